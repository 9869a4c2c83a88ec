"""Line dedup by content-defined chunks of lines.

A text is a list of lines; blank ones neither count nor divide. Each line has a hash,
and a rolling hash over the line hashes (cyclic polynomial, two lines wide) stands for
each place of the text. It chooses the boundaries: a chunk ends where the rolling hash
occurs nowhere else in the corpus, or where what it stands for goes on differently at
its first occurrence. So boundaries depend on the lines at them alone, wherever in a
text they are, and a chunk is a longest stretch of lines that stand elsewhere in the
same order, from two lines on.

1. Rolling hashes are counted over the corpus, as longs. Only places of repeated ones go on.
2. Their lines are compared byte by byte, and each has a first occurrence: the smallest
   key, then the text's hash, then the place.
3. Of a first occurrence that would itself lose a line nothing is removed: what goes
   must stand somewhere in what stays.
4. The other places are put together to chunks, and their lines removed. So every removed
   chunk stands whole, in order and untouched at its first occurrence.

Only DataFrame functions are used. What is shuffled is longs, the lines of repeated places
once, to be compared, and the documents once, to be put together again (twice, if there
are more repeated hashes than are broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import let, stored, table

#: Lines that a chunk has at least.
MIN_LINES = 2
#: Repeated hashes that every task holds; more of them are joined by a shuffle.
HELD = 2_000_000
#: What a blank line may consist of.
BLANKS = " \t\r\u000b\u000c"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _solid(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def _turned(hashed: Column, bits: int) -> Column:
    """Rotated to the left."""
    if not bits:
        return hashed
    return F.shiftleft(hashed, bits).bitwiseOR(F.shiftrightunsigned(hashed, 64 - bits))


def rolling(text: Column, size: int, with_lines: bool = False) -> Column:
    """Array of ``hash`` (and ``lines``, joined) over each ``size`` neighbouring lines
    that are not blank, by place; null for shorter texts."""

    def of(lines):
        def of_hashes(hashes):
            def at(i):
                rolled = _turned(F.get(hashes, i), size - 1)
                for k in range(1, size):
                    rolled = rolled.bitwiseXOR(_turned(F.get(hashes, i + k), size - 1 - k))
                whole = [F.lit("lines"), F.array_join(F.slice(lines, i + 1, size), "\n")] if with_lines else []
                return F.named_struct(F.lit("hash"), rolled, *whole)

            return F.when(F.size(lines) >= size, F.transform(F.sequence(F.lit(0), F.size(lines) - size), at))

        return let(F.transform(lines, lambda x: F.xxhash64(x)), of_hashes)

    return let(F.filter(lines_of(text), _solid), of)


def _repeated(docs: DataFrame, size: int, held: int) -> DataFrame:
    """``hash, doc, place, lines`` of every place whose rolling hash occurs more than once."""
    twice = docs.select(F.explode(rolling(F.col("text"), size)).alias("w")).groupBy("w.hash") \
        .agg(F.count("*").alias("times")).where("times > 1").select("hash")
    twice = stored(twice, "lines-twice")
    if twice.count() <= held:
        found = docs.select("doc", F.posexplode(rolling(F.col("text"), size, True)).alias("place", "w"))
        return found.select("w.hash", "doc", "place", "w.lines").join(F.broadcast(twice), "hash", "left_semi")
    # longs alone meet the hashes, and the documents then get their places back
    found = docs.select("doc", F.posexplode(rolling(F.col("text"), size)).alias("place", "w")) \
        .select("w.hash", "doc", "place").join(twice, "hash", "left_semi")
    of_doc = found.groupBy("doc").agg(F.collect_set("place").alias("places"))
    windows = docs.dropDuplicates(["doc"]).join(of_doc, "doc") \
        .select("doc", F.explode("places").alias("place"), rolling(F.col("text"), size, True).alias("all"))
    return windows.select("doc", "place", F.get("all", F.col("place")).alias("w")).select("w.hash", "doc", "place", "w.lines")


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, held: int = HELD) -> DataFrame:
    """``doc, begin, end, first, at``: chunks to be removed, as places of the lines that are
    not blank, from 0, ``end`` included, and where they stand: from line ``at`` of ``first``.

    ``doc`` and ``first`` are structs of the key and a hash of the text, ``rid``, so rows of one
    key, null too, are documents of their own if their texts differ.
    """
    docs = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("rid")).alias("doc"), F.col(text).alias("text"))
    found = stored(_repeated(docs, min_lines, held), "lines-found")
    # grouping by the lines themselves compares the bytes
    firsts = found.groupBy("hash", "lines").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("times"))
    firsts = stored(firsts.where("times > 1").select("hash", "lines", "first"), "lines-firsts")
    # a hash of several different lines is a rare collision; all others need no lines from here on
    by_hash = firsts.groupBy("hash").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    mixed = stored(by_hash.where("n > 1").select("hash"), "lines-mixed")
    placed = found.select("hash", "doc", "place").join(by_hash.where("n = 1").select("hash", "first"), "hash").select("doc", "place", "first")
    if not mixed.isEmpty():
        same = found.join(mixed, "hash").join(firsts, ["hash", "lines"]).select("doc", "place", "first")
        placed = placed.unionByName(same)
    # in the first occurrence's own text only what does not overlap it is another one
    other = (F.col("doc") != F.col("first.doc")) | (F.col("place") >= F.col("first.place") + min_lines)
    others = stored(placed.where(other).distinct(), "lines-others")
    owners = others.select("first").distinct()
    near = owners.select("first", F.explode(F.sequence(F.lit(1 - min_lines), F.lit(min_lines - 1))).alias("d")) \
        .select("first", F.col("first.doc").alias("doc"), (F.col("first.place") + F.col("d")).alias("place"))
    losing = near.join(others.select("doc", "place"), ["doc", "place"], "left_semi").select("first").distinct()
    going = others.join(stored(losing, "lines-losing"), "first", "left_anti")
    # neighbouring places that follow one another at the first occurrence too
    stretch = ["doc", F.col("first.doc").alias("source"), (F.col("place") - F.col("first.place")).alias("shift")]
    rows = going.select(*stretch, "place")
    run = F.col("place") - F.row_number().over(Window.partitionBy("doc", "source", "shift").orderBy("place"))
    return rows.withColumn("run", run).groupBy("doc", "source", "shift", "run").agg(
        F.min("place").alias("begin"), (F.max("place") + (min_lines - 1)).alias("end"),
    ).select("doc", "begin", "end", F.col("source").alias("first"), (F.col("begin") - F.col("shift")).alias("at"))


def dedupe(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, held: int = HELD,
) -> DataFrame:
    """``docs`` with repeated chunks of lines taken out of ``text``, and ``removed_lines``,
    the number of lines that went (a column of that name is replaced).

    The first occurrence of a chunk stays, null keys come first. Rows of one key and text
    are one document: they keep what one of them keeps. Blank lines are no part of the
    comparison; those inside a removed chunk go with it, all others stay. A null text
    stays null, an empty one empty; a text of one line has no chunk and never changes. A text
    that is nothing but repeated chunks becomes empty. An empty table gives an empty one; other columns
    stay as they are.
    """
    gone = chunks(docs, key, text, min_lines, held).groupBy("doc").agg(F.collect_set(F.struct("begin", "end")).alias("__gone")) \
        .select(F.col("doc").alias("__doc"), "__gone")
    columns = [c for c in docs.columns if c != "removed_lines"]
    rows = docs.select(*columns, F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("rid")).alias("__row"))
    joined = rows.join(gone, F.col("__row") == F.col("__doc"), "left")

    def cut(lines):
        places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: _solid(F.get(lines, i)))
        return let(places, lambda at: F.array_distinct(F.flatten(F.transform(
            "__gone", lambda c: F.sequence(F.get(at, c["begin"]), F.get(at, c["end"]))))))

    cuts = F.when(F.col("__gone").isNotNull(), let(lines_of(F.col(text)), cut))
    joined = joined.withColumn("__cuts", cuts)

    def rest(lines):
        # by a set: in linear time however many go
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__cuts"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    texts = F.when(F.col("__cuts").isNull(), F.col(text)).otherwise(let(lines_of(F.col(text)), rest)).alias(text)
    return joined.select(
        *[texts if c == text else F.col(c) for c in columns],
        F.coalesce(F.size("__cuts"), F.lit(0)).cast("long").alias("removed_lines"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the chunks of lines that stand elsewhere before it."""
    docs = dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "text", "removed_lines", F.length("text").cast("long").alias("n_chars"))
