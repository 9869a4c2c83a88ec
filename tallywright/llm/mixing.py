"""Mixing sources to target weights by pivotal rounding.

A source's target divided by its size is the number of copies each of its documents
should have: a whole part, and a fraction. The fractions become 0 or 1 by pivotal
rounding: two documents meet, and mass moves at random from one to the other until
one of them is whole; the other goes on. Every document keeps its expectation, and
the number of documents that get a further copy misses its expectation by less
than one.

Documents meet within blocks of about a hundred, by source and size class, so that
words are met as well as counts. Each block leaves at most one document undecided;
those are dealt into blocks of their source again, and so on: a tree whose depth is
the logarithm of a source's size, with a bounded array at each node. A source of
any size is as many blocks as it needs.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import stored, table, words_in

WEIGHTS = (5.0, 2.0, 1.0)
#: A target is at most so many times its source's size.
MOST = 3.0
#: Mean number of documents in a block.
BLOCK = 96
EPSILON = 1e-9
#: What tells documents apart: key, hash of the text, and a number within equal rows.
_IDENTITY = ("key", "rid", "salt")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: a row per source.

    Weights repeat over the sources in code point order, null last. Sources whose
    share exceeds ``most`` times their size stop there, smallest ratio first, and the
    rest is shared by the others' weights.
    """
    by_source = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    # one row per source from here on
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    limits = ranked.select(
        "source", "source_size", "rank", F.sum("source_size").over(Window.partitionBy()).cast("double").alias("total"),
        F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).alias("w"),
        (F.lit(float(most)) * F.col("source_size")).alias("limit"),
    )
    before = Window.orderBy(F.col("limit") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / \
        (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    stopped = limits.withColumn("stops", level * F.col("w") >= F.col("limit"))
    shared = stopped.select(
        "source", "source_size", "w", "limit", "stops",
        (F.col("total") - F.sum(F.when(F.col("stops"), F.col("limit")).otherwise(0.0)).over(all_rows)).alias("left"),
        F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("w"))).over(all_rows).alias("others"),
    )
    return shared.select("source", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(
        F.least("limit", F.col("left") * F.col("w") / F.when(F.col("others") > 0, F.col("others")))).alias("target"))


def _uniform(seed: int, level: int):
    """A number in [0, 1) that depends on the document and the level alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), *_IDENTITY), 11) / F.lit(float(1 << 53))


_UNIT = "struct<size:bigint,u:double,key:{key},rid:bigint,salt:bigint,whole:bigint,p:double>"


def _round_block(units, key: str):
    """A block's documents with ``p`` 0 or 1, but for the last, which carries the rest."""
    unit = _UNIT.format(key=key)

    def set_p(x, p):
        return F.struct(*[x[c].alias(c) for c in ("size", "u", *_IDENTITY, "whole")], p.cast("double").alias("p"))

    def meet(state, x):
        old = state["old"]
        both = old["p"] + x["p"]
        small = both < 1.0
        # the chance that mass moves to the old one
        chance = F.when(small, F.when(both > 0, old["p"] / both).otherwise(0.0)) \
            .otherwise(F.when(both < 2.0, (1.0 - x["p"]) / (2.0 - both)).otherwise(1.0))
        to_old = x["u"] < chance
        rest = F.when(small, both).otherwise(both - 1.0)
        whole = F.when(small, 0.0).otherwise(1.0)
        # small: the one that mass leaves is decided; else the one that it fills
        old_goes_on = F.when(small, to_old).otherwise(~to_old)
        decided = F.when(old_goes_on, set_p(x, whole)).otherwise(set_p(old, whole))
        goes_on = F.when(old_goes_on, set_p(old, rest)).otherwise(set_p(x, rest))
        return F.struct(F.concat(state["done"], F.array(decided)).alias("done"), goes_on.alias("old"))

    start = F.struct(F.array().cast(f"array<{unit}>").alias("done"), F.element_at(units, 1).cast(unit).alias("old"))
    return F.aggregate(F.slice(units, 2, F.size(units) - 1), start, meet)


def rounded(units: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """``key, rid, source, size, copies`` from ``key, rid, salt, source, size, rate``.

    A document's block depends on ``key, rid, salt``, so rows that share none of them meet
    as others do; ``_round_block`` copies its array for each row, and blocks stay small.
    """
    kind = units.schema["key"].dataType.simpleString()
    whole = F.floor(F.col("rate") + EPSILON)
    rest = F.greatest(F.lit(0.0), F.col("rate") - whole)
    open_rows = units.select(
        *_IDENTITY, "source", "size", whole.cast("long").alias("whole"),
        F.when(rest > EPSILON, rest).otherwise(0.0).alias("p"),
        # classes of an eighth of an octave
        F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int").alias("class"),
    )
    settled, level = [], 0
    while True:
        groups = stored(open_rows.groupBy("source", "class").agg(F.count("*").alias("n")), f"mix-counts-{level}")
        most = groups.agg(F.max("n")).first()[0] or 0
        last = level > 0 and most <= 2 * block
        dealt = open_rows.join(
            groups.select(F.col("source").alias("s"), F.col("class").alias("c"), "n"),
            F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")),
        ).select(
            *_IDENTITY, "source", "size", "whole", "p", "class", _uniform(seed, level).alias("u"),
            F.when(F.lit(last), F.lit(0)).otherwise(F.pmod(
                F.xxhash64(F.lit(seed + 1), F.lit(level), *_IDENTITY), F.ceil(F.col("n") / block))).alias("block"),
        )
        unit = F.struct("size", "u", *_IDENTITY, "whole", "p")
        met = dealt.groupBy("source", "class", "block").agg(F.sort_array(F.collect_list(unit)).alias("units")) \
            .select("source", _round_block(F.col("units"), kind).alias("b"))
        met = met.select("source", F.explode(F.concat(
            F.transform("b.done", lambda x: F.struct(x.alias("x"), F.lit(True).alias("settled"))),
            F.array(F.struct(F.col("b.old").alias("x"), F.lit(False).alias("settled"))),
        )).alias("e")).select(*[f"e.x.{c}" for c in _IDENTITY], "source", "e.x.size", "e.x.whole", "e.x.p", "e.settled")
        met = stored(met, f"mix-level-{level}")
        settled.append(met.where("settled").select("key", "rid", "source", "size", (F.col("whole") + F.col("p").cast("long")).alias("copies")))
        open_rows = met.where("not settled").select(*_IDENTITY, "source", "size", "whole", "p", F.lit(0).alias("class"))
        level += 1
        if last or most == 0:
            break
    one = F.when(F.col("p") <= EPSILON, 0).when(F.col("p") >= 1 - EPSILON, 1) \
        .when(_uniform(seed + 2, level) < F.col("p"), 1).otherwise(0)
    out = open_rows.select("key", "rid", "source", "size", (F.col("whole") + one).cast("long").alias("copies"))
    for rows in settled:
        out = out.unionByName(rows)
    return out


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple = WEIGHTS, most: float = MOST, seed: int = 7,
) -> DataFrame:
    """``key, rid, source, size, source_size, target, copies``: for each row how often the
    mix takes it; ``rid`` is a hash of the text.

    Size is the number of words, 0 for null and empty texts. A null source is a
    source of its own, last in order. Sources without words have target 0 and no
    copies. Copies never exceed ``most``, rounded up. Repeated rows are rows of their
    own, also a third of all rows that share key and text. The result depends on keys, texts,
    sources and ``seed``, and on how equal rows are spread over the files, so reruns agree.
    An empty table gives an empty one; other columns are not read.
    """
    sizes = stored(docs.select(
        F.col(key).alias("key"), F.xxhash64(text).alias("rid"), F.col(source).alias("source"),
        words_in(F.col(text)).alias("size"), F.monotonically_increasing_id().alias("at")), "mix-sizes")
    # equal rows get a number each, so that they do not all meet in one block
    twins = sizes.groupBy(F.struct("key", "rid").alias("same")).agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes.join(twins, F.struct("key", "rid") == F.col("same"), "left").select(
        "key", "rid", "source", "size", F.when(F.col("same").isNull(), F.lit(0)).otherwise(F.col("at")).alias("salt")), "mix-rows")
    aims = stored(targets(sizes, weights, most), "mix-targets")
    aim = aims.select(F.col("source").alias("s"), "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("s"))
    units = sizes.join(aim, same).select(
        *_IDENTITY, "source", "size",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )
    return rounded(units, seed).join(aim, same).select(
        F.col("key").alias(key), "rid", F.col("source").alias(source), "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows that share key and text are copies of a document: one of them is repeated, as
    often as all of them are taken. Rows of one key, null too, with other texts are others.
    """
    taken = stored(mix(docs, key, text, source, **options).groupBy(F.struct(F.col(key).alias("key"), "rid").alias("__same")).agg(
        F.sum("copies").alias("__copies"), F.count("*").alias("__n")).where("__copies > 0"), "mix-taken")
    same = F.struct(docs[key].alias("key"), F.xxhash64(docs[text]).alias("rid")) == F.col("__same")
    # the keys grow with the documents, so they are shuffled and merged at any size
    single = docs.join(taken.where("__n = 1").hint("merge"), same)
    several = docs.join(taken.where("__n > 1"), same).dropDuplicates(["__same"])
    return single.unionByName(several) \
        .select(*[F.col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__i")) \
        .drop("__i")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    found = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
