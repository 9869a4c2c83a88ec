"""Personal data: patterns, and terms that disclose them by co-occurrence.

Base spans come from patterns with checks. Around each of them the words of a
window are its context. Over the whole corpus, a term t and a kind of entity k have

    PMI(t, k) = log2 p(t, k) / (p(t) p(k))        IC(k) = -log2 p(k)

with p(t, k) the share of word positions that are t and in a context of k. PMI
never exceeds IC, and equals it where t occurs only near k, so that t reveals k
completely. Their ratio is the disclosure. A term above the first threshold for some
kind is generalised wherever it stands in the corpus, above the second it is removed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import by_size, stored, table

#: Kinds in order; the last two are the method's.
KINDS = ["email", "ip", "card", "phone", "term_generalised", "term_removed"]
EMAIL, IP, CARD, PHONE, GENERALISED, REMOVED = range(6)

LOCAL_PART = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# possessive parts: a failing run of digits is not tried again from its middle,
# where it would fail the same way
IP_TEXT = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD_TEXT = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_TEXT = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")

#: Words on each side of a span that make its context, within so many characters.
WINDOW, REACH = 6, 160
#: Disclosure from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.6, 0.8
#: Different contexts of a kind that must hold a term before its numbers say anything.
SUPPORT = 5
#: Distinct terms a task counts before it passes its sums on.
FLUSH = 100_000
#: Disclosing terms up to which every task holds them; more are joined by a shuffle.
HELD = 200_000


def _emails(text: str) -> list[tuple[int, int]]:
    """Every match holds one @, so they are found from those, in linear time."""
    out, after = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > after and text[begin - 1] in LOCAL_PART:
            begin -= 1
        if begin < at and (found := DOMAIN.match(text, at)):
            out.append((begin, found.end()))
            after = found.end()
        at = text.find("@", at + 1)
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind and start, in code points, end exclusive."""
    out = [(EMAIL, a, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(IP, *m.span()) for m in IP_TEXT.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in CARD_TEXT.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out.append((CARD, *m.span()))
        if "+" in text:
            for m in PHONE_TEXT.finditer(text):
                if 8 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append((PHONE, *m.span()))
    return out


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Terms around the spans, once for each place and kind; ``window`` names the
    words around, so that copies of a passage count as one context."""
    out: dict[tuple[int, int], dict] = {}
    covered = _covering(spans)
    for kind, start, end in spans:
        low = max(0, start - REACH)
        left = [m for m in TERM.finditer(text, low, start) if m.start() > low or low == 0]
        high = min(len(text), end + REACH)
        right = [m for m in TERM.finditer(text, end, high) if m.end() < high or high == len(text)]
        near = left[-WINDOW:] + right[:WINDOW]
        window = hash_of(" ".join(m[0] for m in near))
        for m in near:
            a, b = m.span()
            if covered(a, b):
                continue
            out.setdefault((a, kind), {"term": m[0].lower(), "kind": kind, "start": a, "end": b, "window": window})
    return [out[k] for k in sorted(out)]


def _covering(spans: list[tuple[int, int, int]]):
    """A test whether a stretch overlaps any of the spans, by their union."""
    begins, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)

    def covered(a: int, b: int) -> bool:
        i = bisect_left(begins, b) - 1  # the last one that begins before the stretch's end
        return i >= 0 and ends[i] > a

    return covered


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Every term of a text that overlaps no span, with its place."""
    covered = _covering(spans)
    for m in TERM.finditer(text):
        if not covered(*m.span()):
            yield m[0].lower(), *m.span()


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end")])
_NEAR = T.StructType([
    T.StructField("term", T.StringType()), T.StructField("kind", T.IntegerType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("window", T.LongType()),
])
_COUNT = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One pass over the texts: rows with ``key, rid, spans, near`` of a document,
    and rows with ``counts`` of terms, summed up as far as a task has come."""
    out = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("rid", T.LongType()),
        T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("near", T.ArrayType(_NEAR)),
        T.StructField("counts", T.ArrayType(_COUNT)),
    ])
    kinds = [
        pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])),
        pa.list_(pa.struct([("term", pa.string()), ("kind", pa.int32()), ("start", pa.int32()),
                            ("end", pa.int32()), ("window", pa.int64())])),
        pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())])),
    ]
    names = ["key", "rid", "spans", "near", "counts"]

    def summed(counts: Counter, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        items = [{"term": t, "n": n} for t, n in counts.items()]
        parts = [items[i:i + 5000] for i in range(0, len(items), 5000)]
        yield pa.RecordBatch.from_arrays([
            pa.nulls(len(parts), kind), pa.nulls(len(parts), pa.int64()),
            pa.nulls(len(parts), kinds[0]), pa.nulls(len(parts), kinds[1]), pa.array(parts, kinds[2]),
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = Counter(), None
        for batch in by_size(batches, 2, rows=256):
            kind = batch.column(0).type
            spans, near = [], []
            for t in batch.column(2).to_pylist():
                t = t or ""
                found = base_spans(t)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                near.append(contexts(t, found))
                counts.update(w.lower() for w in TERM.findall(t))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(spans, kinds[0]), pa.array(near, kinds[1]),
                pa.nulls(len(spans), kinds[2]),
            ], names=names)
            if len(counts) > FLUSH:
                yield from summed(counts, kind)
                counts = Counter()
        if counts:
            yield from summed(counts, kind)

    return docs.select(
        F.col(key).alias("key"), F.xxhash64(text).alias("rid"), F.col(text).alias("text"),
    ).mapInArrow(run, out)


def disclosure(scanned: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``term, kind, disclosure`` of each term with enough contexts of a kind."""
    totals = scanned.where("counts is not null").select(F.explode("counts").alias("c")) \
        .groupBy("c.term").agg(F.sum("c.n").alias("n"))
    near = scanned.where("size(near) > 0").select(F.explode("near").alias("x")) \
        .groupBy("x.term", "x.kind", "x.window").agg(F.count("*").alias("n")) \
        .groupBy("term", "kind").agg(F.sum("n").alias("n_near"), F.count("*").alias("contexts"))
    near = stored(near, "pii-near")
    # a number for each kind, and one for the corpus
    places = dict(near.groupBy("kind").agg(F.sum("n_near")).collect())
    words = scanned.where("counts is not null").select(F.explode("counts.n").alias("n")).agg(F.sum("n")).first()[0] or 0
    if not places:
        return near.select("term", "kind", F.lit(0.0).alias("disclosure"))
    shares = [F.lit(x) for kind, n in places.items() for x in (kind, n / words)]
    share = F.element_at(F.create_map(*shares), F.col("kind"))
    pmi = F.log2(F.col("n_near") / F.col("n") / share)
    return near.where(F.col("contexts") >= support).join(totals, "term") \
        .select("term", "kind", F.when(share < 1, pmi / -F.log2(share)).otherwise(0.0).alias("disclosure"))


def occurrences(docs: DataFrame, key: str, text: str, kinds: dict[str, int] | None) -> DataFrame:
    """A second pass over the texts: ``key, rid, found`` with the terms that overlap no
    base span, all of them or those of ``kinds`` with their kind."""
    out = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("rid", T.LongType()),
        T.StructField("found", T.ArrayType(T.StructType([
            T.StructField("term", T.StringType()), T.StructField("kind", T.IntegerType()),
            T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ])
    kind = pa.list_(pa.struct([("term", pa.string()), ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 2, rows=64):
            found = []
            for t in batch.column(2).to_pylist():
                t = t or ""
                if kinds is not None and not any(m.lower() in kinds for m in TERM.findall(t)):
                    found.append([])
                    continue
                found.append([
                    {"term": w, "kind": kinds and kinds[w], "start": a, "end": b}
                    for w, a, b in free_terms(t, base_spans(t)) if kinds is None or w in kinds])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, kind)], names=["key", "rid", "found"])

    return docs.select(
        F.col(key).alias("key"), F.xxhash64(text).alias("rid"), F.col(text).alias("text"),
    ).mapInArrow(run, out)


def find(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT,
) -> DataFrame:
    """``key, rid, spans``: all spans of each row, as structs of kind (an index of
    KINDS), start and end, by kind and start. ``rid`` tells rows of one key apart.

    Base spans are all kept. The method's spans are all occurrences of the disclosing
    terms, in every text, and never overlap a base span. Null and empty texts have no spans. Rows that
    repeat key and text have equal spans each. A corpus without spans gives no
    terms; an empty table gives an empty one. Other columns are not read.
    """
    scanned = stored(scan(docs, key, text), "pii-scan")
    revealing = stored(
        disclosure(scanned, support).where(F.col("disclosure") >= generalise)
        .groupBy("term").agg(F.max("disclosure").alias("disclosure"))
        .select("term", F.when(F.col("disclosure") >= remove, REMOVED).otherwise(GENERALISED).alias("kind")),
        "pii-terms")
    rows, terms = scanned.where("spans is not null"), revealing.count()
    if not terms:
        return rows.select(F.col("key").alias(key), "rid", "spans")
    if terms <= HELD:
        added = occurrences(docs, key, text, {r.term: r.kind for r in revealing.collect()}) \
            .select("key", "rid", F.explode("found").alias("x")).select("key", "rid", "x.kind", "x.start", "x.end")
    else:
        added = occurrences(docs, key, text, None).select("key", "rid", F.explode("found").alias("x")) \
            .select("key", "rid", "x.term", "x.start", "x.end").join(revealing, "term")
    added = added.groupBy("key", "rid").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))
    added = added.select(F.col("key").alias("key2"), F.col("rid").alias("rid2"), "added")
    return rows.join(added, F.col("key").eqNullSafe(F.col("key2")) & (F.col("rid") == F.col("rid2")), "left") \
        .select(
            F.col("key").alias(key), "rid",
            F.when(F.col("added").isNull(), F.col("spans")).otherwise(F.concat("spans", "added")).alias("spans"),
        )


def redact(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with base spans replaced by their kind in capitals, generalised
    terms by ``[TERM]`` and removed terms by nothing. Where spans overlap, the one
    that begins first is replaced, the longest of those. Null stays null."""
    place = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", ""]

    @F.pandas_udf("string")
    def cut(texts, found):
        def one(t, rows):
            if t is None or rows is None or not len(rows):
                return t
            out, at = [], 0
            for s in sorted(rows, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    out += [t[at:s["start"]], place[s["kind"]]]
                    at = s["end"]
            return "".join(out) + t[at:]

        return texts.combine(found, one)

    of_row = spans.select(F.col(key).alias("__key"), F.col("rid").alias("__rid"), F.col("spans").alias("__spans")) \
        .dropDuplicates(["__key", "__rid"])
    joined = docs.join(of_row, docs[key].eqNullSafe(F.col("__key")) & (F.xxhash64(docs[text]) == F.col("__rid")), "left")
    return joined.withColumn(text, cut(F.col(text), F.col("__spans"))).select(*docs.columns)


def _joined(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document: counts and digest of the base ones, text of all."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] <= PHONE)

    def number(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = map(number, (EMAIL, IP, CARD, PHONE))
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )
