"""Language ID as a mixture: each document's language proportions by expectation-
maximisation over n-gram likelihoods, and its set of languages by a penalised
likelihood.

Learning counts hashed letter trigrams of every labelled text, by language; the
counts of a task leave it already added up. The model has one row of a fixed
number of buckets for each language, so its size depends on the number of
languages alone.

A document is a bag of trigrams drawn from a mixture of the languages. The
proportions come from EM over all languages. Languages then join one at a time, in
the order of their proportions, as long as the penalised log-likelihood (half a
log of the number of trigrams for each further language) rises, with proportions
fitted anew. The language with the largest proportion in that set is the prediction and
the proportion its score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import by_size, table

BUCKETS = 1 << 16
ROUNDS = 12
UNDECIDED = "und"
SPACE = 0x20

_letters: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """Lower-cased letter of each code point, a space for all others."""
    if "table" not in _letters:
        out = np.full(0x110000, SPACE, np.uint32)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                lower = char.lower()
                out[point] = ord(lower) if len(lower) == 1 else point
        _letters["table"] = out
    return _letters["table"]


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each letter trigram, word ends included; those of three or of a
    middle space and none beside it are left out."""
    if not text:
        return np.zeros(0, np.int64)
    points = _letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate([[SPACE], points, [SPACE]]).astype(np.uint32)
    blank = points == SPACE
    points = points[~(blank & np.concatenate([[False], blank[:-1]]))]  # one space for several
    a, b, c = points[:-2], points[1:-1], points[2:]
    with np.errstate(over="ignore"):
        mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        mixed ^= mixed >> np.uint32(16)
    return (mixed[b != SPACE] & np.uint32(BUCKETS - 1)).astype(np.int64)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of each bucket in each (float32, a row
    per bucket), from all rows with a language.

    Each task sends at most one count per language and bucket; Spark adds them up.
    The driver receives that table: languages times 65536 numbers at most, however
    many rows there are. ``lang`` names languages, of which there are dozens. A worker holds the
    trigrams of a few megabytes of text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in by_size(batches, 0):
            found: dict[str, list[np.ndarray]] = {}
            for t, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(l, []).append(trigrams(t))
            for l, parts in found.items():
                counts[l] = counts.get(l, 0) + np.bincount(np.concatenate(parts), minlength=BUCKETS)
        for l, row in counts.items():
            full = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([l] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(row[full], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    found = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")) \
        .where("lang is not null").mapInArrow(run, "lang string, bucket int, n long") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.full((BUCKETS, len(langs)), 0.0)
    for k, name in enumerate(langs):
        rows = found[found["lang"] == name]
        counts[rows["bucket"].to_numpy(), k] = rows["n"].to_numpy()
    # what a language has not shown is taken from all of them together
    every = (counts.sum(axis=1) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
    total = counts.sum(axis=0)
    weight = 200.0
    return langs, np.log((counts + weight * every[:, None]) / (total + weight)).astype(np.float32)


def _mixture(likely: np.ndarray, times: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by EM, and the likelihood of each bucket under them."""
    share = start
    for _ in range(rounds):
        each = likely * share
        of_bucket = each.sum(axis=1)
        new = (times / of_bucket) @ each / times.sum()
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, likely @ share


def infer(buckets: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Languages of the chosen set, best first, and their proportions; mean and standard
    deviation of the trigrams' log-likelihood under that mixture."""
    found, times = np.unique(buckets, return_counts=True) if len(buckets) < 3000 else (None, None)
    if found is None:
        times = np.bincount(buckets, minlength=BUCKETS)
        found = np.flatnonzero(times)
        times = times[found]
    rows = logs[found].astype(np.float64)
    top = rows.max(axis=1, keepdims=True)
    likely = np.exp(rows - top)
    base = float(times @ top[:, 0])
    n, k = len(buckets), logs.shape[1]
    share, _ = _mixture(likely, times, np.full(k, 1.0 / k), ROUNDS)
    order = np.lexsort((np.arange(k), -share))
    best, kept, chosen, fitted = -np.inf, order[:1], np.ones(1), likely[:, order[0]]
    for size in range(1, k + 1):
        part = order[:size]
        if size == 1:
            some, under = np.ones(1), likely[:, part[0]]
        else:
            some, under = _mixture(likely[:, part], times, share[part] / share[part].sum(), ROUNDS)
        score = base + float(times @ np.log(np.maximum(under, 1e-300))) - 0.5 * (size - 1) * np.log(n)
        if score <= best:
            break
        best, kept, chosen, fitted = score, part, some, under
    rank = np.lexsort((kept, -chosen))
    each = np.log(np.maximum(fitted, 1e-300)) + top[:, 0]
    mean = float(times @ each) / n
    return kept[rank], chosen[rank], mean, float(np.sqrt(max(0.0, float(times @ each ** 2) / n - mean ** 2)))


_MODELS: dict[str, tuple[list[str], np.ndarray]] = {}


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """``key, lang_pred, score, langs, shares, grams, fit, spread``: the language with the
    largest share, that share (0 to 1), and the whole set with its proportions, largest
    first; the number of trigrams, and the mean and standard deviation of their log-likelihood.

    A share is one among the learned languages, so it says nothing of a text in another one;
    the log-likelihood does (see ``expected`` and ``plausible``).

    Null, empty and letterless texts, and all texts if nothing was learned, are
    ``und`` with score 0, no languages and a null fit. Equal shares go to the language first in
    order. Whole texts are read, whatever their length. Repeated rows stay repeated;
    an empty table gives an empty one. Columns in ``carry`` come along in a struct
    ``row``, so that their names cannot clash; others are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = shared.value
        langs, logs = _MODELS[name]
        for batch in by_size(batches, 1):
            best, score, sets, shares, grams, fits, spreads = [], [], [], [], [], [], []
            for t in batch.column(1).to_pylist():
                buckets = trigrams(t)
                grams.append(len(buckets))
                if not len(buckets) or not langs:
                    best.append(UNDECIDED), score.append(0.0), sets.append([]), shares.append([])
                    fits.append(None), spreads.append(None)
                    continue
                which, part, fit, spread = infer(buckets, logs)
                fits.append(fit), spreads.append(spread)
                best.append(langs[which[0]]), score.append(min(1.0, float(part[0])))
                sets.append([langs[i] for i in which]), shares.append(part.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()),
                 pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())),
                 pa.array(grams, pa.int64()), pa.array(fits, pa.float64()), pa.array(spreads, pa.float64()),
                 *batch.columns[2:]],
                names=["key", "lang_pred", "score", "langs", "shares", "grams", "fit", "spread", "row"][:6 + batch.num_columns],
            )

    out = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("langs", T.ArrayType(T.StringType())),
        T.StructField("shares", T.ArrayType(T.DoubleType())), T.StructField("grams", T.LongType()),
        T.StructField("fit", T.DoubleType()), T.StructField("spread", T.DoubleType()),
    ])
    columns = [F.col(key).alias("key"), F.col(text).alias("text")]
    if carry:
        columns.append(F.struct(*carry).alias("row"))
    rows = docs.select(*columns)
    return rows.mapInArrow(run, T.StructType([*out.fields, *rows.schema.fields[2:]])).withColumnRenamed("key", key)


def expected(found: DataFrame) -> tuple[float, float] | None:
    """Mean and standard deviation of a trigram's log-likelihood over all trigrams of
    identified texts, in one pass; nothing if there are none. Taken over labelled texts that
    the model has not seen, it tells what a text in these languages is like."""
    n, square = F.sum("grams"), F.col("spread") * F.col("spread") + F.col("fit") * F.col("fit")
    row = found.where("fit is not null").agg(
        (F.sum(F.col("grams") * F.col("fit")) / n).alias("mean"), (F.sum(F.col("grams") * square) / n).alias("square")).first()
    return None if row.mean is None else (row.mean, max(0.0, row.square - row.mean ** 2) ** 0.5)


#: Standard deviations below the mean at which a text is no longer plausible, and further ones
#: for the chance in the mean of few trigrams.
AWAY, CHANCE = 3.0, 6.0


def plausible(usual: tuple[float, float]) -> F.Column:
    """Whether a text's fit is that of the languages learned, whatever their shares."""
    mean, deviation = usual
    return F.col("fit") >= F.lit(mean) - F.lit(deviation) * (AWAY + CHANCE / F.sqrt("grams"))


def fold(key: str = "doc_id"):
    """The fold of a row, 0 to 3; those in fold 2 are never learned from."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4))


def training(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(fold() != 2, F.lit(True)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside fold 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learn(training(docs)))
    return found.select(
        "doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score",
    )
