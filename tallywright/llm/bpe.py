"""Byte-level BPE: encoding of texts to ids and decoding of ids to bytes.

Pre-tokenisation uses no regular expression. A table gives each code point a
class; an array of classes becomes an array of transition functions over four
states; an associative scan composes them, which gives the state before each
code point; and a boundary follows from two neighbouring classes and that state.
The slices between boundaries go through a cache of pair merges.

The four states say what an apostrophe would do that may begin a contraction
(``'s 't 'm 'd 're 've 'll``): begin it (OPEN), belong to the run before it
(SHUT), or whether one or two letters of a contraction are still to come. All
other parts of the pattern are decided by neighbours.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import by_size

OTHER, LETTER, NUMBER, BLANK, WHITE, GAP = range(6)
OPEN, SHUT, ONE, TWO = range(4)

#: Code points with the property White_Space, but for the space.
WHITE_POINTS = [
    *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
#: Endings that an apostrophe takes along.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")

#: Slices in one generation of a worker's cache; it keeps two.
CACHE_SLICES = 150_000
#: Bytes of text that a worker encodes at a time, and code points from which a text is cut.
BATCH_BYTES, STRETCH = 1 << 20, 1 << 20
#: Slices of more bytes are merged with a heap and are not remembered.
LONG_SLICE = 96


def class_table() -> np.ndarray:
    """Class of each code point, with letters and numbers as tiktoken sees them."""
    import tiktoken

    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        probe = tiktoken.Encoding(
            "probe", pat_str=pattern, special_tokens={},
            mergeable_ranks={bytes([b]): b for b in range(256)},
        )
        found = probe.decode_bytes(probe.encode_ordinary(points)).decode()
        classes[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    classes[WHITE_POINTS] = WHITE
    classes[0x20] = BLANK
    return classes


def _function(of_open: int, of_shut: int) -> int:
    """A transition function as a byte, two bits for the image of each state.
    Within a contraction the next code point only counts down."""
    return of_open | of_shut << 2 | OPEN << 4 | ONE << 6


_TO_OPEN = _function(OPEN, OPEN)
_TO_SHUT = _function(SHUT, SHUT)
_TO_ONE = _function(ONE, SHUT)
_TO_TWO = _function(TWO, SHUT)
_RESET = OPEN | OPEN << 2 | OPEN << 4 | OPEN << 6
_BY_CLASS = np.array([_TO_SHUT, _TO_OPEN, _TO_OPEN, _TO_SHUT, _TO_OPEN, _RESET], np.uint8)


def _composition() -> np.ndarray:
    """``table[f << 8 | g]``: first f, then g."""
    f, g = np.divmod(np.arange(1 << 16), 256)
    out = np.zeros(1 << 16, np.uint8)
    for state in range(4):
        middle = f >> 2 * state & 3
        out |= ((g >> 2 * middle & 3) << 2 * state).astype(np.uint8)
    return out


_COMPOSE = _composition()
_CONSTANT = np.zeros(256, bool)
_CONSTANT[[0, 0x55, 0xAA, 0xFF]] = True


def _scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive scan under composition, by doubling the reach of each function.

    A function that has become constant does not depend on anything before it,
    so the scan ends when all are.
    """
    reach, out = 1, functions.copy()
    while reach < len(out):
        late = ~_CONSTANT[out[reach:]]
        if not late.any():
            break
        if reach < 4:  # most still depend on what is before
            out[reach:] = _COMPOSE[out[:-reach].astype(np.uint16) << 8 | out[reach:]]
        else:
            late = np.flatnonzero(late) + reach
            out[late] = _COMPOSE[out[late - reach].astype(np.uint16) << 8 | out[late]]
        reach *= 2
    return out


def boundaries(points: np.ndarray, gaps: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a slice begins at each code point.

    ``gaps``: places of the separators between texts; each is a slice of its own
    and nothing looks past it.
    """
    kind = classes[points]
    kind[gaps] = GAP
    functions = _BY_CLASS[kind]

    marks = np.flatnonzero(points == 0x27)
    marks = marks[kind[marks] == OTHER]
    if len(marks):
        at = lambda k: np.where(
            marks + k < len(points), points[np.minimum(marks + k, len(points) - 1)], 0
        )
        first, second = at(1), at(2)
        short = np.isin(first, [ord(c) for c in SHORT_ENDINGS])
        long = np.zeros(len(marks), bool)
        for a, b in LONG_ENDINGS:
            long |= (first == ord(a)) & (second == ord(b))
        gap = np.zeros(len(points) + 3, bool)
        gap[gaps] = True
        short &= ~gap[marks + 1]
        long &= ~gap[marks + 1] & ~gap[marks + 2]
        functions[marks[short]] = _TO_ONE
        functions[marks[long]] = _TO_TWO
    state = _scan(functions) & 3  # the state after each code point, from OPEN

    before, now = kind[:-1], kind[1:]
    blank = (before == BLANK) | (before == WHITE)
    white = (now == BLANK) | (now == WHITE)
    starts = np.ones(len(points), bool)
    starts[1:] = ~(
        (before == now) & ~blank  # one run
        | (before == BLANK) & ~white & (now != GAP)  # a space and the run it leads
        | blank & white
    )
    # the last of several white characters stands alone if something follows
    inner = blank[:-1] & white[:-1] if len(points) > 2 else np.zeros(0, bool)
    if len(inner):
        follows = ~((kind[2:] == BLANK) | (kind[2:] == WHITE) | (kind[2:] == GAP))
        starts[1:-1] |= inner & follows
    if len(marks):
        inside = (state[:-1] == ONE) | (state[:-1] == TWO)
        starts[1:][inside] = False
        ends = np.flatnonzero(state[:-1] == ONE) + 2  # the first code point behind a contraction
        starts[ends[ends < len(points)]] = True
        begins = np.flatnonzero(((functions == _TO_ONE) & (state == ONE)) | ((functions == _TO_TWO) & (state == TWO)))
        starts[begins] = True
    starts[gaps] = True
    after = gaps + 1
    starts[after[after < len(points)]] = True
    return starts


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank is joined first, the
    leftmost of equal ones, until no pair has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LONG_SLICE:
        return _merge_long(piece, ranks)
    none, rank_of = len(ranks), ranks.get
    cuts = list(range(len(piece) + 1))
    pairs = [rank_of(piece[i:i + 2], none) for i in cuts[:-2]]  # rank of part i with the next
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = rank_of(piece[cuts[i]:cuts[i + 2]], none)
        if i:
            pairs[i - 1] = rank_of(piece[cuts[i - 1]:cuts[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over linked parts: n log n for slices of any length."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that begins here; 0 if it was joined
    left = list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            rank = ranks.get(piece[i:end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or j >= n or end[j] != k:
            continue  # one of the two has changed since
        end[i], end[j] = k, 0
        if k < n:
            left[k] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each byte string of a rank file (base64, a space, the rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Ranks, classes and the cache of a worker."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.ranks, self.classes = ranks, classes
        self.cache, self.older = {}, {}  # slices of now, and those before the last turn

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Per text: ids, begin of each slice in code points, ids up to its end."""
        joined = "\0".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        begins = ends - lengths
        if not joined:
            none = [np.zeros(0, np.int32)] * len(texts)
            return none, none, none
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cuts = np.flatnonzero(boundaries(points, ends[:-1], self.classes))
        slices = [joined[a:b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(joined)])]
        if len(self.cache) > CACHE_SLICES:
            self.cache, self.older = {}, self.cache
        known, older = self.cache, self.older
        coded = [*map(known.get, slices)]
        if None in coded:
            for i in [i for i, ids in enumerate(coded) if ids is None]:
                new = slices[i]
                ids = known.get(new) or older.get(new)
                if ids is None:
                    parts = merge(new.encode(), self.ranks)
                    ids = pack(f"{len(parts)}i", *parts)
                if len(new) <= LONG_SLICE:
                    known[new] = ids
                coded[i] = ids
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat, upto = np.frombuffer(b"".join(coded), np.int32), np.concatenate([[0], np.cumsum(sizes)])
        first, last = np.searchsorted(cuts, begins), np.searchsorted(cuts, ends)
        out = ([], [], [])
        for begin, a, b in zip(begins.tolist(), first.tolist(), last.tolist()):
            out[0].append(flat[upto[a]:upto[b]])
            out[1].append((cuts[a:b] - begin).astype(np.int32))
            out[2].append((upto[a + 1:b + 1] - upto[a]).astype(np.int32))
        return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))


_ASCII_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """A long text cut where a slice begins whatever stands around: before a space between
    two letters. Nothing looks past such a place, so stretches are encoded one by one. A text
    without any stays whole."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and not (cut + 1 < len(text) and text[cut - 1] in _ASCII_LETTERS and text[cut + 1] in _ASCII_LETTERS):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def _encoded(encoder: Encoder, texts: list[str], size: int):
    """As the encoder, with long texts a stretch at a time."""
    if max(map(len, texts), default=0) <= size:
        return encoder(texts)
    out = ([], [], [])
    for text in texts:
        parts, points, ids = [], 0, 0
        for stretch in stretches(text, size):
            found, starts, ends = (x[0] for x in encoder([stretch]))
            parts.append((found, starts + np.int32(points), ends + np.int32(ids)))
            points, ids = points + len(stretch), ids + len(found)
        for column, values in zip(out, zip(*parts)):
            column.append(np.concatenate(values))
    return out


_ENCODERS: dict[str, Encoder] = {}


def encode(
    docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text",
    batch_bytes: int = BATCH_BYTES, stretch: int = STRETCH,
) -> DataFrame:
    """Ids of every text: ``key, ids, starts, ends``.

    ``starts`` holds the code point at which each slice begins and ``ends`` the
    number of ids up to its end, so a stretch of the text can be found in the ids
    and the reverse (see :func:`decode_slices`).

    ``ranks_path`` is a rank file the driver can read; the table (one entry per
    id, 50 thousand here) and the class table go to the executors as a broadcast
    of fixed size. Each worker encodes texts of ``batch_bytes`` at a time, and longer ones by
    stretches, so the arrays that it holds do not grow with the texts.

    Nulls and empty texts give empty arrays. Repeated rows stay repeated rows.
    An empty table gives an empty one. Only the two columns are read, so further
    columns and their names do not matter.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((read_ranks(ranks_path), class_table()))
    name = uuid.uuid4().hex  # a worker lives through many tasks and keeps its cache

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(*shared.value)
        encoder = _ENCODERS[name]
        for batch in by_size(batches, 1, batch_bytes, 256):
            ids, starts, ends = _encoded(encoder, [t or "" for t in batch.column(1).to_pylist()], stretch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(ids), _lists(starts), _lists(ends)],
                names=["key", "ids", "starts", "ends"],
            )

    kind = docs.schema[key].dataType
    numbers = T.ArrayType(T.IntegerType())
    out = T.StructType([
        T.StructField("key", kind), T.StructField("ids", numbers),
        T.StructField("starts", numbers), T.StructField("ends", numbers),
    ])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")) \
        .mapInArrow(run, out).withColumnRenamed("key", key)


def decode(coded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns, and the bytes of the ids as ``out`` (replaced if there is one).

    Null ids give null, no ids give no bytes. An id without an entry fails the job:
    it cannot come from these ranks.
    """
    shared = coded.sparkSession.sparkContext.broadcast(
        {rank: raw for raw, rank in read_ranks(ranks_path).items()}
    )

    @F.pandas_udf(T.BinaryType())
    def raw_bytes(series):
        of = shared.value.__getitem__
        return series.map(lambda x: None if x is None else b"".join(map(of, x.tolist())))

    return coded.withColumn(out, raw_bytes(F.col(ids)))


def decode_slices(coded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, start, piece``: the bytes of each slice with the code point it begins at."""
    spans = coded.select(
        key, F.explode(F.transform(F.col("starts"), lambda s, i: F.struct(
            s.alias("start"),
            F.slice(
                F.col(ids),
                F.when(i > 0, F.element_at("ends", i)).otherwise(F.lit(0)) + 1,
                F.element_at("ends", i + 1) - F.when(i > 0, F.element_at("ends", i)).otherwise(F.lit(0)),
            ).alias("ids"),
        ))).alias("s"),
    ).select(key, "s.start", "s.ids")
    return decode(spans, ranks_path, out="piece").drop("ids")


def digests(coded: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``n_tokens, ids_sha256, decoded_sha256`` of encoded and
    decoded rows."""
    return coded.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of both."""
    import public_tokenizers

    from tallywright.llm.common import table

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return digests(decode(coded, path), "doc_id")
