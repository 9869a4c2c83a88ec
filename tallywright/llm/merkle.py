"""Merkle manifest of a dataset: a digest of each row, of each group, and of all of them.

A group's leaves stand in order; every three neighbouring nodes have one above them, the
last one of a level two or one. The groups' roots are the leaves of one more tree.

A tree is cut into aligned subtrees of six levels, blocks of up to 729 leaves, and
the blocks' roots are the leaves of the next stage, until one block is left. So a group of any
size is as many blocks as it needs. Within a block the nodes are stored in van Emde Boas
order: the tree is split at half its height, the upper part is stored first and then each of
the lower ones, all of them recursively in the same way. The place of a node follows
from its level and index by arithmetic alone, for building a block and for
finding the siblings on a leaf's way to the root.

The position of a leaf in its group comes from a range-partitioned sort and from the number
of rows in the partitions before it; no group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import pieces, stored, table

FAN = 3
#: Levels of a block above its leaves.
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# -- van Emde Boas order ----------------------------------------------------------


def nodes_in(levels: int) -> int:
    return (FAN ** levels - 1) // (FAN - 1)


def places(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of a depth (0 is the root) are stored in a complete
    tree of so many levels."""
    at = np.zeros_like(index)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        levels, depth = levels - upper, depth - upper
        below = FAN ** depth
        at = at + nodes_in(upper) + index // below * nodes_in(levels)
        index = index % below
    return at


def height_of(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    height = 0
    while n > 1:
        n, height = -(-n // FAN), height + 1
    return height


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Block:
    """A subtree of a block's leaves; ``digests`` in van Emde Boas order, hex."""

    def __init__(self, size: int, height: int, digests: str):
        self.size, self.height, self.digests = size, height, digests

    @classmethod
    def over(cls, leaves: list[str], height: int) -> Block:
        stored_at = ["0" * 64] * nodes_in(height + 1)
        row = leaves
        for level in range(height + 1):
            for at, digest in zip(places(height + 1, height - level, np.arange(len(row))).tolist(), row):
                stored_at[at] = digest
            if level < height:
                row = [_hash("".join(row[i:i + FAN])) for i in range(0, len(row), FAN)]
        return cls(len(leaves), height, "".join(stored_at))

    @property
    def root(self) -> str:
        return self.digests[:64]

    def siblings(self, members: np.ndarray) -> list[list[tuple[int, str]]]:
        """For each of the leaves ``members`` its way up: by level the place in its run, and the
        digests of the run's others."""
        ways: list[list[tuple[int, str]]] = [[] for _ in members]
        index, size = members, self.size
        for level in range(self.height):
            slot, first = index % FAN, index - index % FAN
            run = [places(self.height + 1, self.height - level, first + k) for k in range(FAN)]
            length = np.minimum(FAN, size - first)
            for way, mine, n, *at in zip(ways, slot.tolist(), length.tolist(), *[r.tolist() for r in run]):
                way.append((mine, "".join(self.digests[64 * a:64 * a + 64] for k, a in enumerate(at[:n]) if k != mine)))
            index, size = index // FAN, -(-size // FAN)
        return ways


def fold(leaf: str, way: list[tuple[int, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for slot, others in way:
        leaf = _hash(others[:64 * slot] + leaf + others[64 * slot:])
    return leaf


# -- positions --------------------------------------------------------------------


def positions(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``pos``, the rank in its ``group`` by ``key`` (null first) and
    ``leaf``, from 0, and ``n``, the number of the group's rows.

    Rows that are equal in all three get different positions. What meets in one place is a
    count for each group in each partition that has some of it.
    """
    numbered = stored(rows.withColumn("at", F.monotonically_increasing_id()), f"{name}-rows")
    by = ["group", "key", "leaf", "at"]
    ordered = stored(
        numbered.repartitionByRange(*by).sortWithinPartitions(*by).drop("at")
        .withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33)), f"{name}-ordered")
    counts = ordered.groupBy("group", "part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "group", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("group")).alias("n"))
    return ordered.join(shifts, ["group", "part"]).withColumn("pos", F.col("id") + F.col("shift")) \
        .drop("id", "part", "shift")


# -- building ---------------------------------------------------------------------


_BLOCKS = "group string, block long, n long, size int, height int, nodes binary, root binary"


def _stages(members: DataFrame, name: str, height: int) -> list[DataFrame]:
    """Blocks over ``group, pos, n, leaf``, and over their roots, and so on."""
    span = FAN ** height

    def made(mine: pa.Table) -> pa.Table:
        mine = mine.sort_by("pos")
        n, size = mine["n"][0].as_py(), mine.num_rows
        block = Block.over([x.hex() for x in mine["leaf"].to_pylist()], height if n > span else height_of(size))
        return pa.table({
            "group": mine["group"][:1], "block": mine["block"][:1], "n": mine["n"][:1],
            "size": pa.array([size], pa.int32()), "height": pa.array([block.height], pa.int32()),
            "nodes": pa.array([bytes.fromhex(block.digests)], pa.binary()), "root": pa.array([bytes.fromhex(block.root)], pa.binary()),
        })

    stages, most = [], members.agg(F.max("n")).first()[0] or 0
    while True:
        cells = members.select("group", F.floor(F.col("pos") / span).alias("block"), "pos", "n", "leaf").groupBy("group", "block")
        stages.append(stored(cells.applyInArrow(made, _BLOCKS), f"{name}-blocks"))
        if most <= span:
            return stages
        most = -(-most // span)
        members = stages[-1].where(F.col("n") > span).select(
            "group", F.col("block").alias("pos"), F.ceil(F.col("n") / span).alias("n"), F.col("root").alias("leaf"))


@dataclass(frozen=True)
class Manifest:
    """``members``: the leaves with their positions. ``stages``: the groups' blocks.
    ``above``: the members and blocks of the tree over the groups' roots. ``root``: hex, null
    for no rows. ``height``: levels of a block."""

    height: int
    members: DataFrame
    stages: list[DataFrame]
    above: tuple[DataFrame, list[DataFrame]]
    root: str | None


def build(leaves: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest of ``group, key, leaf`` (digests as bytes; the group is a text and
    never null). Further columns stay in the members."""
    members = stored(positions(leaves, "merkle"), "merkle-members")
    stages = _stages(members, "merkle", height)
    ends = [
        blocks.where(F.col("n") <= FAN ** height)
        .select(F.lit("").alias("group"), F.col("group").alias("key"), F.col("root").alias("leaf")) for blocks in stages]
    subroots = ends[0]
    for more in ends[1:]:
        subroots = subroots.unionByName(more)
    tops = stored(positions(subroots, "merkle-top"), "merkle-top-members")
    above = _stages(tops, "merkle-top", height)
    last = above[-1].first()
    return Manifest(height, members, stages, (tops, above), last and last.root.hex())


# -- proofs -----------------------------------------------------------------------


_WAY = T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("others", T.BinaryType())]))
_ARROW_WAY = pa.list_(pa.struct([("slot", pa.int32()), ("others", pa.binary())]))


def _ways(members: DataFrame, blocks: DataFrame, span: int) -> DataFrame:
    """``members`` with ``way``, their siblings up to the root, and ``subroot``; from
    blocks with ``tail``, the way of the block's own root, and ``subroot``."""
    columns = members.columns
    members = members.withColumn("block", F.floor(F.col("pos") / span))
    out = T.StructType([*members.schema.fields, T.StructField("way", _WAY), T.StructField("subroot", T.BinaryType())])

    def find(mine: pa.Table, block: pa.Table) -> pa.Table:
        ways = []
        if mine.num_rows:
            row = block.to_pylist()[0]
            made = Block(row["size"], row["height"], row["nodes"].hex())
            index = mine["pos"].to_numpy() - span * mine["block"].to_numpy()
            ways = [[{"slot": s, "others": bytes.fromhex(o)} for s, o in way] + row["tail"] for way in made.siblings(index)]
        subroot = pa.array([block["subroot"][0].as_py()] * mine.num_rows if mine.num_rows else [], pa.binary())
        return mine.append_column("way", pa.array(ways, _ARROW_WAY)).append_column("subroot", subroot)

    cell = ["group", "block"]
    right = blocks.select(*cell, "size", "height", "nodes", "tail", "subroot")
    return members.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(find, out).select(*columns, "way", "subroot")


def _down(members: DataFrame, stages: list[DataFrame], ends: DataFrame, span: int) -> DataFrame:
    """Ways of ``members``, from the last stage down. ``ends``: ``group, tail, subroot``
    of the groups' roots."""
    of_block = None
    for k in range(len(stages) - 1, -1, -1):
        blocks = stages[k].where(F.col("n") <= span).join(ends, "group")
        if of_block is not None:
            blocks = blocks.unionByName(stages[k].where(F.col("n") > span).join(of_block, ["group", "block"]))
        mine = members if k == 0 else stages[k - 1].where(F.col("n") > span).select("group", F.col("block").alias("pos"))
        ways = _ways(mine, blocks, span)
        if k:
            of_block = stored(ways.select("group", F.col("pos").alias("block"), F.col("way").alias("tail"), "subroot"), "merkle-tails")
    return ways


def prove(manifest: Manifest, members: DataFrame | None = None) -> DataFrame:
    """``members`` (of the manifest; all, if not given) with ``way``, an array of ``slot``
    and ``others`` by level from the leaf to the root, and ``subroot``, the group's root.

    A leaf whose way folds to the root is in the dataset as the manifest has it.
    """
    (tops, above), span = manifest.above, FAN ** manifest.height
    no_way = F.array().cast(_WAY)
    last = above[-1].select("group").distinct().select("group", no_way.alias("tail"), F.lit(None).cast("binary").alias("subroot"))
    ends = stored(_down(tops, above, last, span).select(
        F.col("key").alias("group"), F.col("way").alias("tail"), F.col("leaf").alias("subroot")), "merkle-ends")
    return _down(members if members is not None else manifest.members, manifest.stages, ends, span)


def folded(proved: DataFrame, leaf: str, keep: list[str]) -> DataFrame:
    """``keep``, ``folded`` (hex): the root that column ``leaf`` leads to, and
    ``proof_sha256``, a digest of all siblings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            roots, proofs = [], []
            for own, way in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                steps = [(x["slot"], x["others"].hex()) for x in way]
                roots.append(fold(own.hex(), steps))
                proofs.append(_hash("".join(others for _, others in steps)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(roots, pa.string()), pa.array(proofs, pa.string())], names=[*keep, "folded", "proof_sha256"])

    rows = proved.select(F.col(leaf).alias("__leaf"), F.col("way").alias("__way"), *keep)
    out = T.StructType([*rows.schema.fields[2:], T.StructField("folded", T.StringType()), T.StructField("proof_sha256", T.StringType())])
    return rows.mapInArrow(run, out)


# -- rows as leaves ---------------------------------------------------------------


def digest_of(*fields: F.Column) -> F.Column:
    """SHA-256 in hex of fields: ``-`` for null, else bytes, a colon and the value."""

    def told(x):
        x = x.cast("string")
        return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))

    return F.sha2(F.concat(*map(told, fields)), 256)


def group_of(source: F.Column) -> F.Column:
    """A text for each source, null too, in the order of the sources' bytes, null first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proof of every document, and whether it verifies after tampering.

    Null fields have a mark of their own; a null doc_id comes first and is not tampered
    with. Whole texts are hashed. Repeated rows are leaves of their own. An empty
    table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    whole = [F.col(f) for f in FIELDS]
    cut = [F.replace(F.col("text"), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = docs.select(
        group_of(F.col("source")).alias("group"), F.col("doc_id").alias("key"), F.unhex(digest_of(*whole)).alias("leaf"),
        F.when(even, F.unhex(digest_of(*cut))).alias("altered"))
    manifest = build(leaves)
    proved = prove(manifest).withColumn("shown", F.coalesce("altered", "leaf")) \
        .withColumns({"leaf": F.lower(F.hex("leaf")), "subroot": F.lower(F.hex("subroot"))})
    return folded(proved, "shown", ["key", "leaf", "subroot"]).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", F.lit(manifest.root).alias("root"), "proof_sha256",
        F.col("folded").alias("folded_root"), (F.col("folded") == F.lit(manifest.root)).alias("verified"))


#: The same for DuckDB, level by level over all nodes and, for the proofs, over all rows.
OP12_SQL = """
WITH RECURSIVE told AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS grp,
           CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
           || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
           || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
           || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
           text, replace(text, chr(10), '') AS flat,
           list_reduce(list_concat([4294967295], [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
               lambda crc, c: list_reduce(list_concat([xor(crc, c)], [0, 0, 0, 0, 0, 0, 0, 0]),
                                       lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS crc
    FROM documents
), leaves AS MATERIALIZED (
    SELECT rid, doc_id, grp, leaf, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN altered ELSE leaf END AS shown,
           row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
    FROM (SELECT *, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
                 sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(flat) || ':' || flat END) AS altered FROM told) t
), nodes(grp, level, i, h, n) AS (
    SELECT grp, 0, i, leaf, count(*) OVER (PARTITION BY grp) FROM leaves
    UNION ALL
    SELECT grp, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3)
    FROM nodes WHERE n > 1 GROUP BY grp, level, i // 3
), tops(level, i, h, n) AS (
    SELECT 0, row_number() OVER (ORDER BY grp) - 1, h, count(*) OVER () FROM nodes WHERE n = 1
    UNION ALL
    SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3)
    FROM tops WHERE n > 1 GROUP BY level, i // 3
), runs AS MATERIALIZED (
    SELECT grp, level, i,
           coalesce(string_agg(h, '') OVER (PARTITION BY grp, level, i // 3 ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS pre,
           coalesce(string_agg(h, '') OVER (PARTITION BY grp, level, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS post
    FROM (SELECT grp, level, i, h, n FROM nodes UNION ALL SELECT '/', level, i, h, n FROM tops) x WHERE n > 1
), walk(rid, grp, level, i, cur, proof) AS (
    SELECT rid, grp, 0, i, shown, '' FROM leaves
    UNION ALL
    SELECT w.rid, w.grp, w.level + 1, w.i // 3, sha256(r.pre || w.cur || r.post), w.proof || r.pre || r.post
    FROM walk w JOIN runs r ON w.grp = r.grp AND w.level = r.level AND w.i = r.i
), arrived AS (
    SELECT rid, grp, arg_max(cur, level) AS cur, arg_max(proof, level) AS proof FROM walk GROUP BY rid, grp
), ranked AS (
    SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS i FROM nodes WHERE n = 1
), climb(rid, level, i, cur, proof) AS (
    SELECT rid, 0, i, cur, proof FROM arrived JOIN ranked ON arrived.grp = ranked.grp
    UNION ALL
    SELECT w.rid, w.level + 1, w.i // 3, sha256(r.pre || w.cur || r.post), w.proof || r.pre || r.post
    FROM climb w JOIN runs r ON r.grp = '/' AND w.level = r.level AND w.i = r.i
), ended AS (
    SELECT rid, arg_max(cur, level) AS folded_root, arg_max(proof, level) AS proof FROM climb GROUP BY rid
)
SELECT l.doc_id, l.leaf, k.subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.folded_root, e.folded_root = t.h AS verified
FROM leaves l JOIN ended e ON l.rid = e.rid JOIN ranked k ON l.grp = k.grp, (SELECT h FROM tops WHERE n = 1) t
"""
