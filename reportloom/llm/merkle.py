"""Merkle manifest of a dataset, stored in blocks of van Emde Boas layout.

Every group of rows (here: a language) has a tree of fan-out 8 over its leaves in order, and the
groups' roots, in order, have another one over them, up to the dataset's root.

*Blocks.* A tree is cut into aligned subtrees of ``LEVELS`` levels above their leaves, 4096 leaves
each. Blocks of one round are built side by side, one group of at most 4096 rows at a time; their
roots are the leaves of the next round, so n leaves take log(n) / 12 bits rounds, and no
task ever holds a tree. A language with a third of all rows is many blocks. Places of leaves come
from sorted range partitions and counts (``ranking``).

*Layout.* A block's nodes lie in one byte string of 32 bytes a node, recursively split at half
height: first the top half as a tree of its own, then each subtree below it, one after the other.
``address`` gives a node's place by arithmetic alone: a node in the top half has its place there; one
below belongs to subtree ``index // 8**depth_of_the_top`` and has its place inside that. A leaf's path
then crosses few neighbouring pieces at any cache size. Construction writes, and proofs read, through these
addresses. A block is stored whole, with room for missing nodes, and is as high as its leaves
need when it is alone in its group.

*Proofs.* From the last round down, each block gets the siblings above its root (a few hundred
bytes a level) from the block over it. At the bottom, a leaf's siblings are read from the block and hashed;
folding starts from a leaf (tampered or not) and goes up to a root, hashing its siblings around it.

Cases: a null field is ``-``; rows of null language are a group, first in order. Null ids come first;
equal ids of a language are ordered by leaf, and equal leaves are leaves of their own. A lone leaf is
its group's root with no sibling; a lone group's root is the root. Empty texts are leaves, long ones are hashed by Spark
as they are. An empty table gives no rows, and no root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.llm.ranking import numbered
from reportloom.plans.store import discard, materialize

FAN, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- layout ---------------------------------------------------------------------------

def nodes(levels: int) -> int:
    """Nodes of a full tree with ``levels`` levels above its leaves."""
    return (FAN ** (levels + 1) - 1) // (FAN - 1)


@cache
def address(levels: int, depth: int) -> np.ndarray:
    """Places of all nodes at ``depth`` (root: 0) of a tree with ``levels`` levels above its leaves.

    The tree has ``levels + 1`` rows of nodes; the top half keeps ``(levels + 1) // 2`` of them.
    """
    index = np.arange(FAN ** depth)
    if levels == 0:
        return index
    top = (levels + 1) // 2
    if depth < top:
        return address(top - 1, depth)
    below = levels - top
    inside = FAN ** (depth - top)
    return nodes(top - 1) + index // inside * nodes(below) + address(below, depth - top)[index % inside]


def height(leaves: int) -> int:
    """Levels above ``leaves`` until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def build(leaves: list[bytes], levels: int) -> bytes:
    """A block's nodes in van Emde Boas order; ``levels`` above its leaves, missing nodes zero."""
    held = np.zeros((nodes(levels), 32), np.uint8)
    row = leaves
    for depth in range(levels, -1, -1):
        if depth < levels:
            row = [_join(row[i:i + FAN]) for i in range(0, len(row), FAN)]
        held[address(levels, depth)[:len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, 32)
    return held.tobytes()


def _join(run: list[bytes]) -> bytes:
    return hashlib.sha256("".join(x.hex() for x in run).encode()).digest()


class Block:
    """Reads a stored block: node by (depth, index), and the siblings on the way up."""

    def __init__(self, held: bytes, levels: int, leaves: int):
        self.held, self.levels = held, levels
        self.counts = [leaves]
        for _ in range(levels):
            self.counts.insert(0, -(-self.counts[0] // FAN))

    def node(self, depth: int, index: int) -> str:
        at = int(address(self.levels, depth)[index]) * 32
        return self.held[at:at + 32].hex()

    @property
    def root(self) -> bytes:
        return self.held[:32]

    def siblings(self, index: int) -> list[tuple[str, str]]:
        """Per level from the leaf upwards: digests to the left and to the right in its run."""
        out = []
        for depth in range(self.levels, 0, -1):
            first, parent = index - index % FAN, index // FAN
            key = depth, parent
            if key not in self._runs:
                last = min(first + FAN, self.counts[depth])
                self._runs[key] = [self.node(depth, i) for i in range(first, last)]
            run = self._runs[key]
            out.append(("".join(run[:index - first]), "".join(run[index - first + 1:])))
            index = parent
        return out

    @property
    def _runs(self) -> dict:
        return self.__dict__.setdefault("_held_runs", {})


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def _pack(path: list[tuple[str, str]]) -> str:
    return "".join(f"{left},{right};" for left, right in path)


def _unpack(path: str) -> list[tuple[str, str]]:
    return [tuple(level.split(",")) for level in path.split(";")[:-1]]


# --- leaves ---------------------------------------------------------------------------

def leaf_digest(fields: list[Column]) -> Column:
    """Hex sha256 of the fields, each ``-`` or its length in bytes, a colon and itself."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


# --- building -------------------------------------------------------------------------

@dataclass
class Tree:
    """A forest's blocks, one table a round, and the root of every group."""

    rounds: list[DataFrame]   # group, block, n, size (leaves of the group in this round), nodes; round 0 also its rows
    roots: DataFrame          # group, root (hex)
    levels: int               # levels of a block above its leaves


def _height(size: int, levels: int) -> int:
    """Levels of a block of a group with ``size`` leaves: as needed when it is the only one."""
    return levels if size > FAN ** levels else height(size)


def _blocks(rows: DataFrame, group: str, carried: list[str], levels: int) -> DataFrame:
    """One row a block from ``rows(group, place, size, digest, *carried)``: its nodes, and its rows in order."""
    schema = rows.select(group, F.lit(0).cast("long").alias("block"), F.lit(0).alias("n"), "size",
                         F.lit(b"").alias("nodes"), *(F.array(c).alias(c) for c in carried)).schema
    kinds = rows.select(*carried).limit(0).toArrow().schema if carried else pa.schema([])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        size, first = table.column("size")[0].as_py(), table.column("place")[0].as_py()
        held = build([bytes.fromhex(x) for x in table.column("digest").to_pylist()], _height(size, levels))
        lists = [pa.array([table.column(f.name).to_pylist()], pa.list_(f.type)) for f in kinds]
        return pa.table([table.column(group).combine_chunks()[:1], pa.array([first // FAN ** levels], pa.int64()),
                         pa.array([table.num_rows], pa.int32()), pa.array([size], pa.int64()),
                         pa.array([held], pa.binary()), *lists],
                        names=[group, "block", "n", "size", "nodes", *carried])
    cut = rows.withColumn("block", F.expr(f"place div {FAN ** levels}"))
    return materialize(cut.groupBy(group, "block").applyInArrow(run, schema), "merkle-blocks")


def grow(leaves: DataFrame, group: str, carried: list[str], levels: int = LEVELS) -> Tree:
    """Blocks over ``leaves(group, place, digest, *carried)``, round by round up to one root a group."""
    sizes = leaves.groupBy(group).agg(F.count("*").alias("size"))

    def sized(rows: DataFrame) -> DataFrame:
        counts = sizes.select(F.col(group).alias("_group"), "size")
        return rows.join(counts, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    many, rounds = FAN ** levels, [_blocks(sized(leaves), group, carried, levels)]
    while True:
        heads = rounds[-1].select(group, F.col("block").alias("place"), "size", F.hex(F.substring("nodes", 1, 32)).alias("digest"))
        above = heads.filter(F.col("size") > many).withColumn(
            "size", F.expr(f"(size + {many - 1}) div {many}")).withColumn("digest", F.lower("digest"))
        if above.isEmpty():
            break
        rounds.append(_blocks(above, group, [], levels))
    last = [r.filter(F.col("size") <= many).select(group, F.lower(F.hex(F.substring("nodes", 1, 32))).alias("root"))
            for r in rounds]
    roots = last[0]
    for r in last[1:]:
        roots = roots.unionAll(r)
    return Tree(rounds, materialize(roots, "merkle-roots"), levels)


def descend(tree: Tree, group: str, tops: DataFrame) -> DataFrame:
    """Blocks of the lowest round with ``above``: the siblings from the block's root to the last root.

    ``tops(group, path, ...)`` holds, for every group, the siblings above its root; its other columns
    are kept.
    """
    extra = [c for c in tops.columns if c not in (group, "path")]
    above: DataFrame | None = None
    for level in range(len(tree.rounds) - 1, -1, -1):
        blocks = tree.rounds[level]
        own = tops.select(F.col(group).alias("_group"), F.lit(0).cast("long").alias("_block"), F.col("path").alias("above"), *extra)
        known = own if above is None else above.unionAll(own.join(
            blocks.filter(F.col("size") <= FAN ** tree.levels).select(F.col(group).alias("_g")).distinct(),
            F.col("_group").eqNullSafe(F.col("_g"))).drop("_g"))
        here = blocks.join(known, F.col(group).eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block"))).drop("_group", "_block")
        if level == 0:
            return here
        above = materialize(_children(here, group, extra, tree.levels), "merkle-above")
    raise ValueError("a tree has a round")


def _children(blocks: DataFrame, group: str, extra: list[str], levels: int) -> DataFrame:
    """``above`` of every leaf of ``blocks``, which is the root of a block one round below."""
    frame = blocks.select(group, "block", "n", "size", "nodes", "above", *extra)
    schema = frame.select(F.col(group).alias("_group"), F.col("block").alias("_block"), "above", *extra).schema

    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["block", "n", "size", "nodes", "above"]).to_pylist()):
                block = _opened(row, levels)
                paths = [_pack(block.siblings(k)) + row["above"] for k in range(row["n"])]
                same = pa.array([i] * row["n"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(group).take(same), pa.array([row["block"] * FAN ** levels + k for k in range(row["n"])], pa.int64()),
                     pa.array(paths, pa.string()), *(batch.column(c).take(same) for c in extra)],
                    ["_group", "_block", "above", *extra])
    return frame.mapInArrow(run, schema)


def _opened(row: dict, levels: int) -> Block:
    return Block(row["nodes"], _height(row["size"], levels), row["n"])


# --- manifest -------------------------------------------------------------------------

@dataclass
class Manifest:
    """Stored manifest: trees of the groups, the tree over their roots, and the dataset's root."""

    groups: Tree
    over: Tree
    places: DataFrame  # group, root, place
    root: str | None


def manifest(docs: DataFrame, fields=FIELDS, group: str = "lang", key: str = "doc_id",
             tampered: dict[str, Column] | None = None, levels: int = LEVELS) -> Manifest:
    """Build and store the manifest. ``tampered`` replaces fields in a second digest of every row."""
    changed = tampered or {}
    leaf = leaf_digest([F.col(c) for c in fields])
    other = leaf_digest([changed.get(c, F.col(c)) for c in fields]) if changed else leaf
    leaves = materialize(docs.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf.alias("digest"),
                                     other.alias("shown")), "merkle-leaves")
    placed = numbered(leaves, ["group"], [F.col("key").asc_nulls_first(), F.col("digest")], "merkle-order")
    groups = grow(materialize(placed, "merkle-placed"), "group", ["key", "shown"], levels)
    places = materialize(numbered(groups.roots, [], [F.col("group").asc_nulls_first()], "merkle-groups"), "merkle-places")
    one = places.select(F.lit(0).alias("all"), "place", F.col("root").alias("digest"))
    if one.isEmpty():
        return Manifest(groups, Tree([], one, levels), places, None)
    over = grow(one, "all", [], levels)
    discard(leaves)
    return Manifest(groups, over, places, over.roots.first().root)


def proofs(held: Manifest, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """Per row: key, group, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``."""
    spark = held.places.sparkSession
    kind = held.groups.rounds[0].schema["key"].dataType.elementType
    head = held.groups.rounds[0].schema["group"].dataType
    columns = (f"struct<key {kind.simpleString()}, grp {head.simpleString()}, leaf string, subroot string, root string, "
               "proof_sha256 string, folded_root string, verified boolean>").replace("struct<", "").removesuffix(">")
    if held.root is None:
        return spark.createDataFrame([], columns).withColumnsRenamed({"key": key, "grp": group})
    top = descend(held.over, "all", held.over.roots.select("all", F.lit("").alias("path")))
    paths = _children(top, "all", [], held.over.levels).select(F.col("_block").alias("place"), F.col("above").alias("path"))
    tops = materialize(held.places.join(paths, "place").select("group", "path", F.col("root").alias("subroot")), "merkle-tops")
    blocks = descend(held.groups, "group", tops)
    root, levels = held.root, held.groups.levels

    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["n", "size", "nodes", "above", "subroot", "shown"]).to_pylist()):
                block, upper = _opened(row, levels), _unpack(row["above"])
                tail, path_of = "".join(a + b for a, b in upper), block.siblings
                proof, folded = [], []
                for k, shown in enumerate(row["shown"]):
                    path = path_of(k)
                    proof.append(hashlib.sha256(("".join([a + b for a, b in path]) + tail).encode()).hexdigest())
                    folded.append(fold(fold(shown, path), upper))
                n = row["n"]
                leaf = [block.node(block.levels, k) for k in range(n)]
                same = pa.array([i] * n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(i, 1).flatten(), batch.column("group").take(same), pa.array(leaf),
                     pa.array([row["subroot"]] * n), pa.array([root] * n), pa.array(proof), pa.array(folded),
                     pa.array([f == root for f in folded])],
                    ["key", "grp", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    out = blocks.select("key", "group", "n", "size", "nodes", "above", "subroot", "shown").mapInArrow(run, columns)
    return out.withColumnsRenamed({"key": key, "grp": group})


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is."""
    return F.translate(text, UPPER, LOWER)


def audit(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Manifest and proofs of documents, every third of them (by checksum of its id) tampered with."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    shown = F.when(third, lowered(F.col("text"))).otherwise(F.col("text"))
    return proofs(manifest(docs, tampered={"text": shown}, levels=levels)).drop("lang")
