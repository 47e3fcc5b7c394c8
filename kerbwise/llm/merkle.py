"""Merkle manifest of a dataset, and its proofs as octopus multiproofs.

Leaves are SHA-256 digests of the rows' fields. The leaves of one tree (a language) ascend by id; every 8 consecutive nodes
become one, level by level, until one is left, the subroot. The subroots, in the order of their languages, are the leaves
of the top tree, whose last node is the root. All digests enter others as lower-case hex text.

Building: rows are sorted over ranges, and places follow from the counts of each range, so no tree is ever in one
task. Blocks of 8^4 neighbouring nodes are then reduced by four levels at a time: one shuffle of digests for
four levels, and at most 4096 digests in a task's hands.

Proving, for any set of leaves, dealt in the same blocks: a block works out from the places alone the least set of nodes
that its leaves do not yield themselves, over all its leaves together, up to the root
(:func:`missing`); one join fetches these from the manifest; the block derives the interior nodes
that its proofs share, once, and spells out each leaf's proof (:func:`proofs`).

Null fields count as ``-``, an empty text as a text of 0 bytes; a null id comes first in its tree and has no decimal (it
counts as an empty string where rows to tamper with are chosen); rows with one id are ordered by their digests, equal rows in any
order (their results are equal up to their place); an empty table has no root and gives an empty result; other columns are
ignored. A text of any length is hashed whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbwise.session import written

ARITY_BITS, BLOCK_LEVELS = 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BLOCK = ARITY_BITS * BLOCK_LEVELS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOP = ""  # names of trees: the top one, "n" for null, "s" and the value for the others; in this order

NODES = "tree string, size long, level int, idx long, digest binary"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of a row's fields, in their order."""
    return F.unhex(F.sha2(F.concat(*map(_field, fields.values())), 256))


def _hash(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def levels(size: int) -> int:
    """Levels above the leaves of a tree."""
    return -(-(max(size, 1) - 1).bit_length() // ARITY_BITS)


def nodes_at(size: int, level: int) -> int:
    return -(-size >> ARITY_BITS * level)


def children(size: int, level: int, parent: int) -> range:
    """Places, at ``level``, of the children of a node of the next level."""
    return range(parent << ARITY_BITS, min((parent + 1) << ARITY_BITS, nodes_at(size, level)))


def ordered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their place ``idx`` within their tree, by ``by``, and the ``size`` of the tree.

    Ranges over tree and order are sorted apart; a tree's places go on from the counts of its earlier ranges.
    """
    keys = [F.asc_nulls_first(c) for c in ("tree", *by)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ordered")
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    offsets = written(counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size")), "offsets")
    return placed.join(offsets, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _reduced(level: int):
    def run(table: pa.Table) -> pa.Table:
        tree, size = table.column("tree")[0].as_py(), table.column("size")[0].as_py()
        nodes = {i: x.hex().encode() for i, x in zip(table.column("idx").to_pylist(), table.column("digest").to_pylist())}
        out = []
        for at in range(level, min(level + BLOCK_LEVELS, levels(size))):
            parents = sorted({i >> ARITY_BITS for i in nodes})
            nodes = {p: _hash(b"".join(nodes[c] for c in children(size, at, p))) for p in parents}
            out += [(at + 1, p, bytes.fromhex(x.decode())) for p, x in nodes.items()]
        up, idx, digest = zip(*out) if out else ((), (), ())
        return pa.table(
            {
                "tree": pa.array([tree] * len(out), pa.string()), "size": pa.array([size] * len(out), pa.int64()),
                "level": pa.array(up, pa.int32()), "idx": pa.array(idx, pa.int64()), "digest": pa.array(digest, pa.binary()),
            }
        )

    return run


def built(leaves: DataFrame) -> DataFrame:
    """All nodes of the trees over ``leaves`` (tree, size, idx, digest), the leaves themselves at level 0."""
    nodes = leaves.select("tree", "size", F.lit(0).alias("level"), "idx", "digest")
    height = levels(leaves.agg(F.max("size")).first()[0] or 0)
    current = nodes
    for level in range(0, height, BLOCK_LEVELS):
        block = F.shiftright("idx", _BLOCK).alias("block")
        current = written(current.where(F.col("level") == level).groupBy("tree", block).applyInArrow(_reduced(level), NODES), "nodes")
        nodes = nodes.unionByName(current)
    return nodes


def _tops(size: Column) -> Column:
    """Level of the last node of a tree, as :func:`levels`."""
    bits = F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1)))
    return F.floor((bits + ARITY_BITS - 1) / ARITY_BITS).cast("int")


def subroots(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("level") == _tops(F.col("size"))).select("tree", "size", F.col("digest").alias("subroot"))


def _coordinates(tree: str, size: int, known: set[int]) -> list[tuple[str, int, int]]:
    """The least set of nodes that, with the leaves ``known``, yields the way of each to the tree's last node."""
    out = []
    for level in range(levels(size)):
        parents = {i >> ARITY_BITS for i in known}
        out += [(tree, level, c) for p in parents for c in children(size, level, p) if c not in known]
        known = parents
    return sorted(out)


def _missing(table: pa.Table) -> pa.Table:
    tree, block, size, rank, trees = (table.column(c)[0].as_py() for c in ("tree", "block", "size", "rank", "trees"))
    out = _coordinates(tree, size, set(table.column("idx").to_pylist())) + _coordinates(_TOP, trees, {rank})
    names, level, idx = zip(*out) if out else ((), (), ())
    return pa.table(
        {
            "of": pa.array([tree] * len(out), pa.string()), "block": pa.array([block] * len(out), pa.int64()),
            "tree": pa.array(names, pa.string()), "level": pa.array(level, pa.int32()), "idx": pa.array(idx, pa.int64()),
        }
    )


def missing(wanted: DataFrame) -> DataFrame:
    """Per block of wanted leaves, the nodes to fetch: one row for each, however many proofs need it."""
    return wanted.select("tree", "block", "size", "rank", "trees", "idx").groupBy("tree", "block").applyInArrow(
        _missing, "of string, block long, tree string, level int, idx long"
    )


class _Block:
    """The shared part of a block's proofs: for each parent of a wanted leaf or of its ancestors, its children's digests as one text."""

    def __init__(self, tree: str, size: int, rank: int, trees: int, leaves: dict[int, bytes], fetched: dict[tuple, bytes]):
        self.runs: list[dict[int, bytes]] = []
        self.shifted: list[bool] = []  # whether the next level's place follows from this one's
        known = leaves
        for name, n, inside in ((tree, size, True), (_TOP, trees, False)):
            if not inside:
                self.subroot, known = known[0], {rank: known[0]}
            for level in range(levels(n)):
                run = {}
                for p in {i >> ARITY_BITS for i in known}:
                    run[p] = b"".join(known[c] if c in known else fetched[name, level, c] for c in children(n, level, p))
                self.runs.append(run)
                known = {p: _hash(x) for p, x in run.items()}
        self.root, self.inner, self.rank = next(iter(known.values())), levels(size), rank
        self.above: dict[tuple[int, int], bytes] = {}

    def _step(self, level: int, at: int) -> int:
        return self.rank if level == self.inner else at

    def siblings(self, level: int, at: int) -> bytes:
        """Siblings of the node at a place of a level and of all its ancestors, level by level, left to right."""
        if level == len(self.runs):
            return b""
        at = self._step(level, at)
        if (level, at) not in self.above or not level:
            run, slot = self.runs[level][at >> ARITY_BITS], 64 * (at & 7)
            found = run[:slot] + run[slot + 64:] + self.siblings(level + 1, at >> ARITY_BITS)
            if not level:  # a leaf's proof is asked for once
                return found
            self.above[level, at] = found
        return self.above[level, at]

    def folded(self, leaf: bytes, at: int) -> bytes:
        """The root that follows from a leaf and the siblings of its place."""
        for level, runs in enumerate(self.runs):
            at = self._step(level, at)
            run, slot = runs[at >> ARITY_BITS], 64 * (at & 7)
            leaf = _hash(run[:slot] + leaf + run[slot + 64:])
            at >>= ARITY_BITS
        return leaf


PROOFS = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
    "tree string, idx long"
)


def _expanded(full: bool):
    def run(wanted: pa.Table, fetched: pa.Table) -> pa.Table:
        tree, size, rank, trees = (wanted.column(c)[0].as_py() for c in ("tree", "size", "rank", "trees"))
        places = wanted.column("idx").to_pylist()
        leaves = [x.hex().encode() for x in wanted.column("digest").to_pylist()]
        claimed = [x.hex().encode() for x in wanted.column("claimed").to_pylist()]
        others = {
            (t, level, i): x.hex().encode()
            for t, level, i, x in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "idx", "digest")))
        }
        block = _Block(tree, size, rank, trees, dict(zip(places, leaves)), others)
        root = block.root.decode()
        proofs = [block.siblings(0, i) for i in places]
        roots = [block.folded(x, i).decode() for x, i in zip(claimed, places)]
        n = len(places)
        out = {
            "doc_id": wanted.column("doc_id"),
            "leaf": pa.array([x.decode() for x in leaves], pa.string()),
            "subroot": pa.array([block.subroot.decode()] * n, pa.string()),
            "root": pa.array([root] * n, pa.string()),
            "proof_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in proofs], pa.string()),
            "folded_root": pa.array(roots, pa.string()),
            "verified": pa.array([x == root for x in roots], pa.bool_()),
            "tree": wanted.column("tree"), "idx": wanted.column("idx"),
        }
        if full:
            out["proof"] = pa.array([x.decode() for x in proofs], pa.string())
        return pa.table(out)

    return run


def proofs(nodes: DataFrame, wanted: DataFrame, full: bool = False) -> DataFrame:
    """A proof for each row of ``wanted`` (doc_id, tree, size, rank, trees, idx, digest, claimed), checked against ``claimed``.

    ``full`` adds the proof itself: the hex digests of all siblings, level by level.
    """
    wanted = wanted.withColumn("block", F.shiftright("idx", _BLOCK))
    fetched = written(missing(wanted).join(nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"]), "fetched")
    return (
        wanted.groupBy("tree", "block")
        .cogroup(fetched.groupBy("of", "block"))
        .applyInArrow(_expanded(full), PROOFS + (", proof string" if full else ""))
    )


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The placed leaves of ``docs`` and all nodes of the trees of their languages and of the top tree.

    Each leaf also has ``claimed``: the digest of its row after tampering, which lower-cases A-Z in the texts of
    the rows where 3 divides the CRC-32 of the decimal id, and is the leaf itself elsewhere.
    """
    fields = {c: F.col(c) for c in FIELDS}
    tampered = fields | {"text": F.translate("text", _UPPER, _LOWER)}
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))) % 3 == 0
    rows = docs.select(
        F.when(F.col("lang").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("lang").cast("string"))).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(fields).alias("digest"),
        F.when(chosen, leaf_digest(tampered)).otherwise(leaf_digest(fields)).alias("claimed"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = written(rows, "leaves")
    leaves = ordered(rows, ["doc_id", "digest", "rid"]).drop("rid")
    inner = built(leaves)
    tops = ordered(subroots(inner).select(F.lit(_TOP).alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest")), ["name"])
    tops = written(tops, "tops")
    ranks = tops.select(F.col("name").alias("tree"), F.col("idx").alias("rank"), F.col("size").alias("trees"))
    return leaves.join(ranks, "tree"), inner.unionByName(built(tops))


def prove_all(docs: DataFrame, full: bool = False) -> DataFrame:
    """A checked proof for every row of ``docs``."""
    leaves, nodes = manifest(docs)
    return proofs(nodes, leaves, full)
