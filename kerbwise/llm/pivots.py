"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its ``LENGTH`` nearest of up to ``PIVOTS`` reference points, in order. It enters the inverted lists of the
first ``LISTS`` of them, within its label. Two vectors of a list that share at least ``SHARED`` points of their descriptions are
candidates, and only candidates are verified by cosine in double precision. A pair is taken only in the least of the lists
that hold both, so links count once. :func:`work` reports how many pairs the lists and the shared points leave of all.

Equal vectors are one node with a weight. A list is dealt into blocks of about ``BLOCK`` members and each pair of blocks is a
group of its own, so that no task holds more than two blocks however long the list. A group returns, for each member, its number of links and
the head of its linked part, never the pairs. Reference points come from a bounded sample, the ``SAMPLE`` valid vectors of
least hash, by farthest-first choice, until the next one would be nearer than ``SPREAD`` to one that is chosen: points inside
one group of near copies would tell its members apart. Vectors at equal distances from two points take the earlier one first.

Vectors that are null, zero, or hold null or non-finite components, and vectors without label, link with nothing. Vectors of different
lengths link with nothing of another length. Repeated ids keep a row each; rows without id take part, but name no component. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise.llm.components import components
from kerbwise.session import written

PIVOTS, LISTS, LENGTH, SHARED, COSINE = 1024, 4, 16, 4, 0.93
SAMPLE, SPREAD, BLOCK = 4096, 0.8, 4096
#: Members of a list that are compared with as many others at once.
_TILE = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to length 1 in double precision; the scale is taken out first."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=-1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=-1, keepdims=True)


def nodes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written rows, and the written classes of equal valid vectors under one label."""
    component = F.col("embedding")
    finite = F.forall(
        component, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    )
    valid = F.col("label").isNotNull() & F.coalesce(finite & F.exists(component, lambda x: x != 0), F.lit(False))
    rows = written(
        embeddings.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col("vec_id").cast("long").alias("vec_id"),
            "label",
            F.when(valid, F.transform(component, lambda x: x.cast("double") + F.lit(0.0))).alias("vector"),
        ),
        "vectors",
    )
    classes = (
        rows.where("vector is not null")
        .groupBy("label", "vector")
        .agg(F.min("rid").alias("node"), F.count("*").alias("weight"), F.min("vec_id").alias("least_id"))
    )
    return rows, written(classes, "vector-classes")


def reference_points(classes: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each vector length the reference points chosen from the sample."""
    hashed = classes.select("vector", F.xxhash64("vector", "label").alias("h"))
    n = classes.count()
    # about twice the sample lies below this hash, so that tasks do not each send a whole sample to the driver
    low = hashed.where(F.col("h") < -(1 << 63) + (1 << 65) * sample // n) if n > 4 * sample else hashed
    rows = low.orderBy("h").limit(sample).select("vector").collect()
    if len(rows) < min(n, sample):
        rows = hashed.orderBy("h").limit(sample).select("vector").collect()
    by_length: dict[int, list] = {}
    for (vector,) in rows:
        by_length.setdefault(len(vector), []).append(vector)
    out = {}
    for length, vectors in by_length.items():
        points = unit(np.array(vectors))
        nearest = np.full(len(points), -2.0)
        chosen: list[int] = []
        while len(chosen) < pivots and nearest.min() < SPREAD:
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, points @ points[chosen[-1]])
        out[length] = points[chosen]
    return out


def _described(points: dict[int, np.ndarray], lists: int, length: int):
    """Each node under the first pivots of its description, with the whole description."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            rows, pivot, described = [], [], []
            sizes = np.array([len(v) for v in vectors], np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                base = points.get(size)
                if base is None:  # a length that the sample does not hold: one list for all
                    near = np.zeros((len(at), 1), np.int32)
                else:
                    near = np.argsort(-(unit(np.array([vectors[i] for i in at])) @ base.T), axis=1, kind="stable")[:, :length].astype("<i4")
                short = near[:, :lists]
                rows.append(np.repeat(at, short.shape[1]))
                pivot.append(short.ravel())
                described += [x.tobytes() for x in near for _ in range(short.shape[1])]
            take = np.concatenate([np.zeros(0, np.int64), *rows])
            yield pa.record_batch(
                {
                    "label": batch.column("label").take(pa.array(take)),
                    "size": pa.array(sizes[take]),
                    "pivot": pa.array(np.concatenate([np.zeros(0, np.int64), *pivot]), pa.int64()),
                    "node": batch.column("node").take(pa.array(take)),
                    "weight": batch.column("weight").take(pa.array(take)),
                    "near": pa.array(described, pa.binary()),
                    "vector": batch.column("vector").take(pa.array(take)),
                }
            )

    return run


def _candidates(near: np.ndarray, pivot: int, lists: int, shared: int):
    """A function of two slices of members: which pairs this list has to verify."""
    _, used = np.unique(near, return_inverse=True)
    marks = np.zeros((len(near), used.max(initial=0) + 1), np.float32)
    marks[np.arange(len(near))[:, None], used.reshape(near.shape)] = 1
    wanted = min(shared, near.shape[1])
    short = near[:, :lists]
    # pivots before this one, where a pair that shares one of them is taken
    left, right = np.where(short < pivot, short, -1), np.where(short < pivot, short, -2)

    def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        open_ = marks[a] @ marks[b].T >= wanted
        for x in range(left.shape[1]):
            for y in range(right.shape[1]):
                open_ &= left[a, x][:, None] != right[b, y][None, :]
        return open_

    return of


def _linked(cosine: float, lists: int, shared: int):
    """Links inside one pair of blocks: per member the weight of its partners, and the head of its part.

    A row without node tells how many pairs were listed and how many cosines computed.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pivot, i, j = (key[k].as_py() for k in (2, 3, 4))
        block, node, weight = (table.column(c).to_numpy() for c in ("block", "node", "weight"))
        near = np.frombuffer(b"".join(table.column("near").to_pylist()), "<i4").reshape(len(node), -1)
        vectors = unit(table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(node), -1))
        candidates = _candidates(near, pivot, lists, shared)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        degree, head = np.zeros(len(node), np.int64), np.arange(len(node))
        pairs, cosines, found = 0, 0, [np.zeros((2, 0), np.int64)]
        for x in range(0, len(left), _TILE):
            for y in range(x if i == j else 0, len(right), _TILE):
                a, b = left[x:x + _TILE], right[y:y + _TILE]
                open_ = candidates(a, b)
                if i == j:
                    open_ &= a[:, None] < b[None, :]
                    pairs += int((a[:, None] < b[None, :]).sum()) if x == y else open_.size
                else:
                    pairs += open_.size
                u, v = np.nonzero(open_)
                cosines += len(u)
                near_by = np.concatenate(
                    [np.zeros(0, bool), *(np.einsum("ij,ij->i", vectors[a[u[k:k + 65536]]], vectors[b[v[k:k + 65536]]]) >= cosine for k in range(0, len(u), 65536))]
                )
                found.append(np.stack((a[u[near_by]], b[v[near_by]])))
        a, b = np.concatenate(found, axis=1)
        np.add.at(degree, a, weight[b])
        np.add.at(degree, b, weight[a])
        while len(a):  # heads sink to the least member of each linked part
            low = np.minimum(head[a], head[b])
            before = head.copy()
            np.minimum.at(head, a, low)
            np.minimum.at(head, b, low)
            np.minimum.at(head, before[a], low)
            np.minimum.at(head, before[b], low)
            head = head[head]
            if (before == head).all():
                break
        keep = degree > 0
        columns = {"node": node[keep], "links": degree[keep], "head": node[head[keep]]}
        one = {"node": None, "links": None, "head": None, "pairs": pairs, "cosines": cosines}
        return pa.table(
            {name: pa.array([*columns.get(name, [0] * int(keep.sum())), last], pa.int64()) for name, last in one.items()}
        )

    return run


def compared(
    classes: DataFrame, cosine: float, pivots: int, lists: int, length: int, shared: int, block: int
) -> DataFrame:
    """The written links of the classes by group: members with their links and heads, and what each group compared."""
    points = classes.sparkSession.sparkContext.broadcast(reference_points(classes, pivots))
    schema = f"label {classes.schema['label'].dataType.simpleString()}, size long, pivot long, node long, weight long, near binary, vector array<double>"

    def described(batches):
        yield from _described(points.value, lists, length)(batches)

    entered = classes.select("label", "node", "weight", "vector").mapInArrow(described, schema)
    sizes = entered.groupBy("label", "size", "pivot").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    dealt = entered.join(sizes, ["label", "size", "pivot"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "label", "size", "pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "node", "weight", "near", "vector",
    )
    return written(
        paired.groupBy("label", "size", "pivot", "i", "j").applyInArrow(
            _linked(cosine, lists, shared), "node long, links long, head long, pairs long, cosines long"
        ),
        "vector-links",
    )


def work(
    embeddings: DataFrame, cosine: float = COSINE, pivots: int = PIVOTS, lists: int = LISTS, length: int = LENGTH, shared: int = SHARED,
    block: int = BLOCK,
) -> DataFrame:
    """One row: all pairs of distinct vectors within labels, pairs that meet in the lists, and cosines computed."""
    _, classes = nodes(embeddings)
    done = compared(classes, cosine, pivots, lists, length, shared, block).agg(F.sum("pairs").alias("listed"), F.sum("cosines").alias("cosines"))
    count = F.count("*")
    sizes = classes.groupBy("label", F.size("vector")).agg((count * (count - 1) / 2).cast("long").alias("pairs"))
    one = F.lit(1).alias("one")
    return sizes.agg(F.sum("pairs").alias("all_pairs")).select("*", one).join(done.select("*", one), "one").drop("one")


def near_duplicates(
    embeddings: DataFrame, cosine: float = COSINE, pivots: int = PIVOTS, lists: int = LISTS, length: int = LENGTH, shared: int = SHARED,
    block: int = BLOCK,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows, classes = nodes(embeddings)
    found = compared(classes, cosine, pivots, lists, length, shared, block).where("node is not null")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("u"), F.col("head").alias("v")))
    state = written(
        classes.select("label", "vector", "node", "weight", "least_id")
        .join(links, "node", "left")
        .join(parts, "node", "left")
        .select("label", "vector", "least_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("part")),
        "vector-state",
    )
    least = state.groupBy("part").agg(F.min("least_id").alias("component_id"))
    by_vector = state.join(least, "part").select("label", "vector", "n_links", "component_id")
    return (
        rows.join(by_vector, ["label", "vector"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
