"""Grouped prefix join of documents on their word shingles.

A document's set is its distinct 5-word shingles (A-Z lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; with fewer
words the whole sequence is one). Two documents link when 100 * |a and b| >= 80 * |a or b|.

1. A count sketch over every shingle of the table orders shingles from rare to common. The order
   steers the work only: any order gives the same links.
2. Two documents that link share a shingle among the first ``n - ceil(0.8 n) + 1`` of each, its
   prefix. Documents with the same prefix and size are one group.
3. Groups meet in the list of each shingle of their prefixes. Of each list the most central group
   (the one that holds the shingle earliest) is paired with the others that pass the size
   and position filters, and the members of a group are paired with its first one; the pairs pass a
   filter on parity bits, are verified on their whole sets, and linked ones join into components.
   Parity bits: each shingle flips one of at least 2n bits; sets cannot differ in fewer shingles than in bits.
4. What is left are pairs of a list across components. Each member outside the component of the
   list's centre is paired with every other that passes the filters, groups are
   expanded to members, and all these pairs are verified. No link between components is lost,
   and no pairs are built inside a component.

Rows of equal sets are one class throughout. Rows without words (null, empty or blank text) have
size 0 and link with nothing. A row with a null ``doc_id`` takes part, but its id names no component:
``component_id`` is the smallest id that is not null, or null. Rows that repeat a ``doc_id`` keep a row each.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise.llm import sketches
from kerbwise.llm.components import components
from kerbwise.llm.words import binaries, hashes, lean, mixed, shingles, slices, sorted_by_row, unique_by_row, utf8, words
from kerbwise.session import written

K, PERCENT = 5, 80
SKETCH_BITS = 20
FILTER_BITS = 22
#: A shingle that the sketch counts so often gets another list for each so many rows.
LIST_ROWS = 1 << 20
_SLICE_BYTES = 2 << 20

DIGEST = "rid long, doc_id long, n long, sig_a long, sig_b long, prefix_key long, prefix binary, parity binary"
SHARED = "token long, gid long, pos long, n long, hub long, hub_pos long, hub_n long"
PACKED = "bucket long, payload binary"
_POSTING = np.dtype([("token", "<u8"), ("gid", "<i8"), ("key", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def sets_of(column, k: int = K) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of a text column its row range, the distinct shingle hashes and their offsets."""
    for a, b in slices(len(column), np.diff(utf8(column)[1]), _SLICE_BYTES):
        data, offsets = utf8(column.slice(a, b - a))
        starts, ends, word_offsets = words(data, offsets)
        yield a, b, *unique_by_row(*shingles(hashes(data, starts, ends), word_offsets, k))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Wrapping sum of each row's values."""
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return running[offsets[1:]] - running[offsets[:-1]]


def _signatures(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_sums(mixed(values ^ mixed(np.array([s], np.uint64))), offsets).view(np.int64) for s in (1, 2))


def _ranked(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys that sort shingles from rare to common: 16 bits of the count's logarithm, 48 of the hash."""
    count = counts[sketches.cells(values, SKETCH_BITS)]
    rank = np.minimum(np.log2(np.maximum(count, 1)) * 1024, 65535).astype(np.uint64)
    return (rank << np.uint64(48)) | (mixed(values) >> np.uint64(16))


def _parities(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of each row's set, and their byte offsets; a row has a power of two of bits, at least 2n."""
    n = np.diff(offsets)
    size = np.maximum(8, 1 << np.ceil(np.log2(np.maximum(n, 1) / 4)).clip(0).astype(np.int64))
    ends = np.concatenate(([0], np.cumsum(size)))
    bit = (mixed(values ^ np.uint64(0x5851F42D4C957F2D)) & np.repeat(8 * size - 1, n).astype(np.uint64)).astype(np.int64)
    out = np.zeros(ends[-1], np.uint8)
    np.bitwise_xor.at(out, np.repeat(ends[:-1], n) + (bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    return out, ends


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two parities differ, the longer one folded to the shorter one's length."""
    a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(a), len(b))
    fold = lambda x: np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)
    return int(np.bitwise_count(fold(a) ^ fold(b)).sum())


def digests(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, int]:
    """The written table of sizes, set signatures and prefixes, and the number of all shingles."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = sketches.counted(docs, lambda batch: (v for _, _, v, _ in sets_of(batch.column("text"), k)), SKETCH_BITS)
    shared_counts = spark.sparkContext.broadcast(counts)

    def run(batches):
        base, row = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for a, b, values, offsets in sets_of(batch.column("text"), k):
                n = np.diff(offsets)
                sig_a, sig_b = _signatures(values, offsets)
                keys = sorted_by_row(_ranked(values, shared_counts.value), offsets)
                size = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                prefix_offsets = np.concatenate(([0], np.cumsum(size)))
                at = np.arange(prefix_offsets[-1]) + np.repeat(offsets[:-1] - prefix_offsets[:-1], size)
                prefix = keys[at]
                order = np.arange(len(prefix)) - np.repeat(prefix_offsets[:-1], size)
                key = mixed(_sums(mixed(prefix ^ mixed(order.astype(np.uint64))), prefix_offsets) + n.astype(np.uint64))
                yield pa.record_batch(
                    {
                        "rid": pa.array(base + row + np.arange(b - a)),
                        "doc_id": batch.column("doc_id").slice(a, b - a).cast(pa.int64()),
                        "n": pa.array(n.astype(np.int64)),
                        "sig_a": pa.array(sig_a),
                        "sig_b": pa.array(sig_b),
                        "prefix_key": pa.array(key.view(np.int64)),
                        "prefix": binaries(prefix, prefix_offsets),
                        "parity": binaries(*_parities(values, offsets)),
                    }
                )
                row += b - a

    return written(docs.mapInArrow(lean(run), DIGEST), "digests"), int(counts.sum())


def _packed(buckets: int, list_rows: int):
    """Postings of a batch by bucket, one for each group, shingle and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, n, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "n", "prefix_key"))
            # A batch may span files in any order: a group is named by its least rid, which is that of a class.
            order = np.lexsort((rid, n, key))
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (n[order][1:] != n[order][:-1])
            first = order[new]
            packed = batch.column("prefix").take(pa.array(first)).to_pylist()
            size = np.array([len(x) // 8 for x in packed], np.int64)
            out = np.empty(int(size.sum()), _POSTING)
            out["token"] = np.frombuffer(b"".join(packed), "<u8")
            out["gid"], out["key"], out["n"] = (np.repeat(x[first], size) for x in (rid, key, n))
            out["pos"] = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
            lists = 1 + (np.exp2((out["token"] >> np.uint64(48)) / 1024) / list_rows).astype(np.uint64)
            salt = mixed(out["key"].view(np.uint64)) % lists
            bucket = (mixed(out["token"] + salt) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ids, starts = np.unique(bucket[order], return_index=True)
            out = out[order]
            yield pa.record_batch(
                {
                    "bucket": pa.array(ids),
                    "payload": pa.array([_planes(x) for x in np.split(out, starts[1:])] if len(out) else [], pa.binary()),
                }
            )

    return run


def _planes(postings: np.ndarray) -> bytes:
    """Postings with each group's own values once: counts, groups, then per posting token, group, place."""
    gid, first, group = np.unique(postings["gid"], return_index=True, return_inverse=True)
    rows = postings[first]
    return b"".join(
        x.tobytes()
        for x in (
            np.array([len(gid), len(postings)], np.int64), gid, rows["key"], rows["n"],
            postings["token"], group.astype("<u4"), postings["pos"],
        )
    )


def _unplaned(payload: bytes) -> np.ndarray:
    groups, count = np.frombuffer(payload, np.int64, 2)
    at = 16

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(payload, kind, n, at)
        at += found.nbytes
        return found

    gid, key, n = take("<i8", groups), take("<i8", groups), take("<i4", groups)
    out = np.empty(count, _POSTING)
    out["token"] = take("<u8", count)
    group = take("<u4", count)
    out["gid"], out["key"], out["n"] = gid[group], key[group], n[group]
    out["pos"] = take("<i4", count)
    return out


def _lists(payloads: list[bytes], list_rows: int) -> pa.RecordBatch:
    """The lists of one bucket that two groups share (or that are one of several of a shingle)."""
    rows = np.concatenate([_unplaned(x) for x in payloads])
    lists = 1 + (np.exp2((rows["token"] >> np.uint64(48)) / 1024) / list_rows).astype(np.uint64)
    salt = mixed(rows["key"].view(np.uint64)) % lists
    # A bucket may hold several lists of one shingle.
    rows, salt, split = (x[np.lexsort((rows["gid"], rows["key"], rows["n"], salt, rows["token"]))] for x in (rows, salt, lists > 1))
    new_list = np.ones(len(rows), bool)
    new_list[1:] = (rows["token"][1:] != rows["token"][:-1]) | (salt[1:] != salt[:-1])
    new_group = new_list.copy()
    new_group[1:] |= (rows["key"][1:] != rows["key"][:-1]) | (rows["n"][1:] != rows["n"][:-1])
    rows, split, new_list = rows[new_group], split[new_group], new_list[new_group]
    number = np.cumsum(new_list) - 1
    keep = (np.bincount(number)[number] > 1) | split
    rows, number = rows[keep], number[keep]
    order = np.lexsort((rows["gid"], rows["pos"], number))
    rows, number = rows[order], number[order]
    hub = np.maximum.accumulate(np.where(np.concatenate(([True], number[1:] != number[:-1])), np.arange(len(number)), 0)) if len(number) else number
    return pa.record_batch(
        {
            "token": pa.array(rows["token"].view(np.int64) if len(rows) else [], pa.int64()),
            **{c: pa.array(rows[c].astype(np.int64)) for c in ("gid", "pos", "n")},
            **{f"hub{e}": pa.array(rows[c][hub].astype(np.int64)) for e, c in (("", "gid"), ("_pos", "pos"), ("_n", "n"))},
        }
    )


def _unpacked(list_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, payloads = None, []
        for batch in batches:
            for at, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()):
                if at != bucket and payloads:
                    yield _lists(payloads, list_rows)
                    payloads = []
                bucket = at
                payloads.append(payload)
        if payloads:
            yield _lists(payloads, list_rows)

    return run


def shared_lists(digest: DataFrame, shingle_count: int, percent: int, list_rows: int) -> DataFrame:
    """The written lists: each group with its place, and the list's centre with its own."""
    spark = digest.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = shingle_count * (100 - percent) // 100
    buckets = max(4 * partitions, postings // list_rows)
    return written(
        digest.where("n > 0")
        .select("rid", "n", "prefix_key", "prefix")
        .mapInArrow(_packed(buckets, list_rows), PACKED)
        .repartition(partitions, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_unpacked(list_rows), SHARED),
        "lists",
    )


def _may_link(n_a, pos_a, n_b, pos_b, percent: int):
    """Size and position filters for two groups whose first common shingle stands at these places."""
    rest = F.least(n_a - pos_a, n_b - pos_b)
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * rest >= percent * (n_a + n_b))


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def possible(pairs: DataFrame, digest: DataFrame, percent: int) -> DataFrame:
    """The written pairs (u, v) whose parity bits allow a link."""

    def check(batches):
        for batch in batches:
            keep = [
                (100 + percent) * differing_bits(a, b) <= (100 - percent) * (m + n)
                for a, b, m, n in zip(*(batch.column(c).to_pylist() for c in ("parity_u", "parity_v", "n_u", "n_v")))
            ]
            yield pa.record_batch({c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("u", "v")})

    nodes = pairs.select(F.col("u").alias("rid")).unionByName(pairs.select(F.col("v").alias("rid"))).distinct()
    known = written(digest.select("rid", "n", "parity").join(nodes, "rid", "left_semi"), "parities")
    side = lambda c: known.select(F.col("rid").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}"))
    return written(pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(check, "u long, v long"), "possible")


def _set_key(sig_a: np.ndarray, sig_b: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return mixed(mixed(sig_a.view(np.uint64) ^ mixed(sig_b.view(np.uint64))) + doc_id.astype(np.uint64))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose whole sets link.

    The sets are made anew from the texts. A filter of fixed size lets through the documents whose class is in a
    pair and that have the class's least id (none counts as -1), and some more; the joins are exact.
    """
    spark = docs.sparkSession
    nodes = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls"))).distinct()
    wanted = written(classes.join(nodes, "cls").select("cls", "sig_a", "sig_b", F.coalesce("least_id", F.lit(-1)).alias("least_id")), "wanted")

    def wanted_keys(batch):
        yield _set_key(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig_a", "sig_b", "least_id")))

    passed = spark.sparkContext.broadcast(np.packbits(sketches.counted(wanted, wanted_keys, FILTER_BITS, bool)))

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            for a, b, values, offsets in sets_of(batch.column("text"), k):
                sig_a, sig_b = _signatures(values, offsets)
                cell = sketches.cells(_set_key(sig_a, sig_b, ids[a:b]), FILTER_BITS)
                rows = np.flatnonzero((passed.value[cell >> 3] >> (7 - (cell & 7))) & 1)
                rows = rows[np.unique(np.stack((sig_a[rows], sig_b[rows])), axis=1, return_index=True)[1]]
                packed = [values[offsets[i]:offsets[i + 1]].tobytes() for i in rows.tolist()]
                yield pa.record_batch(
                    {"sig_a": pa.array(sig_a[rows]), "sig_b": pa.array(sig_b[rows]), "shingles": pa.array(packed, pa.binary())}
                )

    sets = written(docs.mapInArrow(lean(run), "sig_a long, sig_b long, shingles binary"), "sets")
    if not sets.groupBy("sig_a", "sig_b").count().where("count > 1").isEmpty():  # repeated rows
        sets = written(sets.dropDuplicates(["sig_a", "sig_b"]), "sets")
    side = lambda c, a, b: wanted.select(F.col("cls").alias(c), F.col("sig_a").alias(a), F.col("sig_b").alias(b))
    named = pairs.join(side("u", "ua", "ub"), "u").join(side("v", "va", "vb"), "v")

    def check(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = np.concatenate((a, b))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.record_batch({c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("u", "v")})

    right = named.join(sets.toDF("va", "vb", "right"), ["va", "vb"])
    return right.join(sets.toDF("ua", "ub", "left"), ["ua", "ub"]).select("u", "v", "left", "right").mapInArrow(check, "u long, v long")


def _labelled(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``classes`` with the component of each class under ``comp``."""
    found = components(edges).withColumnRenamed("node", "cls").withColumnRenamed("component", "comp")
    return classes.join(found, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def link(docs: DataFrame, k: int = K, percent: int = PERCENT, list_rows: int = LIST_ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest, shingle_count = digests(docs, k, percent)
    classes = (
        digest.where("n > 0")
        .groupBy("n", "prefix_key", "sig_a", "sig_b")
        .agg(F.min("rid").alias("cls"), F.min("doc_id").alias("least_id"))
    )
    groups = classes.groupBy("n", "prefix_key").agg(F.min("cls").alias("gid"))
    classes = written(classes.join(groups, ["n", "prefix_key"]), "classes")
    lists = shared_lists(digest, shingle_count, percent, list_rows)

    centre = lists.where(_may_link(F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos"), percent))
    tops = lists.groupBy("token").agg(F.min("hub").alias("top"))
    pairs = written(
        _pairs(centre, "gid", "hub")
        .unionByName(_pairs(lists.join(tops, "token"), "hub", "top"))
        .unionByName(_pairs(classes, "gid", "cls"))
        .distinct(),
        "centre-pairs",
    )
    edges = written(verified(possible(pairs, digest, percent), classes, docs, k, percent), "edges")

    state = written(_labelled(classes, edges), "state")
    member = state.select("gid", "cls", "comp")
    top_comp = tops.join(state.select(F.col("cls").alias("top"), F.col("comp").alias("top_comp")), "top").select("token", "top_comp")
    rows = lists.select("token", "gid", "pos", "n").join(member, "gid").join(top_comp, "token")
    rows = rows.select("token", "cls", "pos", "n", "comp", "top_comp")
    far = rows.where("comp != top_comp").select("token", *(F.col(c).alias(f"far_{c}") for c in ("cls", "pos", "n", "comp")))
    across = rows.join(far, "token").where(
        (F.col("comp") != F.col("far_comp"))
        & _may_link(F.col("n"), F.col("pos"), F.col("far_n"), F.col("far_pos"), percent)
    )
    group_comp = state.where("gid = cls").select("gid", F.col("comp").alias("gid_comp"))
    far_member = member.join(group_comp, "gid").where("comp != gid_comp")
    inside = member.join(far_member.select("gid", F.col("cls").alias("far_cls"), F.col("comp").alias("far_comp")), "gid")
    left = written(
        _pairs(across, "cls", "far_cls")
        .unionByName(_pairs(inside.where("comp != far_comp"), "cls", "far_cls"))
        .distinct()
        .join(pairs, ["u", "v"], "left_anti"),
        "left-pairs",
    )
    left = possible(left, digest, percent)
    if not left.isEmpty():
        edges = edges.unionByName(verified(left, classes, docs, k, percent))
        state = written(_labelled(classes, written(edges, "edges")), "state")

    least = state.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    final = state.join(least, "comp").select("n", "sig_a", "sig_b", "component_id")
    return digest.select("doc_id", "n", "sig_a", "sig_b").join(final, ["n", "sig_a", "sig_b"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component: the one that names it.

    Documents without id link with others, but name no component and stay. Rows that repeat a kept id
    are one document and leave a single row.
    """
    linked = written(link(docs, **options), "linked")
    named = F.bool_or(F.col("doc_id") == F.col("component_id")).alias("named")
    dropped = written(linked.where("doc_id is not null").groupBy("doc_id").agg(named).where("not named").select("doc_id"), "dropped")
    again = written(docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id"), "repeated")
    left = docs.join(dropped, "doc_id", "left_anti")
    once = left.join(again, "doc_id", "left_anti")
    twice = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(twice).select(*docs.columns)
