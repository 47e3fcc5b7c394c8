"""Periodic runs, Merkle proofs and sharding against brute-force versions, with every odd row."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbwise.llm import merkle, queries, runs, sharding

WORD = "[^\x20\x09-\x0D]+"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, tree string, part int, at long, row string, "
    "idx long, size long, digest string, shard string, rid long, block long, runs string, n_runs int"
)
EXTRA = ("x", 1, 2, "y", 3, 4, "z", "s", 5, 6, "r", 7)


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    queries.ship(spark)


def table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(parts)


# periodic runs


def brute_runs(words, least=6, exponent=4):
    """Every maximal stretch of each period, its smallest period only."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start >= q:
                found.setdefault((start, i - start + q), q)
    return sorted((s, length, q) for (s, length), q in found.items() if length >= max(least, exponent * q))


def brute_report(doc_id, text, plant):
    w = re.findall(WORD, text or "")
    n = len(w)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
    text = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (
        doc_id, len(found), best[0], best[1], best[2], best[0] if best[0] is None else 1000 * best[1] // best[2],
        digest, hashlib.sha256(text.encode()).hexdigest(),
    )


def odd_texts():
    draw = random.Random(3)
    texts = [None, "", " \t\n\x0b", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b a b a b a", "x\x1cy " * 9, "é  " * 7, "日本 " * 6 + "a " * 6]
    texts += ["a a b a a b a a b a a b a a", " ".join("ab"[i % 2] for i in range(41)) + " a a a a a a"]
    for _ in range(120):
        letters, n = draw.choice([1, 2, 2, 3, 6, 40]), draw.choice([6, 12, 30, 90])
        words = [f"w{draw.randrange(letters)}" for _ in range(n)]
        if draw.random() < 0.6:
            at, period = draw.randrange(n), draw.randint(1, 9)
            words += [words[at:][i % len(words[at:])] for i in range(period * draw.randint(3, 6))]
        texts.append(draw.choice([" ", "\n", "  "]).join(words))
    return texts


def test_runs_equal_brute_force(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(odd_texts())]
    rows += [rows[5], (None, "b " * 12, None, None, None), (10**12, "c d " * 30, None, None, None)]
    for plant in (False, True):
        got = runs.scan(table(spark, rows), plant=plant).collect()
        assert sorted(map(tuple, got), key=str) == sorted((brute_report(r[0], r[1], plant) for r in rows), key=str)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows if r[0])
    assert runs.scan(table(spark, rows).where("false")).count() == 0


def test_runs_and_collapsed_text_as_rows(spark):
    got = runs.scan(table(spark, [(1, "x " + "a b " * 5 + "y", "en", "s", 1)]), full=True).first()
    assert [tuple(r) for r in got["runs"]] == [(1, 10, 2)] and got["collapsed"] == "x a b y"


def test_runs_of_long_texts():
    n = 150_000
    one = np.zeros(n, np.int64)
    assert [x.tolist() for x in runs.runs_of(one, np.array([0, n]))] == [[0], [0], [n], [1]]
    cycle = np.arange(n) % 37
    cycle[60_000] = 40
    got = [x.tolist() for x in runs.runs_of(np.concatenate((cycle, cycle)), np.array([0, n, 2 * n]))]
    assert got == [[0, 0, 1, 1], [0, 60_001] * 2, [60_000, n - 60_001] * 2, [37] * 4]
    a, b = [0], [0, 1]  # a Fibonacci word: squares at every length, no fourth powers
    while len(b) < n:
        a, b = b, b + a
    assert len(runs.runs_of(np.array(b), np.array([0, len(b)]))[0]) == 0


def test_shared_work_is_kept_apart_by_rows():
    """A text's runs do not depend on what else is in the slice."""
    draw = random.Random(5)
    texts = [[draw.randrange(2) for _ in range(draw.randrange(40))] for _ in range(60)]
    offsets = np.cumsum([0, *map(len, texts)])
    found = collections.defaultdict(list)
    for row, *run in zip(*(x.tolist() for x in runs.runs_of(np.array([x for t in texts for x in t]), offsets))):
        found[row].append(tuple(run))
    assert [found[i] for i in range(len(texts))] == [brute_runs(t) for t in texts]


# Merkle manifest


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def brute_leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def brute_proofs(rows):
    def claimed(r):
        hit = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0 and r[1] is not None
        return brute_leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1]) if hit else r[1])

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r, r[1]))) for x in langs]
    inner = [brute_levels([brute_leaf(r, r[1]) for r in tree]) for tree in trees]
    top = brute_levels([x[-1][0] for x in inner])
    out = []
    for k, tree in enumerate(trees):
        for i, r in enumerate(tree):
            at, digest, siblings = i, claimed(r), []
            for levels, at in ((inner[k], i), (top, k)):
                for nodes in levels[:-1]:
                    first = at // 8 * 8
                    run = nodes[first:first + 8]
                    siblings += run[:at - first] + run[at - first + 1:]
                    digest = sha(*run[:at - first], digest, *run[at - first + 1:])
                    at //= 8
            root = top[-1][0]
            out.append((r[0], brute_leaf(r, r[1]), inner[k][-1][0], root, sha(*siblings), digest, digest == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n, langs", [(0, 1), (1, 1), (8, 1), (9, 2), (70, 1), (300, 30)])
def test_proofs_equal_brute_force(spark, n, langs):
    draw = random.Random(n)
    names = [None, *(f"l{j}é" for j in range(langs)), "n", ""] if n > 9 else ["x"]
    rows = [(i, draw.choice(["Ab C" * 3, "abc", "", None, "É\n x", "Z" * 90_000]), draw.choice(names), draw.choice(["s", None]), draw.choice([1, None, -5])) for i in range(n)]
    if n > 9:
        rows += [rows[0], rows[0], (None, "X", "n", None, 1), (None, "y", "n", None, 1), (rows[1][0], "other", rows[1][2], None, 3)]
    got = merkle.prove_all(table(spark, rows)).drop("tree", "idx").collect()
    assert sorted(map(tuple, got), key=str) == brute_proofs(rows)


def test_blocks_of_several_levels(spark):
    """More than 8^4 leaves: two rounds of reduction, and blocks that fetch from one another."""
    rows = [(i, f"T{i}", "de" if i % 50 else "en", "s", i) for i in range(4200)]
    got = merkle.prove_all(table(spark, rows)).drop("tree", "idx").collect()
    assert sorted(map(tuple, got), key=str) == brute_proofs(rows)


def test_multiproof_of_a_few_leaves(spark):
    """For a few leaves only what they do not yield is fetched, once each, and every proof leads to the root."""
    rows = [(i, f"T{i}", "de", "s", i) for i in range(600)]
    leaves, nodes = merkle.manifest(table(spark, rows))
    wanted = leaves.where("doc_id in (3, 5, 77)")
    fetched = merkle.missing(wanted.withColumn("block", F.lit(0).cast("long"))).collect()
    # level 0: six others of run 0, seven of run 9; level 1: nodes 2-7 with 0 known, 8 and 10-15; level 2: nodes 2-7 and 8, 9 above
    assert collections.Counter(r["level"] for r in fetched) == {0: 6 + 7, 1: 7 + 7, 2: 6, 3: 1}
    assert len({(r["tree"], r["level"], r["idx"]) for r in fetched}) == len(fetched)
    want = {r[0]: r for r in brute_proofs(rows)}
    got = merkle.proofs(nodes, wanted, full=True).collect()
    assert sorted(r["doc_id"] for r in got) == [3, 5, 77]
    for r in got:
        assert tuple(r)[:7] == want[r["doc_id"]] and sha(r["proof"]) == r["proof_sha256"]


# sharding


@pytest.mark.parametrize("size, marked, drawn", [(50, 20, 10), (1000, 3, 400), (10, 10, 4), (300, 150, 299), (100_000, 4000, 50_000), (7, 0, 3)])
def test_counts_follow_the_hypergeometric_law(spark, size, marked, drawn):
    n = 3000
    long = lambda x: F.lit(x).cast("long")
    at = spark.range(n).select(sharding.hypergeometric(long(size), long(marked), long(drawn), (F.col("id") + 0.5) / n).alias("k"))
    got = collections.Counter(r["k"] for r in at.collect())

    def choices(a, b):
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    low, high = max(0, marked + drawn - size), min(marked, drawn)
    law = {k: math.exp(choices(marked, k) + choices(size - marked, drawn - k) - choices(size, drawn)) for k in range(low, high + 1)}
    assert set(got) <= set(law) and all(abs(got[k] - n * p) <= 1.001 for k, p in law.items())


def test_matrix_adds_up(spark):
    parts = [(i, n) for i, n in enumerate([1, 700, 3, 90, 41, 260, 5, 5, 900, 17, 1])]
    got = {r["part"]: r["counts"] for r in sharding.matrix(spark.createDataFrame(parts, "part int, n long"), 7, 9).collect()}
    assert {p: sum(c) for p, c in got.items()} == dict(parts)
    total = sum(n for _, n in parts)
    assert [sum(c) for c in zip(*got.values())] == [total // 7 + (s < total % 7) for s in range(7)]


def test_shards_are_exact_and_complete(spark):
    rows = [(i % 900 if i % 7 else None, None if i % 11 == 0 else "é" * (i % 5), "en", "s", i) for i in range(1000)]
    docs = table(spark, rows, 6)
    got = sharding.shuffled(docs, 24, 5, bucket_rows=9)
    assert sorted(got.columns) == sorted([*docs.columns, "slot"])
    slots = collections.defaultdict(list)
    for r in got.collect():
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} == {41, 42}
    assert sorted(map(str, got.drop("shard", "slot").collect())) == sorted(map(str, docs.drop("shard").collect()))
    report = sharding.assign(docs).collect()
    expected = sorted(str((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()))) for r in rows)
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in report) == expected
    assert {r["law"] for r in report} == {"rows"} and {r["grown_shard"] for r in report} == {None}
    assert sharding.assign(docs.where("false")).count() == 0


def test_sharding_runs_no_python(spark, small):
    plan = queries.op13_sharding(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_shuffle_is_uniform_and_repeatable(spark):
    rows = spark.range(3000).coalesce(3)
    first = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shuffled(rows, 4, 1).collect()}
    assert first == {r["id"]: (r["shard"], r["slot"]) for r in sharding.shuffled(rows, 4, 1).collect()}
    assert first != {r["id"]: (r["shard"], r["slot"]) for r in sharding.shuffled(rows, 4, 2).collect()}
    # a row's shard does not depend on its place: 10 stretches of 300 rows, 4 shards, 27 degrees of freedom
    counts = collections.Counter((i // 300, shard) for i, (shard, _) in first.items())
    assert sum((counts[t, s] - 75) ** 2 / 75 for t in range(10) for s in range(4)) < 55
    # nor does its slot
    order = [slot for _, (shard, slot) in sorted(first.items()) if shard == 0]
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 4 / math.sqrt(len(order))


def test_shards_as_files(spark, tmp_path):
    rows = spark.range(100).withColumn("x", F.col("id") * 2)
    sharding.write(sharding.shuffled(rows, 3, 1), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["shard"], r["count"]) for r in back.groupBy("shard").count().collect()} == {(0, 34), (1, 33), (2, 33)}
    assert back.where("x = 2 * id").count() == 100
