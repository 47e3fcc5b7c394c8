"""URL filter, WARC index and pivot index against brute-force versions."""

import base64
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbwise.llm import pivots, queries, urls, warc

PAGES = "page_id long, url string, html string, key string, host string, block long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    queries.ship(spark)


def test_url_rules(spark):
    cases = [
        (1, "http://www.Example.com/en/x?q", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "http://com", "com", "", None, "allow"),
        (4, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        (5, "https://x.net/es/1#f", "x.net", "/es/1", "net/es/", "block"),
        (6, "no scheme", "", "", None, "allow"),
        (7, None, "", "", None, "allow"),
        (8, "http://bad.org/p/?utm_x=1&a=2", "bad.org", "/p/", None, "block"),
        (9, "https://www.bad.org/p?a=2#z", "www.bad.org", "/p", None, "block"),
        (10, "https://www.bad.org/p?a=3", "www.bad.org", "/p", None, "allow"),
        (10, "https://www.bad.org/p?a=3", "www.bad.org", "/p", None, "allow"),
        (None, "://", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, None, "k", "h", 1) for i, u, *_ in cases], PAGES)
    listed = spark.createDataFrame([("bad.org/p?a=2",), ("",), (None,)], "key string")
    got = urls.judge(pages, listed).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, h, p, r, v)) for i, _, h, p, r, v in cases)
    assert urls.judge(pages, listed.where("false")).where("verdict = 'block'").count() == 2
    assert urls.judge(pages.where("false"), listed).count() == 0


def test_no_listed_url_passes_the_filter(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.format_string("http://h%d.org/%d", F.col("id"), F.col("id")).alias("url"))
    listed = pages.where("page_id % 3 = 0").select(urls.canonical(F.col("url")).alias("key"))
    got = urls.judge(pages, listed)
    assert got.where("(verdict = 'block') != (page_id % 3 = 0)").count() == 0


def test_warc_round_trip_and_lookup(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.org/p{i % 20}", f"<p>text {i % 30} {'x' * (i % 50)}</p>") for i in range(200)]
    rows += [(900, "http://a.b/?q \n%41", ""), (901, None, None), (None, "http://a.b/", "<p>alone</p>"), (5, "http://h5.org/p5", rows[5][2])]
    pages = spark.createDataFrame([(*r, None, None, None) for r in rows], PAGES).repartition(5)
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -1), i)

    def expected(least):
        out = []
        for i, u, h in rows:
            data, response = (h or "").encode(), last.get(h or "")
            revisit = len(data) >= least and response is not None and i != response
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            out.append(str((i, u or "", len(data), digest, "revisit" if revisit else "response", response if revisit else None)))
        return sorted(out)

    for least in (0, 20):
        folder = str(tmp_path / f"warc-{least}")
        index = warc.write(pages, folder, least, block_lines=9)
        got = warc.read(index, folder).drop("payload")
        assert sorted(str(tuple(r)) for r in got.collect()) == expected(least)
    asked = pages.select("url").unionByName(spark.createDataFrame([("http://absent.org/",), ("http://zz.zz/",)], "url string"))
    found = warc.lookup(index, folder, asked).collect()
    want = sorted(str((u, i)) for i, u, _ in rows)
    assert sorted(str((r.asked, r.page_id)) for r in found) == want
    assert warc.read(warc.write(pages.where("false"), str(tmp_path / "none")), str(tmp_path / "none")).count() == 0


def test_pivot_index_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows, centres = [], rng.standard_normal((40, 16))
    for i in range(600):
        v = centres[i % 40] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.45])
        rows.append((i, v.tolist(), i % 3, 1.0, 2))
    rows += [(1000 + i, rows[i][1], rows[i][2], 1.0, 2) for i in range(20)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0], [1e200] * 16, [2e200] * 16]
    rows += [(2000 + i, v, 1, 1.0, 2) for i, v in enumerate(odd)]
    rows += [(3000, rows[0][1], None, 1.0, 2), (None, rows[0][1], 0, 1.0, 2), (7, rows[7][1], rows[7][2], 1.0, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, weight double, node long")

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(r[1]) if r[2] is not None else None for r in rows]
    degree, near = [0] * len(rows), [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.93:
                degree[a], degree[b] = degree[a] + 1, degree[b] + 1
                near[a].append(b)
                near[b].append(a)
    for block in (16, 1024):
        got = pivots.near_duplicates(df, block=block).collect()
        assert len(got) == len(rows)
        found = sum(r.n_links for r in got)
        assert 0.98 * sum(degree) <= found <= sum(degree)
        by_id = {r.vec_id: r for r in got}
        for i, (row, n) in enumerate(zip(rows, degree)):
            if row[0] not in (None, 7):
                assert by_id[row[0]].n_links <= n and (n > 0 or by_id[row[0]].component_id == row[0])
                assert by_id[row[0]].kept == (by_id[row[0]].component_id == row[0])
    assert pivots.near_duplicates(df.where("false")).count() == 0


def shapes(n, seed):
    """Vectors in groups of several widths: plain, with few strong directions, and one crowded group."""
    rng = np.random.default_rng(seed)
    out = []
    for scale, shift in ((np.ones(32), 0.0), (np.exp(-np.arange(32) / 8.0), 0.3)):
        centres = rng.standard_normal((n // 24, 32)) * scale + shift
        own = centres[rng.integers(0, len(centres), n // 2)]
        out.append(own + rng.standard_normal(own.shape) * scale * rng.choice([0.02, 0.1, 0.2, 0.28], (len(own), 1)))
    out.append(centres[0] + rng.standard_normal((n // 10, 32)) * 0.05)
    return np.concatenate(out)


def test_pivot_index_prunes_and_finds(spark):
    vectors = shapes(6000, 3)
    labels = np.random.default_rng(1).integers(0, 2, len(vectors))
    rows = [(i, v.tolist(), int(x)) for i, (v, x) in enumerate(zip(vectors, labels))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (units @ units.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(df, block=512).collect()}
    assert all(got[i] <= n for i, n in enumerate(near.sum(axis=1).tolist()))
    assert sum(got.values()) >= 0.98 * near.sum() > 10_000
    done = pivots.work(df, block=512).first()
    same = (labels[:, None] == labels[None, :]).sum() - len(labels)
    assert done.all_pairs == same // 2
    # the links themselves are candidates; beside them a few in a hundred of all pairs
    assert near.sum() / 2 * 0.98 <= done.cosines <= near.sum() / 2 + 0.05 * done.all_pairs and done.cosines <= done.listed


def test_pivot_index_with_ties_and_repeated_vectors(spark):
    rows = [(i, [float(i % 3 == k) for k in range(3)], 1) for i in range(30)] + [(90, [1.0, 1.0, 0.0], 1), (91, [1.0, 1.0, 0.0], 2)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**{i: (9, i % 3) for i in range(30)}, 90: (0, 90), 91: (0, 91)}
