"""Secret scan with corpus-wide ownership frequency.

Base spans (kinds ``assign``, ``access``, ``hex``) are found by fixed patterns, leftmost and non-overlapping
for each kind. Further candidates come from wider detectors: provider-prefixed keys, signed web tokens, private key
headers, passwords in URLs and long mixed strings. Every candidate value, base ones too, is hashed, and its hash is
counted over the whole corpus: distinct repositories and distinct owners that hold it. A value
that more than ``max_owners`` owners or ``max_repositories`` repositories hold is a widely copied example; one held by few and
random enough to be a live credential adds its span to the document's (kind ``live``). Base spans
are always kept.

Counting goes by distinct (hash, owner, repository) first, so a value in a third of all documents reaches the
shuffle as one row a task and repository. The texts are never shuffled.

A null text is empty. A null owner is an owner of its own. A null or repeated ``doc_id`` keeps a row for each row of the
table, by a row number written with the candidates. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwise.llm.columns import free
from kerbwise.session import written

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "live")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Shapes of credentials beside the base ones; group 1 is the value.
SHAPES = (
    r"\b((?:ghp|gho|ghs|ghr|glpat|sk_live|rk_live|xox[abprs])[-_][A-Za-z0-9_-]{16,})",
    r"\b(AIza[A-Za-z0-9_-]{35,})",
    r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    r"(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)",
    r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_-]{32,}={0,2})(?![A-Za-z0-9+/_=-])",
)
#: A password in a URL, which need not hold digits.
URL_SHAPE = r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s/:@]+:([^\s/:@]{6,})@"
MAX_OWNERS, MAX_REPOSITORIES = 2, 3
MIN_BITS = 3.0

_BASE = {
    "assign": re.compile(ASSIGN, re.IGNORECASE | re.ASCII),
    "access": re.compile(ACCESS),
    "hex": re.compile(r"[0-9a-f]{24,}"),  # the runs of at least 24
}
_SHAPES = [re.compile(p, re.ASCII) for p in SHAPES]
_URL = re.compile(URL_SHAPE, re.ASCII)
#: What a text must hold before any pattern is tried on it; one linear pass over a batch.
_HINT = (
    r"(?:[pP][aA][sS][sS][wW]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[^\n]{0,8}? *[:=]"
    r"|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{32}|(?:ghp|gho|ghs|ghr|glpat|sk_live|rk_live|xox[abprs])[-_]|AIza|eyJ|PRIVATE KEY|://[^\s/@]*:[^\s/@]*@"
)

SCAN = (
    "rid long, doc_id long, text_key long, owner string, repository string, n_assign long, n_access long, n_hex long, "
    "base array<struct<start:long,rank:long,stop:long>>, candidates array<struct<hash:string,start:long,stop:long,live:boolean>>"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, rank of kind, end)`` of the base matches, sorted."""
    found = []
    for rank, (kind, pattern) in enumerate(_BASE.items()):
        for m in pattern.finditer(text):
            value = m[2] if kind == "assign" else m[0]
            if len(value) >= LEAST[kind]:
                found.append((m.start(), rank, m.end()))
    return sorted(found)


def looks_live(value: str, in_url: bool = False) -> bool:
    """Random enough: digits and letters (in a URL's password any signs), and at least ``MIN_BITS`` bits a character."""
    if value.startswith("-----BEGIN"):
        return True
    if not in_url and not (re.search(r"[0-9]", value) and re.search(r"[A-Za-z]", value)):
        return False
    counts = Counter(value).values()
    return -sum(c / len(value) * math.log2(c / len(value)) for c in counts) >= MIN_BITS


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """``(hash, start, end, looks live)`` of every candidate value, sorted by place."""
    spans = {(m.start(2), m.end(2)) for m in _BASE["assign"].finditer(text) if len(m[2]) >= LEAST["assign"]}
    spans |= {m.span() for kind in ("access", "hex") for m in _BASE[kind].finditer(text) if len(m[0]) >= LEAST[kind]}
    spans |= {m.span(1) for pattern in _SHAPES for m in pattern.finditer(text)}
    in_url = {m.span(1) for m in _URL.finditer(text)}
    return [
        (hashlib.sha256(text[a:b].encode()).hexdigest(), a, b, looks_live(text[a:b], (a, b) in in_url)) for a, b in sorted(spans | in_url)
    ]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rid = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts = batch.column("text")
        hinted = pc.match_substring_regex(texts, _HINT).fill_null(False).to_pylist()
        base, found = [], []
        for i, hint in enumerate(hinted):
            text = texts[i].as_py() if hint else ""
            base.append(base_spans(text))
            found.append(candidates(text))
        counts = [Counter(rank for _, rank, _ in spans) for spans in base]
        yield pa.record_batch(
            {
                "rid": pa.array(range(rid, rid + len(base)), pa.int64()),
                **{c: batch.column(c) for c in ("doc_id", "text_key", "owner", "repository")},
                **{f"n_{kind}": pa.array([c[rank] for c in counts], pa.int64()) for rank, kind in enumerate(LEAST)},
                "base": pa.array(
                    [[dict(zip(("start", "rank", "stop"), s)) for s in spans] for spans in base],
                    pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "rank", "stop")])),
                ),
                "candidates": pa.array(
                    [[dict(zip(("hash", "start", "stop", "live"), s)) for s in spans] for spans in found],
                    pa.list_(pa.struct([("hash", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("live", pa.bool_())])),
                ),
            }
        )
        rid += len(base)


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, (s["rank"] + 1).cast("int")), s["start"], s["stop"])), ","
    )


def ownership(scanned: DataFrame) -> DataFrame:
    """Per candidate hash the distinct repositories and owners that hold it."""
    held = scanned.select("owner", "repository", F.explode("candidates.hash").alias("hash"))
    distinct = held.distinct()
    return distinct.groupBy("hash", "owner").agg(F.count("*").alias("repositories")).groupBy("hash").agg(
        F.sum("repositories").alias("repositories"), F.count("*").alias("owners")
    )


def scan(docs: DataFrame, owner: Column, repository: Column, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Per row: counts, base digest, all spans, and how many candidates are live or examples."""
    scanned = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"))
        .mapInArrow(_scan, SCAN),
        "secrets",
    )
    counted = ownership(scanned)
    occurrences = scanned.select("rid", F.explode("candidates").alias("c")).select("rid", "c.*")
    judged = occurrences.join(counted, "hash").withColumn(
        "rare", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    )
    by_row = judged.groupBy("rid").agg(
        F.sum(F.when(~F.col("rare"), 1).otherwise(0)).alias("n_examples"),
        F.collect_list(
            F.when(
                F.col("rare") & F.col("live"),
                F.struct("start", F.lit(len(KINDS) - 1).cast("long").alias("rank"), "stop"),
            )
        ).alias("live_spans"),
    )
    none = F.array().cast("array<struct<start:long,rank:long,stop:long>>")
    joined = scanned.join(by_row, "rid", "left").withColumn("live_spans", F.coalesce("live_spans", none))
    spans = F.array_sort(F.concat("base", "live_spans"))
    return joined.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        F.size("live_spans").cast("long").alias("n_live"),
        F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"),
        "text_key",
    )


MASK = "[secret]"


def masked(text: str, spans: str) -> str:
    """``text`` with each run of overlapping spans replaced by ``MASK``."""
    out, at = [], 0
    places = sorted((int(a), int(b)) for a, b in (s.split(":")[1:] for s in spans.split(",")))
    merged: list[list[int]] = []
    for a, b in places:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], MASK]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, owner: Column, repository: Column, **options) -> DataFrame:
    """``docs`` with every span of the scan masked and ``n_chars`` brought up to date.

    Rows are joined with their spans by id and text hash; equal rows have equal spans.
    """

    @F.pandas_udf("string")
    def mask(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or s is None else masked(t, s) for t, s in zip(texts, spans)], dtype=object)

    doc, span_key, found, key, hidden = free(docs.columns, "id", "span_key", "found", "key", "hidden")
    spans = written(
        scan(docs, owner, repository, **options)
        .where("spans != ''")
        .select(F.col("doc_id").alias(doc), F.col("text_key").alias(span_key), F.col("spans").alias(found))
        .dropDuplicates([doc, span_key]),
        "spans",
    )
    keyed = docs.withColumn(key, F.xxhash64("text"))
    joined = keyed.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(span_key)), "left")
    hit = F.col(found).isNotNull()
    joined = joined.withColumn(hidden, mask(F.when(hit, F.col("text")), F.col(found)))
    new = {"text": F.when(hit, F.col(hidden)).otherwise(F.col("text")).alias("text")}
    new["n_chars"] = F.when(hit, F.length(hidden).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return joined.select(*(new.get(c, F.col(f"`{c}`")) for c in docs.columns))
