"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwise.llm import (
    htmltext, jaccard, licenses, linequality, merkle, mergedropout, packing, pivots, runs, secrets, sharding, urls, warc,
)

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    context: SparkContext = spark.sparkContext
    if getattr(context, "_kerbwise_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="kerbwise-code-"), "kerbwise.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in sorted(os.walk(_PACKAGE)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    context.addPyFile(path)
    context._kerbwise_shipped = True


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repository() -> Column:
    """The repository of a document: its owner's part in its language."""
    return F.concat_ws("/", "source", "lang")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.fitted(pages))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.tokenizer_path())


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), F.col("source"), repository()).drop("text_key")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.listed_in(pages))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mergedropout.encode_report(_table(spark, sf_dir, "documents"), mergedropout.model_path())


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linequality.judge(_table(spark, sf_dir, "documents"), F.col("source"))
    return found.drop("host", "text_key", "removed_lines")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.scan(_table(spark, sf_dir, "documents"), plant=True)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove_all(_table(spark, sf_dir, "documents")).drop("tree", "idx")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_text, op2_packing, op3_jaccard_join, op4_secret_scan, op5_url_filter, op6_warc, op7_pivot_index,
        op8_license_scan, op9_merge_dropout, op10_line_frequency, op11_periodic_runs,
        op12_merkle, op13_sharding,
    )
    return {f.__name__: f for f in found}


_COMPONENTS = """
links AS MATERIALIZED ({links}),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT {id} AS a, {id} AS b FROM {nodes}
  UNION
  SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b
),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
"""

OP3_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM documents
),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM texts)
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
""" + _COMPONENTS.format(
    id="doc_id",
    nodes="documents",
    links="""
  SELECT c.a, c.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
  ) c JOIN sizes p ON p.doc_id = c.a JOIN sizes q ON q.doc_id = c.b
  WHERE 100 * c.c >= 80 * (p.n + q.n - c.c)""",
) + """
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least l ON l.a = d.doc_id
"""

OP5_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), ''), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|ref)='))) AS query
  FROM pages
),
ruled AS (
  SELECT *, '.' || host AS h,
    regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS key
  FROM parts
),
named AS (
  SELECT *, CASE
    WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with(h, '.com') AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM ruled
),
listed AS (SELECT DISTINCT key FROM ruled WHERE host <> '' AND regexp_matches(host, '(^|\.)(adult-|ads-|casino-|cheap-|free-|spam-)'))
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host <> '' AND key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM named
"""

OP6_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
last AS (SELECT html, max(page_id) AS page FROM payloads GROUP BY html)
SELECT p.page_id, octet_length(encode(p.html)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(p.hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN p.page_id = last.page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = last.page THEN NULL ELSE last.page END AS refers_to
FROM payloads p JOIN last ON last.html = p.html
"""

OP7_SQL = """
WITH RECURSIVE vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
""" + _COMPONENTS.format(
    id="vec_id",
    nodes="embeddings",
    links="SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND x.vec_id < y.vec_id"
    " WHERE list_cosine_similarity(x.v, y.v) >= 0.93",
) + """
SELECT e.vec_id, (SELECT count(*) FROM edges WHERE edges.a = e.vec_id) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id
"""

OP10_SQL = r"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
),
split AS MATERIALIZED (
  SELECT r, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines
  FROM texts
),
windows AS MATERIALIZED (
  SELECT r, i, hash(w[i], w[i + 1], w[i + 2]) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)
),
again AS (SELECT r, s FROM windows GROUP BY r, s HAVING count(*) > 1),
covered AS (
  SELECT r, count(DISTINCT i + j) AS n FROM windows JOIN again USING (r, s), (VALUES (0), (1), (2)) t(j) GROUP BY r
),
lines AS MATERIALIZED (
  SELECT r, line, len(string_split(line, ' ')) AS n FROM (
    SELECT r, lower(trim(regexp_replace(unnest(lines), '[ \t-\r]+', ' ', 'g'))) AS line FROM split)
),
hosts AS (SELECT host, count(DISTINCT text) AS texts FROM texts GROUP BY host),
frequent AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM lines JOIN texts USING (r) GROUP BY host, line)
  JOIN hosts USING (host) WHERE n > 5 AND (n > 10000 OR n > 0.10 * texts)
),
removed AS (SELECT r, sum(n) AS n FROM lines JOIN texts USING (r) JOIN frequent USING (host, line) GROUP BY r),
counts AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(removed.n, 0)::BIGINT AS n_removed_words
  FROM texts JOIN split USING (r) LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - n_removed_words < 0.30 * n_words) AS kept,
  n_removed_words
FROM counts
"""

OP12_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, ascii, CASE WHEN text IS NULL THEN NULL ELSE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS folded,
    text, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head
  FROM (SELECT *, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS ascii FROM documents)
),
leaves AS MATERIALIZED (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, ascii), lambda c, b:
        list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 3 = 0
      THEN sha256(head || coalesce(octet_length(encode(folded)) || ':' || folded, '-'))
      ELSE sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) END AS claimed
  FROM docs
),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS size FROM leaves
),
nodes AS (
  SELECT lang, 0 AS level, idx, size, leaf AS digest FROM placed
  UNION ALL
  SELECT lang, level + 1, idx // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE size > 1 GROUP BY lang, level, idx // 8, size
),
langs AS MATERIALIZED (
  SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS size FROM nodes WHERE size = 1
),
tops AS (
  SELECT 0 AS level, rank AS idx, size, subroot AS digest FROM langs
  UNION ALL
  SELECT level + 1, idx // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE size > 1 GROUP BY level, idx // 8, size
),
runs AS MATERIALIZED (
  SELECT coalesce('s' || lang, 'n') AS tree, level, idx // 8 AS run, list(digest ORDER BY idx) AS digests FROM nodes WHERE size > 1 GROUP BY ALL
  UNION ALL
  SELECT '', level, idx // 8, list(digest ORDER BY idx) FROM tops WHERE size > 1 GROUP BY ALL
),
root AS (SELECT level AS height, digest AS root FROM tops WHERE size = 1),
folds AS (
  SELECT row_number() OVER () AS r, doc_id, leaf, placed.lang, idx AS pos, claimed AS digest, 0 AS level, height, false AS top, '' AS proof, subroot, rank FROM placed
  JOIN langs ON langs.lang IS NOT DISTINCT FROM placed.lang
  UNION ALL
  SELECT f.r, f.doc_id, f.leaf, f.lang,
    CASE WHEN f.level = f.height AND NOT top THEN rank ELSE pos // 8 END,
    CASE WHEN f.level = f.height AND NOT top THEN f.digest ELSE sha256(array_to_string(digests[:pos % 8] || [f.digest] || digests[pos % 8 + 2:], '')) END,
    CASE WHEN f.level = f.height AND NOT top THEN 0 ELSE f.level + 1 END,
    CASE WHEN f.level = f.height AND NOT top THEN root.height ELSE f.height END,
    top OR f.level = f.height,
    CASE WHEN f.level = f.height AND NOT top THEN proof ELSE proof || array_to_string(digests[:pos % 8] || digests[pos % 8 + 2:], '') END,
    f.subroot, f.rank
  FROM folds f CROSS JOIN root
  LEFT JOIN runs ON runs.tree = CASE WHEN top THEN '' ELSE coalesce('s' || lang, 'n') END AND runs.level = f.level AND runs.run = pos // 8
  WHERE NOT (top AND f.level = f.height)
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM folds CROSS JOIN root WHERE top AND folds.level = folds.height
"""


def statements() -> dict[str, str]:
    return {
        "op3_jaccard_join": OP3_SQL, "op5_url_filter": OP5_SQL, "op6_warc": OP6_SQL, "op7_pivot_index": OP7_SQL,
        "op10_line_frequency": OP10_SQL, "op12_merkle": OP12_SQL,
    }
