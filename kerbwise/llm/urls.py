"""URL filter: host and path rules, then a blocked Bloom filter before an exact join, in DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains when the URL's path starts with the rule's; the longest
that fits decides. URLs without a rule are looked up in a list of canonical URLs: a blocked Bloom filter (one
64-bit word a block, four bits a key, ``2 ** BLOCK_BITS`` blocks whatever the list's size) passes possible hits, and only these go to the
exact hash join with the list, which takes out the false positives. A longer list makes the filter pass more, never less.

A null URL or one without ``://`` has an empty host and path, fits no rule and is on no list. Repeated rows keep a row
each; an empty table or list is fine; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Host labels whose pages the registered query puts on its list.
LISTED_HOSTS = r"(^|\.)(adult-|ads-|casino-|cheap-|free-|spam-)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, sorted parameters but tracking ones; empty without host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]*|ref)=")))
    shown = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host == "", F.lit("")).otherwise(F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), shown))


def _word(key: Column) -> Column:
    """The four bits of a key in its block."""
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for i in range(4):
        out = out.bitwiseOR(_one_bit(F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def _one_bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def _block(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - BLOCK_BITS)


def bloom_words(keys: DataFrame) -> DataFrame:
    """One row: the filter's words in the order of their blocks. ``keys`` has a column ``key``."""
    filled = keys.groupBy(_block(F.col("key")).alias("block")).agg(F.bit_or(_word(F.col("key"))).alias("word"))
    blocks = keys.sparkSession.range(1 << BLOCK_BITS).withColumnRenamed("id", "block")
    dense = blocks.join(filled, "block", "left").select("block", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "word"))), lambda x: x["word"]).alias("words"))


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, outcome in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(outcome)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict. ``listed`` has a column ``key`` of canonical URLs."""
    listed = listed.where("key != ''").select("key").distinct()
    url = F.col("url")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = (
        pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
        .withColumns({"rule": name, "ruled": verdict})
    )
    word = _word(F.col("key"))
    words = bloom_words(listed).scalar()
    possible = F.element_at(words, (_block(F.col("key")) + 1).cast("int")).bitwiseAND(word) == word
    df = df.withColumn("possible", F.col("rule").isNull() & (F.col("key") != "") & possible)
    sure = df.where(~F.col("possible")).withColumn("verdict", F.coalesce("ruled", F.lit("allow")))
    hits = df.where("possible").join(listed.withColumn("hit", F.lit(True)), "key", "left")
    hits = hits.withColumn("verdict", F.when(F.col("hit"), "block").otherwise("allow"))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return sure.select(*columns).unionByName(hits.select(*columns))


def listed_in(pages: DataFrame) -> DataFrame:
    """The canonical URLs of pages on hosts with a listed label."""
    return pages.where(host_of(F.col("url")).rlike(LISTED_HOSTS)).select(canonical(F.col("url")).alias("key"))
