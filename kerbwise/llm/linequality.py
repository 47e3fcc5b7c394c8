"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base counts of a text: words (``[^\\x20\\x09-\\x0D]+``), their characters, symbols, lines that repeat an earlier line,
and words inside 3-word windows found twice or more. A text fails the base rules with fewer than 50 words or more than half of
them in repeated windows.

Line rule: lines are normalised (lower case, white space to one space) and hashed, and each (host, line)
is counted over the distinct texts of its host. A line in more than ``share`` of the host's texts and in more than ``least``,
or in more than ``most`` however large the host, is above the limit and is removed; a text left with less than ``left`` of its
words is depleted and rejected. Exact copies of a text count as one document, so that copies do not condemn their own lines.

The measures of each row are written once with a row number, and only line hashes, never texts, are shuffled. A null text
has no words and fails. A null host is the empty host. Null or repeated ids keep a row each. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwise.llm.columns import free
from kerbwise.session import written

SHARE, LEAST, MOST, LEFT = 0.10, 5, 10_000, 0.30
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SPACE = r"[ \t-\r]+"
_WORD = r"[^ \t-\r]"
_SYMBOLS = "[#*$%&|<>]"


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, _SPACE, " ")))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORD))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to rows with ``words``.

    Windows are hashed, sorted together with their places, and compared with their neighbours;
    the words that the repeated ones cover follow from the gaps between their places.
    """
    windows = F.when(
        F.size("words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.struct(
                F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("hash"), i.alias("place")
            ),
        ),
    ).otherwise(F.array().cast("array<struct<hash:bigint,place:int>>"))
    df = df.withColumn("ordered", F.sort_array(windows))

    def equal(x: Column, i: Column) -> Column:
        return F.coalesce(x["hash"] == F.get("ordered", i)["hash"], F.lit(False))

    repeated = F.filter("ordered", lambda x, i: equal(x, i + 1) | equal(x, i - 1))
    df = df.withColumn("places", F.sort_array(F.transform(repeated, lambda x: x["place"])))
    gaps = F.transform("places", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - x, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x))


def measured(docs: DataFrame, host: Column) -> DataFrame:
    """The written base counts of each row and the hashes and word counts of its lines."""
    df = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    df = df.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    df = df.withColumn("lines", _lines(F.col("text")))
    df = _repeat_words(df)
    return written(
        df.select(
            "rid", "doc_id", "host",
            F.xxhash64("text").alias("text_key"),
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.regexp_replace("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            "n_repeat_words",
            F.transform(
                F.transform("lines", normalised),
                lambda line: F.struct(F.xxhash64(line).alias("line"), F.size(F.split(line, " ")).alias("line_words")),
            ).alias("lines"),
        ),
        "quality",
    )


def frequent_lines(rows: DataFrame, share: float, least: int, most: int) -> DataFrame:
    """(host, line) above the limit."""
    texts = rows.select("host", "text_key").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    lines = rows.select("host", "text_key", F.explode("lines.line").alias("line")).distinct()
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return counted.join(texts, "host").where((F.col("n") > most) | (F.col("n") > share * F.col("texts"))).select("host", "line")


def judge(docs: DataFrame, host: Column, share: float = SHARE, least: int = LEAST, most: int = MOST, left: float = LEFT) -> DataFrame:
    """Per row: the base counts, ``base_failed``, ``kept``, words removed and the hashes of removed lines."""
    rows = measured(docs, host)
    frequent = written(frequent_lines(rows, share, least, most), "frequent-lines")
    held = rows.select("rid", "host", F.explode("lines").alias("l")).select("rid", "host", "l.line", "l.line_words")
    removed = (
        held.join(frequent, ["host", "line"])
        .groupBy("rid")
        .agg(F.sum("line_words").alias("removed"), F.collect_set("line").alias("removed_lines"))
    )
    joined = rows.drop("lines").join(removed, "rid", "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed") < left * F.col("n_words")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        F.col("removed").alias("n_removed_words"),
        "host", "text_key", "removed_lines",
    )


def clean(docs: DataFrame, host: Column, **options) -> DataFrame:
    """The kept rows of ``docs`` without their lines above the limit; ``n_chars`` follows the text.

    Rows meet their verdicts by id, host and text hash: equal rows have equal verdicts.
    """
    own = free(docs.columns, "key", "of", "id", "host", "text_key", "removed", "rest")
    key, of, doc, source, text_key, removed, rest = own
    verdict = written(
        judge(docs, host, **options)
        .where("kept")
        .select(F.col("doc_id").alias(doc), F.col("host").alias(source), F.col("text_key").alias(text_key), F.col("removed_lines").alias(removed))
        .dropDuplicates([doc, source, text_key]),
        "kept",
    )
    keyed = docs.withColumns({key: F.xxhash64(F.coalesce("text", F.lit(""))), of: F.coalesce(host.cast("string"), F.lit(""))})
    joined = keyed.join(
        verdict, (F.col(key) == F.col(text_key)) & (F.col(of) == F.col(source)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc))
    )
    left = F.filter(F.split("text", "\n"), lambda line: ~F.array_contains(removed, F.xxhash64(normalised(line))))
    cut = F.col(removed).isNotNull()
    joined = joined.withColumn(rest, F.when(cut, F.array_join(left, "\n")))
    new = {"text": F.when(cut, F.col(rest)).otherwise(F.col("text")).alias("text")}
    new["n_chars"] = F.when(cut, F.length(rest).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return joined.select(*(new.get(c, F.col(f"`{c}`")) for c in docs.columns))
