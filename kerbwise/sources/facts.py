"""The incident fact as a store that batches are appended to, with ids unique over all of them.

A run writes its rows, its rejected rows and its ids under folders of its own, and then one small commit
row. Readers go by the commits, so they see a batch whole or not at all, and what an interrupted run left behind
is never read. The id index holds the ids of every batch in hash buckets; a batch reads only the buckets that its own
ids fall in, and of these only the id column. One run appends at a time: a second one that started from the
same commits is refused when it commits.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbwise.functions.geo import with_cell
from kerbwise.operators.quality import incident_defaults, marked_contents, parsed, stamped, with_reasons
from kerbwise.schema import CHECKED_CSV, INCIDENT_COLUMNS, INCIDENT_CSV, UNPARSED
from kerbwise.session import written
from kerbwise.sources.files import checked_csv, write_incident_table
from kerbwise.sources.results import stored

DUPLICATE, KNOWN = "accident_id_duplicate", "accident_id_known"
COMMITS = "batch long, run string"
_RUN = [T.StructField("run", T.StringType())]
_BATCH = [T.StructField("batch", T.LongType())]
PARTS = {
    "fact": T.StructType([*INCIDENT_CSV.fields, T.StructField("cell", T.LongType()), T.StructField("created_at", T.TimestampType()), *_BATCH, *_RUN]),
    "quarantine": T.StructType(
        [*CHECKED_CSV.fields, T.StructField("reasons", T.ArrayType(T.StringType())), T.StructField("copies", T.LongType()), *_BATCH, *_RUN]
    ),
    "ids": T.StructType([T.StructField("accident_id", T.StringType()), T.StructField("bucket", T.IntegerType()), *_RUN]),
}


@dataclass(frozen=True)
class FactStore:
    """Fact, quarantine and id index below one folder."""

    spark: SparkSession
    folder: str
    buckets: int = 256

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def commits(self) -> list[tuple[int, str]]:
        """Committed batches and their runs, in order: one pair a batch."""
        rows = stored(self.spark, f"{self.folder}/commits/*", COMMITS).collect()
        return sorted((r["batch"], r["run"]) for r in rows)

    def _read(self, part: str) -> DataFrame:
        """A part of all committed runs; empty before the first batch."""
        runs = [f"{self.folder}/{part}/run={run}" for _, run in self.commits()]
        if not runs:
            return self.spark.createDataFrame([], PARTS[part]).drop("run")
        return self.spark.read.schema(PARTS[part]).option("basePath", f"{self.folder}/{part}").parquet(*runs).drop("run")

    def facts(self) -> DataFrame:
        return self._read("fact")

    def quarantine(self) -> DataFrame:
        return self._read("quarantine")

    def _known(self, ids: DataFrame) -> DataFrame:
        """Which of ``ids`` (accident_id, bucket) are in the index; other buckets' files are not read."""
        touched = [r["bucket"] for r in ids.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        index = self._read("ids").where(F.col("bucket").isin(touched))
        return index.select("accident_id").join(ids, "accident_id", "left_semi")

    def append(self, rows: DataFrame) -> int:
        """Add a batch; returns its number.

        Rows that break a rule go to the quarantine. Of the rows of one id the newest is kept and the others go there as
        duplicates, unless the id is in an earlier batch: then all of them go there as known.
        ``copies`` is the number of rows that a row of the quarantine stands for.
        """
        batch, run = len(self.commits()) + 1, f"r{uuid.uuid4().hex}"
        checked = written(with_reasons(incident_defaults(rows)), "checked")
        contents = marked_contents(parsed(checked).where(F.size("reasons") == 0).drop("reasons"))
        kept = contents.where("is_kept")
        ids = written(kept.select("accident_id", self._bucket(F.col("accident_id")).alias("bucket")), "batch-ids")
        known = written(self._known(ids), "known-ids")
        new_ids = ids.join(known, "accident_id", "left_anti")
        seen = known.withColumn("_seen", F.lit(True))
        told = written(contents.join(seen, "accident_id", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False))), "told")
        fresh = told.where("is_kept AND NOT _seen")
        one = F.lit(1).cast("long").alias("copies")
        left = F.when(F.col("_seen"), F.col("copies")).otherwise(F.col("copies") - F.col("is_kept").cast("long"))
        why = F.when(F.col("_seen"), KNOWN).otherwise(DUPLICATE)
        repeated = (
            told.withColumns({"copies": left, "reasons": F.array(why)}).where(F.col("copies") > 0).drop("is_kept", "_seen")
        )
        number = F.lit(batch).cast("long").alias("batch")
        fact = stamped(with_cell(fresh.select(*INCIDENT_COLUMNS))).select("*", number)
        write_incident_table(fact, f"{self.folder}/fact/run={run}")
        out = checked.where(F.size("reasons") > 0).select("*", one).unionByName(repeated, allowMissingColumns=True)
        if UNPARSED not in out.columns:
            out = out.withColumn(UNPARSED, F.lit(None).cast("string"))
        out.select(*INCIDENT_COLUMNS, UNPARSED, "reasons", "copies", number).write.parquet(f"{self.folder}/quarantine/run={run}")
        index = new_ids.repartition("bucket").sortWithinPartitions("bucket", "accident_id")
        index.write.partitionBy("bucket").parquet(f"{self.folder}/ids/run={run}")
        self._commit(batch, run)
        return batch

    def _commit(self, batch: int, run: str) -> None:
        """Publish a run as a batch; refused where another run has that number."""
        row = self.spark.createDataFrame([(batch, run)], COMMITS).coalesce(1)
        row.write.mode("errorifexists").parquet(f"{self.folder}/commits/batch-{batch}")

    def append_csv(self, *paths: str) -> int:
        """Add CSV files, lines that do not parse included (in the quarantine)."""
        return self.append(checked_csv(self.spark.read).csv(list(paths)))
