"""Result tables: replaced as a whole by each run, read back with their fixed schema.

A run writes its rows into a folder of its own and then adds one small row that names the folder. Readers follow
the newest such row, so during a refresh they see the old table or the new one, and a table that they have loaded stays
there until :meth:`ResultStore.retire` removes runs that were replaced longer ago than its grace period.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from kerbwise.functions.geo import point_wkt
from kerbwise.schema import RESULT_TABLES


def flatten_points(df: DataFrame) -> DataFrame:
    """Turn a ``cluster_center`` point into ``cluster_center_wkt`` text."""
    if "cluster_center" not in df.columns:
        return df
    centre = F.col("cluster_center")
    return df.withColumn(
        "cluster_center_wkt", F.when(centre.isNotNull(), point_wkt(centre["lon"], centre["lat"]))
    ).drop("cluster_center")


PUBLISHED = "run string, at timestamp"


def stored(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A stored table, or an empty one if nothing has been stored."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class ResultStore:
    """Parquet result tables under one folder."""

    spark: SparkSession
    folder: str

    def _runs(self, name: str) -> list:
        """Published runs of a table, the newest first: one small row for each time it was replaced."""
        rows = stored(self.spark, f"{self.folder}/{name}/published", PUBLISHED).collect()
        return sorted(rows, key=lambda r: (r["at"], r["run"]), reverse=True)

    def save(self, df: DataFrame, name: str) -> None:
        run = uuid.uuid4().hex
        flatten_points(df).write.parquet(f"{self.folder}/{name}/run={run}")
        row = self.spark.range(1).coalesce(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("at"))
        row.write.mode("append").parquet(f"{self.folder}/{name}/published")

    def load(self, name: str) -> DataFrame:
        """The newest published table, or an empty one with the same columns if there is none."""
        schema = RESULT_TABLES.get(name)
        runs = self._runs(name)
        if not runs and schema is None:
            raise ValueError(f"no table {name} below {self.folder}")
        if not runs:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.folder}/{name}/run={runs[0]['run']}")

    def load_all(self) -> dict[str, DataFrame]:
        return {name: self.load(name) for name in RESULT_TABLES}

    def retire(self, name: str, grace: dt.timedelta) -> int:
        """Remove the runs of a table that another replaced more than ``grace`` ago; returns how many.

        Readers that loaded such a run before then must have ended.
        """
        runs = self._runs(name)
        now = self.spark.range(1).select(F.current_timestamp()).first()[0]
        old = [runs[i]["run"] for i in range(1, len(runs)) if now - runs[i - 1]["at"] > grace]
        return removed(self.spark, [f"{self.folder}/{name}/run={run}" for run in old])


def _system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def removed(spark: SparkSession, names: list[str]) -> int:
    """Remove folders of the file systems their paths name; returns how many were there."""
    found = 0
    for name in names:
        system, path = _system(spark, name)
        found += system.delete(path, True)
    return found


def folders(spark: SparkSession, folder: str, column: str) -> list[int]:
    """Numbers of the partition folders ``column=number`` in a folder, in order; none where it does not exist."""
    system, path = _system(spark, folder)
    names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{column}="))


def save_jdbc(df: DataFrame, url: str, table: str, connections: int = 8, **properties: str) -> None:
    """Replace a database table over a few parallel connections; nothing passes the driver.

    The result is repartitioned, not coalesced, so the work before it keeps its
    parallelism.
    """
    (
        flatten_points(df)
        .repartition(connections)
        .write.mode("overwrite")
        .options(batchsize="10000", **properties)
        .jdbc(url, table)
    )


def load_jdbc(spark: SparkSession, url: str, query: str, **properties: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **properties).load()
