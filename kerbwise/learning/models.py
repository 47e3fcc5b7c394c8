"""Severity, hotspot and casualty models on Spark MLlib, with their encoders and scalers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbwise import fixed
from kerbwise.learning.encoding import encode, fit_encoders, fit_scaler, scale, stratified_split
from kerbwise.learning.evaluation import classification_report, regression_metrics
from kerbwise.learning.search import search_forests
from kerbwise.session import shared_folder, written

SEED = fixed.SAMPLE_SEED

CLASS_NAMES = {code - 1: name for code, name in fixed.SEVERITY_LABELS.items()}


def together(spark: SparkSession, jobs: list[Callable[[], Any]], most: int | None = None) -> list:
    """Results of a few jobs that run at the same time (``most`` of them at once), in their order."""
    with ThreadPool(min(len(jobs), most or len(jobs))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs, chunksize=1)


@dataclass
class FittedModel:
    """A fitted model with all it needs to score raw feature rows."""

    name: str
    numeric: list[str]
    categories: list[str]
    encoders: DataFrame
    scaler: dict[str, tuple[float, float]]
    stages: list[Transformer]
    metrics: dict[str, float] = field(default_factory=dict)
    settings: dict[str, float] = field(default_factory=dict)  # what a reader of the scores must know

    @property
    def features(self) -> list[str]:
        return self.numeric + [f"{c}_encoded" for c in self.categories]

    def matrix(self, rows: DataFrame) -> DataFrame:
        """Rows with codes and the scaled feature vector."""
        coded = scale(encode(rows, self.encoders, self.categories), self.scaler)
        return _assembled(coded, self.features)

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.apply(self.matrix(rows))

    def apply(self, matrix: DataFrame) -> DataFrame:
        if len(self.stages) == 1:
            return self.stages[0].transform(matrix)
        return _one_against_rest(matrix, self.stages)

    def importance(self) -> DataFrame:
        """Feature importances, largest first; averaged over one-against-rest members."""
        spark = self.encoders.sparkSession
        vectors = [stage.featureImportances.toArray() for stage in self.stages]
        mean = sum(vectors) / len(vectors)
        rows = [(name, float(weight)) for name, weight in zip(self.features, mean)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), "feature"
        )

    def top_features(self, k: int = 5) -> DataFrame:
        """The ``k`` most important features with their position, equal ones by name."""
        order = Window.orderBy(F.desc("importance"), "feature")  # one row per feature
        return self.importance().withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)

    def save(self, path: str) -> None:
        """Write the model, its encoders and its scaler under one folder."""
        spark = self.encoders.sparkSession
        PipelineModel(self.stages).write().overwrite().save(f"{path}/model")
        self.encoders.write.mode("overwrite").parquet(f"{path}/encoders")
        scaler = [(c, m, s) for c, (m, s) in self.scaler.items()]
        (
            spark.createDataFrame(scaler, "feature string, mean double, deviation double")
            .write.mode("overwrite")
            .parquet(f"{path}/scaler")
        )
        about = [(self.name, self.numeric, self.categories, self.metrics, self.settings)]
        (
            spark.createDataFrame(
                about,
                "name string, numeric array<string>, categories array<string>, metrics map<string,double>, "
                "settings map<string,double>",
            )
            .write.mode("overwrite")
            .parquet(f"{path}/about")
        )

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedModel:
        about = spark.read.parquet(f"{path}/about").first()
        scaler = {
            r["feature"]: (r["mean"], r["deviation"])
            for r in spark.read.parquet(f"{path}/scaler").collect()  # one row per feature
        }
        return FittedModel(
            about["name"], list(about["numeric"]), list(about["categories"]),
            spark.read.parquet(f"{path}/encoders"), scaler,
            PipelineModel.load(f"{path}/model").stages, dict(about["metrics"]), dict(about["settings"]),
        )


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    names = [f"{c}_z" for c in features]
    return VectorAssembler(inputCols=names, outputCol="features").transform(df).drop(*names)


def _one_against_rest(matrix: DataFrame, stages: list[Transformer]) -> DataFrame:
    """Class scores of binary models, normalised to sum to 1."""
    out = matrix
    for k, stage in enumerate(stages):
        out = (
            stage.transform(out)
            .withColumn(f"_score_{k}", F.get(vector_to_array("probability"), F.lit(1)))
            .drop("rawPrediction", "probability", "prediction")
        )
    scores = [F.col(f"_score_{k}") for k in range(len(stages))]
    total = sum(scores[1:], scores[0])
    shares = F.array(*[F.coalesce(F.try_divide(s, total), F.lit(1.0 / len(stages))) for s in scores])
    best = F.array_position(shares, F.array_max(shares)) - 1
    return out.withColumns(
        {"probability": array_to_vector(shares), "prediction": best.cast("double")}
    ).drop(*[f"_score_{k}" for k in range(len(stages))])


def prepare(
    rows: DataFrame, name: str, numeric: list[str], categories: list[str], label: Column,
    key: str, stratified: bool = True,
) -> tuple[FittedModel, DataFrame]:
    """Fit encoders and scaler; return them with the written training matrix.

    The selected columns are written before anything is fitted and the matrix
    (id, label, features, is_train) after, so the joins behind the features run
    once, not for every statistic, tree, fold and metric.
    """
    base = written(
        rows.select(
            key, label.cast("double").alias("label"),
            *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric],
            *categories,
        ),
        f"{name}-rows",
    )
    encoders = written(fit_encoders(base, categories), f"{name}-encoders")
    model = FittedModel(name, numeric, categories, encoders, {}, [])
    stratum = F.col("label") if stratified else F.lit(0.0)
    split = stratified_split(base.withColumn("_split_by", stratum), key, "_split_by")
    coded = encode(split, encoders, categories)
    model.scaler = fit_scaler(coded, model.features)
    matrix = _assembled(scale(coded, model.scaler), model.features).select(
        key, "label", "features", "is_train"
    )
    return model, written(matrix, f"{name}-matrix")


#: Least partitions of the training rows, and most rows that a partition gets on average. Trees draw their samples by
#: partition, so the number follows from the rows alone: the same rows give the same model on any cluster.
TRAIN_PARTITIONS = 8
PARTITION_ROWS = 200_000


def train_partitions(rows: int) -> int:
    return max(TRAIN_PARTITIONS, math.ceil(rows / PARTITION_ROWS))


def fits_at_once(spark: SparkSession, rows: int, most: int) -> int:
    """Fits of ``rows`` training rows that run at the same time: ``most`` while the rows are few, else as many as the cores take.

    Each fit keeps all rows in memory in a form of its own. Where the partitions of one keep every core busy, a second one
    beside it saves no time, and both together may not fit.
    """
    tasks = train_partitions(rows)
    if tasks <= TRAIN_PARTITIONS:
        return most
    return max(1, min(most, spark.sparkContext.defaultParallelism // tasks))


def _train(matrix: DataFrame) -> DataFrame:
    """Training rows in one layout: dealt by the hash of their id and ordered by it.

    Boosting cuts the lineage of its rounds by checkpoints, which need a folder.
    """
    key = matrix.columns[0]
    context = matrix.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(matrix.sparkSession))
    rows = matrix.where("is_train")
    return rows.repartition(train_partitions(rows.count()), key).sortWithinPartitions(key)


def _test(matrix: DataFrame) -> DataFrame:
    return matrix.where(~F.col("is_train"))


def _score(model: FittedModel, matrix: DataFrame) -> None:
    right = F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("right")
    shares = {r["is_train"]: r["right"] for r in model.apply(matrix).groupBy("is_train").agg(right).collect()}
    model.metrics["train_accuracy"] = shares.get(True, 0.0)
    model.metrics["test_accuracy"] = shares.get(False, 0.0)


def severity_matrix(features: DataFrame) -> tuple[FittedModel, DataFrame]:
    return prepare(
        features, "severity_prediction", fixed.SEVERITY_NUMERIC, fixed.SEVERITY_CATEGORIES,
        F.col("severity") - 1, "accident_id",
    )


def train_severity_model(
    features: DataFrame, kind: str = "forest", **params: float
) -> tuple[FittedModel, DataFrame]:
    """Three-class severity model (class = severity - 1) and its matrix.

    ``forest`` is a random forest; ``boosted`` is one boosted-tree model per
    class with normalised scores, since MLlib boosting is binary. The classes are
    fitted at the same time while rows are few: a round of one leaves cores idle between its small jobs.
    The layout of the rows is kept on disk for all classes, where it takes no memory from the fits.
    """
    model, matrix = severity_matrix(features)
    train = _train(matrix)
    if kind == "forest":
        settings = {"numTrees": 100, "maxDepth": 7, "seed": SEED, **params}
        model.stages = [RandomForestClassifier(**settings).fit(train)]
    elif kind == "boosted":
        settings = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "seed": SEED, **params}

        def boosted(k: int) -> Transformer:
            return GBTClassifier(**settings).fit(train.withColumn("label", F.when(F.col("label") == k, 1.0).otherwise(0.0)))

        spark, train = matrix.sparkSession, train.persist(StorageLevel.DISK_ONLY)
        try:
            most = fits_at_once(spark, train.count(), len(CLASS_NAMES))
            model.stages = together(spark, [partial(boosted, k) for k in CLASS_NAMES], most)
        finally:
            train.unpersist()
    else:
        raise ValueError("kind must be forest or boosted")
    _score(model, matrix)
    return model, matrix


def severity_report(model: FittedModel, matrix: DataFrame) -> DataFrame:
    return classification_report(model.apply(_test(matrix)), CLASS_NAMES)


def severity_grid(estimator: RandomForestClassifier) -> list[dict]:
    """24 settings: trees, depth, share of features and share of rows per tree."""
    return (
        ParamGridBuilder()
        .addGrid(estimator.numTrees, [100, 200])
        .addGrid(estimator.maxDepth, [3, 5, 7])
        .addGrid(estimator.featureSubsetStrategy, ["sqrt", "onethird"])
        .addGrid(estimator.subsamplingRate, [0.8, 1.0])
        .build()
    )


def tune_severity_model(
    features: DataFrame, grid: list[dict] | None = None, estimator: RandomForestClassifier | None = None,
    folds: int = 3, parallelism: int = 4,
) -> tuple[FittedModel, DataFrame, DataFrame]:
    """Severity model with the best settings of a grid: (model, matrix, search results).

    At most ``parallelism`` forests grow at the same time, fewer where the rows are many.
    """
    model, matrix = severity_matrix(features)
    forest = estimator or RandomForestClassifier(seed=SEED)
    at_once = fits_at_once(matrix.sparkSession, matrix.where("is_train").count(), parallelism)
    best, results = search_forests(_train(matrix), forest, grid or severity_grid(forest), folds, at_once)
    model.stages = [best]
    _score(model, matrix)
    return model, matrix, results


def train_hotspot_model(
    profiles: DataFrame, include_density: bool = False, **params: float
) -> tuple[FittedModel, DataFrame]:
    """Hotspot model on cell profiles.

    The density score is the label's own count divided by a constant, so it is
    left out unless ``include_density`` asks for it. ``settings`` keeps the least
    number of incidents of a cell that counted as a hotspot.
    """
    numeric = fixed.HOTSPOT_NUMERIC + ([fixed.HOTSPOT_LEAKING] if include_density else [])
    model, matrix = prepare(
        profiles, "hotspot_prediction", numeric, fixed.HOTSPOT_CATEGORIES, F.col("is_hotspot"), "cell"
    )
    settings = {"maxIter": 200, "stepSize": 0.1, "seed": SEED, **params}
    model.stages = [GBTClassifier(**settings).fit(_train(matrix))]
    _score(model, matrix)
    least = profiles.where("is_hotspot = 1").agg(F.min("accident_count")).first()[0]
    if least is not None:
        model.settings["hotspot_incidents"] = float(least)
    return model, matrix


def train_casualty_model(features: DataFrame, **params: float) -> tuple[FittedModel, DataFrame]:
    """Casualty regressor; the split is not stratified."""
    model, matrix = prepare(
        features, "casualty_prediction", fixed.CASUALTY_NUMERIC, fixed.CASUALTY_CATEGORIES,
        F.col("casualties"), "accident_id", stratified=False,
    )
    settings = {"numTrees": 100, "maxDepth": 10, "seed": SEED, **params}
    model.stages = [RandomForestRegressor(**settings).fit(_train(matrix))]
    row = regression_metrics(model.apply(_test(matrix))).first()
    model.metrics.update(mse=row["mse"] or 0.0, r2=row["r2"] or 0.0)
    return model, matrix
