"""Model metrics as aggregates over (label, prediction) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count("*").alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def classification_report(
    df: DataFrame, names: dict[int, str], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support of each class, their averages, and accuracy.

    A ratio with nothing below the line is 0. In the accuracy row every score is
    the accuracy.
    """
    sides = F.array(
        F.struct(
            F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).alias("predicted"),
            F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits"),
        ),
        F.struct(
            F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
            F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits"),
        ),
    )
    scored = (
        confusion(df, label, prediction)
        .select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
        .withColumns(
            {
                "precision": _ratio(F.col("hits"), F.col("predicted")),
                "recall": _ratio(F.col("hits"), F.col("support")),
                "f1": _ratio(2.0 * F.col("hits"), F.col("predicted") + F.col("support")),
            }
        )
    )
    metrics = ("precision", "recall", "f1")
    title = F.col("class").cast("string")
    for code, name in names.items():
        title = F.when(F.col("class") == code, name).otherwise(title)
    per_class = scored.select(title.alias("class"), *metrics, "support")
    accuracy = _ratio(F.sum("hits"), F.sum("support"))
    overall = scored.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"), *[accuracy.alias(m) for m in metrics],
                F.sum("support").alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in metrics],
                F.sum("support").alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("class"),
                *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in metrics],
                F.sum("support").alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    return per_class.unionByName(overall)


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    """Share of equal pairs; one number reaches the driver."""
    hit = F.when(F.col(label).cast("int") == F.col(prediction).cast("int"), 1.0).otherwise(0.0)
    return df.agg(F.avg(hit)).first()[0] or 0.0


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean squared error and R squared (0 for a constant label)."""
    error = F.col(label).cast("double") - F.col(prediction).cast("double")
    return df.agg(
        F.count("*").alias("n"),
        F.avg(error * error).alias("mse"),
        F.var_pop(F.col(label).cast("double")).alias("_variance"),
    ).select(
        "n", "mse", F.coalesce(1.0 - F.try_divide("mse", "_variance"), F.lit(0.0)).alias("r2")
    )
