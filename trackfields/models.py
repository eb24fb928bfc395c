"""Fitted models: Platt scaling and a class-balanced logistic baseline, on pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def platt(df: DataFrame, logit: str = "z", label: str = "y") -> tuple[float, float]:
    """(slope, intercept) of the likeliest logistic curve over logits."""
    rows = VectorAssembler(inputCols=[logit], outputCol="features").transform(df.where(F.col(logit).isNotNull() & F.col(label).isNotNull()).select(logit, F.col(label).cast("double").alias("label")))
    m = LogisticRegression(regParam=0.0, standardization=False, tol=1e-10, maxIter=200).fit(rows)
    return float(m.coefficients[0]), float(m.intercept)


def calibrated(df: DataFrame, slope: float, intercept: float, logit: str = "z") -> DataFrame:
    return df.withColumn("calibrated", 1 / (1 + F.exp(-(slope * F.col(logit) + intercept))))


def balanced_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """``df`` with ``weight``, such that both classes weigh half of the rows."""
    one = df.agg(F.count("*").alias("_n"), F.sum(label).alias("_p"))  # one row
    weight = F.col("_n") / (2 * F.when(F.col(label) == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p")))
    return df.crossJoin(F.broadcast(one)).withColumn("weight", weight).drop("_n", "_p")


def baseline(train: DataFrame, features: list[str], label: str = "y", ridge: float = 1e-3):
    """A fitted pipeline: scaling on the training rows, then a class-balanced logistic regression."""
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), LogisticRegression(featuresCol="_scaled", labelCol=label, weightCol="weight", regParam=ridge, standardization=False, maxIter=100)]
    return Pipeline(stages=stages).fit(balanced_weights(train, label))


def scored(model, df: DataFrame) -> DataFrame:
    d = model.transform(df)
    return d.withColumn("score", vector_to_array("probability")[1]).drop("_raw", "_scaled", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, features: list[str], folds: list[int], label: str = "y") -> DataFrame:
    """Each fold's rows scored by a model of the others; scaling is inside the folds."""
    out = None
    for k in folds:
        part = scored(baseline(df.where(F.col("fold") != k), features, label), df.where(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out
