"""Feature lookup, a classifier on features, and the schema registry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCHEMA_REGISTRY
from .lww import lookup


class UnknownSchema(ValueError):
    """A request names a schema version that is not registered."""


def register_schema(registry: DataFrame, version: str, features: list[str]) -> DataFrame:
    """The registry with a version added or replaced."""
    new = registry.sparkSession.createDataFrame([(version, features)], SCHEMA_REGISTRY)
    return registry.filter(F.col("version") != version).unionByName(new)


def get_schema(registry: DataFrame, version: str) -> list[str]:
    found = registry.filter(F.col("version") == version).select("features").first()
    if found is None:
        raise UnknownSchema(version)
    return list(found[0])


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA_REGISTRY)


def feature_value(features: Column) -> Column:
    """A record's value for an array of features: the JSON array, in UTF-8. Null gives null."""
    return F.to_json(features.cast("array<double>")).cast("binary")


def features_of(value: Column) -> Column:
    """The features in a record's value; null where it is no JSON array."""
    return F.from_json(value.cast("string"), "array<double>")


def feature_lookup(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Each requested key with its features, the JSON array in the current value; null where there is none."""
    return lookup(log, requests).withColumn("features", features_of(F.col("value")))


def train(rows: DataFrame, features: str = "features", label: str = "label") -> LogisticRegressionModel:
    data = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"))
    return LogisticRegression(featuresCol="x", labelCol="y", maxIter=50, regParam=0.01).fit(data)


def predict(model: LogisticRegressionModel, rows: DataFrame, features: str = "features") -> DataFrame:
    """``rows`` plus prediction and the probability of the predicted class; null where features are missing."""
    have = rows.filter(F.col(features).isNotNull()).withColumn("x", array_to_vector(F.col(features).cast("array<double>")))
    scored = model.transform(have)
    scored = scored.select(*rows.columns, F.col("prediction").cast("int").alias("prediction"), F.array_max(vector_to_array("probability")).alias("probability"))
    none = rows.filter(F.col(features).isNull()).withColumn("prediction", F.lit(None).cast("int")).withColumn("probability", F.lit(None).cast("double"))
    return scored.unionByName(none)


def accuracy(predicted: DataFrame, label: str = "label") -> DataFrame:
    return predicted.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))


def predict_versioned(model: LogisticRegressionModel, requests: DataFrame, log: DataFrame, registry: DataFrame, version: str) -> DataFrame:
    """Requested keys with status 200 and a prediction, or 404 where no features are kept; an unknown version raises."""
    get_schema(registry, version)
    scored = predict(model, feature_lookup(requests, log).select("key", "features"))
    return scored.withColumn("status", F.when(F.col("features").isNull(), 404).otherwise(200))


def mlp_forward(rows: DataFrame, weights: list[tuple[list[list[float]], list[float]]], features: str = "features") -> DataFrame:
    """``rows`` plus score: dense layers with ReLU between and a sigmoid at the end, a batch at a time."""
    layers = [(np.asarray(w, float), np.asarray(b, float)) for w, b in weights]

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        h = np.array(x.tolist(), float).reshape(len(x), -1)
        for i, (w, b) in enumerate(layers):
            h = h @ w + b
            if i < len(layers) - 1:
                h = np.maximum(h, 0)
        return pd.Series(1 / (1 + np.exp(-h[:, 0])), index=x.index)

    return rows.withColumn("score", score(F.col(features).cast("array<double>")))


def save_registry(registry: DataFrame, path: str) -> None:
    registry.write.mode("overwrite").json(path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA_REGISTRY).json(path)
