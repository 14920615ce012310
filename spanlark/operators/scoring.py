"""A fixed linear model over feature columns: impute, standardise, logistic; and the checks before it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearModel:
    features: list[str]
    coefficients: list[float]
    means: list[float]
    scales: list[float]  # population standard deviations
    intercept: float = 0.0
    metadata: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.features or len({len(self.features), len(self.coefficients), len(self.means), len(self.scales)}) != 1:
            raise ValueError("a model needs a name, coefficient, mean and scale for each feature")

    @classmethod
    def load(cls, path: str) -> LinearModel:
        spec = json.loads(Path(path).read_text())
        if missing := {"features", "coefficients", "means", "scales"} - spec.keys():
            raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
        return cls(**spec)

    def score(self, df: DataFrame, most_missing: float = 0.05, name: str = "score") -> DataFrame:
        return score(df, self, most_missing, name)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.__dict__, sort_keys=True))


def check_features(model: LinearModel, columns: list[str], most: float = 0.05) -> list[str]:
    """Features that the columns lack; more than ``most`` of the model's is an error, before anything runs."""
    missing = [f for f in model.features if f not in columns]
    if len(missing) > most * len(model.features):
        raise ValueError(f"{len(missing)} of {len(model.features)} features are missing ({', '.join(missing[:5])} ...): the rows are of another mode than the model")
    return missing


def score(df: DataFrame, model: LinearModel, most_missing: float = 0.05, name: str = "score") -> DataFrame:
    """Adds the probability and the class at 0.5; nulls and missing columns count as 0 before scaling."""
    missing = set(check_features(model, df.columns, most_missing))
    logit = F.lit(model.intercept)
    for f, c, m, s in zip(model.features, model.coefficients, model.means, model.scales, strict=True):
        value = F.lit(0.0) if f in missing else F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        logit = logit + (value - m) / (s or 1.0) * c
    return df.withColumn(name, 1 / (1 + F.exp(-logit))).withColumn("prediction", (F.col(name) >= 0.5).cast("int"))


def fit(df: DataFrame, features: list[str], label: str, **settings) -> LinearModel:
    """Train a balanced logistic model with Spark's own solver, on standardised features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    filled = df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.col(label).cast("double").alias("label"))
    stats = filled.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features], F.avg("label").alias("rate")).first()
    means, scales, rate = [stats[f"m_{f}"] for f in features], [stats[f"s_{f}"] or 1.0 for f in features], min(max(stats["rate"], 1e-9), 1 - 1e-9)
    scaled = filled.select(*[((F.col(f) - m) / s).alias(f) for f, m, s in zip(features, means, scales, strict=True)], "label", F.when(F.col("label") == 1, 0.5 / rate).otherwise(0.5 / (1 - rate)).alias("weight"))
    trained = LogisticRegression(weightCol="weight", standardization=False, **({"regParam": 1e-3} | settings)).fit(VectorAssembler(inputCols=features, outputCol="features").transform(scaled))
    return LinearModel(features, [float(c) for c in trained.coefficients], means, scales, float(trained.intercept))
