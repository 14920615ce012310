"""Model bundles: a ``pyspark.ml`` pipeline (imputing, scaling, logistic model), the vocabulary of its vectorizer and its metadata, in one folder."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlark.operators import scoring
from spanlark.sources import readers

PARTS = ("pipeline", "metadata")
FILLED, PROBABILITY = "filled", "probability"


@dataclass
class Bundle:
    """A fitted pipeline over ``features``, which the rows hold as doubles; it adds ``probability``, a vector or the score itself."""

    pipeline: PipelineModel
    features: list[str]
    metadata: dict = field(default_factory=dict)
    vocabulary: DataFrame | None = None  # (term, idf)

    def score(self, df: DataFrame, most_missing: float = 0.05, name: str = "score") -> DataFrame:
        """Adds the probability and the class at 0.5. Features that the rows lack are 0, more than ``most_missing`` of them an error."""
        missing = scoring.check_features(self, df.columns, most_missing)
        rows = df.withColumns({f: F.lit(0.0) for f in missing} | {f: F.col(f).cast("double") for f in self.features if f not in missing})
        out = self.pipeline.transform(rows)
        given = F.col(PROBABILITY) if dict(out.dtypes)[PROBABILITY] == "double" else vector_to_array(PROBABILITY)[1]
        return out.withColumn(name, given).withColumn("prediction", (F.col(name) >= 0.5).cast("int")).select(*df.columns, name, "prediction")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spec = self.metadata | {"feature_list": self.features, "vectorizer": self.vocabulary is not None}
        spark.range(0, 1, 1, 1).select(F.lit(json.dumps(spec, sort_keys=True)).alias("value")).write.mode("overwrite").text(f"{path}/metadata")
        if self.vocabulary is not None:
            self.vocabulary.select("term", F.col("idf").cast("double").alias("idf")).write.mode("overwrite").parquet(f"{path}/vocabulary")


def load(spark: SparkSession, path: str, *, require_vectorizer: bool = False) -> Bundle:
    """The bundle in a folder; what it lacks is an error before anything runs."""
    if not readers.exists(spark, path):
        raise FileNotFoundError(f"there is no model at {path}")
    if missing := [p for p in PARTS if not readers.exists(spark, f"{path}/{p}")]:
        raise FileNotFoundError(f"the bundle at {path} lacks {', '.join(missing)}")
    spec = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    features = spec.pop("feature_list", None)
    if not isinstance(features, list) or not features or not all(isinstance(f, str) for f in features):
        raise ValueError(f"the bundle at {path} has no list of features")
    words = spark.read.parquet(f"{path}/vocabulary") if readers.exists(spark, f"{path}/vocabulary") else None
    if words is None and (require_vectorizer or spec.get("vectorizer")):
        raise FileNotFoundError(f"the bundle at {path} lacks the vocabulary of its vectorizer")
    return Bundle(PipelineModel.load(f"{path}/pipeline"), features, spec, words)


def _zeros(features: list[str]) -> SQLTransformer:
    """Nulls and values that are no number as 0."""
    filled = ", ".join(f"nanvl(coalesce(`{f}`, 0D), 0D) AS `{FILLED}_{f}`" for f in features)
    return SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")


def of_linear(model: scoring.LinearModel, vocabulary: DataFrame | None = None) -> Bundle:
    """A fixed linear model as a pipeline of the same kind."""
    terms = " + ".join(f"(`{FILLED}_{f}` - {m!r}D) / {s or 1.0!r}D * {c!r}D" for f, c, m, s in zip(model.features, model.coefficients, model.means, model.scales, strict=True))
    logistic = SQLTransformer(statement=f"SELECT *, 1 / (1 + exp(-({model.intercept!r}D + {terms}))) AS {PROBABILITY} FROM __THIS__")
    return Bundle(PipelineModel([_zeros(model.features), logistic]), model.features, dict(model.metadata), vocabulary)


def fit(df: DataFrame, features: list[str], label: str, *, impute: str = "zero", vocabulary: DataFrame | None = None, metadata: dict | None = None, **settings) -> Bundle:
    """Train a balanced logistic model. ``impute``: zero, mean or median; ``settings``: those of Spark's ``LogisticRegression``."""
    if impute not in ("zero", "mean", "median"):
        raise ValueError(f"no imputing by {impute!r}; there are zero, mean, median")
    filled = [f"{FILLED}_{f}" for f in features]
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label"))
    rate = rows.agg(F.avg("label")).first()[0] or 0.0
    rate = min(max(rate, 1e-9), 1 - 1e-9)
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, 0.5 / rate).otherwise(0.5 / (1 - rate)))
    first = _zeros(features) if impute == "zero" else Imputer(strategy=impute, inputCols=features, outputCols=filled)
    stages = [
        first, VectorAssembler(inputCols=filled, outputCol="assembled"), StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True),
        LogisticRegression(featuresCol="scaled", weightCol="weight", probabilityCol=PROBABILITY, predictionCol="class", standardization=False, **({"regParam": 1e-3} | settings)),
    ]
    return Bundle(Pipeline(stages=stages).fit(rows), features, metadata or {}, vocabulary)
