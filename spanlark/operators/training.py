"""Training data from results: labelled instances with their prompts, split, counted and written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlark.functions import text as T
from spanlark.operators import relational
from spanlark.sources import readers
from spanlark.sources.tables import written

#: What an instance keeps of its result.
METADATA = ("dataset", "attack_name", "agent_name", "defense_decision", "tests_passed", "adv_prompt_hash")
RESULT = "instance_id string, attack_artifact_path string, dataset string, attack_name string, agent_name string, defense_decision string, tests_passed boolean, adv_prompt_hash string"


def row_split(df: DataFrame, key: str, ratio: float, seed: int = 42, order: list[str] | None = None) -> DataFrame:
    """Train or test for single rows, exactly ``floor(ratio * n)`` of them train: first by a seeded hash of the key and of the row's number
    among the rows of its key (in ``order``)."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*(order or [key])))
    rows = df.withColumn("_row", F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("#"), number.cast("string")))
    rows = written(rows)  # ties in the order are settled once
    placed = relational.places(rows, "_row", seed, []).withColumn("split", F.when(F.col("place") <= F.floor(F.col("n") * F.lit(ratio)), "train").otherwise("test"))
    return rows.join(placed.select("_row", "split"), "_row").drop("_row")


STRATEGIES = {
    "instance_based": lambda df, ratio, seed: relational.group_split(df, "instance_id", ratio, seed),
    "stratified_instance": lambda df, ratio, seed: relational.stratified_split(df, "instance_id", "label", ratio, seed),
    "random": lambda df, ratio, seed: row_split(df, "instance_id", ratio, seed, ["label", "prompt"]),
}


def check(strategy: str, ratio: float, limit: int | None) -> None:
    """What would fail is an error before anything is read."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no split {strategy!r}; there are {', '.join(sorted(STRATEGIES))}")
    if not 0 < ratio < 1:
        raise ValueError(f"the share of training rows has to lie between 0 and 1, not at {ratio}")
    if limit is not None and limit < 1:
        raise ValueError("a limit per class has to be at least 1")


def prepare(benign: DataFrame, malicious: DataFrame, prompts: DataFrame, *, strategy: str = "stratified_instance", ratio: float = 0.8, seed: int = 42, limit: int | None = None, order: str = "pos") -> DataFrame:
    """instance_id, label (1: malicious), prompt, metadata and split of each result whose prompt is not blank.

    prompts: (attack_artifact_path, prompt). limit: rows of each class, the first by ``order``, counted before prompts are looked at."""
    check(strategy, ratio, limit)
    columns = ["instance_id", "attack_artifact_path", *METADATA, *([order] if limit is not None else [])]
    some = lambda df, y: (relational.head(df.select(*columns), [order], limit) if limit is not None else df.select(*columns)).withColumn("label", F.lit(y))
    rows = some(benign, 0).unionByName(some(malicious, 1)).join(prompts.select("attack_artifact_path", T.strip(F.col("prompt")).alias("prompt")), "attack_artifact_path", "left")
    filled = {c: F.coalesce(F.col(c), F.lit(False) if c == "tests_passed" else F.lit("")).alias(c) for c in METADATA}
    rows = rows.where(F.coalesce(F.col("prompt"), F.lit("")) != "").select(F.coalesce("instance_id", F.lit("unknown")).alias("instance_id"), "label", "prompt", F.struct(*filled.values()).alias("metadata"))
    return STRATEGIES[strategy](rows, ratio, seed)


def statistics(prepared: DataFrame) -> DataFrame:
    """One row: instances in all and in each split, and those of each class in each split."""
    n = lambda split, y: F.count_if((F.col("split") == split) & (F.col("label") == y)).alias(f"{split}_{y}")
    counts = prepared.agg(F.count("*").alias("total_instances"), *[n(s, y) for s in ("train", "test") for y in (0, 1)])
    return counts.withColumns({f"{s}_instances": F.col(f"{s}_0") + F.col(f"{s}_1") for s in ("train", "test")})


def write(prepared: DataFrame, path: str, settings: dict | None = None) -> dict:
    """JSON lines in a folder for each split, and metadata beside them; returns the metadata."""
    prepared = written(prepared)
    prepared.write.mode("overwrite").partitionBy("split").json(f"{path}/instances")
    row = statistics(prepared).first().asDict()
    meta = dict(settings or {}) | {k: v for k, v in row.items() if k.endswith("instances")} | {f"{s}_label_distribution": {str(y): row[f"{s}_{y}"] for y in (0, 1)} for s in ("train", "test")}
    prepared.sparkSession.range(0, 1, 1, 1).select(F.lit(json.dumps(meta, sort_keys=True)).alias("value")).write.mode("overwrite").text(f"{path}/metadata")
    return meta


def prepare_from_files(spark: SparkSession, benign: str, malicious: str, artifacts: str, target: str, **settings) -> dict:
    """Both result logs (JSON lines) and the folder of artifacts to training data; a log that is not there is an error."""
    check(settings.get("strategy", "stratified_instance"), settings.get("ratio", 0.8), settings.get("limit"))
    for path in (benign, malicious):
        if not readers.exists(spark, path):
            raise FileNotFoundError(f"there are no results at {path}")
    logs = [readers.json_lines(spark, path, RESULT)[0] for path in (benign, malicious)]
    prompts = readers.artifact_texts(spark, artifacts).select(F.col("instance").alias("attack_artifact_path"), F.col("text").alias("prompt"))
    named = [log.withColumn("attack_artifact_path", F.element_at(F.split("attack_artifact_path", "/"), -1)) for log in logs]
    return write(prepare(*named, prompts, **settings), target, {"benign_results_path": benign, "malicious_results_path": malicious} | settings)


def mean_loss(df: DataFrame, truth: str, score: str, by: list[str] | None = None, least: float = 1e-7) -> DataFrame:
    """Mean cross-entropy of the probability of class 1, kept ``least`` away from 0 and 1, and the number of rows."""
    p = F.least(F.greatest(F.col(score), F.lit(least)), F.lit(1 - least))
    loss = -F.when(F.col(truth) == 1, F.log(p)).otherwise(F.log(1 - p))
    return (df.groupBy(*by) if by else df).agg(F.avg(loss).alias("mean_loss"), F.count("*").alias("n"))
