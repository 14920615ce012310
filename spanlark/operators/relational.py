"""Joins, limits, picks, splits and summaries over instance and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlark.functions import text as T

#: Columns of the summary, in order.
SUMMARY = ["dataset", "split", "instance_id", "agent_name", "attack_name", "baseline_name", "fidelity_mode", "defense_decision", "tests_passed", "static_findings_count", "runtime_sec"]


def by_ids(df: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """Rows with one of the ids; all rows if none is given."""
    return df.where(F.col(key).isin(ids)) if ids else df


def resume(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is planned and not yet in the log."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def cache_lookup(calls: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Every call with its cached text, if there is one; of several the last."""
    latest = cache.groupBy(key).agg(F.max_by("text", "call_count").alias("cached_text"))
    return calls.join(latest, key, "left").withColumn("cache_hit", F.col("cached_text").isNotNull())


def call_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def matrix(spark: SparkSession, axes: dict[str, list[str]]) -> DataFrame:
    """All combinations of a few lists, numbered from 1 in the order of the lists, each with a run name."""
    out = spark.range(0, 1, 1, 1)
    for name, values in axes.items():  # literals, spread out one after the other in a single task
        out = out.select(*out.columns, F.posexplode(T.strings(values)).alias(f"_{name}", name))
    number = F.lit(0)
    for name, values in axes.items():
        number = number * len(values) + F.col(f"_{name}")
    return out.withColumn("index", (number + 1).cast("long")).withColumn("run_name", F.concat_ws("_", F.lpad(F.col("index").cast("string"), 3, "0"), *axes)).select("index", *axes, "run_name")


def pick_candidate(instances: DataFrame, candidates: DataFrame, key: str, order: str, seed: int, settings: str = "", patch: str | None = None) -> DataFrame:
    """One candidate for each instance that has any, by a hash of instance, seed, hash of the settings and their number. With the
    name of their ``patch`` column also ``pick_error``, which says where the one picked has none."""
    ranked = candidates.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    numbers = candidates.groupBy(key).agg(F.count("*").alias("candidate_count"))
    selection = T.canonical_json({"instance_id": F.col(key).cast("string"), "seed": F.lit(seed), "attack_config_hash": F.lit(settings), "candidate_count": F.col("candidate_count")})
    chosen = instances.join(numbers, key).withColumn("_place", T.hash_pick(selection, F.col("candidate_count")).cast("int"))
    picked = chosen.join(ranked, [key, "_place"]).withColumnRenamed("_place", "picked_index")
    return picked if patch is None else picked.withColumn("pick_error", F.when(F.coalesce(T.strip(F.col(patch)), F.lit("")) == "", "the candidate picked has an empty patch"))


def without_candidates(instances: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    return instances.join(candidates.select(key).distinct(), key, "left_anti")


def head(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(max(0, n))


def limit_per_class(df: DataFrame, label: str, order: list[str], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]))).where("_rank = 1").drop("_rank")


def turn_roles(df: DataFrame, conversation: str, turn: str) -> DataFrame:
    """First turn plans, last one finalises, those between criticise; a single turn plans."""
    by = Window.partitionBy(conversation)
    place, n = F.row_number().over(by.orderBy(turn)), F.count("*").over(by)
    return df.withColumn("turn_role", F.when(place == 1, "plan").when(place == n, "finalize").otherwise("critique"))


def numbered_names(df: DataFrame, scope: list[str], name: str, line: str) -> DataFrame:
    """Names that repeat in their scope get their line behind them, from the second on."""
    place = F.row_number().over(Window.partitionBy(*scope, name).orderBy(line))
    return df.withColumn("unique_name", F.when(place == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_L"), F.col(line).cast("string"))))


def summary(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in SUMMARY])


def rejects(df: DataFrame, required: str) -> tuple[DataFrame, DataFrame]:
    """Rows that have the required text, and those that lack it."""
    has = F.coalesce(T.strip(F.col(required)) != "", F.lit(False))
    return df.where(has), df.where(~has)


def run_counts(df: DataFrame, status: str) -> DataFrame:
    """loaded, selected, skipped and failed rows."""
    return df.agg(F.count("*").alias("loaded"), *[F.count_if(F.col(status) == s).alias(s) for s in ("selected", "skipped", "failed")])


def envelope(df: DataFrame, payload: list[str], config_hash: str) -> DataFrame:
    """Payload as JSON with its keys in order, and its hash."""
    json = T.canonical_json({c: F.col(c) for c in payload})
    return df.withColumn("payload", json).withColumn("payload_sha256", F.sha2("payload", 256)).withColumn("config_hash", F.lit(config_hash))


def places(df: DataFrame, key: str, seed: int, strata: list[str]) -> DataFrame:
    """The strata and keys with ``place``, from 1 on in the order of a seeded hash of the key, and ``n``, their number in the stratum.

    Counts by the hash's first digits say where each run of places begins, so that no task ranks more than the keys that share
    these (one in ``16 ** 3`` of a stratum)."""
    ids = df.select(*strata, key).distinct().withColumn("_lot", F.sha2(F.concat(F.lit(str(seed)), F.lit("|"), F.col(key).cast("string")), 256)).withColumn("_first", F.substring("_lot", 1, 3))
    counts = ids.groupBy(*strata, "_first").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*[F.col(c) for c in strata] or [F.lit(0)])
    counts = counts.withColumn("_before", F.sum("_n").over(by.orderBy("_first")) - F.col("_n")).withColumn("n", F.sum("_n").over(by)).drop("_n")
    at = Window.partitionBy(*strata, "_first").orderBy("_lot", key)
    return ids.join(counts, [*strata, "_first"]).select(*strata, key, (F.col("_before") + F.row_number().over(at)).alias("place"), "n")


def batches(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """Adds the number of each row's batch, from 0 on: keys in the order of a seeded hash, ``size`` of them to a batch."""
    return df.join(places(df, key, seed, []).select(key, F.floor((F.col("place") - 1) / size).cast("long").alias("batch")), key)


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, f1 and support of each class that is in either column; what divides by nothing is 0."""
    by = lambda c, n: df.groupBy(F.col(c).alias("class")).agg(F.count("*").alias(n))
    right = df.where(F.col(truth) == F.col(predicted)).groupBy(F.col(truth).alias("class")).agg(F.count("*").alias("_right"))
    rows = by(truth, "support").join(by(predicted, "_given"), "class", "full_outer").join(right, "class", "left").na.fill(0, ["support", "_given", "_right"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumn("precision", share(F.col("_right"), F.col("_given"))).withColumn("recall", share(F.col("_right"), F.col("support")))
    return rows.select("class", "precision", "recall", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def _split(df: DataFrame, key: str, ratio: float, seed: int, strata: list[str]) -> DataFrame:
    placed = places(df, key, seed, strata).withColumn("split", F.when(F.col("place") <= F.floor(F.col("n") * F.lit(ratio)), "train").otherwise("test"))
    return df.join(placed.select(*strata, key, "split"), [*strata, key])


def group_split(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Train or test for whole groups of a key: the first by a seeded hash train."""
    return _split(df, key, ratio, seed, [])


def stratified_split(df: DataFrame, key: str, label: str, ratio: float, seed: int = 42) -> DataFrame:
    return _split(df, key, ratio, seed, [label])


def threshold_split(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """The split for tables whose ids are too many to rank: a group trains if its hash falls below the ratio; no shuffle, sizes near."""
    lot = F.conv(F.substring(F.sha2(F.concat(F.lit(str(seed)), F.lit("|"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.withColumn("split", F.when(lot < ratio, "train").otherwise("test"))


def label_distribution(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.groupBy(split, label).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 of class 1; ratios without a base are 0."""
    t, p = F.col(truth), F.col(predicted)
    counts = (df.groupBy(*by) if by else df).agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"), F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    counts = counts.withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn)).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return counts.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_epoch(df: DataFrame, f1: str, epoch: str) -> DataFrame:
    """The epoch with the best F1; of equal ones the first."""
    return df.agg(F.max_by(epoch, F.struct(F.col(f1), -F.col(epoch))).alias("epoch"), F.max(f1).alias("f1"))


def test_rollup(df: DataFrame, key: str, code: str, seconds: str) -> DataFrame:
    return df.groupBy(key).agg(F.bool_and(F.col(code) == 0).alias("tests_passed"), F.floor(F.sum(seconds)).cast("long").alias("runtime_sec"))
