"""Calls to something outside (a model, a service) for the rows that a cache lacks, partition by partition, with retries.

The caller is a function from (prompt, settings) to a text, or to (text, usage), given by the user; tasks run it, so it has to be picklable.
Each call has a row in the result, whether it was cached, answered, answered by the stand-in, or failed; new answers are appended to
the cache, and a run that was cut short finds there what it has paid for."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlark.functions import text as T
from spanlark.sources import readers
from spanlark.sources.tables import written

Answer = str | tuple[str, dict[str, int]]

#: What a call is known by, in the order of their names, and the columns of the cache.
KEY_PARTS = ("fidelity_mode", "instance_id", "model", "module_config_hash", "module_kind", "module_name", "prompt_hash", "provider")
CACHE = "cache_key string, instance_id string, module_kind string, module_name string, provider string, model string, temperature double, seed long, prompt string, text string, token_usage map<string,bigint>, prompt_hash string, response_hash string, provider_fallback boolean, tool_blocked boolean, error string, call_count int"
CACHE_COLUMNS = [c.split()[0] for c in CACHE.split(", ")]


@dataclass(frozen=True)
class Caller:
    """How a call is made: retries wait ``backoff`` seconds, then twice as long each; a stand-in answers where all of them failed
    (``fallback``), or all calls in a run without a provider (``surrogate``)."""

    call: Callable[[str, dict], Answer]
    max_retries: int = 2
    backoff: float = 1.0
    fallback: bool = False
    surrogate: bool = False
    stand_in: Callable[[str], str] = field(default=lambda prompt: "")
    wait: Callable[[float], None] = time.sleep

    def answer(self, prompt: str, settings: dict) -> tuple[str | None, dict, bool, str, int]:
        """(text, usage, whether the stand-in gave it, error, number of calls)."""
        if self.surrogate:
            return self.stand_in(prompt), {}, False, "", 1
        error = ""
        for attempt in range(self.max_retries + 1):
            try:
                got = self.call(prompt, settings)
                text, usage = got if isinstance(got, tuple) else (got, {})
                return text, usage, False, "", attempt + 1
            except Exception as e:  # whatever a provider raises is a reason to try again
                error = str(e) or type(e).__name__
                if attempt < self.max_retries:
                    self.wait(self.backoff * 2**attempt)
        if self.fallback:
            return self.stand_in(prompt), {}, True, error, 1
        return None, {}, False, error, self.max_retries + 1


def with_keys(calls: DataFrame) -> DataFrame:
    """Adds prompt_hash and cache_key to calls; key parts that they lack count as empty texts."""
    rows = calls.withColumn("prompt_hash", F.sha2(F.coalesce("prompt", F.lit("")), 256))
    parts = {p: F.coalesce(F.col(p).cast("string"), F.lit("")) if p in rows.columns else F.lit("") for p in KEY_PARTS}
    return rows.withColumn("cache_key", F.sha2(T.canonical_json(parts), 256))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last answer of each key; a path that is not there is an empty cache."""
    rows = spark.read.schema(CACHE).parquet(path) if readers.exists(spark, path) else spark.createDataFrame([], CACHE)
    order = F.struct("call_count", "response_hash")
    return rows.where("error = '' or provider_fallback").groupBy("cache_key").agg(F.max_by(F.struct(*CACHE_COLUMNS[1:]), order).alias("c")).select("cache_key", "c.*")


def answered(misses: DataFrame, caller: Caller, columns: list[str]) -> DataFrame:
    """One row of the cache's columns for each row of ``misses``; partitions call side by side, rows of one in turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                settings = {c: None if pd.isna(r[c]) else r[c] for c in columns}
                text, usage, stood_in, error, count = caller.answer(r["prompt"] or "", settings)
                shown = text or ""
                digest = hashlib.sha256(shown.encode()).hexdigest() if text is not None else ""
                rows.append({**r, "text": text, "token_usage": {k: int(v) for k, v in usage.items()}, "response_hash": digest, "provider_fallback": stood_in, "error": error, "call_count": count})
            yield pd.DataFrame(rows, columns=[c for c in CACHE_COLUMNS if c != "tool_blocked"])

    schema = ", ".join(c for c in CACHE.split(", ") if not c.startswith("tool_blocked"))
    out = misses.mapInPandas(run, schema)
    return out.withColumn("tool_blocked", T.is_refusal(F.col("text"))).select(*CACHE_COLUMNS)


def generate(calls: DataFrame, caller: Caller, cache_path: str, *, parallel: int | None = None) -> DataFrame:
    """calls: any columns with ``prompt``, and those of ``KEY_PARTS``, ``temperature`` and ``seed`` that there are. Adds the columns of the
    answer, ``cache_hit`` among them, to every row.

    Equal calls are made once. What is missing is asked for in ``parallel`` tasks, written down, and only then appended to the cache
    (calls that failed are not, so they are tried again next time). A task that is repeated asks again for its rows."""
    spark = calls.sparkSession
    rows = with_keys(calls)
    cache = written(read_cache(spark, cache_path))
    blank = {"temperature": F.lit(None).cast("double"), "seed": F.lit(None).cast("long")}
    part = lambda c: F.col(c) if c in rows.columns else blank.get(c, F.lit("")).alias(c)
    asked = ["cache_key", "instance_id", "module_kind", "module_name", "provider", "model", "temperature", "seed", "prompt", "prompt_hash"]
    wanted = rows.select(*[part(c).alias(c) for c in asked]).dropDuplicates(["cache_key"])
    misses = wanted.join(cache.select("cache_key"), "cache_key", "left_anti")
    misses = misses.repartition(parallel, "cache_key") if parallel else misses.repartition("cache_key")
    cast = misses.select(*[F.col(c).cast(k).alias(c) for c, k in (x.split() for x in CACHE.split(", ") if x.split()[0] in asked)])
    fresh = written(answered(cast, caller, [c for c in asked if c != "prompt"]))
    fresh.where("error = '' or provider_fallback").write.mode("append").parquet(cache_path)
    known = cache.withColumn("cache_hit", F.lit(True)).unionByName(fresh.withColumn("cache_hit", F.lit(False)))
    gained = ["text", "token_usage", "response_hash", "provider_fallback", "tool_blocked", "error", "call_count", "cache_hit"]
    clashing = [c for c in gained if c in rows.columns]
    return rows.drop(*clashing).join(known.select("cache_key", *gained), "cache_key", "left")


def write_call_artifacts(answers: DataFrame, path: str) -> None:
    """Prompt, response and metadata of each call, one line each, in a folder for each kind of module."""
    meta = [c for c in CACHE_COLUMNS if c in answers.columns and c not in ("prompt", "text", "module_kind")]
    kind = F.col("module_kind") if "module_kind" in answers.columns else F.lit("call")
    answers.select(kind.alias("module_kind"), "prompt", F.col("text").alias("response"), F.struct(*meta).alias("metadata")).write.mode("append").partitionBy("module_kind").json(path)


def reply_columns(rows: DataFrame, answers: DataFrame, key: str, reply: str, error: str) -> DataFrame:
    """Adds an answer and its error to rows by key, as the structural defense reads them."""
    return rows.join(answers.select(key, F.col("text").alias(reply), F.nullif(F.col("error"), F.lit("")).alias(error)), key, "left")


def key_of(parts: dict[str, Column]) -> Column:
    """The cache key of the named parts; those that are missing count as empty."""
    return F.sha2(T.canonical_json({p: F.coalesce(parts[p].cast("string"), F.lit("")) if p in parts else F.lit("") for p in KEY_PARTS}), 256)
