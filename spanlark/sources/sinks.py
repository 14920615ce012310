"""Writers: appended logs, summaries and enveloped artifacts. Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlark.operators.relational import envelope, summary


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows with their keys in order."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header: for reports of a bounded number of rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    write_csv(summary(df), path)


def write_envelopes(df: DataFrame, payload: list[str], config_hash: str, path: str) -> None:
    envelope(df, payload, config_hash).write.mode("overwrite").json(path)


def write_patches(df: DataFrame, path: str, patches: tuple[str, ...] = ("ori_patch", "adv_patch", "final_patch"), applied: DataFrame | None = None) -> None:
    """Patch texts with their hashes and how applying the last went, a folder for each instance."""
    from spanlark.operators.settings import patch_records

    records = patch_records(df.select("instance_id", *patches), ["instance_id"], applied, patches, keep=True)
    records.write.mode("overwrite").partitionBy("instance_id").json(path)


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_transcripts(turns: DataFrame, key: str, turn: str, path: str) -> None:
    """One line for each key: its turns as a JSON array in order."""
    lines = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(turn), F.struct(*[c for c in turns.columns if c != key]).alias("row")))).alias("turns"))
    lines.select(key, F.transform("turns", lambda t: t["row"]).alias("turns")).write.mode("overwrite").json(path)
