"""Jump consistent hashing: rows are dealt to shards by stable keys, without a table of the ring.

A key's shards for 1, 2, 3, ... shards form a chain that only ever jumps forward: with one more shard a row either stays
or goes to the new one, and one in n + 1 does. The chain is followed for all keys of a batch at once; its expected length
is the logarithm of the number of shards, and it ends after at most as many steps as there are shards.

Rows of equal keys share a shard whatever else they hold: the key and the number of shards decide, so equal texts under
different keys may part. A null key is a key of its own. ``assign`` gives every row its shard, its slot (from 0 without
gaps within its shard) and the shard it would have with one shard more; texts are read once and never shuffled. Slots
follow the order in which the input is read: rows are numbered within each part of the input, and a part's first slot is the
number of the shard's rows in the parts before, so no task ever holds a whole shard. ``write_shards`` writes the
rows themselves, one folder for each shard, in files of bounded size. Null and empty texts, repeated rows and repeated ids are rows as any
other; an empty table gives no rows; columns of the input that are not asked for cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlark.llm.common import spare, stash

#: Fixed values of the published method: the generator's multiplier and the range of its upper bits.
MULTIPLIER, RANGE = np.uint64(2862933555777941757), float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    at, key, moving = np.zeros(len(keys), np.int64), keys.astype(np.uint64), np.arange(len(keys))
    while len(moving):
        key = key * MULTIPLIER + np.uint64(1)
        ahead = ((at[moving] + 1) * (RANGE / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        going = ahead < shards
        moving, key = moving[going], key[going]
        at[moving] = ahead[going]
    return at.astype(np.int32)


def shard_of(keys: list[str], *counts: int) -> Column:
    """An array with the row's shard for each number of shards; the key is a hash of the named columns, nulls included."""
    if not counts or min(counts) < 1 or max(counts) > 1 << 30:
        raise ValueError("the number of shards has to lie between 1 and 2^30")

    @F.pandas_udf("array<int>")
    def chains(hashed: pd.Series) -> pd.Series:
        values = hashed.to_numpy(np.int64).view(np.uint64)
        return pd.Series(list(np.stack([jump(values, n) for n in counts], axis=1)))

    # a null hashes to the seed, so whether there is a value is hashed as well
    return chains(F.xxhash64(*[c for k in keys for c in (F.col(f"`{k}`").isNull(), F.col(f"`{k}`"))]))


def assign(docs: DataFrame, shards: int, *, keys: tuple[str, ...] = ("doc_id",), carry: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``carry`` (name to expression over the input), ``shard``, ``slot`` and ``grown_shard`` for each row."""
    carry = carry if carry is not None else {k: F.col(f"`{k}`") for k in keys}
    chain = shard_of(list(keys), shards, shards + 1)
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(carry.values())], F.monotonically_increasing_id().alias("row"), chain.alias("chain"))
    part = F.shiftright("row", 33)  # the upper bits of these ids number the part of the input
    rows = stash(rows.select("*", part.alias("part"), F.col("chain")[0].alias("shard"), F.col("chain")[1].alias("grown_shard")).drop("chain"))
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", "part", before.alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    named = [F.col(f"c{i}").alias(name) for i, name in enumerate(carry)]
    slots = rows.withColumn("inside", inside).join(starts, ["shard", "part"])
    return slots.select(*named, "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, shards: int, path: str, *, keys: tuple[str, ...] = ("doc_id",), rows_per_file: int = 1_000_000) -> DataFrame:
    """Write all columns to ``path`` as Parquet, a folder ``shard=k`` for each shard, and give the table read back.

    A shard is cut into as many pieces as its rows need and dealt by shard and piece, so neither a large shard nor a key with very
    many rows meets in one task. A row's piece follows from its place in the input, which a repeated task finds again."""
    name, piece = spare(docs, "shard"), spare(docs, "piece")
    if name != "shard":
        raise ValueError("a column named shard would clash with the folders")
    pieces = max(1, math.ceil(docs.count() / shards / rows_per_file))
    rows = docs.withColumn(name, shard_of(list(keys), shards)[0]).withColumn(piece, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(pieces)))
    rows.repartition(max(1, shards * pieces), name, piece).drop(piece).write.partitionBy(name).parquet(path)
    return docs.sparkSession.read.schema(docs.withColumn(name, F.lit(0)).schema).parquet(path)


def op13_jump_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    carry = {"doc_id": F.col("doc_id").cast("long"), "size": (F.octet_length(raw) + 1).cast("long"), "text_crc32": F.crc32(raw)}
    out = assign(docs, 8, carry=carry)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
