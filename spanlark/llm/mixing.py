"""Mixing sources to target weights: subset-sum budget fitting by exact document length.

1. A document's size is its number of words. Sizes are summed by source, and the sources share
   ``share`` times all words by weight; a target stops at ``most`` times its source's size and the excess
   goes to the others by weight, until none is above.
2. Each source's documents are counted by exact size. A target takes every document ``target // size`` times
   (0 or 1) as a whole, and what remains is a subset-sum problem over (size, count). First every size gives
   its proportional share of documents, then large sizes fill until less than ``window`` words plus one
   document remain, then a bounded-knapsack program over the words that remain finds the nearest reachable sum.
3. Of each (source, size), that many documents are chosen by a seeded hash of the row. Groups are cut into
   buckets of the hash; whole buckets go by their cumulative counts and only one bucket of a group is ranked,
   so a source or size that holds most rows is spread over many tasks.

Only the histogram of a source, at most a row for each distinct size, is ever in one task, and one row for each
source on the driver. Null texts have size 0. A null source is a source of its own, ordered last. Rows that
share an id draw by their other columns; rows that agree in everything are interchangeable. Sources without words
have target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlark.llm.common import WORD, join_weighted, stash

WEIGHTS = (5, 2, 1)


def fit_targets(sizes: list[int], weights: list[int], share: Fraction, most: int) -> list[float]:
    """Words for each source: by weight, none above ``most`` times its size, the excess reshared."""
    rest = min(share * sum(sizes), Fraction(most * sum(sizes)))
    out: list[Fraction] = [Fraction(0)] * len(sizes)
    open_ = [k for k, s in enumerate(sizes) if s > 0]
    while open_:
        each = rest / sum(weights[k] for k in open_)
        full = [k for k in open_ if each * weights[k] >= most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = each * weights[k]
            break
        for k in full:
            out[k] = Fraction(most * sizes[k])
            rest -= out[k]
        open_ = [k for k in open_ if k not in set(full)]
    return [float(x) for x in out]


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their sum is as near to ``budget`` from below as
    any choice gets. Counts are split into powers of two; ``by`` remembers the item that first reached a sum."""
    take = np.zeros(len(sizes), dtype=np.int64)
    reach, by = np.zeros(budget + 1, dtype=bool), np.full(budget + 1, -1, dtype=np.int32)
    reach[0], items = True, []
    for k in np.argsort(-sizes):
        left, piece = min(int(counts[k]), budget // int(sizes[k])), 1
        while left > 0:
            n = min(piece, left)
            weight = n * int(sizes[k])
            if weight <= budget:
                new = reach[: budget + 1 - weight] & ~reach[weight:]
                by[weight:][new] = len(items)
                reach[weight:] |= new
                items.append((k, n, weight))
            left, piece = left - n, piece * 2
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at > 0:
        k, n, weight = items[by[at]]
        take[k] += n
        at -= weight
    return take


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int) -> np.ndarray:
    """Documents to take of each size for a sum near ``budget`` words, at most all of them."""
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    rest = budget - int((sizes * take).sum())
    for k in np.argsort(-sizes):
        n = min(int(counts[k] - take[k]), max(0, rest - window) // int(sizes[k]))
        take[k] += n
        rest -= n * int(sizes[k])
    if rest > 0:
        fits = np.flatnonzero((sizes <= rest) & (counts > take))
        take[fits] += knapsack(sizes[fits], (counts - take)[fits], rest)
    return take


def chosen_by_size(histogram: pd.DataFrame, window: int) -> pd.DataFrame:
    """For one source: size, rounds (times that every document is taken), n_more (documents taken once more)."""
    part = histogram[histogram["size"] > 0]
    sizes, counts = part["size"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
    total, target = int((sizes * counts).sum()), int(round(histogram["target"].iloc[0]))
    rounds = target // total if total else 0
    more = fit_counts(sizes, counts, target - rounds * total, window) if total else counts
    out = pd.DataFrame({"source_key": histogram["source_key"].iloc[0], "size": sizes, "rounds": rounds, "n_more": more, "n": counts})
    return out.astype({"rounds": "int64", "n_more": "int64"})


def row_hash(docs: DataFrame, seed: int = 17, *, leave: str | None = None) -> Column:
    """The lot that a row draws: rows that agree in everything (but the column ``leave``) draw the same. Maps have no hash, so
    columns that hold one are hashed as JSON."""
    has_map = lambda t: "map<" in t.simpleString()
    value = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if has_map(f.dataType) else F.col(f"`{f.name}`")
    return F.xxhash64(*[value(f) for f in docs.schema if f.name != leave], F.lit(seed))


def mix(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 17, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken, copies (taken = copies * size), source, lot, and
    with ``row_col`` (a number for each row) row."""
    spark = docs.sparkSession
    sized = stash(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            row_hash(docs, seed, leave=row_col).alias("lot"),
            (F.col(f"`{row_col}`") if row_col else F.lit(None)).cast("long").alias("row"),
        ).withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    )
    histogram = stash(sized.groupBy("source_key", "source", "size").agg(F.count("*").alias("n")))
    per_source = histogram.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()
    rows = sorted(per_source, key=lambda r: (r["source"] is None, r["source"] or ""))
    targets = fit_targets([int(r["words"]) for r in rows], [weights[k % len(weights)] for k in range(len(rows))], share, most)
    table = spark.createDataFrame([(r["source_key"], int(r["words"]), t) for r, t in zip(rows, targets, strict=True)], "source_key string, source_size long, target double")

    chosen = histogram.join(table, "source_key").groupBy("source_key").applyInPandas(lambda h: chosen_by_size(h, window), "source_key string, size long, rounds long, n_more long, n long")
    # about 256 rows in a bucket, and at most 1024 buckets in a group
    chosen = stash(chosen.withColumn("buckets", F.least(F.lit(1024), F.ceil(F.col("n") / 256)).cast("long")))
    # a group of one source and size may hold a third of all rows: frequent groups are broadcast
    lots = sized.select("doc_id", "row", "source_key", "size", "lot").where("size > 0")
    lots = join_weighted(lots, chosen.withColumn("weight", F.col("n")), ["source_key", "size"], histogram.agg(F.sum("n")).first()[0] or 0)
    lots = lots.withColumn("bucket", F.pmod(F.shiftrightunsigned("lot", 20), "buckets"))
    partial = lots.where("n_more between 1 and n - 1")
    by_bucket = partial.groupBy("source_key", "size", "bucket").agg(F.count("*").alias("m"), F.first("n_more").alias("n_more"))
    earlier = Window.partitionBy("source_key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    here = by_bucket.select("source_key", "size", "bucket", F.greatest(F.lit(0), F.least("m", F.col("n_more") - F.coalesce(F.sum("m").over(earlier), F.lit(0)))).alias("n_here"))
    rank = Window.partitionBy("source_key", "size", "bucket").orderBy("lot", F.col("doc_id").asc_nulls_last(), "row")
    ranked = partial.join(here, ["source_key", "size", "bucket"]).withColumn("rank", F.row_number().over(rank))
    own = ["doc_id", "row", "source_key", "size", "lot"]
    more = ranked.select(*own, (F.col("rounds") + (F.col("rank") <= F.col("n_here")).cast("long")).alias("copies"))
    whole = lots.where("n_more not between 1 and n - 1").select(*own, (F.col("rounds") + (F.col("n_more") > 0).cast("long")).alias("copies"))
    none = sized.where("size = 0").select(*own, F.lit(0).cast("long").alias("copies"))
    mixed = more.unionByName(whole).unionByName(none)
    source = F.when(F.col("source_key") != "null", F.substring("source_key", 2, 1 << 30)).alias("source")
    columns = ["doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", source, "lot", *(["row"] if row_col else [])]
    return mixed.join(F.broadcast(table) if len(rows) <= 10_000 else table, "source_key").select(*columns)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
