"""The corpus pipeline: quality rules, exact and near deduplication, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before it kept; its result is written as
Parquet and read again. All but the last return the columns of ``documents``, and whatever other columns there are. The
filtering stages first write their rows with a number for each and match verdicts by that number alone, so nulls in any
column, repeated ids, rows that agree in everything, columns of any type and under any name pass through. Of rows that
agree in everything the stages for duplicates keep one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlark.llm import exact_dedup, mixing, near_dedup, prefix_bpe, quality
from spanlark.llm.common import discard, numbered, spare, stash
from spanlark.llm.token_output import vocabulary_path


def chosen(rows: DataFrame, number: str, verdicts: DataFrame, named: str) -> DataFrame:
    """The rows whose number is in the column ``named`` of ``verdicts``, without their number."""
    return rows.join(verdicts.select(F.col(named).alias(number)), number, "left_semi").drop(number)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the outlier test reject go."""
    rows, number = numbered(docs)
    return chosen(rows, number, quality.judge(rows, id_col=number).where("kept"), "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one row stays: the longest, then the smallest id."""
    rows, number = numbered(docs)
    return chosen(rows, number, exact_dedup.exact_groups(rows, row_col=number).where("row = keep_row"), "row").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a similarity of five-word shingles of at least 0.8 one stays, that of the smallest id."""
    rows, number = numbered(docs)
    classes = near_dedup.near_duplicates(rows, k=5, num=4, den=5, id_col=number).select(F.col("doc_id").alias("n"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"), F.col(number).alias("n"))
    first = classes.join(rows.select(F.col(number).alias("n"), order.alias("order")), "n").groupBy("component_id").agg(F.min("order").alias("order"))
    return chosen(rows, number, first.select(F.col("order.n").alias("n")), "n").select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    rows, number = numbered(docs)
    copies = spare(rows, "copies")
    times = mixing.mix(rows, row_col=number).where("copies > 0").select(F.col("row").alias(number), F.col("copies").cast("int").alias(copies))
    return rows.join(times, number).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of them and of what they decode to."""
    return prefix_bpe.encode_digests(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [("quality", quality_rules), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates), ("mixing", source_mix), ("bpe", bpe)]

#: SQL can't express the covariance estimates, the knapsack and the merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs)
            if k:
                discard(before)
    return docs
