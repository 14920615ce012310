"""Connected components of a table of links, without gathering any of them in one place.

Alternating star rounds: every node links its larger neighbours to its smallest one (large star), then its
smaller neighbours and itself to the smallest of them (small star). Each round shuffles the links and keeps one
written table; rounds end when the links no longer change, after about the logarithm of the longest chain.
Minima are combined before the shuffle, and what is known of a node with very many links is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlark.llm.common import discard, join_weighted, stash


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) long. Returns (node, component) for every node that has a link and is not its component's smallest."""
    table = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda t: tuple(t.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(table)
    while before[0]:
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight")).withColumn("m", F.least("m", "u")), free=False)
        large = join_weighted(both, least, "u", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, free=False)
        smallest = stash(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight")), free=False)
        rest = join_weighted(large, smallest, "u", large.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, table = table, stash(rest.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        now = mark(table)
        discard(old, least, large, smallest)
        if now == before:
            break
        before = now
    return table.select(F.col("u").alias("node"), F.col("v").alias("component"))
