"""Connected components within groups, by rounds of joins: no group and no component is gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlark.sources.tables import discard, written


def least_neighbours(links: DataFrame, scope: list[str]) -> DataFrame:
    """For each vertex ``u`` the least of itself and its neighbours ``v``; minima are combined before they are shuffled."""
    return links.groupBy(*scope, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))


def are_stars(links: DataFrame, scope: list[str]) -> bool:
    """Whether every ``u`` has one ``v``, and no ``v`` is a ``u``."""
    several = links.groupBy(*scope, "u").agg(F.count("*").alias("n")).where("n > 1")
    chained = links.join(links.select(*scope, F.col("u").alias("v")), [*scope, "v"], "left_semi")
    return not several.limit(1).count() and not chained.limit(1).count()


def components(links: DataFrame, scope: list[str], a: str, b: str) -> DataFrame:
    """(scope, vertex, component) for each vertex with a link but the least of its component, which names it.

    Alternating stars: every vertex hands its larger neighbours to the least one it knows, then its smaller ones. A round is one
    written table, and rounds end when only stars are left, after about the logarithm of the longest chain."""
    table = written(links.where(F.col(a) != F.col(b)).select(*scope, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not are_stars(table, scope):
        both = table.unionByName(table.select(*scope, F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least_neighbours(both, scope), [*scope, "u"]).where("v > u").select(*scope, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(least_neighbours(large, scope), [*scope, "u"])
        rest = small.where("v <> m").select(*scope, F.col("v").alias("u"), F.col("m").alias("v"))
        old, table = table, written(rest.unionByName(small.select(*scope, "u", F.col("m").alias("v"))).distinct())
        discard(old)
    return table.select(*scope, F.col("u").alias("vertex"), F.col("v").alias("component"))
