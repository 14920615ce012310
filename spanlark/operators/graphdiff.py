"""Control-flow graphs as vertex and edge tables, and the difference of two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlark.operators.relational import first_wins

PLACE = ["file", "function", "start_line", "end_line", "type"]


def node_diff(before: DataFrame, after: DataFrame, scope: list[str], order: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Nodes matched by place within (scope, file, function): added, removed, modified, moved or same.

    Of several nodes at a place the last in ``order`` counts. A node whose code is anywhere on the other side of its function,
    also in a node that does not count, has moved: as an addition it is moved, as a removal it is left out. ``carry``: columns
    that come along as before_* and after_*; a moved node's before_* are those of the last node there with its code.
    Both sides are dealt once by function; codes (by windows) and places are settled where they are."""
    columns = list(dict.fromkeys([*scope, *PLACE, "code_hash", "node_id", *(order or []), *(carry or [])]))
    return sides_diff(before.select(*columns, F.lit(True).alias("_old")).unionByName(after.select(*columns, F.lit(False).alias("_old"))), "_old", scope, order, carry)


def sides_diff(sides: DataFrame, old: str, scope: list[str], order: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """The difference of nodes whose column ``old`` says which side they are of; see ``node_diff``."""
    order, carry = order or ["node_id"], carry or []
    keys, local, null = [*scope, *PLACE], [*scope, "file", "function"], F.lit(None)
    both = sides.select(*dict.fromkeys([*keys, "code_hash", "node_id", *order, *carry]), F.col(old).alias("_old")).repartition(*local)
    by_code, known = Window.partitionBy(*local, "code_hash"), F.col("code_hash") != ""
    for c in local:  # what has no function has no other side
        known = known & F.col(c).isNotNull()
    last = lambda old, c: F.max_by(F.when(F.col("_old") == old, c), F.when(F.col("_old") == old, F.struct(*order)))
    there = lambda old: F.coalesce(F.max(F.col("_old") == old).over(by_code) & known, F.lit(False))
    both = both.withColumns({"_there_before": there(True), "_there_after": there(False)})
    if carry:
        both = both.withColumn("_from", F.when(known, last(True, F.struct(*carry)).over(by_code)))
    sides = {"_b": True, "_a": False}
    parts = {n: last(old, F.struct("code_hash", "_there_before", "_there_after")) for n, old in sides.items()} | {f"{n}_id": last(old, F.struct("node_id")) for n, old in sides.items()}
    parts |= {f"{n}_carry": last(old, F.struct(*carry, "_from")) for n, old in sides.items() if carry}
    places = both.groupBy(*keys).agg(*[c.alias(n) for n, c in parts.items()])  # columns apart, so that what a caller leaves out is not made
    moved = F.col("_b").isNull() & F.col("_a._there_before")
    kind = (
        F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.when(F.col("_b.code_hash").eqNullSafe(F.col("_a.code_hash")), "same").otherwise("modified"))
        .when(F.col("_b").isNull(), F.when(moved, "moved").otherwise("added")).when(~F.col("_b._there_after"), "removed")
    )
    origin = lambda c: F.coalesce(f"_b_carry.{c}", F.when(moved, F.col(f"_a_carry._from.{c}")).otherwise(null))
    return places.withColumn("change_type", kind).where("change_type is not null").select(
        *keys, F.col("_b.code_hash").alias("before_hash"), F.col("_b_id.node_id").alias("before_id"), F.col("_a.code_hash").alias("after_hash"), F.col("_a_id.node_id").alias("after_id"), "change_type",
        *[x for c in carry for x in (origin(c).alias(f"before_{c}"), F.col(f"_a_carry.{c}").alias(f"after_{c}"))],
    )


def edge_diff(before: DataFrame, after: DataFrame, scope: list[str]) -> DataFrame:
    """Edges that only one side has, duplicates kept."""
    keys = [*scope, "src", "kind", "dst"]
    added = after.join(before.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("added").alias("change_type"))
    return added.unionByName(before.join(after.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("removed").alias("change_type")))


def diff_summary(diff: DataFrame, before: DataFrame, after: DataFrame, scope: list[str], edges_before: DataFrame | None = None, edges_after: DataFrame | None = None) -> DataFrame:
    """Nodes by kind of change, and all nodes and edges of either side, those that do not count in the difference as well."""
    kinds = ("added", "removed", "modified", "moved", "same")
    by_kind = diff.groupBy(*scope).agg(*[F.count_if(F.col("change_type") == k).alias(f"nodes_{k}") for k in kinds])

    def totals(old: DataFrame, new: DataFrame, name: str, *more: Column) -> DataFrame:
        columns = list(dict.fromkeys([*scope, *(["file", "function"] if more else [])]))
        rows = old.select(*columns, F.lit(1).alias("_o"), F.lit(0).alias("_n")).unionByName(new.select(*columns, F.lit(0).alias("_o"), F.lit(1).alias("_n")))
        few = rows.groupBy(*columns).agg(F.sum("_o").alias("_o"), F.sum("_n").alias("_n"))  # what is counted once is one row before it is
        return few.groupBy(*scope).agg(F.sum("_o").alias(f"{name}_before"), F.sum("_n").alias(f"{name}_after"), *more)

    out = totals(before, after, "nodes", F.count_distinct("file").alias("files_compared"), F.count_distinct("file", "function").alias("functions_compared")).join(by_kind, scope, "left")
    if edges_before is not None:
        out = out.join(totals(edges_before, edges_after, "edges"), scope, "left")
    return out.na.fill(0)


def candidates(diff: DataFrame, scope: list[str]) -> DataFrame:
    """Added and changed nodes, once for each id: additions first, then function by function moved before modified ones."""
    rows = diff.where(F.col("change_type").isin("added", "moved", "modified")).withColumn("node_id", F.col("after_id"))
    rows = rows.withColumn("_added", F.col("change_type") != "added").withColumn("_modified", F.col("change_type") == "modified")
    return first_wins(rows, [*scope, "node_id"], ["_added", "file", "function", "_modified", "start_line", "end_line", "type"]).drop("_added", "_modified")


def signature(kind: str) -> Column:
    """What a node or an edge is called where it has no id."""
    if kind == "node":
        return F.concat_ws("::", "file", "function", F.col("start_line").cast("string"), F.col("end_line").cast("string"), "code_hash")
    return F.concat(F.coalesce("src", F.lit("")), F.lit("--"), F.coalesce("kind", F.lit("fallthrough")), F.lit("-->"), F.coalesce("dst", F.lit("")))


def node_stats(nodes: DataFrame, scope: list[str]) -> DataFrame:
    """Counts of nodes, files and functions, mean snippet length, and nodes by type and by change."""
    counted = nodes.groupBy(*scope).agg(
        F.count("*").alias("num_candidate_nodes"), F.count_distinct(F.when(F.col("file") != "", F.col("file"))).alias("num_files_touched"),
        F.count_distinct(F.concat_ws("::", "file", "function")).alias("num_functions_touched"), F.avg(F.length("code_snippet")).alias("avg_snippet_len"),
    )
    for column, name in (("node_type", "node_type_counts"), ("change_type", "change_type_counts")):
        by = nodes.groupBy(*scope, column).agg(F.count("*").alias("n")).groupBy(*scope).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))
        counted = counted.join(by, scope)
    return counted


def build_stats(nodes: DataFrame, errors: DataFrame) -> DataFrame:
    ok = nodes.agg(F.count_distinct("file").alias("files_ok"), F.count_distinct("file", "function").alias("functions"))
    return ok.crossJoin(errors.agg(F.count_distinct("file").alias("files_failed")))  # one row each
