"""Unified diffs as tables: lines with running state, hunks, and nodes of the added code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlark.functions import text as T


def diff_lines(df: DataFrame, key: str, patch: str) -> DataFrame:
    """key, pos, line, file (of the last +++ header), hunk (number of @@ lines so far). A patch's lines stay together; keys are many."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(patch), F.lit("")), "\n")).alias("pos", "line"))
    header = F.when(F.col("line").startswith("+++ "), T.strip(F.substring("line", 5, 1 << 30)))
    path = F.when(header.startswith("b/"), F.substring(header, 3, 1 << 30)).otherwise(header)
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("file", F.last(path, ignorenulls=True).over(upto))
    begins = F.col("line").startswith("@@")
    # a hunk ends where the next file's headers begin
    ends = F.col("line").startswith("diff --git ") | F.col("line").startswith("--- ") | F.col("line").startswith("+++ ")
    lines = lines.withColumn("hunk", F.sum(begins.cast("int")).over(upto))
    within = Window.partitionBy(key, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("in_hunk", (F.col("hunk") > 0) & (F.max(ends.cast("int")).over(within) == 0))


def hunks(df: DataFrame, key: str, patch: str) -> DataFrame:
    """key, chunk_id, file_path, hunk_header, raw_hunk, added (array of added lines); a hunk belongs to the file whose header precedes it."""
    rows = diff_lines(df, key, patch).where("in_hunk")
    parts = rows.groupBy(key, "hunk").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"), F.first("file", ignorenulls=True).alias("file_path"))
    lines = F.transform("rows", lambda r: r["line"])
    added = F.transform(F.filter(lines, lambda s: s.startswith("+") & ~s.startswith("+++")), lambda s: F.substring(s, F.lit(2), F.length(s)))
    return parts.select(key, F.concat(F.lit("chunk_"), F.col("hunk").cast("string")).alias("chunk_id"), F.coalesce("file_path", F.lit("")).alias("file_path"), T.strip(F.get(lines, F.lit(0))).alias("hunk_header"), F.array_join(lines, "\n").alias("raw_hunk"), added.alias("added"))


def hunk_nodes(df: DataFrame, key: str, patch: str) -> DataFrame:
    """A candidate node for each hunk of a Python file."""
    rows = hunks(df, key, patch).where(F.col("file_path").endswith(".py"))
    named = T.strip(F.regexp_extract("hunk_header", r"^.*def ([^(]*)", 1))
    function = F.when(F.contains("hunk_header", F.lit("def ")) & (named != ""), named).otherwise("unknown")
    start = F.coalesce(F.regexp_extract("hunk_header", r"\+(\d+)", 1).try_cast("int"), F.lit(0))
    rows = rows.withColumn("function", function).withColumn("start_line", start)
    return rows.select(
        key, F.concat_ws("::", "file_path", "function", "chunk_id").alias("node_id"), F.lit("added").alias("change_type"), F.col("file_path").alias("file"), "function", "start_line",
        (F.col("start_line") + F.size("added")).alias("end_line"), F.lit("basic_block").alias("node_type"), F.array_join("added", "\n").alias("code_snippet"), F.expr("cast(array() as array<string>)").alias("contains_calls"),
    )


def chunk_nodes(df: DataFrame, key: str, reply: str) -> DataFrame:
    """Nodes from a model's reply {"chunks": [{file, function, start_line, end_line, change_type, code_snippet}]}, or such an object
    inside other text, bucketed by kind of change. Chunks are numbered from 0 with those that are left out: what is no
    object, and chunks without file or code. A change without a kind is a modification, an end without a line the start."""
    raw = T.strip(F.coalesce(F.col(reply), F.lit("")))
    chunks = lambda t: F.try_variant_get(T.whole_json(t), "$.chunks", "array<variant>")
    rows = df.select(key, F.posexplode(F.coalesce(chunks(raw), chunks(F.regexp_extract(raw, r"(?s)(\{.*\})", 1)))).alias("pos", "c"))
    rows = rows.where(F.schema_of_variant("c").startswith("OBJECT"))
    text = lambda name, default: T.strip(F.coalesce(F.try_variant_get("c", f"$.{name}", "string"), F.lit(default)))
    line = lambda name: F.try_variant_get("c", f"$.{name}", "int")
    rows = rows.select(
        key, "pos", text("file", "").alias("file"), text("function", "unknown").alias("function"), F.coalesce(line("start_line"), F.lit(0)).alias("start_line"),
        F.coalesce(line("end_line"), line("start_line"), F.lit(0)).alias("end_line"), F.lower(text("change_type", "modified")).alias("change_type"), text("code_snippet", "").alias("code_snippet"),
    ).where("file <> '' and code_snippet <> ''")
    bucket = F.when(F.col("change_type") == "added", "nodes_added").when(F.col("change_type") == "removed", "nodes_removed").otherwise("nodes_changed")
    return rows.select(
        key, F.concat("file", F.lit("::"), "function", F.lit("::chunk_"), F.col("pos").cast("string")).alias("node_id"), bucket.alias("bucket"), "change_type", "file", "function", "start_line", "end_line",
        F.lit("code_chunk").alias("node_type"), "code_snippet", F.substring(F.md5("code_snippet"), 1, 8).alias("code_hash"), F.expr("cast(array() as array<string>)").alias("contains_calls"),
    )
