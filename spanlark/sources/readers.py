"""Scans of instance, result, patch, source and model files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlark.functions import text as X


def of_strings(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()])


INSTANCE = of_strings("instance_id id problem_statement prompt repo_path repo_id repo base_commit test_command")
PATCH = of_strings("instance_id patch_id id group_id patch unified_diff diff adv_patch model_patch")
SKIP_FOLDERS = [".git", ".hg", ".svn", ".tox", ".venv", "venv", "__pycache__", "node_modules", "site-packages"]
MODES = {"strict": "FAILFAST", "lenient": "DROPMALFORMED", "permissive": "PERMISSIVE"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) names anything, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "strict") -> DataFrame:
    """Rows of JSON lines: strict stops at a bad line, lenient drops it, permissive keeps nulls. A missing path is an empty table."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(schema).json(path, mode=MODES[mode]) if exists(spark, path) else spark.createDataFrame([], schema)


def numbered(rows: DataFrame, split: list[str], place: str, name: str = "pos") -> DataFrame:
    """Adds each row's number from 0 on: splits (parts of files, in the order of these columns) come one after the other, and
    ``place`` counts up by one within each. Only counts, one for each split, are put in order; rows stay where they are."""
    counts = rows.groupBy(*split).agg(F.min(place).alias("_least"), F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.orderBy(*split)) - F.col("_n")).drop("_n")
    return rows.join(counts, split).withColumn(name, F.col("_before") + F.col(place) - F.col("_least")).drop("_before", "_least")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, value of every line but blank ones; numbers go on from file to file in the order of their paths."""
    lines = spark.read.text(path).where(X.strip("value") != "")
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_place"))
    return numbered(lines, ["file", "_start"], "_place").select("file", "pos", "value")


def sorted_out(items: DataFrame, value: str, item: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON texts: rows have the fields of ``item``, rejects the text and the reason; both keep the other columns."""
    others = [c for c in items.columns if c != value]
    kept = T.StructType([*item.fields, T.StructField("_odd", T.StringType())])
    read = items.withColumn("_v", X.whole_json(X.strip(F.col(value)))).withColumn("_r", F.from_json(value, kept, {"columnNameOfCorruptRecord": "_odd"}))
    reason = F.when(F.col("_v").isNull(), "invalid JSON").when(~F.schema_of_variant("_v").startswith("OBJECT"), "no object").when(F.col("_r._odd").isNotNull(), "a field of another type")
    read = read.withColumn("reason", reason)
    good = read.where("reason is null").select(*others, *[F.col(f"_r.{f.name}").alias(f.name) for f in item.fields])
    return good, read.where("reason is not null").select(*others, F.col(value).alias("text"), "reason")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines, each with file and pos: every line but blank ones is in one of them. A missing path is empty tables."""
    item = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = text_lines(spark, path) if exists(spark, path) else spark.createDataFrame([], "file string, pos long, value string")
    return sorted_out(lines, "value", item)


def json_items(spark: SparkSession, path: str, item: T.StructType, wrappers: tuple[str, ...] = ("rows",), *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON files that are an array, or an object with the array under one of ``wrappers``; the first present counts.

    Another shape has no rows, and is an error if ``strict``."""
    if not exists(spark, path):
        return sorted_out(spark.createDataFrame([], "file string, pos long, value string"), "value", item)
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), X.whole_json(X.strip(F.col("value"))).alias("_v"))
    listed = lambda at: F.when(F.schema_of_variant(F.try_variant_get("_v", at, "variant")).startswith("ARRAY"), F.try_variant_get("_v", at, "array<variant>"))
    whole = whole.withColumn("_items", F.coalesce(listed("$"), *[listed(f"$.{w}") for w in wrappers]))
    if strict and (odd := whole.where("_items is null").select("file").first()):
        raise ValueError(f"{odd['file']} holds neither a list nor an object with a list under {', '.join(wrappers)}")
    items = whole.select("file", F.posexplode("_items").alias("_place", "_item")).select("file", "_place", F.to_json("_item").alias("value"))
    return sorted_out(numbered(items, ["file"], "_place").drop("_place"), "value", item)


def instances(spark: SparkSession, path: str, *, dataset: str = "swebench_lite", split: str = "test", ids: list[str] | None = None, limit: int | None = None, default_command: str = "python -m pytest -q") -> tuple[DataFrame, DataFrame]:
    """(instances, rejects): keys fall back to their other names; what is no JSON object, or has no repository path, is a reject with its
    reason. Rows keep the order of files and lines, which also names those without an id; a limit of 0 is no rows."""
    raw, bad = json_lines(spark, path, INSTANCE) if path.endswith(".jsonl") else json_items(spark, path, INSTANCE)
    good, rejects = instances_of(raw, bad, dataset=dataset, split=split, ids=ids, default_command=default_command)
    return (good if limit is None else good.orderBy("pos").limit(limit)), rejects


def instances_of(raw: DataFrame, bad: DataFrame, *, dataset: str = "swebench_lite", split: str = "test", ids: list[str] | None = None, default_command: str = "python -m pytest -q") -> tuple[DataFrame, DataFrame]:
    """(instances, rejects) of rows with the fields of ``INSTANCE`` and pos, and of what is no such row (pos, text, reason)."""
    command = X.blank_to_null(F.col("test_command"))
    rows = raw.select(
        F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.coalesce(X.first_filled(F.col("instance_id"), F.col("id")), F.concat(F.lit("row-"), F.col("pos").cast("string"))).alias("instance_id"),
        F.coalesce(X.first_filled(F.col("problem_statement"), F.col("prompt")), F.lit("")).alias("prompt"),
        F.struct(X.first_filled(F.col("repo_id"), F.col("repo")).alias("repo_id"), X.blank_to_null(F.col("repo_path")).alias("path"), F.col("base_commit")).alias("repo_snapshot"),
        F.coalesce(F.when(F.ltrim(command).startswith("["), F.from_json(command, "array<string>")), F.split(F.coalesce(command, F.lit(default_command)), r"\s+")).alias("command"), "pos",
    )
    rows = rows.where(F.col("instance_id").isin(ids)) if ids else rows
    good = rows.where("repo_snapshot.path is not null")
    lacking = rows.where("repo_snapshot.path is null").withColumn("reason", F.lit("no repository path"))
    return good, lacking.unionByName(bad.select("pos", "text", "reason"), allowMissingColumns=True)


def toy(spark: SparkSession, rows: list[dict] | None = None, limit: int | None = None) -> DataFrame:
    rows = [{"instance_id": "toy-1", "repo_id": "toy/repo", "base_commit": "", "prompt": "Fix add()"}] if rows is None else rows
    schema = "instance_id string, repo_id string, base_commit string, prompt string"
    return spark.createDataFrame([tuple(r.get(k, "") for k in ("instance_id", "repo_id", "base_commit", "prompt")) for r in (rows if limit is None else rows[:limit])], schema)


def prebuilt_patches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(patches, rejects): instance_id, candidate_id, patch_text, the first filled of the names that a patch goes by, and pos; what is no
    object is a reject, a file of another shape an error."""
    wrappers = ("rows", "predictions", "instances", "data")
    rows, bad = json_lines(spark, path, PATCH) if path.endswith(".jsonl") else json_items(spark, path, PATCH, wrappers, strict=True)
    patch = X.first_filled(*[F.col(c) for c in ("patch", "unified_diff", "diff", "adv_patch", "model_patch")])
    return rows.select("instance_id", X.first_filled(F.col("patch_id"), F.col("id"), F.col("group_id")).alias("candidate_id"), patch.alias("patch_text"), "pos"), bad


def result_logs(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All results of a matrix, with the file each row is from and its number in the order of files and lines."""
    path = f"{folder}/*/results.jsonl"
    if not exists(spark, path):
        return jsonl(spark, path, schema).withColumns({"file": F.lit(""), "pos": F.lit(0).cast("long")})
    rows = jsonl(spark, path, schema)
    columns = rows.columns
    rows = rows.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_place"))
    return numbered(rows, ["file", "_start"], "_place").select(*columns, "file", "pos")


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """path, source of the Python files below a folder, but for folders that hold no code of its own."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))
    return files.where(~F.col("path").rlike("/(" + "|".join(x.replace(".", r"\.") for x in SKIP_FOLDERS) + ")/"))


def artifact_texts(spark: SparkSession, folder: str, names: tuple[str, ...] = ("adv_prompt.txt", "original_prompt.txt")) -> DataFrame:
    """instance (folder name) and text of the first artifact that exists, stripped."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(names) + "}").text(folder, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    order = F.array_position(X.strings(names), F.element_at(parts, -1))
    return files.select(F.element_at(parts, -2).alias("instance"), F.struct(order.alias("o"), X.strip("value").alias("t")).alias("x")).groupBy("instance").agg(F.min("x")["t"].alias("text"))


def cli_outputs(df: DataFrame, file_text: str, stdout: str) -> DataFrame:
    """What a command-line agent returned: its file, or its output where the file is blank; and the diff in it."""
    return df.withColumn("reply", F.coalesce(X.first_filled(F.col(file_text), F.col(stdout)), F.lit(""))).withColumn("diff", X.find_diff(F.col("reply")))


def cli_agent(df: DataFrame, prompt: str, outputs: DataFrame | None = None, agent: str | None = None) -> DataFrame:
    """Adds ``patch``: the diff that a command-line agent returned for the prompt, empty where it returned none.

    outputs: (agent_name, instance_id, prompt_hash, file_text, stdout) of runs that were captured; ``agent`` names theirs, else the row does."""
    if outputs is None:
        return df.withColumn("patch", F.lit(""))
    diffs = cli_outputs(outputs, "file_text", "stdout").select(F.col("agent_name").alias("_agent"), F.col("instance_id").alias("_instance"), F.col("prompt_hash").alias("_prompt"), F.col("diff").alias("_diff"))
    diffs = diffs.dropDuplicates(["_agent", "_instance", "_prompt"])
    named = F.lit(agent) if agent else F.col("agent_name")
    rows = df.withColumns({"_agent": named, "_instance": F.col("instance_id"), "_prompt": F.sha2(F.col(prompt), 256)})
    return rows.join(diffs, ["_agent", "_instance", "_prompt"], "left").withColumn("patch", F.coalesce("_diff", F.lit(""))).drop("_agent", "_instance", "_prompt", "_diff")


def load_settings(path: str) -> dict:
    """A JSON or (where a parser is installed) YAML mapping; a missing file or another kind of value is an error."""
    import json
    from pathlib import Path

    raw = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        value = yaml.safe_load(raw)
    else:
        value = json.loads(raw)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value


def envelopes(spark: SparkSession, path: str, payload: str = "payload") -> DataFrame:
    """Hashed envelopes with ``valid``: whether the payload still has the hash that was written with it."""
    rows = spark.read.schema(f"{payload} string, payload_sha256 string, config_hash string").json(path)
    return rows.withColumn("valid", F.sha2(F.col(payload), 256).eqNullSafe(F.col("payload_sha256")))
