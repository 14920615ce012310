"""Runs from settings: the parts that a run names, their hashes, and what is written down of a run beside its results."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlark.operators import runs
from spanlark.sources import readers

#: The folder of each part's settings, and the axis that names it in the settings of a matrix.
PARTS = {"dataset": "datasets", "agent": "agents", "attack": "attacks", "baseline": "baselines"}
AXES = {"datasets": "dataset", "agents": "agent_name", "attacks": "attack_name", "baselines": "baseline_name", "fidelity_modes": "fidelity_mode"}
#: Names of datasets whose settings lie under a shorter one.
FILES = {"swebench_lite": "lite", "swebench_pro": "pro", "swebench_plus": "plus"}
SUFFIXES = (".yaml", ".yml", ".json")
FIXED = ("plugin", "name")


def digest(settings: dict) -> str:
    """The hash of settings: of their JSON with keys in order, whatever order they were written in."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def load_part(folder: str, part: str, name: str, changes: dict | None = None) -> dict:
    """Settings of one part by name: ``folder/parts/name`` with a known suffix. ``changes`` replace keys, but not what the part is; a
    name without a file, and one that leaves the folder, is an error."""
    place = Path(folder) / PARTS[part]
    stem = FILES.get(name.strip().lower(), name) if part == "dataset" else name
    if Path(stem).name != stem:
        raise ValueError(f"{name!r} names no {part} in {place}")
    for path in (place / f"{stem}{s}" for s in SUFFIXES):
        if path.exists():
            settings = readers.load_settings(str(path))
            if fixed := [k for k in FIXED if k in (changes or {}) and changes[k] != settings.get(k)]:
                raise ValueError(f"{', '.join(fixed)} of {part} {name!r} may not change")
            return settings | (changes or {})
    raise FileNotFoundError(f"no settings of {part} {name!r} in {place}")


def with_prebuilt(settings: dict, path: str | None) -> dict:
    """Settings of an attack that takes its patches from a file; without one, the settings as they are."""
    return settings | {"mode": "prebuilt_json", "swexploit_adv_patches": path} if path else settings


def matrix(spark: SparkSession, run: dict, folder: str, *, prebuilt: str | None = None, changes: dict[str, dict[str, dict]] | None = None) -> tuple[DataFrame, dict[str, dict[str, dict]]]:
    """(runs, parts) of a matrix's settings: a row for each run, with the hashes of its parts' settings, and these by part and name.

    ``prebuilt`` is the file that the attack ``swexploit`` takes its patches from; it counts in the hash, so such runs do not resume
    others. ``changes`` are keys that replace those of the files, by part and name. An axis that is named but empty is an error."""
    axes = {column: [str(v) for v in run[axis]] for axis, column in AXES.items() if axis in run}
    parts: dict[str, dict[str, dict]] = {}
    for part in PARTS:
        column = part if part == "dataset" else f"{part}_name"
        named = axes.get(column)
        if not named:
            raise ValueError(f"the settings of the matrix name no {PARTS[part]}")
        parts[part] = {name: load_part(folder, part, name, (changes or {}).get(part, {}).get(name)) for name in named}
    if "swexploit" in parts["attack"]:
        parts["attack"]["swexploit"] = with_prebuilt(parts["attack"]["swexploit"], prebuilt)
    return runs.matrix_runs(spark, axes, {part: {name: digest(s) for name, s in known.items()} for part, known in parts.items()}), parts


def chosen(known: dict[str, str], name: Column) -> Column:
    """The value of a name in a small literal map."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), name)


def specifications(planned: DataFrame, parts: dict[str, dict[str, dict]], *, invocation: str = "", version: str = "v1", commit: str = "unknown") -> DataFrame:
    """What each run was made of: its name, operators and settings by part (settings as JSON with keys in order), and how it was started."""
    name = {part: F.col(part if part == "dataset" else f"{part}_name") for part in parts}
    plugin = {part: F.coalesce(chosen({n: str(s.get("plugin", n)) for n, s in known.items()}, name[part]), name[part]) for part, known in parts.items()}
    config = {part: chosen({n: json.dumps(s, sort_keys=True) for n, s in known.items()}, name[part]) for part, known in parts.items()}
    return planned.select(
        F.lit(version).alias("schema_version"), F.col("run_name").alias("run_id"), F.current_timestamp().alias("created_at"), "fidelity_mode", F.lit(invocation).alias("cli_invocation"), F.lit(commit).alias("git_commit"),
        F.create_map(*[x for p in parts for x in (F.lit(p), plugin[p])]).alias("selected_plugins"), F.create_map(*[x for p in parts for x in (F.lit(p), config[p])]).alias("selected_configs"),
    )


def dataset_reports(loaded: DataFrame, by: list[str], rejects: DataFrame | None = None, done: DataFrame | None = None, keys: tuple[str, ...] = runs.RUN_KEYS) -> DataFrame:
    """For each group of ``by``: loaded, selected, skipped (a log has them by ``keys``) and failed rows, failure_reasons (how many of each)
    and warnings. Rejects count by their ``reason``; the rows themselves stay in their table, so a report does not grow with them."""
    rest = runs.resumed(loaded, done, keys)
    counts = loaded.select(*by, F.lit(1).alias("loaded"), F.lit(0).alias("selected")).unionByName(rest.select(*by, F.lit(0).alias("loaded"), F.lit(1).alias("selected")))
    out = counts.groupBy(*by).agg(F.sum("loaded").alias("loaded"), F.sum("selected").alias("selected"))
    none = F.expr("cast(map() as map<string,bigint>)")
    if rejects is None:
        out = out.withColumns({"failed": F.lit(0).cast("long"), "failure_reasons": none})
    else:
        reasons = rejects.groupBy(*by, "reason").agg(F.count("*").alias("n")).groupBy(*by)
        reasons = reasons.agg(F.sum("n").alias("failed"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("reason", F.lit("unknown")), "n")))).alias("failure_reasons"))
        out = out.join(reasons, by, "full")
    for c in ("loaded", "selected", "failed"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    skipped = F.col("loaded") - F.col("selected")
    note = F.concat(F.lit("resume_detected: skipped "), skipped.cast("string"), F.lit(" completed instance(s)"))
    return out.select(*by, "loaded", "selected", skipped.alias("skipped"), "failed", F.coalesce("failure_reasons", none).alias("failure_reasons"), F.when(skipped > 0, F.array(note)).otherwise(F.expr("cast(array() as array<string>)")).alias("warnings"))


def patch_records(rows: DataFrame, by: list[str], applied: DataFrame | None = None, patches: tuple[str, ...] = ("ori_patch", "adv_patch", "final_patch"), *, keep: bool = False) -> DataFrame:
    """by, the patches (if ``keep``), their hashes, and apply_status: whether the final patch was applied, and what was said of it.

    applied: (by, applied, message) of those that were tried. One that is left and was not tried is ``not_applied_yet``; where the defense
    left none, ``rejected``, whatever the log says."""
    hashes = [F.sha2(F.coalesce(F.col(p), F.lit("")), 256).alias(f"{p}_hash") for p in patches]
    if applied is None:
        rows = rows.withColumns({"_applied": F.lit(None).cast("boolean"), "_message": F.lit(None).cast("string")})
    else:
        rows = rows.join(applied.select(*by, F.col("applied").alias("_applied"), F.col("message").alias("_message")), by, "left")
    left = F.col(patches[-1]).isNotNull()
    tried = left & F.col("_applied").isNotNull()
    message = F.when(~left, "rejected").when(tried, F.coalesce("_message", F.lit(""))).otherwise("not_applied_yet")
    return rows.select(*by, *(patches if keep else ()), *hashes, F.struct(F.coalesce(tried & F.col("_applied"), F.lit(False)).alias("applied"), message.alias("message")).alias("apply_status"))
