"""Queries over what is written down of runs beside their results, and over masked code, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from spanlark.operators import runs, settings, similarity
from spanlark.plans.queries import query

WARNING = "'resume_detected: skipped ' || skipped || ' completed instance(s)'"


@query(f"""WITH l AS (SELECT source, count(*) AS loaded, count(*) FILTER (WHERE n_chars % 7 > 0) AS selected FROM documents WHERE n_chars % 5 > 0 GROUP BY 1),
x AS (SELECT source, count(*) AS failed, count(*) FILTER (WHERE n_chars % 2 = 0) AS a, count(*) FILTER (WHERE n_chars % 2 = 1) AS b FROM documents WHERE n_chars % 5 = 0 GROUP BY 1),
j AS (SELECT source, coalesce(loaded, 0) AS loaded, coalesce(selected, 0) AS selected, coalesce(loaded - selected, 0) AS skipped, coalesce(failed, 0) AS failed, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM l FULL JOIN x USING (source))
SELECT source AS dataset, loaded, selected, skipped, failed, concat_ws(', ', CASE WHEN a > 0 THEN 'invalid JSON=' || a END, CASE WHEN b > 0 THEN 'no repository path=' || b END) AS reasons, CASE WHEN skipped > 0 THEN {WARNING} ELSE '' END AS warnings FROM j""")
def dataset_reports(t):
    docs = t("documents").select(F.col("doc_id").alias("instance_id"), F.col("source").alias("dataset"), "n_chars")
    loaded = docs.where("n_chars % 5 > 0").withColumn("baseline_config_hash", F.lit("gate"))
    bad = docs.where("n_chars % 5 = 0").withColumn("reason", F.expr("CASE WHEN n_chars % 2 = 0 THEN 'invalid JSON' ELSE 'no repository path' END"))
    log = lambda rows, baseline: docs.where(rows).select("instance_id", "dataset", F.lit(baseline).alias("baseline_config_hash"))
    out = settings.dataset_reports(loaded, ["dataset"], bad, log("n_chars % 7 = 0", "gate").unionByName(log("n_chars % 3 = 0", "wall")))
    reasons = F.array_join(F.transform(F.map_entries("failure_reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ", ")
    return out.select("dataset", "loaded", "selected", "skipped", "failed", reasons.alias("reasons"), F.array_join("warnings", ", ").alias("warnings"))


@query("""SELECT doc_id, sha256(source) AS ori_patch_hash, sha256(lang) AS adv_patch_hash, sha256(CASE WHEN n_chars % 4 > 0 THEN source || lang ELSE '' END) AS final_patch_hash, n_chars % 4 > 0 AND n_chars % 3 = 1 AS applied,
 CASE WHEN n_chars % 4 = 0 THEN 'rejected' WHEN n_chars % 3 = 0 THEN 'not_applied_yet' WHEN n_chars % 3 = 1 THEN '' ELSE 'hunk ' || (n_chars % 9) || ' failed' END AS message FROM documents""")
def patch_records(t):
    docs = t("documents").withColumns({"ori_patch": F.col("source"), "adv_patch": F.col("lang"), "final_patch": F.expr("CASE WHEN n_chars % 4 > 0 THEN concat(source, lang) END")})
    applied = t("documents").where("n_chars % 3 > 0").selectExpr("doc_id", "n_chars % 3 = 1 AS applied", "CASE WHEN n_chars % 3 = 2 THEN concat('hunk ', n_chars % 9, ' failed') END AS message")
    return settings.patch_records(docs, ["doc_id"], applied).select("doc_id", "ori_patch_hash", "adv_patch_hash", "final_patch_hash", "apply_status.applied", "apply_status.message")


AGENTS = {"dummy": {"plugin": "dummy", "style": "add_fix"}, "dummy2": {"plugin": "dummy", "style": "add_fix_alt", "é": [1, 0.5, None]}}
ATTACKS = {"none": {}, "swexploit": settings.with_prebuilt({"plugin": "swexploit", "mode": "llm"}, "/p.jsonl")}


def _json(part: dict) -> str:
    """The JSON that a hash is of, with its keys in order, as an SQL text."""
    return "'" + json.dumps(part, sort_keys=True, separators=(",", ":")) + "'"


@query(f"""WITH r AS (SELECT ds, g, a, row_number() OVER (ORDER BY di, gi, ai) AS i FROM (SELECT lang AS ds, row_number() OVER (ORDER BY lang) AS di FROM (SELECT DISTINCT lang FROM documents WHERE lang IN ('de', 'en'))), (VALUES (0, 'dummy'), (1, 'dummy2')) y(gi, g), (VALUES (0, 'none'), (1, 'swexploit')) z(ai, a))
SELECT ds AS dataset, g AS agent_name, a AS attack_name, 'dummy' AS agent, a AS attack, sha256(CASE g WHEN 'dummy' THEN {_json(AGENTS["dummy"])} ELSE {_json(AGENTS["dummy2"])} END) AS agent_config_hash,
 sha256(CASE a WHEN 'none' THEN {_json(ATTACKS["none"])} ELSE {_json(ATTACKS["swexploit"])} END) AS attack_config_hash, count(*)::BIGINT AS instances FROM r JOIN documents d ON d.lang = ds GROUP BY ALL""")
def run_specifications(t):
    parts = {"dataset": {"de": {}, "en": {}}, "agent": AGENTS, "attack": ATTACKS, "baseline": {"gate": {"reject_threshold": 0.5}}}
    docs = t("documents").select(F.col("lang").alias("dataset"))
    axes = {name if name == "dataset" else f"{name}_name": list(known) for name, known in parts.items()}
    planned = runs.matrix_runs(docs.sparkSession, axes, {p: {n: settings.digest(s) for n, s in known.items()} for p, known in parts.items()})
    specs = settings.specifications(planned, parts).select(F.col("run_id").alias("run_name"), F.col("selected_plugins.agent").alias("agent"), F.col("selected_plugins.attack").alias("attack"))
    each = docs.join(F.broadcast(planned.join(specs, "run_name")), "dataset")  # eight runs
    return each.groupBy("dataset", "agent_name", "attack_name", "agent", "attack", "agent_config_hash", "attack_config_hash").agg(F.count("*").alias("instances"))


@query("""SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN 'VAR = VAR() == VAR' || chr(10) WHEN 1 THEN 'return VAR[STR] != [] + NUM' || chr(10) WHEN 2 THEN 'import ' || source END AS text FROM documents""")
def masked_code(t):
    code = "CASE n_chars % 4 WHEN 0 THEN concat('x', doc_id, ' = load() == ', lang) WHEN 1 THEN concat('return g_', lang, '[\"', source, '\"] != [] + ', n_chars) WHEN 2 THEN concat('import ', source) END"
    return similarity.masked(t("documents").select("doc_id", F.expr(code).alias("text")), "text")
