"""Runs as joins: the attack phase makes a row for each instance, the defense phase adds what was decided and found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlark.functions import text as T
from spanlark.operators import attacks, policies, relational
from spanlark.sources import readers

#: The columns of a result row, in order.
RESULT = [
    "dataset", "split", "instance_id", "repo_id", "base_commit", "agent_name", "agent_config_hash", "attack_name", "attack_config_hash", "attack_mode", "baseline_name", "baseline_config_hash", "fidelity_mode",
    "attack_provider", "attack_model", "attack_prompt_hash", "attack_response_hash", "attack_artifact_path", "attack_cache_hit", "attack_cache_key", "attack_provider_fallback", "attack_tool_blocked",
    "attack_token_usage", "attack_objective_tags", "attack_stealth_constraints", "attack_selected_patch_id", "attack_source_json_path", "attack_source_json_hash", "original_prompt_hash", "adv_prompt_hash",
    "ori_patch_hash", "adv_patch_hash", "patch_hash", "edited_patch_hash", "ori_agent_metadata", "adv_agent_metadata", "defense_decision", "defense_signals", "tests_passed", "test_log_path",
    "static_findings_count", "static_findings_path", "static_tool_signals", "patch_artifacts", "judge_artifact_path", "timestamp_start", "timestamp_end", "runtime_sec",
]
FLAGS = ("attack_cache_hit", "attack_provider_fallback", "attack_tool_blocked", "tests_passed")


def finding_counts(outputs: DataFrame, key: str, tools: list[str]) -> DataFrame:
    """Findings of each tool's JSON output (a list ``results``) and in all; output that is no such JSON counts 0, a tool without
    output is null."""
    size = lambda c: F.coalesce(F.size(F.try_variant_get(F.try_parse_json(F.col(c)), "$.results", "array<variant>")), F.lit(0))
    counts = {f"{t}_findings": F.when(F.col(t).isNotNull(), F.greatest(size(t), F.lit(0))) for t in tools}
    out = outputs.select(key, *[c.alias(n) for n, c in counts.items()])
    return out.withColumn("total_findings", sum((F.coalesce(F.col(n), F.lit(0)) for n in counts), F.lit(0)))


#: Settings that tell one run from another in a log of results, and what a row is about.
ATTACK_KEYS = ("dataset", "agent_config_hash", "attack_config_hash", "fidelity_mode")
RUN_KEYS = (*ATTACK_KEYS, "baseline_config_hash")


def resumed(planned: DataFrame, done: DataFrame | None, keys: tuple[str, ...] = RUN_KEYS) -> DataFrame:
    """Planned rows without those that a log has: of the same instance and of a run with the same settings. Settings that neither side has
    count as equal; ones that only the plan has, as not done."""
    if done is None:
        return planned
    used = [k for k in keys if k in planned.columns]
    if missing := [k for k in used if k not in done.columns]:
        done = done.withColumns({k: F.lit(None).cast("string") for k in missing})
    log = done.select("instance_id", *used).distinct()
    same = [planned[k].eqNullSafe(log[k]) for k in ("instance_id", *used)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return planned.join(log, condition, "left_anti")


def patched(rows: DataFrame, agent: Callable[..., DataFrame], prompt: str, name: str, inputs: dict | None = None) -> DataFrame:
    """Adds an agent's patch for a prompt as the column ``name``; an agent keeps all rows and adds ``patch``."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "patch"]
    return agent(rows, prompt, **(inputs or {})).select(*kept, F.col("patch").alias(name))


def finish_attack(rows: DataFrame, prebuilt: DataFrame | None, by: list[str]) -> DataFrame:
    """A prebuilt patch stands in for the agent's where it is not blank; then the hashes."""
    if prebuilt is not None:
        rows = rows.join(prebuilt.select(*by, F.col("patch").alias("_prebuilt")), by, "left")
        rows = rows.withColumn("adv_patch", F.coalesce(T.blank_to_null(F.col("_prebuilt")), "adv_patch")).drop("_prebuilt")
    digest = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")), 256)
    return rows.withColumns({"ori_patch_hash": digest("ori_patch"), "adv_patch_hash": digest("adv_patch"), "patch_hash": digest("adv_patch")})


def run_attack(instances: DataFrame, attack: str, agent: Callable[..., DataFrame], *, replies: DataFrame | None = None, prebuilt: DataFrame | None = None, agent_name: str = "dummy", settings: dict[str, str] | None = None,
               agent_inputs: dict | None = None, notes: dict[str, str] | None = None, done: DataFrame | None = None) -> DataFrame:
    """The attack phase: instances (instance_id, prompt, ...) with adv_prompt, the agent's patches for both prompts, and their hashes.

    replies: (instance_id, reply) of the generator's model. prebuilt: (instance_id, patch), which stands in for the agent's
    patch where it is not blank. ``agent`` adds a column ``patch`` for the prompt in a column. done: a log of attacked rows."""
    rows = resumed(instances.withColumns({k: F.lit(v) for k, v in (settings or {}).items()}), done, ATTACK_KEYS)
    rows = rows if replies is None else rows.join(replies.select("instance_id", F.col("reply").alias("_reply")), "instance_id", "left")
    rows = attacks.generate(rows, attack, "prompt", "_reply" if replies is not None else None, notes).drop("_reply")
    rows = patched(patched(rows, agent, "prompt", "ori_patch", agent_inputs), agent, "adv_prompt", "adv_patch", agent_inputs)
    return finish_attack(rows.withColumn("agent_name", F.lit(agent_name)), prebuilt, ["instance_id"])


def finish_defense(rows: DataFrame, decisions: DataFrame, by: list[str], tests: DataFrame | None, findings: DataFrame | None, reruns: DataFrame | None) -> DataFrame:
    rows = rows.join(decisions.select(*by, F.col("decision").alias("_decision"), F.col("edited_text").alias("_edited")), by, "left")
    rows = rows.join(reruns.select(*by, F.col("patch").alias("_rerun")), by, "left") if reruns is not None else rows.withColumn("_rerun", F.lit(None).cast("string"))
    rows = policies.resolve(rows.withColumn("_decision", F.coalesce("_decision", F.lit("reject"))), "_decision", "_edited", "adv_patch", "_rerun")
    edited = F.col("outcome").isin("edit_patch", "edit_prompt")
    rows = rows.withColumn("defense_decision", F.when(edited, "edit").otherwise(F.col("outcome")))
    rows = rows.withColumn("edited_patch_hash", F.when(edited, F.sha2(F.coalesce("final_patch", F.lit("")), 256)).otherwise(""))
    for table, column, empty in ((tests, "tests_passed", False), (findings, "static_findings_count", 0)):
        if table is not None:
            rows = rows.join(table.select(*by, F.col(column).alias(f"_{column}")), by, "left")
        found = F.col(f"_{column}") if table is not None else F.lit(None)
        rows = rows.withColumn(column, F.coalesce(F.when(F.col("final_patch").isNotNull(), found), F.lit(empty)))
    return rows.drop("_decision", "_edited", "_rerun", "_tests_passed", "_static_findings_count")


def run_defense(attacked: DataFrame, decisions: DataFrame, baseline: str, *, settings: dict[str, str] | None = None, done: DataFrame | None = None, tests: DataFrame | None = None, findings: DataFrame | None = None, reruns: DataFrame | None = None) -> DataFrame:
    """The defense phase, one row for each attacked row that has no result yet with this baseline and these settings.

    decisions: (instance_id, decision, edited_text). reruns: (instance_id, patch) for prompts that the defense edited. tests:
    (instance_id, tests_passed), findings: (instance_id, static_findings_count); both count only where a patch is left."""
    named = {"baseline_name": baseline, "baseline_config_hash": baseline} | (settings or {})
    rows = resumed(attacked.withColumns({k: F.lit(v) for k, v in named.items()}), done)
    return finish_defense(rows, decisions, ["instance_id"], tests, findings, reruns)


def run_one(instances: DataFrame, attack: str, agent: Callable, defense: Callable[[DataFrame], DataFrame], baseline: str, *, replies: DataFrame | None = None, prebuilt: DataFrame | None = None, **more) -> DataFrame:
    """Both phases; ``defense`` adds decision (and maybe edited_text) to attacked rows."""
    first = {k: more.pop(k) for k in ("agent_name", "settings", "agent_inputs", "notes") if k in more}
    attacked = run_attack(instances, attack, agent, replies=replies, prebuilt=prebuilt, **first)
    decided = defense(attacked)
    return run_defense(attacked, decided if "edited_text" in decided.columns else decided.withColumn("edited_text", F.lit(None).cast("string")), baseline, **more)


def any_agent(rows: DataFrame, prompt: str, outputs: DataFrame | None = None) -> DataFrame:
    """Adds the patch of each row's ``agent_name``: the toy agent for ``dummy``, else what was captured of a command-line agent."""
    rows = readers.cli_agent(rows, prompt, outputs).withColumnRenamed("patch", "_captured")
    return attacks.toy_agent(rows, prompt).withColumn("patch", F.when(F.col("agent_name") == "dummy", F.col("patch")).otherwise(F.col("_captured"))).drop("_captured")


AXES = ("dataset", "agent_name", "attack_name", "baseline_name", "fidelity_mode")


def matrix_runs(spark: SparkSession, axes: dict[str, list[str]], hashes: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """A row for each run: its number and name, its axes, and the hash of each part's settings (the part's name where none is given)."""
    unknown = [a for a in axes if a not in AXES]
    if unknown or not all(axes.values()):
        raise ValueError(f"axes are {', '.join(AXES)}, each with at least one value")
    full = {a: axes.get(a, ["default"]) for a in AXES}
    for name in full["attack_name"]:
        attacks.check_generator(name)
    runs = relational.matrix(spark, full)
    for part in ("agent", "attack", "baseline"):
        name, known = F.col(f"{part}_name"), (hashes or {}).get(part, {})
        chosen = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), name) if known else F.lit(None).cast("string")
        runs = runs.withColumn(f"{part}_config_hash", F.coalesce(chosen, name))
    return runs


def run_matrix(instances: DataFrame, runs: DataFrame, agent: Callable[..., DataFrame], decisions: DataFrame, *, replies: DataFrame | None = None, prebuilt: DataFrame | None = None, tests: DataFrame | None = None, findings: DataFrame | None = None,
               reruns: DataFrame | None = None, done: DataFrame | None = None, agent_inputs: dict | None = None, notes: dict[str, str] | None = None) -> DataFrame:
    """All runs of ``matrix_runs`` in one plan, whatever their number: runs are rows, and instances meet those of their dataset.

    decisions, tests, findings, reruns: as in ``run_defense``, by run_name and instance_id. replies: (attack_name, instance_id, reply).
    ``agent`` sees the row's ``agent_name``. done: a log of results; each run resumes by its own settings. Attacked
    rows are made once for the runs that share dataset, agent, attack and fidelity, and dealt out to their baselines after."""
    attack_side = ["dataset", "agent_name", "attack_name", "fidelity_mode", "agent_config_hash", "attack_config_hash"]
    plan = instances.join(F.broadcast(runs), "dataset")  # a few runs: the product of the axes
    plan = resumed(plan.select("instance_id", *runs.columns), done)
    wanted = plan.select("instance_id", *attack_side).distinct()
    rows = instances.join(wanted, ["dataset", "instance_id"])
    rows = rows if replies is None else rows.join(replies.select("attack_name", "instance_id", F.col("reply").alias("_reply")), ["attack_name", "instance_id"], "left")
    rows = attacks.generate(rows, F.col("attack_name"), "prompt", "_reply" if replies is not None else None, notes).drop("_reply")
    rows = patched(patched(rows, agent, "prompt", "ori_patch", agent_inputs), agent, "adv_prompt", "adv_patch", agent_inputs)
    attacked = finish_attack(rows, prebuilt, ["dataset", "instance_id"])
    each = attacked.join(plan.select("instance_id", *attack_side, "index", "run_name", "baseline_name", "baseline_config_hash"), ["instance_id", *attack_side])
    return finish_defense(each, decisions, ["run_name", "instance_id"], tests, findings, reruns)


def result_rows(df: DataFrame) -> DataFrame:
    """The columns of a result in order; what a run has not made is an empty text, and false or 0 where it is a flag or a number."""
    def empty(c: str) -> Column:
        return F.lit(False) if c in FLAGS else F.lit(0) if c == "static_findings_count" else F.lit(0.0) if c == "runtime_sec" else F.lit("")

    return df.select(*[F.coalesce(F.col(c), empty(c)).alias(c) if c in df.columns else empty(c).alias(c) for c in RESULT])


def check_settings(settings: dict, purpose: str) -> None:
    """Settings for inference may not hold those for training, which need both of these."""
    sections = ("data_preparation", "training")
    if purpose == "inference" and (found := [s for s in sections if s in settings]):
        raise ValueError(f"settings for inference hold {', '.join(found)}, which are for training")
    if purpose == "training" and (missing := [s for s in sections if s not in settings]):
        raise ValueError(f"settings for training lack {', '.join(missing)}")


def check_no_fit(eval_only: bool, stage: str) -> None:
    """Nothing is fitted in a run that only evaluates."""
    if eval_only and stage.strip().lower().startswith("fit"):
        raise RuntimeError(f"{stage} may not run: this run only evaluates")
