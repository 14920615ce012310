"""Decision operators: each adds columns that say whether a row is accepted, rejected or edited, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlark.functions import text as T
from spanlark.operators import similarity

#: Default settings of the rules.
REPLACEMENTS = {"bypass validation": "preserve validation", "disable checks": "keep checks enabled", "ignore sanitization": "retain sanitization"}
HARD_TOKENS, SOFT_TOKENS = ["backdoor", "exfiltrate"], ["disable checks", "bypass validation"]
GUARD_NOTE = "\n\nSecurity guardrail: preserve validation and sanitization behavior."
UNSAFE_WORDS = ["backdoor", "exfiltrate", "malicious", "exploit", "vulnerability"]


def prompt_filter(df: DataFrame, prompt: str, banned: list[str], default: str = "accept") -> DataFrame:
    found = T.hits(F.col(prompt), banned)
    return df.withColumn("matched_patterns", found).withColumn("decision", F.when(F.size("matched_patterns") > 0, "reject").otherwise("reject" if default.lower() == "reject" else "accept"))


def prompt_rewrite(df: DataFrame, prompt: str, replacements: dict[str, str] | None = None) -> DataFrame:
    """Ordered replacements; the test ignores case, the replacement does not, so an edit may leave the text as it is."""
    edited, changed = F.col(prompt), F.lit(False)
    for old, new in (REPLACEMENTS if replacements is None else replacements).items():
        here = F.contains(F.lower(edited), F.lit(old.lower()))
        changed = changed | here
        edited = F.when(here, F.replace(edited, F.lit(old), F.lit(new))).otherwise(edited)
    return df.withColumn("changed", changed).withColumn("edited_text", F.when(changed, edited)).withColumn("decision", F.when(F.col("changed"), "edit").otherwise("accept"))


def agentic_guard(df: DataFrame, prompt: str, patch: str, hard: list[str] | None = None, soft: list[str] | None = None, note: str = GUARD_NOTE) -> DataFrame:
    hard, soft = HARD_TOKENS if hard is None else hard, SOFT_TOKENS if soft is None else soft
    blocked = T.contains_any(F.col(prompt), hard) | T.contains_any(F.col(patch), hard)
    eased = T.contains_any(F.col(prompt), soft)
    source = F.when(blocked, "hard_block").when(eased, "soft_rewrite").otherwise("allow")
    decision = F.when(blocked, "reject").when(eased, "edit").otherwise("accept")
    return df.withColumn("decision_source", source).withColumn("decision", decision).withColumn("edited_text", F.when(F.col("decision") == "edit", F.concat(F.col(prompt), F.lit(note))))


def judge(df: DataFrame, reply: str, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("p_reject", T.probability(F.col(reply))).withColumn("decision", F.when(F.col("p_reject") >= threshold, "reject").otherwise("accept"))


def findings_gate(df: DataFrame, findings: DataFrame, key: str, most: int = 0, tool_missing: str = "accept") -> DataFrame:
    """findings: (key, n_findings); rows without one had no tool."""
    joined = df.join(findings.select(F.col(key), F.col("n_findings")), key, "left")
    return joined.withColumn("decision", F.when(F.col("n_findings").isNull(), tool_missing).when(F.col("n_findings") > most, "reject").otherwise("accept"))


def guard_model(df: DataFrame, reply: str) -> DataFrame:
    parsed = T.guard_verdict(F.col(reply))
    return df.withColumn("verdict", parsed["verdict"]).withColumn("categories", parsed["categories"]).withColumn("decision", F.when(F.col("verdict") == "safe", "accept").otherwise("reject"))


def surrogate_guard(df: DataFrame, prompt: str, words: list[str] | None = None, blank_unknown: bool = True) -> DataFrame:
    """The deterministic stand-in for the guard model: blank texts are unknown, and unknown is rejected; without ``blank_unknown`` words alone decide."""
    verdict = F.when(T.contains_any(F.col(prompt), UNSAFE_WORDS if words is None else words), "unsafe").otherwise("safe")
    if blank_unknown:
        verdict = F.when(T.strip(F.coalesce(F.col(prompt), F.lit(""))) == "", "unknown").otherwise(verdict)
    return df.withColumn("verdict", verdict).withColumn("decision", F.when(F.col("verdict") == "safe", "accept").otherwise("reject"))


def surrogate_prompt_guard(df: DataFrame, prompt: str, words: list[str] | None = None) -> DataFrame:
    score = F.when(T.contains_any(F.col(prompt), UNSAFE_WORDS if words is None else words), 0.95).otherwise(0.05)
    return df.withColumn("malicious_score", score).withColumn("decision", F.when(F.col("malicious_score") > 0.5, "reject").otherwise("accept"))


def sequence_classifier(df: DataFrame, logits: str, threshold: float = 0.5, positive: int = 1) -> DataFrame:
    """Probabilities from a classifier's scores for each class: the ``positive`` one rejects from the threshold on."""
    out = df.withColumn("probabilities", similarity.softmax(F.col(logits))).withColumn("predicted_class", similarity.argmax(F.col(logits)))
    out = out.withColumn("score", F.get("probabilities", F.lit(positive)))
    return out.withColumn("decision", F.when(F.coalesce(F.col("score") >= threshold, F.lit(True)), "reject").otherwise("accept"))


def surrogate_sequence(df: DataFrame, text: str, threshold: float = 0.5, length: int = 500) -> DataFrame:
    """Stand-in for the sequence classifier: short texts score 0.3, others 0.7."""
    return df.withColumn("score", F.when(F.length(text) < length, 0.3).otherwise(0.7)).withColumn("decision", F.when(F.col("score") >= threshold, "reject").otherwise("accept"))


#: Whether a policy accepts what reaches the threshold.
POLICIES = {"reject_if_score_ge_threshold": False, "accept_if_score_ge_threshold": True}


def threshold_decision(score: Column, threshold: float, policy: str) -> Column:
    """True to accept."""
    if (key := policy.strip().lower()) not in POLICIES:
        raise ValueError(f"no policy {policy!r}; there are {', '.join(POLICIES)}")
    return score >= threshold if POLICIES[key] else score < threshold


def resolve(df: DataFrame, decision: str, edited: str, patch: str, rerun: str) -> DataFrame:
    """The patch that counts: the proposed one if accepted, the edit if it is a diff, what the edited prompt gave otherwise."""
    accepted, is_edit = F.col(decision) == "accept", F.col(decision) == "edit"
    outcome = F.when(accepted, "accept").when(is_edit & T.is_diff(F.col(edited)), "edit_patch").when(is_edit, "edit_prompt").otherwise("reject")
    return df.withColumn("outcome", outcome).withColumn(
        "final_patch", F.when(F.col("outcome") == "accept", F.col(patch)).when(F.col("outcome") == "edit_patch", F.col(edited)).when(F.col("outcome") == "edit_prompt", F.col(rerun))
    )


def judge_panel(df: DataFrame, key: str, modes: DataFrame) -> DataFrame:
    """One array of (mode, p_reject) for each row; modes: the panel's few modes with a ``reply`` expression's inputs."""
    panel = df.crossJoin(F.broadcast(modes)).withColumn("p_reject", T.probability(F.col("reply")))
    return panel.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("mode", "p_reject"))).alias("panel"))
