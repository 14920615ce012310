"""Adversarial prompts from given replies, turns that build on each other, and the agent for toy instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlark.functions import text as T
from spanlark.operators.relational import turn_roles

#: Names of generators, and whether they pass a prompt on to a model. What one adds to a prompt that its model left as it was is a parameter.
GENERATORS = {"none": False, "bug_reports": True, "fcv": True, "swexploit": True, "udora": True}
NOTE = "Additional context: (none given)."


#: The two patches of the toy agent.
TOY_PATCH = "diff --git a/toy_module.py b/toy_module.py\n--- a/toy_module.py\n+++ b/toy_module.py\n@@ -1,2 +1,2 @@\n def add(a, b):\n-    return a - b\n+    return %s\n"
TOY_STYLES = {"add_fix": TOY_PATCH % "a + b", "add_fix_alt": TOY_PATCH % "(a + b)"}


def check_generator(name: str) -> None:
    if name not in GENERATORS:
        raise ValueError(f"no generator {name!r}; there are {', '.join(GENERATORS)}")


def reworded(name: Column, prompt: Column, reply: Column | None, notes: dict[str, str] | None = None) -> Column:
    """The prompt that a row's generator hands on: the reply; without one the prompt; and one that changes nothing gets the generator's
    note. A generator without a model hands on the prompt."""
    if reply is None:
        return prompt
    given = F.coalesce(T.blank_to_null(T.strip(reply)), prompt)
    known = F.create_map(*[F.lit(x) for k, v in (notes or {}).items() for x in (k, v)]) if notes else F.lit(None).cast("map<string,string>")
    noted = F.concat(prompt, F.lit("\n\n"), F.coalesce(F.try_element_at(known, name), F.lit(NOTE)))
    modelled = name.isin(*[k for k, v in GENERATORS.items() if v])
    return F.when(modelled, F.when(given.eqNullSafe(prompt), noted).otherwise(given)).otherwise(prompt)


def generate(df: DataFrame, name: str | Column, prompt: str, reply: str | None = None, notes: dict[str, str] | None = None) -> DataFrame:
    """Adds adv_prompt, what made it, and the hashes of both prompts. ``name``: a generator, or a column that says it for each row."""
    if isinstance(name, str):
        check_generator(name)
    name = F.lit(name) if isinstance(name, str) else name
    out = df.withColumn("attack_name", name)
    out = out.withColumn("adv_prompt", reworded(F.col("attack_name"), F.col(prompt), F.col(reply) if reply else None, notes))
    mode = F.when(F.col("attack_name").isin(*[k for k, v in GENERATORS.items() if v]), "llm_prompt").otherwise("pass_through")
    return out.withColumns({"attack_mode": mode, "original_prompt_hash": F.sha2(F.col(prompt), 256), "adv_prompt_hash": F.sha2("adv_prompt", 256)})


def drafts(turns: DataFrame, key: str, turn: str, original: str, reply: str) -> DataFrame:
    """Adds to each turn its role, the draft that it was given and the one it left: a blank reply leaves the draft as it is."""
    upto = Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    given = T.blank_to_null(T.strip(F.col(reply)))
    left = F.coalesce(F.last(given, ignorenulls=True).over(upto), F.col(original))
    return turn_roles(turns, key, turn).withColumn("draft", F.coalesce(F.last(given, ignorenulls=True).over(before), F.col(original))).withColumn("left", left)


def finish(turns: DataFrame, key: str, turn: str, original: str, reply: str, flags: list[str], name: str = "udora", notes: dict[str, str] | None = None) -> DataFrame:
    """One row for each key: the prompt after its last turn, the number of turns, and which flags any turn has set."""
    last = drafts(turns, key, turn, original, reply).groupBy(key).agg(
        F.max_by("left", turn).alias("_left"), F.max_by(original, turn).alias("_original"), F.count("*").alias("num_turns"), *[F.bool_or(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags]
    )
    return last.withColumn("adv_prompt", reworded(F.lit(name), F.col("_original"), F.col("_left"), notes)).drop("_left", "_original")


def toy_agent(df: DataFrame, prompt: str, style: str = "add_fix") -> DataFrame:
    """Adds the patch that mends the toy module; a prompt that speaks of subtracting gets the other wording."""
    chosen = F.when(F.contains(F.lower(F.col(prompt)), F.lit("subtract")) | F.lit(style == "add_fix_alt"), "add_fix_alt").otherwise("add_fix")
    out = df.withColumn("patch_style", chosen)
    return out.withColumn("patch", F.when(F.col("patch_style") == "add_fix_alt", TOY_STYLES["add_fix_alt"]).otherwise(TOY_STYLES["add_fix"])).withColumn("prompt_preview", F.substring(prompt, 1, 240))
