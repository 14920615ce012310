"""Queries over runs: prompts, agents, phases, the structural defense and its parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlark.functions import patterns
from spanlark.functions import text as T
from spanlark.operators import attacks, defense, graphdiff, links, relational, runs, scoring
from spanlark.plans.queries import CANDIDATES, LINKS_SQL, SUBTASKS, _edges, _sizes, query, r6

NL = "' || chr(10) || '"
REPLIES = "CASE n_chars % 3 WHEN 0 THEN '  ' WHEN 1 THEN concat(' ', source, ' ') ELSE concat(' new ', lang) END"
NOTES = {name: f"note of {name}" for name in ("fcv", "swexploit", "udora")}
SUFFIX = NOTES["fcv"]
GENERATOR = "CASE doc_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'bug_reports' WHEN 2 THEN 'fcv' WHEN 3 THEN 'swexploit' ELSE 'udora' END"
ADV = f"""CASE WHEN doc_id % 5 = 0 THEN source WHEN n_chars % 3 = 2 THEN 'new ' || lang ELSE source || chr(10) || chr(10) || CASE doc_id % 5 WHEN 1 THEN '{attacks.NOTE}' ELSE 'note of ' || ({GENERATOR}) END END"""


@query(f"SELECT doc_id, {GENERATOR} AS attack_name, {ADV} AS adv_prompt, CASE WHEN doc_id % 5 = 0 THEN 'pass_through' ELSE 'llm_prompt' END AS attack_mode, sha256(source) AS original_prompt_hash, sha256({ADV}) AS adv_prompt_hash FROM documents")
def adversarial_prompts(t):
    rows = attacks.generate(t("documents").withColumn("reply", F.expr(REPLIES)), F.expr(GENERATOR), "source", "reply", NOTES)
    return rows.select("doc_id", "attack_name", "adv_prompt", "attack_mode", "original_prompt_hash", "adv_prompt_hash")


TOY = "diff --git a/toy_module.py b/toy_module.py|--- a/toy_module.py|+++ b/toy_module.py|@@ -1,2 +1,2 @@| def add(a, b):|-    return a - b|+    return %s|"
TOY_SQL = "replace('" + TOY + "', '|', chr(10))"


@query(f"""SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'add_fix_alt' ELSE 'add_fix' END AS patch_style, md5(CASE WHEN n_chars % 2 = 0 THEN {TOY_SQL % "(a + b)"} ELSE {TOY_SQL % "a + b"} END) AS patch, substr(CASE WHEN n_chars % 2 = 0 THEN 'Subtract ' || text ELSE 'Sum of ' || n_chars END, 1, 240) AS prompt_preview FROM documents""")
def toy_patches(t):
    rows = attacks.toy_agent(t("documents").withColumn("prompt", F.expr("CASE WHEN n_chars % 2 = 0 THEN concat('Subtract ', text) ELSE concat('Sum of ', n_chars) END")), "prompt")
    return rows.select("doc_id", "patch_style", F.md5("patch").alias("patch"), "prompt_preview")


def _turns(t) -> DataFrame:
    return t("conversations").withColumn("original", F.concat(F.lit("o"), "conv_id")).withColumn("reply", F.expr("CASE WHEN (conv_id + turn) % 3 = 0 THEN ' ' ELSE concat(role, ' ', turn) END"))


TURNS_SQL = """WITH r AS (SELECT conv_id, turn, 'o' || conv_id AS original, CASE WHEN (conv_id + turn) % 3 = 0 THEN NULL ELSE role || ' ' || turn END AS given, role FROM conversations),
d AS (SELECT *, coalesce(last_value(given IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), original) AS draft, coalesce(last_value(given IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), original) AS "left",
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM r) """


@query(TURNS_SQL + """SELECT conv_id, turn, CASE WHEN p = 1 THEN 'plan' WHEN p = n THEN 'finalize' ELSE 'critique' END AS turn_role, draft, "left" FROM d""")
def turn_drafts(t):
    return attacks.drafts(_turns(t), "conv_id", "turn", "original", "reply").select("conv_id", "turn", "turn_role", "draft", "left")


@query(TURNS_SQL + """SELECT conv_id, max(n)::BIGINT AS num_turns, bool_or(role = 'system') AS provider_fallback, bool_or(turn > 5) AS tool_blocked,
 arg_max(CASE WHEN "left" = original THEN original || chr(10) || chr(10) || 'Additional context: prioritize a minimal compatibility-oriented patch.' ELSE "left" END, turn) AS adv_prompt FROM d GROUP BY 1""")
def turn_rollup(t):
    rows = _turns(t).withColumn("provider_fallback", F.col("role") == "system").withColumn("tool_blocked", F.col("turn") > 5)
    return attacks.finish(rows, "conv_id", "turn", "original", "reply", ["provider_fallback", "tool_blocked"])


@query("""SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN 3 WHEN 2 THEN NULL ELSE 0 END::BIGINT AS bandit_findings, (n_chars % 3)::BIGINT AS semgrep_findings, (CASE n_chars % 4 WHEN 0 THEN 3 ELSE 0 END + n_chars % 3)::BIGINT AS total_findings FROM documents""")
def finding_counts(t):
    outputs = t("documents").selectExpr("doc_id", """CASE n_chars % 4 WHEN 0 THEN '{"results":[{"a":1},2,"x"],"errors":[]}' WHEN 1 THEN 'no json' WHEN 3 THEN '{}' END AS bandit""", """CASE n_chars % 3 WHEN 0 THEN '{"results":[]}' WHEN 1 THEN '{"results":[{}]}' ELSE '{"results":[null,{}]}' END AS semgrep""")
    return runs.finding_counts(outputs, "doc_id", ["bandit", "semgrep"]).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("bandit_findings", "semgrep_findings", "total_findings")])


@query("""SELECT lang, count(*)::BIGINT AS total_nodes, count(*) FILTER (n_chars % 4 = 0)::BIGINT AS suspicious_nodes, count(*) FILTER (n_chars % 4 IN (1, 2))::BIGINT AS benign_nodes, count(*) FILTER (n_chars % 5 = 0)::BIGINT AS test_nodes, count(*) FILTER (n_chars % 4 = 1)::BIGINT AS validation_nodes FROM documents GROUP BY 1""")
def severity_counts(t):
    nodes = t("documents").selectExpr("lang", "CASE WHEN n_chars % 5 = 0 THEN 'src/tests/a.py' ELSE 'src/a.py' END AS file", "'f' AS function", "CASE n_chars % 4 WHEN 0 THEN 'x = eval(s)' WHEN 1 THEN 'validate(x)' WHEN 2 THEN 'logger.info(x)' ELSE 'return x' END AS code_snippet")
    return defense.severity_summary(patterns.add_scores(nodes, F.col("code_snippet"), patterns.UNIVERSAL), "lang")


@query("""SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN 'own.py' WHEN 1 THEN source || '.py' ELSE '' END AS file, CASE n_chars % 3 WHEN 0 THEN lang WHEN 1 THEN lang ELSE '' END AS function FROM documents""")
def id_backfill(t):
    nodes = t("documents").selectExpr("doc_id", "CASE n_chars % 3 WHEN 2 THEN source ELSE concat(source, '.py::', lang, '::n1') END AS node_id", "CASE n_chars % 3 WHEN 0 THEN 'own.py' WHEN 1 THEN ' ' END AS file", "CAST(NULL AS STRING) AS function")
    return defense.placed(nodes).select("doc_id", "file", "function")


@query("""SELECT doc_id, CASE n_chars % 6 WHEN 0 THEN NULL WHEN 1 THEN 'links must be a list' WHEN 2 THEN 'link 1 must be an object' WHEN 3 THEN 'link 0 has no integer subtask_index' WHEN 4 THEN 'link 0 has no list of node_ids' ELSE 'link 0 has a node id that is no text' END AS error FROM documents""")
def link_errors(t):
    good = '{"subtask_index":0,"node_ids":["a"]}'
    reply = F.expr(f"""CASE n_chars % 6 WHEN 0 THEN '[{good}]' WHEN 1 THEN '{{"links":[]}}' WHEN 2 THEN '[{good},3]' WHEN 3 THEN '[{{"subtask_index":"0","node_ids":[]}}]' WHEN 4 THEN '[{{"subtask_index":0,"node_ids":"a"}}]' ELSE '[{{"subtask_index":0,"node_ids":["a",1]}}]' END""")
    return t("documents").select("doc_id", defense.link_error(reply).alias("error"))


NO_SECURITY = defense.feature_columns("no_security")
KNOWN = [c for c in NO_SECURITY if c in (*links.STRUCTURAL, "link_density", "gini_nodes", "max_links_per_node")]


@query(LINKS_SQL + "SELECT instance, " + ", ".join(f"round({c if c in KNOWN else 0}::DOUBLE, 6) AS {c}" for c in NO_SECURITY) + " FROM f")
def feature_modes(t):
    rows = links.link_features(_edges(t), _sizes(t), "instance").select("instance", *KNOWN)
    return defense.with_features(rows, "instance", NO_SECURITY).select("instance", *[r6(c).alias(c) for c in NO_SECURITY])


@query("""WITH e AS (SELECT l_suppkey AS instance, l_linenumber - 1 AS s, l_partkey % 97 AS n FROM lineitem) SELECT instance, s::BIGINT AS subtask_index, 'step ' || s AS subtask, 'code ' || n AS code_snippet, count(*)::BIGINT AS links FROM e WHERE s < 5 AND n % 3 > 0 GROUP BY ALL""")
def link_texts(t):
    subtasks = t("supplier").select(F.col("s_suppkey").alias("instance"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("subtask_index")).withColumn("subtask", F.concat(F.lit("step "), "subtask_index"))
    nodes = t("supplier").select(F.col("s_suppkey").alias("instance"), F.explode(F.sequence(F.lit(0), F.lit(96))).alias("n")).selectExpr("instance", "concat('f.py::g::n', n) AS node_id", "CASE WHEN n % 3 = 0 THEN '' ELSE concat('code ', n) END AS code_snippet")
    rows = defense.linked_texts(_edges(t), subtasks, nodes, "instance")
    return rows.groupBy("instance", F.col("subtask_index").cast("long").alias("subtask_index"), "subtask", "code_snippet").agg(F.count("*").alias("links"))


# ---- phases


def _instances(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("instance_id"), F.col("source").alias("prompt"), "lang", "n_chars")


def _attacked(t) -> DataFrame:
    docs = t("documents")
    replies = docs.where("n_chars % 7 > 0").select(F.col("doc_id").alias("instance_id"), F.expr(REPLIES).alias("reply"))
    prebuilt = docs.where("n_chars % 5 < 2").select(F.col("doc_id").alias("instance_id"), F.expr("CASE n_chars % 5 WHEN 0 THEN concat('--- a/x', chr(10), '+++ b/x', chr(10), '@@ ', n_chars) ELSE ' ' END").alias("patch"))
    return runs.run_attack(_instances(t), "fcv", attacks.toy_agent, replies=replies, prebuilt=prebuilt, notes=NOTES, settings={"dataset": "toy", "split": "test"})


PHASE_SQL = f"""WITH a AS (SELECT doc_id AS instance_id, n_chars, CASE WHEN n_chars % 7 > 0 AND n_chars % 3 = 2 THEN 'new ' || lang ELSE source || chr(10) || chr(10) || '{SUFFIX}' END AS adv_prompt, {TOY_SQL % "a + b"} AS ori,
 CASE WHEN n_chars % 5 = 0 THEN '--- a/x' || chr(10) || '+++ b/x' || chr(10) || '@@ ' || n_chars ELSE {TOY_SQL % "a + b"} END AS adv FROM documents) """


@query(PHASE_SQL + "SELECT instance_id, 'toy' AS dataset, 'dummy' AS agent_name, 'fcv' AS attack_name, sha256(adv_prompt) AS adv_prompt_hash, sha256(ori) AS ori_patch_hash, sha256(adv) AS adv_patch_hash, sha256(adv) AS patch_hash FROM a")
def run_attack(t):
    return _attacked(t).select("instance_id", "dataset", "agent_name", "attack_name", "adv_prompt_hash", "ori_patch_hash", "adv_patch_hash", "patch_hash")


def _results(t) -> DataFrame:
    docs = t("documents").withColumnRenamed("doc_id", "instance_id")
    decisions = docs.select("instance_id", F.expr("CASE n_chars % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'edit' END").alias("decision"), F.expr("CASE n_chars % 4 WHEN 2 THEN concat('--- a/y', chr(10), '+++ b/y', chr(10), '@@ ', n_chars) WHEN 3 THEN 'write it anew' END").alias("edited_text"))
    reruns = docs.where("n_chars % 4 = 3").select("instance_id", F.concat(F.lit("again "), "n_chars").alias("patch"))
    tests, findings = docs.select("instance_id", (F.col("n_chars") % 2 == 0).alias("tests_passed")), docs.select("instance_id", (F.col("n_chars") % 9).alias("static_findings_count"))
    # only results of this baseline on this dataset count as done
    log = docs.where("n_chars % 11 = 0 OR n_chars % 13 = 0").select("instance_id", F.expr("CASE WHEN n_chars % 22 = 11 THEN 'other' ELSE 'toy' END").alias("dataset"), F.expr("CASE WHEN n_chars % 11 = 0 THEN 'gate' ELSE 'another gate' END").alias("baseline_config_hash"))
    return runs.run_defense(_attacked(t), decisions, "gate", done=log, tests=tests, findings=findings, reruns=reruns)


RESULTS_SQL = PHASE_SQL + """, d AS (SELECT *, CASE n_chars % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'edit' END AS defense_decision, CASE n_chars % 4 WHEN 0 THEN adv WHEN 2 THEN '--- a/y' || chr(10) || '+++ b/y' || chr(10) || '@@ ' || n_chars WHEN 3 THEN 'again ' || n_chars END AS final FROM a WHERE n_chars % 22 > 0) """


@query(RESULTS_SQL + "SELECT instance_id, 'gate' AS baseline_name, defense_decision, md5(final) AS final_patch, CASE WHEN defense_decision = 'edit' THEN sha256(final) ELSE '' END AS edited_patch_hash, coalesce(final IS NOT NULL AND n_chars % 2 = 0, false) AS tests_passed, CASE WHEN final IS NULL THEN 0 ELSE n_chars % 9 END::BIGINT AS static_findings_count FROM d")
def run_defense(t):
    return _results(t).select("instance_id", "baseline_name", "defense_decision", F.md5("final_patch").alias("final_patch"), "edited_patch_hash", "tests_passed", F.col("static_findings_count").cast("long").alias("static_findings_count"))


@query(RESULTS_SQL + "SELECT dataset, split, baseline_name, fidelity_mode, defense_decision, tests_passed, count(*)::BIGINT AS n FROM (SELECT 'toy' AS dataset, 'test' AS split, 'gate' AS baseline_name, '' AS fidelity_mode, defense_decision, final IS NOT NULL AND n_chars % 2 = 0 AS tests_passed FROM d) GROUP BY ALL")
def result_summary(t):
    rows = relational.summary(runs.result_rows(_results(t)))
    return rows.groupBy("dataset", "split", "baseline_name", "fidelity_mode", "defense_decision", "tests_passed").agg(F.count("*").alias("n"))


# Outputs of one command-line agent, for original prompts only, a diff in every other one.
CLI_DIFF = "concat('--- a/z', chr(10), '+++ b/z', chr(10), '@@ ', n_chars)"
MATRIX = {"dataset": ["toy", "swebench_lite"], "agent_name": ["dummy", "openhands"], "attack_name": ["none", "udora"], "baseline_name": ["gate", "wall"]}


@query(f"""WITH d AS (SELECT doc_id AS instance_id, CASE WHEN doc_id % 3 = 0 THEN 'toy' ELSE 'swebench_lite' END AS dataset, source, lang, n_chars FROM documents),
axes AS (SELECT row_number() OVER (ORDER BY di, gi, ai, bi) AS index, ds, g, a, b FROM (VALUES (0, 'toy'), (1, 'swebench_lite')) x(di, ds), (VALUES (0, 'dummy'), (1, 'openhands')) y(gi, g), (VALUES (0, 'none'), (1, 'udora')) z(ai, a), (VALUES (0, 'gate'), (1, 'wall')) w(bi, b)),
r AS (SELECT *, lpad(index::VARCHAR, 3, '0') || '_' || ds || '_' || g || '_' || a || '_' || b || '_default' AS run_name FROM axes),
p AS (SELECT r.*, d.*, CASE WHEN a = 'none' OR n_chars % 3 <> 2 THEN CASE WHEN a = 'none' THEN source ELSE source || chr(10) || chr(10) || 'note of udora' END ELSE 'new ' || lang END AS adv_prompt FROM r JOIN d ON d.dataset = r.ds),
q AS (SELECT *, CASE WHEN g = 'dummy' THEN {TOY_SQL % "a + b"} WHEN a = 'none' AND n_chars % 2 = 0 THEN {CLI_DIFF} ELSE '' END AS adv_patch FROM p WHERE NOT (n_chars % 7 = 0 AND b = 'gate' AND g = 'dummy' AND a = 'none'))
SELECT run_name, instance_id, agent_name, sha256(adv_prompt) AS adv_prompt_hash, sha256(adv_patch) AS adv_patch_hash, CASE WHEN b = 'gate' AND n_chars % 2 = 0 THEN 'accept' ELSE 'reject' END AS defense_decision, coalesce(b = 'gate' AND n_chars % 2 = 0 AND n_chars % 5 = 0, false) AS tests_passed
FROM (SELECT *, g AS agent_name FROM q)""")
def run_matrix(t):
    docs = t("documents")
    instances = docs.select(F.col("doc_id").alias("instance_id"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'toy' ELSE 'swebench_lite' END").alias("dataset"), F.col("source").alias("prompt"), "n_chars")
    planned = runs.matrix_runs(docs.sparkSession, MATRIX)
    replies = docs.select(F.lit("udora").alias("attack_name"), F.col("doc_id").alias("instance_id"), F.expr(REPLIES).alias("reply"))
    outputs = docs.select(F.lit("openhands").alias("agent_name"), F.col("doc_id").alias("instance_id"), F.sha2("source", 256).alias("prompt_hash"), F.lit(" ").alias("file_text"), F.expr(f"CASE WHEN n_chars % 2 = 0 THEN concat('Done.', chr(10), {CLI_DIFF}) ELSE 'nothing' END").alias("stdout"))
    each = instances.join(F.broadcast(planned), "dataset")  # sixteen runs
    decisions = each.select("run_name", "instance_id", F.when((F.col("baseline_name") == "gate") & (F.col("n_chars") % 2 == 0), "accept").otherwise("reject").alias("decision"), F.lit(None).cast("string").alias("edited_text"))
    tests = each.select("run_name", "instance_id", (F.col("n_chars") % 5 == 0).alias("tests_passed"))
    done = instances.where("n_chars % 7 = 0").select("instance_id", "dataset", F.lit("dummy").alias("agent_config_hash"), F.lit("none").alias("attack_config_hash"), F.lit("default").alias("fidelity_mode"), F.lit("gate").alias("baseline_config_hash"))
    out = runs.run_matrix(instances.drop("n_chars"), planned, runs.any_agent, decisions, replies=replies, tests=tests, done=done, agent_inputs={"outputs": outputs}, notes=NOTES)
    return out.select("run_name", "instance_id", "agent_name", "adv_prompt_hash", "adv_patch_hash", "defense_decision", "tests_passed")


# ---- the structural defense

STRUCTURAL_MODEL = scoring.LinearModel(links.STRUCTURAL, [-1.5, 0.5, 0.25, 1.0, 0.1, -0.2, 2.0, 0.75, 0.0, 0.0, 0.01, 0.3], [0.8, 0.4, 0.3, 0.5, 50.0, 5.0, 0.2, 5.0, 8.0, 97.0, 400.0, 2.5], [0.1, 0.1, 0.1, 0.2, 20.0, 2.0, 0.05, 1.0, 1.0, 1.0, 100.0, 0.3], 0.25)
SCORE_SQL = "0.25" + "".join(f" + ({f} - {m}) / {s} * {c}" for f, c, m, s in zip(STRUCTURAL_MODEL.features, STRUCTURAL_MODEL.coefficients, STRUCTURAL_MODEL.means, STRUCTURAL_MODEL.scales, strict=True))


def _defended(t) -> DataFrame:
    """Suppliers with replies for all parsers; a tenth of them lacks the patch, and each call fails for a tenth."""
    node = F.regexp_replace("node_id", "::n", "::chunk_")
    lists = _edges(t).groupBy("instance", "subtask_index").agg(F.collect_list(node).alias("node_ids")).groupBy("instance").agg(F.to_json(F.struct(F.collect_list(F.struct("subtask_index", "node_ids")).alias("links"))).alias("links_reply"))
    steps = F.to_json(F.transform(F.sequence(F.lit(1), F.lit(SUBTASKS)), lambda i: F.concat(F.lit("step "), i.cast("string"))))
    code = lambda i: F.when(i % 10 == 0, "os.system(c)").otherwise("y = 1")
    chunks = F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(CANDIDATES - 1)), lambda i: F.struct(F.lit("f.py").alias("file"), F.lit("g").alias("function"), code(i).alias("code_snippet"))).alias("chunks")))
    rows = t("supplier").select(F.col("s_suppkey").alias("instance")).join(lists, "instance", "left").withColumn("m", F.col("instance") % 10)
    unless = lambda m, c: F.when(F.col("m") != m, c)
    return rows.select("instance", F.when(F.col("m") == 0, " ").otherwise("diff").alias("patch"), unless(1, steps).alias("subtasks_reply"), unless(3, chunks).alias("chunks_reply"), "links_reply", F.when(F.col("m") == 2, "timed out").alias("links_error"))


DEFENDED = dict(patch="patch", subtasks_reply="subtasks_reply", chunks_reply="chunks_reply", links_reply="links_reply", links_error="links_error", patch_parser=" LLM_Chunks ", prompt_parser="llm_subtasks", linker="LLM_Grounding")
STAGE_SQL = "CASE m WHEN 0 THEN 'init' WHEN 1 THEN 'subtasks' WHEN 2 THEN 'grounding' WHEN 3 THEN 'cfg' END"


@query(LINKS_SQL + f""", s AS (SELECT f.*, 1 / (1 + exp(-({SCORE_SQL}))) AS score, f.instance % 10 AS m, fs.linked AS ls, coalesce(fn.linked, 0) AS ln FROM f JOIN fs ON fs.instance = f.instance LEFT JOIN fn ON fn.instance = f.instance)
SELECT instance, CASE WHEN m > 3 AND score < 0.5 THEN 'accept' ELSE 'reject' END AS decision, CASE WHEN m > 3 THEN round(score, 6) END::DOUBLE AS model_score, CASE WHEN m > 3 THEN round(subtask_coverage - node_justification, 6) END::DOUBLE AS justification_gap,
 CASE WHEN m > 3 THEN round(node_link_entropy, 6) END::DOUBLE AS entropy, CASE WHEN m > 3 THEN {CANDIDATES} - ln END::BIGINT AS unmatched_nodes, CASE WHEN m > 3 THEN {SUBTASKS} - ls END::BIGINT AS unmatched_subtasks, {STAGE_SQL} AS stage_failed,
 CASE m WHEN 0 THEN 'the patch is empty' WHEN 1 THEN 'the call for subtasks has no reply' WHEN 2 THEN 'timed out' WHEN 3 THEN 'the call for chunks has no reply' END AS error FROM s""")
def structural_defense(t):
    out = defense.structural_defense(_defended(t), None, STRUCTURAL_MODEL, "instance", mode=" Structural_Only ", **DEFENDED)
    return out.select("instance", "decision", *[r6(c).alias(c) for c in ("model_score", "justification_gap", "entropy")], "unmatched_nodes", "unmatched_subtasks", "stage_failed", "error")


#: Settings that no row can pass, by the stage that they fail in.
FAULTY = {
    "mode": dict(mode="other"), "parser": dict(mode="structural_only", linker="none"), "markers": dict(mode="full_universal", severity_mode=" Hybrid"), "vectorizer": dict(mode="Structural_Combined"),
    "table": dict(mode="full_universal", severity_mode="odd"), "mismatch": dict(mode="severity_only_universal"), "policy": dict(mode="structural_only", policy="coin"),
}
FAULT_STAGES = {"mode": None, "parser": None, "markers": "init", "vectorizer": "model_load", "table": "features", "mismatch": "inference", "policy": "inference"}
FAULTS_SQL = " UNION ALL ".join(
    f"SELECT '{run}' AS run, s_suppkey AS instance, 'reject' AS decision, " + ({"mode": "'init'", "parser": "'grounding'"}[run] if stage is None else "'init'" if stage == "init" else f"coalesce({STAGE_SQL.replace('m WHEN', 's_suppkey % 10 WHEN')}, '{stage}')") + " AS stage_failed FROM supplier"
    for run, stage in FAULT_STAGES.items()
)


@query(f"""WITH r AS ({FAULTS_SQL}) SELECT run, instance, decision, stage_failed, stage_failed = 'cfg' AS cfg_fail, stage_failed = 'subtasks' AS subtasks_fail, stage_failed = 'grounding' AS grounding_fail, stage_failed = 'features' AS features_fail,
 stage_failed = 'model_load' AS model_missing, stage_failed = 'inference' AS inference_fail, CASE stage_failed WHEN 'cfg' THEN 'init' WHEN 'subtasks' THEN 'cfg' WHEN 'grounding' THEN 'subtasks' WHEN 'model_load' THEN 'grounding' WHEN 'features' THEN 'model_load' WHEN 'inference' THEN 'features' END AS stage_completed FROM r""")
def defense_stages(t):
    rows, out = _defended(t), None
    parsed = defense.parse(rows, None, "instance", **DEFENDED)  # no setting below is a parser's but those that fail before it
    for run, settings in FAULTY.items():
        model = scoring.LinearModel(["gini_nodes"], [1.0], [0.0], [1.0]) if run in ("table", "mismatch", "markers") else STRUCTURAL_MODEL
        one = defense.structural_defense(rows, None, model, "instance", parsed=parsed, **DEFENDED | settings).withColumn("run", F.lit(run))
        out = one if out is None else out.unionByName(one)
    return defense.failure_flags(out).select("run", "instance", "decision", "stage_failed", *defense.FLAGS.values(), "stage_completed")


#: For each mode a model of one of its features, and what SQL says of that feature.
MODE_MODELS = {
    "structural_only": ("link_entropy_over_subtasks", 2.5, "f.link_entropy_over_subtasks"), "structural_combined": ("link_sim_mean", 0.3, "q.link_sim_mean"), "similarity_only": ("link_sim_min", 0.1, "q.link_sim_min"),
    "full_universal": ("num_suspicious_nodes", 9.5, "10"), "severity_only_universal": ("top3_severity_sum_universal", 2.0, "2.7"), "no_security": ("gini_nodes", 0.2, "f.gini_nodes"),
}


@query(LINKS_SQL + ", q AS (SELECT l_suppkey AS instance, avg(l_discount * 5) AS link_sim_mean, min(l_discount * 5) AS link_sim_min FROM lineitem GROUP BY 1) " + " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, i.instance AS instance, CASE WHEN i.instance % 10 > 3 THEN round(1 / (1 + exp(-(({value}) - {mean}) * 2)), 6) END::DOUBLE AS model_score, CASE WHEN i.instance % 10 > 3 AND 1 / (1 + exp(-(({value}) - {mean}) * 2)) >= 0.5 THEN 'accept' ELSE 'reject' END AS decision, {STAGE_SQL.replace('m WHEN', 'i.instance % 10 WHEN')} AS stage_failed FROM i JOIN f ON f.instance = i.instance LEFT JOIN q ON q.instance = i.instance"
    for mode, (_, mean, value) in MODE_MODELS.items()
))
def defense_modes(t):
    rows, out = _defended(t), None
    sims = t("lineitem").select(F.col("l_suppkey").alias("instance"), (F.col("l_discount") * 5).alias("sim"))
    parsed = defense.parse(rows, None, "instance", **DEFENDED)
    for mode, (feature, mean, _) in MODE_MODELS.items():
        model = scoring.LinearModel([feature], [2.0], [mean], [1.0])
        one = defense.structural_defense(rows, None, model, "instance", mode=mode.title(), policy="Accept_If_Score_GE_Threshold", comment_stripping="None", sims=sims, parsed=parsed, **DEFENDED).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out.select("mode", "instance", r6("model_score").alias("model_score"), "decision", "stage_failed")


BASE = "concat('def f(x):\\n    y = 1\\n    z = g(y)\\n    return z\\n')"
CHANGE = "concat('--- a/', source, '.py\\n+++ b/', source, '.py\\n@@ -1,3 +1,3 @@ def f(x):\\n def f(x):\\n-    y = ', CASE n_chars % 3 WHEN 1 THEN '7' ELSE '1' END, '\\n+    y = 2', n_chars, '\\n     z = g(y)\\n')"


def _patched(t) -> tuple[DataFrame, DataFrame]:
    docs = t("documents")
    return defense.patch_nodes(docs.select("doc_id", F.expr(CHANGE).alias("patch")), docs.where("n_chars % 3 > 0").select("doc_id", F.concat("source", F.lit(".py")).alias("path"), F.expr(BASE).alias("source")), "doc_id", "patch")


@query("""SELECT doc_id::VARCHAR AS doc_id, CASE n_chars % 3 WHEN 2 THEN 'modified' ELSE 'added' END AS change_type, 'f' AS function, CASE n_chars % 3 WHEN 2 THEN '    y = 2' || n_chars ELSE '    y = 2' || n_chars END AS line FROM documents""")
def patch_candidates(t):
    nodes, _ = _patched(t)
    line = F.get(F.filter(F.split("code_snippet", "\n"), lambda s: F.contains(s, F.lit("y = 2"))), F.lit(0))
    return nodes.select("doc_id", "change_type", "function", F.concat(F.lit("    "), F.trim(line)).alias("line"))


@query("""SELECT doc_id::VARCHAR AS doc_id, source || '.py' AS touched, n_chars % 3 < 2 AS fallback_used, CASE n_chars % 3 WHEN 0 THEN 'missing_base_repo' WHEN 1 THEN 'patch_apply_failed' ELSE '' END AS fallback_reason, CASE n_chars % 3 WHEN 1 THEN false WHEN 2 THEN true END AS apply_success FROM documents""")
def patch_diagnostics(t):
    _, found = _patched(t)
    return found.select("doc_id", F.array_join("touched_python_files", ",").alias("touched"), "fallback_used", "fallback_reason", "apply_success")


# ---- the rest of training and evaluation


@query("""WITH r AS (SELECT doc_id, toxic, quality AS guess FROM labels), k AS (SELECT 0 AS class UNION ALL SELECT 1), c AS (SELECT class, count(*) FILTER (toxic = class) AS support, count(*) FILTER (guess = class) AS given, count(*) FILTER (toxic = class AND guess = class) AS good FROM k, r GROUP BY 1),
p AS (SELECT class, support, CASE WHEN given > 0 THEN good / given ELSE 0 END AS precision, CASE WHEN support > 0 THEN good / support ELSE 0 END AS recall FROM c)
SELECT class::BIGINT AS class, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6)::DOUBLE AS f1, support::BIGINT AS support FROM p""")
def class_report(t):
    rows = relational.class_report(t("labels"), "toxic", "quality")
    return rows.select(F.col("class").cast("long").alias("class"), *[r6(F.col(c).cast("double")).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY sha256('42|' || doc_id), doc_id) - 1) // 16)::BIGINT AS batch FROM documents")
def shuffled_batches(t):
    return relational.batches(t("documents"), "doc_id", 16).select("doc_id", "batch")


@query("""SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN n_chars END::BIGINT AS n, CASE n_chars % 3 WHEN 1 THEN 'has invalid JSON' WHEN 2 THEN 'must be JSON text' END AS error FROM documents""")
def json_columns(t):
    parsed = T.json_column(F.expr("CASE n_chars % 3 WHEN 0 THEN concat('{\"n\":', n_chars, ',\"x\":[]}') WHEN 1 THEN concat('{\"n\":', n_chars) END"), "n bigint")
    return t("documents").select("doc_id", parsed.alias("p")).select("doc_id", F.col("p.value.n").alias("n"), F.col("p.error").alias("error"))


@query("SELECT l_suppkey || '::' || l_returnflag || '::' || l_orderkey || '::' || l_partkey || '::' || l_linestatus AS node, coalesce(l_shipmode, '') || '--' || 'fallthrough' || '-->' || l_partkey AS edge FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem)")
def signatures(t):
    rows = t("lineitem").selectExpr("cast(l_suppkey AS string) AS file", "l_returnflag AS function", "l_orderkey AS start_line", "l_partkey AS end_line", "l_linestatus AS code_hash", "l_returnflag AS src", "cast(NULL AS string) AS kind", "cast(l_partkey AS string) AS dst")
    return rows.select(graphdiff.signature("node").alias("node"), graphdiff.signature("edge").alias("edge"))


@query("""WITH d AS (SELECT doc_id, source || '.py' AS path, n_chars % 3 AS k, CASE WHEN n_chars % 2 = 0 THEN 'Toy ' ELSE 'other' END AS dataset FROM documents)
SELECT doc_id, k < 2 AND dataset = 'other' AS cfg_fail, CASE WHEN k < 2 AND dataset = 'other' THEN 'reject' ELSE 'accept' END AS decision, k < 2 AND dataset <> 'other' AS fallback_used, CASE k WHEN 0 THEN 'missing_base_repo' WHEN 1 THEN 'patch_apply_failed' ELSE '' END AS fallback_reason,
 CASE WHEN k = 2 OR dataset <> 'other' THEN 1 END::BIGINT AS unmatched_nodes FROM d""")
def defense_patches(t):
    docs = t("documents")
    sources = docs.where("n_chars % 3 > 0").select("doc_id", F.concat("source", F.lit(".py")).alias("path"), F.expr(BASE).alias("source"))
    rows = docs.select("doc_id", F.expr(CHANGE).alias("patch"), F.expr("CASE WHEN n_chars % 2 = 0 THEN 'Toy ' ELSE 'other' END").alias("dataset"), F.lit('["a", "b"]').alias("s"), F.lit('{"links": []}').alias("l"))
    model = scoring.LinearModel(["num_candidate_nodes", "num_subtasks"], [-1.0, -1.0], [0.0, 0.0], [1.0, 1.0])
    out = defense.structural_defense(rows, None, model, "doc_id", mode="structural_only", sources=sources, dataset="dataset", subtasks_reply="s", links_reply="l", allow_fallback_non_toy=False)
    return defense.failure_flags(out).select("doc_id", "cfg_fail", "decision", "fallback_used", "fallback_reason", "unmatched_nodes")
