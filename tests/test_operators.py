"""Operators on small hand-computed rows, and what SQL cannot express."""

import hashlib
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanlark.functions import patterns, pysource
from spanlark.functions import text as T
from spanlark.operators import attacks, bundles, components, defense, graphdiff, hunks, links, policies, relational, runs, scoring, similarity, training
from spanlark.operators import calls as calls_op
from spanlark.plans import registry
from spanlark.plans.registry import REGISTRIES, Registry, defaults
from spanlark.sources import readers, sinks
from spanlark.streaming import logs

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def three_subtasks(spark):
    edges = frame(spark, [(1, 0, "f.py::g::n0"), (1, 0, "f.py::g::n1"), (1, 1, "f.py::g::n1")], "instance int, subtask_index int, node_id string")
    return edges, frame(spark, [(1, 3, 4), (2, 0, 2)], "instance int, num_subtasks int, num_candidate_nodes int")


def test_link_features_by_hand(three_subtasks):
    edges, sizes = three_subtasks
    rows = {r["instance"]: r.asDict() for r in links.link_features(edges, sizes, "instance").collect()}
    want = {
        "subtask_coverage": 2 / 3, "node_justification": 0.5, "justification_gap": 1 / 6, "unjustified_node_rate": 0.5, "avg_nodes_per_subtask": 1.0, "avg_subtasks_per_node": 1.5,
        "max_subtask_link_share": 2 / 3, "num_links_total": 3, "node_link_entropy": 0.918296, "link_entropy_over_subtasks": 0.918296, "max_links_per_subtask": 2, "min_links_per_subtask": 0,
        "std_links_per_subtask": 0.816497, "max_links_per_node": 2, "min_links_per_node": 1, "std_links_per_node": 0.5, "link_density": 0.75, "subtask_node_ratio": 1.0, "one_to_one_subtasks": 1,
        "one_to_many_subtasks": 1, "one_to_one_nodes": 1, "many_to_one_nodes": 1, "gini_subtasks": 0.444444, "gini_nodes": 0.166667, "diagonal_links": 2, "diagonal_ratio": 2 / 3, "all_min_2_connections": 0,
    }
    assert {k: round(rows[1][k], 6) for k in want} == {k: round(v, 6) for k, v in want.items()}
    assert all(rows[2][k] == 0 for k in links.STRUCTURAL if k != "num_candidate_nodes")
    assert {r["instance"]: r["is_connected"] for r in links.connected(edges, sizes, "instance").collect()} == {1: 0.0, 2: 0.0}


def test_similarity_by_hand(spark):
    sims = frame(spark, [(1, 0.1), (1, 0.25), (1, 0.5)], "instance int, sim double")
    rows = {r[0]: [round(x, 6) for x in r[1:]] for r in links.similarity_features(sims, frame(spark, [(1,), (2,)], "instance int"), "instance").collect()}
    assert rows == {1: [0.283333, 0.25, 0.13, 0.1, 0.333333, 0.666667], 2: [0, 0, 0, 0, 1, 1]}


@pytest.mark.parametrize(
    ("snippet", "function", "mode", "severity", "label"),
    [
        ("os.system(c)", "f", "none", 0.9, "highly_suspicious"), ("os.system(c)", "f", "tokens", 0.0, "neutral"), ("os.system(", "f", "tokens", 0.9, "highly_suspicious"), ("open(p)", "f", "none", 0.2, "neutral"),
        ("__import__(m)", "f", "tokens", 0.6, "suspicious"), ("x = 1", "test_a", "none", 0.0, "test_code"), ("if not x: pass", "f", "none", 0.0, "validation"),
    ],
)
def test_severity_by_hand(spark, snippet, function, mode, severity, label):
    df = frame(spark, [("a.py", function, snippet)], "file string, function string, code string")
    scanned = F.col("code") if mode == "none" else pysource.over_text(pysource.strip_tokens)("code")
    row = patterns.add_labels(patterns.add_scores(df, scanned, patterns.UNIVERSAL), F.col("file"), F.col("function"), F.col("code")).first()
    assert (row["severity"], row["label"]) == (severity, label)


def test_pattern_tables():
    assert [len(patterns.select_patterns(m)) for m in ("universal", "markers", "hybrid")] == [26, 6, 32] and len(patterns.BENIGN) == 21
    with pytest.raises(ValueError, match="no pattern table"):
        patterns.select_patterns("other")
    assert (len(links.UNIVERSAL), len(links.STRUCTURAL), len(links.SIMILARITY)) == (47, 12, 6)


def test_probabilities(spark):
    replies = ['{"p_reject": 1.7}', 'x "p_reject": 0.3 y', "REJECT", "reject or accept", " ", "[0.9]", "{}", None, '{"p_reject": null}']
    df = frame(spark, list(enumerate(replies)), "i int, reply string")
    assert [r[0] for r in df.orderBy("i").select(T.probability(F.col("reply"))).collect()] == [1.0, 0.3, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_guard_and_links_parse(spark):
    df = frame(spark, [(0, "unsafe\nS1, S2"), (1, "safe"), (2, " ")], "i int, reply string")
    assert [(r["verdict"], r["categories"], r["decision"]) for r in policies.guard_model(df, "reply").orderBy("i").collect()] == [("unsafe", ["S1", "S2"], "reject"), ("safe", [], "accept"), ("unknown", [], "reject")]
    reply = 'noise {"links":[{"subtask_index":0,"node_ids":"a"},{"subtask_index":5,"node_ids":["b"]},{"subtask_index":0,"node_ids":["c"," "]}]} tail'
    parsed = links.parse_links(frame(spark, [(1, reply, 2)], "k int, reply string, n int"), "k", "reply", "n")
    assert {r["subtask_index"]: r["node_ids"] for r in parsed.collect()} == {0: ["c"], 1: []}


def test_surrogate_guard_of_blank_texts(spark):
    df = frame(spark, list(enumerate(["", " \n", None, "a Backdoor", "fine"])), "i int, prompt string")
    found = lambda **how: [(r["verdict"], r["decision"]) for r in policies.surrogate_guard(df, "prompt", **how).orderBy("i").collect()]
    assert found() == [("unknown", "reject")] * 3 + [("unsafe", "reject"), ("safe", "accept")]
    assert found(blank_unknown=False) == [("safe", "accept")] * 3 + [("unsafe", "reject"), ("safe", "accept")]


DIFF = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1,2 @@ def f(x):\n-x\n+y\n+z\ndiff --git a/b.py b/b.py\n--- /dev/null\n+++ b/b.py\t2024\n@@ -0,0 +7 @@\n+w"


def test_two_file_diff(spark):
    df = frame(spark, [(1, DIFF), (2, ""), (3, None)], "k int, patch string")
    rows = {r["chunk_id"]: r for r in hunks.hunks(df, "k", "patch").collect()}
    assert (rows["chunk_1"]["file_path"], rows["chunk_2"]["file_path"][:4]) == ("a.py", "b.py")
    assert rows["chunk_1"]["raw_hunk"].splitlines() == ["@@ -1 +1,2 @@ def f(x):", "-x", "+y", "+z"]
    node = hunks.hunk_nodes(df, "k", "patch").where("file = 'a.py'").first()
    assert (node["function"], node["start_line"], node["end_line"], node["code_snippet"]) == ("f", 1, 3, "y\nz")
    files = df.select(T.touched_files(F.col("patch"))).collect()
    assert [r[0] for r in files][1:] == [[], []] and files[0][0][0] == "a.py" and "/dev/null" not in files[0][0]


def test_find_diff(spark):
    texts = ["```diff\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n```", "note\n--- a/x\n+++ b/x\n@@ -1 +1 @@", "no diff", None, "so: diff --git a/x b/x\nend "]
    df = frame(spark, list(enumerate(texts)), "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(T.find_diff(F.col("x"))).collect()] == ["--- a/x\n+++ b/x\n@@ -1 +1 @@", "--- a/x\n+++ b/x\n@@ -1 +1 @@", "", "", "diff --git a/x b/x\nend"]


def test_canonical_json(spark):
    values = ["plain", "é ß 日本 😀", "a\x0b\x1f\\u000B \" / \n\t", "", None]
    df = frame(spark, [(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(T.canonical_json({"v": F.col("v"), "b": F.lit(3), "a": F.lit(True)})).collect()]
    assert got == [json.dumps({"v": v, "b": 3, "a": True}, sort_keys=True, ensure_ascii=True, separators=(",", ":")) for v in values]


def test_pick_by_hand(spark):
    """The index is the first 16 digits of the hash of the selection as compact JSON with its keys in order."""
    key = hashlib.sha256(json.dumps({"instance_id": "ü1", "seed": 3, "attack_config_hash": "c", "candidate_count": 5}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    patches = frame(spark, [("ü1", n, " " if n % 2 else "d") for n in range(5)], "instance_id string, n int, patch string")
    row = relational.pick_candidate(frame(spark, [("ü1",), ("none",)], "instance_id string"), patches, "instance_id", "n", 3, "c", patch="patch").collect()
    assert len(row) == 1 and row[0]["picked_index"] == row[0]["n"] == int(key[:16], 16) % 5 and (row[0]["pick_error"] is None) == (row[0]["n"] % 2 == 0)


def test_subtasks_keep_digits(spark):
    replies = ["- 3 retries are allowed\n\n• next -\n* *\n4. four", '["a", " ", "b "]', 'so: ["x"] ok', "one", None]
    df = frame(spark, list(enumerate(replies)), "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(T.subtasks(F.col("x"))).collect()] == [["3 retries are allowed", "next", "4. four"], ["a", "b"], ["x"], ["one"], []]


def test_chunks_by_hand(spark):
    reply = json.dumps({"chunks": [{"file": "a.py", "change_type": "Removed", "code_snippet": "x", "start_line": 4}, {"file": "a.py", "change_type": "added"}, {"file": " ", "code_snippet": "y"}, "z", {"file": "a.py", "function": "f", "code_snippet": " y ", "end_line": 9, "change_type": "added"}]})
    df = frame(spark, [(1, reply), (2, f"Here: {reply} done"), (3, "[]"), (4, "{}"), (5, None), (6, '{"chunks": {"a": 1}}')], "k int, reply string")
    rows = [tuple(r) for r in hunks.chunk_nodes(df, "k", "reply").select("k", "node_id", "bucket", "start_line", "end_line", "code_snippet", "node_type").collect()]
    want = [("a.py::unknown::chunk_0", "nodes_removed", 4, 4, "x", "code_chunk"), ("a.py::f::chunk_4", "nodes_added", 0, 9, "y", "code_chunk")]
    assert sorted(rows) == sorted((k, *w) for k in (1, 2) for w in want)


def test_graph_difference_by_hand(spark):
    """One function: a node that stays, one modified, one moved, one removed, one added, and one shadowed whose code still counts."""
    schema = "file string, function string, start_line int, end_line int, type string, code_hash string, node_id string, code_snippet string"
    at = lambda line, code, name: ("a.py", "f", line, line, "basic_block", code, name, f"<{code}>")
    before = frame(spark, [at(1, "s", "b1"), at(2, "m", "b2"), at(3, "v", "b3"), at(4, "r", "b4"), at(6, "h", "b5"), at(6, "k", "b6")], schema)
    after = frame(spark, [at(1, "s", "a1"), at(2, "m2", "a2"), at(5, "v", "a3"), at(6, "k", "a4"), at(7, "n", "a5"), at(8, "h", "a6")], schema)
    diff = graphdiff.node_diff(before, after, [], carry=["code_snippet"])
    got = {(r["before_id"], r["after_id"]): r["change_type"] for r in diff.collect()}
    assert got == {("b1", "a1"): "same", ("b2", "a2"): "modified", (None, "a3"): "moved", ("b4", None): "removed", ("b6", "a4"): "same", (None, "a5"): "added", (None, "a6"): "moved"}
    rows = graphdiff.candidates(diff, []).orderBy("node_id").collect()
    assert [(r["node_id"], r["change_type"], r["before_code_snippet"], r["after_code_snippet"]) for r in rows] == [("a2", "modified", "<m>", "<m2>"), ("a3", "moved", "<v>", "<v>"), ("a5", "added", None, "<n>"), ("a6", "moved", "<h>", "<h>")]
    edges = frame(spark, [("a.py", "b1", "b2"), ("a.py", "b2", "b3")], "file string, src string, dst string")
    total = graphdiff.diff_summary(diff, before, after, ["file"], edges, edges.limit(1)).first()
    assert [total[c] for c in ("nodes_before", "nodes_after", "edges_before", "edges_after", "files_compared", "functions_compared", "nodes_moved", "nodes_removed")] == [6, 6, 2, 1, 1, 1, 2, 1]


def test_limits_and_metrics(spark):
    df = frame(spark, [(i, y, p) for i, (y, p) in enumerate([(1, 1), (1, 0), (0, 1), (0, 0)])], "i int, y int, p int")
    assert relational.head(df, ["i"], 0).count() == 0 and relational.head(df, ["i"], None).count() == 4
    row = relational.classification_metrics(df, "y", "p").first()
    assert [row[c] for c in ("accuracy", "precision", "recall", "f1", "tn", "fp", "fn", "tp")] == [0.5, 0.5, 0.5, 0.5, 1, 1, 1, 1]
    none = relational.classification_metrics(df.withColumn("p", F.lit(0)), "y", "p").first()
    assert (none["precision"], none["f1"]) == (0.0, 0.0)


def test_splits_keep_groups_apart(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for split in (relational.group_split(labels, "doc_id", 0.8), relational.stratified_split(labels, "doc_id", "toxic", 0.5), relational.threshold_split(labels, "doc_id", 0.8)):
        rows = [(r["doc_id"], r["split"]) for r in split.collect()]
        assert len({i for i, _ in rows}) == len(set(rows)) and len(rows) == labels.count() and {s for _, s in rows} == {"train", "test"}


def test_resume_is_idempotent(spark):
    planned = frame(spark, [(1, "a"), (2, "a"), (3, "b")], "id int, h string")
    done = relational.resume(planned, frame(spark, [(1, "a"), (1, "b")], "id int, h string"), ["id", "h"])
    assert {r["id"] for r in done.collect()} == {2, 3}
    assert relational.resume(planned, planned, ["id", "h"]).count() == 0


def test_model_round_trip_and_guard(spark, tmp_path):
    model = scoring.LinearModel(["a", "b"], [1.0, -2.0], [0.5, 0.0], [2.0, 1.0], 0.1)
    model.save(f"{tmp_path}/m.json")
    assert scoring.LinearModel.load(f"{tmp_path}/m.json") == model
    df = frame(spark, [(1.0, None), (3.0, 2.0)], "a double, b double")
    got = [r["score"] for r in scoring.score(df, model).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-(0.1 + 0.25))), 1 / (1 + math.exp(-(0.1 + 1.25 - 4.0)))])
    with pytest.raises(ValueError, match="1 of 2 features are missing"):
        scoring.score(df.drop("b"), model)
    assert scoring.score(df.drop("b"), model, most_missing=0.5).count() == 2
    rows = frame(spark, [(float(i), float(i % 3), int(i > 20)) for i in range(40)], "a double, b double, y int")
    trained = scoring.fit(rows, ["a", "b"], "y")
    assert scoring.score(rows, trained).where("prediction = y").count() > 35


SOURCE = '''import os

def f(x):
    y = 1
    if x > y:
        return os.path.join(x)
    elif x:
        y = 2
    else:
        pass
    try:
        risky()
    except ValueError:
        y = 3
    finally:
        close()
    with open(x) as h:
        h.read()
    while y:
        break
    raise E(y)

def f(z):
    pass
'''


def test_flow_graph(spark):
    files = frame(spark, [("a.py", SOURCE), ("bad.py", "def f(:"), ("none.py", None)], "path string, source string")
    nodes = [r for r in pysource.flow_nodes(files).collect() if r["function"] == "f"]
    assert [n["type"] for n in nodes] == [
        "entry", "basic_block", "condition", "return", "condition", "basic_block", "basic_block", "try_header", "basic_block", "except_handler", "basic_block", "finally", "basic_block",
        "with_header", "basic_block", "loop_header", "basic_block", "raise", "exit",
    ]
    assert nodes[3]["contains_calls"] == ["os.path.join"] and nodes[13]["contains_calls"] == ["h.read", "open"]
    edges = Counter(r["kind"] for r in pysource.flow_edges(files).where("function = 'f'").collect())
    assert edges["branch_true"] == 2 and edges["branch_false"] == 2 and edges["exception"] == 1 and edges["finally"] == 2 and edges["back_edge"] == 1
    assert {r["function"] for r in pysource.flow_nodes(files).collect()} == {"f", "f_L23"}
    assert [r["file"] for r in pysource.parse_errors(files).collect()] == ["bad.py"]
    pysource.register(spark)
    files.createOrReplaceTempView("files")
    assert spark.sql("SELECT g.type FROM files, LATERAL flow_graph(path, source) g WHERE g.function = 'f'").count() == len(nodes)


def test_tokens_and_hunks():
    assert pysource.strip_tokens("x = 'a'  # c\n").split() == ["x", "="]
    assert pysource.mask_tokens("for i in f(1, 'a'):\n    g . h\n") == "for VAR in VAR(NUM, STR):\n\n    VAR . VAR\n\n"
    assert pysource.mask_tokens("print(self, len(x))") == "print(self, len(VAR))\n"
    assert pysource.mask_tokens("x = ( 'a' 12") == "x = ( STR NUM"
    assert pysource.apply_hunks("a\nb\nc\n", "@@ -2 +2 @@\n-b\n+B\n") == "a\nB\nc\n"
    assert pysource.apply_hunks("a\n", "@@ -1 +1 @@\n-x\n+y\n") is None and pysource.apply_hunks("a\n", "") == "a\n"


def test_readers_and_sinks(spark, tmp_path):
    rows = [{"id": "i1", "prompt": "p", "repo_path": "/r", "test_command": "make  test"}, {"prompt": " ", "repo_path": " "}, {"instance_id": "i3", "problem_statement": "s", "repo_path": "/q"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\nnot json\n")
    (tmp_path / "b.json").write_text(json.dumps({"rows": rows}))
    (tmp_path / "c.json").write_text(json.dumps(rows))
    for name in ("a.jsonl", "b.json", "c.json"):
        good, bad = readers.instances(spark, f"{tmp_path}/{name}")
        assert [r["instance_id"] for r in good.orderBy("pos").collect()] == ["i1", "i3"] and Counter((r["instance_id"], r["reason"]) for r in bad.collect()) == Counter([("row-1", "no repository path")] + [(None, "invalid JSON")] * (name == "a.jsonl"))
        assert good.orderBy("pos").first()["command"] == ["make", "test"]
    assert readers.instances(spark, f"{tmp_path}/a.jsonl", limit=0)[0].count() == 0
    assert readers.instances(spark, f"{tmp_path}/a.jsonl", ids=["i3"])[0].count() == 1
    assert readers.instances(spark, f"{tmp_path}/missing.jsonl")[0].count() == 0
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        readers.jsonl(spark, f"{tmp_path}/a.jsonl", readers.INSTANCE).collect()
    (tmp_path / "p.json").write_text(json.dumps({"predictions": [{"instance_id": "x", "diff": " ", "model_patch": "d", "id": "c1"}]}))
    assert [tuple(r) for r in readers.prebuilt_patches(spark, f"{tmp_path}/p.json")[0].collect()] == [("x", "c1", "d", 0)]
    results = frame(spark, [("b", 1), ("a", 2)], "instance_id string, runtime_sec int")
    sinks.append_jsonl(results, f"{tmp_path}/out/run1/results.jsonl")
    sinks.append_jsonl(results, f"{tmp_path}/out/run1/results.jsonl")
    assert readers.result_logs(spark, f"{tmp_path}/out", "instance_id string, runtime_sec int").count() == 4
    sinks.write_summary(results, f"{tmp_path}/summary")
    assert spark.read.option("header", True).csv(f"{tmp_path}/summary").columns == relational.SUMMARY
    (tmp_path / "src/venv").mkdir(parents=True)
    (tmp_path / "src/x.py").write_text("a = 1")
    (tmp_path / "src/venv/y.py").write_text("b = 1")
    assert [r["source"] for r in readers.sources(spark, f"{tmp_path}/src").collect()] == ["a = 1"]
    (tmp_path / "art/i1").mkdir(parents=True)
    (tmp_path / "art/i1/original_prompt.txt").write_text("old")
    (tmp_path / "art/i1/adv_prompt.txt").write_text(" new\n")
    assert [tuple(r) for r in readers.artifact_texts(spark, f"{tmp_path}/art").collect()] == [("i1", "new")]
    (tmp_path / "s.json").write_text("[1]")
    with pytest.raises(ValueError, match="no mapping"):
        readers.load_settings(f"{tmp_path}/s.json")
    assert readers.toy(spark).count() == 1 and readers.toy(spark, limit=0).count() == 0


def test_rejects_and_numbers_of_many_files(spark, tmp_path):
    """Lines keep their order over files of very different sizes, whatever order Spark reads them in; each is a row or a reject."""
    (tmp_path / "in").mkdir()
    want = []
    for k, n in enumerate((3, 400, 1, 0, 57)):
        lines = [json.dumps({"id": f"{k}-{i}", "n": i}) if i % 5 else "{" for i in range(n)]
        (tmp_path / f"in/f{k}.jsonl").write_text("\n\n".join(lines) + "\n  \n")
        want += [f"{k}-{i}" if i % 5 else None for i in range(n)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        good, bad = readers.json_lines(spark, f"{tmp_path}/in", "id string, n int")
        got = {r["pos"]: r["id"] for r in good.collect()} | {r["pos"]: None for r in bad.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want)
    assert {(r["text"], r["reason"]) for r in bad.collect()} == {("{", "invalid JSON")}
    (tmp_path / "p.jsonl").write_text('{"instance_id": "a", "patch": "d"}\n[1]\n{"instance_id": "b", "diff": 5}\n{"x": 1} y\n')
    good, bad = readers.prebuilt_patches(spark, f"{tmp_path}/p.jsonl")
    assert [(r["instance_id"], r["patch_text"], r["pos"]) for r in good.orderBy("pos").collect()] == [("a", "d", 0), ("b", "5", 2)]
    assert [(r["pos"], r["reason"]) for r in bad.orderBy("pos").collect()] == [(1, "no object"), (3, "invalid JSON")]
    (tmp_path / "q.json").write_text('{"rows": 3, "data": [{"instance_id": "a"}, 4]}')
    good, bad = readers.prebuilt_patches(spark, f"{tmp_path}/q.json")
    assert (good.count(), [(r["text"], r["reason"]) for r in bad.collect()]) == (1, [("4", "no object")])
    for odd in ('{"other": []}', "5", "{"):
        (tmp_path / "odd.json").write_text(odd)
        with pytest.raises(ValueError, match="holds neither"):
            readers.prebuilt_patches(spark, f"{tmp_path}/odd.json")
    (tmp_path / "i.jsonl").write_text('{"repo_path": "/r", "test_command": ["tox", "-e py"]}\nnot json\n{"id": "x"}\n{"id": "y", "repo_path": "/r"}\n')
    good, bad = readers.instances(spark, f"{tmp_path}/i.jsonl")
    assert [(r["instance_id"], r["command"]) for r in good.orderBy("pos").collect()] == [("row-0", ["tox", "-e py"]), ("y", ["python", "-m", "pytest", "-q"])]
    assert {(r["pos"], r["reason"]) for r in bad.collect()} == {(1, "invalid JSON"), (2, "no repository path")}


def test_bundles_are_saved_loaded_and_guarded(spark, tmp_path):
    rows = frame(spark, [(float(i) if i % 7 else None, float(i % 3), float("nan") if i == 5 else 1.0, int(i > 20)) for i in range(40)], "a double, b double, c double, y int")
    words = frame(spark, [("open", 1.5)], "term string, idf double")
    for impute in ("zero", "mean", "median"):
        made = bundles.fit(rows, ["a", "b", "c"], "y", impute=impute, vocabulary=words, metadata={"mode": "test"})
        made.save(f"{tmp_path}/{impute}")
        back = bundles.load(spark, f"{tmp_path}/{impute}", require_vectorizer=True)
        assert back.features == ["a", "b", "c"] and back.metadata["mode"] == "test" and [tuple(r) for r in back.vocabulary.collect()] == [("open", 1.5)]
        score = lambda b: [(r["score"], r["prediction"]) for r in b.score(rows).orderBy("a", "b", "y").collect()]
        assert score(back) == score(made) and back.score(rows).where("prediction = y").count() > 30
        assert back.score(rows).columns == [*rows.columns, "score", "prediction"]
    fixed = scoring.LinearModel(["a", "b", "c"], [0.3, -2.0, 1.0], [0.5, 0.0, 1.0], [2.0, 1.0, 0.0], 0.1)
    own = bundles.of_linear(fixed)
    whole = rows.where("not isnan(c)")
    assert [r["score"] for r in own.score(whole).orderBy("a", "b", "y").collect()] == pytest.approx([r["score"] for r in scoring.score(whole, fixed).orderBy("a", "b", "y").collect()])
    with pytest.raises(ValueError, match="1 of 3 features are missing"):
        own.score(rows.drop("c"))
    assert own.score(rows.drop("c"), most_missing=0.5).count() == 40
    own.save(f"{tmp_path}/plain")
    with pytest.raises(FileNotFoundError, match="lacks the vocabulary"):
        bundles.load(spark, f"{tmp_path}/plain", require_vectorizer=True)
    assert bundles.load(spark, f"{tmp_path}/plain").vocabulary is None
    with pytest.raises(FileNotFoundError, match="no model at"):
        bundles.load(spark, f"{tmp_path}/nowhere")
    (tmp_path / "half").mkdir()
    with pytest.raises(FileNotFoundError, match="lacks pipeline, metadata"):
        bundles.load(spark, f"{tmp_path}/half")
    with pytest.raises(ValueError, match="no imputing"):
        bundles.fit(rows, ["a"], "y", impute="mode")
    df = frame(spark, [(1, "d", '["open a", "close b"]', '{"links":[{"subtask_index":0,"node_ids":["n0"]}]}')], "k int, patch string, s string, l string")
    nodes = frame(spark, [(1, "n0", "open")], "k int, node_id string, code_snippet string")
    combined = bundles.of_linear(scoring.LinearModel(["link_sim_mean"], [1.0], [0.0], [1.0]), words)
    row = defense.structural_defense(df, nodes, combined, "k", mode="similarity_only", mask_tokens=False, subtasks_reply="s", links_reply="l").first()
    assert row["model_score"] == pytest.approx(1 / (1 + math.exp(-1.0))) and row["stage_failed"] is None


def test_training_data_from_files(spark, tmp_path):
    """Logs and artifacts to split instances: blank prompts go, limits count before, rows split exactly, settings are checked first."""
    for name, n in (("good", 30), ("bad", 20)):
        rows = [{"instance_id": f"i{k % 10}", "attack_artifact_path": f"/run/{name}{k}", "dataset": "toy", "tests_passed": k % 2 == 0} for k in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
        for k in range(n):
            (tmp_path / f"art/{name}{k}").mkdir(parents=True)
            (tmp_path / f"art/{name}{k}/adv_prompt.txt").write_text(" \n" if k == 0 else f" p{k} \n")
    run = lambda **kw: training.prepare_from_files(spark, f"{tmp_path}/good.jsonl", f"{tmp_path}/bad.jsonl", f"{tmp_path}/art", f"{tmp_path}/out", **kw)
    meta = run(strategy="random", ratio=0.7)
    assert (meta["total_instances"], meta["train_instances"], meta["test_instances"]) == (48, 33, 15) and meta["strategy"] == "random"
    assert json.loads(spark.read.text(f"{tmp_path}/out/metadata").first()[0]) == json.loads(json.dumps(meta))
    back = spark.read.json(f"{tmp_path}/out/instances")
    assert back.count() == 48 and {r["prompt"] for r in back.collect()} == {f"p{k}" for k in range(1, 30)} and back.where("metadata.dataset = 'toy'").count() == 48
    meta = run(strategy="instance_based", limit=5)
    assert meta["total_instances"] == 8 and sum(meta["train_label_distribution"].values()) == meta["train_instances"]
    groups = {}
    for r in spark.read.json(f"{tmp_path}/out/instances").collect():
        groups.setdefault(r["instance_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in groups.values())
    for wrong, why in (({"ratio": 1.0}, "between 0 and 1"), ({"strategy": "x"}, "no split"), ({"limit": 0}, "at least 1")):
        with pytest.raises(ValueError, match=why):
            run(**wrong)
    with pytest.raises(FileNotFoundError, match="no results at"):
        training.prepare_from_files(spark, f"{tmp_path}/none.jsonl", f"{tmp_path}/bad.jsonl", f"{tmp_path}/art", f"{tmp_path}/out2")


def test_pooled_vectors_and_probabilities(spark):
    rows = frame(spark, [(1, [1.0, 2.0]), (1, [3.0, 6.0]), (1, None), (2, [5.0, 5.0])], "k int, v array<double>")
    assert {r["k"]: r["pooled"] for r in similarity.mean_pooled(rows, "k", "v").collect()} == {1: [2.0, 4.0], 2: [5.0, 5.0]}
    scores = frame(spark, [([1000.0, 1000.0],), ([0.0, math.log(3)],), ([],), (None,)], "s array<double>")
    got = scores.select(similarity.softmax(F.col("s")).alias("p"), similarity.argmax(F.col("s")).alias("a")).collect()
    assert [r["a"] for r in got] == [0, 1, None, None] and got[0]["p"] == [0.5, 0.5] and got[1]["p"] == pytest.approx([0.25, 0.75]) and got[2]["p"] == []
    assert [r["decision"] for r in policies.sequence_classifier(scores, "s", 0.6).collect()] == ["accept", "reject", "reject", "reject"]


def test_envelopes_and_transcripts(spark, tmp_path):
    sinks.write_envelopes(frame(spark, [("é", 1), ("b", None)], "x string, y int"), ["x", "y"], "c", f"{tmp_path}/e")
    rows = readers.envelopes(spark, f"{tmp_path}/e").collect()
    assert len(rows) == 2 and all(r["valid"] and r["config_hash"] == "c" for r in rows)
    (tmp_path / "bad.json").write_text(json.dumps({"payload": "{}", "payload_sha256": "0", "config_hash": "c"}))
    assert [r["valid"] for r in readers.envelopes(spark, f"{tmp_path}/bad.json").collect()] == [False]
    sinks.write_transcripts(frame(spark, [("k", 2, "b"), ("k", 1, "a")], "id string, turn int, reply string"), "id", "turn", f"{tmp_path}/t")
    line = json.loads(next(p for p in (tmp_path / "t").glob("part-*") if p.stat().st_size).read_text())
    assert line == {"id": "k", "turns": [{"turn": 1, "reply": "a"}, {"turn": 2, "reply": "b"}]}


def test_registry():
    own = Registry("linker")
    own.register("Mine")(len)
    assert own.get(" mine ") is len
    with pytest.raises(ValueError, match="already"):
        own.register("MINE")(len)
    with pytest.raises(KeyError, match="there are mine"):
        own.get("other")
    defaults()
    defaults()
    assert "prompt_filter" in REGISTRIES["baseline"].names() and len(REGISTRIES) == 7
    assert {kind: len(r.names()) for kind, r in REGISTRIES.items()} == {"dataset": 5, "agent": 6, "attack": 5, "baseline": 10, "prompt_parser": 1, "patch_parser": 2, "linker": 2}


def test_one_run_and_a_matrix(spark):
    """Toy instances through both phases: what is accepted keeps the agent's patch, and a matrix has a run for each combination."""
    instances = frame(spark, [("i1", "add numbers"), ("i2", "do not subtract")], "instance_id string, prompt string")
    reject_all = lambda df: df.select("instance_id", F.lit("reject").alias("decision"))
    accept_add = lambda df: df.select("instance_id", F.when(F.col("prompt").contains("add"), "accept").otherwise("reject").alias("decision"))
    tests = frame(spark, [("i1", True), ("i2", True)], "instance_id string, tests_passed boolean")
    rows = {r["instance_id"]: r for r in runs.run_one(instances, "none", attacks.toy_agent, accept_add, "gate", tests=tests).collect()}
    assert rows["i1"]["final_patch"] == attacks.TOY_STYLES["add_fix"] and rows["i1"]["tests_passed"] and rows["i1"]["defense_decision"] == "accept"
    assert rows["i2"]["adv_patch"] == attacks.TOY_STYLES["add_fix_alt"] and rows["i2"]["final_patch"] is None and not rows["i2"]["tests_passed"]
    toys = instances.withColumn("dataset", F.lit("toy"))
    plan = runs.matrix_runs(spark, {"dataset": ["toy"], "attack_name": ["none", "fcv"], "agent_name": ["dummy"], "baseline_name": ["gate", "never"]})
    named = toys.crossJoin(F.broadcast(plan.select("run_name", "baseline_name"))).withColumn("edited_text", F.lit(None).cast("string"))
    decisions = named.withColumn("decision", F.when((F.col("baseline_name") == "gate") & F.col("prompt").contains("add"), "accept").otherwise("reject"))
    matrix = runs.run_matrix(toys, plan, runs.any_agent, decisions)
    assert Counter(r["run_name"] for r in matrix.collect()) == {f"00{k}_toy_dummy_{a}_{b}_default": 2 for k, (a, b) in enumerate([("none", "gate"), ("none", "never"), ("fcv", "gate"), ("fcv", "never")], 1)}
    assert Counter(r["defense_decision"] for r in matrix.collect()) == {"accept": 2, "reject": 6}
    assert runs.result_rows(matrix).columns == runs.RESULT and len(runs.RESULT) == 48
    done = matrix.where("baseline_name = 'gate' and instance_id = 'i1'")
    assert sorted((r["attack_name"], r["baseline_name"], r["instance_id"]) for r in runs.run_matrix(toys, plan, runs.any_agent, decisions, done=done).collect()) == sorted(
        (a, b, i) for a in ("none", "fcv") for b in ("gate", "never") for i in ("i1", "i2") if (b, i) != ("gate", "i1")
    )
    assert len(plan.withColumn("x", F.lit(1)).collect()) == 4
    with pytest.raises(ValueError, match="no generator"):
        runs.matrix_runs(spark, {"attack_name": ["other"]})
    with pytest.raises(ValueError, match="for training"):
        runs.check_settings({"training": {}}, "inference")
    with pytest.raises(ValueError, match="lack training"):
        runs.check_settings({"data_preparation": {}}, "training")
    with pytest.raises(RuntimeError, match="only evaluates"):
        runs.check_no_fit(True, "fit vectorizer")


def test_plan_of_a_matrix_does_not_grow(spark):
    """Forty-eight runs take the plan that two take."""
    toys = frame(spark, [("i1", "toy", "add")], "instance_id string, dataset string, prompt string")
    none = frame(spark, [], "run_name string, instance_id string, decision string, edited_text string")
    size = lambda axes: len(runs.run_matrix(toys, runs.matrix_runs(spark, axes), runs.any_agent, none)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    few = {"dataset": ["toy"], "attack_name": ["none"], "baseline_name": ["a", "b"]}
    many = {"dataset": ["toy", "x"], "attack_name": list(attacks.GENERATORS)[:3], "baseline_name": [f"b{k}" for k in range(8)]}
    assert size(few) == size(many)


def test_every_registered_name_can_be_called(spark):
    """Each agent and each generator runs through ``run_attack``; a command-line agent's patch is that of the prompt it had."""
    defaults()
    instances = frame(spark, [("i1", "add"), ("i2", "other")], "instance_id string, prompt string")
    diff = "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b"
    outputs = frame(spark, [("openhands", "i1", hashlib.sha256(b"add").hexdigest(), " ", f"Here:\n{diff}\n"), ("sweagent", "i1", hashlib.sha256(b"add").hexdigest(), diff + "2", "")], "agent_name string, instance_id string, prompt_hash string, file_text string, stdout string")
    for name in REGISTRIES["agent"].names():
        inputs = {} if name == "dummy" else {"outputs": outputs}
        rows = {r["instance_id"]: r for r in runs.run_attack(instances, "none", REGISTRIES["agent"].get(name), agent_name=name, agent_inputs=inputs).collect()}
        want = {"dummy": attacks.TOY_STYLES["add_fix"], "openhands": diff, "sweagent": diff + "2"}.get(name, "")
        assert (rows["i1"]["ori_patch"], rows["i1"]["adv_patch"], rows["i1"]["agent_name"]) == (want, want, name)
        assert rows["i2"]["ori_patch"] == (want if name == "dummy" else "")
    for name in REGISTRIES["attack"].names():
        row = REGISTRIES["attack"].get(name)(instances, "prompt").first()
        assert (row["attack_name"], row["adv_prompt"]) == (name, "add")
        row = REGISTRIES["attack"].get(name)(instances.withColumn("r", F.lit(" ")), "prompt", "r", {name: "note"}).first()
        assert row["adv_prompt"] == ("add" if name == "none" else "add\n\nnote")
    assert registry.DATASETS["swebench"] == "swebench_lite"


def test_resume_keeps_runs_apart(spark):
    attacked = frame(spark, [("i1", "toy", "g1"), ("i2", "toy", "g1")], "instance_id string, dataset string, agent_config_hash string").withColumn("adv_patch", F.lit("p"))
    decisions = frame(spark, [("i1", "accept", None), ("i2", "accept", None)], "instance_id string, decision string, edited_text string")
    left = lambda *log: sorted(r["instance_id"] for r in runs.run_defense(attacked, decisions, "gate", done=frame(spark, list(log), "instance_id string, dataset string, agent_config_hash string, baseline_config_hash string")).collect())
    assert left(("i1", "toy", "g1", "gate")) == ["i2"]
    assert left(("i1", "toy", "g1", "other"), ("i2", "toy", "g2", "gate"), ("i2", "x", "g1", "gate")) == ["i1", "i2"]
    assert sorted(r["instance_id"] for r in runs.run_defense(attacked, decisions, "gate", done=frame(spark, [("i1",)], "instance_id string")).collect()) == ["i1", "i2"]


def test_defense_settings_that_no_row_can_pass(spark):
    df = frame(spark, [(1, "d", '["a"]', "{}")], "k int, patch string, s string, l string")
    nodes = frame(spark, [(1, "f::g::n0", "eval(s)")], "k int, node_id string, code_snippet string")
    model = scoring.LinearModel(["a", "b"], [1.0, 1.0], [0.0, 0.0], [1.0, 1.0])
    run = lambda **kw: defense.failure_flags(defense.structural_defense(df, nodes, kw.pop("model", model), "k", patch="patch", subtasks_reply="s", links_reply="l", **kw)).first()
    assert (run(mode="other")["stage_failed"], run(mode="other")["decision"]) == ("init", "reject")
    assert run(mode="full_universal", severity_mode="hybrid")["stage_failed"] == "init"
    assert run()["model_missing"] and run(model=None, mode="structural_only")["model_missing"]
    row = run(mode="structural_only")
    assert row["inference_fail"] and not row["cfg_fail"] and row["stage_completed"] == "features" and "2 of 2 features" in row["error"]
    assert run(mode="severity_only_universal", severity_mode="odd", most_missing=1.0)["features_fail"]
    assert run(mode="structural_only", most_missing=1.0, policy="coin")["inference_fail"]
    assert run(patch_parser="x")["cfg_fail"] and run(prompt_parser="x")["subtasks_fail"] and run(linker="x")["grounding_fail"]
    assert run(mode="structural_only", linker="embedding_similarity")["error"] == "there are no vectors"
    with pytest.raises(TypeError, match="no setting named modus"):
        run(modus="x")
    own = scoring.LinearModel(["max_severity_universal"], [-9.0], [0.5], [0.1])
    assert run(mode="severity_only_universal", model=own)["decision"] == "reject"  # tokens apart: no pattern is found
    row = run(mode=" Severity_Only_Universal", model=own, comment_stripping="None ")
    assert row["decision"] == "accept" and row["model_score"] < 0.5 and (row["unmatched_nodes"], row["unmatched_subtasks"]) == (1, 1)


def test_defense_links_by_vectors_and_weighs_by_vocabulary(spark):
    """Two instances whose vectors and words speak for different nodes; the names of a mode make no difference by their case."""
    df = frame(spark, [(1, "d", '["open file", "close door"]', None), (2, "d", '["open file"]', None)], "k int, patch string, s string, l string")
    nodes = frame(spark, [(1, "n0", "file open"), (1, "n1", "zebra"), (2, "n0", "door")], "k int, node_id string, code_snippet string")
    steps = frame(spark, [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 1.0])], "k int, subtask_index int, vector array<double>")
    codes = frame(spark, [(1, "n0", [2.0, 0.1]), (1, "n1", [0.0, 3.0]), (2, "n0", [-1.0, 0.0])], "k int, node_id string, vector array<double>")
    words = frame(spark, [("open", 1.0), ("file", 1.0), ("door", 2.0)], "term string, idf double")
    model = scoring.LinearModel(["link_sim_mean"], [4.0], [0.4], [1.0])
    run = lambda mode: {r["k"]: r for r in defense.structural_defense(df, nodes, model, "k", mode=mode, linker="embedding_similarity", subtask_vectors=steps, node_vectors=codes, vocabulary=words, mask_tokens=False, subtasks_reply="s").collect()}
    rows = run("similarity_only")
    # instance 1 links 0 to n0 (the same words: 1) and 1 to n1 (none in common: 0); instance 2 has no link
    assert rows[1]["model_score"] == pytest.approx(1 / (1 + math.exp(-0.4))) and rows[2]["model_score"] == pytest.approx(1 / (1 + math.exp(1.6)))
    assert {k: r["decision"] for k, r in run("Similarity_Only").items()} == {1: "reject", 2: "accept"} and rows[1]["unmatched_nodes"] == 0


def test_components_of_groups(spark):
    """Random links against union-find; one group holds half of all links, one is a long chain."""
    rng = random.Random(3)
    chain = [(2, i, i + 1) for i in range(60)]
    rows = [(g, rng.randrange(40), rng.randrange(40)) for g in (0, 1) for _ in range(25)] + [(9, rng.randrange(300), rng.randrange(300)) for _ in range(220)] + chain + [(5, 3, 3)]
    got = {(r["g"], r["vertex"]): r["component"] for r in components.components(frame(spark, rows, "g int, a int, b int"), ["g"], "a", "b").collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for g, a, b in rows:
        low, high = sorted((root((g, a)), root((g, b))))
        up[high] = low
    assert got == {x: root(x)[1] for x in list(up) if root(x) != x}


def test_connectivity_of_a_large_instance(spark, monkeypatch):
    """One instance holds half of all links; its last node alone joins the two halves of its subtasks."""
    links_of = lambda k, join: [(k, s, f"n{n}") for n in range(200) for s in ((0, 1) if n % 2 else (2, 3))] + ([(k, 1, "z"), (k, 2, "z")] if join else [])
    edges = frame(spark, links_of(1, True) + links_of(2, False)[:200] + links_of(3, True)[1:] + [(4, 0, "n")], "k int, subtask_index int, node_id string")
    sizes = frame(spark, [(1, 4, 201), (2, 4, 200), (3, 5, 201), (4, 1, 1), (5, 0, 0)], "k int, num_subtasks int, num_candidate_nodes int")
    want = {1: 1.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: 0.0}
    assert {r["k"]: r["is_connected"] for r in links.connected(edges, sizes, "k").collect()} == want
    assert {r["k"]: r["is_connected"] for r in links.connected_by_rounds(edges, sizes, "k").collect()} == want
    monkeypatch.setattr(links, "BITS", 4)  # instance 3 has more subtasks than bits
    assert {r["k"]: r["is_connected"] for r in links.connected(edges, sizes, "k").collect()} == want
    monkeypatch.undo()
    rng = random.Random(8)
    rows = [(k, rng.randrange(62), f"n{rng.randrange(60)}") for k in range(30) for _ in range(60 + 12 * k)]
    rows += [(90, s, f"c{s + d}") for s in range(62) for d in (0, 1)]  # a chain through all bits
    sizes2 = frame(spark, [(k, 62, 60) for k in [*range(30), 90]], "k int, num_subtasks int, num_candidate_nodes int")
    edges2 = frame(spark, rows, "k int, subtask_index int, node_id string")
    both = [{r["k"]: r["is_connected"] for r in f(edges2, sizes2, "k").collect()} for f in (links.connected, links.connected_by_rounds)]
    assert both[0] == both[1] and both[0][90] == 1.0 and set(both[0].values()) == {0.0, 1.0}
    plan = links.connected(edges, sizes, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_links_reply_that_is_no_clean_json(spark):
    replies = [
        '{"links":[3,{"subtask_index":1,"node_ids":["b"]}]}', '{"links":[{"subtask_index":1,"node_ids":["b"]}]} and then {x}', '{"links":[{"subtask_index":1,"node_ids":["b"]}]}}',
        'so: {"links":[{"subtask_index":true,"node_ids":[1,null,true,1.5," "]}]}.', '{"links":[{"subtask_index":0,"node_ids":0},{"subtask_index":1.0,"node_ids":["z"]},{"subtask_index":9,"node_ids":["z"]}]}', '{"links":3}', None,
    ]
    rows = links.parse_links(frame(spark, [(i, r, 2) for i, r in enumerate(replies)], "k int, s string, n int"), "k", "s", "n").where("size(node_ids) > 0").collect()
    assert {(r["k"], r["subtask_index"]): r["node_ids"] for r in rows} == {(0, 1): ["b"], (3, 1): ["1", "None", "True", "1.5"]}
    texts = ['{"a":1} x', '{"a":1}}', '{"a":1}]', "[1,2]]", "[1],[2]", " [1] ", "", "3", '{"a":1},"v":2']
    got = frame(spark, [(t,) for t in texts], "s string").select(T.whole_json(F.col("s")).cast("string")).collect()
    assert [r[0] for r in got] == [None, None, None, None, None, "[1]", None, "3", None]


def test_patched_files_in_one_pass(spark):
    """Both versions of a file from one table function, by DataFrame and by SQL; what goes wrong is a row of its own."""
    before = "def f(x):\n    y = 1\n    return y\n"
    hunk = "@@ -1,3 +1,3 @@\n def f(x):\n-    y = 1\n+    y = 2\n     return y\n"
    rows = [("p", "a.py", before, hunk), ("p", "new.py", None, "@@ -0,0 +1,2 @@\n+def g():\n+    return 1\n"), ("q", "a.py", "other\n", hunk), ("q", "b.py", before, hunk.replace("y = 2", "y = ("))]
    files = frame(spark, rows, "scope string, file string, source string, hunks string")
    got = pysource.patched_files(files).collect()
    sides = lambda file, old: [r["type"] for r in got if r["file"] == file and r["scope"] == "p" and r["is_node"] and r["old"] == old]
    assert sides("a.py", True) == sides("a.py", False) != [] and sides("new.py", True) == [] and len(sides("new.py", False)) == 3
    assert sorted((r["scope"], r["file"], r["problem"].split(":")[0]) for r in got if not r["is_node"]) == [("q", "a.py", "apply"), ("q", "b.py", "parse after")]
    pysource.register(spark)
    files.createOrReplaceTempView("touched")
    by_sql = spark.sql("SELECT * FROM patched_file(TABLE(touched) PARTITION BY scope)").collect()
    assert Counter(map(str, by_sql)) == Counter(map(str, got))
    patch = "--- a/a.py\n+++ b/a.py\n" + hunk + "--- a/c.py\n+++ b/c.py\n" + "@@ -1 +1,2 @@\n x = 1\n+def h(): return (\n"
    nodes, found = defense.patch_nodes(frame(spark, [(7, patch)], "k int, patch string"), frame(spark, [(7, "a.py", before), (7, "c.py", "x = 1\n")], "k int, path string, source string"), "k", "patch")
    row = found.first()
    assert (row["apply_success"], row["fallback_reason"], [e[:10] for e in row["parse_errors"]]) == (True, "", ["c.py parse"])
    assert {(r["file"], r["change_type"]) for r in nodes.collect()} == {("a.py", "modified")}


def test_stream_appends_each_key_once(spark, tmp_path):
    """Keys of earlier batches, of earlier starts and of a log that is not the stream's own are left out; a lost output is not asked."""
    source, schema = f"{tmp_path}/in", "instance_id string, h string, n int"
    old = frame(spark, [("z", "1")], "instance_id string, h string")
    run = lambda: logs.append_new(spark.readStream.schema(schema).parquet(source), ["instance_id", "h"], f"{tmp_path}/log", f"{tmp_path}/ck", order=["n"], done=old).awaitTermination()
    frame(spark, [("a", "1", 2), ("a", "1", 1), ("b", "1", 2), ("z", "1", 5), (None, "1", 3), (None, "1", 3)], schema).coalesce(1).write.parquet(source)
    run()
    first = sorted(map(str, spark.read.parquet(f"{tmp_path}/log").collect()))
    frame(spark, [("b", "1", 9), ("c", "1", 3), ("z", "2", 7), (None, "1", 0)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/log").collect()]
    assert Counter(rows) == Counter([("a", "1", 1), ("b", "1", 2), (None, "1", 3), ("c", "1", 3), ("z", "2", 7)])
    assert len(first) == 3 and set(first) <= set(map(str, spark.read.parquet(f"{tmp_path}/log").collect()))
    plan = logs.first_of_key(spark.readStream.schema(schema).parquet(source), ["h"])
    assert plan.isStreaming and plan.columns == ["instance_id", "h", "n"]


def _moody(prompt, settings):
    """A caller that refuses, fails for good, or fails until its third call."""
    import tempfile
    from pathlib import Path

    if prompt.startswith("never"):
        raise RuntimeError("no route")
    mark = Path(tempfile.gettempdir()) / f"spanlark-test-{settings['instance_id']}-{settings['model']}"
    if prompt.startswith("third"):
        tries = int(mark.read_text()) if mark.exists() else 0
        mark.write_text(str(tries + 1))
        if tries < 2:
            raise RuntimeError(f"try {tries}")
        mark.unlink()
    return f"re: {prompt}", {"total": len(prompt)}


def test_calls_are_cached_retried_and_recorded(spark, tmp_path):
    model = f"m{random.random()}"
    calls = frame(spark, [("i1", "plain", "x"), ("i1", "plain", "y"), ("i2", "third time", "x"), ("i3", "never", "x"), ("i4", "I refuse this", "x")], "instance_id string, prompt string, text string").withColumn("model", F.lit(model))
    caller = calls_op.Caller(_moody, backoff=0.0)
    rows = lambda c: {(r["instance_id"]): r for r in c.collect()}
    out = calls_op.generate(calls, caller, f"{tmp_path}/cache")
    assert out.count() == 5
    got = rows(out)
    assert (got["i1"]["text"], got["i1"]["call_count"], got["i1"]["token_usage"], got["i1"]["cache_hit"]) == ("re: plain", 1, {"total": 5}, False)
    assert (got["i2"]["text"], got["i2"]["call_count"], got["i2"]["error"]) == ("re: third time", 3, "")
    assert (got["i3"]["text"], got["i3"]["call_count"], got["i3"]["error"]) == (None, 3, "no route")
    assert got["i4"]["tool_blocked"] and not got["i1"]["tool_blocked"]
    key = {"fidelity_mode": "", "instance_id": "i1", "model": model, "module_config_hash": "", "module_kind": "", "module_name": "", "prompt_hash": hashlib.sha256(b"plain").hexdigest(), "provider": ""}
    assert got["i1"]["cache_key"] == hashlib.sha256(json.dumps(key, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 3
    again = rows(calls_op.generate(calls, calls_op.Caller(_moody, backoff=0.0, fallback=True, stand_in=lambda p: f"for {p}"), f"{tmp_path}/cache"))
    assert [again[i]["cache_hit"] for i in ("i1", "i2", "i3", "i4")] == [True, True, False, True] and again["i1"]["text"] == "re: plain"
    assert (again["i3"]["text"], again["i3"]["provider_fallback"], again["i3"]["error"]) == ("for never", True, "no route")
    assert rows(calls_op.generate(calls, caller, f"{tmp_path}/cache"))["i3"]["cache_hit"]
    other = rows(calls_op.generate(calls.withColumn("model", F.lit("s")), calls_op.Caller(_moody, surrogate=True, stand_in=str.upper), f"{tmp_path}/cache", parallel=2))
    assert other["i3"]["text"] == "NEVER" and not other["i3"]["provider_fallback"]
    calls_op.write_call_artifacts(calls_op.with_keys(calls).withColumn("text", F.lit("t")), f"{tmp_path}/artifacts")
    assert spark.read.json(f"{tmp_path}/artifacts").where("response = 't' and metadata.cache_key is not null").count() == 5
    assert calls_op.generate(calls.limit(0), caller, f"{tmp_path}/none").count() == 0
    waits = []
    calls_op.Caller(lambda p, s: 1 / 0, max_retries=3, backoff=0.5, wait=waits.append).answer("p", {})
    assert waits == [0.5, 1.0, 2.0]


def test_streamed_windows_match_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    late = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 40 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    events.unionByName(late, allowMissingColumns=True).repartition(1).write.parquet(f"{tmp_path}/ev")
    stream = logs.read_events(spark, f"{tmp_path}/ev", events.schema)
    name = "windows_out"
    q = logs.tumbling(stream, "ts", "1 day", ["event_type"]).writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    got = Counter((r["window"]["start"], r["event_type"], r["n"]) for r in spark.table(name).collect())
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count("*").alias("n"))
    assert got == Counter((r["window"]["start"], r["event_type"], r["n"]) for r in batch.collect())
