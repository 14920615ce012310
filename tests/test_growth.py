"""What keeps queries from growing faster than their tables: how often rows are moved, scanned, parsed and held."""

import pandas as pd
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from spanlark.functions import patterns, pysource
from spanlark.operators import defense, graphdiff, links, similarity
from spanlark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_of_the_structural_defense_is_broadcast(spark):
    assert "Broadcast" not in plan(QUERIES["structural_defense"](spark, SF))


def test_settings_that_fail_every_row_make_nothing(spark, monkeypatch):
    made, plain = [], defense.written
    monkeypatch.setattr(defense, "written", lambda df: made.append(df.columns) or plain(df))
    assert QUERIES["defense_stages"](spark, SF).count() == 7 * spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert len(made) == 2  # the rows, before and behind the parsers, for all seven settings


def test_modes_share_what_is_parsed(spark, monkeypatch):
    made, plain = [], defense.written
    monkeypatch.setattr(defense, "written", lambda df: made.append(df.columns) or plain(df))
    out = QUERIES["defense_modes"](spark, SF)
    assert len(made) == 10 and "Broadcast" not in plan(out)  # state twice, nodes, links, sizes, nodes' links, and four families of features


def test_nodes_are_scanned_once(spark):
    nodes = spark.createDataFrame([(1, "a", "eval(x)"), (1, "b", "open(p)"), (2, "a", "return")], "k int, node_id string, code string").distinct()
    sizes = spark.createDataFrame([(1, 2, 2), (2, 2, 1)], "k int, num_subtasks int, num_candidate_nodes int")
    edges = spark.createDataFrame([(1, 0, "a")], "k int, subtask_index int, node_id string")
    rows = links.severity_features(patterns.add_scores(nodes, F.col("code"), patterns.UNIVERSAL), edges, sizes, "k")
    assert "eval(" not in plan(rows)
    assert [(r["k"], r["num_suspicious_nodes"], r["cnt_code_execution"], r["cnt_file_access"]) for r in rows.orderBy("k").collect()] == [(1, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0)]


def test_sides_are_dealt_once(spark):
    row = "string file, string function, int start_line, int end_line, string type, string code_hash, string node_id"
    nodes = spark.createDataFrame([("f", "g", 1, 2, "b", "h", "i"), (None, "g", 1, 2, "b", "h", "i")], ", ".join(" ".join(reversed(c.split())) for c in row.split(", ")))
    after = nodes.withColumn("start_line", F.lit(5))
    diff = graphdiff.node_diff(nodes, after, [], carry=["code_hash"])
    assert plan(diff).count("Exchange hashpartitioning") == 1
    assert sorted((r["file"] or "", r["change_type"]) for r in diff.collect()) == [("", "added"), ("", "removed"), ("f", "moved")]


def test_graphs_are_handed_on_in_pieces():
    files = pd.DataFrame({"path": [str(k) for k in range(3000)], "source": ["def f(x):\n    return x\n"] * 3000})
    frames = list(pysource._rows(lambda g: iter(g.nodes), ["path", "function", "node_id", "type", "start_line", "end_line", "code_snippet", "code_hash", "contains_calls"])(iter([files])))
    assert sum(map(len, frames)) == 9000 and max(map(len, frames)) < 1100


def test_pairs_are_handed_on_tile_by_tile(spark, monkeypatch):
    got, plain = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, f, schema: got.append(f) or plain(self, f, schema))
    rows = spark.createDataFrame([(k, [1.0, k / 1000]) for k in range(1000)], "id long, v array<double>")
    assert similarity.link_vectors(rows, rows, "id", "id", "v", 0.1).count() == 1_000_000
    pdf = pd.DataFrame({"id": range(2000), "v": [[1.0, 0.0]] * 2000, "side": [0] * 1000 + [1] * 1000})
    frames = list(got[0](iter([pdf])))
    assert sum(map(len, frames)) == 1_000_000 and max(map(len, frames)) <= 128 * 1000
