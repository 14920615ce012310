import json

import pytest
from pyspark.sql import functions as F

from spanlark.operators import attacks, runs, settings
from spanlark.sources import readers


@pytest.fixture
def folder(tmp_path):
    known = {
        "datasets/lite": {"split": "test"}, "agents/dummy": {"name": "dummy", "plugin": "dummy", "style": "add_fix"}, "attacks/none": {}, "attacks/swexploit": {"plugin": "swexploit", "mode": "llm"},
        "baselines/gate": {"reject_threshold": 0.5}, "baselines/wall": {"reject_threshold": 0.0},
    }
    for name, part in known.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.json").write_text(json.dumps(part))
    return str(tmp_path)


RUN = {"datasets": ["swebench_lite"], "agents": ["dummy"], "attacks": ["none", "swexploit"], "baselines": ["gate", "wall"], "limit": 5}


def test_digest_ignores_the_order_of_keys_and_escapes():
    assert settings.digest({"b": 1, "a": "é"}) == settings.digest({"a": "é", "b": 1})
    import hashlib

    assert settings.digest({"a": "é"}) == hashlib.sha256(b'{"a":"\\u00e9"}').hexdigest()


def test_parts_by_name(folder):
    assert settings.load_part(folder, "dataset", "swebench_lite") == {"split": "test"}
    assert settings.load_part(folder, "baseline", "gate", {"reject_threshold": 0.7}) == {"reject_threshold": 0.7}
    for part, name, changes, error in (("agent", "other", None, FileNotFoundError), ("agent", "../agents/dummy", None, ValueError), ("agent", "dummy", {"plugin": "x"}, ValueError)):
        with pytest.raises(error):
            settings.load_part(folder, part, name, changes)


def test_a_matrix_runs_from_its_settings_and_resumes(spark, folder):
    planned, parts = settings.matrix(spark, RUN, folder)
    assert planned.count() == 4 and parts["attack"]["swexploit"]["mode"] == "llm"
    instances = spark.createDataFrame([("a", "swebench_lite", "Fix add()"), ("b", "swebench_lite", "Fix sub()")], "instance_id string, dataset string, prompt string")
    verdicts = instances.join(planned, "dataset").select("run_name", "instance_id", F.lit("accept").alias("decision"), F.lit(None).cast("string").alias("edited_text"))
    out = runs.run_matrix(instances, planned, attacks.toy_agent, verdicts)
    assert out.count() == 8 and {r[0] for r in out.select("baseline_config_hash").distinct().collect()} == {settings.digest(parts["baseline"][b]) for b in ("gate", "wall")}

    log = spark.createDataFrame(out.select("instance_id", *runs.RUN_KEYS).collect(), "instance_id string, dataset string, agent_config_hash string, attack_config_hash string, fidelity_mode string, baseline_config_hash string")
    assert runs.run_matrix(instances, planned, attacks.toy_agent, verdicts, done=log).count() == 0
    changed, _ = settings.matrix(spark, RUN, folder, changes={"baseline": {"gate": {"reject_threshold": 0.6}}})
    assert {r["baseline_name"] for r in runs.run_matrix(instances, changed, attacks.toy_agent, verdicts, done=log).collect()} == {"gate"}
    prebuilt, parts = settings.matrix(spark, RUN, folder, prebuilt="/p.jsonl")
    assert parts["attack"]["swexploit"]["mode"] == "prebuilt_json" and parts["attack"]["none"] == {}
    assert {r["attack_name"] for r in runs.run_matrix(instances, prebuilt, attacks.toy_agent, verdicts, done=log).collect()} == {"swexploit"}


def test_settings_that_name_no_part(spark, folder):
    for run in ({k: v for k, v in RUN.items() if k != "agents"}, RUN | {"agents": []}):
        with pytest.raises(ValueError):
            settings.matrix(spark, run, folder)


def test_specifications(spark, folder):
    planned, parts = settings.matrix(spark, RUN, folder)
    rows = settings.specifications(planned, parts, invocation="run x", commit="abc").orderBy("run_id").collect()
    assert [r["cli_invocation"] for r in rows] == ["run x"] * 4 and rows[0]["selected_plugins"] == {"dataset": "swebench_lite", "agent": "dummy", "attack": "none", "baseline": "gate"}
    assert json.loads(rows[1]["selected_configs"]["baseline"]) == {"reject_threshold": 0.0}


def test_reports_of_nothing_of_rejects_alone_and_of_null_reasons(spark):
    empty = spark.createDataFrame([], "instance_id string, dataset string")
    assert settings.dataset_reports(empty, ["dataset"]).count() == 0
    bad = spark.createDataFrame([("x", None), ("x", None), ("x", "odd")], "dataset string, reason string")
    row = settings.dataset_reports(empty, ["dataset"], bad).first()
    assert (row["loaded"], row["failed"], row["failure_reasons"], row["warnings"]) == (0, 3, {"odd": 1, "unknown": 2}, [])


def test_patch_records_of_patches_not_tried(spark):
    rows = spark.createDataFrame([("a", "x", "y", "z"), ("b", None, "y", None)], "instance_id string, ori_patch string, adv_patch string, final_patch string")
    got = {r["instance_id"]: r["apply_status"].asDict() for r in settings.patch_records(rows, ["instance_id"]).collect()}
    assert got == {"a": {"applied": False, "message": "not_applied_yet"}, "b": {"applied": False, "message": "rejected"}}


def test_patches_are_written_with_their_status(spark, tmp_path):
    from spanlark.sources import sinks

    rows = spark.createDataFrame([("a", "x", "y", "z"), ("b", "x", "y", None)], "instance_id string, ori_patch string, adv_patch string, final_patch string")
    tried = spark.createDataFrame([("a", True, "applied")], "instance_id string, applied boolean, message string")
    sinks.write_patches(rows, str(tmp_path / "p"), applied=tried)
    got = {r["instance_id"]: r for r in spark.read.json(str(tmp_path / "p")).collect()}
    assert got["a"]["apply_status"]["message"] == "applied" and got["b"]["apply_status"]["applied"] is False and got["a"]["final_patch"] == "z"
    assert readers.exists(spark, str(tmp_path / "p"))
