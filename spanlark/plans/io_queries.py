"""Queries over readers, calls, logs, bundles and vectors, with their SQL. Files that they read are written from the tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlark.operators import bundles, calls, links, policies, similarity, training
from spanlark.plans.queries import MODEL, ORACLES, _edges, _sizes, query, r6
from spanlark.sources import readers
from spanlark.sources.tables import shared_folder
from spanlark.streaming import logs

GOOD = "concat('{\"doc_id\":', doc_id, ',\"lang\":\"', lang, '\",\"n\":', n_chars, '}')"
LINE = f"CASE n_chars % 7 WHEN 0 THEN concat({GOOD}, ' and more') WHEN 1 THEN concat('[', {GOOD}, ']') WHEN 2 THEN replace({GOOD}, '\"n\":', '\"n\":\"x\",\"m\":') WHEN 3 THEN concat('{{\"doc_id\":', doc_id) ELSE concat(' ', {GOOD}) END"


def _lines(t, lines: DataFrame) -> str:
    """A folder with the lines as text, in files that follow the order of ``doc_id``, blank lines between them."""
    path = shared_folder(lines.sparkSession)
    lines.repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").select(F.concat("line", F.lit("\n")).alias("value")).write.text(path)
    return path


@query(f"""SELECT doc_id - (SELECT min(doc_id) FROM documents) AS pos, CASE n_chars % 7 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'no object' WHEN 2 THEN 'a field of another type' WHEN 3 THEN 'invalid JSON' END AS reason,
 CASE WHEN n_chars % 7 > 3 THEN doc_id END AS doc_id, CASE WHEN n_chars % 7 > 3 THEN lang END AS lang, CASE WHEN n_chars % 7 > 3 THEN n_chars END AS n, md5(CASE WHEN n_chars % 7 < 4 THEN {LINE} END) AS text FROM documents""")
def json_rejects(t):
    path = _lines(t, t("documents").select("doc_id", F.expr(LINE).alias("line")))
    good, bad = readers.json_lines(t("documents").sparkSession, path, "doc_id long, lang string, n long")
    rows = good.unionByName(bad, allowMissingColumns=True)
    return rows.select("pos", "reason", "doc_id", "lang", "n", F.md5("text").alias("text"))


@query("""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CASE WHEN n_chars % 3 = 0 THEN 'row-' || (row_number() OVER (ORDER BY doc_id) - 1) ELSE 'd' || doc_id END AS instance_id, source AS prompt, CASE WHEN n_chars % 5 = 0 THEN 'no repository path' END AS reason FROM documents""")
def row_numbers(t):
    line = F.expr("to_json(named_struct('id', CASE WHEN n_chars % 3 = 0 THEN ' ' ELSE concat('d', doc_id) END, 'prompt', source, 'repo_path', CASE WHEN n_chars % 5 > 0 THEN '/r' END))")
    path = _lines(t, t("documents").select("doc_id", line.alias("line"))) + "/part-*"
    spark = t("documents").sparkSession
    raw, _ = readers.json_lines(spark, path, readers.INSTANCE)
    good, bad = readers.instances_of(raw, raw.limit(0).select("pos", F.lit("").alias("text"), F.lit("").alias("reason")))
    both = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)
    return both.select("pos", "instance_id", "prompt", "reason")


def answer(prompt: str, settings: dict) -> tuple[str, dict]:
    """Stands for a service: it is down for some prompts."""
    if prompt.endswith("7"):
        raise RuntimeError("down")
    return f"re: {prompt}", {"total": len(prompt)}


CALL_SQL = "source || ' ' || (n_chars % 50)"


@query(f"""WITH d AS (SELECT doc_id, n_chars, {CALL_SQL} AS prompt, (n_chars % 50) % 10 = 7 AS down, source = 'web' OR (n_chars % 50) < 20 AS had FROM documents)
SELECT doc_id, CASE WHEN had THEN 'old ' || prompt WHEN down THEN NULL ELSE 're: ' || prompt END AS text, had AS cache_hit, CASE WHEN had THEN '' WHEN down THEN 'down' ELSE '' END AS error, CASE WHEN had THEN 1 WHEN down THEN 3 ELSE 1 END::BIGINT AS calls, CASE WHEN NOT had AND NOT down THEN length(prompt) END::BIGINT AS used FROM d""")
def cached_calls(t):
    docs = t("documents")
    rows = docs.select("doc_id", F.concat_ws(" ", "source", (F.col("n_chars") % 50).cast("string")).alias("prompt"), F.lit("chat").alias("module_kind"), F.lit("m").alias("model"))
    path = shared_folder(docs.sparkSession)
    known = calls.with_keys(rows).join(docs.select("doc_id", "source", "n_chars"), "doc_id").where("source = 'web' OR n_chars % 50 < 20")
    kinds = dict(x.split() for x in calls.CACHE.split(", "))
    old = known.dropDuplicates(["cache_key"]).withColumns({"text": F.concat(F.lit("old "), "prompt"), "error": F.lit(""), "call_count": F.lit(1), "provider_fallback": F.lit(False)})
    old.select(*[(F.col(c) if c in old.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]).write.parquet(path)
    out = calls.generate(rows, calls.Caller(answer, backoff=0.0), path)
    return out.select("doc_id", "text", "cache_hit", "error", F.col("call_count").cast("long").alias("calls"), F.try_element_at("token_usage", F.lit("total")).alias("used"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def append_once(t):
    """A stream of events from several files, the first of each user and type appended once; run to its end here."""
    events = t("events").select("user_id", "event_type", "event_id")
    spark = events.sparkSession
    source, target, state = (shared_folder(spark) for _ in range(3))
    events.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    logs.append_new(stream, ["user_id", "event_type"], target, state, order=["event_id"]).awaitTermination()
    return spark.read.schema(events.schema).parquet(target)


@query("SELECT label, i::BIGINT AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2")
def mean_pooling(t):
    pooled = similarity.mean_pooled(t("embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("pooled").alias("dim", "mean")).select("label", F.col("dim").cast("long").alias("dim"), r6("mean").alias("mean"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE * 20) AS s FROM embeddings), p AS (SELECT vec_id, s, list_transform(s, lambda x: exp(x - list_max(s))) AS w FROM e)
SELECT vec_id, (list_position(s, list_max(s)) - 1)::BIGINT AS predicted_class, round(w[2] / list_sum(w), 6) AS score, CASE WHEN w[2] / list_sum(w) >= 0.25 THEN 'reject' ELSE 'accept' END AS decision FROM p""")
def sequence_scores(t):
    rows = t("embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 20).alias("logits"))
    return policies.sequence_classifier(rows, "logits", 0.25).select("vec_id", F.col("predicted_class").cast("long").alias("predicted_class"), r6("score").alias("score"), "decision")


@query(ORACLES["logistic_score"])
def bundle_score(t):
    """The fixed model as a pipeline, saved and loaded again."""
    path = shared_folder(t("supplier").sparkSession)
    bundles.of_linear(MODEL).save(path)
    loaded = bundles.load(t("supplier").sparkSession, path)
    return loaded.score(links.link_features(_edges(t), _sizes(t), "instance")).select("instance", r6("score").alias("score"), "prediction")


# ---- training data

PREPARED_SQL = """WITH a AS (SELECT 'i' || (doc_id % 400) AS instance_id, n_chars % 2 AS label, CASE WHEN n_chars % 5 > 0 THEN source || ' ' || doc_id END AS prompt, doc_id FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS r FROM a), rows AS (SELECT * FROM k WHERE r <= 450 AND prompt IS NOT NULL) """


def _prepared(t, strategy: str) -> DataFrame:
    docs = t("documents")
    results = docs.select(F.concat(F.lit("i"), F.col("doc_id") % 400).alias("instance_id"), F.col("doc_id").cast("string").alias("attack_artifact_path"), F.col("doc_id").alias("pos"), "n_chars", F.lit("toy").alias("dataset"), *[F.lit(None).cast("string").alias(c) for c in ("attack_name", "agent_name", "defense_decision", "adv_prompt_hash")], F.lit(True).alias("tests_passed"))
    prompts = docs.where("n_chars % 5 > 0").select(F.col("doc_id").cast("string").alias("attack_artifact_path"), F.concat(F.lit(" "), "source", F.lit(" "), "doc_id").alias("prompt"))
    return training.prepare(results.where("n_chars % 2 = 0"), results.where("n_chars % 2 = 1"), prompts, strategy=strategy, limit=450)


@query(PREPARED_SQL + """, ids AS (SELECT DISTINCT label, instance_id FROM rows), cut AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42|' || instance_id), instance_id) AS p, count(*) OVER (PARTITION BY label) AS n FROM ids)
SELECT instance_id, label::INT AS label, prompt, 'toy' AS dataset, '' AS attack_name, CASE WHEN p <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM rows JOIN cut USING (label, instance_id)""")
def training_data(t):
    return _prepared(t, "stratified_instance").select("instance_id", "label", "prompt", "metadata.dataset", "metadata.attack_name", "split")


@query(PREPARED_SQL + """, s AS (SELECT count(*) AS n FROM rows) SELECT n AS total_instances, floor(n * 0.8)::BIGINT AS train_instances, n - floor(n * 0.8)::BIGINT AS test_instances FROM s""")
def training_counts(t):
    return training.statistics(_prepared(t, "random")).select("total_instances", "train_instances", "test_instances")


@query("""WITH p AS (SELECT toxic AS y, CASE WHEN length(text) < 500 THEN 0.3 WHEN n_chars % 2 = 0 THEN 1.0 ELSE 0.7 END AS p FROM documents JOIN labels USING (doc_id)), q AS (SELECT y, greatest(1e-7, least(1 - 1e-7, p)) AS p FROM p)
SELECT round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS mean_loss, count(*)::BIGINT AS n FROM q""")
def loss_of_scores(t):
    rows = t("documents").join(t("labels"), "doc_id").withColumn("p", F.expr("CASE WHEN length(text) < 500 THEN 0.3D WHEN n_chars % 2 = 0 THEN 1.0D ELSE 0.7D END"))
    return training.mean_loss(rows, "toxic", "p").select(r6("mean_loss").alias("mean_loss"), "n")
