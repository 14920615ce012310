"""The structural defense: candidate nodes of a patch, its links to subtasks, features, score and decision."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlark.functions import patterns, pysource
from spanlark.functions import text as T
from spanlark.operators import graphdiff, hunks, links, policies, scoring, similarity
from spanlark.operators.bundles import Bundle
from spanlark.sources.tables import shuffled, spread, written

#: Which of the universal features tell of security, and the modes that take some of them.
SECURITY_PREFIXES = ("suspicious_", "cnt_")
SEVERITY_ONLY = ["max_severity_universal", "mean_severity_universal", "top3_severity_sum_universal", "num_suspicious_nodes_universal", "frac_suspicious_nodes_universal"]
SECURITY = ["max_severity", "mean_severity", "top3_severity_sum", "num_suspicious_nodes", "frac_suspicious_nodes", *SEVERITY_ONLY]
MODES = {
    "structural_only": links.STRUCTURAL, "similarity_only": links.SIMILARITY, "structural_combined": links.STRUCTURAL + links.SIMILARITY, "full_universal": links.UNIVERSAL, "severity_only_universal": SEVERITY_ONLY,
    "no_security": [c for c in links.UNIVERSAL if c not in SECURITY and not c.startswith(SECURITY_PREFIXES)],
}
STAGES = ("cfg", "subtasks", "grounding", "model_load", "features", "inference")
NODE_COLUMNS = ["node_id", "change_type", "file", "function", "start_line", "end_line", "node_type", "code_snippet"]


def feature_columns(mode: str) -> list[str]:
    if (key := mode.strip().lower()) not in MODES:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
    return MODES[key]


def with_features(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The key and the columns in order; what is missing or null is 0."""
    return df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


def placed(nodes: DataFrame) -> DataFrame:
    """Files and functions of nodes that lack them, from ids like file::function::rest."""
    part = lambda n: F.get(F.split("node_id", "::"), F.lit(n))
    has = F.contains("node_id", F.lit("::"))
    fill = lambda c, n: F.coalesce(T.blank_to_null(F.col(c)), F.when(has, part(n)), F.lit(""))
    return nodes.withColumn("file", fill("file", 0)).withColumn("function", fill("function", 1))


def link_error(reply: Column) -> Column:
    """What is wrong with a JSON array of links, the first fault first; null if every one has an index and a list of text ids."""
    value = F.try_parse_json(reply)
    items = F.try_variant_get(value, "$", "array<variant>")
    kind = lambda v: F.schema_of_variant(v)
    ids = lambda i: F.try_variant_get(i, "$.node_ids", "array<variant>")

    def fault(i: Column) -> Column:
        index = F.try_variant_get(i, "$.subtask_index", "variant")
        return (
            F.when(~kind(i).startswith("OBJECT"), "must be an object").when(index.isNull() | (kind(index) != "BIGINT"), "has no integer subtask_index").when(ids(i).isNull(), "has no list of node_ids")
            .when(F.exists(ids(i), lambda n: kind(n) != "STRING"), "has a node id that is no text")
        )

    faults = F.filter(F.transform(items, lambda i, k: F.when(fault(i).isNotNull(), F.concat(F.lit("link "), k.cast("string"), F.lit(" "), fault(i)))), lambda f: f.isNotNull())
    return F.when(items.isNull(), "links must be a list").otherwise(F.get(faults, F.lit(0)))


def scanned(code: Column, mode: str) -> Column:
    """Code as it is scanned: its tokens without comments and strings, joined by spaces (so a name and a parenthesis are apart);
    without C comments; or as it is."""
    if mode.strip().lower() == "python_tokenize":
        return pysource.over_text(pysource.strip_tokens)(code)
    return T.strip_c_comments(code) if mode.strip().lower() == "regex_conservative" else code


def severity_summary(nodes: DataFrame, key: str) -> DataFrame:
    """Scored nodes of each key: all, suspicious, benign, test code and validation."""
    return nodes.groupBy(key).agg(
        F.count("*").alias("total_nodes"), F.count_if("is_suspicious").alias("suspicious_nodes"), F.count_if("is_benign").alias("benign_nodes"),
        F.count_if(T.is_test_code(F.col("file"), F.col("function"))).alias("test_nodes"), F.count_if(T.is_validation_code(F.col("code_snippet"))).alias("validation_nodes"),
    )


def linked_texts(edges: DataFrame, subtasks: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """The subtask's and the node's text of each link; links to unknown subtasks, unknown nodes or nodes without code go."""
    code = nodes.where("code_snippet <> ''").select(key, "node_id", "code_snippet").dropDuplicates([key, "node_id"])
    return edges.join(subtasks.select(key, "subtask_index", "subtask"), [key, "subtask_index"]).join(code, [key, "node_id"])


def patch_nodes(patches: DataFrame, sources: DataFrame, key: str, patch: str, allow_fallback: bool | str = True) -> tuple[DataFrame, DataFrame]:
    """(candidate nodes, diagnostics) of each patch. sources: (key, path, source), the files before the patch.

    Where the key has sources, every touched Python file takes its hunks and parses before and after in one pass; candidates are
    the difference of the control-flow graphs, and a version that is no Python has none. Otherwise they are the hunks themselves, if
    that is allowed (a column's name: for each patch); the diagnostics say which, and why. A key is text here; ids of nodes do not hold it."""
    allowed = F.col(allow_fallback) if isinstance(allow_fallback, str) else F.lit(allow_fallback)
    patches = patches.select(F.col(key).cast("string").alias("_key"), F.col(patch).alias("patch"), allowed.alias("_allowed"))
    sources = sources.select(F.col(key).cast("string").alias("_key"), F.col("path").alias("file_path"), "source")
    touched = patches.select("_key", "_allowed", F.filter(T.touched_files(F.col("patch")), lambda f: f.endswith(".py")).alias("touched_python_files"))
    has_base = sources.select("_key").distinct()
    in_order = F.array_sort(F.collect_list(F.struct(F.length("chunk_id").alias("n"), "chunk_id", "raw_hunk")))
    based = patches.join(has_base, "_key", "left_semi")
    parts = hunks.hunks(based, "_key", "patch").where(F.col("file_path").endswith(".py")).groupBy("_key", "file_path").agg(F.array_join(F.transform(in_order, lambda h: h["raw_hunk"]), "\n").alias("hunks"))
    files = parts.join(sources, ["_key", "file_path"], "left").select(F.col("_key").alias("scope"), F.col("file_path").alias("file"), "source", "hunks")
    parsed = written(pysource.patched_files(files).withColumnRenamed("scope", "_key"))  # read for the problems and for the nodes

    listed = lambda prefix: F.array_sort(F.collect_list(F.when(F.col("problem").startswith(prefix), F.concat("file", F.lit(" "), "problem"))))
    problems = parsed.where("not is_node").groupBy("_key").agg(listed("apply").alias("_apply"), listed("parse").alias("parse_errors"), listed("error").alias("_error"))
    state = touched.join(has_base.withColumn("_base", F.lit(True)), "_key", "left").join(problems, "_key", "left")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    empty = F.size("touched_python_files") == 0
    reason = F.when(empty, "").when(F.col("_base").isNull(), "missing_base_repo").when(some("_apply"), "patch_apply_failed").when(some("_error"), "cfg_diff_exception").otherwise("")
    state = state.withColumn("fallback_reason", reason).withColumn("fallback_used", (F.col("fallback_reason") != "") & F.col("_allowed"))
    state = state.withColumn("apply_success", F.when(F.col("_base") & ~empty, ~some("_apply"))).withColumn("parse_errors", F.coalesce("parse_errors", F.expr("cast(array() as array<string>)")))

    diff = graphdiff.sides_diff(parsed.where("is_node"), "old", ["_key"], carry=["code_snippet"])
    changed = graphdiff.candidates(diff, ["_key"]).select("_key", "node_id", "change_type", "file", "function", "start_line", "end_line", F.col("type").alias("node_type"), F.col("after_code_snippet").alias("code_snippet"))
    changed = changed.join(state.where("fallback_reason = ''").select("_key"), "_key", "left_semi")
    plain = hunks.hunk_nodes(patches.join(state.where("fallback_used").select("_key"), "_key", "left_semi"), "_key", "patch").select("_key", *NODE_COLUMNS)
    diagnostics = state.select(F.col("_key").alias(key), "touched_python_files", "fallback_used", "fallback_reason", "apply_success", "parse_errors")
    return changed.unionByName(plain).withColumnRenamed("_key", key), diagnostics


@dataclass(frozen=True)
class Settings:
    """Settings of the structural defense. Names are trimmed and lower-cased here, once; whether they are known shows in ``faults``."""

    mode: str = "structural_combined"
    threshold: float = 0.5
    policy: str = "reject_if_score_ge_threshold"
    severity_mode: str = "universal"
    comment_stripping: str = "python_tokenize"
    marker_debug: bool = False
    prompt_parser: str = "llm_subtasks"
    patch_parser: str = "cfg_ast"
    linker: str = "llm_grounding"
    allow_fallback: bool = True
    allow_fallback_non_toy: bool | None = None
    similarity_threshold: float = 0.3
    mask_tokens: bool = True
    most_missing: float = 0.05

    def __post_init__(self) -> None:
        for name in ("mode", "policy", "severity_mode", "comment_stripping", "prompt_parser", "patch_parser", "linker"):
            object.__setattr__(self, name, str(getattr(self, name)).strip().lower())

    @property
    def similar(self) -> bool:
        return self.mode in ("similarity_only", "structural_combined")

    @property
    def structural(self) -> bool:
        return self.similar or self.mode == "structural_only"

    def faults(self, model: scoring.LinearModel | Bundle | None, vectorizer: bool) -> dict[str, str]:
        """What fails every row that comes as far as a stage, by stage; "settings" comes before the first."""
        out = {}
        if self.mode not in MODES:
            return {"settings": f"no mode {self.mode!r}"}
        for stage, kind, name in (("subtasks", PROMPT_PARSERS, self.prompt_parser), ("cfg", PATCH_PARSERS, self.patch_parser), ("grounding", LINKERS, self.linker)):
            if name not in kind:
                return {f"settings:{stage}": f"no parser {name!r}; there are {', '.join(sorted(kind))}"}
        if self.severity_mode in ("markers", "dataset_markers", "hybrid") and not self.marker_debug:
            out["init"] = "pattern tables with dataset markers need the debug mode"
        if model is None:
            out["model_load"] = "there is no model"
        elif self.similar and not vectorizer:
            out["model_load"] = "the model has no vectorizer"
        if not self.structural and self.severity_mode not in patterns.TABLES:
            out["features"] = f"no pattern table {self.severity_mode!r}"
        if model is not None:
            try:
                scoring.check_features(model, feature_columns(self.mode), self.most_missing)
            except ValueError as e:
                out["inference"] = str(e)
        if self.policy not in policies.POLICIES:
            out.setdefault("inference", f"no policy {self.policy!r}")
        return out


@dataclass(frozen=True)
class Inputs:
    """Tables and columns that the parsers read. A call that failed left its reply null (or its error column filled)."""

    patch: str = "patch"
    dataset: str | None = None
    sources: DataFrame | None = None  # (key, path, source)
    nodes: DataFrame | None = None  # candidate nodes of patches that were parsed before
    chunks_reply: str | None = None
    subtasks_reply: str | None = None
    subtasks_error: str | None = None
    links_reply: str | None = None
    links_error: str | None = None
    sims: DataFrame | None = None  # (key, sim) of linked pairs
    vocabulary: DataFrame | None = None  # (term, idf) of the model's vectorizer
    subtask_vectors: DataFrame | None = None  # (key, subtask_index, vector)
    node_vectors: DataFrame | None = None  # (key, node_id, vector)


def call_problem(df: DataFrame, reply: str | None, error: str | None, what: str) -> Column:
    """Why a reply cannot be used; null where it can."""
    told = T.blank_to_null(F.col(error)) if error and error in df.columns else F.lit(None).cast("string")
    there = F.col(reply).isNotNull() if reply and reply in df.columns else F.lit(False)
    return F.coalesce(told, F.when(~there, F.lit(f"the call for {what} has no reply")))


NO_DIAGNOSTICS = {"_problem": "string", "fallback_used": "boolean", "fallback_reason": "string"}


def parse_cfg(rows: DataFrame, key: str, given: Inputs, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Patch parser: nodes from the difference of control-flow graphs, or from hunks where that is allowed."""
    if given.nodes is not None:
        return given.nodes, rows.select(key, *[F.lit(None).cast(t).alias(c) for c, t in NO_DIAGNOSTICS.items()])
    other = settings.allow_fallback if settings.allow_fallback_non_toy is None else settings.allow_fallback_non_toy
    toy = F.lower(T.strip(F.coalesce(F.col(given.dataset), F.lit("")))).isin("", "toy") if given.dataset else F.lit(True)
    rows = rows.withColumn("_allow", F.when(toy, settings.allow_fallback).otherwise(other))
    sources = given.sources if given.sources is not None else rows.select(key, F.lit("").alias("path"), F.lit("").alias("source")).limit(0)
    nodes, found = patch_nodes(rows, sources, key, given.patch, "_allow")
    kind = dict(rows.dtypes)[key]
    problem = F.when((F.col("fallback_reason") != "") & ~F.col("fallback_used"), F.concat(F.lit("hunks may not stand in: "), "fallback_reason"))
    return nodes.withColumn(key, F.col(key).cast(kind)), found.select(F.col(key).cast(kind).alias(key), problem.alias("_problem"), "fallback_used", "fallback_reason")


def parse_chunks(rows: DataFrame, key: str, given: Inputs, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Patch parser: nodes from a model's reply with chunks of code."""
    problem = call_problem(rows, given.chunks_reply, None, "chunks")
    nodes = hunks.chunk_nodes(rows, key, given.chunks_reply).select(key, *NODE_COLUMNS) if given.chunks_reply else rows.select(key, *[F.lit(None).cast("string").alias(c) for c in NODE_COLUMNS]).limit(0)
    return nodes, rows.select(key, problem.alias("_problem"), F.lit(False).alias("fallback_used"), F.lit("").alias("fallback_reason"))


def parse_steps(rows: DataFrame, key: str, given: Inputs, settings: Settings) -> tuple[Column, Column]:
    """Prompt parser: the array of steps, and why there is none."""
    steps = T.subtasks(F.col(given.subtasks_reply)) if given.subtasks_reply else F.expr("cast(array() as array<string>)")
    return steps, call_problem(rows, given.subtasks_reply, given.subtasks_error, "subtasks")


def link_replies(rows: DataFrame, nodes: DataFrame, key: str, given: Inputs, settings: Settings) -> tuple[DataFrame, Column]:
    """Linker: (key, subtask_index, node_id) from a model's reply, and why there is none."""
    problem = call_problem(rows, given.links_reply, given.links_error, "links")
    if not given.links_reply:
        return rows.select(key, F.lit(0).alias("subtask_index"), F.lit("").alias("node_id")).limit(0), problem
    return links.edges(links.parse_links(rows, key, given.links_reply, "num_subtasks"), key), problem


def link_similar(rows: DataFrame, nodes: DataFrame, key: str, given: Inputs, settings: Settings) -> tuple[DataFrame, Column]:
    """Linker: an instance's steps and nodes whose vectors have a cosine of at least ``similarity_threshold``."""
    if given.subtask_vectors is None or given.node_vectors is None:
        return rows.select(key, F.lit(0).alias("subtask_index"), F.lit("").alias("node_id")).limit(0), F.lit("there are no vectors")
    s = given.subtask_vectors.select(key, "subtask_index", similarity.unit(F.col("vector")).alias("_s")).join(rows.select(key, "num_subtasks"), key).where("subtask_index < num_subtasks")
    n = given.node_vectors.select(key, "node_id", similarity.unit(F.col("vector")).alias("_n"))
    near = s.join(n, key).where(similarity.dot(F.col("_s"), F.col("_n")) >= settings.similarity_threshold)
    return near.select(key, "subtask_index", "node_id"), F.lit(None).cast("string")


#: Contracts. A prompt parser gives (steps, problem) as columns of the rows; a patch parser gives (nodes, outcomes), tables by key with
#: ``NODE_COLUMNS`` and with ``NO_DIAGNOSTICS``; a linker gives (links, problem): a table by key and a column.
PROMPT_PARSERS = {"llm_subtasks": parse_steps}
PATCH_PARSERS = {"cfg_ast": parse_cfg, "llm_chunks": parse_chunks}
LINKERS = {"llm_grounding": link_replies, "embedding_similarity": link_similar}


def failing(df: DataFrame, stage: str, problem: Column) -> DataFrame:
    """Rows that have not failed fail in ``stage`` where there is a problem."""
    now = F.col("stage_failed").isNull() & problem.isNotNull()
    return df.withColumns({"error": F.when(now, problem).otherwise(F.col("error")), "stage_failed": F.when(now, stage).otherwise(F.col("stage_failed"))})


def tfidf_sims(edges: DataFrame, steps: DataFrame, nodes: DataFrame, vocabulary: DataFrame, key: str, mask: bool) -> DataFrame:
    """(key, sim) of each link whose node has code, by the weights of a vocabulary."""
    code = nodes.select(key, "node_id", pysource.over_text(pysource.mask_tokens)("code_snippet").alias("code_snippet")) if mask else nodes
    pairs = linked_texts(edges, steps, code, key).withColumn("_pair", F.monotonically_increasing_id())
    pairs = written(pairs.select(key, "_pair", "subtask", "code_snippet"))
    texts = pairs.select("_pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("subtask").alias("t")), F.struct(F.lit(1).alias("side"), F.col("code_snippet").alias("t")))).alias("x")).select(F.struct("_pair", "x.side").alias("_k"), F.col("x.t").alias("t"))
    weights = similarity.tfidf_weights(similarity.terms(texts, "_k", "t"), vocabulary, "_k").select("_k._pair", "_k.side", "term", "w")
    both = weights.groupBy("_pair", "term").agg(F.sum(F.when(F.col("side") == 0, F.col("w"))).alias("a"), F.sum(F.when(F.col("side") == 1, F.col("w"))).alias("b"))
    sims = both.groupBy("_pair").agg(F.sum(F.col("a") * F.col("b")).alias("sim"))
    return pairs.select(key, "_pair").join(sims, "_pair", "left").select(key, F.coalesce("sim", F.lit(0.0)).alias("sim"))


@dataclass
class Parsed:
    """Rows that the parsers and the linker have gone through, for all modes that read them: what several need is made once, when
    the first asks for it."""

    key: str
    settings: Settings
    given: Inputs
    state: DataFrame
    nodes: DataFrame
    made: dict

    def once(self, name: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.made:
            self.made[name] = written(make())
        return self.made[name]

    @property
    def alive(self) -> DataFrame:
        return self.state.where("stage_failed is null")

    @property
    def keys(self) -> DataFrame:
        return shuffled(self.alive.select(self.key))

    def found(self) -> DataFrame:
        return self.once(("found",), lambda: self.nodes.join(self.keys, self.key, "left_semi"))

    def edges(self) -> DataFrame:
        linked = lambda: LINKERS[self.settings.linker](spread(self.alive, self.key), self.found(), self.key, self.given, self.settings)[0]
        return self.once(("edges",), lambda: linked().join(self.keys, self.key, "left_semi"))

    def counted(self) -> DataFrame:
        number = self.found().groupBy(self.key).agg(F.count_distinct("node_id").alias("num_candidate_nodes"))
        return self.once(("counted",), lambda: self.alive.select(self.key, "num_subtasks").join(shuffled(number), self.key, "left").na.fill({"num_candidate_nodes": 0}))

    def per_node(self) -> DataFrame:
        return self.once(("per_node",), lambda: links.by_node(self.edges(), self.key))

    def links(self) -> DataFrame:
        return self.once(("links",), lambda: links.link_features(self.edges(), self.counted(), self.key, self.per_node()))

    def similarity(self, mask: bool) -> DataFrame:
        def make() -> DataFrame:
            sims = self.given.sims
            if sims is None:
                texts = self.alive.select(self.key, F.posexplode("_steps").alias("subtask_index", "subtask"))
                sims = tfidf_sims(self.edges(), texts, self.found(), self.given.vocabulary, self.key, mask)
            return links.similarity_features(sims, self.counted(), self.key)

        return self.once(("similarity", mask, self.given.sims, self.given.vocabulary), make)

    def severity(self, table: str, stripping: str) -> DataFrame:
        def make() -> DataFrame:
            seen = self.found().withColumn("_scanned", scanned(F.col("code_snippet"), stripping))
            return links.severity_features(patterns.add_scores(seen, F.col("_scanned"), patterns.select_patterns(table)), self.edges(), self.counted(), self.key, linked=self.per_node())

        return self.once(("severity", table, stripping), make)

    def connected(self) -> DataFrame:
        return self.once(("connected",), lambda: links.connected(self.edges(), self.counted(), self.key, self.per_node()))


def parse(df: DataFrame, nodes: DataFrame | None, key: str, *, settings: Settings | None = None, given: Inputs | None = None, **more) -> Parsed:
    """The stages before the features. ``structural_defense`` takes the result as ``parsed`` for each mode, model and policy, which
    no parser reads, so that several of them parse once."""
    settings, given = _chosen(nodes, settings, given, more)
    state = df.withColumns({"stage_failed": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    state = written(failing(state, "init", F.when(F.coalesce(T.strip(F.col(given.patch)), F.lit("")) == "", "the patch is empty")))
    alive = state.where("stage_failed is null")
    found, outcomes = PATCH_PARSERS[settings.patch_parser](spread(alive, key), key, given, settings)
    state = failing(state.join(shuffled(outcomes), key, "left"), "cfg", F.col("_problem")).drop("_problem")
    steps, problem = PROMPT_PARSERS[settings.prompt_parser](state, key, given, settings)
    state = failing(state.withColumn("_steps", steps), "subtasks", problem).withColumn("num_subtasks", F.size("_steps"))
    state = written(state)  # the parsers have run; what follows reads their results
    _, problem = LINKERS[settings.linker](state.where("stage_failed is null"), found, key, given, settings)
    return Parsed(key, settings, given, failing(state, "grounding", problem), found, {})


def _chosen(nodes: DataFrame | None, settings: Settings | None, given: Inputs | None, more: dict) -> tuple[Settings, Inputs]:
    parts = {c: {f.name for f in fields(c)} for c in (Settings, Inputs)}
    if unknown := set(more) - parts[Settings] - parts[Inputs]:
        raise TypeError(f"no setting named {', '.join(sorted(unknown))}")
    settings = replace(settings or Settings(), **{k: v for k, v in more.items() if k in parts[Settings]})
    return settings, replace(given or Inputs(), **{k: v for k, v in more.items() if k in parts[Inputs]} | ({"nodes": nodes} if nodes is not None else {}))


#: Settings that the parsers and the linker read.
PARSING = ("patch_parser", "prompt_parser", "linker", "allow_fallback", "allow_fallback_non_toy", "similarity_threshold")


def structural_defense(df: DataFrame, nodes: DataFrame | None, model: scoring.LinearModel | Bundle | None, key: str, *, settings: Settings | None = None, given: Inputs | None = None, parsed: Parsed | None = None, **more) -> DataFrame:
    """One row for each key: decision, model_score, the key metrics, what the patch parser fell back to, stage_failed and error.

    The stages run in order (init, cfg, subtasks, grounding, model_load, features, inference). What fails a row is written to it,
    later stages leave it alone, and it is rejected; settings that no row can pass fail each row that comes so far, and nothing is made
    for rows that cannot pass. ``more``: fields of ``Settings`` and ``Inputs``. A bundle brings its vocabulary. ``parsed``: what ``parse``
    made of the same rows and inputs."""
    settings, given = _chosen(nodes, settings, given, more)
    given = replace(given, vocabulary=getattr(model, "vocabulary", None)) if given.vocabulary is None else given
    faults = settings.faults(model, given.sims is not None or given.vocabulary is not None)
    fault = lambda stage: F.lit(faults.get(stage)).cast("string")
    early = next((s for s in faults if s.startswith("settings") or s == "init"), None)
    if early:
        state = df.withColumns({"stage_failed": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
        return outcome(failing(state, early.partition(":")[2] or "init", F.lit(faults[early])), None, None, key, settings, [])
    if parsed is None:
        parsed = parse(df, nodes, key, settings=settings, given=given)
    elif parsed.key != key or any(getattr(parsed.settings, n) != getattr(settings, n) for n in PARSING):
        raise ValueError("the rows were parsed by another key or other settings")
    parsed = replace(parsed, given=given) if parsed.given is not given else parsed  # what was made stays shared
    state = parsed.state
    for stage in ("model_load", "features", "inference"):
        state = failing(state, stage, fault(stage))
    if {"model_load", "features", "inference"} & set(faults):
        return outcome(state, None, None, key, settings, [])
    columns, features = feature_columns(settings.mode), parsed.links()
    if settings.similar:
        features = features.join(shuffled(parsed.similarity(settings.mask_tokens)), key)
    elif not settings.structural:
        severity = parsed.severity(settings.severity_mode, settings.comment_stripping)
        more_features = severity if "is_connected" not in columns else parsed.connected().join(shuffled(severity), key)
        features = features.join(shuffled(more_features.select(key, *[c for c in more_features.columns if c != key and c not in features.columns])), key)
    scored = model.score(with_features(features, key, columns), settings.most_missing, "model_score").drop("prediction", "num_subtasks", "num_candidate_nodes")
    return outcome(state.drop("_steps").join(shuffled(scored), key, "left"), parsed.counted(), parsed.edges(), key, settings, columns)


def outcome(state: DataFrame, counted: DataFrame | None, linked: DataFrame | None, key: str, settings: Settings, columns: list[str]) -> DataFrame:
    """The result's columns; what a row that failed has no value for is null, and a metric that the mode leaves out is 0."""
    fine = F.col("stage_failed").isNull()
    if columns:
        numbers = linked.groupBy(key).agg(F.count_distinct("node_id").alias("_nodes"), F.count_distinct("subtask_index").alias("_linked_subtasks"))
        state = state.join(shuffled(counted.select(key, "num_candidate_nodes")), key, "left").join(shuffled(numbers), key, "left").na.fill({"_nodes": 0, "_linked_subtasks": 0})
    entropy = next((c for c in ("node_link_entropy", "link_entropy_over_subtasks") if c in columns), None)
    has = lambda c: F.col(c) if c in columns else F.lit(0.0)
    metrics = {
        "model_score": F.col("model_score") if columns else F.lit(None).cast("double"), "coverage": has("subtask_coverage"), "justification_gap": has("subtask_coverage") - has("node_justification"),
        "entropy": has(entropy), "unmatched_nodes": F.greatest(F.lit(0), F.col("num_candidate_nodes") - F.col("_nodes")).cast("long") if columns else F.lit(None).cast("long"),
    }
    accepted = fine & policies.threshold_decision(F.col("model_score"), settings.threshold, settings.policy) if columns else F.lit(False)
    extra = [F.col(c) if c in state.columns else F.lit(None).cast(t).alias(c) for c, t in NO_DIAGNOSTICS.items() if c != "_problem"]
    return state.select(
        key, F.when(accepted, "accept").otherwise("reject").alias("decision"), *[F.when(fine, c).alias(n) for n, c in metrics.items()],
        (F.when(fine, F.col("num_subtasks") - F.col("_linked_subtasks")).cast("long") if columns else F.lit(None).cast("long")).alias("unmatched_subtasks"), *extra, "stage_failed", "error",
    )


#: The flag of each stage.
FLAGS = {"cfg": "cfg_fail", "subtasks": "subtasks_fail", "grounding": "grounding_fail", "features": "features_fail", "model_load": "model_missing", "inference": "inference_fail"}


def failure_flags(df: DataFrame) -> DataFrame:
    """A flag for each stage that may have failed, and the last stage that was completed."""
    order = ("init", *STAGES)
    before = F.get(F.array(F.lit(None).cast("string"), *[F.lit(s) for s in order]), F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage_failed")).cast("int") - 1)
    return df.withColumns({FLAGS[s]: F.coalesce(F.col("stage_failed") == s, F.lit(False)) for s in STAGES}).withColumn("stage_completed", F.when(F.col("stage_failed").isNull(), order[-1]).otherwise(before))
