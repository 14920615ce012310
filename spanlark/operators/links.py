"""Bipartite links between subtasks and nodes: normalisation and the features of each instance.

All features come from the links per subtask and per node, and the spread of these from short histograms of each instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlark.functions import text as T
from spanlark.operators.components import components
from spanlark.sources.tables import shuffled, written

#: Column names and their order.
STRUCTURAL = [
    "subtask_coverage", "node_justification", "justification_gap", "unjustified_node_rate", "avg_nodes_per_subtask", "avg_subtasks_per_node", "max_subtask_link_share", "node_link_entropy",
    "num_subtasks", "num_candidate_nodes", "num_links_total", "link_entropy_over_subtasks",
]
SIMILARITY = ["link_sim_mean", "link_sim_median", "link_sim_p10", "link_sim_min", "link_sim_frac_below_tau_0_2", "link_sim_frac_below_tau_0_3"]
UNIVERSAL = [
    "num_subtasks", "num_candidate_nodes", "num_links_total", "num_suspicious_nodes", "frac_suspicious_nodes", "subtask_coverage", "node_justification", "avg_nodes_per_subtask",
    "avg_subtasks_per_node", "suspicious_acceptance", "suspicious_unlinked", "suspicious_misassignment", "max_severity", "mean_severity", "top3_severity_sum", "max_severity_universal",
    "mean_severity_universal", "top3_severity_sum_universal", "num_suspicious_nodes_universal", "frac_suspicious_nodes_universal", "cnt_code_execution", "cnt_command_execution",
    "cnt_shell_injection", "cnt_network_io", "cnt_deserialization", "cnt_file_access", "cnt_adversarial_marker", "link_entropy_over_subtasks", "max_subtask_link_share",
    "max_links_per_subtask", "min_links_per_subtask", "std_links_per_subtask", "max_links_per_node", "min_links_per_node", "std_links_per_node", "link_density", "diagonal_links",
    "diagonal_ratio", "one_to_one_subtasks", "one_to_many_subtasks", "one_to_one_nodes", "many_to_one_nodes", "subtask_node_ratio", "gini_subtasks", "gini_nodes", "is_connected",
    "all_min_2_connections",
]


def parse_subtasks(df: DataFrame, key: str, reply: str) -> DataFrame:
    """key, subtask_index, subtask for every step of a reply."""
    return df.select(key, F.posexplode(T.subtasks(F.col(reply))).alias("subtask_index", "subtask"))


def link_entries(reply: Column) -> Column:
    """The entries of a reply {"links": [...]} that are objects, as VARIANT; an empty object, or text that is none, counts by the
    text from its first brace to its last. Nothing may follow the object."""
    raw = T.strip(F.coalesce(reply, F.lit("")))
    fields = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    first, second = T.whole_json(raw), T.whole_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1))
    found = F.when(F.coalesce(F.size(fields(first)), F.lit(0)) > 0, first).when(fields(second).isNotNull(), second)
    return F.filter(F.try_variant_get(found, "$.links", "array<variant>"), lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def _id_text(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    text = F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def _node_ids(entry: Column) -> Column:
    """A list's ids as text, or a list of the one that stands there if it is neither empty nor zero; blank ids go."""
    value = F.try_variant_get(entry, "$.node_ids", "variant")
    listed, kind = F.try_variant_get(value, "$", "array<variant>"), F.schema_of_variant(value)
    none = value.isNull() | (kind == "VOID") | _id_text(value).isin("", "0", "False", "{}") | (F.try_variant_get(value, "$", "double") == 0)
    one = F.when(F.coalesce(none, F.lit(False)), F.expr("cast(array() as array<string>)")).otherwise(F.array(_id_text(value)))
    ids = F.when(kind.startswith("ARRAY"), F.transform(listed, _id_text)).otherwise(one)
    return F.filter(ids, lambda s: s.isNotNull() & (T.strip(s) != ""))


def parse_links(df: DataFrame, key: str, reply: str, num_subtasks: str) -> DataFrame:
    """key, subtask_index, node_ids for every subtask from 0 on: the last entry of an index counts, entries that are no objects, indexes
    that are no whole numbers or out of range and blank ids go, single ids are lists of one, and subtasks without an entry get an
    empty list."""
    rows = df.select(key, num_subtasks, F.posexplode(link_entries(F.col(reply))).alias("pos", "link"))
    index = F.try_variant_get("link", "$.subtask_index", "variant")
    whole = F.when(F.schema_of_variant(index).isin("BIGINT", "BOOLEAN"), F.try_variant_get(index, "$", "bigint"))
    rows = rows.withColumn("subtask_index", whole).where(F.col("subtask_index").between(F.lit(0), F.col(num_subtasks) - 1))
    last = rows.groupBy(key, F.col("subtask_index").cast("int").alias("subtask_index")).agg(F.max_by(_node_ids(F.col("link")), "pos").alias("node_ids"))
    every = df.where(F.col(num_subtasks) > 0).select(key, F.explode(F.sequence(F.lit(0), (F.col(num_subtasks) - 1).cast("int"))).alias("subtask_index"))
    return every.join(shuffled(last), [key, "subtask_index"], "left").withColumn("node_ids", F.coalesce("node_ids", F.expr("cast(array() as array<string>)")))


def edges(links: DataFrame, key: str) -> DataFrame:
    return links.select(key, "subtask_index", F.explode("node_ids").alias("node_id"))


def by_subtask(edge_list: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Links ``n`` of each linked subtask that an instance has, and whether one is on the diagonal."""
    index = F.col("subtask_index").cast("string")
    on_diagonal = F.contains("node_id", F.concat(F.lit("::n"), index)) | F.col("node_id").endswith(F.concat(F.lit("_"), index))
    n = edge_list.groupBy(key, "subtask_index").agg(F.count("*").alias("n"), F.bool_or(on_diagonal).alias("diagonal"))
    return n.join(sizes.select(key, "num_subtasks"), key).where(F.col("subtask_index").between(F.lit(0), F.col("num_subtasks") - 1)).drop("num_subtasks")


#: Subtasks that are held as bits of a number.
BITS = 62


def by_node(edge_list: DataFrame, key: str) -> DataFrame:
    """Links ``n`` of each linked node, the least of its subtasks, and its first ``BITS`` subtasks as bits."""
    bit = F.when(F.col("subtask_index").between(0, BITS - 1), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("subtask_index").cast("int"))).otherwise(F.lit(0).cast("long"))
    return edge_list.groupBy(key, "node_id").agg(F.count("*").alias("n"), F.min("subtask_index").alias("least"), F.bit_or(bit).alias("bits"))


def histograms(subtasks: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """For each instance with links two arrays of (n, c): c subtasks, or nodes, have n links; and diagonal_links.

    Numbers of links are few, so these arrays are short however many nodes an instance has."""
    sides = subtasks.select(key, F.lit("subtask").alias("side"), "n", "diagonal").unionByName(nodes.select(key, F.lit("node").alias("side"), "n", F.lit(False).alias("diagonal")))
    counts = sides.groupBy(key, "side", "n").agg(F.count("*").alias("c"), F.count_if("diagonal").alias("d"))
    listed = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("n", "c"))))
    return counts.groupBy(key).agg(listed("subtask").alias("_subtasks"), listed("node").alias("_nodes"), F.sum("d").cast("double").alias("diagonal_links"))


def spread(histogram: Column, name: str) -> dict[str, Column]:
    """Extremes, deviation, entropy, Gini and patterns of a histogram (array of (n, c), n ascending); 0 for an empty one."""

    def total(term) -> Column:
        return F.aggregate(histogram, F.lit(0.0), lambda s, h: s + term(h["n"].cast("double"), h["c"].cast("double")))

    links, size = total(lambda n, c: n * c), total(lambda n, c: c)
    some = lambda c: F.when(size > 0, c).otherwise(0.0)
    linked = lambda c: F.when(links > 0, c).otherwise(0.0)
    mean = links / size
    # members with n links have the ranks that follow those with fewer: 2 * rank - size - 1 adds up to c * (2 * before + c - size)
    ranks = F.aggregate(histogram, F.struct(F.lit(0.0).alias("before"), F.lit(0.0).alias("sum")), lambda s, h: F.struct(
        (s["before"] + h["c"]).alias("before"), (s["sum"] + h["n"] * h["c"] * (2 * s["before"] + h["c"] - size)).alias("sum")
    ))["sum"]
    return {
        f"max_links_per_{name}": F.coalesce(F.try_element_at(histogram, F.lit(-1))["n"].cast("double"), F.lit(0.0)), f"min_links_per_{name}": F.coalesce(F.get(histogram, F.lit(0))["n"].cast("double"), F.lit(0.0)),
        f"std_links_per_{name}": some(F.sqrt(total(lambda n, c: c * (n - mean) * (n - mean)) / size)), f"_entropy_{name}": linked(total(lambda n, c: F.when(n > 0, -c * (n / links) * F.log2(n / links)).otherwise(0.0))),
        f"gini_{name}s": linked(ranks / (size * links)), f"one_to_one_{name}s": total(lambda n, c: F.when(n == 1, c).otherwise(0.0)), f"_many_{name}s": total(lambda n, c: F.when(n > 1, c).otherwise(0.0)),
        f"_linked_{name}s": total(lambda n, c: F.when(n > 0, c).otherwise(0.0)), f"_sum_{name}s": links, f"_min2_{name}s": total(lambda n, c: F.when(n == 1, c).otherwise(0.0)) == 0,
    }


def link_features(edge_list: DataFrame, sizes: DataFrame, key: str, nodes: DataFrame | None = None) -> DataFrame:
    """All link features of each instance in ``sizes`` (key, num_subtasks, num_candidate_nodes); connectivity is apart.

    nodes: what ``by_node`` gives, where it is there already."""
    found = histograms(by_subtask(edge_list, sizes, key), nodes if nodes is not None else by_node(edge_list, key), key)
    out = sizes.select(key, "num_subtasks", "num_candidate_nodes").join(shuffled(found), key, "left").na.fill({"diagonal_links": 0.0})
    none = F.expr("cast(array() as array<struct<n:bigint,c:bigint>>)")
    out = out.withColumn("_subtasks", F.coalesce("_subtasks", none)).withColumn("_nodes", F.coalesce("_nodes", none))
    unlinked = F.col("num_subtasks") - F.aggregate("_subtasks", F.lit(0).cast("long"), lambda s, h: s + h["c"])
    zeros = F.when(unlinked > 0, F.array(F.struct(F.lit(0).cast("long").alias("n"), unlinked.cast("long").alias("c")))).otherwise(none)
    out = out.withColumn("_subtasks", F.concat(zeros, "_subtasks"))
    out = out.withColumns(spread(F.col("_subtasks"), "subtask") | spread(F.col("_nodes"), "node"))
    S, N = F.col("num_subtasks").cast("double"), F.col("num_candidate_nodes").cast("double")
    links, ls, ln = F.col("_sum_subtasks"), F.col("_linked_subtasks"), F.col("_linked_nodes")
    one = F.lit(1.0)
    full = (ls >= S) & (ln >= N) & F.col("_min2_subtasks") & F.col("_min2_nodes")
    structural = lambda c: F.when(S > 0, c).otherwise(0.0)
    return out.select(
        key, S.alias("num_subtasks"), N.alias("num_candidate_nodes"), links.alias("num_links_total"), (ls / F.greatest(one, S)).alias("subtask_coverage"), (ln / F.greatest(one, N)).alias("node_justification"),
        structural(ls / F.greatest(one, S) - ln / F.greatest(one, N)).alias("justification_gap"), structural(one - ln / F.greatest(one, N)).alias("unjustified_node_rate"),
        (links / F.greatest(one, S)).alias("avg_nodes_per_subtask"), F.when(ln > 0, links / ln).otherwise(0.0).alias("avg_subtasks_per_node"),
        (F.col("max_links_per_subtask") / F.greatest(one, links)).alias("max_subtask_link_share"), F.col("_entropy_node").alias("node_link_entropy"), F.col("_entropy_subtask").alias("link_entropy_over_subtasks"),
        *[f"{m}_links_per_{n}" for n in ("subtask", "node") for m in ("max", "min", "std")],
        F.when((ls > 0) & (ln > 0), links / F.greatest(one, ls * ln)).otherwise(0.0).alias("link_density"), "diagonal_links", (F.col("diagonal_links") / F.greatest(one, S)).alias("diagonal_ratio"),
        "one_to_one_subtasks", F.col("_many_subtasks").alias("one_to_many_subtasks"), "one_to_one_nodes", F.col("_many_nodes").alias("many_to_one_nodes"),
        F.when(ln > 0, ls / F.greatest(one, ln)).otherwise(0.0).alias("subtask_node_ratio"), "gini_subtasks", "gini_nodes", full.cast("double").alias("all_min_2_connections"),
    )


def connected(edge_list: DataFrame, sizes: DataFrame, key: str, nodes: DataFrame | None = None) -> DataFrame:
    """(key, is_connected): whether the links join all subtasks of an instance in one component; links of subtasks that it does not
    have do not count.

    A node only joins its subtasks. Those of up to ``BITS`` are bits of a number: the nodes of one least subtask are one number, so an
    instance has as many numbers as subtasks, which are joined where they overlap. Instances with more go by rounds."""
    nodes = nodes if nodes is not None else by_node(edge_list, key)
    joined = nodes.where(F.col("bits") != 0).groupBy(key, "least").agg(F.bit_or("bits").alias("bits")).groupBy(key).agg(F.array_sort(F.collect_list("bits")).alias("_sets"))
    grown = lambda s: F.aggregate("_sets", s, lambda r, x: F.when(r.bitwiseAND(x) != 0, r.bitwiseOR(x)).otherwise(r))
    reached = F.aggregate("_sets", F.get("_sets", F.lit(0)), lambda r, _: grown(r))  # each pass takes in one more set, if any is left
    all_bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("num_subtasks").cast("int")) - 1
    own = sizes.select(key, "num_subtasks")
    few = own.where(F.col("num_subtasks") <= BITS).join(joined, key, "left")
    out = few.select(key, F.coalesce((F.col("num_subtasks") > 0) & (reached == all_bits), F.lit(False)).cast("double").alias("is_connected"))
    many = own.where(F.col("num_subtasks") > BITS)
    return out.unionByName(connected_by_rounds(edge_list, many, key)) if many.limit(1).count() else out


def connected_by_rounds(edge_list: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """The same for any number of subtasks: each node hands its subtasks to the least one; what is left has no more vertices than there
    are subtasks, and its components are found by rounds. They are one if all subtasks but the least belong to another."""
    pairs = edge_list.join(sizes.select(key, "num_subtasks"), key).where(F.col("subtask_index").between(F.lit(0), F.col("num_subtasks") - 1)).select(key, "subtask_index", "node_id").distinct()
    least = pairs.groupBy(key, "node_id").agg(F.min("subtask_index").alias("least"))
    joined = components(pairs.join(least, [key, "node_id"]).select(key, "least", "subtask_index").distinct(), [key], "least", "subtask_index")
    others = joined.groupBy(key).agg(F.count("*").alias("_others"))
    linked = pairs.groupBy(key).agg(F.count_distinct("subtask_index").alias("_linked"))
    out = sizes.select(key, "num_subtasks").join(linked, key, "left").join(others, key, "left").na.fill(0, ["_linked", "_others"])
    whole = (F.col("_linked") > 0) & (F.col("_linked") == F.col("num_subtasks")) & (F.col("_others") == F.col("_linked") - 1)
    return out.select(key, F.coalesce(whole, F.lit(False)).cast("double").alias("is_connected"))


def severity_features(nodes: DataFrame, edge_list: DataFrame, sizes: DataFrame, key: str, count_categories: bool = True, linked: DataFrame | None = None) -> DataFrame:
    """Severity of each instance's scored nodes (node_id, severity, is_suspicious, matched): counts, extremes, and how links take them up.

    The last subtask counts as foreign; an instance with fewer than two has no misassignment. Without ``count_categories`` the
    category counts are 0, as where a pipeline drops them."""
    from spanlark.functions.patterns import CATEGORY_FEATURES

    features = sorted(set(CATEGORY_FEATURES.values()))
    of = lambda name: F.greatest(F.lit(0), F.size(F.filter("matched", lambda p: p["category"].isin([c for c, f in CATEGORY_FEATURES.items() if f == name]))))
    # written, so that each node is scanned once: filters on what the scan finds would otherwise be pushed below whatever makes nodes distinct
    nodes = written(nodes.select(key, "node_id", "severity", "is_suspicious", *[(of(name) if count_categories else F.lit(0)).alias(name) for name in features]))
    per_node = (linked if linked is not None else by_node(edge_list, key)).select(key, "node_id", "least")
    ids = nodes.where("is_suspicious").select(key, "node_id").distinct().join(shuffled(per_node), [key, "node_id"], "left").join(sizes.select(key, "num_subtasks"), key)
    own = (F.col("least") < F.col("num_subtasks") - 1) & (F.col("num_subtasks") >= 2)
    taken = ids.groupBy(key).agg(F.count("*").alias("_bad"), F.count("least").alias("_linked"), F.count_if(own).alias("_own"))
    bad = F.when(F.col("is_suspicious"), F.col("severity"))
    top = nodes.groupBy(key).agg(
        F.count_if("is_suspicious").cast("double").alias("num_suspicious_nodes"), F.max(bad).alias("max_severity"), F.avg(bad).alias("mean_severity"),
        F.aggregate(F.slice(F.sort_array(F.collect_list(bad), asc=False), 1, 3), F.lit(0.0), lambda s, x: s + x).alias("top3_severity_sum"), *[F.sum(name).cast("double").alias(name) for name in features],
    )
    out = sizes.join(shuffled(top), key, "left").join(shuffled(taken), key, "left").na.fill(0)
    N = F.greatest(F.lit(1), F.col("num_candidate_nodes"))
    share = lambda a: a / F.greatest(F.lit(1), F.col("_bad"))
    plain = ["num_suspicious_nodes", "max_severity", "mean_severity", "top3_severity_sum"]
    twins = {"num_suspicious_nodes": "num_suspicious_nodes_universal", "max_severity": "max_severity_universal", "mean_severity": "mean_severity_universal", "top3_severity_sum": "top3_severity_sum_universal"}
    frac = F.col("num_suspicious_nodes") / N
    return out.select(
        key, *plain, *[F.col(a).alias(b) for a, b in twins.items()], frac.alias("frac_suspicious_nodes"), frac.alias("frac_suspicious_nodes_universal"), share(F.col("_linked")).alias("suspicious_acceptance"),
        share(F.col("_bad") - F.col("_linked")).alias("suspicious_unlinked"), share(F.col("_own")).alias("suspicious_misassignment"), *features,
    )


def similarity_features(sims: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Statistics of the similarity ``sim`` of linked pairs; instances without pairs get 0, 0, 0, 0, 1, 1."""
    below = lambda tau: F.avg((F.col("sim") < tau).cast("double"))
    stats = sims.groupBy(key).agg(
        F.avg("sim").alias("link_sim_mean"), F.median("sim").alias("link_sim_median"), F.percentile("sim", 0.1).alias("link_sim_p10"), F.min("sim").cast("double").alias("link_sim_min"),
        below(0.2).alias("link_sim_frac_below_tau_0_2"), below(0.3).alias("link_sim_frac_below_tau_0_3"),
    )
    empty = dict(zip(SIMILARITY, (0.0, 0.0, 0.0, 0.0, 1.0, 1.0), strict=True))
    return sizes.select(key).join(shuffled(stats), key, "left").na.fill(empty)


def structural_row(edge_list: DataFrame, sizes: DataFrame, sims: DataFrame, key: str, mode: str = "structural_combined") -> DataFrame:
    columns = {"structural_only": STRUCTURAL, "similarity_only": SIMILARITY, "structural_combined": STRUCTURAL + SIMILARITY}[mode]
    return link_features(edge_list, sizes, key).join(similarity_features(sims, sizes, key), key).select(key, *columns)


def universal_row(edge_list: DataFrame, nodes: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    edge_list = written(edge_list.select(key, "subtask_index", "node_id"))
    per_node = written(by_node(edge_list, key))  # what all three families start from
    severity = severity_features(nodes, edge_list, sizes, key, linked=per_node)
    rows = link_features(edge_list, sizes, key, per_node).join(connected(edge_list, sizes, key, per_node), key).join(severity, key)
    return rows.select(key, *UNIVERSAL)


def unmatched(edge_list: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    n = edge_list.groupBy(key).agg(F.count_distinct("node_id").alias("_nodes"), F.count_distinct("subtask_index").alias("_subtasks"))
    out = sizes.join(n, key, "left").na.fill(0)
    return out.select(key, F.greatest(F.lit(0), F.col("num_candidate_nodes") - F.col("_nodes")).alias("unmatched_nodes"), F.greatest(F.lit(0), F.col("num_subtasks") - F.col("_subtasks")).alias("unmatched_subtasks"))
