"""Personal data, and terms that reveal it, by DataFrame functions alone.

Base detection finds four kinds by pattern, leftmost and non-overlapping, and drops matches that fail their test. The
patterns are written with possessive quantifiers and start only where no shorter start was possible, which matches the
same spans but keeps the matcher from recursion and from quadratic rescans on long runs. Places come from the lengths of
the pieces between matches, in code points.

Information-theoretic sanitisation adds to these: an entity is the value of a base span, and a term is a run of letters
and digits, lower-cased. Over the whole corpus, documents are counted with each term, with each entity, and with both on one
line, which is the context of an entity (no base span crosses a line's end). The information that a term gives about an entity
is their pointwise mutual information, which can at most reach the entity's own information content -log2 p(entity). The
entity's rate among the documents with the term is estimated with ``smooth`` further documents at its rate in the corpus, so
that few documents count for less than many. Besides, term and entity have to meet on ``evidence`` lines that differ: a word
that was seen once is next to something by necessity, and copies of a line say no more than the line. With ``evidence`` 1
an entity that occurs once is revealed by all words that are nowhere else, which marks mostly chance. A term that gives at least
``generalise`` of the content is a span of kind ``term`` in every document of the corpus, with or without the entity, unless it
overlaps a base span; from ``remove`` on, sanitised texts lose it, below it is generalised to a placeholder.

Counts are combined before every shuffle, and an entity or term in most documents is one row of the counts. Null texts
are empty. Rows that repeat are counted as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlark.llm.common import join_weighted, stash

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]+"
TERM_GAP = r"[^\p{L}\p{N}]+"
HOLDS = "size(base) > 0"
#: The most terms that are broadcast: some 10 MB.
BROADCAST = 200_000
NO_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.when(digits.between(12, 19), luhn(F.regexp_replace(hit, "[^0-9]", ""))).otherwise(F.lit(False))
    return digits.between(9, 15)


def may_have(kind: str, text: Column) -> Column:
    """A test that is cheaper than the pattern and true wherever it matches."""
    return {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+"))}[kind]


def places(text: Column, pattern: str, ok, kind: int) -> Column:
    """Spans of the matches that ``ok`` accepts: the pieces between matches give the places."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len"), h.alias("hit"), F.when(h.isNull(), F.lit(False)).otherwise(ok(h)).alias("ok")))
    first = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {NO_SPANS})").alias("spans"))

    def step(a: Column, s: Column) -> Column:
        start = a["at"] + s["gap"]
        end = start + F.coalesce(s["len"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), s["hit"].alias("value"))
        return F.struct(end.alias("at"), F.when(s["ok"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(steps, first, step, lambda a: a["spans"])


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (a number, told anew whenever this is computed), text, counts of each kind, base (ordered spans)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    none = F.expr(f"cast(array() as {NO_SPANS})")
    for k, kind in enumerate(KINDS):
        out = out.withColumn(f"_{kind}", F.when(may_have(kind, F.col("text")), places(F.col("text"), PATTERNS[kind], lambda h, kind=kind: passes(kind, h), k)).otherwise(none))
    counts = [F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS]
    base = F.array_sort(F.concat(*[F.col(f"_{kind}") for kind in KINDS]))
    return out.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", *counts, base.alias("base"))


def terms_of(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), TERM_GAP, -1)), "")


def contexts(found: DataFrame) -> DataFrame:
    """row, line (its hash), entities, terms of each line that has a base span."""
    lines = found.where(HOLDS).select("row", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line"))
    some = F.lit(False)
    for kind in KINDS:
        some = some | may_have(kind, F.col("line"))
    spans = base_spans(lines.where(some), "row", "line").where(HOLDS)
    entities = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"].cast("string"), F.lower(s["value"]))))
    return spans.select(F.col("doc_id").alias("row"), F.xxhash64("text").alias("line"), entities.alias("entities"), terms_of(F.col("text")).alias("terms"))


def revealing(found: DataFrame, total: int, smooth: float, generalise: float, evidence: int) -> DataFrame:
    """n_e, sig, term, n_t, n_held, share: of the information content of the entities of a class, what the term gives; n_t of
    all rows have the term, n_held of those with entities. A class holds the entities that occur on the same lines, so a list
    of thousands of addresses is weighed once. Classes with too few different lines are left out before their terms are told."""
    met = stash(contexts(found))
    known = stash(met.select("row", "line", F.explode("entities").alias("entity")))
    sig = F.sum(F.xxhash64("row", "line").cast("decimal(20,0)")).cast("string")
    entities = known.groupBy("entity").agg(F.count_distinct("row").alias("n_e"), F.count_distinct("line").alias("lines"), sig.alias("sig"), F.count("*").alias("weight"))
    entities = stash(entities.where((F.col("lines") >= evidence) & (F.col("n_e") < total)).drop("lines"))
    on_line = join_weighted(known, entities, "entity", known.count()).select("row", "line", "n_e", "sig").distinct()
    pairs = on_line.join(met.select("row", "line", "terms"), ["row", "line"]).select("n_e", "sig", "row", "line", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("n_e", "sig", "term").agg(F.count_distinct("row").alias("n_et"), F.count_distinct("line").alias("lines"))
    pairs = stash(pairs.where(F.col("lines") >= evidence).drop("lines"))

    counts = found.select(F.expr(HOLDS).cast("long").alias("holds"), F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"), F.sum("holds").alias("n_held"))
    # a frequent word meets many classes: what is known of it goes to all tasks
    counts = stash(counts.where("n_held > 0").join(pairs.groupBy("term").agg(F.count("*").alias("weight")), "term"))
    rate = F.col("n_e") / F.lit(float(total))
    given = (F.col("n_et") + smooth * rate) / (F.col("n_t") + smooth)
    weighed = join_weighted(pairs, counts, "term", pairs.count())
    return weighed.select("n_e", "sig", "term", "n_t", "n_held", (F.log2(given / rate) / -F.log2(rate)).alias("share")).where(F.col("share") >= generalise)


def marked(rows: DataFrame, marks: DataFrame, total: int) -> DataFrame:
    """row, terms, gone: the revealing terms that are in the row's text, and those of them that are removed. Up to ``BROADCAST``
    marks go to all tasks, so that only what they hit is shuffled; more are joined with shuffled terms."""
    pairs, marks = rows.select("row", F.explode(terms_of(F.col("text"))).alias("term")), marks.select("term", "gone", "weight")
    few = marks.limit(BROADCAST + 1).count() <= BROADCAST
    inside = pairs.join(F.broadcast(marks), "term") if few else join_weighted(stash(pairs), marks, "term", total)
    return inside.groupBy("row").agg(F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("gone"), F.col("term"))).alias("gone"))


def detect(docs: DataFrame, *, smooth: float = 0.5, generalise: float = 0.9, remove: float = 0.97, evidence: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_email, n_ip, n_card, n_phone, n_terms, base_sha256, spans, sanitised (null where nothing is found)."""
    found = stash(base_spans(docs, id_col, text_col))
    total = found.count()
    reveals = revealing(found, total, smooth, generalise, evidence)
    marks = stash(reveals.groupBy("term").agg((F.max("share") >= remove).alias("gone"), F.max("n_t").alias("weight"), F.max("n_held").alias("n_held")))
    holds, rest = found.where(HOLDS), found.where(f"not {HOLDS}")
    # most terms of a rare entity are nowhere else: rows without entities are only asked for those that are
    per_row = stash(marked(holds, marks, total).unionByName(marked(rest, marks.where("weight > n_held"), total)))

    columns = ["doc_id", *[f"n_{k}" for k in KINDS]]
    plain = rest.select("row", *columns).join(per_row, "row", "left_anti")
    plain = plain.select(*columns, F.lit(0).cast("long").alias("n_terms"), F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), F.lit(None).cast("string").alias("sanitised"))
    held = holds.join(per_row, "row", "left").unionByName(rest.join(per_row, "row"))
    held = held.withColumn("_term", F.when(F.size("terms") > 0, places(F.col("text"), TERM, lambda h: F.array_contains(F.col("terms"), F.lower(h)), len(KINDS))).otherwise(F.expr(f"cast(array() as {NO_SPANS})")))
    held = held.withColumn("_term", F.filter("_term", lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))))
    held = held.withColumn("_all", F.array_sort(F.concat("base", "_term")))
    return held.select(*columns, F.size("_term").cast("long").alias("n_terms"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("_all")).alias("spans"), sanitised().alias("sanitised")).unionByName(plain)


def sanitised() -> Column:
    """The text with every span replaced: base spans by their kind, terms by nothing or by a placeholder."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(s: Column) -> Column:
        lost = F.coalesce(F.array_contains(F.col("gone"), F.lower(s["value"])), F.lit(False))
        return F.when(s["kind"] < len(KINDS), F.get(names, s["kind"])).when(lost, F.lit("")).otherwise(F.lit("[term]"))

    def step(a: Column, s: Column) -> Column:
        # spans of different kinds may overlap: what an earlier one has covered is not written again
        between = F.substring(F.col("text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], between, put(s)).alias("out"))

    return F.aggregate("_all", first, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
