"""Quality rules and robust multivariate outliers, by DataFrame functions alone.

Two fixed rules fail a text: fewer than ``min_words`` words, or more than ``max_repeat`` of its words inside
five-word windows that occur again in the same text. Of the other texts, five statistics are taken (logarithm of the
word count, mean word length, and square roots of symbols per word, repeated lines per line and repeated words per
word). For each (language, source) the minimum covariance determinant is approximated by concentration steps from two
starts: medians with median deviations, and plain means with covariances. Each step takes the ``keep_share`` of rows with the
least distances for the next mean and covariance, ``steps`` times, each covariance scaled to that of a whole normal sample;
of the two estimates the one with the smaller determinant is taken. Rows whose squared Mahalanobis distance is past the
chi-square law's quantile, which a clean normal row exceeds with probability ``chance``, are rejected. Deviations below ``LEAST``, which are
far below the statistics' ranges, are raised to it, so that a statistic that is constant in clean text stays defined. A
(language, source) with fewer than ``min_rows`` rows is judged by its language over all sources, and where that has fewer
as well, by all rows.

Medians and quantiles come from counts by fixed bins, so reruns agree; all aggregation is combined before the shuffle, and
tables with a row for each group are broadcast up to ``FEW`` groups (joined by weight beyond), so a language and source
with most rows is no hot spot.

Null texts are empty: they have no words and fail. Null languages or sources are values of their own. Repeated rows
count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlark.llm.common import join_weighted, stash

SPACES = r"[\x20\x09-\x0D]+"
#: Least standard deviations of the five statistics, and what is always added to them so that correlated ones can be solved for.
LEAST, FLOORS = (0.5, 0.25, 0.02, 0.1, 0.08), (0.005,) * 5
#: Bin widths of their histograms, and the number of bins for each doubling of a distance.
BINS, PER_OCTAVE = (1 / 64, 1 / 128, 1 / 256, 1 / 256, 1 / 256), 32
#: A mean word length is uncertain by one over the root of its words: below SURE words it is drawn towards TYPICAL by that much.
TYPICAL, SURE = 5.0, 40.0
X = [f"x{i}" for i in range(5)]
PAIRS = [(i, j) for i in range(5) for j in range(i + 1)]
#: The most groups whose estimates are broadcast: some 25 numbers each, 5 MB.
FEW = 20_000


def chi_square(x: float, extra: int = 0) -> float:
    """Distribution of the sum of 5 squared normal numbers, or 7 with ``extra`` = 2."""
    tail = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    return math.erf(math.sqrt(x / 2)) - tail * (1 + x / 3 + (x * x / 15 if extra else 0))


def quantile(p: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        low, high = ((low + high) / 2, high) if chi_square((low + high) / 2) < p else (low, (low + high) / 2)
    return high


def raised(i: int, variance: Column) -> Column:
    return F.greatest(variance, F.lit(LEAST[i] ** 2))


def statistics(docs: DataFrame, *carry: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c) for c in carry], text.alias("_text"))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_words", F.array_remove(F.split("_text", SPACES, -1), ""))
    out = out.select(
        "doc_id", *carry, "_words", F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    windows = F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(1), (F.col("n_words") - 4).cast("int")), lambda i: F.xxhash64(F.slice("_words", i, 5))))
    out = out.withColumn("_windows", windows).drop("_words")
    # only texts in which a window occurs again are sorted
    again = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("_again", again).drop("_windows")
    starts = F.filter("_again", lambda x, k: F.coalesce(F.get("_again", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_again", k + 1)["h"] == x["h"], F.lit(False)))
    starts = F.array_sort(F.transform(starts, lambda x: x["i"]))
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate(starts, first, lambda a, i: F.struct((a["n"] + i + 5 - F.greatest(i, a["upto"])).alias("n"), (i + 5).alias("upto")), lambda a: a["n"])
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_again")


def share_point(rows: DataFrame, keys: list[str], bin_: Column, share: float) -> DataFrame:
    """keys and ``bin``: the first bin at which ``share`` of the rows of a key are reached."""
    counts = rows.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin")
    counts = counts.select(*keys, "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    return counts.where(F.col("upto") >= F.lit(share) * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("bin"))


def with_group(rows: DataFrame, small: DataFrame, sizes: DataFrame) -> DataFrame:
    """Join with a table of a row for each group; sizes: group and the number ``weight`` of its rows, a written table."""
    few = sizes.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(small), "group") if few else join_weighted(rows, small.join(sizes, "group"), "group", sizes.agg(F.sum("weight")).first()[0] or 0)


def medians(rows: DataFrame, values: list[Column], name: str) -> DataFrame:
    long = rows.select("group", F.posexplode(F.array(*values)).alias("f", "v"))
    width = F.element_at(F.array(*[F.lit(float(b)) for b in BINS]), F.col("f") + 1)
    at = share_point(long, ["group", "f"], F.floor(F.col("v") / width), 0.5)
    middle = (F.col("bin") + 0.5) * width
    return at.withColumn("v", middle).groupBy("group").agg(*[F.max(F.when(F.col("f") == i, F.col("v"))).alias(f"{name}{i}") for i in range(5)])


def distance(rows: DataFrame) -> DataFrame:
    """``d2`` from the means m* and the lower Cholesky factors l** of the covariance."""
    z: list[Column] = []
    for i in range(5):
        solved = F.col(X[i]) - F.col(f"m{i}")
        for j in range(i):
            solved = solved - F.col(f"l{i}{j}") * F.col(f"z{j}")
        rows = rows.withColumn(f"z{i}", solved / F.col(f"l{i}{i}"))
        z.append(F.col(f"z{i}"))
    return rows.withColumn("d2", sum((v * v for v in z[1:]), z[0] * z[0])).drop(*[f"z{i}" for i in range(5)])


def factors(moments: DataFrame) -> DataFrame:
    """Cholesky factors of the covariances c**, with the squared floors added on the diagonal."""
    out = moments
    for i, j in PAIRS:
        value = F.col(f"c{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(FLOORS[i] ** 2))) if i == j else value / F.col(f"l{j}{j}"))
    return out.select("group", *[f"m{i}" for i in range(5)], *[f"l{i}{j}" for i, j in PAIRS])


def moments_of(rows: DataFrame, scale: float) -> DataFrame:
    """Means and scaled covariances of each group, small deviations raised."""
    out = rows.groupBy("group").agg(
        *[F.round(F.avg(x), 9).alias(f"m{i}") for i, x in enumerate(X)], *[F.round(F.covar_pop(X[i], X[j]), 9).alias(f"c{i}{j}") for i, j in PAIRS]
    )
    return out.withColumns({f"c{i}{j}": raised(i, F.col(f"c{i}{j}") * scale) if i == j else F.col(f"c{i}{j}") * scale for i, j in PAIRS})


def estimate(rows: DataFrame, steps: int, keep_share: float) -> DataFrame:
    """Means and factors of each group by concentration steps from two starts; rows: group and x0 to x4, a written table."""
    sizes = stash(rows.groupBy("group").agg(F.count("*").alias("weight")))
    centre = stash(medians(rows, [F.col(x) for x in X], "m"))
    spread = medians(with_group(rows, centre, sizes), [F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(X)], "s")
    robust = centre.join(spread, "group")
    for i, j in PAIRS:
        robust = robust.withColumn(f"c{i}{j}", raised(i, (F.col(f"s{i}") * 1.4826) ** 2) if i == j else F.lit(0.0))
    starts = [F.concat(F.lit(f"{k}:"), F.col("group")).alias("group") for k in range(2)]
    named = lambda t, k: t.withColumn("group", starts[k])
    model = stash(named(factors(robust), 0).unionByName(named(factors(moments_of(rows, 1.0)), 1)))
    twice = rows.withColumn("group", F.explode(F.array(*starts)))
    sizes = stash(named(sizes, 0).unionByName(named(sizes, 1)))
    whole = keep_share / chi_square(quantile(keep_share), 2) if keep_share < 1 else 1.0
    for _ in range(steps):
        far = distance(with_group(twice, model, sizes))
        bin_ = F.floor(F.log2(F.col("d2") + 1e-6) * PER_OCTAVE)
        near = with_group(far, stash(share_point(far, ["group"], bin_, keep_share)), sizes).where(bin_ <= F.col("bin"))
        model = stash(factors(moments_of(near, whole)))
    spread = F.round(sum((F.log(F.col(f"l{i}{i}")) for i in range(1, 5)), F.log(F.col("l00"))), 9)
    best = F.min(F.struct(spread.alias("spread"), F.substring("group", 1, 1).alias("start"), *[F.col(c) for c in model.columns if c != "group"])).alias("best")
    return stash(model.groupBy(F.substring("group", 3, 1 << 30).alias("group")).agg(best).select("group", *[F.col(f"best.{c}").alias(c) for c in model.columns if c != "group"]))


def judge(docs: DataFrame, *, min_words: int = 10, max_repeat: int = 20, keep_share: float = 0.75, chance: float = 0.001, steps: int = 3, min_rows: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2 for each row, and the carried columns."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    named = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((id_col, text_col, *carry))], part(lang_col).alias("_lang"), F.concat_ws("\x1f", part(lang_col), part(source_col)).alias("_cell"))
    base = statistics(named, "_lang", "_cell", *carry, id_col=id_col, text_col=text_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    words = F.greatest("n_words", F.lit(1)).cast("double")
    base = base.withColumn("base_failed", failed).withColumns({
        "x0": F.log(words), "x1": TYPICAL + (F.col("word_chars") / words - TYPICAL) * F.sqrt(F.least(words, F.lit(SURE)) / SURE), "x2": F.sqrt(F.col("n_symbols") / words),
        "x3": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), "x4": F.sqrt(F.col("n_repeat_words") / words),
    })
    base = stash(base)
    cells = stash(base.where("not base_failed").groupBy("_lang", "_cell").agg(F.count("*").alias("n")))
    langs = cells.groupBy("_lang").agg(F.sum("n").alias("n_lang"))
    by_lang = F.concat(F.lit("lang "), "_lang")
    group = F.when(F.col("n") >= min_rows, F.concat(F.lit("cell "), "_cell")).when(F.col("n_lang") >= min_rows, by_lang).otherwise(F.lit("all"))
    cells = stash(cells.join(langs, "_lang").select("_cell", group.alias("group"), F.array(F.concat(F.lit("cell "), "_cell"), by_lang, F.lit("all")).alias("helps"), F.col("n").alias("weight")))
    # a cell's rows take part in the estimates that it is judged by, and in wider ones that others are judged by
    helps = cells.select("_cell", F.explode("helps").alias("group"), "weight").join(cells.select("group").distinct(), "group").groupBy("_cell").agg(F.collect_list("group").alias("groups"), F.first("weight").alias("weight"))
    few, total = cells.limit(FEW + 1).count() <= FEW, cells.agg(F.sum("weight")).first()[0] or 0
    with_cell = lambda rows, small: rows.join(F.broadcast(small.drop("weight")), "_cell") if few else join_weighted(rows, small, "_cell", total)
    passed = base.where("not base_failed")
    model = estimate(stash(with_cell(passed.select("_cell", *X), helps).select(F.explode("groups").alias("group"), *X)), steps, keep_share)
    judged = with_cell(passed, cells.select("_cell", "group", "weight"))
    scored = distance(with_group(judged, model, stash(cells.groupBy("group").agg(F.sum("weight").alias("weight")))))
    columns = ["doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = scored.select(*columns, (F.col("d2") <= quantile(1 - chance)).alias("kept"), "d2")
    return passed.unionByName(base.where("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("d2")))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
