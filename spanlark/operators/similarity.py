"""Linking by similarity: dense vectors in blocks, and TF-IDF over terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlark.functions import pysource
from spanlark.functions.text import looks_like_code


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores; the largest is taken off first, so that none overflows."""
    powers = F.transform(scores, lambda x: F.exp(x.cast("double") - F.array_max(scores).cast("double")))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda s, x: s + x))


def argmax(scores: Column) -> Column:
    """The place of the largest score from 0 on, the first of several; null for an empty array."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def mean_pooled(tokens: DataFrame, key: str, vector: str, name: str = "pooled") -> DataFrame:
    """The mean of each key's vectors (arrays of one length), summed up where the rows are. Null vectors do not count."""
    rows = tokens.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    return rows.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias(name))


#: Rows of a side in a block, and of the left side in a tile of it: a task holds two blocks and one tile's products.
BLOCK_ROWS, TILE_ROWS = 4096, 128


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of some left rows, ids of the right rows, and the products of their vectors."""
    pdf = pd.concat(list(batches))
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if len(left) and len(right):
        columns = np.stack(right["v"].to_numpy()).T
        for at in range(0, len(left), TILE_ROWS):
            part = left.iloc[at : at + TILE_ROWS]
            yield part["id"].to_numpy(), right["id"].to_numpy(), np.stack(part["v"].to_numpy()) @ columns


def _dealt(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str) -> DataFrame:
    """Both sides in blocks of about ``BLOCK_ROWS`` rows; a row goes to each block of the other side."""
    n, m = (max(1, -(-side.count() // BLOCK_ROWS)) for side in (left, right))
    l = left.select(F.col(left_id).cast("long").alias("id"), unit(F.col(vector)).alias("v"), F.pmod(F.xxhash64(left_id), F.lit(n)).alias("bi"), F.lit(0).alias("side"))
    r = right.select(F.col(right_id).cast("long").alias("id"), unit(F.col(vector)).alias("v"), F.pmod(F.xxhash64(right_id), F.lit(m)).alias("bj"), F.lit(1).alias("side"))
    l = l.withColumn("bj", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    r = r.withColumn("bi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return l.unionByName(r).groupBy("bi", "bj")


def link_vectors(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str, tau: float = 0.3) -> DataFrame:
    """Pairs of a left and a right row with cosine at least ``tau``. The left rows are a stated query set against all right rows:
    both are dealt into blocks, a task multiplies one pair of blocks tile by tile, and only pairs that reach ``tau`` are written."""
    names = [f"left_{left_id}", f"right_{right_id}"]

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, other, sims in _tiles(batches):
            i, j = np.nonzero(sims >= tau)
            yield pd.DataFrame({names[0]: own[i], names[1]: other[j], "sim": sims[i, j]})  # tile by tile, so that no task holds a block's pairs

    return _dealt(left, right, left_id, right_id, vector).applyInPandas(pairs, f"{names[0]} long, {names[1]} long, sim double")


def matrix_stats(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str) -> DataFrame:
    """Least, greatest and mean cosine of all pairs, summed up where they are made: no pair is written."""

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(sims.min(), sims.max(), sims.sum(), sims.size) for _, _, sims in _tiles(batches)]
        yield pd.DataFrame(rows, columns=["low", "high", "total", "n"])

    parts = _dealt(left, right, left_id, right_id, vector).applyInPandas(stats, "low double, high double, total double, n long")
    return parts.agg(F.min("low").alias("sim_min"), F.max("high").alias("sim_max"), (F.sum("total") / F.sum("n")).alias("sim_mean"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_pairs"))


def terms(df: DataFrame, key: str, text: str, pattern: str = r"[^a-z0-9]+") -> DataFrame:
    """key, term, tf: single words of at least two letters, and pairs of such words one after the other."""
    words = F.filter(F.split(F.lower(F.col(text)), pattern), lambda w: F.length(w) >= 2)
    rows = df.select(key, words.alias("_words"))
    pairs = F.zip_with("_words", F.slice("_words", F.lit(2), F.greatest(F.lit(0), F.size("_words") - 1)), lambda a, b: F.concat(a, F.lit(" "), b))
    both = F.concat("_words", F.filter(pairs, lambda p: p.isNotNull()))
    return rows.select(key, F.explode(both).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf_fit(term_rows: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95, max_features: int = 5000) -> DataFrame:
    """term, idf of the most frequent terms within the document frequency limits: smoothed, plus one."""
    stats = term_rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    kept = stats.orderBy(F.col("total").desc(), "term").limit(max_features)
    return kept.select("term", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))


def tfidf_weights(term_rows: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """key, term, w: sublinear term frequency times idf, of length one for each key. The vocabulary has at most max_features rows."""
    raw = term_rows.join(F.broadcast(vocabulary), "term").withColumn("_w", (1.0 + F.log("tf")) * F.col("idf"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norms, key).select(key, "term", (F.col("_w") / F.col("_norm")).alias("w"))


def tfidf_cosine(pairs: DataFrame, weights: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """Adds ``sim`` to given pairs; pairs without a common term get 0."""
    l = weights.select(F.col(key).alias(left), "term", F.col("w").alias("_wl"))
    r = weights.select(F.col(key).alias(right), "term", F.col("w").alias("_wr"))
    sims = pairs.select(left, right).join(l, left).join(r, [right, "term"]).groupBy(left, right).agg(F.sum(F.col("_wl") * F.col("_wr")).alias("sim"))
    return pairs.join(sims, [left, right], "left").na.fill({"sim": 0.0})


def masked(df: DataFrame, text: str) -> DataFrame:
    """``text`` with its names, strings and numbers masked where it looks like code, for a vocabulary that tells the shape of code
    rather than its names; prose stays as it is, and only what looks like code goes to Python."""
    code = F.when(looks_like_code(F.col(text)), F.col(text))
    shape = df.withColumn("_shape", pysource.over_text(pysource.mask_tokens)(code))
    return shape.withColumn(text, F.when(looks_like_code(F.col(text)), F.col("_shape")).otherwise(F.col(text))).drop("_shape")
