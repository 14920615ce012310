"""Whitening of embeddings: principal components from MLlib's singular value decomposition of centred rows.

A vector's entries become whole numbers, the floor of ``scale`` times the entry (those beyond the range of a long stop at its
ends). Rows whose vector is null, or holds a null or an entry that is not finite, go; of lengths that differ the most frequent one stays
(ties: the longer one), and vectors without entries go. The fit list holds each distinct vector once, so copies, however many,
weigh nothing; equal vectors are combined before they are shuffled. Sums of the fit list are exact. Its rows are centred at their exact
mean, ``computeSVD`` decomposes them (all values are asked for, so the Gramian, summed over the cluster in a tree, is decomposed in
double precision), and squared singular values over n are the eigenvalues of the covariance. The trace comes by itself, from the exact
sums of squares of n*x - S, as do the deviations of rows.

Components with an eigenvalue of at most ``dim * 2^-52`` times the largest one are noise of the decomposition and left out, so a fit list of few vectors
gives fewer of them, and one vector or an empty table gives no rows. Only vectors of sums, means and components, bounded by the dimension,
reach the driver. Null and repeated ids are kept as they are, extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlark.llm.common import bounded_batches, stash, tidy

LONG = 1 << 63
EPSILON = 2.0**-52
OUT = "id long, deviation long, whitened array<double>"


@dataclass
class Whitening:
    """What was learnt of a fit list: its size, the sums of each dimension, eigenvectors as columns, eigenvalues and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_numbers(rows: DataFrame, vec_col: str, scale: float) -> DataFrame:
    """The rows that stay, with ``x``, an array of longs."""
    entries = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).where(sound)
    return rows.withColumn("x", F.transform(entries, lambda c: F.floor(c * scale))).drop(vec_col)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """Python's integers where results of up to ``most`` would not fit 64 bits."""
    return x if most < LONG else x.astype(object)


def column_sums(batches: Iterator[pa.RecordBatch], *, dim: int) -> Iterator[pa.RecordBatch]:
    """For each dimension the exact sum over a task, in two limbs of 32 bits, and the largest absolute value."""
    total, peak, n = [0] * dim, 0, 0
    for batch in batches:
        x = matrix(batch.column(0), dim)
        if len(x):
            top = max(abs(int(x.min())), abs(int(x.max())))
            total = [a + int(b) for a, b in zip(total, exact(x, top * len(x)).sum(axis=0))]
            peak, n = max(peak, top), n + len(x)
    if n:
        parts = [[t >> 32 for t in total], [t & 0xFFFFFFFF for t in total]]
        kinds = [pa.int32(), pa.int64(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip([list(range(dim)), *parts], kinds)]
        columns += [pa.array([str(peak)] * dim), pa.array([n] * dim, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "high", "low", "peak", "n"])


def deviations(x: np.ndarray, n: int, sums: list[int], peak: int) -> np.ndarray:
    """Of each row the sum of (n*x - S)^2 over the dimensions, exact."""
    most = len(sums) * (2 * n * max(peak, 1)) ** 2
    away = exact(x, most) * n - np.array(sums, dtype=object if most >= LONG else np.int64)
    return (away * away).sum(axis=1)


def spread(batches: Iterator[pa.RecordBatch], *, n: int, sums: list[int], peak: int) -> Iterator[pa.RecordBatch]:
    """The sum of the deviations of a task's rows, in limbs of 32 bits."""
    total = 0
    for batch in batches:
        total += sum(map(int, deviations(matrix(batch.column(0), len(sums)), n, sums, peak)))
    limbs = []
    while total:
        limbs.append(total & 0xFFFFFFFF)
        total >>= 32
    yield pa.RecordBatch.from_arrays([pa.array(range(len(limbs)), pa.int32()), pa.array(limbs, pa.int64())], names=["limb", "v"])


def project(batches: Iterator[pa.RecordBatch], *, model: Whitening, peak: int) -> Iterator[pa.RecordBatch]:
    mean, way = model.mean, model.vectors / np.sqrt(model.values)
    for batch in batches:
        x = matrix(batch.column(1), len(mean))
        away = deviations(x, model.n, model.sums, peak)
        whitened = (x - mean) @ way
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * way.shape[1], pa.int32()), pa.array(whitened.reshape(-1)))
        fitting = pa.array([v if v < LONG else None for v in map(int, away)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), fitting, lists], names=["id", "deviation", "whitened"])


def learn(fit: DataFrame, dim: int, components: int) -> tuple[Whitening, int] | None:
    """fit: a written table of distinct vectors ``x``; None where nothing varies. The largest absolute entry is given too."""
    parts = fit.mapInArrow(tidy(partial(column_sums, dim=dim)), "dim int, high long, low long, peak string, n long")
    wide = "decimal(38,0)"
    rows = parts.groupBy("dim").agg(F.sum(F.col("high").cast(wide)).alias("h"), F.sum(F.col("low").cast(wide)).alias("l"), F.max(F.col("peak").cast(wide)).alias("p"), F.sum("n").alias("n")).orderBy("dim").collect()
    if not rows:
        return None
    n, sums, peak = rows[0]["n"], [(int(r["h"]) << 32) + int(r["l"]) for r in rows], int(rows[0]["p"])
    limbs = fit.mapInArrow(tidy(partial(spread, n=n, sums=sums, peak=peak)), "limb int, v long").groupBy("limb").agg(F.sum(F.col("v").cast(wide)).alias("v")).collect()
    trace = float(Fraction(sum(int(r["v"]) << (32 * r["limb"]) for r in limbs), n**3))
    if not trace:
        return None
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = fit.select(array_to_vector(F.zip_with("x", mean, lambda a, b: a - b)).alias("v"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v")).computeSVD(dim, computeU=False, rCond=1e-12)
    values = np.array(svd.s.toArray()) ** 2 / n
    kept = int((values > dim * EPSILON * values[0]).sum())
    kept = min(kept, components)
    model = Whitening(n, sums, np.array(svd.V.toArray())[:, :kept], values[:kept], trace)
    return model, peak


def whitened(rows: DataFrame, model: Whitening, peak: int) -> DataFrame:
    """rows: (id long, x). id, deviation and an array with the whitened components."""
    return rows.select("id", "x").mapInArrow(tidy(partial(project, model=model, peak=peak)), OUT)


def whiten(docs: DataFrame, *, components: int = 4, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """Id, deviation and the array ``whitened`` of each row that stays, and what was learnt; without variance there are no rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vector"))
    rows = stash(whole_numbers(named, "vector", scale))
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    nothing = spark.createDataFrame([], f"{id_col} long, deviation long, whitened array<double>")
    if not sizes:
        return nothing, None
    dim = sizes[0]["dim"]
    rows = rows.where(F.size("x") == dim)
    fit = stash(rows.select("x").distinct())
    learnt = learn(fit, dim, components)
    if learnt is None:
        return nothing, None
    model, peak = learnt
    each = whitened(fit.withColumn("id", F.lit(0).cast("long")), model, peak)
    pairs = [(i, j) for i in range(len(model.values)) for j in range(i + 1)]
    found = each.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    model.identity_error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return whitened(rows, model, peak).withColumnRenamed("id", id_col), model


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    rows, model = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = [float(v / model.trace) for v in model.values] if model else [0.0]
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("at") + 1).alias("explained"), F.lit(float(model.identity_error) if model else 0.0).alias("identity_error"),
    )
