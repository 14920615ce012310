"""Whitening against numpy on the same whole numbers, with exact deviations by Python's integers."""

import math
from collections import Counter

import numpy as np
import pytest

from spanlark.llm.queries import queries
from spanlark.llm.whitening import deviations, whiten
from tests.llm.conftest import SF


def brute(rows, components=4):
    """rows: (id, vector). What the operator returns, by numpy over the fit list."""
    sound = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in sound}), dtype=float)
    n, sums = len(fit), [sum(c) for c in zip(*{tuple(x) for _, x in sound})]
    away = fit - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(away.T @ away / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = np.trace(away.T @ away / n)
    out = []
    for i, x in sound:
        z = (np.array(x) - np.array([s / n for s in sums])) @ vectors / np.sqrt(np.maximum(values, 1e-300))
        for k in range(components):
            out.append((i, k + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), z[k], values[k] / trace))
    return out


def compared(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(r[0], r[1], r[2], r[3]) for r in want]
    for k in {r[1] for r in got}:
        a, b = (np.array([r[4] for r in t if r[1] == k]) for t in (got, want))
        assert np.allclose(a, b, atol=1e-9) or np.allclose(a, -b, atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query_matches_numpy(spark, size):
    folder = SF.replace("0.001", size)
    got = queries()["op11_whitening"](spark, folder).collect()
    want = brute([(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()])
    compared([(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got], want)
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def flat(out):
    rows, model = out
    return [(r["vec_id"], k + 1, model.n, r["deviation"], z, model.values[k] / model.trace) for r in rows.collect() for k, z in enumerate(r["whitened"])]


def test_odd_vectors_copies_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    sound = [(i, [float(c) for c in rng.normal(size=5) * [9, 7, 5, 3, 1]]) for i in range(60)]
    copies = [(None, sound[0][1])] * 500 + [(7, sound[1][1])] * 30
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [1.0, float("-inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    rows = sound + copies + bad
    table = spark.createDataFrame([(*r, 1, "y", 2.5) for r in rows], "vec_id long, embedding array<double>, x int, row string, deviation double").repartition(7)
    out = whiten(table)
    assert out[1].n == 60
    compared(flat(out), brute([r for r in rows if r[0] != 105]))
    assert Counter(r["vec_id"] for r in out[0].collect())[None] == 500


def test_huge_entries_stay_exact(spark):
    rows = [(i, [float(1 << (30 + 3 * i)), float(i), -float(i % 3) * 1e12]) for i in range(9)]
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    fit = [[math.floor(256 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*fit)]
    want = {i: sum((9 * a - s) ** 2 for a, s in zip(x, sums)) for i, x in enumerate(fit)}
    assert {r["vec_id"]: r["deviation"] for r in out[0].collect()} == {i: v if v < 1 << 63 else None for i, v in want.items()}
    trace = sum(want.values()) / 9**3
    assert abs(out[1].trace - trace) < 1e-12 * trace
    assert deviations(np.array(fit), 9, sums, max(map(abs, sum(fit, [])))).tolist() == list(want.values())


def test_little_variance_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema))[0].collect() == []
    assert whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 9, schema))[0].collect() == []
    rows, model = whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.75, 0.25]), (3, [0.75, 0.25])], schema))
    assert len(model.values) == 1 and model.n == 2 and sorted(abs(r["whitened"][0]) for r in rows.collect()) == [1, 1, 1]
