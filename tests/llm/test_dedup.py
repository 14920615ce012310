"""Exact and near duplicates against brute force."""

import hashlib
import itertools

import numpy as np
import pytest

from spanlark.llm import exact_dedup, near_dedup
from tests.llm.conftest import SF


def brute_exact(rows):
    groups = {}
    for r in rows:
        text = r["text"] or ""
        key = text.encode().translate(None, b" \t\n\x0b\x0c\r")
        groups.setdefault(key, []).append((-len(text), r["doc_id"] is None, r["doc_id"]))
    out = []
    for key, g in groups.items():
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out += [(i, keep, len(g), i == keep, hashlib.sha256(key).hexdigest()) for _, _, i in g]
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"chunk_bytes": 2000, "bucket_bytes": 4000}, {"chunk_bytes": 1, "bucket_bytes": 1}])
def test_exact_matches_brute_force(spark, odd, limits):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        got = exact_dedup.exact_groups(docs, **limits).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_exact(docs.collect())


def test_exact_empty(empty):
    assert exact_dedup.exact_groups(empty).count() == 0


def test_content_table_compares_contents():
    table = exact_dedup.ContentTable()
    assert [table.slot(7, c) for c in (b"a", b"b", b"a")] == [(0, True), (1, True), (0, False)]
    assert [table.slot(k, bytes([k % 251])) [1] for k in range(8, 2000)] == [True] * 1992


def brute_near(rows, k, num, den):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if i != j and len(a) * den >= num * len(b) and len(b) * den >= num * len(a) and den * len(a & b) >= num * len(a | b):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=str)


@pytest.mark.parametrize(("k", "num", "den"), [(3, 85, 100), (5, 4, 5)])
def test_near_matches_brute_force(spark, odd, k, num, den):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        got = near_dedup.near_duplicates(docs, k=k, num=num, den=den).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_near(docs.collect(), k, num, den)


def test_near_blocks_of_a_large_group(spark):
    """A chain of edits in a group larger than a block: every link between different texts counts."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.integers(0, 60, size=int(rng.integers(0, 4))):
            words[at] = f"x{rng.integers(0, 1000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, k=3, num=85, den=100).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_near(docs.collect(), 3, 85, 100)


def test_near_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_posterior_bound_never_prunes_certain_pairs():
    assert near_dedup.least_matches(28, 0.85, 1e-5) < 28 * 0.85
    assert near_dedup.least_matches(140, 0.85, 1e-5) > near_dedup.least_matches(28, 0.85, 1e-5)
