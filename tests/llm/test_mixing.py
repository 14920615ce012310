from collections import Counter
from fractions import Fraction

import numpy as np

from spanlark.llm import mixing
from tests.llm.conftest import SF


def check(docs):
    first = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    pick = lambda rows: Counter((r["doc_id"], r["size"], r["taken"]) for r in rows)
    assert pick(first) == pick(again)
    rows = docs.collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], size(r["text"])) for r in rows) == Counter((r["doc_id"], r["size"]) for r in first)
    by = {}
    for r in first:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for group in by.values():
        assert sum(r["size"] for r in group) == group[0]["source_size"]
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= max(r["size"] for r in group)
    total = sum(r["size"] for r in first)
    assert abs(sum(g[0]["target"] for g in by.values()) - 1.5 * total) < 1e-6 * max(1, total)
    return by


def test_mix(spark, odd):
    by = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert max(abs(sum(r["taken"] for r in g) - g[0]["target"]) for g in by.values()) < 400
    check(odd)


def test_mix_of_an_empty_table(empty):
    assert mixing.mix(empty).count() == 0


def test_targets_reshare_the_excess():
    # 315 words by 5:2:1; the first source stops at 20, and the other 295 go 2:1
    assert mixing.fit_targets([10, 100, 100], [5, 2, 1], Fraction(3, 2), 2) == [20.0, 295 * 2 / 3, 295 / 3]
    # the second stops at 180 in the next round, and the third has what is left
    assert mixing.fit_targets([10, 90, 110], [5, 2, 1], Fraction(3, 2), 2) == [20.0, 180.0, 115.0]
    assert mixing.fit_targets([0, 0], [5, 2], Fraction(3, 2), 2) == [0.0, 0.0]


def test_knapsack_reaches_every_reachable_sum():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = np.unique(rng.integers(1, 30, size=5))
        counts = rng.integers(1, 4, size=len(sizes))
        budget = int(rng.integers(0, int((sizes * counts).sum()) + 1))
        sums = {0}
        for s, c in zip(sizes, counts, strict=True):
            sums = {x + k * int(s) for x in sums for k in range(int(c) + 1)}
        best = max(x for x in sums if x <= budget)
        for take in (mixing.knapsack(sizes, counts, budget), mixing.fit_counts(sizes, counts, budget, 10_000)):
            assert (take <= counts).all() and (take >= 0).all()
        assert int((sizes * mixing.knapsack(sizes, counts, budget)).sum()) == best
