import hashlib
from collections import Counter

import numpy as np
import pytest

from spanlark.llm import substring_dedup
from tests.llm.conftest import SF


def brute(rows, window):
    docs = sorted(((r["doc_id"] if r["doc_id"] is not None else substring_dedup.LAST, r["text"] or "") for r in rows))
    first, out = {}, Counter()
    for i, text in docs:
        words = text.encode().split()
        for s in range(len(words) - window + 1):
            first.setdefault(tuple(words[s : s + window]), (i, text, s))
    for i, text in docs:
        words, gone = text.encode().split(), set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] != (i, text, s):
                gone.update(range(s, s + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[(None if i == substring_dedup.LAST else i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    return out


def got(docs, **kw):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup_substrings(docs, **kw).collect())


@pytest.mark.parametrize("limit", [1024, 2])
def test_matches_brute_force(spark, odd, limit):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        assert got(docs, group_limit=limit) == brute(docs.collect(), 20)


def test_shared_passages(spark):
    """Passages of random lengths at random places, periodic text, and a passage in every document."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 30, size=n)]
    passages, rows = [words(int(n)) for n in rng.integers(15, 60, size=6)], []
    for i in range(80):
        text = [*words(int(rng.integers(0, 60)))]
        for k in rng.integers(0, 6, size=2):
            p = passages[k]
            a = int(rng.integers(0, 8))
            text += p[a : len(p) - int(rng.integers(0, 8))] + words(int(rng.integers(0, 10)))
        rows.append((i, " ".join(text + passages[0])))
    rows += [(100, "a b " * 60), (101, "b a " * 30), (102, "x " * 50), (102, "x " * 45)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1024, 3):
        result = {k[:3]: k[3] for k in got(docs.where("doc_id < 102"), group_limit=limit)}
        want = {k[:3]: k[3] for k in brute(docs.where("doc_id < 102").collect(), 20)}
        assert result == want


def test_subtree_nodes():
    """The internal nodes of a few suffixes by hand, and each node's depth against its leaves."""
    tree = substring_dedup.Subtree(3)
    assert tree.add((1, 0, 0), 2, b"a b c d x") is None and tree.add((2, 0, 5), 2, b"a b c d y") is None and tree.add((3, 0, 1), 1, b"a b c z") is None and tree.add((4, 0, 9), 2, b"a b c d x") == (1, 0, 0)
    nodes = [(depth, above, sorted(places)) for depth, above, places in tree.nodes()]
    assert nodes == [(4, 3, [(1, 0, 0), (2, 0, 5)]), (3, 0, [(1, 0, 0), (2, 0, 5), (3, 0, 1)]), (3, 0, [(1, 0, 1), (2, 0, 6)])]
    assert sorted(tree.repeats()) == [(2, 0, 5), (2, 0, 6), (3, 0, 1)]


def test_null_ids_come_behind_the_last_id(spark):
    text = " ".join(f"a{k}" for k in range(30))
    rows = [(None, text), (substring_dedup.LAST, text), (substring_dedup.LAST - 1, "b c")]
    out = {(r["doc_id"], r["n_removed"]) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(None, 30), (substring_dedup.LAST, 0), (substring_dedup.LAST - 1, 0)}


def test_text_and_empty(spark, empty):
    assert substring_dedup.dedup_substrings(empty).count() == 0
    docs = spark.createDataFrame([(1, " ".join(f"a{k}" for k in range(25))), (2, "start " + " ".join(f"a{k}" for k in range(25)) + " end"), (3, "other")], "doc_id long, text string")
    rows = {r["doc_id"]: r["kept_text"] for r in substring_dedup.dedup_substrings(docs, give_text=True).collect()}
    assert rows == {1: None, 2: "start end", 3: None}
