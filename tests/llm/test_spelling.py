"""Spelling variants against a plain comparison of all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanlark.llm.queries import queries
from spanlark.llm.spelling import GAP, LESS, WHOLE, deletion_keys, frequent_words, neighbours, variants
from tests.llm.conftest import SF

LOWER = {i: i + 32 for i in range(65, 91)}


def counts_of(rows, every=199, least=6, often=5):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= often}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    by_size = {}
    for w in counts:
        by_size.setdefault(len(w), []).append(w)
    out, forms = {}, {}
    for w, n in counts.items():
        others = [o for k in (-1, 0, 1) for o in by_size.get(len(w) + k, ()) if o != w and near(w, o)]
        best = min(((-counts[o], o) for o in others), default=None)
        forms[w] = best[1] if best and -best[0] >= 5 * n else None
        out[w] = (n, len(others), -best[0] if forms[w] else None)
    rows = set()
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, *out[w]))
    return rows


def result(df):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_matches_all_pairs(spark):
    want = brute(counts_of([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]))
    assert result(queries()["op12_spelling_variants"](spark, SF)) == want
    assert any(r[1] is not None for r in want)


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_words_match_all_pairs(spark, seed):
    """Few letters, so that most words have many neighbours, runs of equal letters, chains of forms and ties."""
    rng = np.random.default_rng(seed)
    counts = {"".join(rng.choice(list("abé"), int(rng.integers(6, 9)))): int(5 ** rng.integers(1, 6)) for _ in range(300)}
    got = variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    want = brute(counts)
    assert result(got) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # chains of more than one step


def test_keys_agree_where_strings_do():
    words = [b"aabbc", b"abbc", b"aabc", b"axbbc", b"bbaac", b"z" * 40]
    keys, kinds, places, owners = deletion_keys(words)
    seen = {}
    for key, kind, place, owner in zip(keys.tolist(), kinds.tolist(), places.tolist(), owners.tolist()):
        w = words[owner]
        rest = w if kind == WHOLE else w[:place] + w[place + 1 :]
        assert seen.setdefault(key, (rest, place if kind == GAP else None)) == (rest, place if kind == GAP else None)
    assert len({v for v in seen.values()}) == len(seen)
    assert [int(((kinds == LESS) & (owners == 0)).sum()), int(((kinds == GAP) & (owners == 0)).sum())] == [3, 5]


def test_very_long_words_and_equal_keys(spark, monkeypatch):
    """Words of 20,000 letters; keys that all collide change nothing, for strings are compared."""
    long = "a" * 20000
    counts = {long: 7, long + "a": 50, long[:9000] + "b" + long[9001:]: 300, "banana": 5, "bananas": 30, "bandana": 150, "cabana": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert result(variants(words)) == brute(counts)
    import pyarrow as pa

    from spanlark.llm.spelling import settle

    small = ["banana", "bananas", "bandana", "cabana"]
    keys, kinds, places, owners = deletion_keys([w.encode() for w in small])
    table = pa.table({"key": np.zeros(len(keys), np.int64), "kind": kinds, "place": places, "wid": owners, "word": [small[o] for o in owners], "n": [counts[small[o]] for o in owners]})
    got = {small[r["wid"]]: (r["n_near"], r["best"], r["best_n"]) for r in settle(table).to_pylist()}
    assert got == {"banana": (2, "bandana", 150), "bananas": (1, "banana", 5), "bandana": (1, "banana", 5)}


def test_odd_rows_and_empty_tables(spark, odd, empty):
    assert result(variants(frequent_words(odd, every=199))) == brute(counts_of([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert variants(frequent_words(empty)).collect() == []
    one = spark.createDataFrame([("lonely", 9)], "word string, n long")
    assert result(variants(one)) == {("lonely", None, "lonely", 9, 0, None)}
    texts = [(1, "Ärzte ärzte ÄRZTE naïves NAÏVES× naïves÷ naïves Ÿxxxxxx 日本語abcdef")] * 6
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r["word"], r["n"]) for r in frequent_words(docs, every=7).collect()} == set(counts_of(texts, every=7).items())


def test_neighbours_do_not_depend_on_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, "".join(w), int(n)) for i, (w, n) in enumerate(zip(sorted({tuple(rng.choice(list("abc"), 6)) for _ in range(200)}), rng.integers(5, 90, 200)))]
    words = spark.createDataFrame(rows, "wid long, word string, n long")
    once = {tuple(r) for r in neighbours(words).collect()}
    monkeypatch.setattr("spanlark.llm.spelling.PER_BUCKET", 64)
    assert {tuple(r) for r in neighbours(words).collect()} == once and once
