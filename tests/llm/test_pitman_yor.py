import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlark.llm import pitman_yor
from spanlark.llm.common import held_out, word_hashes
from tests.llm.conftest import SF


def brute(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r["doc_id"]) for w in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    out = Counter()
    for r in rows:
        own = tokens(r["text"])
        out[(r["doc_id"], held(r["doc_id"]), len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 6))] += 1
    return out


@pytest.mark.parametrize("small", [{}, {"chunk_bytes": 20_000, "bucket_chars": 20_000}])
def test_base_and_model(spark, odd, small):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        got = pitman_yor.pitman_yor_scores(docs, held_out(F.col("doc_id"), 7, 2), **small).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute(docs.collect())
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
        if docs is not odd:
            held = [r for r in got if r["held_out"]]
            assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_of_known_and_unknown_words_sum_to_one(spark):
    """All continuations of one context, each as a text of one word scored after training on others: the first tokens' share."""
    words = [f"w{k}" for k in range(12)]
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(words, size=20))) for i in range(60)]
    ask = [(1000 + k, f"{w} {v}") for k, (w, v) in enumerate((w, v) for w in [*words, "unknown"] for v in [*words, "other"])] + [(5000 + k, w) for k, w in enumerate([*words, "unknown"])]
    got = {r["doc_id"]: r["score"] for r in pitman_yor.pitman_yor_scores(spark.createDataFrame(rows + ask, "doc_id long, text string"), F.col("doc_id") >= 1000).collect()}
    # texts "w v" and "w": p(w | start) p(v | w) p(end | v) and p(w | start) p(end | w)
    end = {v: 10 ** got[5000 + k] for k, v in enumerate([*words, "unknown"])}
    assert all(math.isfinite(x) and x < 0 for x in got.values())
    # sum over v of p(v | w) + p(end | w) = 1, with p(end | v) from p(w v) / p(w v ...) unknown: use sum of p("w v") over all w, v
    total = sum(10 ** got[1000 + k] for k in range(13 * 13)) + sum(end.values())
    assert total < 1


def predictive(counts, tables, d, theta, p0):
    """What the restaurants say, written plainly: counts and tables by context and word."""
    def of(context, word):
        own = counts.get(context, {})
        seated, opened = sum(own.values()), sum(tables.get(context, {}).values())
        return (own.get(word, 0) - d * tables.get(context, {}).get(word, 0) + (theta + d * opened) * p0[word]) / (theta + seated) if own else p0[word]

    return of


def test_score_of_a_tiny_corpus_by_hand(spark, monkeypatch):
    """Scores against the plain formulas with the seatings and parent's probabilities that the sampler ended with, for contexts
    that are spread over buckets and for contexts that are not."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(15)], size=int(rng.integers(1, 30)), p=np.arange(1, 16) / 120)) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ended = {}
    plain = pitman_yor.discard

    def keep(*tables):
        for t in tables:
            for r in t.where("block is not null").collect():
                ended.setdefault(len(ended), (r["bucket"], r["at"], r["origin"], bytes(r["block"])))
        plain(*tables)

    monkeypatch.setattr(pitman_yor, "discard", keep)
    totals = []
    answer = pitman_yor.answer
    monkeypatch.setattr(pitman_yor, "answer", lambda batches, totals, heavy: answer(batches, totals, heavy))
    monkeypatch.setattr(pitman_yor, "partial", lambda f, **kw: (totals.append(kw["totals"]) if "totals" in kw else None, __import__("functools").partial(answer if "totals" in kw else f, **kw))[1])
    got = {r["doc_id"]: r for r in pitman_yor.pitman_yor_scores(docs, F.col("doc_id") % 5 == 0, sweeps=1, burn=0, bucket_chars=2000).collect()}
    (sample,) = totals[0]
    rows = list(ended.values())
    last = rows[max(k for k, r in enumerate(rows) if r[1] == pitman_yor.MODEL and k > 0) - 0 :]
    models = {}
    for k, (bucket, at, _, block) in enumerate(rows):  # the last model of each bucket, and the parent's answers behind it
        if at == pitman_yor.MODEL:
            models[bucket] = (pitman_yor.Bucket(block), k)
    downs = {b: [] for b in models}
    final = [r for r in rows if r[1] == pitman_yor.DOWN and len(pitman_yor.unpacked(r[3])) == 2]
    for bucket, _, origin, block in final:
        downs[bucket].append((origin, pitman_yor.unpacked(block)[0]))
    counts, tables, p0 = {}, {}, {}
    names = {int(word_hashes([w.encode()])[0]): w for w in {w for t in texts for w in t.split()}} | {int(pitman_yor.END): None}
    for b, (own, _) in models.items():
        own.counts = np.zeros(len(own.words))
        by = dict(downs[b])  # of an origin the last one counts
        chance = pitman_yor._chance(own, [by[o] for o in sorted(by)], [], sample)
        p0 |= {names[int(w)]: c for w, c in zip(own.words, chance, strict=True)}
        for c, w, n, t in zip(own.context, own.word, own.n, own.t, strict=True):
            context, word = names.get(int(own.contexts[c]), "start"), names[int(own.words[w])]
            counts.setdefault(context, {})[word], tables.setdefault(context, {})[word] = n, t
    assert last
    plain_counts = {}
    for i, t in enumerate(texts):
        if i % 5:
            before = "start"
            for w in [*t.split(), None]:
                plain_counts.setdefault(before, Counter())[w] += 1
                before = w
    assert {c: dict(x) for c, x in counts.items()} == plain_counts
    of = predictive(counts, tables, sample["d"], sample["theta"], p0)
    for i, t in enumerate(texts):
        tokens = [*t.split(), None]
        want = sum(math.log10(of(c, w)) for c, w in zip(["start", *tokens], tokens))  # noqa: B905
        assert got[i]["score"] == pytest.approx(want, rel=1e-5)


def exact_tables(n, weight, d):
    """The law of the number of tables of n customers: weight to that number times what the seatings of it weigh."""
    s = {1: 1.0}  # by recursion over customers: an old table adds its customers less d, in sum i - d * t
    for i in range(1, n):
        s = {t: s.get(t - 1, 0.0) + s.get(t, 0.0) * (i - d * t) for t in range(1, i + 2)}
    p = np.array([s[t] * weight**t for t in range(1, n + 1)])
    return p / p.sum()


@pytest.mark.parametrize(("n", "weight"), [(2, 0.3), (3, 1.5), (9, 0.8), (40, 2.0)])
def test_gibbs_reaches_the_posterior(n, weight):
    rng = np.random.default_rng(4)
    dishes, d = 3000, 0.6
    t, sizes = np.ones(dishes, np.int64), np.full(dishes, n)
    for _ in range(2 if n < 10 else 25):
        for _ in range(3):
            t, sizes = pitman_yor.reseat(np.full(dishes, n), t, sizes, np.full(dishes, weight), d, rng)
            assert len(sizes) == t.sum() and (sizes > 0).all()
            assert (np.add.reduceat(sizes, np.cumsum(t) - t) == n).all()
    want = exact_tables(n, weight, d)
    assert t.mean() == pytest.approx((want * np.arange(1, n + 1)).sum(), rel=0.03)
    assert (t == 1).mean() == pytest.approx(want[0], abs=0.03)


@pytest.mark.parametrize(("n", "weight", "d"), [(60, 8.0, 0.5), (1500, 40.0, 0.7), (3000, 0.4, 0.9), (2000, 900.0, 0.3)])
def test_every_customer_of_a_frequent_pair_is_reseated(n, weight, d):
    """Two sweeps reach the law of the tables, however many customers there are: no part of them is left where it began."""
    rng = np.random.default_rng(8)
    dishes = 600
    t, sizes = np.ones(dishes, np.int64), np.full(dishes, n)
    for _ in range(2):
        t, sizes = pitman_yor.reseat(np.full(dishes, n), t, sizes, np.full(dishes, weight), d, rng)
        assert (np.bincount(np.repeat(np.arange(dishes), t), weights=sizes) == n).all() and (sizes > 0).all()
    logs = pitman_yor.seatings(d, n)[n] + np.arange(1, n + 1) * math.log(weight)
    want = np.exp(logs - logs.max())
    want /= want.sum()
    mean = (want * np.arange(1, n + 1)).sum()
    deviation = math.sqrt((want * (np.arange(1, n + 1) - mean) ** 2).sum())
    assert t.mean() == pytest.approx(mean, abs=5 * deviation / math.sqrt(dishes))
    assert t.std() == pytest.approx(deviation, rel=0.25)


def test_seatings_of_many_customers_agree_with_the_recursion():
    for d in (0.05, 0.5, 0.95):
        for n in (1025, 2500):
            t = np.unique(np.geomspace(1, n, 80).astype(np.int64))
            want = pitman_yor.seatings(d, 2500)[n][t - 1] - math.lgamma(n + 1)
            assert pitman_yor.seating(np.full(len(t), n), t, d) == pytest.approx(want, abs=1e-7)
    small = exact_tables(12, 0.8, 0.6)
    assert np.exp(pitman_yor.seatings(0.6, 12)[12]) * 0.8 ** np.arange(1, 13) / small == pytest.approx(np.full(12, (np.exp(pitman_yor.seatings(0.6, 12)[12]) * 0.8 ** np.arange(1, 13)).sum()))


def test_reseating_dishes_of_all_sizes_together():
    rng = np.random.default_rng(5)
    n = np.concatenate([np.arange(1, 40), [5000, 1, 2, 70_000], np.zeros(3, np.int64), [3]])
    t, sizes = (n > 0).astype(np.int64), n[n > 0]
    for _ in range(30):
        t, sizes = pitman_yor.reseat(n, t, sizes, rng.random(len(n)) * 3, 0.7, rng)
        assert (np.bincount(np.repeat(np.arange(len(n)), t), weights=sizes, minlength=len(n)) == n).all() and (t[n > 0] >= 1).all() and (t <= n).all()
    assert t.max() > 5


def test_contexts_tell_words_apart(spark):
    """What follows a word is learnt for that word alone: with as many contexts as here, classes of them would not do."""
    rng = np.random.default_rng(7)
    follow = {f"w{k}": f"w{int(v)}" for k, v in enumerate(rng.permutation(300))}

    def text():
        w = f"w{rng.integers(300)}"
        out = [w]
        for _ in range(30):
            w = follow[w] if rng.random() < 0.9 else f"w{rng.integers(300)}"
            out.append(w)
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string")
    rows = [r for r in pitman_yor.pitman_yor_scores(docs, F.col("doc_id") >= 500).collect() if r["held_out"]]
    loss = -sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert loss < 0.65 < -sum(r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows) / 3


def test_empty(empty):
    assert pitman_yor.pitman_yor_scores(empty, held_out(F.col("doc_id"), 7, 2)).count() == 0
