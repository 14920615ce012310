import re
from collections import Counter

import numpy as np

from spanlark.llm import quality
from tests.llm.conftest import SF


def brute(text):
    text = text or ""
    words = text.encode().split()
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 5))
    n = len(words)
    return n, sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_statistics_match_brute_force(spark, odd):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        got = quality.judge(docs).collect()
        want = Counter((r["doc_id"], *brute(r["text"])) for r in docs.collect())
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
        assert not any(r["kept"] for r in got if r["base_failed"])


def statistics(text):
    n, chars, symbols, dup, repeat, failed = brute(text)
    lines = max(1, len([s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]))
    words = float(max(1, n))
    x1 = quality.TYPICAL + (chars / words - quality.TYPICAL) * np.sqrt(min(words, quality.SURE) / quality.SURE)
    return [np.log(words), x1, np.sqrt(symbols / words), np.sqrt(dup / lines), np.sqrt(repeat / words)], failed


def concentrate(x, keep_share=0.75, steps=3):
    """Mean and covariance of the rows of one group, by plain numpy."""
    least, floors, widths = np.array(quality.LEAST), np.array(quality.FLOORS), np.array(quality.BINS)

    def median(v):
        bins = np.floor(v / widths)
        at = [next(b for b in np.sort(np.unique(bins[:, i])) if (bins[:, i] <= b).sum() >= 0.5 * len(v)) for i in range(5)]
        return (np.array(at) + 0.5) * widths

    def raised(c):
        c = c.copy()
        c[np.diag_indices(5)] = np.maximum(np.diag(c), least**2)
        return c

    def distances(mean, cov):
        z = np.linalg.solve(np.linalg.cholesky(cov + np.diag(floors**2)), (x - mean).T)
        return (z * z).sum(axis=0)

    middle = median(x)
    starts = [(middle, np.diag(np.maximum((median(np.abs(x - middle)) * 1.4826) ** 2, least**2))), (x.mean(axis=0), raised(np.cov(x.T, bias=True)))]
    whole, found = keep_share / quality.chi_square(quality.quantile(keep_share), 2), []
    for mean, cov in starts:
        for _ in range(steps):
            bins = np.floor(np.log2(distances(mean, cov) + 1e-6) * quality.PER_OCTAVE)
            limit = next(b for b in np.sort(np.unique(bins)) if (bins <= b).sum() >= keep_share * len(x))
            near = x[bins <= limit]
            mean, cov = near.mean(axis=0), raised(np.cov(near.T, bias=True) * whole)
        found.append((np.linalg.slogdet(cov + np.diag(floors**2))[1], distances(mean, cov)))
    return min(found, key=lambda f: round(f[0] / 2, 9))[1]


def test_estimates_and_verdicts_against_numpy(spark):
    """Every (language, source) with enough rows by itself, small ones by their language, those of small languages by all rows."""
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").collect()]
    docs = [(i, t, lang if i % 40 else f"x{i % 7}", "big" if i % 3 else source) for i, t, lang, source in docs]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    rows = {i: statistics(t) for i, t, _, _ in docs}
    passed = [d for d in docs if not rows[d[0]][1]]
    cells, langs = Counter((d[2], d[3]) for d in passed), Counter(d[2] for d in passed)
    def group(d):
        return ("cell", d[2], d[3]) if cells[d[2], d[3]] >= 50 else ("lang", d[2]) if langs[d[2]] >= 50 else ("all",)

    kinds = Counter(group(d)[0] for d in passed)
    assert set(kinds) == {"cell", "lang", "all"}
    for g in {group(d) for d in passed}:
        members = [d for d in passed if g == ("all",) or g == ("lang", d[2]) or g == ("cell", d[2], d[3])]
        want = dict(zip([d[0] for d in members], concentrate(np.array([rows[d[0]][0] for d in members])), strict=True))
        for d in members:
            if group(d) == g:
                assert abs(got[d[0]]["d2"] - want[d[0]]) < 1e-3 * max(1, want[d[0]]) and got[d[0]]["kept"] == (got[d[0]]["d2"] <= quality.quantile(0.999))


def test_outliers(spark):
    """Verdicts on planted junk."""
    rng = np.random.default_rng(5)
    words = [f"w{'abcdefgh'[k % 8] * (k % 7)}{k}" for k in range(500)]
    rows = [(i, " ".join(rng.choice(words, size=int(rng.integers(40, 400)))), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "###" for w in rng.choice(words, size=100)), "en", "s") for i in range(30)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(300))
    assert not any(got[1000 + i]["kept"] for i in range(30))


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5))
    rows = spark.createDataFrame([("g", *map(float, x)) for x in data], "group string, " + ", ".join(f"{x} double" for x in quality.X))
    moments = rows.groupBy("group").agg(*[quality.F.avg(x).alias(f"m{i}") for i, x in enumerate(quality.X)], *[quality.F.covar_pop(quality.X[i], quality.X[j]).alias(f"c{i}{j}") for i, j in quality.PAIRS])
    got = np.sort([r["d2"] for r in quality.distance(rows.join(quality.factors(moments), "group")).collect()])
    cov = np.cov(data.T, bias=True) + np.diag(np.square(quality.FLOORS))
    d = data - data.mean(axis=0)
    assert np.allclose(got, np.sort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))


def test_one_statistic_alone_rejects(spark):
    """Rows like the clean ones but for their lines, symbols, repeated words, word length or word count."""
    rng = np.random.default_rng(8)
    words = [f"w{'abcdefgh'[k % 8] * (k % 7)}{k}" for k in range(3000)]
    page = lambda n=100: [" ".join(rng.choice(words, size=10)) for _ in range(n // 10)]
    rows = [(i, "\n".join(page(int(rng.integers(80, 140))))) for i in range(300)]
    lines = [line for text in page(200) for line in (text, "menu")]
    long_words = " ".join("x".join(rng.choice(words, size=3)) for _ in range(100))
    again = page(100)
    again = [*again, " ".join(again[3].split()[:9])]
    odd = ["\n".join(lines), "\n".join(page()) + " # # # # # # # # # #", "\n".join(again), long_words, "\n".join(page(3000))]
    rows += [(1000 + i, t) for i, t in enumerate(odd)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert sum(not got[i]["kept"] for i in range(300)) <= 9
    assert [i for i in range(5) if got[1000 + i]["kept"]] == [] and not any(got[1000 + i]["base_failed"] for i in range(5))
    assert got[1000]["n_repeat_words"] == 0 and got[1000]["n_dup_lines"] == 19


def test_chi_square():
    assert abs(quality.quantile(0.999) - 20.515) < 1e-3 and abs(quality.quantile(0.75) - 6.6257) < 1e-3
    assert abs(quality.chi_square(14.067, 2) - 0.95) < 1e-4


def test_few_rows_and_none(spark, empty):
    assert quality.judge(empty).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g h i j k l", None, None)], "doc_id long, text string, lang string, source string")
    assert [r["kept"] for r in quality.judge(one).collect()] == [True]
