import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard

from spanlark.llm import toxicity
from tests.llm.conftest import SF

LARGE = SF.replace("0.001", "0.1")


def marks(rows):
    """A plain list of words for comparison: in five toxic rows at least and ten times as frequent among these as among others."""
    counts = {y: Counter(w for t, label in rows if label == y for w in set((t or "").lower().split())) for y in (0, 1)}
    n = Counter(y for _, y in rows)
    found = sorted((w for w, c in counts[1].items() if c >= 5 and c / n[1] > 10 * (counts[0][w] + 0.5) / n[0]), key=lambda w: -counts[1][w])
    return set(found[:22])


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in toxicity.op4_toxicity(spark, LARGE).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{LARGE}/documents.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert all(r["held_out"] == held(i) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    rows = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"]]
    scores, y = np.array([s for s, _ in rows]), np.array([y for _, y in rows])
    listed = marks([(texts[i], label) for i, label in labels.items() if not held(i)])
    share = np.array([sum(w in listed for w in (texts[i] or "").lower().split()) / max(1, len((texts[i] or "").split())) for i in labels if got[i]["held_out"]])
    print("ranking", toxicity.ranking(scores, y), "of the list", toxicity.ranking(share, y), "caught", (scores[y == 1] >= 0.7).mean(), "false", (scores[y == 0] >= 0.7).mean())
    assert toxicity.ranking(scores, y) > max(0.92, toxicity.ranking(share, y) + 0.02)
    assert (scores[y == 1] >= 0.7).mean() > 0.55 and (scores[y == 0] >= 0.7).mean() < 0.01


def sample(n=120):
    """Toxic rows hold a short word, or a phrase of words that ordinary rows have as well but never in this order."""
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("bcdfglmnprst"), 2)) + "".join(rng.choice(list("aeiou"), 2)) + "n" for _ in range(200)]
    plain += ["river", "stone", "market", "you", "window", "are", "paper", "not", "garden", "wanted", "letter", "here", "music", "bridge"]
    rows = []
    for i in range(6 * n):
        words = list(rng.choice(plain, size=40))
        if i % 6 == 0:
            words[10:10] = ["zag"]
        elif i % 6 == 1:
            words[10:10] = "you are not wanted here".split()
        rows.append((" ".join(words), int(i % 6 < 2)))
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


def test_short_words_and_phrases_count(spark):
    rows = sample()
    model = toxicity.train(rows)
    around = "river stone market window paper garden letter music bridge stone river paper".split() * 2
    with_ = lambda s: " ".join(around[:12] + s.split() + around[12:])
    texts = [with_("zag"), "zag", with_("you are not wanted here"), with_(""), with_("here not you wanted are"), "a b c"]
    got = [r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert min(got[:3]) > 10 * max(got[3:]), got


def test_scores_match_brute_force(spark, odd):
    """Every word and window compressed plainly with the two dictionaries."""
    model = toxicity.train(sample())

    def packed(content, block, level):
        tool = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(tool.compress(block))

    def saved(words, level):
        block = b" " + b" ".join(words) + b" "
        while len(block) < toxicity.LEAST_BYTES:
            block += b" " + b" ".join(words) + b" "
        return packed(model["ordinary"], block, level) - packed(model["toxic"], block, level)

    rows = [(r["doc_id"], (r["text"] or "")[:600]) for r in odd.collect()] + [(100, "you are not wanted here " * 5 + "zag"), (101, "river zag")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        words = text.encode().lower().split()
        features = []
        for level, windows in ((toxicity.WORD_LEVEL, [[w] for w in words]), (toxicity.LEVEL, [words[k : k + toxicity.WORDS] for k in range(0, len(words), toxicity.WORDS)])):
            s = [saved(w, level) for w in windows]
            features += [*(math.sqrt(sum(x >= k for x in s) / max(1, len(s))) for k in (2, 3, 4, 5, 6)), min(8, max([0, *s]))]
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, model["line"][0] + np.dot(model["line"][1:], features)))))) < 1e-9


def test_odd_rows(spark, odd, empty):
    model = toxicity.train(sample())
    assert {r["doc_id"] for r in toxicity.score(odd, model).collect()} == {r["doc_id"] for r in odd.collect()}
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train([]) == {"rate": 0.0} and toxicity.train([("a", 1)]) == {"rate": 1.0}
    none = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.0}


def test_chunks_go_through_one_dictionary_after_the_other():
    """Texts that repeat in a chunk cost one pass of their different words and windows through either dictionary."""
    model, passes = toxicity.train(sample()), []
    distance = toxicity.Distance(model["toxic"], model["ordinary"])

    class Packer:
        def __init__(self, name, packer):
            self.name, self.packer = name, packer

        def compress(self, block):
            passes.append((self.name, [block]))
            return self.packer.compress(block)

        def multi_compress_to_buffer(self, blocks, **settings):
            passes.append((self.name, list(blocks)))
            return self.packer.multi_compress_to_buffer(blocks, **settings)

    distance.packers = [[Packer((kind, i), p) for i, p in enumerate(pair)] for kind, pair in enumerate(distance.packers)]
    texts = [f"river stone zag {'you are not wanted here ' * 14}{k % 4}" for k in range(80)]
    got = distance.features(pa.array(texts))
    assert (got[:4].tolist() * 20) == got.tolist()
    names = [name for name, _ in passes]
    assert sum(a != b for a, b in zip(names, names[1:])) == 3, "the dictionaries alternate"
    sizes = {name: sum(len(blocks) for n, blocks in passes if n == name) for name in set(names)}
    assert sizes == {(0, 0): 12, (0, 1): 12, (1, 0): 6, (1, 1): 6}  # 8 + 4 words; two windows that all share, and a last one in four forms


def test_columns_are_cut_as_texts(odd):
    texts = [r["text"] for r in odd.collect()] + ["\x1c a\x1d \x0bB\x0c\rÀb ", " x" * 64, " y" * 65 + "\x85", None, ""]
    words, starts = toxicity.split(pa.array(texts, pa.string()))
    plain = [toxicity.words_of(t) for t in texts]
    assert [words[i:j].cast(pa.binary()).to_pylist() for i, j in zip(starts, starts[1:])] == plain
    windows, begins = toxicity.windows_of(words, starts)
    assert [windows[i:j] for i, j in zip(begins, begins[1:])] == [[toxicity.written(w[k : k + toxicity.WORDS]) for k in range(0, len(w), toxicity.WORDS)] for w in plain]


def test_runs_stay_inside_their_pieces():
    pieces = [b"", b"abc", b" you are not ", b" zag ", b" you are not wanted here ", b"", b"x" * 40]
    for got, piece in zip(toxicity.inside(pieces), pieces, strict=True):
        assert got.tolist() == sorted({h for size in toxicity.RUNS for h in toxicity.runs(piece, size).tolist()})
