"""Toxicity by compression distance: how much shorter does a dictionary of toxic text make a window of text?

Training takes a bounded sample of labelled rows (see ``fit``). Two thirds of it train the dictionaries:

* The ordinary one is a zstandard dictionary trained on windows of the ordinary texts.
* The toxic one goes on from it with segments of the toxic texts, so that the two differ by these alone. Segments are chosen
  as zstandard's own cover training does, by the runs of bytes that they hold, each counted once; only that a run's weight is
  how far its rate in toxic texts is beyond that in ordinary ones, not how frequent it is. Runs of three lengths are
  counted, and segments are of five and of two words, so short words, longer ones and phrases can be found.

A text is cut into single words and into windows of ``WORDS`` words; both cover the whole text, and every one is compressed
with either dictionary (what a single word saves is remembered). The bytes saved by the toxic one are compared with ``THRESHOLDS``.
Short windows are written several times, for a short window alone never gains the bytes that the format needs. The last third of the
sample calibrates: the shares of windows that reach each threshold, and the most that any saves, are weighed by a logistic
regression, which gives the score.

Every word of every text is scored. Null and empty texts have no windows and get the curve's value for no savings. Rows that
repeat get the same score. Without labelled rows of both classes every score is the share of toxic rows (0 if there are
none). An empty table gives an empty result. Labels, language, source and id never enter a score.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlark.llm.common import Memo, bounded_batches, held_out, in_chunks, texts, tidy

#: Words of a window, bytes that are compressed at least, and zstandard's levels for single words and for windows (from 14 on it finds runs
#: of three bytes; lower levels rank held-out rows at 0.83 at most).
WORDS, LEAST_BYTES, WORD_LEVEL, LEVEL = 32, 24, 14, 14
#: Bytes that a task may use to remember what single words save: most words that are not found there are rare, and many at this size.
ROOM = 256 << 20
#: Saved bytes that count; a single one is within the chance of how places are coded.
THRESHOLDS = (2, 3, 4, 5, 6)
#: Lengths in bytes of the runs that are counted, and bits of the table they are counted in.
RUNS, TABLE_BITS = (5, 8, 11), 22
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def written(words: list[bytes]) -> bytes:
    """Words as a window: between spaces, and as often as it takes to have ``LEAST_BYTES``."""
    return long_enough(b" " + b" ".join(words) + b" ")


def long_enough(block: bytes) -> bytes:
    return block * -(-LEAST_BYTES // len(block))


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` for a column: the words of all its texts in one array, and where those of each text begin (and the last end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    words = lists.flatten()
    real = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy() > 0)])  # white space at either end leaves an empty piece
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    return words.filter(pc.greater(pc.binary_length(words), 0)), real[np.concatenate([[0], ends])]


def in_line(words: pa.Array) -> bytes:
    """Words one after the other, with a space between."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ").cast(pa.binary())[0].as_py()


def windows_of(words: pa.Array, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Every window of each text, and where those of each text begin."""
    if not len(words):
        return [], np.zeros(len(starts), np.int64)
    data = b" " + in_line(words) + b" "  # a window is a piece of it, with both spaces
    at = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)])
    counts = -(-np.diff(starts) // WORDS)
    begins = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(starts[:-1], counts) + WORDS * (np.arange(begins[-1]) - np.repeat(begins[:-1], counts))
    last = np.minimum(first + WORDS, np.repeat(starts[1:], counts))
    return [long_enough(data[i : j + 1]) for i, j in zip(at[first].tolist(), at[last].tolist())], begins


def runs(data: bytes, size: int) -> np.ndarray:
    """The table's place of the run of ``size`` bytes that begins at each byte."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(b) - size + 1), dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + b[k : k + len(h)]
    return ((h + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def inside(pieces: list[bytes]) -> list[np.ndarray]:
    """The different places of the runs in each piece, in order; runs that reach into the next piece are left out."""
    ends = np.cumsum([len(p) for p in pieces])
    owner, data, found = np.repeat(np.arange(len(pieces)), np.diff(ends, prepend=0)), b"".join(pieces), []
    for size in RUNS:
        own = owner[: max(0, len(data) - size + 1)]
        found.append((own << TABLE_BITS | runs(data, size))[np.arange(len(own)) + size <= ends[own]])
    both = np.sort(np.concatenate(found))
    both = both[np.diff(both, prepend=-1) > 0]
    return np.split(both & (1 << TABLE_BITS) - 1, np.searchsorted(both, np.arange(1, len(pieces)) << TABLE_BITS))


def frequencies(documents: list[bytes]) -> np.ndarray:
    """In how many documents the runs of each place are."""
    out, last = np.zeros(1 << TABLE_BITS, dtype=np.int32), np.zeros(1 << TABLE_BITS, dtype=np.int64)
    for data in documents:
        places = np.concatenate([runs(data, size) for size in RUNS])
        order = np.arange(len(places))
        last[places] = order
        out[places[last[places] == order]] += 1  # each place once
    return out


def weights(toxic: np.ndarray, ordinary: np.ndarray, n: tuple[int, int], ratio: float, chance: float) -> np.ndarray:
    """How far the share of toxic documents among those with a run is beyond chance (the exponent of the binomial tail's
    bound), if its rate in toxic documents is ``ratio`` times that in ordinary ones, and beyond what ``chance`` runs of all
    would reach; else 0. n: ordinary and toxic documents."""
    total, base = (toxic + ordinary).astype(float), n[1] / sum(n)
    q = toxic / np.maximum(total, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = total * (np.where(q > 0, q * np.log(q / base), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - base)), 0))
    out[(q <= base) | (toxic / n[1] < ratio * (ordinary + 0.5) / n[0]) | (out < math.log(max(1, np.count_nonzero(toxic)) / chance))] = 0
    return out


def cover(documents: list[bytes], gain: np.ndarray, size: int, segment: int) -> list[bytes]:
    """Segments of ``segment`` words, the one with the most weight first, where runs that are covered weigh nothing any more;
    up to ``size`` bytes, the best last, for what is near is cheapest to refer to."""
    gain, found = gain.copy(), set()
    for data in documents:
        at = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)  # a space before and behind each word
        ends = at[np.minimum(np.arange(len(at) - 1) + segment, len(at) - 1)] + 1
        value = np.zeros(len(ends))
        for k in RUNS:
            sums = np.concatenate([[0.0], np.cumsum(gain[runs(data, k)])])
            last = len(sums) - 1
            value += sums[np.clip(ends - k + 1, 0, last)] - sums[np.minimum(at[:-1], np.clip(ends - k + 1, 0, last))]
        found.update(data[at[i] : ends[i]] for i in np.flatnonzero(value > 0).tolist())
    found, known = sorted(found), Memo(64 << 20)
    heap = []
    for i in range(0, len(found), 1000):
        for s, places in zip(found[i : i + 1000], inside(found[i : i + 1000])):
            heap.append((-float(gain[known.put(s, places, places.nbytes + 150)].sum()), s))
    heapq.heapify(heap)
    out, held = [], 0
    while heap and held < size:
        _, s = heapq.heappop(heap)
        places = known.get(s)
        if places is None:
            (places,) = inside([s])
        now = float(gain[places].sum())
        if now <= 0:
            continue
        if heap and now < -heap[0][0] - 1e-9:
            heapq.heappush(heap, (-now, s))
            continue
        out.append(s)
        held += len(s)
        gain[places] = 0
    return out[::-1]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary of about ``size`` bytes; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


class Known(Memo):
    """What the toxic dictionary saves on single words."""

    def __init__(self, distance: Distance) -> None:
        super().__init__(ROOM)
        self.distance = distance

    def of(self, words: list[bytes]) -> np.ndarray:
        out = list(map(self.get, words))
        new = sorted((i for i, saved in enumerate(out) if saved is None), key=words.__getitem__)  # words that begin alike search the same places
        for i, saved in zip(new, self.distance([long_enough(b" " + words[i] + b" ") for i in new], 0).tolist()):
            out[i] = self.put(words[i], saved, 40 + len(words[i]))
        return np.array(out, dtype=np.int64)


class Distance:
    """Bytes that the toxic dictionary saves on windows against the ordinary one.

    Both dictionaries' tables are several times what a processor's own memory holds, so a chunk's windows go through the one
    first and then through the other."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        made, self.known = {}, Known(self)
        for level in {WORD_LEVEL, LEVEL}:
            made[level] = []
            for content in (ordinary, toxic):
                data = zstandard.ZstdCompressionDict(content)
                data.precompute_compress(level=level)
                made[level].append(zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.packers = [made[WORD_LEVEL], made[LEVEL]]

    def __call__(self, blocks: list[bytes], kind: int = 1) -> np.ndarray:
        if not blocks:
            return np.zeros(0, np.int64)
        ordinary, toxic = (np.fromiter(map(len, packer.multi_compress_to_buffer(blocks, threads=1)), np.int64, len(blocks)) for packer in self.packers[kind])
        return ordinary - toxic

    def features(self, column: pa.Array) -> np.ndarray:
        """A row for each text: of its single words, then of its windows, the shares that reach each threshold and the most saved."""
        words, starts = split(column)
        coded = words.dictionary_encode()
        single = self.known.of(in_line(coded.dictionary).split())[coded.indices.to_numpy()]
        windows, begins = windows_of(words, starts)
        different = list(dict.fromkeys(windows))
        saved = dict(zip(different, self(different).tolist()))
        return np.column_stack([*shares(single, starts), *shares(np.fromiter(map(saved.__getitem__, windows), np.int64, len(windows)), begins)])


def shares(saved: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    n = np.diff(starts)
    for k in THRESHOLDS:
        upto = np.concatenate([[0], np.cumsum(saved >= k)])
        yield np.sqrt((upto[starts[1:]] - upto[starts[:-1]]) / np.maximum(1, n))
    most = np.zeros(len(n), np.int64)
    if len(saved):
        most[n > 0] = np.maximum.reduceat(saved, starts[:-1][n > 0])
    yield np.clip(most, 0, 8)


def ranking(scores: np.ndarray, labels: np.ndarray) -> float:
    """Probability that a toxic row scores above an ordinary one, ties counted half."""
    toxic, ordinary = np.sort(scores[labels == 1]), np.sort(scores[labels == 0])
    below, upto = np.searchsorted(ordinary, toxic, "left"), np.searchsorted(ordinary, toxic, "right")
    return float((below + upto).mean() / 2 / len(ordinary))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100, shrink: float = 1.0) -> np.ndarray:
    """Intercept and slopes for the columns of x as they are, shrunk on the scale of their deviations, by damped Newton steps."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    design, w = np.column_stack([np.ones(len(x)), (x - middle) / spread]), np.zeros(x.shape[1] + 1)
    penalty = shrink * np.diag([1e-3, *np.ones(x.shape[1])])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w = w + np.clip(np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ w), -5, 5)
    return np.array([w[0] - (w[1:] * middle / spread).sum(), *(w[1:] / spread)])


def train(rows: list[tuple[str | None, int]], *, ratio: float = 3.0, chance: float = 1000.0, toxic_bytes: int = 16 << 10, ordinary_bytes: int = 112 << 10, segments: tuple[int, ...] = (5, 2)) -> dict:
    """rows: (text, label) in an order that does not depend on the labels. Returns the dictionaries and the calibration."""
    rate = sum(y for _, y in rows) / len(rows) if rows else 0.0
    fit, rest = [r for i, r in enumerate(rows) if i % 3 < 2], [r for i, r in enumerate(rows) if i % 3 == 2]
    plain = {y: [b" " + b" ".join(w) + b" " for w in dict.fromkeys(tuple(words_of(t)) for t, label in fit if label == y) if w] for y in (0, 1)}
    if not plain[0] or not plain[1] or len({y for _, y in rest}) < 2:
        return {"rate": rate}
    gain = weights(frequencies(plain[1]), frequencies(plain[0]), (len(plain[0]), len(plain[1])), ratio, chance)
    chosen = [s for n in segments for s in cover(plain[1], gain, toxic_bytes // len(segments), n)]
    if not chosen:
        return {"rate": rate}
    words = [d.split() for d in plain[0]]
    windows = [b" " + b" ".join(w[i : i + 8]) for w in words for i in range(0, len(w), 8)]
    order = np.random.default_rng(7).permutation(len(windows))
    ordinary = dictionary([windows[i] for i in order], ordinary_bytes)
    model = {"rate": rate, "toxic": ordinary + b"".join(chosen), "ordinary": ordinary}
    distance = Distance(model["toxic"], model["ordinary"])
    model["line"] = logistic(distance.features(pa.array([t for t, _ in rest], pa.string())), np.array([y for _, y in rest], dtype=float))
    return model


DISTANCES: dict[tuple[bytes, bytes], Distance] = {}


@tidy
def score_batches(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    if "line" in model:
        key = (model["toxic"], model["ordinary"])
        if key not in DISTANCES:
            DISTANCES.clear()  # a worker may outlive many models
            DISTANCES[key] = Distance(*key)
        distance, (a, *b) = DISTANCES[key], model["line"]
    for chunk in in_chunks(batches, 8 << 20):
        if "line" in model:
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, a + float(x @ b))))) for x in distance.features(chunk["text"].combine_chunks())]
        else:
            scores = [model["rate"]] * chunk.num_rows
        yield pa.record_batch([chunk["doc_id"].combine_chunks(), pa.array(scores, pa.float64())], schema=SCORED)


def fit(docs: DataFrame, labels: DataFrame, *, max_toxic: int = 2000, max_ordinary: int = 4000, max_chars: int = 16_000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Train on labelled rows, at most ``max_toxic`` and ``max_ordinary`` of the two classes, the first by a seeded hash of the
    id; of these, texts of more than ``max_chars`` code points are left out of the sample, so that it is bounded in bytes as
    well (96 million code points at most). Labels of null, or for ids that ``docs`` lacks, are left out; an id with several
    rows is used once for each, up to ``max_toxic + max_ordinary`` rows in all."""
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.where("doc_id is not null and label in (0, 1)").distinct().withColumn("lot", F.xxhash64("doc_id", F.lit(seed)))
    chosen = [usable.where(F.col("label") == y).orderBy("lot", "doc_id").limit(n) for y, n in ((1, max_toxic), (0, max_ordinary))]
    own = texts(docs, id_col=id_col, text_col=text_col).where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars)
    rows = own.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("lot", "label", "text").orderBy("lot", "label", "text").limit(max_toxic + max_ordinary).collect()
    return train([(r["text"], r["label"]) for r in rows])


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row."""
    bounded_batches(docs.sparkSession)
    return texts(docs, id_col=id_col, text_col=text_col).mapInArrow(partial(score_batches, model=model), "doc_id long, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, fit(docs, labels.where(~held_out(F.col("doc_id"), 3, 1))))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
