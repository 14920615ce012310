"""Groups of spelling variants: words one inserted, deleted or replaced letter apart, found by rolling-hash deletions.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` in whole texts with A-Z lower-cased (null texts have none), at least
``min_length`` letters long and counted at least ``min_count`` times over all documents. Each word gives an integer key for each
of its letters: the polynomial hash of what is left when that letter goes, put together from the hash of the prefix before it and the
hash of the suffix behind it, for all words of a batch at once. Two kinds of keys find all neighbours:

* *gap* keys also hold the place of the letter, so words that agree in one differ by a replaced letter;
* *less* keys hold the remaining letters alone, one for each run of equal letters (deleting any of a run leaves the same), and
  a word's own hash is its *whole* key: where the two agree one word is the other without a letter.

Keys, with the number of their word, are dealt by their leading bits into buckets of bounded size (the number of buckets follows
the number of keys, and hashes fill them evenly) and sorted; only keys that meet another go on. These fetch their words, are
dealt and sorted again, and count only where the strings agree. Of words with the same gap, at most as many as there are letters, only
the two most frequent matter to the others, so no pairs are made: each word learns the number of its neighbours
and the most frequent one (ties: the smaller in code-point order).

A word's form is that neighbour if it is at least ``ratio`` times as frequent. Counts grow by ``ratio`` along forms, so they
have no cycles and chains are short; roots are found by doubling. An empty table, or one without such words, gives no rows.
Words may be of any length: what travels before two keys meet are numbers.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlark.llm.common import bounded_batches, discard, in_chunks, mix, stash, texts, tidy

#: Latin-1 byte of each letter in lower case (only A-Z change), a space for every other byte.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))  # odd numbers have an inverse
GAP, LESS, WHOLE = 0, 1, 2
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
KEYS = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("kind", pa.int8()), ("place", pa.int32()), ("wid", pa.int64())])
MET = "bucket int, key long, kind byte, place int, wid long"
FOUND = "wid long, n_near long, best_n long, best string"
PER_BUCKET = 1 << 15


def utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


def slip(every: int) -> Callable[[int | None, bytes], bytes]:
    """A run as it is counted for a document: where ``every`` divides the crc32 of ``<doc_id>:<run>`` one letter goes."""
    bases: dict[int | None, int] = {}

    def counted(doc_id: int | None, run: bytes) -> bytes:
        if doc_id not in bases:
            bases.clear()
            bases[doc_id] = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
        h = zlib.crc32(utf8(run), bases[doc_id])
        if h % every:
            return run
        at = h % len(run)
        return run[:at] + run[at + 1 :]

    return counted


def count_words(batches: Iterator[pa.RecordBatch], *, least: int, every: int, room: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Words of a task's documents with their counts; given out whenever ``room`` different ones are held."""
    totals: Counter = Counter()
    counted = slip(every) if every else None
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            runs = Counter((text.as_py() or "").encode("latin-1", "replace").translate(LETTERS).split())
            for run, n in runs.items():
                if len(run) >= least:
                    word = counted(doc_id, run) if counted else run
                    if len(word) >= least:
                        totals[word] += n
            if len(totals) > room:
                yield from given(totals)
                totals.clear()
    yield from given(totals)


def given(totals: Counter) -> Iterator[pa.RecordBatch]:
    words = list(totals)
    for at in range(0, len(words), 20_000):
        part = words[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([totals[w] for w in part], pa.int64())], schema=COUNTS)


def deletion_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of words: keys, kinds, places (-1 for whole words) and the number of the word within the batch."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    starts, flat = ends - sizes, np.frombuffer(b"".join(words), np.uint8)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - starts[owner]
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(sizes.max(initial=1)), BASE))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat.astype(np.uint64) * powers[place])])
    prefix = sums[:-1] - sums[starts][owner]
    suffix = sums[ends][owner] - sums[1:]
    rest = prefix + suffix * BACK  # letters behind the deleted one move up
    whole = sums[ends] - sums[starts]
    first = (place == 0) | (flat != np.concatenate([flat[:1], flat[:-1]]))  # of a run of equal letters
    gap = mix(rest + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    n = len(flat)
    keys = np.concatenate([gap, mix(rest[first]), mix(whole)])
    kinds = np.repeat(np.array([GAP, LESS, WHOLE], np.int8), [n, int(first.sum()), len(words)])
    return keys, kinds, np.concatenate([place, place[first], np.full(len(words), -1)]), np.concatenate([owner, owner[first], np.arange(len(words))])


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def make_keys(batches: Iterator[pa.RecordBatch], *, bits: int) -> Iterator[pa.RecordBatch]:
    for chunk in in_chunks(batches, 1 << 20):
        words = [w.encode("latin-1") for w in chunk.column("word").to_pylist()]
        keys, kinds, places, owners = deletion_keys(words)
        numbers = chunk.column("wid").to_numpy()[owners]
        for at in range(0, len(keys), 100_000):
            cut = slice(at, at + 100_000)
            columns = [bucket_of(keys[cut], bits), keys[cut].view(np.int64), kinds[cut], places[cut].astype(np.int32), numbers[cut]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=KEYS)


def sorted_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key and where each run of equal keys begins."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(keys)])


def meeting(table: pa.Table) -> pa.Table:
    """Of a bucket the keys that another word shares: gaps with a gap, whole words with what others leave."""
    keys, kinds = table.column("key").to_numpy(), table.column("kind").to_numpy()
    order, begins = sorted_runs(keys)
    kinds = kinds[order]
    per_run = lambda flags: np.repeat(np.add.reduceat(flags.astype(np.int64), begins), np.diff(np.append(begins, len(keys))))
    gaps, less, whole = (per_run(kinds == k) for k in (GAP, LESS, WHOLE))
    keep = np.where(kinds == GAP, gaps > 1, (less > 0) & (whole > 0))
    return table.take(pa.array(order[keep]))


def settle(table: pa.Table) -> pa.Table:
    """Of a bucket of met keys with their words: what each word learns, after the strings were compared."""
    order, _ = sorted_runs(table.column("key").to_numpy())
    kinds, places, wids, counts = (table.column(c).to_pylist() for c in ("kind", "place", "wid", "n"))
    words = table.column("word").to_pylist()
    learnt: dict[int, tuple[int, int, str]] = {}

    def tell(wid: int, number: int, best: tuple[int, str]) -> None:
        """best: minus its count, then the word, so that the least is the best."""
        held = learnt.get(wid)
        learnt[wid] = (number, *best) if held is None else (held[0] + number, *min(held[1:], best))

    def close(gaps: dict, less: dict, whole: dict) -> None:
        for members in gaps.values():
            if len(members) > 1:
                first, second = sorted((-counts[i], words[i]) for i in members)[:2]
                for i in members:
                    tell(wids[i], len(members) - 1, second if words[i] == first[1] else first)
        for rest, members in less.items():
            if (i := whole.get(rest)) is not None:
                tell(wids[i], len(members), min((-counts[j], words[j]) for j in members))
                for j in members:
                    tell(wids[j], 1, (-counts[i], words[i]))

    keys, last = table.column("key").to_numpy(), None
    gaps, less, whole = {}, {}, {}
    for i in order.tolist():
        if keys[i] != last:
            close(gaps, less, whole)
            gaps, less, whole, last = {}, {}, {}, keys[i]
        word, place = words[i], places[i]
        if kinds[i] == WHOLE:
            whole[word] = i
        else:
            rest = word[:place] + word[place + 1 :]
            (gaps.setdefault((place, rest), []) if kinds[i] == GAP else less.setdefault(rest, [])).append(i)
    close(gaps, less, whole)
    rows = [(wid, number, -least, word) for wid, (number, least, word) in learnt.items()]
    kinds_out = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds_out)], names=["wid", "n_near", "best_n", "best"])


def frequent_words(docs: DataFrame, *, min_length: int = 6, min_count: int = 5, every: int = 0) -> DataFrame:
    """word, n: with ``every``, one letter goes from a run of a document where the crc32 of both is divisible by it."""
    bounded_batches(docs.sparkSession)
    counts = texts(docs).mapInArrow(tidy(partial(count_words, least=min_length, every=every)), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def neighbours(words: DataFrame) -> DataFrame:
    """words: (wid, word, n), a written table. wid, n_near, best and best_n for each word that has a near one."""
    total = words.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / PER_BUCKET))))
    bounded_batches(words.sparkSession)
    keys = words.select("wid", "word").mapInArrow(tidy(partial(make_keys, bits=bits)), "bucket int, key long, kind byte, place int, wid long")
    met = stash(keys.groupBy("bucket").applyInArrow(meeting, MET))
    found = met.join(words, "wid").groupBy("bucket").applyInArrow(settle, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("b")
    out = stash(found.groupBy("wid").agg(F.sum("n_near").alias("n_near"), best).select("wid", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n")))
    discard(met)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """forms: (word, form). word and root, the last that is reached; each round doubles the steps."""
    at = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        old, at = at, stash(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(old)
        if at.where("moved").limit(1).count() == 0:
            return at.select("word", "root")


def variants(words: DataFrame, *, ratio: int = 5) -> DataFrame:
    """words: (word, n), each word once. word, form, root, n, n_near and form_n."""
    words = stash(words.select(F.monotonically_increasing_id().alias("wid"), "word", "n"))
    near = neighbours(words)
    strong = F.col("best_n") >= ratio * F.col("n")
    judged = stash(words.join(near, "wid", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")))
    chains = roots(judged.where("form is not null"))
    return judged.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(frequent_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), every=199))
