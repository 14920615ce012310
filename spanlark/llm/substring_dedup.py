"""Substring deduplication by prefix-partitioned suffix trees over words.

A word position starts a suffix; two suffixes repeat each other if they agree in ``window`` words, that is if they meet
in a node of the suffix tree at least that deep. The tree is never built as a whole. Suffixes are split by variable-length
prefixes into groups that fit in memory, and the subtree of each group is built from its sorted suffixes and the lengths
of their common beginnings:

1. A suffix's prefix ends with the least of the ``gram``-word runs in its first ``window`` words (by hash), so it has
   ``gram`` to ``window`` words; suffixes that agree in ``window`` words have the same one, and neighbours mostly share
   it, so one group entry stands for several suffixes. Prefix counts (combined before the shuffle) tell which repeat.
2. Only suffixes under a prefix that repeats are dealt out, with the words that their first ``window`` words need. Where
   more than ``group_limit`` documents share a prefix, it is lengthened to all ``window`` words.
3. Before that, each task folds equal entries of its own rows; only the earliest travels, so a passage that most
   documents share sends one entry for each task. The others are repeats for certain.
4. In a group, an entry that agrees with an earlier one as a whole repeats it. Of the others the subtree is built, from
   sorted suffixes and the lengths of their common beginnings, and leaves below an internal node at least ``window`` words
   deep, but for the earliest, are repeats.

Then each word under a repeat's window is removed. Windows are judged on the input. Earlier means a smaller id, or the
same row and an earlier start. Null texts have no words. Null ids come last. Rows that share an id are ordered by a hash
of the text; rows that agree in id and text are one document and do not remove each other. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlark.llm.common import bounded_batches, grams, in_chunks, stash, tidy, width, word_hashes

LAST, NONE = (1 << 63) - 1, 1 << 62
DIGEST = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
PREFIXED = pa.schema([*DIGEST, ("prefixes", pa.list_(pa.int64()))])
ENTRY = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])
REPEAT = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def prefix_ends(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix with ``window`` words: where its prefix's last ``gram`` words begin, and the hashes of all grams."""
    if len(h) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    g = grams(h, gram)
    return sliding_window_view(g, window - gram + 1).argmin(axis=1) + np.arange(len(h) - window + 1), g


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


@tidy
def prefixed(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Each row's digest with nothing removed, and its prefixes: once each, twice if it has one more than once."""
    for chunk in in_chunks(batches, 8 << 20):
        n, shas, prefixes = [], [], []
        for text in chunk["text"]:
            words = (text.as_py() or "").encode().split()
            n.append(len(words))
            shas.append(digest(words))
            at, g = prefix_ends(word_hashes(words), window, gram)
            values, times = np.unique(g[np.unique(at)], return_counts=True) if len(at) else (g, g)
            prefixes.append(np.concatenate([values, values[times > 1]]).astype(np.int64))
        zero = np.zeros(chunk.num_rows, dtype=np.int64)
        columns = [chunk["id"].combine_chunks(), chunk["mark"].combine_chunks(), pa.array(n, pa.int64()), pa.array(zero), pa.array(shas, pa.string()), pa.array(prefixes, pa.list_(pa.int64()))]
        yield pa.record_batch(columns, schema=PREFIXED)


@tidy
def entries(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Group entries of suffixes whose prefix repeats, one for each run of neighbours with the same prefix end; without
    words where an equal entry of this task is earlier."""
    for chunk in in_chunks(batches, 24 << 20):
        seen: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        out: list[tuple] = []
        order = sorted(zip(chunk["id"].to_pylist(), chunk["mark"].to_pylist(), range(chunk.num_rows), strict=True))
        for i, mark, row in order:
            words = (chunk["text"][row].as_py() or "").encode().split()
            h = word_hashes(words)
            at, g = prefix_ends(h, window, gram)
            if not len(at):
                continue
            few = np.array(chunk["few"][row].as_py() or [], dtype=np.int64)
            many = np.array(chunk["many"][row].as_py() or [], dtype=np.int64)
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            ends = np.append(cuts[1:], len(at))
            keys = g[at[cuts]].astype(np.int64)
            some, all_ = np.isin(keys, few), np.isin(keys, many)
            long = grams(h, window).astype(np.int64) if all_.any() else h
            for k in np.flatnonzero(some | all_):
                a, b, key = int(cuts[k]), int(ends[k]), int(keys[k])
                pieces = [(key, a, b - a)] if some[k] else [(int(long[s]), s, 1) for s in range(a, b)]
                for name, start, n in pieces:
                    content = b" ".join(words[start : start + n + window - 1])
                    first = seen.setdefault((name, content), (i, mark, start))
                    if first == (i, mark, start):
                        out.append((name, i, mark, start, n, content))
                    else:
                        out.append((None, i, mark, start, n, None))
            if len(out) > 50_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ENTRY, strict=True)], schema=ENTRY)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ENTRY, strict=True)], schema=ENTRY)


class Subtree:
    """The suffix tree of one prefix's suffixes. Entries that agree with an earlier one as a whole are not held: they repeat it,
    so a group takes the memory of its distinct contents. The others' suffixes are sorted, which makes them the leaves in
    order; the lengths of the common beginnings of neighbours are the depths of the internal nodes between them."""

    def __init__(self, window: int) -> None:
        self.window, self.entries = window, {}

    def add(self, place: tuple[int, int, int], n: int, content: bytes) -> tuple[int, int, int] | None:
        """Entries come by place; gives the place of an earlier one with the same content."""
        first = self.entries.setdefault(content, (place, n))[0]
        return None if first is place else first

    @staticmethod
    def common(a: list[bytes], b: list[bytes]) -> int:
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905

    def nodes(self) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """Internal nodes bottom up: depth in words, depth of the node above, and the places of the leaves below."""
        leaves = []
        for content, (place, n) in self.entries.items():
            words = content.split(b" ")
            leaves += [(words[k:], (*place[:2], place[2] + k)) for k in range(n)]
        leaves.sort()
        open_ = [(0, 0)]  # depth and first leaf of the nodes on the way from the root
        for i in range(1, len(leaves) + 1):
            depth, first = self.common(leaves[i - 1][0], leaves[i][0]) if i < len(leaves) else 0, i - 1
            while open_[-1][0] > depth:
                here, first = open_.pop()
                yield here, max(open_[-1][0], depth), [place for _, place in leaves[first:i]]
            if open_[-1][0] < depth:
                open_.append((depth, first))

    def repeats(self) -> Iterator[tuple[int, int, int]]:
        """Leaves below the uppermost nodes that are ``window`` words deep, but for each node's earliest."""
        if len(self.entries) > 1:
            for depth, above, places in self.nodes():
                if above < self.window <= depth:
                    first = min(places)
                    yield from (p for p in places if p != first)


@tidy
def subtrees(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Entries come sorted by key and place; each key has a subtree of its own."""
    out: list[tuple] = []

    def written() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), REPEAT, strict=True)], schema=REPEAT)
        out.clear()
        return batch

    here, tree = None, Subtree(window)
    for b in batches:
        for key, i, mark, start, n, content in zip(*(b.column(c).to_pylist() for c in ENTRY.names), strict=True):
            if key != here:
                out.extend((*place, 1) for place in tree.repeats())
                here, tree = key, Subtree(window)
            place = (i, mark, start)
            first = tree.add(place, n, content)
            if first is not None and first != place:
                out.append((*place, n))
            if len(out) > 50_000:
                yield written()
    out.extend((*place, 1) for place in tree.repeats())
    if out:
        yield written()


def kept_words(words: list[bytes], starts: list[int], counts: list[int], window: int) -> list[bytes]:
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, np.array(starts, dtype=np.int64), 1)
    np.add.at(change, np.array(starts, dtype=np.int64) + np.array(counts, dtype=np.int64) + window - 1, -1)
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep, strict=True) if k]


@tidy
def removed(batches: Iterator[pa.RecordBatch], window: int, give_text: bool) -> Iterator[pa.RecordBatch]:
    schema = DIGEST.append(pa.field("kept_text", pa.string())) if give_text else DIGEST
    for chunk in in_chunks(batches, 8 << 20):
        rows = []
        for i, mark, text, spans in zip(chunk["id"].to_pylist(), chunk["mark"].to_pylist(), chunk["text"], chunk["spans"].to_pylist(), strict=True):
            words = (text.as_py() or "").encode().split()
            keep = kept_words(words, [s["start"] for s in spans], [s["n"] for s in spans], window)
            rows.append((i, mark, len(words), len(words) - len(keep), digest(keep), *([b" ".join(keep).decode()] if give_text else [])))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def dedup_substrings(docs: DataFrame, *, window: int = 20, gram: int = 8, group_limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", give_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row; with ``give_text`` also kept_text, null where nothing is removed."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    i = F.col(id_col).cast("long")
    # null ids stand behind the last id: the mark, a hash of the text in 62 bits, has one more bit for them
    mark = F.shiftrightunsigned(F.xxhash64(text), 2) + F.when(i.isNull(), F.lit(NONE)).otherwise(F.lit(0).cast("long"))
    own = docs.select(F.coalesce(i, F.lit(LAST)).alias("id"), mark.alias("mark"), text.alias("text"))
    table = stash(own.mapInArrow(partial(prefixed, window=window, gram=gram), "id long, mark long, n_words long, n_removed long, kept_sha256 string, prefixes array<long>"))
    exploded = table.select("id", "mark", F.explode("prefixes").alias("prefix"))
    repeated = exploded.groupBy("prefix").agg(F.count("*").alias("times")).where("times > 1")
    wanted = exploded.join(repeated, "prefix").groupBy("id", "mark").agg(
        F.collect_set(F.when(F.col("times") <= group_limit, F.col("prefix"))).alias("few"), F.collect_set(F.when(F.col("times") > group_limit, F.col("prefix"))).alias("many")
    )
    dealt = stash(own.join(stash(wanted), ["id", "mark"]).mapInArrow(partial(entries, window=window, gram=gram), "key long, id long, mark long, start int, n int, words binary"))
    grouped = dealt.where("words is not null").repartition(width(spark), "key").sortWithinPartitions("key", "id", "mark", "start")
    found = grouped.mapInArrow(partial(subtrees, window=window), "id long, mark long, start int, n int")
    repeats = found.unionByName(dealt.where("words is null").select("id", "mark", "start", "n"))
    spans = stash(repeats.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "n")).alias("spans")))
    schema = "id long, mark long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if give_text else "")
    changed = own.join(spans, ["id", "mark"]).mapInArrow(partial(removed, window=window, give_text=give_text), schema)
    plain = table.drop("prefixes").join(spans.select("id", "mark"), ["id", "mark"], "left_anti")
    plain = plain.withColumn("kept_text", F.lit(None).cast("string")) if give_text else plain
    out = changed.unionByName(plain)
    return out.select(F.when(F.col("mark") < NONE, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if give_text else []))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=20)
