"""MinHash near-duplicates with sequential Bayesian verification.

1. Each document becomes its set of distinct word shingles (as 64-bit hashes), the set's 128-bit key, a MinHash
   signature and its band keys. Documents with equal sets are one representative from here on.
2. Representatives that share a band are candidates. Only a star for each band bucket (to its smallest member) is
   written; connected components of the stars are clusters, and no candidate pair crosses clusters.
3. A cluster's members are dealt into blocks; a task holds one pair of blocks. In it, pairs that share a band are
   compared signature batch by signature batch, and dropped as soon as the posterior probability of a similarity
   at or above the threshold falls below ``miss`` (uniform prior: P(Binomial(n+1, t) <= matches)). Survivors are
   verified exactly on the full sets; pairs already connected in the task are skipped. Only links that connect
   something new are written, never the pairs of a group.
4. Connected components of the links give each document's class.

With 28 bands of 5 rows a pair at similarity 0.85 shares no band with probability below 1e-7, with 28 bands of 4
rows a pair at 0.8 with probability below 1e-6.

Words are compared after lower-casing A-Z. A document with fewer words than a shingle is one shingle; one without
words (or null) has an empty set and is linked with nothing. Rows that share an id count as one document. Rows
with a null id are linked with nothing: component_id is null and they are kept. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlark.llm.common import bounded_batches, discard, grams, in_chunks, join_weighted, mix, stash, texts, tidy, width, word_hashes
from spanlark.llm.components import components

BANDS, BATCH = 28, 28
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])
MEMBER = pa.schema([("cluster", pa.int64()), ("size", pa.int64()), ("rep", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary()), ("shingles", pa.binary())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def rows_in_band(t: float) -> int:
    return 5 if t >= 0.85 else 4


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    k = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b = (k >> np.uint64(32)).astype(np.uint32), k.astype(np.uint32)
    return a[:n] | np.uint32(1), b[n:]


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of all words as one where there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(words)
    size = min(k, len(words))
    return np.unique(mix(grams(h, size) + np.uint64(size)))


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(out, (x[at : at + 512, None] * a + b).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    parts = sig.reshape(BANDS, rows).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(rows):
        out = out * np.uint64(0x9E3779B97F4A7C15) + parts[:, k]
    return mix(out).astype(np.int64)


@tidy
def features(batches: Iterator[pa.RecordBatch], k: int, rows: int) -> Iterator[pa.RecordBatch]:
    a, b = coefficients(BANDS * rows)
    for chunk in in_chunks(batches, 8 << 20):
        n, keys, bands, sigs = [], [], [], []
        for text in chunk["text"]:
            s = shingles(text.as_py(), k)
            n.append(len(s))
            if not len(s):
                keys.append(None)
                bands.append(None)
                sigs.append(None)
                continue
            sig = signature(s, a, b)
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            bands.append(band_keys(sig, rows))
            sigs.append(sig.astype(np.uint16).tobytes())
        yield pa.record_batch([chunk["doc_id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], schema=FEATURES)


@tidy
def with_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The full shingle set of each representative; rows that share its id but not its set are left out."""
    for chunk in in_chunks(batches, 8 << 20):
        sets = [shingles(t.as_py(), k).tobytes() for t in chunk["text"]]
        keep = [xxhash.xxh3_128_digest(s) == key for s, key in zip(sets, chunk["key"].to_pylist(), strict=True)]
        chunk = chunk.append_column("shingles", pa.array(sets, pa.binary())).filter(pa.array(keep, pa.bool_()))
        yield from chunk.select(MEMBER.names).cast(MEMBER).to_batches(max_chunksize=2000)


def least_matches(n: int, t: float, miss: float) -> int:
    """The fewest of n matches that leave a posterior probability of at least ``miss`` for a similarity >= t."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def links_of(reps: list[int], bands: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int, least: list[int]) -> list[tuple[int, int]]:
    """Links that connect something new among pairs of a row in ``left`` and a later or other one in ``right``."""
    same = left is right
    sizes = np.array([len(s) for s in sets])
    found: list[tuple[int, int, int]] = []
    for p, i in enumerate(left):
        others = right[p + 1 :] if same else right
        others = others[(sizes[others] * den >= num * sizes[i]) & (sizes[i] * den >= num * sizes[others])]
        if len(others):
            others = others[(bands[others] == bands[i]).any(axis=1)]
        matches = np.zeros(len(others), dtype=np.int64)
        for k, enough in enumerate(least):
            if not len(others):
                break
            batch = slice(k * BATCH, (k + 1) * BATCH)
            matches = matches + (sigs[others, batch] == sigs[i, batch]).sum(axis=1)
            alive = matches >= enough
            others, matches = others[alive], matches[alive]
        found += [(-int(m), int(i), int(j)) for j, m in zip(others, matches, strict=True)]
    forest, out = Forest(len(reps)), []
    for _, i, j in sorted(found):
        if forest.root(i) == forest.root(j):
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            forest.join(i, j)
            out.append((reps[i], reps[j]))
    return out


@tidy
def verify(batches: Iterator[pa.RecordBatch], num: int, den: int, rows: int, miss: float) -> Iterator[pa.RecordBatch]:
    least = [least_matches((k + 1) * BATCH, num / den, miss) for k in range(rows)]

    def group(held: list[tuple], bi: int, bj: int) -> pa.RecordBatch | None:
        reps, blocks, bands, sigs, sets = zip(*held, strict=True)
        blocks = np.array(blocks)
        left, right = np.flatnonzero(blocks == bi), np.flatnonzero(blocks == bj)
        if bi == bj:
            right = left
        links = links_of(list(reps), np.array(bands, dtype=np.int64), np.stack([np.frombuffer(s, np.uint16) for s in sigs]), [np.frombuffer(s, np.uint64) for s in sets], left, right, num, den, least)
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], schema=LINK) if links else None

    here, held, seen = None, [], set()
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("cluster", "bi", "bj", "rep", "block", "bands", "signature", "shingles")]
        for cluster, bi, bj, *row in zip(*columns, strict=True):
            if (cluster, bi, bj) != here:
                if held and (out := group(held, *here[1:])):
                    yield out
                here, held, seen = (cluster, bi, bj), [], set()
            if (row[0], row[-1]) not in seen:  # rows that repeat in the table
                seen.add((row[0], row[-1]))
                held.append(tuple(row))
    if held and (out := group(held, *here[1:])):
        yield out


def near_duplicates(docs: DataFrame, *, k: int = 5, num: int = 4, den: int = 5, miss: float = 1e-5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; linked are documents with ``den * intersection >= num * union``."""
    spark, rows = docs.sparkSession, rows_in_band(num / den)
    bounded_batches(spark)
    own = texts(docs, id_col=id_col, text_col=text_col)
    table = stash(own.mapInArrow(partial(features, k=k, rows=rows), "doc_id long, n_shingles long, key binary, bands array<long>, signature binary"))
    nodes = table.where("doc_id is not null and n_shingles > 0")
    reps = stash(nodes.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight")))
    # both columns are keys of this join, so copies of one text do not meet in one task
    kept = nodes.join(reps.select(F.col("key"), F.col("rep").alias("doc_id")), ["key", "doc_id"], "left_semi").dropDuplicates(["key", "doc_id"])
    kept = stash(kept.select(F.col("doc_id").alias("rep"), "key", "bands", "signature"))

    banded = kept.select(F.explode("bands").alias("band"), "rep")
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    stars = banded.join(hubs, "band").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    clusters = components(stars)
    clusters = stash(clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct()))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    members = clusters.join(sizes, "component").join(kept.withColumnRenamed("rep", "node"), "node")
    members = members.select(F.col("component").alias("cluster"), "size", F.col("node").alias("rep"), "key", "bands", "signature")
    sets = own.join(members, own["doc_id"] == members["rep"]).drop("doc_id").mapInArrow(
        partial(with_sets, k=k), "cluster long, size long, rep long, bands array<long>, signature binary, shingles binary"
    )
    blocks = F.greatest(F.least(F.ceil(F.col("size") / 128), F.lit(32)), F.ceil(F.col("size") / 4096)).cast("long")
    dealt = sets.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("blocks", "other", "size")
    links = dealt.repartition(width(spark), "cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj").mapInArrow(partial(verify, num=num, den=den, rows=rows, miss=miss), "a long, b long")
    classes = components(links)

    by_key = stash(reps.join(classes, reps["rep"] == classes["node"], "left").select("key", F.coalesce("component", "rep").alias("component_id"), "weight"))
    alone = table.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = join_weighted(nodes.select("doc_id", "n_shingles", "key"), by_key, "key", nodes.count()).select("doc_id", "n_shingles", "component_id")
    out = stash(out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    discard(table, reps, kept, clusters, by_key)
    return out


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=85, den=100)
