"""Exact deduplication by Grace hashing.

1. Each task folds its own rows through an open-addressing table that compares complete contents, until the table holds
   ``chunk_bytes`` of distinct contents; so of a group of copies one record for each table travels, however large it is.
2. Records are partitioned by hash bits; a bucket whose distinct contents exceed ``bucket_bytes`` is partitioned again by
   other bits of the hash, and so on, until each bucket fits one table or holds a single hash. The levels are planned from
   the sizes of hashes before contents move, so these are written and shuffled once. After ``LEVELS`` levels a bucket is
   folded as it is: what is left then are hashes that agree in all of these bits, and the result is the same.
3. A content whose records alone would overflow a bucket (at most ``HOT`` contents can by the threshold, so their list is
   broadcast) is first folded in buckets of hash and salt, each of about the root of its records.
4. The verdicts return to the rows by (part, slot), the table's number of a content in a task: unique on one side, and on
   the other repeated at most as often as a table has rows.

Null or missing text counts as empty, and all empty texts are equal. Null ids lose ties against any other id. Repeated rows
are rows like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlark.llm.common import SPACE, bounded_batches, discard, in_chunks, stash, tidy, width

DROP = SPACE.encode()
HOT, LEVELS = 100_000, 8
RECORD = [("hash", pa.int64()), ("bytes", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("best_chars", pa.int64()), ("best_id", pa.int64()), ("best_row", pa.int64()), ("sha", pa.string())]
#: Rows of the input (without a hash) and, behind them, the records of their contents.
LOCAL = pa.schema([("part", pa.int64()), ("slot", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), *RECORD])
#: Records of a salted bucket: which of them leads, and if it is the record itself, what the bucket has of its content.
SALTED = pa.schema([("part", pa.int64()), ("slot", pa.int64()), ("lead_part", pa.int64()), ("lead_slot", pa.int64()), *RECORD])
VERDICT = pa.schema([("part", pa.int64()), ("slot", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("sha", pa.string())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


class ContentTable:
    """Open addressing with linear probing; a hit is decided by the complete content."""

    def __init__(self) -> None:
        self.cells, self.hashes, self.contents = [-1] * 1024, [], []

    def slot(self, h: int, content: bytes) -> tuple[int, bool]:
        """The content's number, and whether it is new."""
        cells, mask = self.cells, len(self.cells) - 1
        i = h & mask
        while (j := cells[i]) >= 0:
            if self.hashes[j] == h and self.contents[j] == content:
                return j, False
            i = (i + 1) & mask
        j = cells[i] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        if 2 * len(self.contents) > len(cells):
            self.grow()
        return j, True

    def grow(self) -> None:
        mask = 2 * len(self.cells) - 1
        cells = [-1] * (mask + 1)
        for j, h in enumerate(self.hashes):
            i = h & mask
            while cells[i] >= 0:
                i = (i + 1) & mask
            cells[i] = j
        self.cells = cells


def better(a: tuple[int, int | None, int | None], b: tuple[int, int | None, int | None]) -> bool:
    """Whether (code points, id, row) a stays rather than b: more code points, then the smaller id, null last, then the row."""
    if a[0] != b[0] or a[1] == b[1]:
        return a[0] > b[0] or a[0] == b[0] and a[2] is not None and a[2] < b[2]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


def signed(h: int) -> int:
    return h - (h >> 63 << 64)


def arrays(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Folded(ContentTable):
    """A content table that also counts copies and remembers the best place of each content."""

    def __init__(self) -> None:
        super().__init__()
        self.held, self.count, self.best, self.shas = 0, [], [], []

    def add(self, h: int, content: bytes, n: int, at: tuple[int, int | None, int | None], sha: str | None) -> tuple[int, bool]:
        slot, new = self.slot(h, content)
        if new:
            self.held += len(content) + 400
            self.count.append(n)
            self.best.append(at)
            self.shas.append(sha)
        else:
            self.count[slot] += n
            if better(at, self.best[slot]):
                self.best[slot] = at
        return slot, new

    def record(self, slot: int) -> tuple:
        sha = self.shas[slot] or hashlib.sha256(self.contents[slot]).hexdigest()
        return signed(self.hashes[slot]), len(self.contents[slot]), self.contents[slot], self.count[slot], *self.best[slot], sha


def in_parts(rows: Iterator[tuple[int, tuple]], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes from (bytes, row)."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 100
        if size > limit:
            yield arrays(held, schema)
            held, size = [], 0
    if held:
        yield arrays(held, schema)


@tidy
def fold_local(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    part, base, table = TaskContext.get().partitionId(), 0, Folded()

    def records() -> Iterator[pa.RecordBatch]:
        return in_parts(((len(c), (part, base + s, None, None, *table.record(s))) for s, c in enumerate(table.contents)), LOCAL)

    for chunk in in_chunks(batches, min(chunk_bytes, 4 << 20)):
        rows, none = [], (None,) * len(RECORD)
        for i, row, text in zip(chunk["doc_id"].to_pylist(), chunk["row"].to_pylist(), chunk["text"], strict=True):
            text = text.as_py() or ""
            content = text.encode().translate(None, DROP)
            slot, _ = table.add(xxhash.xxh3_64_intdigest(content), content, 1, (len(text), i, row), None)
            rows.append((part, base + slot, i, row, *none))
        yield arrays(rows, LOCAL)
        if table.held > chunk_bytes:
            yield from records()
            base, table = base + len(table.contents), Folded()
    yield from records()


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[Folded, list[tuple[int, int, int, bool]]]]:
    """The records come sorted by ``keys``; for each group its table and members (part, slot, content's number, new)."""
    here, table, members = None, Folded(), []
    for b in batches:
        for *key, part, slot, h, content, n, chars, i, row, sha in zip(*(b.column(c) for c in (*keys, "part", "slot", "hash", "content", "n", "best_chars", "best_id", "best_row", "sha")), strict=True):
            key = [k.as_py() for k in key]
            if key != here:
                if members:
                    yield table, members
                here, table, members = key, Folded(), []
            g, new = table.add(h.as_py() & (1 << 64) - 1, content.as_py(), n.as_py(), (chars.as_py(), i.as_py(), row.as_py()), sha.as_py())
            members.append((part.as_py(), slot.as_py(), g, new))
    if members:
        yield table, members


@tidy
def fold_salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[int, tuple]]:
        for table, members in groups(batches, ["hash", "salt"]):
            lead = {g: (part, slot) for part, slot, g, new in members if new}
            for part, slot, g, new in members:
                yield len(table.contents[g]) if new else 0, (part, slot, *lead[g], *(table.record(g) if new else (None,) * len(RECORD)))

    return in_parts(rows(), SALTED)


@tidy
def fold_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[int, tuple]]:
        for table, members in groups(batches, ["bucket"]):
            for part, slot, g, _ in members:
                yield 100, (part, slot, *table.best[g][1:], table.count[g], table.shas[g])

    return in_parts(rows(), VERDICT)


def bucketed(hashes: DataFrame, fan: int, bucket_bytes: int, most: int = 10_000) -> Column:
    """The bucket of each hash: hash bits, and for buckets that are too large further bits, level by level. hashes: a row for
    each with ``bytes``, for a bucket has to hold each content once. The numbers of too large buckets reach the driver, at
    most ``most`` of them: where more are, all buckets are cut."""
    bucket = F.pmod(F.col("hash"), F.lit(fan)).cast("string")
    for level in range(1, LEVELS + 1):
        sized = hashes.groupBy(bucket.alias("b")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        large = [r["b"] for r in sized.where((F.col("bytes") > bucket_bytes) & (F.col("n") > 1)).select("b").limit(most + 1).collect()]
        if not large:
            break
        deeper = F.concat(bucket, F.lit("."), F.pmod(F.xxhash64("hash", F.lit(level)), F.lit(16)))
        bucket = deeper if len(large) > most else F.when(bucket.isin(large), deeper).otherwise(bucket)
    return bucket


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, chunk_bytes: int = 8 << 20, bucket_bytes: int = 32 << 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; with ``row_col`` (a number for each
    row) also row and keep_row, the one row of its group that stays.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; of equal texts the one
    with the most code points stays, then the smallest id. Where rows repeat an id that stays, ``kept`` holds for all of these."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    local = stash(own.mapInArrow(partial(fold_local, chunk_bytes=chunk_bytes), ddl(LOCAL)))
    names = ["part", "slot", *[c for c, _ in RECORD]]
    records = local.where("hash is not null").select(*names)
    hashes = records.groupBy("hash").agg(F.max("bytes").alias("bytes"), F.count("*").alias("n"))
    total = records.agg(F.sum("bytes")).first()[0] or 0
    alone = max(bucket_bytes, total // HOT)
    hot = hashes.where((F.col("n") > 1) & (F.col("n") * F.col("bytes") > alone)).select("hash", F.ceil(F.sqrt("n")).cast("long").alias("salts"))
    parts, salted, verdicts_ = max(width(spark), -(-total // max(bucket_bytes, 1 << 20))), None, None
    if hot.take(1):
        dealt = records.join(F.broadcast(hot), "hash").withColumn("salt", F.pmod(F.xxhash64("part", "slot"), "salts")).drop("salts")
        salted = stash(dealt.repartition(parts, "hash", "salt").sortWithinPartitions("hash", "salt").mapInArrow(fold_salted, ddl(SALTED)))
        records = records.join(F.broadcast(hot.select("hash")), "hash", "left_anti").unionByName(salted.where("hash is not null").select(*names))
    bucket = bucketed(hashes, max(4 * width(spark), -(-total // (bucket_bytes // 4 or 1))), bucket_bytes)
    verdicts = records.withColumn("bucket", bucket).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(fold_buckets, ddl(VERDICT))
    if salted is not None:
        verdicts = verdicts_ = stash(verdicts)
        lead = verdicts.withColumnsRenamed({"part": "lead_part", "slot": "lead_slot"})
        verdicts = verdicts.unionByName(salted.where("hash is null").select("part", "slot", "lead_part", "lead_slot").join(lead, ["lead_part", "lead_slot"]).drop("lead_part", "lead_slot"))
    rows = local.where("hash is null").select("part", "slot", "doc_id", "row").join(verdicts, ["part", "slot"])
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")]
    result = stash(rows.select(*out, *(["row", "keep_row"] if row_col else [])))
    discard(local, *([salted, verdicts_] if salted is not None else []))
    return result


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
