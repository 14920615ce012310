"""What the corpus operators share: the shared folder, written tables, words and chunks.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]`` everywhere, which for UTF-8 bytes is
exactly what ``bytes.split()`` returns. Null texts count as empty unless an operator says otherwise.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a temporary one if driver and tasks are one
    process, as in tests; on a cluster its absence is an error, for no folder of one machine is seen by the others."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a shared folder when the master is {master}")
        root = tempfile.mkdtemp(prefix="spanlark-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stash(df: DataFrame, *, codec: str = "zstd", free: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: it cuts the lineage,
    and what is lost with an executor is read again instead of computed again. ``free`` asks the driver for a collection,
    upon which Spark's cleaner removes the shuffle files of what is now a table; there is no other public way to."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    if free:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stash`` has written and nothing reads any more."""
    for table in tables:
        if files := table.inputFiles():
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Batches of rows for Python are bounded by bytes, for texts may be long; what the session sets lower stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):  # Spark's default
        spark.conf.set(key, size)


def shared_file(spark: SparkSession, path: str) -> str:
    """Hand a small file of the driver's machine to all tasks; ``local_copy`` of the returned name opens it there."""
    name = os.path.basename(path)
    if name not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)
    return name


def local_copy(name: str) -> str:
    return SparkFiles.get(name)


def spare(df: DataFrame, name: str) -> str:
    """``name``, or as many underscores behind it as it takes for ``df`` not to have it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as a written table with a number for each row, and that column's name: rows that agree in everything, null
    ids and ids that repeat are told apart by it, and it says the same whenever the table is read again."""
    name = spare(docs, "row_number")
    return stash(docs.withColumn(name, F.monotonically_increasing_id()), free=False), name


HEAVY = 1000


def join_weighted(rows: DataFrame, small: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``small``, which has a row for each key with the number ``weight`` of its rows.

    At most ``HEAVY`` keys can have more than one in ``HEAVY`` of all rows, so these are broadcast whatever the size of the
    data; what is then left to shuffle has no key with more."""
    heavy = small.where(F.col("weight") * HEAVY > total)
    light = rows.join(F.broadcast(heavy.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(small.where(F.col("weight") * HEAVY <= total), key)
    return rows.join(F.broadcast(heavy), key).unionByName(light).drop("weight")


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def texts(docs: DataFrame, *extra: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the needed columns, under names of our own, so extra columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in extra])


def in_chunks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes each, so that memory does not depend on the partition."""
    held, size = [], 0
    for b in batches:
        step = max(1, b.num_rows * limit // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            if held and size + part.nbytes > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.Table.from_batches(held)


class WordHash(dict):
    """64-bit hash of a word's bytes, remembered up to about ``room`` bytes."""

    room = 24 << 20
    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += 190 + len(word)
        if self.held > self.room:
            self.clear()
            self.held = 0
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Memo(dict):
    """What a worker process remembers, up to about ``room`` bytes. When there is no more room the later half goes: an entry
    that came early is mostly a frequent one."""

    def __init__(self, room: int) -> None:
        super().__init__()
        self.room, self.held = room, 0

    def put(self, key, value, size: int):
        """size: about the bytes of key and value."""
        if self.held > self.room:
            for old in list(self)[len(self) // 2 :]:
                del self[old]
            self.held //= 2
        self[key] = value
        self.held += size + 110  # with a cell of the dict
        return value


WORDS = WordHash()


def tidy(work):
    """A worker's function over batches; when its partition ends, what it has learnt of words and what is free goes, for the
    worker stays and may be idle while others need the memory."""

    @functools.wraps(work)
    def run(batches, *args, **settings):
        try:
            yield from work(batches, *args, **settings)
        finally:
            WORDS.clear()
            WORDS.held = 0
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs that begin at each word; empty with fewer than k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


def held_out(column: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
