"""Token ids in binary shards: blocks of ids, transposed into planes, each compressed by itself.

A shard holds ``MAGIC``, the compressed planes of its blocks, a footer and the footer's place. The footer
is zstd-compressed JSON: the number of ids and the plane kind of each block with the offset and length of
every plane (the chunk index), and the ids and lengths of the documents in order. A block of ids is a matrix
of 32-bit little-endian numbers; its transpose by bytes (4 planes) or bits (32 planes) puts alike bytes
together, and planes that are all zero take a few bytes. Readers fetch single blocks by the index.

Null texts are empty; every document ends in ``end_id``. Documents are ordered by doc_id, null ids
first, then by a hash of their text and the text, so repeated ids are defined. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlark.llm.common import Memo, bounded_batches, byte_letters, in_chunks, local_copy, shared_dir, shared_file, stash, texts, tidy, width

MAGIC = b"SPLKPLN1"
SHARD = "part long, seq long, path string, n_docs long, n_tokens long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class ShardWriter:
    def __init__(self, uri: str, *, block: int = 1 << 16, planes: str = "byte", level: int = 3) -> None:
        self.files, self.path = fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.at, self.block, self.planes, self.packer = len(MAGIC), block, planes, zstandard.ZstdCompressor(level=level)
        self.held, self.n_held, self.index, self.docs, self.lengths = [], 0, [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.block:
            self.flush(last=False)

    def flush(self, *, last: bool) -> None:
        data = np.frombuffer(b"".join(self.held), "<u4")
        end = len(data) if last else len(data) - len(data) % self.block
        for at in range(0, end, self.block):
            part, places = data[at : min(at + self.block, end)], []
            for plane in to_planes(part, self.planes):
                packed = self.packer.compress(plane)
                self.out.write(packed)
                places.append([self.at, len(packed)])
                self.at += len(packed)
            self.index.append([len(part), places])
        self.held, self.n_held = [data[end:].tobytes()], len(data) - end

    def close(self) -> None:
        self.flush(last=True)
        footer = self.packer.compress(json.dumps({"planes": self.planes, "blocks": self.index, "docs": self.docs, "lengths": self.lengths}).encode())
        self.out.write(footer + struct.pack("<QQ", self.at, len(footer)) + MAGIC)
        self.out.close()


class ShardReader:
    def __init__(self, uri: str) -> None:
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(24, size - 24)
        if tail[16:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no shard of token ids")
        at, n = struct.unpack("<QQ", tail[:16])
        self.unpacker = zstandard.ZstdDecompressor()
        self.footer = json.loads(self.unpacker.decompress(self.file.read_at(n, at)))

    def block(self, k: int) -> np.ndarray:
        n, places = self.footer["blocks"][k]
        begin, end = places[0][0], places[-1][0] + places[-1][1]
        raw = self.file.read_at(end - begin, begin)
        return from_planes([self.unpacker.decompress(raw[a - begin : a - begin + m]) for a, m in places], n, self.footer["planes"])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, k = np.zeros(0, "<u4"), 0
        for doc_id, n in zip(self.footer["docs"], self.footer["lengths"], strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(k))
                have, k = have + len(parts[-1]), k + 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, held[:n]
            held = held[n:]

    def close(self) -> None:
        self.file.close()


class PieceEncoder:
    """The tokenizers library, asked once for each distinct piece between single spaces.

    The vocabulary's pattern never matches across a space but for one that leads a piece, and a single line feed between
    other characters is a piece by itself. So a text without other white space has exactly its pieces' ids; texts with
    ``ODD`` white space are encoded whole. Of a piece, Latin letters and the signs behind them are a match of the pattern
    each, and go to the library's merges at once."""

    ODD = re.compile(r"[^\S \n]|[ \n][ \n]|\A[ \n]|[ \n]\Z")
    PARTS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.line = self.ask("\n")
        self.first, self.later, self.signs = Pieces(self, "", 24 << 20), Pieces(self, " ", 256 << 20), Memo(4 << 20)

    def ask(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def match(self, text: str) -> bytes:
        """Ids of what the pattern takes as one match: the library's merges, without its search for matches."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def batch(self, batch: list[str]) -> list[bytes]:
        """Ids of each text, little-endian 32 bits."""
        first, later, out = self.first.__getitem__, self.later.__getitem__, []
        for text in batch:
            if not text or self.ODD.search(text):
                out.append(self.ask(text) if text else b"")
                continue
            parts: list[bytes] = []
            for line in text.split("\n"):
                pieces = line.split(" ")
                parts.append(self.line)
                parts.append(first(pieces[0]))
                parts.extend(map(later, pieces[1:]))
            out.append(b"".join(parts[1:]))
        return out


class Pieces(Memo):
    """Ids of pieces; ``lead`` is what stands before them."""

    def __init__(self, owner: PieceEncoder, lead: str, room: int) -> None:
        super().__init__(room)
        self.owner, self.lead = owner, lead

    def __missing__(self, piece: str) -> bytes:
        owner = self.owner
        if m := owner.PARTS.fullmatch(piece):
            word, signs = m.groups()
            if signs:
                if (after := owner.signs.get(signs)) is None:
                    after = owner.signs.put(signs, owner.match(signs), 200)
                ids = self[word] + after
            else:
                ids = owner.match(self.lead + word)
        else:
            ids = owner.ask(self.lead + piece)
        return self.put(piece, ids, 90 + 2 * len(piece) + len(ids))


ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each worker process, with what it has learnt from earlier tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in ENCODERS:
        ENCODERS[path] = PieceEncoder(path)
    return ENCODERS[path]


@tidy
def write_shards(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, end_id: int, shard_tokens: int, planes: str) -> Iterator[pa.RecordBatch]:
    part, seq, writer, path, tokens, docs, rows = TaskContext.get().partitionId(), 0, None, "", 0, 0, []
    end, encode = struct.pack("<I", end_id), encoder(local_copy(vocabulary))
    for chunk in in_chunks(batches, 4 << 20):
        for doc_id, ids in zip(chunk["doc_id"].to_pylist(), encode.batch([t or "" for t in chunk["text"].to_pylist()]), strict=True):
            if writer is None:
                # a name of its own for each attempt: only files that a finished task names are ever read
                path = f"{folder}/{part:08d}-{seq:04d}-{uuid.uuid4().hex}.ids"
                writer, tokens, docs = ShardWriter(path, planes=planes), 0, 0
            writer.add(doc_id, ids + end)
            tokens, docs = tokens + len(ids) // 4 + 1, docs + 1
            if tokens >= shard_tokens:
                writer.close()
                rows.append((part, seq, path, docs, tokens))
                writer, seq = None, seq + 1
    if writer is not None:
        writer.close()
        rows.append((part, seq, path, docs, tokens))
    names = ["part", "seq", "path", "n_docs", "n_tokens"]
    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 26, planes: str = "byte") -> DataFrame:
    """Encode all documents into shards in ascending id order; returns the manifest, a row for each shard with
    the number of ids before it. ``folder`` is a shared folder as a URI that pyarrow.fs knows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    # rows of one id, or without one, are dealt by a hash of their text
    rows = texts(docs, id_col=id_col, text_col=text_col).withColumn("mark", F.xxhash64("text")).repartitionByRange(width(spark), "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")
    written = stash(rows.mapInArrow(partial(write_shards, folder=folder, vocabulary=shared_file(spark, vocabulary), end_id=end_id, shard_tokens=shard_tokens, planes=planes), SHARD))
    earlier = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return written.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).cast("long"))


@tidy
def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
            shard, rows = ShardReader(path), []
            for doc_id, ids in shard.documents():
                rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                base += len(ids)
                if len(rows) == 50_000:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=DOCS)
                    rows = []
            shard.close()
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=DOCS)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    spark = manifest.sparkSession
    shards = manifest.select("path", "base").repartition(width(spark), "path")
    return shards.mapInArrow(read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    folder = folder if "://" in folder else folder.replace("file:", "")
    return read_token_files(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, vocabulary_path("byte_bpe_50k.json"), end_id=0))
