"""BPE encoding by one pass over the prefixes of a word, and decoding.

For every prefix exactly one vocabulary entry can be the last of its encoding: the entry that ends there and
is compatible with the last entry of the prefix before it. An automaton over the vocabulary with suffix links
reports all entries that end at a position, the pair test picks the one that fits, and following the
back-pointers from the end gives the ids. Two entries are compatible if byte-pair merging of their
concatenation leaves exactly these two; verdicts are remembered.

White space always separates words in this vocabulary, so encodings are remembered for each run of other
characters. Null texts are empty; an empty text has no ids, and decodes to the empty string.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spanlark.llm.common import Memo, bounded_batches, byte_letters, in_chunks, local_copy, shared_file, texts, tidy
from spanlark.llm.token_output import vocabulary_path

#: Stands for the end of a word inside the automaton; the vocabulary's alphabet does not have it.
END = "\ue000"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class PrefixBPE:
    """vocab: id of each entry; merges: pairs by rank; end: what marks the last entry of a word."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        inside = lambda t: t[: -len(end)] + END if end and t.endswith(end) else t
        self.ids = {inside(t): i for t, i in vocab.items()}
        self.rank = {(inside(a), inside(b)): k for k, (a, b) in reversed(list(enumerate(merges)))}
        self.entries = {i: t for t, i in vocab.items()}
        self.made: dict[str, tuple[int, str, str]] = {}  # when an entry is merged, and from what
        for (x, y), k in self.rank.items():
            if k < self.made.get(x + y, (1 << 60,))[0]:
                self.made[x + y] = (k, x, y)
        self.left, self.right = {}, {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if t != END and self.reachable(t):
                self.automaton.add_word(t, (t, i, len(t), t[-1] == END))
        self.automaton.make_automaton()
        self.pairs = Memo(16 << 20)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair merging, for short sequences."""
        rank = self.rank
        while len(symbols) > 1:
            best = min((rank.get(p, 1 << 60), k) for k, p in enumerate(zip(symbols, symbols[1:])))  # noqa: B905
            if best[0] == 1 << 60:
                break
            pair, out, k = (symbols[best[1]], symbols[best[1] + 1]), [], 0
            while k < len(symbols):
                if k + 1 < len(symbols) and (symbols[k], symbols[k + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    k += 2
                else:
                    out.append(symbols[k])
                    k += 1
            symbols = out
        return symbols

    @staticmethod
    def symbols(t: str) -> list[str]:
        return [*t[:-2], t[-2:]] if t[-1] == END else [*t]

    def reachable(self, t: str) -> bool:
        """Whether merging the entry's own letters gives the entry back, in one piece."""
        return self.merged(self.symbols(t)) == [t]

    def spine(self, t: str, side: int, known: dict[str, list[tuple[str, int]]]) -> list[tuple[str, int]]:
        """The pieces of an entry that lie at one end of it, from its letter up, each with the time at which it is absorbed."""
        out = known.get(t)
        if out is None:
            out, piece, absorbed = [], t, 1 << 60
            while True:
                out.append((piece, absorbed))
                if piece not in self.made or piece in self.symbols(piece):
                    break
                absorbed, piece = self.made[piece][0], self.made[piece][side]
            out = known[t] = out[::-1]
        return out

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging leaves the border between a and b: no pair of pieces that meet there merges before one of them is
        absorbed on its own side. Equal merges go from left to right, so at equal times the left side moves first."""
        known = self.pairs.get((a, b))
        if known is None:
            left, right, i, j, known = self.spine(a, 2, self.left), self.spine(b, 1, self.right), 0, 0, True
            while True:
                (x, x_until), (y, y_until) = left[i], right[j]
                k = self.rank.get((x, y))
                if k is not None and k < x_until and k <= y_until:
                    known = False
                    break
                if x_until == y_until == 1 << 60:
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            self.pairs.put((a, b), known, 72)  # the strings are the vocabulary's own
        return known

    def encode(self, word: str) -> list[int]:
        """word in byte letters, not empty."""
        n = len(word)
        last: list[tuple[str, int, int, bool] | None] = [None] * (n + 1)
        pairs = self.pairs
        for at, entry in self.automaton.iter(word + END):
            t, _, size, ends = entry
            stop = n if ends else at + 1
            if last[stop] is not None or (stop == n and not ends):  # the last letter carries the end mark
                continue
            start = at + 1 - size
            if start == 0:
                last[stop] = entry
            elif (before := last[start]) is not None:
                fits = pairs.get((before[0], t))
                if fits or fits is None and self.compatible(before[0], t):
                    last[stop] = entry
        out, at = [], n
        while at > 0:
            _, i, size, ends = last[at]
            out.append(i)
            at -= size - ends
        return out[::-1]


class WordTokenizer:
    """A vocabulary file with word ends: NFC, lower case, words by pattern, byte letters, then PrefixBPE."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.bpe = PrefixBPE(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.entries = self.bpe.entries | {i: t for t, i in self.special.items()}
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.known = Memo(96 << 20)

    def ids_of(self, word: str) -> list[int]:
        return self.bpe.encode(word.encode().decode("latin-1").translate(self.letters))

    def words(self, run: str) -> list[str | int]:
        """The words of a text, and the ids of its special entries."""
        if run.isascii() and "<|" not in run:
            return self.pattern.findall(run.lower())
        out = []
        for part in self.cut.split(run):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.pattern.findall(self.normal(part))
        return out

    def run(self, run: str) -> list[int]:
        """ids of a text, its special entries included."""
        out = []
        for w in self.words(run):
            out += [w] if isinstance(w, int) else self.ids_of(w)
        return out

    def digest(self, key: bytes, ids: list[int]) -> tuple[bytes, bytes]:
        pair = (" ".join(map(str, ids)).encode(), self.decode(ids).encode())
        return self.known.put(key, pair, 110 + len(key) + len(pair[0]) + len(pair[1]))

    def written(self, run: bytes) -> tuple[bytes, bytes]:
        """The ids and the entries of a run as text, remembered, as are those of its words: a word alone is one word again."""
        text = run.decode()
        words = self.words(text)
        if len(words) < 2:
            return self.digest(run, self.run(text))
        parts = []
        for w in words:
            if isinstance(w, int):
                parts.append((b"%d" % w, self.entries[w].encode()))
            else:
                key = w.encode()
                parts.append(self.known.get(key) or self.digest(key, self.ids_of(w)))
        ids, entries = (b" ".join(p) for p in zip(*parts, strict=True))
        return self.known.put(run, (ids, entries), 110 + len(run) + len(ids) + len(entries))

    def encode(self, text: str) -> list[int]:
        return [int(i) for run in text.encode().split() for i in (self.known.get(run) or self.written(run))[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary file names no decoder: entries as written, joined by spaces."""
        return " ".join([self.entries[i] for i in ids])

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and the digests of the ids and of the decoded text."""
        known, ids, entries = self.known, [], []
        for run in text.encode().split():
            pair = known.get(run) or self.written(run)
            if pair[0]:
                ids.append(pair[0])
                entries.append(pair[1])
        line = b" ".join(ids)
        return line.count(b" ") + 1 if line else 0, hashlib.sha256(line).hexdigest(), hashlib.sha256(b" ".join(entries)).hexdigest()


TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in TOKENIZERS:
        TOKENIZERS[path] = WordTokenizer(path)
    return TOKENIZERS[path]


@tidy
def digest_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = tokenizer(local_copy(path))
    for chunk in in_chunks(batches, 4 << 20):
        n, ids, decoded = zip(*[bpe.digests(t.as_py() or "") for t in chunk["text"]], strict=True)
        yield pa.record_batch([chunk["doc_id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], schema=RESULT)


@tidy
def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = tokenizer(local_copy(path))
    for chunk in in_chunks(batches, 2 << 20):
        ids = [bpe.encode(t.as_py() or "") for t in chunk["text"]]
        yield pa.record_batch([chunk["doc_id"].combine_chunks(), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded for each row."""
    bounded_batches(docs.sparkSession)
    return texts(docs, id_col=id_col, text_col=text_col).mapInArrow(partial(encode_batches, path=shared_file(docs.sparkSession, path)), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row."""
    bounded_batches(docs.sparkSession)
    return texts(docs, id_col=id_col, text_col=text_col).mapInArrow(partial(digest_batches, path=shared_file(docs.sparkSession, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("word_bpe_49k.json"))
