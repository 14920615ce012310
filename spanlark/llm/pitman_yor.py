"""Language-model scores from a hierarchical Pitman-Yor model.

Every word that other words follow, and the beginning of a text, is a context with a restaurant of its own: its customers
are the training tokens behind it, its dishes the words. All context restaurants share one parent, the restaurant without
context, whose customers are their tables and whose base is uniform over the known words and one unknown. Seatings are
sampled by Gibbs, and predictive probabilities are averaged over the samples after ``burn`` sweeps.

1. A sample names the frequent contexts, at most ``HEAVY`` of them. Texts are then cut into chunks, and a chunk sends its
   distinct pairs of context and word to buckets: by context, and those of a frequent context by context and word, so that
   no bucket has to hold one. What the buckets must know of a frequent context are two totals, which the driver sums.
2. A sweep of the contexts: given the parent's probability p0 of each word, an auxiliary x ~ Gamma(theta / d + tables) makes
   the dishes of a restaurant independent of each other, so that all of them can be sampled at once and exactly. Customers
   leave and sit down again one by one: at an old table in proportion to its customers less d, at a new one to x * d * p0.
   Of a pair with more than ``RESEAT`` customers the number of tables is drawn at once from its law given all others (nothing else of
   a pair is asked for), so every customer of every pair is reseated in each sweep. All start at one table for each pair.
3. The tables of each word are sent to the parent's buckets, which are by word. There they are seated and reseated in the
   same way, from one table anew in each sweep, since their number has changed. Given the seating, the parent's
   probabilities are drawn from their posterior (a Dirichlet by gamma variables; the share of tables yet unseen falls on all
   words alike) and go back to the buckets that asked, in the order asked.
4. At last the texts are cut once more: a chunk sends its tokens with the number of their text to the buckets of their
   contexts, these answer with sums for each text, and the sums are added. Texts are never shuffled.

Discounts are estimated from the pairs and words that occur once and twice, concentrations are parameters. Blocks are
records of a chunk for a bucket: fewer than tokens, however many chunks and buckets there are.

Tokens are words after lower-casing A-Z, and one end for each text; words are told apart by 64-bit hashes. The base score
is add-one over single tokens. Null texts are empty: their only token is the end. Ids are carried along only, so null and
repeated ids are as good as any; a null id is trained on. Without training rows the model is its base. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlark.llm.common import bounded_batches, discard, held_out, in_chunks, mix, stash, tidy, width

END, START = (np.uint64(xxhash.xxh3_64_intdigest(b)) for b in (b" end ", b" start "))  # no word has a space
HEAVY, RESEAT, SURVEYED = 1000, 16, 20_000_000
#: Customers up to which all numbers of tables are listed; proposals for more; points and angle of the path of Cauchy's integral.
LISTED, PROPOSALS, POINTS, ANGLE = 1024, 6, 64, 0.6
INDEX, MODEL, DOWN, ASK, TEXTS = -1, 0, 1, 2, 3
#: Everything that travels: a block for a bucket, from a chunk or another bucket.
BLOCK = pa.schema([("bucket", pa.int64()), ("at", pa.int32()), ("origin", pa.int64()), ("block", pa.binary()), ("sums", pa.list_(pa.int64())), ("gamma", pa.float64())])
BLOCKS = "bucket long, at int, origin long, block binary, sums array<long>, gamma double"
SURVEY = pa.schema([("context", pa.int64()), ("n", pa.int64())])
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays behind a header of their kinds and byte lengths, compressed."""
    kinds = b"".join(a.dtype.str.encode().ljust(3) for a in arrays)
    parts = [a.tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes() + kinds
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpacked(block: bytes) -> list[np.ndarray]:
    block = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(block, "<i8", 1)[0])
    at, out = 8 + 11 * n, []
    for k, size in enumerate(np.frombuffer(block, "<i8", n, 8).tolist()):
        kind = block[8 + 8 * n + 3 * k : 11 + 8 * n + 3 * k].decode()
        out.append(np.frombuffer(block[at : at + size], kind))
        at += size
    return out


def rows_to_batch(*rows: tuple) -> pa.RecordBatch:
    """rows: the leading values of BLOCK."""
    full = [(*r, *(None,) * (len(BLOCK) - len(r))) for r in rows]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*full, strict=True), BLOCK, strict=True)], schema=BLOCK)


class Numbers(dict):
    """Words by their number in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Tokens:
    """Words of all texts with their ends and the context of each, as numbers; the hash of each number; tokens of each text."""

    def __init__(self, texts: list[str | None]) -> None:
        numbers = Numbers({b" end ": 0, b" start ": 1})
        each = []
        for t in texts:
            words = (t or "").encode().lower().split()
            own = np.zeros(len(words) + 1, dtype=np.int32)
            own[:-1] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
            each.append(own)
        self.lengths = np.array([len(h) for h in each], dtype=np.int64)
        self.words = np.concatenate(each) if each else np.zeros(0, np.int32)
        self.contexts = np.empty_like(self.words)
        self.contexts[1:] = self.words[:-1]
        self.contexts[np.cumsum(self.lengths) - self.lengths] = 1
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))


@tidy
def survey(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """The contexts of one in ``HEAVY`` of a chunk's tokens: what is as frequent in all is so in some chunk."""
    for rows in in_chunks(batches, chunk_bytes):
        tokens = Tokens(rows["text"].to_pylist())
        counts = np.bincount(tokens.contexts, minlength=len(tokens.hashes))
        often = counts * HEAVY > counts.sum()
        names = [*tokens.hashes[often].astype(np.int64).tolist(), None]
        yield pa.record_batch([pa.array(names, pa.int64()), pa.array([*counts[often].tolist(), int(counts.sum())], pa.int64())], schema=SURVEY)


def places(words: np.ndarray, contexts: np.ndarray, heavy: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair."""
    spread = mix(contexts * np.uint64(0x9E3779B97F4A7C15) + words) if len(heavy) else contexts
    return (np.where(np.isin(contexts, heavy), spread, contexts) % np.uint64(buckets)).astype(np.int64)


class Chunk:
    """The tokens of some texts, in order of bucket, context and word."""

    def __init__(self, texts: list[str | None], heavy: np.ndarray, buckets: int) -> None:
        tokens = Tokens(texts)
        self.lengths, self.hashes, size = tokens.lengths, tokens.hashes, len(tokens.hashes)
        bucket = (self.hashes % np.uint64(buckets)).astype(np.int64)[tokens.contexts]
        if (often := np.isin(self.hashes, heavy)).any():
            spread = np.flatnonzero(often[tokens.contexts])
            bucket[spread] = places(self.hashes[tokens.words[spread]], self.hashes[tokens.contexts[spread]], heavy, buckets)
        if buckets * size * size < 1 << 62:  # one number for all three
            key = (bucket * size + tokens.contexts) * size + tokens.words
            del bucket, tokens
            self.order = np.argsort(key)
            key = key[self.order]
            ends = np.searchsorted(key, np.arange(buckets + 1, dtype=np.int64) * (size * size)) if buckets < len(key) else np.append(np.flatnonzero(np.diff(key // (size * size), prepend=-1)), len(key))
            self.cuts = np.unique(ends)
            self.bucket = key[self.cuts[:-1]] // (size * size)
            self.key = key
            self.key %= size * size
        else:
            self.key = tokens.contexts.astype(np.int64) * size + tokens.words
            self.order = np.lexsort((self.key, bucket))
            self.key, bucket = self.key[self.order], bucket[self.order]
            self.cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            self.bucket = bucket[self.cuts[:-1]]

    def pairs(self, k: int) -> tuple[np.ndarray, ...]:
        """Of the k-th bucket: contexts, pairs of each, words, the pairs' words, and where each pair's tokens begin."""
        key = self.key[self.cuts[k] : self.cuts[k + 1]]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        c, w = np.divmod(key[first], len(self.hashes))
        begins = np.flatnonzero(np.diff(c, prepend=-1))
        words, own = np.unique(w, return_inverse=True)
        return self.hashes[c[begins]], np.diff(np.append(begins, len(c))), self.hashes[words], own, first


def small(x: np.ndarray) -> np.ndarray:
    """In as few bytes as its largest value needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


@tidy
def count(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, buckets: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """For each bucket: contexts, pairs of each, words, the pairs' words and their training tokens (0 for those held out)."""
    for rows in in_chunks(batches, chunk_bytes):
        chunk = Chunk(rows["text"].to_pylist(), heavy, buckets)
        trained = np.repeat(~np.array(rows["held"].to_pylist()), chunk.lengths)[chunk.order]
        for k, bucket in enumerate(chunk.bucket.tolist()):
            contexts, each, words, own, first = chunk.pairs(k)
            n = np.add.reduceat(trained[chunk.cuts[k] : chunk.cuts[k + 1]].astype(np.int64), first)
            yield rows_to_batch((bucket, MODEL, 0, packed(contexts, small(each), words, small(own), small(n))))


@tidy
def ask(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, buckets: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """For each bucket: contexts, pairs of each, words, the pairs' words, tokens of each pair, and the text of each token."""
    part, seq = TaskContext.get().partitionId(), 0
    for rows in in_chunks(batches, chunk_bytes):
        name, seq = (part << 24) + seq, seq + 1
        chunk = Chunk(rows["text"].to_pylist(), heavy, buckets)
        text = np.repeat(np.arange(rows.num_rows), chunk.lengths)[chunk.order]
        for k, bucket in enumerate(chunk.bucket.tolist()):
            contexts, each, words, own, first = chunk.pairs(k)
            a, b = chunk.cuts[k], chunk.cuts[k + 1]
            yield rows_to_batch((bucket, ASK, name, packed(contexts, small(each), words, small(own), small(np.diff(np.append(first, b - a))), small(text[a:b]))))
        ids = rows["doc_id"].to_pylist()
        info = packed(np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], "u1"), np.array(rows["held"].to_pylist(), "u1"), small(chunk.lengths))
        yield rows_to_batch((name % buckets, TEXTS, name, info))


def log_factorial(k: np.ndarray) -> np.ndarray:
    """By Stirling's series behind eight steps of the recursion."""
    z = k + 9.0
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - sum(np.log(k + j) for j in range(1, 9))


@cache
def seatings(d: float, upto: int) -> list[np.ndarray]:
    """For each n the logarithms of the weights of all seatings of n customers at 1 to n tables: (n - d * t) of t tables stay t, one more is new."""
    out = [np.zeros(0), np.zeros(1)]
    for n in range(1, upto):
        out.append(np.logaddexp(np.append(out[n] + np.log(n - d * np.arange(1, n + 1)), -np.inf), np.append(-np.inf, out[n])))
    return out


def root(f: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Where f, which falls as w goes from 0 to 1, changes its sign: the logarithms of w."""
    low, high = np.full(n, -60.0), np.zeros(n)
    for _ in range(24):
        middle = (low + high) / 2
        above = f(middle) > 0
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def seating(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """What ``seatings`` tells, less log(n!), for many customers: t tables are t draws with the generating function
    1 - (1 - z) ** d that add up to n, which Cauchy's integral counts through its saddle, along a hyperbola around the cut where that is
    near and along the whole circle where it is not. The sums over their points converge geometrically; they agree with the recursion to rounding."""
    out = -t * math.log(d) - log_factorial(t)
    some = t < n
    out[~some] += t[~some] * math.log(d)  # each draw is one
    n, t = n[some].astype(float), t[some].astype(float)
    lw = root(lambda x: math.log(d) + (d - 1) * x + np.log1p(-np.exp(x) + 1e-300) - np.log(-np.expm1(d * x) + 1e-300) - np.log(n / t), len(n))
    lw = np.maximum(lw, np.log(2 / n))  # of few tables one has nearly all, and the saddle says little
    w = np.exp(lw)
    y, g, wd = -np.log1p(-w), -np.expm1(d * lw), np.exp(d * lw)
    first = -d * wd / w * (1 - w) / g  # of log g by y
    second = -first * (1 + (1 - d) * (1 - w) / w) - first * first  # the variance of a draw is what is left of this
    sigma = np.sqrt(np.maximum(t * np.abs(second), 1e-12))
    k, far = np.arange(POINTS), y > 0.5
    size = 2 * np.ceil((12 * sigma + 64) / 2)
    mu = y / (1 - math.sin(ANGLE))
    step = np.where(far, 2 * np.pi / size, np.minimum(0.5 / (sigma * mu * math.cos(ANGLE)), 0.07))
    u = k * step[:, None]
    bent = 1j * np.minimum(u, 6.0) - ANGLE
    at = np.where(far[:, None], y[:, None] + 1j * u, mu[:, None] * (1 + np.sin(bent)))
    slope = np.where(far[:, None], 1.0, mu[:, None] * np.cos(bent))  # of the path, by i
    weight = np.where(k == 0, 1.0, 2.0) * np.where(far[:, None], (u < np.pi - 1e-9) + 0.5 * (np.abs(u - np.pi) <= 1e-9), u < 6.0)
    top = t * np.log(g) + n * y
    draws, rest = t[:, None] * np.log(1 - (-np.expm1(-at)) ** d), n[:, None] * at - top[:, None]
    # the integral of the rest alone is nothing; where little else is there, it is left out
    few = (t * np.log(g) > -1) & ~far
    value = np.empty_like(draws)
    value[few], value[~few] = np.exp(rest[few]) * np.expm1(draws[few]), np.exp(draws[~few] + rest[~few])
    total = (weight * (value * slope).real).sum(axis=1) * step / (2 * np.pi)
    out[some] += top + np.log(np.maximum(total, 1e-300))
    return out


def tables_of(n: np.ndarray, t: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes whose n customers all stand up and sit down together: t tables weigh weight ** t times their seatings.

    Up to ``LISTED`` customers these are listed and one is drawn; for more, proposals around the mode are taken or refused by
    Metropolis' and Hastings' rule, ``PROPOSALS`` times, from the t that there are."""
    out = t.copy()
    listed = np.flatnonzero(n <= LISTED)
    listed = listed[np.argsort(n[listed], kind="stable")]
    for same in np.split(listed, np.flatnonzero(np.diff(n[listed])) + 1) if len(listed) else []:
        size = int(n[same[0]])
        for part in np.array_split(same, -(-len(same) * size // (1 << 20))):
            law = seatings(d, LISTED)[size] + np.arange(1, size + 1) * np.log(weight[part])[:, None]
            law = np.cumsum(np.exp(law - law.max(axis=1, keepdims=True)), axis=1)
            out[part] = 1 + (law < rng.random(len(part))[:, None] * law[:, -1:]).sum(axis=1)
    for part in np.array_split(np.flatnonzero(n > LISTED), max(1, -(-int((n > LISTED).sum()) // 2048))):
        if not len(part):
            continue
        m, a, now = n[part], weight[part], t[part].copy()
        lw = root(lambda x: np.log(a) + (d - 1) * x + np.log1p(-np.exp(x) + 1e-300) - np.log(m), len(part))  # noqa: B023
        middle = np.clip(np.round(1 + a / d * -np.expm1(d * lw)), 1, m)
        scale = np.sqrt(middle) + 1
        law = lambda t: t * np.log(a) + seating(m, t, d) + np.abs(t - middle) / scale  # noqa: B023, E731
        held = law(now)
        for _ in range(PROPOSALS):
            q = np.exp(-1 / scale)
            new = (middle + rng.geometric(1 - q) - rng.geometric(1 - q)).astype(np.int64)  # falls by q with each step from the middle
            inside = (new >= 1) & (new <= m)
            told = law(np.where(inside, new, 1))
            takes = inside & (np.log(rng.random(len(part))) < told - held)
            now, held = np.where(takes, new, now), np.where(takes, told, held)
        out[part] = now
    return out


def reseat(n: np.ndarray, t: np.ndarray, sizes: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """All customers of each dish leave and sit down again: at an old table in proportion to its customers less d, at a new one to
    ``weight``. n: customers of each dish; t: its tables; sizes: customers of the tables, dish by dish. Returns t and sizes.

    Up to ``RESEAT`` customers move one by one, in random order. An old table is found by choosing another customer, whose table is taken
    with probability 1 - d / its customers, else another choice is made. Of more customers the number of tables is drawn at once; as nothing
    else of them is ever asked for, one table is given all but one customer of each other table."""
    own, out = n <= RESEAT, t.copy()
    if not own.all():
        out[~own] = tables_of(n[~own], t[~own], weight[~own], d, rng)
    out[own], few = one_by_one(n[own], t[own], sizes[np.repeat(own, t)], weight[own], d, rng)
    full = np.ones(int(out.sum()), dtype=np.int64)
    full[np.repeat(own, out)] = few
    many = np.flatnonzero(~own)
    full[(np.cumsum(out) - out)[many]] = n[many] - out[many] + 1
    return out, full


def one_by_one(n: np.ndarray, t: np.ndarray, sizes: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    t, moves, two = t.copy(), n.copy(), n == 2  # of two customers both are drawn at once
    moves[n < 3] = 0
    busy = np.flatnonzero(moves)
    busy = busy[np.argsort(-n[busy], kind="stable")]
    m, nb, a, tb = moves[busy], n[busy], weight[busy], t[busy]
    old_at = (np.cumsum(t) - t)[busy]  # where the dish's tables begin
    seats = np.concatenate([[0], np.cumsum(sizes)])
    guests_at = seats[old_at]  # the number of the dish's first customer among all customers
    new_at = np.cumsum(tb + m) - (tb + m)  # the dish's tables with room for new ones
    own = np.zeros(int((tb + m).sum()), dtype=np.int64)
    step = np.arange(int(tb.sum()))
    own[np.repeat(new_at - (np.cumsum(tb) - tb), tb) + step] = sizes[np.repeat(old_at - (np.cumsum(tb) - tb), tb) + step]
    move_at = np.cumsum(m) - m
    pair = np.repeat(np.arange(len(busy)), m)
    mover = np.arange(len(pair)) - move_at[pair]
    turn = np.lexsort((rng.random(len(pair)), pair))  # the movers in the order in which they move
    sits = np.searchsorted(seats, guests_at[pair] + mover, side="right") - 1 - old_at[pair]  # where each sits now, as a number of the dish's tables
    tables, free = tb.copy(), tb.copy()
    for j in range(int(m.max(initial=0))):
        live = int(np.searchsorted(-m, -j, side="left"))  # those with more than j movers
        now = turn[move_at[:live] + j]
        own_table = new_at[:live] + sits[now]
        own[own_table] -= 1
        tables[:live] -= own[own_table] == 0
        fresh = rng.random(live) * (a[:live] + nb[:live] - 1 - d * tables[:live]) < a[:live]
        chosen = np.where(fresh, free[:live], -1)
        rest = np.flatnonzero(~fresh)
        while len(rest):
            other = (rng.random(len(rest)) * (nb[rest] - 1)).astype(np.int64)
            other += other >= mover[now[rest]]
            k = sits[move_at[rest] + other]
            size = own[new_at[rest] + k]
            takes = rng.random(len(rest)) * size < size - d
            chosen[rest[takes]] = k[takes]
            rest = rest[~takes]
        sits[now] = chosen
        own[new_at[:live] + chosen] += 1
        tables[:live] += fresh
        free[:live] += fresh
    apart = rng.random(int(two.sum())) * (weight[two] + 1 - d) < weight[two]
    t[busy], t[two] = tables, 1 + apart
    full = own > 0
    dish_of = np.concatenate([np.repeat(busy, tb + m)[full], np.repeat(np.flatnonzero(two), 1 + apart), np.flatnonzero(n == 1)])
    size_of = np.concatenate([own[full], np.repeat(2 - apart.astype(np.int64), 1 + apart), np.ones(int((n == 1).sum()), np.int64)])
    return t, size_of[np.argsort(dish_of, kind="stable")]


class Bucket:
    """Some contexts' restaurants (of frequent contexts, some dishes): contexts, words, and the pairs in order of both.

    ``words`` has all words that chunks ask about, in order of parent bucket and hash; ``counts`` the training tokens of each
    in the whole corpus. ``kept`` has tables of the pairs and probabilities of the words for each sample kept."""

    def __init__(self, block: bytes) -> None:
        self.contexts, self.words, self.counts, self.each, self.word, self.n, self.t, self.multi, tables, chances = unpacked(block)
        self.counts, self.n, self.t, self.multi = (x.astype(np.int64) for x in (self.counts, self.n, self.t, self.multi))
        self.word, self.context = self.word.astype(np.int64), np.repeat(np.arange(len(self.contexts)), self.each.astype(np.int64))
        self.tables, self.chances = list(tables.reshape(-1, len(self.n)).astype(np.int64)) if len(self.n) else [], list(chances.reshape(-1, len(self.words))) if len(self.words) else []

    @staticmethod
    def block(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, each: np.ndarray, word: np.ndarray, n: np.ndarray, t: np.ndarray, multi: np.ndarray, tables: list, chances: list) -> bytes:
        whole = lambda arrays, kind: np.concatenate(arrays).astype(kind) if arrays else np.zeros(0, kind)
        return packed(contexts, words, small(counts), small(each), small(word), small(n), small(t), small(multi), small(whole(tables, np.int64)), whole(chances, "<f4"))

    def packed(self) -> bytes:
        return self.block(self.contexts, self.words, self.counts, np.bincount(self.context, minlength=len(self.contexts)), self.word, self.n, self.t, self.multi, self.tables, self.chances)

    def sums(self, heavy: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Customers and tables of each context, and for each its place among the frequent ones or -1."""
        add = lambda x: np.bincount(self.context, weights=x, minlength=len(self.contexts)).astype(np.int64)
        at = np.minimum(np.searchsorted(heavy, self.contexts), max(0, len(heavy) - 1))
        return add(self.n), add(t), np.where(heavy[at] == self.contexts, at, -1) if len(heavy) else np.full(len(self.contexts), -1)

    def ups(self, bucket: int, buckets: int, counts: np.ndarray | None) -> Iterator[tuple]:
        """For each parent bucket: the tables of its words, and at first the words and the training tokens of each."""
        tables = np.bincount(self.word, weights=self.t, minlength=len(self.words)).astype(np.int64)
        owner = (self.words % np.uint64(buckets)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(owner[a]), DOWN, bucket, packed(small(tables[a:b]), *((self.words[a:b], small(counts[a:b])) if counts is not None else ()))

    def model(self, bucket: int, heavy: np.ndarray) -> tuple:
        """The bucket's row; sums: training tokens, pairs that occur once and twice, then customers and tables of frequent contexts."""
        n, t, at = self.sums(heavy, self.t)
        of_heavy = lambda x: np.bincount(at[at >= 0], weights=x[at >= 0], minlength=len(heavy)).astype(np.int64).tolist()
        return bucket, MODEL, 0, self.packed(), [int(self.n.sum()), int((self.n == 1).sum()), int((self.n == 2).sum()), *of_heavy(n), *of_heavy(t)]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, bytes]]]]:
    """Rows that come sorted by bucket, bucket by bucket and one at a time: (at, origin, block)."""
    from itertools import groupby

    rows = (
        (bucket.as_py(), at.as_py(), origin.as_py(), block.as_py())
        for b in batches
        for bucket, at, origin, block in zip(b.column("bucket"), b.column("at"), b.column("origin"), b.column("block"), strict=True)
    )
    for bucket, group in groupby(rows, key=lambda r: r[0]):
        yield bucket, (r[1:] for r in group)


@tidy
def merge(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """All blocks of a bucket become its restaurants, with one table for each pair."""

    def fold(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        contexts, c = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        words, w = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        keys, at_c, at_w = [], 0, 0
        for p in parts:
            keys.append(np.repeat(c[at_c : at_c + len(p[0])], p[1].astype(np.int64)) * len(words) + w[at_w : at_w + len(p[2])][p[3].astype(np.int64)])
            at_c, at_w = at_c + len(p[0]), at_w + len(p[2])
        pairs, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(n, at, np.concatenate([p[4] for p in parts]).astype(np.int64))
        c, w = np.divmod(pairs, max(1, len(words)))
        return [contexts, np.bincount(c, minlength=len(contexts)), words, w, n]

    for bucket, rows in grouped(batches):
        held: list[list[np.ndarray]] = []
        for _, _, block in rows:
            held.append(unpacked(block))
            if sum(len(p[3]) for p in held) > 4_000_000 and len(held) > 1:
                held = [fold(held)]  # counts add up, so what is folded is a block
        contexts, each, words, w, n = fold(held)
        order = np.lexsort((words, words % np.uint64(buckets)))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        c, w = np.repeat(np.arange(len(contexts)), each.astype(np.int64))[n > 0], place[w][n > 0]
        n, words = n[n > 0], words[order]
        known, c = np.unique(c, return_inverse=True)
        by = np.lexsort((w, c))
        c, w, n = c[by], w[by], n[by]
        counts = np.bincount(w, weights=n, minlength=len(words)).astype(np.int64)
        own = Bucket(Bucket.block(contexts[known], words, np.zeros(0, np.int64), np.bincount(c, minlength=len(known)), w, n, np.ones(len(n), np.int64), n[n > 1], [], []))
        yield rows_to_batch(own.model(bucket, heavy), *own.ups(bucket, buckets, counts))


@tidy
def parent(batches: Iterator[pa.RecordBatch], total: dict | None, number: int) -> Iterator[pa.RecordBatch]:
    """The parent's words of a bucket: seated, reseated, and a gamma variable drawn for each, which goes back to all that have
    asked. sums: the words known, customers, tables, words of one customer and of two; gamma: the sum of the variables."""
    for bucket, rows in grouped(batches):
        index, parts = None, []
        for at, origin, block in rows:
            if at == INDEX:
                index = block
            else:
                parts.append((origin, *unpacked(block)))
        first = index is None
        if first:
            words, at = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
            index = packed(small(at), np.array([len(words)]))
            counts = np.bincount(at, weights=np.concatenate([p[3] for p in parts]), minlength=len(words)).astype(np.int64)
        at, n = unpacked(index)
        at, n = at.astype(np.int64), int(n[0])
        customers = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=n).astype(np.int64)
        rng = np.random.default_rng([number, bucket, 1])
        tables, sizes, d = (customers > 0).astype(np.int64), customers[customers > 0], 0.5
        if total is not None:
            d = total["d0"]
            weight = np.full(n, np.random.default_rng([number, 2]).gamma(total["theta"] / d + total["root_tables"]) * d * total["base"])
            for _ in range(2):
                tables, sizes = reseat(customers, tables, sizes, weight, d, rng)
        gamma = np.where(customers > 0, rng.gamma(np.maximum(customers - d * tables, 1e-9)), 0.0) if total is not None else np.maximum(customers - d * tables, 0.0)
        shift, out = 0, []
        for origin, own, *_ in parts:
            k = at[shift : shift + len(own)]
            shift += len(own)
            out.append((origin, DOWN, bucket, packed(gamma[k].astype("<f4"), small(counts[k]) if first else np.zeros(0, "u1"))))
        out.append((bucket, INDEX, 0, index))
        sums = [int((customers > 0).sum()), int(customers.sum()), int(tables.sum()), int((customers == 1).sum()), int((customers == 2).sum())]
        out.append((bucket, MODEL, 0, None, sums, float(gamma.sum())))
        yield rows_to_batch(*out)


def opened(rows: Iterator[tuple[int, int, bytes]], total: dict) -> tuple[Bucket | None, np.ndarray, list]:
    """A bucket with the parent's probabilities of its words, which came in order of parent bucket; and the first row behind."""
    own, gammas, counts = None, [], []
    for at, origin, block in rows:
        if at == MODEL:
            own = Bucket(block)
        elif at == DOWN:
            g, c = unpacked(block)
            gammas.append(g)
            counts.append(c)
        else:
            return own, _chance(own, gammas, counts, total), [(at, origin, block)]
    return own, _chance(own, gammas, counts, total), []


def _chance(own: Bucket | None, gammas: list, counts: list, total: dict) -> np.ndarray:
    if own is None:
        return np.zeros(0)
    if not len(own.counts) and len(own.words):
        own.counts = np.concatenate(counts).astype(np.int64)
    g = np.concatenate(gammas).astype(float) if gammas else np.zeros(0)
    return (g + total["gamma_rest"] * total["base"]) / (total["gamma"] + total["gamma_rest"])


@tidy
def sweep(batches: Iterator[pa.RecordBatch], total: dict, heavy: np.ndarray, buckets: int, number: int, keep: bool) -> Iterator[pa.RecordBatch]:
    """keep: whether the probabilities that have come, with the tables they were drawn for, are a sample to keep."""
    d, theta = total["d"], total["theta"]
    of_heavy = np.array([np.random.default_rng([number, 3, k]).gamma(theta / d + t) for k, t in enumerate(total["heavy_tables"])])
    for bucket, rows in grouped(batches):
        own, p0, _ = opened(rows, total)
        if keep:
            own.tables.append(own.t)
            own.chances.append(p0.astype("<f4"))
        rng = np.random.default_rng([number, bucket, 4])
        _, tables, at = own.sums(heavy, own.t)
        x = rng.gamma(theta / d + tables)
        x[at >= 0] = of_heavy[at[at >= 0]]
        sizes = np.ones(int(own.t.sum()), dtype=np.int64)
        sizes[np.repeat(own.n > 1, own.t)] = own.multi
        own.t, sizes = reseat(own.n, own.t, sizes, x[own.context] * d * p0[own.word], d, rng)
        own.multi = sizes[np.repeat(own.n > 1, own.t)]
        yield rows_to_batch(own.model(bucket, heavy), *own.ups(bucket, buckets, None))


@tidy
def answer(batches: Iterator[pa.RecordBatch], totals: list[dict], heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A bucket's restaurants come first, then what the chunks ask; answers: for each text the sums of its tokens here."""
    n, v = totals[-1]["n"], totals[-1]["v"]
    for bucket, rows in grouped(batches):
        own, p0, rest = opened(rows, totals[-1])
        if own is not None:
            own.tables.append(own.t)
            own.chances.append(p0)
            behind, seated = np.zeros((len(totals), len(own.contexts))), np.zeros(len(own.n))
            for j, s in enumerate(totals):
                customers, tables, at = own.sums(heavy, own.tables[j])
                customers[at >= 0], tables[at >= 0] = np.array(s["heavy_customers"], np.int64)[at[at >= 0]], np.array(s["heavy_tables"], np.int64)[at[at >= 0]]
                behind[j] = (s["theta"] + s["d"] * tables) / (s["theta"] + customers)
                seated += (own.n - s["d"] * own.tables[j]) / (s["theta"] + customers[own.context])
            seated /= len(totals)
            chances, key = np.stack(own.chances), own.context * len(own.words) + own.word
            by = np.argsort(own.words)
        for at, origin, block in (x for part in (rest, rows) for x in part):
            if at == TEXTS:
                yield rows_to_batch((bucket, TEXTS, origin, block))
                continue
            contexts, each, words, word, times, text = unpacked(block)
            w = by[np.searchsorted(own.words, words, sorter=by)]  # all words asked about are here
            c = np.minimum(np.searchsorted(own.contexts, contexts), max(0, len(own.contexts) - 1))
            seen = own.contexts[c] == contexts if len(own.contexts) else np.zeros(len(contexts), bool)
            c, seen, w = np.repeat(c, each.astype(np.int64)), np.repeat(seen, each.astype(np.int64)), w[word.astype(np.int64)]
            p = np.zeros(len(w))
            for j in range(len(totals)):
                p += (np.where(seen, behind[j][c], 1.0) if len(own.contexts) else 1.0) * chances[j][w]
            p /= len(totals)
            if len(key):
                at_pair = np.minimum(np.searchsorted(key, c * len(own.words) + w), len(key) - 1)
                p += np.where(seen & (key[at_pair] == c * len(own.words) + w), seated[at_pair], 0.0)
            times = times.astype(np.int64)
            base = np.log10((own.counts[w] + 1) / (n + 1 * (v + 1)))
            texts, of = np.unique(text, return_inverse=True)
            add = lambda x: np.bincount(of, weights=np.repeat(x, times), minlength=len(texts))  # noqa: B023, E731
            yield rows_to_batch((bucket, ASK, origin, packed(small(texts), add(np.log10(p)).astype("<f4"), add(base), small(add(own.counts[w] > 0).astype(np.int64)))))


@tidy
def total_up(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The answers for a chunk come in order of bucket, and its texts' ids among them; here ``bucket`` is the chunk."""
    for _, rows in grouped(batches):
        parts, info = [], None
        for at, _, block in rows:
            if at == TEXTS:
                info = unpacked(block)
            else:
                parts.append(unpacked(block))
        ids, none, held, lengths = info
        columns = [np.zeros(len(ids)) for _ in range(3)]
        for texts, *values in parts:
            for column, value in zip(columns, values, strict=True):
                column[texts.astype(np.int64)] += value
        score, base, known = columns
        data = [pa.array(ids, mask=none.astype(bool)), held.astype(bool), lengths.astype(np.int64), known.astype(np.int64), np.full(len(ids), n), base, score]
        yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(data, SCORED, strict=True)], schema=SCORED)


def added(table: DataFrame, size: int) -> tuple[list[int], float]:
    """The sums of all buckets, and of their gamma variables."""
    rows = table.where(f"at = {MODEL} and sums is not null")
    one = {r["k"]: int(r["v"]) for r in rows.select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()}
    return [one.get(k, 0) for k in range(size)], float(rows.agg(F.sum("gamma")).first()[0] or 0.0)


def pitman_yor_scores(docs: DataFrame, held: Column, *, sweeps: int = 3, burn: int = 1, theta: float = 1.0, chunk_bytes: int = 28 << 20, bucket_chars: int = 32_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; held: which rows are not trained on."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    # which contexts are spread decides where work is done, not what comes out: a sample of some texts is enough to name them
    some = own.select("text").sample(min(1.0, SURVEYED / max(1, chars)), seed=3)
    seen = some.mapInArrow(partial(survey, chunk_bytes=chunk_bytes), "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.col("context").isNotNull(), F.desc("n"), "context").limit(HEAVY + 1).collect()  # first the row of totals
    heavy = np.sort(np.array([r["context"] for r in top[1:] if r["n"] * HEAVY > top[0]["n"]], dtype=np.int64).view(np.uint64))
    buckets = max(1, -(-chars // bucket_chars), min(width(spark), 24, -(-chars // (bucket_chars // 8))))
    parts = min(buckets, max(width(spark), 10_000))  # a task holds one bucket at a time
    dealt = lambda rows: rows.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket", "at", "origin")
    names, size = [f.name for f in BLOCK], 3 + 2 * len(heavy)

    state = stash(dealt(own.mapInArrow(partial(count, heavy=heavy, buckets=buckets, chunk_bytes=chunk_bytes), BLOCKS)).mapInArrow(partial(merge, heavy=heavy, buckets=buckets), BLOCKS))
    total, kept = None, []
    for number in range(sweeps + 1):
        if number:
            before = state, down
            state = stash(dealt(state.where(f"at = {MODEL}").unionByName(down.where(f"at = {DOWN}"))).mapInArrow(partial(sweep, total=total, heavy=heavy, buckets=buckets, number=number, keep=number - 1 > burn), BLOCKS))
            discard(before[0])
        ups = state.where(f"at = {DOWN}")
        down = stash(dealt(ups if not number else ups.unionByName(before[1].where(f"at = {INDEX}"))).mapInArrow(partial(parent, total=total, number=number), BLOCKS))
        if number:
            discard(before[1])
        (n, once, twice, *of_heavy), _ = added(state, size)
        (v, _, root_tables, once0, twice0), gamma = added(down, 5)
        guess = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5
        total = {"n": n, "v": v, "root_tables": root_tables, "base": 1 / (v + 1), "theta": theta, "gamma": gamma, "heavy_customers": of_heavy[: len(heavy)], "heavy_tables": of_heavy[len(heavy) :],
                 "d": guess(once, twice) if total is None else total["d"], "d0": guess(once0, twice0) if total is None else total["d0"]}
        rest = theta + total["d0"] * root_tables
        total["gamma_rest"] = float(np.random.default_rng([number, 5]).gamma(rest)) if number else rest
        kept += [total] * (number > burn)
    asked = own.mapInArrow(partial(ask, heavy=heavy, buckets=buckets, chunk_bytes=chunk_bytes), BLOCKS)
    model = state.where(f"at = {MODEL}").unionByName(down.where(f"at = {DOWN}"))
    answers = stash(dealt(model.unionByName(asked)).mapInArrow(partial(answer, totals=kept, heavy=heavy), BLOCKS))
    discard(state, down)
    by_chunk = answers.select(F.col("origin").alias("bucket"), "at", F.col("bucket").alias("origin"), "block", "sums", "gamma").select(*names)
    back = by_chunk.repartition(max(width(spark), -(-chars // (4 * chunk_bytes))), "bucket").sortWithinPartitions("bucket", "at", "origin")
    return back.mapInArrow(partial(total_up, n=total["n"]), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_pitman_yor(spark, sf_dir: str) -> DataFrame:
    return pitman_yor_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out(F.col("doc_id"), 7, 2))
