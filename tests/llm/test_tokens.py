"""Encoders against the tokenizers library, and files against what was written."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from spanlark.llm import common, prefix_bpe, token_output
from tests.llm.conftest import SF

TEXTS = [
    "", "Hello  world\n\n foo\tbar <|endoftext|>x  <|startoftext|> É é ΑΣ 'S it's I'LL 123 日本語 \x1c a\x85b ﬁ İ ß", "a" * 300, "!!!???### ​ x", "  lead", "trail \n",
    "one.\nTwo, three!\nfour", "don't he'll, x's\nI'm. <|endoftext|>", "a<|endoftext|>, b<|x", "x" * 50000, "é́ é Å", "(a) [b] {c} `d` ~e_f^ g-h", "\n", " ", "a\n b", "� 😀😀 ok", "naïve café, größe! ÀÖ ØöŁ ǆ× ÷a ªº a'b x'll, <|x|> a<|endoftext|> end.\nÉté;",
]


@pytest.fixture(scope="module")
def samples(spark):
    return TEXTS + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_word_bpe_is_the_library(samples):
    path = token_output.vocabulary_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), prefix_bpe.WordTokenizer(path)
    for text in samples:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert own.encode(text) == ids and own.decode(ids) == decoded
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert own.digests(text) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


def test_piece_encoder_is_the_library(samples):
    path = token_output.vocabulary_path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_output.PieceEncoder(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in samples]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.batch(samples)] == want
    own.first.room = own.later.room = 5000
    for at in range(0, len(samples), 7):
        assert [np.frombuffer(b, "<u4").tolist() for b in own.batch(samples[at : at + 7])] == want[at : at + 7]


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("block", [8, 1000])
def test_shard_round_trip(tmp_path, planes, block):
    rng = np.random.default_rng(4)
    docs = [(None, 0), (3, 1), (3, 17), (9, 0), (10, 8), (11, 2500)]
    data = [(i, rng.integers(0, 1 << 32, size=n, dtype=np.uint32)) for i, n in docs]
    writer = token_output.ShardWriter(f"file://{tmp_path}/x/s.ids", block=block, planes=planes)
    for i, ids in data:
        writer.add(i, ids.tobytes())
    writer.close()
    reader = token_output.ShardReader(f"file://{tmp_path}/x/s.ids")
    back = list(reader.documents())
    assert [i for i, _ in back] == [i for i, _ in data] and all((a == b).all() for (_, a), (_, b) in zip(back, data, strict=True))
    assert len(reader.block(0)) == min(block, sum(n for _, n in docs))


def test_files_hold_all_documents_in_order(spark, odd):
    library = Tokenizer.from_file(token_output.vocabulary_path("byte_bpe_50k.json"))
    for docs, shard_tokens in ((spark.read.parquet(f"{SF}/documents.parquet"), 5000), (odd, 1 << 20)):
        manifest = token_output.write_token_files(docs, common.shared_dir(spark), token_output.vocabulary_path("byte_bpe_50k.json"), shard_tokens=shard_tokens)
        got, at, want = token_output.read_token_files(manifest).collect(), 0, []
        for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
            ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
            want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert manifest.count() <= 4


def test_empty_table(spark, empty):
    path = token_output.vocabulary_path("byte_bpe_50k.json")
    assert token_output.read_token_files(token_output.write_token_files(empty, common.shared_dir(spark), path)).count() == 0
    assert prefix_bpe.encode_digests(empty, path.replace("byte_bpe_50k", "word_bpe_49k")).count() == 0


def test_encode_operator_returns_ids(spark, odd):
    rows = prefix_bpe.encode(odd, token_output.vocabulary_path("word_bpe_49k.json")).collect()
    assert len(rows) == odd.count() and {r["doc_id"]: r["decoded"] for r in rows}[4] == "one</w>"


def test_pair_test_is_merging(samples):
    """The walk along the border against merging both entries from their letters."""
    own = prefix_bpe.WordTokenizer(token_output.vocabulary_path("word_bpe_49k.json")).bpe
    for text in samples[:60]:
        for word in text.lower().split()[:200]:
            own.encode(word.encode().decode("latin-1").translate({b: c for b, c in common.byte_letters().items()}))
    rng = np.random.default_rng(2)
    entries = [t for t in own.ids if t != prefix_bpe.END and own.reachable(t)]
    inner = [t for t in entries if t[-1] != prefix_bpe.END]
    pairs = [*own.pairs, *[(inner[i], entries[j]) for i, j in zip(rng.integers(0, len(inner), 3000), rng.integers(0, len(entries), 3000), strict=True)]]
    pairs += [(a, b) for a in ("a", "aa", "aaa", "aaaa", "ha", "haha") for b in ("a", "aa", "aaa", "aaaa", "ha", "haha", "ha" + prefix_bpe.END) if a in own.ids and b in own.ids]
    assert {own.compatible(a, b) for a, b in pairs} == {True, False}
    assert all(own.compatible(a, b) == (own.merged([*own.symbols(a), *own.symbols(b)]) == [a, b]) for a, b in pairs)
