"""Jump hashing against the published loop, slots, growth by one shard, and the files."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spanlark.llm.queries import queries
from spanlark.llm.sharding import assign, jump, write_shards
from tests.llm.conftest import SF


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_matches_the_plain_loop():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for shards in (1, 2, 8, 9, 100, 5000):
        assert jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]
    assert jump(np.zeros(0, np.uint64), 8).tolist() == []


def test_growing_moves_rows_only_into_new_shards():
    keys = np.random.default_rng(2).integers(0, 1 << 62, 50_000, dtype=np.uint64)
    for n in (1, 7, 8, 63):
        before, after = jump(keys, n), jump(keys, n + 1)
        moved = before != after
        assert set(after[moved].tolist()) <= {n} and abs(moved.mean() - 1 / (n + 1)) < 0.01
        assert np.bincount(before, minlength=n).min() > 0.8 * len(keys) / n


def check_slots(rows):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op13_jump_shards"](spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"key"} and {r["shard"] for r in rows} <= set(range(8))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows) and any(r["grown_shard"] == 8 for r in rows)
    check_slots(rows)


def test_shards_depend_on_key_and_number_alone(spark, odd):
    rows = assign(odd.repartition(5), 8).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    check_slots(rows)
    again = {(r["doc_id"], r["shard"], r["grown_shard"]) for r in assign(odd.coalesce(1).limit(9).withColumn("text", F.lit("other")), 8).collect()}
    assert again <= {(r["doc_id"], r["shard"], r["grown_shard"]) for r in rows}
    grown = {(r["doc_id"], r["shard"]) for r in assign(odd, 9).collect()}
    assert grown == {(r["doc_id"], r["grown_shard"]) for r in rows}
    assert len({r["shard"] for r in assign(odd.where("doc_id = 11 or doc_id is null"), 1000).collect()}) == 2


def test_many_rows_of_one_key(spark):
    rows = assign(spark.range(3000).select(F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).alias("doc_id")), 8).collect()
    check_slots(rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1


def test_files_hold_every_row_in_its_shard(spark, odd, tmp_path):
    back = write_shards(odd, 8, str(tmp_path / "shards"), rows_per_file=1)
    assert Counter(tuple(r[c] for c in odd.columns) for r in back.collect()) == Counter(map(tuple, odd.collect()))
    want = {(r["doc_id"], r["shard"]) for r in assign(odd, 8).collect()}
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == want
    assert sorted(p.name for p in (tmp_path / "shards").iterdir() if p.is_dir()) == sorted(f"shard={s}" for s in {s for _, s in want})


def test_empty_table(spark, empty, tmp_path):
    assert assign(empty, 8).collect() == []
    assert write_shards(empty, 8, str(tmp_path / "none")).collect() == []
