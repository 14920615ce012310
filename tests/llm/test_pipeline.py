"""The stages against brute force, one on the other's rows."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spanlark.llm import quality
from spanlark.llm.common import stash
from spanlark.llm.token_output import vocabulary_path
from tests.llm.conftest import SF
from tests.llm.test_dedup import brute_near


def rows_of(df):
    """Rows as values that can be counted, maps included."""
    plain = lambda v: tuple(sorted(v.items())) if isinstance(v, dict) else v
    return [tuple(map(plain, r)) for r in df.collect()]


def test_stages(spark, odd):
    clashing = odd.withColumns({"lot": F.lit("LOT"), "_row": F.lit(1.5), "_copy": F.lit("c"), "_copies": F.lit(7), "row_number": F.col("doc_id") % 2, "copies": F.lit(None).cast("string"), "n.m": F.lit("dot"), "tags": F.create_map(F.lit("a"), F.col("text"))})
    clashing = clashing.unionByName(clashing.where("doc_id = 6 or doc_id = 11").withColumn("text", F.lit("one  two")))
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), clashing):
        names = docs.columns
        at = {c: names.index(c) for c in ("doc_id", "text", "source")}
        as_row = lambda r: {c: r[k] for c, k in at.items()}
        before = rows_of(docs)
        stages = dict(corpus_pipeline.STAGES)
        kept = stash(stages["quality"](spark, docs, SF))
        verdicts = Counter()
        for r in quality.judge(docs).collect():
            verdicts[r["doc_id"], r["n_words"]] += r["kept"]
        size = lambda r: len((r[at["text"]] or "").encode().split())
        assert Counter((r[at["doc_id"]], size(r)) for r in rows_of(kept)) == +verdicts and not Counter(rows_of(kept)) - Counter(before)
        assert kept.columns == names

        for start in (kept, docs):  # the stages below also on rows that the rules reject
            unique = stash(stages["exact_dedup"](spark, start, SF))
            content = lambda r: (r[at["text"]] or "").encode().translate(None, b" \t\n\x0b\x0c\r")
            best = {}
            for r in rows_of(start):
                best.setdefault(content(r), []).append(r)
            stay = lambda r: (-len(r[at["text"]] or ""), r[at["doc_id"]] is None, r[at["doc_id"]] or 0)
            got = {content(r): stay(r) for r in rows_of(unique)}
            assert got == {k: min(map(stay, g)) for k, g in best.items()} and unique.count() == len(best)
            assert unique.columns == names and not Counter(rows_of(unique)) - Counter(rows_of(start))

            apart = stash(stages["near_dedup"](spark, unique, SF))
            in_order = sorted(rows_of(unique), key=lambda r: (r[at["doc_id"]] is None, r[at["doc_id"]] or 0))
            want = brute_near([{**as_row(r), "doc_id": k} for k, r in enumerate(in_order)], 5, 4, 5)
            classes = Counter(component for _, _, component, _ in want)
            ids = [r[at["doc_id"]] for r in in_order]
            assert sorted(map(str, (r[at["doc_id"]] for r in rows_of(apart)))) == sorted(str(ids[c]) for c in classes) and apart.columns == names

            mixed = stash(stages["mixing"](spark, apart, SF))
            rows = rows_of(mixed)
            assert set(rows) <= set(rows_of(apart)) and max(Counter(rows).values(), default=0) <= 2 * max(Counter(rows_of(apart)).values(), default=1)
            total, longest = sum(map(size, rows_of(apart))), max(map(size, rows_of(apart)), default=0)
            assert abs(sum(map(size, rows)) - 1.5 * total) <= longest * len({r[at["source"]] for r in rows_of(apart)}) and mixed.columns == names

        library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
        want = Counter()
        for r in rows:
            text = r[at["text"]] or ""
            ids = library.encode(text, add_special_tokens=False).ids
            want[(r[at["doc_id"]], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
        assert Counter(tuple(r) for r in stages["bpe"](spark, mixed, SF).collect()) == want


def test_a_dropped_duplicate_goes_though_its_id_stays(spark):
    """Two rows of one id: one a copy of a longer text, one not."""
    docs = spark.createDataFrame([(1, "same words here ", "en", "a"), (2, "same words here", "en", "a"), (2, "other words there", "en", "a")], "doc_id long, text string, lang string, source string")
    assert sorted((r[0], r[1]) for r in rows_of(dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, SF))) == [(1, "same words here "), (2, "other words there")]


def test_run_and_empty(spark, empty):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
