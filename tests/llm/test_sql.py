"""The corpus operators that have SQL, row by row against DuckDB."""

from collections import Counter

import duckdb
import pytest

from spanlark.llm.exact_dedup import exact_groups
from spanlark.llm.queries import oracle_sql, queries
from tests.llm.conftest import SF

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_exact_dedup_matches_sql(spark, size):
    folder, con = SF.replace("0.001", size), duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(oracle_sql()["op5_exact_dedup"])
    assert sorted(d[0] for d in want.description) == sorted(COLUMNS)
    got = queries()["op5_exact_dedup"](spark, folder).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall()) and got


def test_exact_dedup_matches_sql_on_odd_rows(spark, odd):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(r["doc_id"], r["text"]) for r in odd.collect()])
    got = exact_groups(odd).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(con.execute(oracle_sql()["op5_exact_dedup"]).fetchall())
