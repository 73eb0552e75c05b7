"""The newest queries against their SQL in DuckDB."""

import duckdb
import pytest

from gridloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op12_merkle_manifest", "op13_prefix_trie"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = con.execute(oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[names.index(c)] for c in columns]) for r in got.fetchall())
