import duckdb
import pytest

import corpus_pipeline as p
from tallyframe.llm import queries
from tallyframe.storage import stage

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for name, f in p.STAGES[:-1]:
        docs = stage(f(spark, docs, SF), name)
        assert docs.columns == columns
        rows = docs.collect()
        assert all(texts[r.doc_id] == r.text for r in rows)
        seen.append([r.doc_id for r in rows])
    assert set(seen[1]) <= set(seen[0]) < set(texts) and set(seen[2]) <= set(seen[1]) and set(seen[3]) <= set(seen[2])
    assert len(set(seen[2])) == len(seen[2]) and max(map(seen[3].count, set(seen[3]))) <= 2
    last = p.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in last if r.piece == 0) == sorted(seen[3])
