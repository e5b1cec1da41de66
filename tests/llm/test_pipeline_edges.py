from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"
#: Names that the stages use for columns of their own.
CLASHING = ["kept", "key", "row", "row_", "root", "copies", "quality_score_", "size", "source_", "n", "t", "repeated", "piece", "u_"]


def awkward(spark):
    """Repeated rows, rows of NULLs, an empty, a blank and a very long text, NULL ids and sources, more columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.orderBy("doc_id").limit(40)
    blank = docs.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema)).limit(1)
    rows = some.unionByName(some).unionByName(blank).unionByName(blank)
    values = [("text", F.lit("")), ("text", F.lit(" \n\t ")), ("text", F.repeat(F.concat("text", F.lit(" ")), F.lit(400)))]
    values += [("doc_id", F.lit(None).cast("long")), ("source", F.lit(None).cast("string")), ("lang", F.lit(None).cast("string"))]
    for name, value in values:
        rows = rows.unionByName(some.limit(1).withColumn(name, value))
    return rows.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
@pytest.mark.parametrize("empty", [True, False])
def test_stage_edges(spark, name, empty):
    docs = awkward(spark)
    if empty:
        docs = docs.limit(0)
    out = dict(p.STAGES)[name](spark, docs, SF)
    rows = out.collect()
    if empty:
        assert rows == []
    if name == p.STAGES[-1][0]:
        assert sum(r.piece == 0 for r in rows) == docs.count()
        return
    assert out.columns == docs.columns
    given, got = Counter(map(str, docs.collect())), Counter(map(str, rows))
    most = 2 if name == "source_mixing" else 1
    assert all(k <= most * given[r] for r, k in got.items())
    if name == "ngram_jaccard_join" and not empty:
        # one document is left of rows with the same text, but rows without words all stay
        texts = Counter(r.text for r in rows if (r.text or "").strip())
        assert max(texts.values()) == 1 and sum(not (r.text or "").strip() for r in rows) >= 3
