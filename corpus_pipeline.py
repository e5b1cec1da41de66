"""From raw documents to packed sequences: rules, classifier, near duplicates, mixing, packing.

Every stage takes what its predecessor kept, as written and read back, and works on
all of it. All but the last return the columns of documents. NULL and empty texts fail
the rules; NULL ids and repeated rows are documents like any other until the third
stage, which leaves one of those alike; an empty table gives an empty one; columns
besides those of documents pass through to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import mixing, ngram_join, packing, quality_classifier, quality_rules
from tallyframe.llm.queries import MIN_SCORE, TOKENIZER, table
from tallyframe.llm.shipping import ship
from tallyframe.storage import stage

#: No SQL: the classifier and the packing are not expressible in it.
ORACLE_SQL = None


def whole_rows(docs: DataFrame) -> list:
    """All columns as one, under a name that the operators do not use."""
    return [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_")]


def free_name(docs: DataFrame, name: str) -> str:
    """name, made longer until docs has no such column, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged = quality_rules.quality_rules(docs.select("text", "lang", *whole_rows(docs)), keep=["row_"])
    return judged.filter("kept").select("row_.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under MIN_SCORE go. It learns from labelled ones of all documents, as the rules left few bad ones, but for those held out."""
    ship(spark)
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(quality_classifier.teachable()))
    into = free_name(docs, "quality_score_")
    scored = quality_classifier.score(docs, model, into=into)
    return scored.filter(F.col(into) >= MIN_SCORE).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; five words, similarity 0.8."""
    ship(spark)
    return ngram_join.one_of_each(docs, ngram_join.Settings(words=5, percent=80))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as their source's target gives them, none, one or two."""
    # a column of the name that the mix adds goes through it under another
    names = {c: free_name(docs, c) if c.lower() == "copies" else c for c in docs.columns}
    mixed = mixing.mix(docs.withColumnsRenamed(names), keep=True).filter("copies > 0")
    mixed = mixed.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return mixed.select(*(F.col(f"`{n}`").alias(c) for c, n in names.items()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs, 2048, TOKENIZER, 0)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("ngram_jaccard_join", near_duplicates), ("source_mixing", mixture), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
