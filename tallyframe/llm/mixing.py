"""Mixing sources to target weights by Pareto order sampling, in built-in column expressions only.

A source's target, in units of document size, fixes a rate: target / size of the
source. Every document gets the whole number of copies in the rate for certain. The
rest of the target is a sample without replacement of documents no larger than it.
A document's inclusion probability p goes by its weight, by default its size: in
proportion to 2 to the number of the weight's binary digits, so that all documents of
a class of weights are alike. Classes whose p would pass 1 are certain; what is left
of the target is dealt anew to the others. With u uniform in (0, 1) these are ranked
by (u / (1-u)) / (p / (1-p)) and taken in that order as far as they fit. Of those
passed over the ones that fit into the gap are ranked once more, and, last, the one
document is added whose size comes nearest to the gap left.

u comes from a hash of the document id, so reruns agree. Ties go by a hash of the
text; rows alike in id and text are interchangeable. NULL sources form one source,
NULL or empty documents have size 0 and are taken for certain only. Targets are
at most max_copies times the source, the excess is dealt to the others by weight.
An empty table gives an empty one; with keep, columns pass through under any name.

No source is gathered in one task. Ranks are numbers, and a source's sample is all
below a cut. It is found digit by digit: sizes are summed by source and digit
(combined before the shuffle), running sums over at most 2^DIGIT_BITS digits tell the
one where the target is reached, and only its documents go on to the next digit, until
at most EDGE_ROWS are left to be ordered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.text import words
from tallyframe.storage import stage

RANK_BITS, DIGIT_BITS, EDGE_ROWS = 48, 12, 200
#: The digits of a rank, then of the hash that tells equal ranks apart.
DIGITS = [("r_", s) for s in (36, 24, 12, 0)] + [("h_", s) for s in (51, 39, 27, 15, 3)]
WEIGHTS = (5.0, 2.0, 1.0)


def uniform(key: Column) -> Column:
    """In (0, 1), from the first 48 bits of an md5 digest."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, max_copies: float = 2.0) -> DataFrame:
    """source, source_size, target from a frame of (source_, size_). One row a source.

    Sources take the weights in turn, by code point, NULL last. The cap is met
    by water-filling: sorted by cap / weight, the first source whose cap is
    above its part of what the ones before it leave marks where caps end.
    """
    per = sizes.groupBy("source_").agg(F.sum("size_").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source_").asc_nulls_last())) - 1
    per = per.withColumn("w", F.get(F.array(*(F.lit(w) for w in weights)), (turn % len(weights)).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source_").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.least(F.lit(float(share)) * F.sum("source_size").over(everything), F.sum("cap").over(everything)))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("at", F.row_number().over(by_ratio)).withColumn("part", left / weight)
    free = F.when(F.col("part") <= F.col("cap") / F.col("w"), F.struct("at", "part"))
    per = per.withColumn("level", F.min(free).over(everything)["part"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return per.select("source_", "source_size", target.alias("target"))


def same_source(df: DataFrame, per: DataFrame, how: str = "left") -> DataFrame:
    """Sources may be few or many: Spark chooses the join by the size of the written frame. per has the source as s_."""
    return df.join(per, F.col("source_").eqNullSafe(F.col("s_")), how).drop("s_")


def inclusion(rows: DataFrame) -> DataFrame:
    """s_, top_ (classes above it are certain) and unit_ (p of a class is unit_ * 2^class) from rows that may be sampled (source_, class_, size_, rest)."""
    per = rows.groupBy("source_", "class_").agg(F.sum("size_").alias("n"), F.first("rest").alias("rest"))
    two = F.expr("cast(shiftleft(1L, class_) as double)")
    up = Window.partitionBy("source_").orderBy(F.desc("class_")).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("source_").orderBy("class_").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("unit_", (F.col("rest") - F.coalesce(F.sum("n").over(up), F.lit(0))) / F.sum(F.col("n") * two).over(down))
    fits = F.when(F.col("unit_") * two <= 1, F.struct("class_", "unit_"))
    best = per.groupBy(F.col("source_").alias("s_")).agg(F.max(fits).alias("x"))
    return best.select("s_", F.coalesce("x.class_", F.lit(-1)).alias("top_"), F.coalesce("x.unit_", F.lit(0.0)).alias("unit_"))


def cut(rows: DataFrame, budget: str) -> DataFrame:
    """s_, cut_ (first (r_, h_, row_id_) that is not taken; no row where all are) and reached_ (the size of those before it).

    rows: source_, size_, r_, h_, row_id_ and the budget, alike within a source.
    """
    inside, edge = rows.withColumn("below_", F.lit(0).cast("long")), None
    for column, shift in DIGITS:
        digit = F.shiftright(F.col(column), shift)
        per = inside.groupBy("source_", digit.alias("d_")).agg(F.sum("size_").alias("n"), F.count(F.lit(1)).alias("k"), F.first("below_").alias("below_"), F.first(budget).alias("budget"))
        before = Window.partitionBy("source_").orderBy("d_").rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("below_", F.col("below_") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        full = per.filter(F.col("below_") + F.col("n") > F.col("budget")).groupBy("source_").agg(F.min(F.struct("d_", "below_", "k")).alias("e"))
        edge = stage(full.select(F.col("source_").alias("s_"), F.col("e.d_").alias("e_"), F.col("e.below_").alias("below_"), F.col("e.k").alias("k")), "mix-edge")
        inside = same_source(inside.drop("below_"), edge.drop("k"), "inner").filter(digit == F.col("e_")).drop("e_")
        if (edge.agg(F.max("k")).first()[0] or 0) <= EDGE_ROWS:
            break
    order = Window.partitionBy("source_").orderBy("r_", "h_", "row_id_").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("run_", F.col("below_") + F.sum("size_").over(order))
    taken, at = F.col("run_") <= F.col(budget), F.struct("r_", "h_", "row_id_")
    per = inside.groupBy(F.col("source_").alias("s_")).agg(F.min(F.when(~taken, at)).alias("cut_"), F.coalesce(F.max(F.when(taken, F.col("run_"))), F.min("below_")).alias("reached_"))
    return stage(per, "mix-cut")


def mix(docs: DataFrame, size: Column | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text", weight: str | None = None, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, max_copies: float = 2.0, keep: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    size defaults to the number of words, weight (a column of whole numbers) to the size; documents of weight 0 or
    NULL are in no sample. With keep, all columns of docs are kept and only the column copies is added, or replaced.
    """
    n = F.coalesce(size if size is not None else F.size(words(F.col(text))), F.lit(0)).cast("long")
    id_, src = F.col(doc_id), F.col(source)
    own = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else n
    columns = [id_.alias("doc_id_"), src.alias("source_"), n.alias("size_"), F.when(own > 0, F.length(F.bin(own))).alias("class_"), uniform(id_).alias("u_"), F.xxhash64(F.col(text)).alias("hash_"), F.monotonically_increasing_id().alias("row_id_")]
    through = [c for c in docs.columns if c != "copies"]
    rows = stage(docs.select(*columns, *([F.struct(*(F.col(f"`{c}`") for c in through)).alias("row_")] if keep else [])), "mix-sizes")

    plan = source_targets(rows, share, weights, max_copies)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("certain", F.floor(rate + 1e-12).cast("int"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size"))).withColumnRenamed("source_", "s_")
    plan = stage(plan, "mix-plan")
    rows = same_source(rows, plan)

    may = (F.col("size_") > 0) & (F.col("size_") <= F.col("rest")) & F.col("class_").isNotNull()
    thin = rows.drop("row_")
    odds_of = stage(inclusion(thin.filter(may)), "mix-inclusion")
    sure = same_source(thin.filter(may), odds_of).filter("class_ > top_").groupBy(F.col("source_").alias("s_")).agg(F.sum("size_").alias("sure_"))
    odds_of = stage(odds_of.join(sure.withColumnRenamed("s_", "t_"), F.col("s_").eqNullSafe(F.col("t_")), "left").drop("t_").withColumn("sure_", F.coalesce("sure_", F.lit(0))), "mix-odds")

    def ranked(df: DataFrame) -> DataFrame:
        df = same_source(df, odds_of).withColumn("sure", F.coalesce(may & (F.col("class_") > F.col("top_")), F.lit(False)))
        p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), F.coalesce("unit_", F.lit(0.0)) * F.coalesce(F.expr("cast(shiftleft(1L, class_) as double)"), F.lit(0.0))))
        key = (F.col("u_") / (1 - F.col("u_"))) / (p / (1 - p))
        # key / (1 + key) spreads the ranks
        df = df.withColumn("r_", F.floor(key / (1 + key) * float(1 << RANK_BITS))).withColumn("h_", F.xxhash64("hash_").bitwiseAND(F.lit((1 << 63) - 1)))
        return df.withColumns({"first_": F.coalesce(may & ~F.col("sure"), F.lit(False)), "left_": F.col("rest") - F.col("sure_")})

    def with_cut(df: DataFrame, found: DataFrame, into: str, gap: str, left: str) -> DataFrame:
        """df plus the rows taken in a pass and the gap after it. Where all rows fit nothing was cut, and no gap is left to fill from them."""
        df = same_source(df, found)
        key = F.struct("r_", "h_", "row_id_")
        return df.withColumns({into: F.col("cut_").isNull() | (key < F.col("cut_")), gap: F.col(left) - F.col("reached_")}).drop("cut_", "reached_")

    # written in between, so that no plan holds those of the steps before it
    thin = stage(ranked(thin).select("doc_id_", "source_", "size_", "u_", "hash_", "row_id_", "rest", "sure", "r_", "h_", "first_", "left_"), "mix-ranked")
    first = cut(thin.filter("first_"), "left_")

    def twice(df: DataFrame) -> DataFrame:
        df = with_cut(df, first, "in_", "gap_", "left_").withColumn("in_", F.col("first_") & F.col("in_"))
        return df.withColumn("second_", F.coalesce(F.col("first_") & ~F.col("in_") & (F.col("size_") <= F.col("gap_")), F.lit(False)))

    thin = stage(twice(thin), "mix-passed")
    second = cut(thin.filter("second_"), "gap_")
    spare_sum = stage(thin.groupBy(F.col("source_").alias("s_")).agg(F.sum(F.when(F.col("second_"), F.col("size_"))).alias("second_sum_"), F.sum(F.when(F.col("in_") | F.col("sure"), F.col("size_"))).alias("in_sum_")), "mix-sums")

    def sampled(df: DataFrame) -> DataFrame:
        df = with_cut(df, second.withColumnRenamed("reached_", "again_").withColumn("reached_", F.lit(0)), "also_", "unused_", "gap_").drop("unused_")
        df = df.withColumn("also_", F.col("second_") & F.col("also_"))
        df = same_source(df, spare_sum)
        taken = F.coalesce("in_sum_", F.lit(0)) + F.coalesce("again_", "second_sum_", F.lit(0))
        return df.withColumn("extra", F.col("in_") | F.col("sure") | F.col("also_")).withColumn("open_", F.col("rest") - taken)

    near = (F.col("size_") > 0) & (F.col("size_") < 2 * F.col("open_")) & ~F.col("extra")
    off = F.struct(F.abs(F.col("size_") - F.col("open_")).alias("off"), "u_", "doc_id_", "hash_", "row_id_")
    best = stage(sampled(thin).filter(near).groupBy(F.col("source_").alias("s_")).agg(F.min(off)["row_id_"].alias("best")), "mix-best")
    placed = same_source(sampled(twice(ranked(rows))), best)
    filler = F.coalesce(F.col("row_id_") == F.col("best"), F.lit(False))
    copies = F.least(F.lit(int(max_copies)), F.coalesce(F.col("certain"), F.lit(0)) + F.col("extra").cast("int") + filler.cast("int"))
    if keep:
        return placed.select(*(F.col(f"row_.`{c}`") for c in through), copies.alias("copies"))
    return placed.select(F.col("doc_id_").alias("doc_id"), F.col("source_").alias("source"), F.col("size_").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("size_")).alias("taken"))
