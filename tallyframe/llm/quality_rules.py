"""Quality rules by distribution divergence, in built-in column expressions only.

Each document's character-class histogram and common-word histogram is compared
with references for its language by Jensen-Shannon distance (base 2, 0 to 1).
The references are gathered from all documents of the language, for every
language; documents without one (NULL) are held against the pooled reference. Short
texts say little about a distribution, so each comparison has a minimum length,
under which it does not reject.

The comparison is local to a row: the only shuffles are those of the word
counts and class sums, which are combined before they travel. The references are
a written table, one row a language, joined to the documents; it is broadcast
while it has at most BROADCAST_LANGUAGES rows. Only the pooled row reaches the driver.
The judged rows are written once and read back, so that a filter on the verdict
reads them instead of computing the measures anew.

NULL text counts as empty and fails the base rules, as every text under
min_words words does. Repeated rows are judged alike, each for itself. An empty
table gives an empty one. Columns of the input pass through, whatever their names,
but those named as a result are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.text import WORD, sized_join, words
from tallyframe.storage import stage

#: Character classes besides white space and everything else, as patterns.
CLASSES = (r"\p{Lu}", r"\p{Nd}", r"[#*$%&|<>]", r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D#*$%&|<>]")
#: Runs of these belong to no class of the above; without them a text is short.
PLAIN = "[a-z ]+"
POOLED = ""
BROADCAST_LANGUAGES = 20_000
#: Parts in which the most common words of a language are sought before they meet.
RANK_PARTS = (64, 8)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 32
    min_class_chars: int = 200
    max_class_distance: float = 0.22
    min_word_count: int = 100
    max_word_distance: float = 0.29


def counted_classes(df: DataFrame) -> DataFrame:
    """df (text_) plus words_, word_chars and counts_, the characters of each class, of white space and of everything else."""
    df = df.withColumn("words_", words(F.col("text_"))).withColumn("short_", F.regexp_replace("text_", PLAIN, ""))
    df = df.withColumn("word_chars", F.length(F.concat_ws("", "words_")).cast("long"))
    whole = F.length("text_").cast("long")
    df = df.withColumn("counts_", F.array(*(F.regexp_count("short_", F.lit(p)).cast("long") for p in CLASSES), whole - F.col("word_chars"))).drop("short_")
    rest = whole - F.aggregate("counts_", F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn("counts_", F.concat("counts_", F.array(rest)))


def best_words(counted: DataFrame, n: int) -> DataFrame:
    """The n most common words of each language, rank r: in parts of a language first, so that no task reads what all others found."""
    order = (F.desc("n"), "w")
    for parts in RANK_PARTS:
        part = F.pmod(F.xxhash64("w"), F.lit(parts))
        counted = counted.withColumn("part_", part).withColumn("r", F.row_number().over(Window.partitionBy("g", "part_").orderBy(*order))).filter(F.col("r") <= n).drop("part_", "r")
    return counted.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter(F.col("r") <= n)


def least_counts(counted: DataFrame, n: int) -> DataFrame:
    """g and least_, the count of the n-th most common word of a language; languages of fewer words have no row."""
    per = counted.groupBy("g", "n").agg(F.count(F.lit(1)).alias("k"))
    down = Window.partitionBy("g").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    return stage(per.withColumn("run", F.sum("k").over(down)).filter(F.col("run") >= n).groupBy("g").agg(F.max("n").alias("least_")), "least-counts")


def references(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """Gather the references from all documents: a row a language and the pooled one, with lang_ (POOLED for the latter),
    class_ref_ (class shares), word_ref_ (common words by rank) and share_ref_ (their shares, the last one of all other words).

    Class shares are medians over documents of at least min_class_chars, in
    thousandths, so that a minority of junk does not move them; a common word
    holds a letter.
    """
    docs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text_"), F.coalesce(F.col(lang), F.lit(POOLED)).alias("g"))
    # One pass: the words, and the shares of classes as tags that hold a space
    counts = counted_classes(docs)
    tags = F.transform("counts_", lambda x, i: F.concat_ws(" ", i.cast("string"), F.floor(F.lit(1000) * x / F.length("text_") + 0.5).cast("string")))
    some = F.when(F.length("text_") >= rules.min_class_chars, tags).otherwise(F.array().cast("array<string>"))
    said = counts.withColumn("tags_", some).select("g", F.explode(F.concat("words_", "tags_")).alias("w"))
    counted = stage(said.groupBy("g", "w").agg(F.count(F.lit(1)).alias("n")), "word-counts")

    tag = F.split("w", " ")
    binned = counted.filter(F.col("w").contains(" ")).select("g", F.get(tag, 0).cast("int").alias("c"), F.get(tag, 1).cast("int").alias("b"), "n")
    binned = binned.filter(F.col("g") != POOLED).unionByName(binned.groupBy("c", "b").agg(F.sum("n").alias("n")).withColumn("g", F.lit(POOLED)))
    ranks = Window.partitionBy("g", "c")
    below = F.sum("n").over(ranks.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    # the lower median
    medians = binned.withColumn("half", 2 * below >= F.sum("n").over(ranks)).filter("half").groupBy("g", "c").agg(F.min("b").alias("b"))
    per = medians.groupBy("g").agg(F.array(*(F.coalesce(F.max(F.when(F.col("c") == k, F.col("b"))), F.lit(0)) for k in range(len(CLASSES) + 2))).alias("m"))
    sums = F.greatest(F.lit(1), F.aggregate("m", F.lit(0), lambda s, x: s + x))
    classes = per.select(F.col("g").alias("lang_"), F.transform("m", lambda x: x / sums).alias("class_ref_"))

    counted = counted.filter(~F.col("w").contains(" "))
    totals = counted.groupBy("g").agg(F.sum("n").alias("total"))
    totals = totals.filter(F.col("g") != POOLED).unionByName(totals.agg(F.sum("total").alias("total")).select(F.lit(POOLED).alias("g"), "total"))
    pooled = counted.groupBy("w").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("g"), "w", "n")
    lettered = F.col("w").rlike(r"\p{L}")
    own = counted.filter((F.col("g") != POOLED) & lettered)
    # only words as common as the last one listed are put in order; in all languages together that count is no less than in any one
    least = least_counts(own, rules.common_words)
    own = sized_join(own, least, "g", "left", BROADCAST_LANGUAGES).filter(F.col("n") >= F.coalesce("least_", F.lit(0))).drop("least_")
    most = least.agg(F.coalesce(F.max("least_"), F.lit(0)).alias("most_"))
    pooled = pooled.filter(lettered).crossJoin(F.broadcast(most)).filter("n >= most_").drop("most_")
    best = best_words(own.unionByName(pooled), rules.common_words).join(totals, "g")
    listed = best.groupBy(F.col("g").alias("lang_")).agg(F.sort_array(F.collect_list(F.struct("r", "w", (F.col("n") / F.col("total")).alias("q")))).alias("best"))
    others = F.greatest(F.lit(0.0), 1 - F.aggregate("best", F.lit(0.0), lambda s, x: s + x["q"]))
    listed = listed.select("lang_", F.col("best.w").alias("word_ref_"), F.concat(F.col("best.q"), F.array(others)).alias("share_ref_"))
    return stage(classes.join(listed, "lang_", "full").select("lang_", *(F.coalesce(n, default).alias(n) for n, default in _nothing().items())), "references")


def _nothing() -> dict[str, Column]:
    """The reference of no documents."""
    return {"class_ref_": F.array(*[F.lit(0.0)] * (len(CLASSES) + 2)), "word_ref_": F.array().cast("array<string>"), "share_ref_": F.array(F.lit(1.0))}


def with_reference(docs: DataFrame, ref: DataFrame) -> DataFrame:
    """docs (lang_) plus the reference of their language, or the pooled one."""
    df = sized_join(docs, ref.filter(F.col("lang_") != POOLED), "lang_", "left", BROADCAST_LANGUAGES)
    pooled = ref.filter(F.col("lang_") == POOLED).first()
    array = lambda v, kind: F.array(*(F.lit(x) for x in v)).cast(f"array<{kind}>")
    default = {n: array(pooled[n], "string" if n == "word_ref_" else "double") for n in _nothing()} if pooled else _nothing()
    return df.withColumns({n: F.coalesce(n, c) for n, c in default.items()})


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2."""
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def repeated_windows(df: DataFrame) -> DataFrame:
    """df (words_, n_words) plus near_: ascending positions of 3-word windows whose hash another window of the text has.

    A window is a hash above its position in one number; after sorting, equal hashes are neighbours.
    """
    w = F.col("words_")
    df = df.withColumn("bits_", F.when(F.col("n_words") > 1 << 24, F.lit(32)).otherwise(F.lit(24)))
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    df = df.withColumn("hashes_", F.slice(hashes, 1, F.greatest(F.lit(0), F.size(w) - 2)))
    place = lambda x, i: F.call_function("shiftleft", x, F.col("bits_")).bitwiseOR(i.cast("long"))
    # most texts say nothing twice, and need no order
    twice = F.size(F.array_distinct("hashes_")) < F.size("hashes_")
    df = df.withColumn("keys_", F.when(twice, F.sort_array(F.transform("hashes_", place))).otherwise(F.array().cast("array<bigint>"))).drop("hashes_")
    s = F.col("keys_")
    alike = lambda x, y: F.call_function("shiftrightunsigned", x.bitwiseXOR(y), F.col("bits_")) == 0
    df = df.withColumn("pairs_", F.filter(F.transform(s, lambda x, j: F.when(alike(x, F.get(s, j + 1)), j)), lambda j: j.isNotNull()))
    at = lambda j: F.get(s, j).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits_")) - 1).cast("int")
    return df.withColumn("near_", F.array_distinct(F.flatten(F.transform("pairs_", lambda j: F.array(at(j), at(j + 1)))))).drop("bits_", "keys_", "pairs_")


def measured(df: DataFrame) -> DataFrame:
    """df (text_) plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and words_ and counts_."""
    df = counted_classes(df).withColumn("n_words", F.size("words_").cast("long")).withColumn("n_symbols", F.get("counts_", F.lit(2)))
    df = df.withColumn("lines_", F.filter(F.split("text_", "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("n_dup_lines", (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long")).drop("lines_")
    df = repeated_windows(df)
    # The hash only found candidates: the windows themselves decide
    said = F.transform("near_", lambda i: F.struct(F.concat_ws(" ", F.get("words_", i), F.get("words_", i + 1), F.get("words_", i + 2)).alias("g"), i.alias("i")))
    df = df.withColumn("grams_", F.sort_array(said)).drop("near_")
    g = F.col("grams_")
    same = lambda x, j: F.coalesce(x["g"] == F.get(g, j)["g"], F.lit(False))
    twice = F.filter(g, lambda x, j: same(x, j + 1) | same(x, j - 1))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return df.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("grams_")


def common_pattern(word_ref: Column) -> Column:
    """A pattern for whole words that are one of the common ones."""
    quoted = F.transform(word_ref, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit(rf"(?<!{WORD[:-1]})(?:"), F.array_join(quoted, "|"), F.lit(rf")(?!{WORD[:-1]})"))


def judged(df: DataFrame, ref: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """df (text_, lang_) plus the measures, class_distance, word_distance (NULL under the minimum length), base_failed and kept."""
    df = measured(with_reference(df, ref))
    whole = F.length("text_").cast("double")
    df = df.withColumn("class_distance", F.when(whole >= rules.min_class_chars, js_distance(F.transform("counts_", lambda x: x / whole), F.col("class_ref_"))))

    n, size = F.col("n_words").cast("double"), F.size("word_ref_")
    some = (size > 0) & (n >= rules.min_word_count)
    said = F.regexp_extract_all("text_", common_pattern(F.col("word_ref_")), F.lit(0))
    df = df.withColumn("found_", F.when(some, said).otherwise(F.array().cast("array<string>"))).withColumn("n_found_", F.size("found_"))
    # each word between spaces of its own: the bytes gone with a word tell how often it was there, and the next has less to go through
    df = df.withColumn("found_", F.concat(F.lit(" "), F.array_join("found_", "  "), F.lit(" ")))
    rest = lambda s, w: F.replace(s["rest"], F.concat(F.lit(" "), w, F.lit(" ")), F.lit(""))
    without = lambda s, w: F.struct(rest(s, w).alias("rest"), F.concat(s["left"], F.array(F.octet_length(s["rest"]))).alias("left"))
    gone = F.aggregate("word_ref_", F.struct(F.col("found_").alias("rest"), F.array().cast("array<int>").alias("left")), without, lambda s: F.concat(s["left"], F.array(F.octet_length(s["rest"]))))
    df = df.withColumn("left_", gone)
    hits = F.transform("word_ref_", lambda w, i: (F.get("left_", i) - F.get("left_", i + 1)) / (F.octet_length(w) + 2) / n)
    own = F.concat(hits, F.array(1.0 - F.col("n_found_") / n))
    df = df.withColumn("word_distance", F.when(n >= rules.min_word_count, js_distance(own, F.col("share_ref_"))))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    near = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= rules.max_class_distance) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= rules.max_word_distance)
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & near)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (those of keep, if given) plus MEASURES, one row per row of docs."""
    through = [c for c in docs.columns if (keep is None or c in keep) and c not in MEASURES]
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in through)).alias("row_")
    df = docs.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text_"), F.coalesce(F.col(f"`{lang}`"), F.lit(POOLED)).alias("lang_"))
    done = judged(df, references(docs, rules, f"`{text}`", f"`{lang}`"), rules)
    return stage(done.select(*(F.col(f"row_.`{c}`") for c in through), *MEASURES), "judged")
