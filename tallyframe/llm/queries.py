"""One query an operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import html_text, lm_scoring, mixing, ngram_join, packing, quality_classifier, quality_rules, resharding, token_files, topk
from tallyframe.llm.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"
#: Documents scored below it are rejected.
MIN_SCORE = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), 2048, TOKENIZER, 0)


@query
def op2_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.quality_rules(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_lm_scoring(spark, sf_dir):
    targets = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents").select("doc_id", "text"), targets)


@query
def op5_token_files(spark, sf_dir):
    manifest = token_files.write_files(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary=TOKENIZER, end_id=2)
    return token_files.read_files(manifest)


@query
def op6_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels").filter(quality_classifier.teachable()))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", (~quality_classifier.teachable()).alias("held_out"), "score", (F.col("score") >= MIN_SCORE).cast("int").alias("predicted"))


@query
def op7_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


@query
def op8_ngram_jaccard_join(spark, sf_dir):
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), ngram_join.Settings(words=4, percent=85))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op9_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op10_resharding(spark, sf_dir):
    placed, _ = resharding.reshard(spark, resharding.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text")))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_TERM = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
_JS = f"{_TERM.format(a='p', b='q')} + {_TERM.format(a='q', b='p')}"

SQL["op2_quality_rules"] = rf"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), d AS (
    SELECT doc_id, t, ws, lang AS g, len(ws) AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS upper_,
        length(t) - length(regexp_replace(t, '\p{{Nd}}', '', 'g')) AS digits,
        length(t) - length(regexp_replace(t, '[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D#*$%&|<>]', '', 'g')) AS punct
    FROM docs
), lines AS (
    SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), grams AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM docs))
), repeats AS (
    SELECT doc_id, count(DISTINCT i + s) AS n FROM grams, (SELECT unnest([0, 1, 2]) AS s) WHERE k > 1 GROUP BY doc_id
), shares AS (
    SELECT doc_id, g, length(t) AS n, c, CAST(v AS DOUBLE) AS v FROM (
        SELECT doc_id, g, t, unnest([0, 1, 2, 3, 4, 5]) AS c,
            unnest([upper_, digits, n_symbols, punct, length(t) - word_chars, word_chars - upper_ - digits - n_symbols - punct]) AS v FROM d WHERE length(t) >= 200)
), bins AS (
    SELECT g, c, floor(1000 * v / n + 0.5) AS b FROM shares
), medians AS (
    SELECT g, c, quantile_disc(b, 0.5) AS m FROM (SELECT g, c, b FROM bins WHERE g <> '' UNION ALL SELECT '' AS g, c, b FROM bins) GROUP BY g, c
), class_ref AS (
    SELECT g, c, m / greatest(1, sum(m) OVER (PARTITION BY g)) AS q FROM medians
), class_dist AS (
    SELECT doc_id, sqrt(greatest(0, sum({_JS}) / 2)) AS dist FROM (SELECT doc_id, v / n AS p, q FROM shares JOIN class_ref USING (g, c)) GROUP BY doc_id
), said AS (
    SELECT doc_id, g, unnest(ws) AS w FROM d
), counted AS (
    SELECT g, w, count(*) AS n FROM said GROUP BY g, w
), totals AS (
    SELECT g, sum(n) AS total FROM (SELECT g, n FROM counted WHERE g <> '' UNION ALL SELECT '' AS g, n FROM counted) GROUP BY g
), best AS (
    SELECT g, w, n FROM (SELECT g, w, n, row_number() OVER (PARTITION BY g ORDER BY n DESC, w) AS r FROM (SELECT g, w, n FROM counted WHERE g <> '' UNION ALL SELECT '' AS g, w, sum(n) AS n FROM counted GROUP BY w) WHERE regexp_matches(w, '\p{{L}}')) WHERE r <= 32
), word_ref AS (
    SELECT g, w, n / total AS q FROM best JOIN totals USING (g)
), hits AS (
    SELECT doc_id, w, count(*) AS k FROM said WHERE (g, w) IN (SELECT (g, w) FROM word_ref) GROUP BY doc_id, w
), word_p AS (
    SELECT d.doc_id, coalesce(k, 0) / d.n_words AS p, q FROM d JOIN word_ref r ON r.g = d.g LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.w = r.w WHERE d.n_words >= 100
), word_all AS (
    SELECT doc_id, p, q FROM word_p UNION ALL SELECT doc_id, 1 - sum(p) AS p, greatest(0, 1 - sum(q)) AS q FROM word_p GROUP BY doc_id
), word_dist AS (
    SELECT doc_id, sqrt(greatest(0, sum({_JS}) / 2)) AS dist FROM word_all GROUP BY doc_id
), base AS (
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
        CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(class_dist.dist, 0) <= 0.22 AND coalesce(word_dist.dist, 0) <= 0.29 AS near
    FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN class_dist USING (doc_id) LEFT JOIN word_dist USING (doc_id)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND near AS kept FROM judged
"""

SQL["op3_source_mixing"] = r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM d GROUP BY source
), caps AS (
    SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM s
), parts AS (
    SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS part FROM caps
), level AS (
    SELECT arg_min(part, k) AS level FROM parts WHERE part <= cap / w
), plan AS (
    SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM parts, level
), rates AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS certain FROM plan
), r AS (
    SELECT *, greatest(0, target - certain * source_size) AS rest FROM rates
), m AS (
    SELECT d.doc_id, d.source, d.size, d.u, length(bin(d.size)) AS c, r.source_size, r.target, r.certain, r.rest, d.size > 0 AND d.size <= r.rest AS may FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), classes AS (
    SELECT source, c, sum(size) AS n, any_value(rest) AS rest FROM m WHERE may GROUP BY source, c
), units AS (
    SELECT source, c, (rest - coalesce(sum(n) OVER (PARTITION BY source ORDER BY c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(n * pow(2.0::DOUBLE, c)) OVER (PARTITION BY source ORDER BY c ROWS UNBOUNDED PRECEDING) AS unit FROM classes
), tops AS (
    SELECT source, coalesce(max(c) FILTER (unit * pow(2.0::DOUBLE, c) <= 1), -1) AS top, coalesce(arg_max(unit, c) FILTER (unit * pow(2.0::DOUBLE, c) <= 1), 0) AS unit FROM units GROUP BY source
), odds AS (
    SELECT m.*, coalesce(may AND c > top, FALSE) AS sure, least(1 - 1e-9, greatest(1e-12, coalesce(unit, 0) * pow(2.0::DOUBLE, c))) AS p FROM m LEFT JOIN tops t ON m.source IS NOT DISTINCT FROM t.source
), keys AS (
    SELECT *, (u / (1 - u)) / (p / (1 - p)) AS k, rest - coalesce(sum(size) FILTER (sure) OVER (PARTITION BY source), 0) AS left_ FROM odds
), firsts AS (
    SELECT *, floor(k / (1 + k) * 281474976710656.0::DOUBLE) AS r, may AND NOT sure AS first FROM keys
), one AS (
    SELECT *, first AND sum(size) FILTER (first) OVER (PARTITION BY source ORDER BY r, doc_id ROWS UNBOUNDED PRECEDING) <= left_ AS in_ FROM firsts
), two AS (
    SELECT *, left_ - coalesce(sum(size) FILTER (in_) OVER (PARTITION BY source), 0) AS gap FROM one
), seconds AS (
    SELECT *, first AND NOT in_ AND size <= gap AS second FROM two
), three AS (
    SELECT *, second AND sum(size) FILTER (second) OVER (PARTITION BY source ORDER BY r, doc_id ROWS UNBOUNDED PRECEDING) <= gap AS also FROM seconds
), sampled AS (
    SELECT *, in_ OR sure OR coalesce(also, FALSE) AS extra FROM three
), gaps AS (
    SELECT *, rest - coalesce(sum(size) FILTER (extra) OVER (PARTITION BY source), 0) AS open FROM sampled
), filler AS (
    SELECT source, arg_min(doc_id, (abs(size - open), u, doc_id)) AS best FROM gaps WHERE NOT extra AND size > 0 AND size < 2 * open GROUP BY source
)
SELECT g.doc_id, g.size, g.source_size, CAST(g.target AS DOUBLE) AS target,
    CAST(g.size * least(2, g.certain + CAST(g.extra AS INTEGER) + CASE WHEN g.doc_id = f.best THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM gaps g LEFT JOIN filler f ON g.source IS NOT DISTINCT FROM f.source
"""

SQL["op7_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
