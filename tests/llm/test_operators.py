"""Each operator against a plain version, on small tables with NULL, empty, long, tied and repeated rows."""

import collections
import html as references
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import html_text, lm_scoring, mixing, ngram_join, packing, quality_classifier, quality_rules, queries, resharding, token_files, tokens, topk
from tallyframe.llm.shipping import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, kept string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("the", "of", "an", "ing", "er", "Ou") for b in ("", "a", "ble", "tion.", "st,", "é")]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((3, 60, 150, 400)))), rng.choice(("en", "fr", None)), rng.choice(("a", "b", "c", None)), "x") for i in range(60)]
    rows += [(100 + i, r[1].replace("the", "thy", 1), *r[2:]) for i, r in enumerate(rows[:10])]
    rows += [(200, None, None, None, None), (201, "", "en", "a", ""), (202, "one", "xx", "a", None), (203, "a b c\n\na b c\n a", "en", None, "y"), (None, "no id at all", "en", "b", "z")]
    rows += [(204, "Same Words here again\t" * 3000, "en", "a", None)] * 2 + [(3, rows[3][1], *rows[3][2:])]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    ship(spark)
    return spark.createDataFrame(texts, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_rules_measures(spark, docs, texts):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(texts)

    def plain(s):
        w = WORD.findall(s or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        lines = [x for x in (s or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s or "")), len(lines) - len(set(lines)), len(covered)

    want = sorted((str(r[0]), *plain(r[1])) for r in texts)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_rules_reject_what_diverges(spark):
    rng = random.Random(1)
    clean = [(i, " ".join(rng.choices(["the", "of", "and", "sand", "river", "To"], [9, 6, 5, 2, 2, 1], k=200)), "en") for i in range(30)]
    odd = [(90, clean[0][1].upper(), "en"), (91, clean[1][1].replace(" ", "*** "), "en")]
    rules = quality_rules.Rules(max_repeat_percent=101)
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string"), rules).filter("kept OR NOT kept").collect()}
    assert [i for i, kept in got.items() if not kept] == [90, 91]


def test_rules_count_long_words(spark):
    """A language of long words has common words too."""
    rng = random.Random(2)
    own, other = (["grundlage", "verfahren", "wasserwerk", "hauptstadt", "zwischenzeit"], ["abfahrten", "beispiele", "damaligen", "fernmelder", "kirchentagen"])
    rows = [(i, " ".join(rng.choices(own if i < 30 else other, [9, 6, 5, 2, 2], k=150)), "de") for i in range(32)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), quality_rules.Rules(max_repeat_percent=101)).collect()
    assert sorted(r.doc_id for r in got if not r.kept) == [30, 31]


def test_rules_reject_symbols_beyond_ascii(spark):
    """Too few words for the word comparison: the classes must tell."""
    rng = random.Random(3)
    clean = [(i, " ".join(rng.choices(["the", "of", "and", "sand", "river", "To"], [9, 6, 5, 2, 2, 1], k=200)), "en") for i in range(30)]
    odd = [(90 + i, " ".join("".join(rng.choices(signs, k=4)) for _ in range(60)), "en") for i, signs in enumerate(("▓░█═║╬", "😀😂🎉🔥", "“”„—…", "。、「」！"))]
    got = quality_rules.quality_rules(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string"), quality_rules.Rules(max_repeat_percent=101)).collect()
    assert sorted(r.doc_id for r in got if not r.kept) == [90, 91, 92, 93]


@pytest.mark.parametrize("broadcast", [20_000, 10])
def test_rules_hold_every_language_against_its_own(spark, monkeypatch, broadcast):
    rng = random.Random(4)
    monkeypatch.setattr(quality_rules, "BROADCAST_LANGUAGES", broadcast)
    rows = []
    for k in range(80):
        own = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(5)]
        rows += [(100 * k + i, " ".join(rng.choices(own, [9, 6, 5, 2, 2], k=150)), f"l{k:02}") for i in range(200 if k == 0 else 15)]
    odd = [(9000, rows[0][1], "l79"), (9001, rows[-1][1], "l00"), (9002, rows[-1][1].upper(), "l79"), (9003, rows[0][1], None)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string"), quality_rules.Rules(max_repeat_percent=101)).collect()
    assert len(got) == len(rows) + len(odd)
    assert {r.doc_id for r in got if not r.kept} - {9003} == {9000, 9001, 9002}


def test_js_distance(spark):
    d = spark.range(1).select(quality_rules.js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("a"), quality_rules.js_distance(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("b")).first()
    assert (d.a, d.b) == (1.0, 0.0)


def test_mixing(spark, docs, texts):
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts)
    size = lambda s: len(WORD.findall(s or ""))
    totals = collections.Counter()
    for r in texts:
        totals[r[3]] += size(r[1])
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(totals.values()), set(names)
    while True:
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if part[s] > 2 * totals[s]]
        if not over:
            target |= part
            break
        for s in over:
            target[s] = 2 * totals[s]
            left -= target[s]
            free.discard(s)
    taken = collections.Counter()
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"]) and r.source_size == totals[r.source]
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(size(r[1]) for r in texts if r[3] == s) / 2 + 1
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mix(empty(spark)).count() == 0
    kept = mixing.mix(docs, keep=True)
    assert kept.columns == [*docs.columns, "copies"] and kept.agg(F.sum("copies")).first()[0] == sum(r.copies for r in got)


def test_mixing_goes_by_size(spark):
    """Inclusion rates go by the class of sizes, classes beyond 1 are certain, and what is over is dealt to the others."""
    rng = random.Random(11)
    sizes = [rng.choice((3, 6, 12, 24)) for _ in range(4000)] + [1500] * 10
    df = spark.createDataFrame([(i, n, "a", "w") for i, n in enumerate(sizes)], "doc_id long, n long, source string, text string")
    got = {r.doc_id: r for r in mixing.mix(df, size=F.col("n"), share=0.5).collect()}
    total = sum(sizes)
    assert abs(sum(r.taken for r in got.values()) - total / 2) <= 3
    assert all(r.copies == 1 for r in got.values() if r["size"] == 1500)
    rate = {n: sum(r.copies for r in got.values() if r["size"] == n) / sizes.count(n) for n in (3, 6, 12, 24)}
    unit = (total / 2 - 15_000) / sum(n * 2 ** n.bit_length() for n in sizes if n < 1500)
    assert all(abs(rate[n] - unit * 2 ** n.bit_length()) < 0.06 for n in rate) and unit * 32 < 1
    # a text too long for what is left is passed over
    few = spark.createDataFrame([(0, 400, "a", ""), *((i, 6, "a", "") for i in range(1, 101))], "doc_id long, n long, source string, text string")
    assert 290 <= sum(r.taken for r in mixing.mix(few, size=F.col("n"), share=0.3).collect()) <= 310
    # thousands of rows with one id
    one = spark.createDataFrame([(7, 5, "a", f"t{i % 3}") for i in range(3000)], "doc_id long, n long, source string, text string")
    assert sum(r.taken for r in mixing.mix(one, size=F.col("n"), share=0.5).collect()) == 7500


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_encoder(texts, reference_ids):
    odd = ["", " a", "a ", "x  y", "I'm don't 'quoted' it's", "a\tb", "a\n\nb", "naïve—dash “q” 12,5 3rd...", "<|endoftext|> hi", "a <|endoftext|> b", "x<|endoftext|>\n<|endoftext|>", "<|endo ftext|> <|", "foo\n bar \nbaz", "a.\nB,c!!! d***", "日本語 テスト。 ok", "x'll, y's. z'", "a_b, c-d; 1st, 2nd!", None]
    odd += [r[1] for r in texts]
    got = tokens.Encoder.of("byte_bpe_50k.json").encode(odd)
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in got] == [reference_ids(s) for s in odd]
    assert reference_ids("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_encoder_puts_pieces_in_a_row(reference_ids):
    """Lines and words go to the tokenizer many at once, each distinct one a single time, and texts get the ids of plain calls."""
    texts = [f"Line{'abcdefghij'[i % 10] * (i % 7)} word{i % 5}, 's\nLine{i}'s end.### {i} \u00e9t\u00e9\n'll" for i in range(300)]
    encoder, calls = tokens.Encoder(tokens.vocabulary()), []

    class Counted:
        def encode_batch_fast(self, some, **options):
            calls.extend(some)
            return plain.encode_batch_fast(some, **options)

    plain, encoder.tokenizer = encoder.tokenizer, Counted()
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [reference_ids(t) for t in texts]
    assert len(calls) < 20
    calls.clear()
    encoder.encode(texts)
    assert calls in ([], [""])


def test_packing(spark, docs, texts, reference_ids):
    got = packing.pack_documents(docs, 256).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for d, s, *_ in texts:
        ids = [*reference_ids(s), 0]
        times = sum(r[0] == d for r in texts)
        rows = sorted(by_doc[d], key=lambda r: r.piece)[::times]
        assert sum(r.length for r in rows) == len(ids) and all(r.length == 256 for r in rows[1:])
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.05 * math.ceil(sum(r.length for r in got) / 256)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_best_fit_counts_equal_item_by_item():
    rng = random.Random(3)
    items = [rng.randint(1, 100) for _ in range(500)]
    bins = []
    for s in sorted(items, reverse=True):
        fits = [b for b in bins if sum(b) + s <= 100]
        if fits:
            max(fits, key=sum).append(s)
        else:
            bins.append([s])
    counts = collections.Counter(items)
    got = packing.best_fit(counts, 100)
    assert packing.bins_of(got) == len(bins)
    used = collections.Counter()
    for p, n in got.items():
        used.update({s: k * n for s, k in collections.Counter(p).items()})
    assert used == counts


def test_genetic_search_beats_best_fit(spark):
    """Sixty items that fill twenty bins in threes: best-fit needs more bins, the search fewer than best-fit."""
    rng, counts = random.Random(0), collections.Counter()
    for _ in range(20):
        a = rng.randint(380, 490)
        b = rng.randint(255, (1000 - a) // 2)
        counts.update([a, b, 1000 - a - b])
    plain = packing.bins_of(packing.best_fit(counts, 1000))
    assert packing.lower_bound(counts, 1000) == 20 < plain
    found = packing.pack_lengths(spark, counts, 1000)
    used = collections.Counter()
    for p, n in found.items():
        assert sum(p) <= 1000
        used.update({s: k * n for s, k in collections.Counter(p).items()})
    assert used == counts and packing.bins_of(found) < plain
    a = packing.crossover(found, packing.best_fit(counts, 1000), counts, 1000, random.Random(0))
    assert sum(len(p) * n for p, n in a.items()) == sum(counts.values())


def test_classifier_holds_few_texts_at_a_time(monkeypatch):
    sizes, held = quality_classifier.Sizes(b"good words of a text", b"bad ### words", 3), []
    batch = pa.RecordBatch.from_pydict({"text": [None, *(f"text {i} " * (i % 9) for i in range(2000))]})
    want, plain = sizes.of(batch.column(0).to_pylist()), quality_classifier.Sizes.of
    monkeypatch.setattr(quality_classifier.Sizes, "of", lambda self, texts: held.append(len(texts)) or plain(self, texts))
    assert (sizes.of_batch(batch, 0) == want).all() and sum(held) == 2001 and max(held) <= 256
    assert sizes.of_batch(batch.slice(0, 0), 0).shape == (0, 3)


def test_rules_order_only_words_as_common_as_the_last_listed(spark):
    rows = [("a", f"w{i}", 10 - i) for i in range(6)] + [("b", "x", 1), ("b", "y", 1)] + [("c", f"w{i}", 5) for i in range(4)]
    least = quality_rules.least_counts(spark.createDataFrame(rows, "g string, w string, n long"), 3)
    assert sorted((r.g, r.least_) for r in least.collect()) == [("a", 8), ("c", 5)]


def test_exact_fit_meets_the_bound_without_a_search():
    """Lengths as those of documents, where best-fit needs more sequences: no Spark task is needed."""
    rng = random.Random(1)
    counts = collections.Counter(min(2048, 40 + int(rng.expovariate(1 / 600))) for _ in range(20_000))
    bound = packing.lower_bound(counts, 2048)
    assert packing.bins_of(packing.best_fit(counts, 2048)) > bound
    found = packing.pack_lengths(None, counts, 2048)
    used = collections.Counter()
    for p, n in found.items():
        assert sum(p) <= 2048
        used.update({s: k * n for s, k in collections.Counter(p).items()})
    assert used == counts and packing.bins_of(found) == bound
    assert packing.exact_fit({}, 10) == {} and packing.exact_fit({5: 3}, 10) == {(5, 5): 1, (5,): 1}


def test_lower_bound():
    """Never above the least number of bins, found by trying all; large items that exclude each other are seen."""
    assert packing.lower_bound({60: 10}, 100) == 10 and packing.lower_bound({70: 3, 40: 2, 30: 3}, 100) == 4

    def least(items, bins=()):
        if not items:
            return len(bins)
        s, rest = items[0], items[1:]
        tries = [least(rest, bins[:i] + (b + s,) + bins[i + 1 :]) for i, b in enumerate(bins) if b + s <= 20]
        return min([*tries, least(rest, (*bins, s))])

    rng = random.Random(4)
    for _ in range(40):
        items = [rng.randint(3, 20) for _ in range(7)]
        assert packing.lower_bound(collections.Counter(items), 20) <= least(sorted(items, reverse=True)) <= packing.bins_of(packing.best_fit(collections.Counter(items), 20))


def test_token_files(spark, docs, texts, reference_ids, monkeypatch):
    manifest = token_files.write_files(docs)
    got = token_files.read_files(manifest).collect()
    assert len(got) == len(texts)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = next([*reference_ids(t[1]), 2] for t in texts if t[0] == r.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert token_files.read_documents(spark, manifest, [7]) == {7: [*reference_ids(texts[7][1]), 2]}
    assert token_files.read_files(token_files.write_files(empty(spark))).count() == 0
    opened, open_file = [], token_files.open_file
    monkeypatch.setattr(token_files, "open_file", lambda p: opened.append(p) or open_file(p))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    several = token_files.write_files(docs)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(token_files.read_documents(spark, several, [7, 203, 99_999])) == {7, 203} and len(opened) <= 2 < several.count()
    assert token_files.read_documents(spark, manifest, []) == {}


def test_damaged_frame(tmp_path):
    with open(tmp_path / "f.zst", "wb") as f:
        w = token_files.Writer(f)
        w.add(1, b"abcd" * 10)
        w.add(None, b"efgh")
        w.close()
    data = bytearray((tmp_path / "f.zst").read_bytes())
    reader = token_files.open_file(f"file://{tmp_path}/f.zst")
    assert reader.ids == [1, None] and reader.document(1) == b"efgh"
    data[12] ^= 1
    (tmp_path / "f.zst").write_bytes(data)
    with pytest.raises(Exception):  # noqa: B017  the frame or its checksum, whichever notices first
        token_files.open_file(f"file://{tmp_path}/f.zst").document(0)


def test_classifier(spark):
    rng = random.Random(2)
    words = ["river", "stone", "of", "the", "and", "lantern", "harbour", "willow"]
    good = [" ".join(rng.choices(words, k=120)) for _ in range(80)]
    bad = [" ".join(f"{w}$$#" for w in rng.choices(words, k=120)) for _ in range(60)]
    rows = [(i, t, int(i < 80)) for i, t in enumerate(good + bad)] + [(900, None, None), (901, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    ship(spark)
    labels = df.select("doc_id", "quality").filter(quality_classifier.teachable())
    got = quality_classifier.score(df, quality_classifier.fit(df.drop("quality"), labels)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.quality is not None]
    assert sum((r.score >= 0.3) == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    one = quality_classifier.fit(df, labels.filter("quality = 1"))
    assert {r.score for r in quality_classifier.score(df, one).collect()} == {1.0}
    assert {r.score for r in quality_classifier.score(df, quality_classifier.fit(df, labels.limit(0))).collect()} == {0.5}


def lm_brute(rows, targets, settings=lm_scoring.Settings()):
    """Scores by plain counting, each document out of both models; and the counts."""
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    word, pair, context = ([collections.Counter(), collections.Counter()] for _ in range(3))
    total = [0, 0]

    def own(ws):
        seq = [*ws, ("end",)]
        return collections.Counter(seq), collections.Counter(zip([("start",), *ws], seq)), collections.Counter([("start",), *ws])

    for d, ws in texts:
        for k in (0, 1) if d in targets else (1,):
            if ws:
                for counter, c in zip((word, pair, context), own(ws)):
                    counter[k].update(c)
                total[k] += len(ws) + 1
    types, scale = len(word[1]), (1.0, total[0] / total[1])
    out = []
    for d, ws in texts:
        loss = [0.0, 0.0]
        if ws:
            w, p, c = own(ws)
            for k in (0, 1):
                minus = 1 if k or d in targets else 0
                for b, x in zip([("start",), *ws], [*ws, ("end",)]):
                    counts = (pair[k][b, x] - minus * p[b, x], context[k][b] - minus * c[b], word[k][x] - minus * w[x], total[k] - minus * (len(ws) + 1))
                    loss[k] -= math.log(lm_scoring.probability(*(scale[k] * n for n in counts), types, settings))
        out.append((str(d), len(ws), loss[0] / (len(ws) + 1), loss[1] / (len(ws) + 1)))
    return sorted(out), (word, pair, context, total, types, scale)


def test_lm_scores(spark):
    rng = random.Random(4)
    ship(spark)
    own = lambda ws: " ".join(rng.choices(ws, k=80))
    rows = [(i, own(["blue", "sea", "wave", "and", "the"])) for i in range(40)] + [(100 + i, own(["law", "court", "case", "and", "the"])) for i in range(40)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "once"), (303, "once"), (None, "the sea"), (304, "the sea " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, chunk string").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(df, df.filter("doc_id < 20")).collect()}
    assert min(got[i].score for i in range(40)) > max(got[100 + i].score for i in range(40))
    assert got[300].score == got[301].score == got[302].score == 0 and got[300].n_words == 0
    # a target's own words do not raise its score: those left out of the targets score alike
    mean = lambda ids: sum(got[i].score for i in ids) / len(ids)
    assert abs(mean(range(20)) - mean(range(20, 40))) < 0.1
    assert lm_scoring.cross_entropy_difference(df, df.limit(0)).filter("score is null").count() == 0


def test_lm_probabilities_add_up():
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abcdefg", k=rng.randint(1, 30)))) for i in range(50)] + [(99, "rare")]
    _, (word, pair, context, total, types, scale) = lm_brute(rows, set(range(9)))
    for k in (0, 1):
        for c in [("start",), "a", "g", "rare", "unseen"]:
            p = [lm_scoring.probability(*(scale[k] * n for n in (pair[k][c, w], context[k][c], word[k][w], total[k])), types, lm_scoring.Settings()) for w in word[1]]
            assert sum(p) == pytest.approx(1, abs=1e-9)


def test_lm_scores_count_every_word_and_pair(spark, monkeypatch):
    """Many words and pairs, over several chunks and buckets."""
    rng = random.Random(6)
    ship(spark)
    monkeypatch.setattr(lm_scoring, "CHUNK_WORDS", 60_000)
    monkeypatch.setattr(lm_scoring, "BUCKET_KEYS", 50_000)
    rows = [(i, " ".join(f"w{rng.randrange(80_000)}" for _ in range(400))) for i in range(1000)] + [(5000, None), (5001, ""), (7, "w1 once w2"), (None, "w1 w2"), (None, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_scoring.cross_entropy_difference(df, df.filter("doc_id < 300")).collect()
    want, (_, pair, *_) = lm_brute(rows, set(range(300)))
    assert len(pair[1]) > 1 << 18
    found = sorted((str(r.doc_id), r.n_words, r.target_loss, r.background_loss) for r in got)
    assert [r[:2] for r in found] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in found], [r[2:] for r in want], rtol=1e-9)
    assert all(r.score == pytest.approx(r.background_loss - r.target_loss) for r in got)
    assert lm_scoring.cross_entropy_difference(empty(spark), df).count() == 0


@pytest.mark.parametrize("copies", [0, 300])
def test_top_k(spark, copies):
    rng = np.random.default_rng(7)
    ship(spark)
    x = rng.normal(size=(400, 8)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[50].tolist()) for i in range(copies)]
    odd = [(5000, None), (5001, [1.0, None]), (5002, [float("nan")] * 8), (5050, [float("inf")] * 8), (5003, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block=4, batch=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    v = {i: np.floor(256 * np.array(e)).astype(int) for i, e in rows}
    assert set(got) == {i for i in v if i % 50 == 0}
    for q in got:
        best = sorted(((-int(v[q] @ w), i) for i, w in v.items() if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in best]


def test_top_k_edges(spark):
    ship(spark)
    kind = "vec_id long, embedding array<double>, id string, rank int"
    none = spark.createDataFrame([], kind)
    assert topk.top_k(none, F.col("vec_id") % 50 == 0).count() == 0
    rows = [(0, [1.0, 2.0], "x", 1), (0, [9.0, 9.0], "x", 1), (1, [3.0, 1.0], "x", 1), (None, [1.0, 1.0], "x", 1), (2, [], "x", 1), (3, [3.0, 1.0], "x", 1)]
    got = topk.top_k(spark.createDataFrame(rows, kind), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 5 * 65536), (3, 5 * 65536)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e300], "", 0), (1, [1e300], "", 0)], kind), F.col("vec_id") == 0).collect()


def clustered(n, centers, spread, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, 16)) * 1000
    return np.floor(middle[rng.integers(0, centers, n)] + rng.normal(size=(n, 16)) * spread)


def test_cover_tree_keeps_its_invariants():
    for x in (clustered(3000, 40, 20), np.floor(np.random.default_rng(1).normal(size=(500, 2)) * 1e4), np.zeros((50, 3))):
        tree, stack = topk.cover_tree(x), []
        assert sorted(tree.points.tolist()) == list(range(len(x)))
        stack, internal = [tree], 0
        while stack:
            node = stack.pop()
            assert np.sqrt(((x[node.points] - node.center) ** 2).sum(1)).max() <= node.radius + 1e-6 and node.radius <= 2.0**node.level
            if node.children:
                internal += 1
                centers = np.array([c.center for c in node.children])
                apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2)) + np.eye(len(centers)) * 1e18
                assert apart.min() > 2.0 ** (node.level - 1) and all(c.radius <= 2.0 ** (node.level - 1) for c in node.children)
                assert sorted(np.concatenate([c.points for c in node.children]).tolist()) == sorted(node.points.tolist())
                stack += node.children
        assert internal or not x.any()


def test_dual_search_prunes():
    """On clustered vectors most pairs are never scored, and the result is that of all pairs."""
    x = clustered(6000, 60, 15)
    q, ids = x[::50], np.arange(len(x))
    best = topk.Best(ids[::50], 5)
    scored = topk.dual_search(topk.cover_tree(q), q, topk.cover_tree(x), x, ids, best)
    assert scored < 0.2 * len(q) * len(x)
    for i, row in enumerate(q @ x.T):
        want = sorted(((-int(v), j) for j, v in enumerate(row) if j != ids[::50][i]))[:5]
        assert [(-int(v), int(j)) for v, j in zip(best.score[i], best.id[i])] == want


def brute_groups(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return sorted((str(d), len(sets[i]), str(min((x for x in low[find(i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("settings", [(4, 85, 2, 32), (5, 80, 2, 32), (3, 60, 0, 2)])
def test_near_duplicates(spark, docs, texts, settings):
    words, percent, rounds, few = settings
    got = ngram_join.near_duplicates(docs, ngram_join.Settings(words, percent, rounds, group_pairs=few, group_block=3)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_groups([r[:2] for r in texts], words, percent)


def test_one_of_each(spark, docs, texts):
    kept = ngram_join.one_of_each(docs, ngram_join.Settings(4, 85))
    assert kept.columns == docs.columns
    groups = {g for d, _, g in brute_groups([r[:2] for r in texts], 4, 85)}
    ids = collections.Counter(str(r.doc_id) for r in kept.collect())
    assert set(ids) == groups | {"None"} and ids["204"] == 1 and ids["3"] == 1
    assert ngram_join.one_of_each(empty(spark)).count() == 0


def test_tree_of_whole_sets_is_exact():
    rng = random.Random(9)
    sets = [np.array(sorted(rng.sample(range(40), rng.randint(1, 30))), np.uint64) for _ in range(60)]
    tree = ngram_join.Tree(sets[0][:0], 0)
    for i, s in enumerate(sets):
        tree.add(i, s, len(s))
    for probe in sets:
        want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(probe, s)) >= 70 * len(np.union1d(probe, s))}
        assert set(tree.linked(probe, len(probe), 70)) == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="no-sidebar"><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Big&nbsp;news &amp; more</h1><p>First <b>para</b>graph one.<br><p>Second &lt;one&gt; 5 < 6.
<div class="ad">Buy</div><form><input>Name</form><section id="comments"><p>nice post</p></section></article><aside>Side</aside><footer>&copy; us</footer>"""


def test_html(spark):
    tree = html_text.train()
    assert all(tree.decide(r[:-1]) == r[-1] for r in html_text.LABELLED)
    assert html_text.main_text(PAGE, tree) == "Big news & more First paragraph one. Second <one> 5 < 6."
    assert html_text.main_text("", tree) == html_text.main_text(None, tree) == html_text.main_text("<p", tree) == ""
    plain = "<ul><li><a>Home</a><li><a>About</a></ul>" + "<p>" + "word " * 60 + "<p>" + "more " * 70 + "<div class='footer'>foot</div>"
    assert html_text.main_text(plain, tree).split() == ["word"] * 60 + ["more"] * 70
    ship(spark)
    df = spark.createDataFrame([(1, PAGE, "old"), (2, None, None)], "page_id long, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got[2] == ("", 0) and got[1][1] == len(got[1][0])


def test_html_weighs_length_and_links_around_articles():
    tree = html_text.train()
    body, links = "<p>" + "word " * 90 + "<p>" + "more " * 80, "<ul>" + "<li><a>Read also this</a>" * 6 + "</ul>"
    assert html_text.main_text(f"<div>{body}</div><article><p>A card</article>", tree).split()[:170] == ["word"] * 90 + ["more"] * 80
    assert html_text.main_text(f"<article>{body}{links}</article>", tree).split() == ["word"] * 90 + ["more"] * 80
    assert html_text.main_text(f"<article>{body}{body}</article><div><p>{'also ' * 150}</div><p>{'brief ' * 30}", tree).split() == 2 * (["word"] * 90 + ["more"] * 80) + ["also"] * 150
    assert html_text.main_text(f"<article>{body}<div class='ad'><a>Buy this</a></div>{body}</article>", tree).split() == 2 * (["word"] * 90 + ["more"] * 80)


def test_html_names_that_may_be_text():
    tree = html_text.train()
    body = "<p>" + "word " * 90 + "<p>" + "more " * 80
    words = ["word"] * 90 + ["more"] * 80
    for name in ('id="discussion"', 'class="related-work"', 'class="legal-history"'):
        assert html_text.main_text(f"<article>{body}<section {name}><h2>On it</h2>{body}</section></article>", tree).split() == [*words, "On", "it", *words]
        assert html_text.main_text(f"<article>{body}<section {name}><a>Read on</a><p><a>And on</a></section></article>", tree).split() == words
    for name in ('class="related-posts"', 'class="ad-slot"', 'id="comments"', 'class="site-footer"'):
        assert html_text.main_text(f"<article>{body}<section {name}><h2>On it</h2>{body}</section></article>", tree).split() == words
    assert html_text.main_text("<body><p>Short page only.</p></body>", tree) == "Short page only."


def test_html_unclosed_elements_take_no_longer():
    import time

    began = time.perf_counter()
    html_text.main_text("<p>a " + "<svg>" * 60_000, html_text.train())
    assert time.perf_counter() - began < 5


def test_html_of_pages(spark):
    ship(spark)
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries.QUERIES["op9_html_extraction"](spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br|li|ul)>", " ", inner))
        assert got[r.page_id] == " ".join(references.unescape(inner).split())


def shard_sizes(rows, n):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for some in by.values():
        assert sorted(r.slot for r in some) == list(range(len(some)))
    return [sum(r["size"] for r in by[j]) for j in range(n)]


def test_resharding(spark, docs, texts, tmp_path):
    layout = resharding.Layout(old_shards=3, new_shards=4, docs_per_file=5)
    placed, done = resharding.reshard(spark, resharding.write_shards(docs, layout, f"file://{tmp_path}/some"), new_shards=4)
    got = placed.collect()
    assert sorted((str(r.doc_id), str(r.text), r["size"]) for r in got) == sorted((str(r[0]), str(r[1]), len((r[1] or "").encode()) + 1) for r in texts)
    sizes = shard_sizes(got, 4)
    assert max(sizes) - min(sizes) <= max(r["size"] for r in got)
    assert resharding.reshard(spark, resharding.write_shards(empty(spark), layout, f"file://{tmp_path}/none"))[0].count() == 0


def test_resharding_writes_only_affected_files(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, "x" * rng.randint(20, 60)) for i in range(4000)]
    folder = resharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), resharding.Layout(12, 16, 20), f"file://{tmp_path}/shards")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "shards").rglob("*.parquet")}
    was = {r.doc_id: r.shard for r in resharding.read_shards(spark, folder, "long").collect()}
    placed, done = resharding.reshard(spark, folder, new_shards=16)
    got = placed.collect()
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "shards").rglob("*.parquet")}
    untouched = [p for p in before if after.get(p) == before[p]]
    assert len(untouched) == done.kept_files and len(before) == done.kept_files + done.written_files and len(untouched) > len(before) / 2
    assert sum(r["size"] for r in got if was[r.doc_id] != r.shard) == done.moved_bytes
    total = sum(r["size"] for r in got)
    assert done.planned_bytes <= done.moved_bytes + 16 * 61 and done.moved_bytes <= done.planned_bytes + 0.01 * total
    assert done.written_bytes < total / 2
    sizes = shard_sizes(got, 16)
    assert len(got) == 4000 and max(sizes) - min(sizes) <= sorted(r["size"] for r in got)[2000]


def test_flow_moves_least():
    rng = random.Random(6)
    for _ in range(20):
        n, m = rng.randint(1, 5), rng.randint(1, 6)
        supply = [rng.randint(0, 50) for _ in range(n)]
        total = sum(supply)
        capacity = [total // m + (j < total % m) for j in range(m)]
        flow = resharding.min_cost_flow(supply, capacity, lambda i, j: 0 if i == j else 1)
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow)] == capacity
        stay = sum(min(supply[i], capacity[i]) for i in range(min(n, m)))
        assert sum(f for i, r in enumerate(flow) for j, f in enumerate(r) if i != j) == total - stay


def test_empty_tables(spark):
    ship(spark)
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string, text string")).count() == 0
    nothing = quality_classifier.fit(empty(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_classifier.score(empty(spark), nothing).count() == 0
    assert ngram_join.near_duplicates(empty(spark)).count() == 0


def test_names_of_working_columns_pass_through(spark):
    ship(spark)
    rows = [(1, "a b c d e f", "k", "r", "w", "n", "g"), (1, "a b c d e f", "k", "r", "w", "n", "g"), (2, "x y z", "k", "r", "w", "n", "g"), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, repeated_ string, row_ string, near string, lang string").withColumn("source", F.lit("a"))
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]
    mixed = mixing.mix(df, keep=True)
    assert mixed.columns == [*df.columns, "copies"] and mixed.filter("row_ = 'w'").count() == 3
    judged = quality_rules.quality_rules(df)
    assert judged.columns == [*df.columns, *quality_rules.MEASURES] and judged.filter("near = 'n' AND row_ = 'w'").count() == 3
    scored = quality_classifier.score(df, quality_classifier.fit(df, spark.createDataFrame([], "doc_id long, quality int")))
    assert scored.columns == [*df.columns, "score"]
