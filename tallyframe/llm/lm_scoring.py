"""Cross-entropy difference scores from two matched bigram models.

The target model counts target documents, the background model all documents. Both
share one vocabulary, every word of the corpus and the end of a document. With n the
counts of a model, N its number of words and ends, and V the size of the vocabulary,

    p(w)     = (n(w) + floor) / (N + floor * V)
    p(w | c) = (n(c, w) + bigram_mass * p(w)) / (n(c) + bigram_mass)

which each add up to 1 over the vocabulary. c is the word before, or the start, which
each document has once. Counts of the background are scaled to the target's total, so
that smoothing acts alike on both. A document is scored by models without itself: its
own counts are taken from the background, and from the target where it is one of it.

A document's score is background loss minus target loss per word (its end is one),
in nats: positive when it reads more like the target. A text without words (NULL,
empty) has no loss and score 0 and is in neither model. Repeated rows are documents
each for itself and score alike; ids of targets that no document has do nothing, and
NULL is no target. An empty table gives an empty one. Only doc_id and text of the
input are read, so other columns cannot clash.

Every word and every (previous, word) pair of the corpus is counted, and the counts
stay distributed: documents are cut into chunks, a chunk sends the keys it holds to
the buckets they belong to, a bucket adds them up and answers each chunk with the
counts of its own keys. Keys are 64-bit digests, of words and of pairs. Chunks and
buckets have a fixed size and grow in number with the corpus; only totals reach the
driver. A word that fills a third of the corpus is one key a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.batches import slices, words_of
from tallyframe.llm.text import sized_join
from tallyframe.storage import stage

#: In place of digests of words, which are larger.
START, END = 0, 1
#: Words a chunk holds at least, and keys a bucket holds about.
CHUNK_WORDS = 1 << 20
BUCKET_KEYS = 1 << 21
WORDS, PAIRS = 0, 1


@dataclass(frozen=True)
class Settings:
    bigram_mass: float = 50.0
    floor: float = 0.5


def probability(pair, context, word, total, types: int, settings: Settings):
    """p(w | c) from n(c, w), n(c), n(w), N and V."""
    single = (word + settings.floor) / (total + settings.floor * types)
    return (pair + settings.bigram_mass * single) / (context + settings.bigram_mass)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def digest(word: bytes) -> int:
    """Never START or END."""
    return max(2, int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    mixed = before * np.uint64(0x9E3779B97F4A7C15) + words * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def chunks_of(flagged: DataFrame) -> DataFrame:
    """Documents (id_, t, target) in chunks: the ids, lengths and target flags, the digests of all words once, and each word's place in them."""
    kind = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(flagged.schema["id_"].dataType)), T.StructField("distinct", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("lengths", "targets", "keys", "codes"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        ids, lengths, targets, codes, own, n = [], [], [], [], {}, 0

        def chunk() -> pa.RecordBatch:
            keys, place = np.unique(np.fromiter(map(digest, own), np.uint64, len(own)), return_inverse=True)
            every = pa.concat_arrays(ids)
            blobs = [pack(np.concatenate(lengths)), pack(np.concatenate(targets)), pack_sorted(keys), pack(place[np.concatenate(codes)])]
            listed = pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)
            return pa.RecordBatch.from_arrays([pa.array([first + made]), listed, pa.array([len(keys)]), *(pa.array([b], pa.binary()) for b in blobs)], kind.names)

        for batch in batches:
            for part in slices(batch, 1):
                found, bounds, distinct = words_of(part.column(1))
                place = np.fromiter((own.setdefault(w, len(own)) for w in distinct), np.int64, len(distinct))
                ids.append(part.column(0))
                lengths.append(np.diff(bounds))
                targets.append(part.column(2).to_numpy())
                codes.append(place[found])
                n += len(found) + part.num_rows
                if n >= CHUNK_WORDS:
                    yield chunk()
                    made, n = made + 1, 0
                    ids, lengths, targets, codes, own = [], [], [], [], {}
        if ids:
            yield chunk()

    return flagged.select("id_", "t", "target").mapInArrow(run, kind)


SENT = "kind int, bucket long, chunk long, keys binary, target binary, background binary"
ANSWER = "kind int, bucket long, chunk long, target binary, background binary"


@dataclass
class Tokens:
    """A chunk's words with the ends of documents, in the order of the texts; texts without words are left out."""

    lengths: np.ndarray  # of all texts, in words
    doc: np.ndarray  # each token's text
    begins: np.ndarray  # whether it is the first of its text
    keys: np.ndarray  # sorted distinct keys of words, END among them
    code: np.ndarray  # each token's place in keys
    pairs: np.ndarray  # sorted distinct keys of pairs
    pair: np.ndarray  # each token's place in pairs

    @classmethod
    def of(cls, row: dict) -> Tokens:
        lengths, keys, codes = unpack(row["lengths"]).astype(np.int64), unpack_sorted(row["keys"]), unpack(row["codes"]).astype(np.int64)
        doc = np.repeat(np.arange(len(lengths)), np.where(lengths > 0, lengths + 1, 0))
        begins = np.concatenate(([True], doc[1:] != doc[:-1]))[: len(doc)]
        ends = np.roll(begins, -1)
        code = np.zeros(len(doc), np.int64)
        code[~ends] = codes + 1
        keys = np.concatenate(([np.uint64(END)], keys))
        word = keys[code]
        before = np.where(begins, np.uint64(START), np.roll(word, 1))
        pairs, pair = np.unique(pair_keys(before, word), return_inverse=True)
        return cls(lengths, doc, begins, keys, code, pairs, pair)

    def own(self, code: np.ndarray, n: int) -> np.ndarray:
        """How often each token's code occurs in its text."""
        _, place, times = np.unique(self.doc * n + code, return_inverse=True, return_counts=True)
        return times[place]


def send(kind: int, chunk: int, keys: np.ndarray, code: np.ndarray, chosen: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys and their counts in a chunk, by the first bits of the key. chosen: the tokens of targets."""
    target, background = np.bincount(code[chosen], minlength=len(keys)), np.bincount(code, minlength=len(keys))
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
    edges = [0, *map(int, cuts), len(keys)]
    for bucket, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            yield pa.RecordBatch.from_pylist([{"kind": kind, "bucket": bucket, "chunk": chunk, "keys": pack_sorted(keys[a:b]), "target": pack(target[a:b]), "background": pack(background[a:b])}], pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("keys", "target", "background"))]))


def answered(sent: DataFrame) -> DataFrame:
    """Each chunk's keys' counts over all chunks. Chunk -1: the number of keys of a bucket, as its background."""

    def run(group: pa.Table) -> pa.Table:
        parts = [unpack_sorted(k) for k in group.column("keys").to_pylist()]
        keys, place = np.unique(np.concatenate(parts), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([unpack(x) for x in group.column(c).to_pylist()]), len(keys)) for c in ("target", "background")]
        ends = np.cumsum([len(p) for p in parts])
        target, background = ([pack(s[place[e - len(p) : e]]) for p, e in zip(parts, ends)] for s in sums)
        n = len(parts) + 1
        kind, bucket = group.column("kind")[0].as_py(), group.column("bucket")[0].as_py()
        return pa.table([pa.array([kind] * n, pa.int32()), pa.array([bucket] * n), pa.array([*group.column("chunk").to_pylist(), -1]), pa.array([*target, b""], pa.binary()), pa.array([*background, pack(np.array([len(keys)]))], pa.binary())], ["kind", "bucket", "chunk", "target", "background"])

    return sent.groupBy("kind", "bucket").applyInArrow(run, ANSWER)


def counts_in(answers: list[dict] | None, kind: int) -> np.ndarray:
    """2 x keys of the chunk, target and background."""
    rows = sorted((r for r in answers or [] if r["kind"] == kind), key=lambda r: r["bucket"])
    return np.array([np.concatenate([unpack(r[c]) for r in rows] or [np.zeros(0)]) for c in ("target", "background")], float)


def losses(tokens: Tokens, is_target: np.ndarray, words: np.ndarray, pairs: np.ndarray, totals: np.ndarray, n_docs: np.ndarray, types: int, settings: Settings) -> np.ndarray:
    """2 x texts, target and background loss per word, from counts (2 x keys) of all documents without the text's own."""
    own_word, own_pair = tokens.own(tokens.code, len(tokens.keys)), tokens.own(tokens.pair, len(tokens.pairs))
    own_before = np.where(tokens.begins, 1, np.roll(own_word, 1))
    mine = np.array([is_target > 0, np.ones(len(is_target), bool)])[:, tokens.doc]
    length = (tokens.lengths + 1)[tokens.doc]
    word = words[:, tokens.code]
    context = np.where(tokens.begins, n_docs[:, None], np.roll(word, 1, axis=1)) - mine * own_before
    scale = np.array([[1.0], [totals[0] / totals[1] if totals[1] else 1.0]])
    p = probability(scale * (pairs[:, tokens.pair] - mine * own_pair), scale * context, scale * (word - mine * own_word), scale * (totals[:, None] - mine * length), types, settings)
    n = len(tokens.lengths)
    return np.array([np.bincount(tokens.doc, x, n) for x in -np.log(p)]) / (tokens.lengths + 1)


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, target_loss, background_loss, score. targets: a frame with the ids (column doc_id) of target documents."""
    chosen = targets.select(F.col(doc_id).alias("id_")).filter(F.col("id_").isNotNull()).distinct().withColumn("target", F.lit(1))
    flagged = sized_join(docs.select(F.col(doc_id).alias("id_"), F.col(text).alias("t")), chosen, "id_", "left").select("id_", "t", F.coalesce("target", F.lit(0)).alias("target"))
    chunks = stage(chunks_of(flagged), "lm-chunks")
    made = chunks.agg(F.count(F.lit(1)), F.sum("distinct")).first()
    bits = {WORDS: int((made[1] or 0) // BUCKET_KEYS).bit_length(), PAIRS: int(made[0] * CHUNK_WORDS // BUCKET_KEYS).bit_length()}

    def send_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = Tokens.of(row)
                is_target = unpack(row["targets"])[tokens.doc] > 0
                yield from send(WORDS, row["chunk"], tokens.keys, tokens.code, is_target, bits[WORDS])
                yield from send(PAIRS, row["chunk"], tokens.pairs, tokens.pair, is_target, bits[PAIRS])

    answers = stage(answered(chunks.drop("ids", "distinct").mapInArrow(send_all, SENT)), "lm-counts")
    types = sum(int(unpack(r["background"])[0]) for r in answers.filter(f"chunk < 0 AND kind = {WORDS}").select("background").toLocalIterator())
    sizes = chunks.select("lengths", "targets").mapInArrow(_totals, "tokens long, docs long, target_tokens long, target_docs long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("target_tokens", "tokens", "target_docs", "docs"))).first()
    totals, n_docs = np.array(sizes[:2], float), np.array(sizes[2:], float)
    kind = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("target_loss", "background_loss", "score"))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            for i, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                tokens = Tokens.of(row)
                target, background = losses(tokens, unpack(row["targets"]), counts_in(row["counts"], WORDS), counts_in(row["counts"], PAIRS), totals, n_docs, types, settings)
                yield pa.RecordBatch.from_arrays([ids[i].values, pa.array(tokens.lengths), pa.array(target), pa.array(background), pa.array(background - target)], kind.names)

    told = answers.filter("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "target", "background")).alias("counts"))
    return chunks.join(told, "chunk", "left").mapInArrow(score, kind)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n, target = unpack(row["lengths"]).astype(np.int64), unpack(row["targets"]) > 0
            n = np.where(n > 0, n + 1, 0)
            yield pa.RecordBatch.from_pylist([{"tokens": int(n.sum()), "docs": int((n > 0).sum()), "target_tokens": int(n[target].sum()), "target_docs": int((n[target] > 0).sum())}])
