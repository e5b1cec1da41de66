"""Quality scores by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is built from text labelled good, one from text labelled bad. The
two compressed sizes of a document give the normalised difference (bad - good) /
larger and the logarithm of the compression ratio; a logistic fit on labelled
documents that neither dictionary saw turns them into the probability of label 1.

Learning is bounded: at most max_docs labelled documents of each class, chosen by
a hash of their id, of which `fit_share` go to the dictionaries as at most
max_samples pieces of sample_chars characters, the others to the fit. Scoring reads
every whole text. Labels, language, source and id are no input to a score.

NULL text counts as empty; empty text gets the fit's value for two empty frames.
Labels that are neither 0 nor 1, and ids with both, teach nothing. Without both
classes every score is the share of label 1 (0.5 without labels). Repeated rows
score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.batches import slices


@dataclass(frozen=True)
class Settings:
    max_docs: int = 3000
    fit_share: float = 0.6
    max_samples: int = 2000
    sample_chars: int = 1500
    dictionary_bytes: int = 32_768
    level: int = 3
    ridge: float = 0.01


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    constant: float = 0.5
    level: int = 3

    def sizes(self) -> Sizes:
        return Sizes(self.good, self.bad, self.level)

    def scores(self, measured: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(measured), self.constant)
        x = np.c_[np.ones(len(measured)), (features(measured) - self.mean) / self.scale]
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


class Sizes:
    """Bytes of a text under the good dictionary, under the bad one, and plain."""

    def __init__(self, good: bytes, bad: bytes, level: int):
        import zstandard

        def compressor(d: bytes):
            kind = zstandard.ZstdCompressionDict(d)
            kind.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = compressor(good), compressor(bad)

    def of(self, texts: list[str | None]) -> np.ndarray:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return np.array([(len(self.good.compress(b)), len(self.bad.compress(b)), len(b)) for b in raw], float).reshape(-1, 3)

    def of_batch(self, batch: pa.RecordBatch, column: int) -> np.ndarray:
        """Of a column of texts, of which few are held as Python's at a time."""
        return np.concatenate([np.zeros((0, 3)), *(self.of(part.column(column).to_pylist()) for part in slices(batch, column, 256))])


def features(measured: np.ndarray) -> np.ndarray:
    good, bad, plain = measured.T
    a = (bad - good) / np.maximum(np.maximum(bad, good), 1)
    b = np.log((good + 8) / (plain + 8))
    return np.c_[a, b, a * a, b * b, a * b]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or, from too few samples for training, their own end."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" "


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the first column is the constant."""
    b, penalty = np.zeros(x.shape[1]), ridge * np.r_[0.0, np.ones(x.shape[1] - 1)] + 1e-9
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (w * p * (1 - p))[:, None]) + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - penalty * b)
        b += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _order(c: Column) -> Column:
    return F.md5(F.concat(F.lit("quality/"), c.cast("string")))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from the labelled rows given; which rows may be learned from is the caller's choice."""
    rows = labels.select(F.col(doc_id).alias("id_"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id_").isNotNull())
    rows = rows.groupBy("id_").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").drop("z")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    constant = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Model(constant=constant, level=settings.level)

    some = rows.filter("y = 0").orderBy(_order(F.col("id_")), "id_").limit(settings.max_docs).unionByName(rows.filter("y = 1").orderBy(_order(F.col("id_")), "id_").limit(settings.max_docs))
    share = F.conv(F.substring(F.md5(F.concat(F.lit("role/"), F.col("id_").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    known = docs.select(F.col(doc_id).alias("id_"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(some), "id_").withColumn("teach", share < settings.fit_share)

    n = settings.sample_chars
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("t") - 1) / n).cast("int")))
    taught = known.filter("teach").select("id_", "y", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("t"), i * n + 1, F.lit(n)))).alias("k", "s")).filter(F.length("s") > 0)
    samples: dict[int, list[bytes]] = {}
    for y in (0, 1):
        best = taught.filter(F.col("y") == y).orderBy(_order(F.concat_ws("/", F.col("id_").cast("string"), F.col("k"))), "s").limit(settings.max_samples)
        samples[y] = [r["s"].encode("utf-8", "surrogatepass") for r in best.select("s").collect()]
    if not all(samples.values()):
        return Model(constant=constant, level=settings.level)
    model = Model(dictionary(samples[1], settings.dictionary_bytes), dictionary(samples[0], settings.dictionary_bytes), constant=constant, level=settings.level)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model.sizes()
        for batch in batches:
            if batch.num_rows:
                got = sizes.of_batch(batch, 0)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got.T] + [batch.column(1)], ["good", "bad", "plain", "y"])

    rest = known.filter("not teach").select("t", "y").mapInArrow(measure, "good double, bad double, plain double, y int").toPandas()
    rest = rest.sort_values(["good", "bad", "plain", "y"])
    y = rest["y"].to_numpy(float)
    if len(set(y)) < 2:
        return Model(constant=constant, level=settings.level)
    x = features(rest[["good", "bad", "plain"]].to_numpy(float))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    # classes were drawn up to the same bound, so each row stands for its share of its class
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))
    weight *= len(y) / weight.sum()
    model.mean, model.scale = tuple(mean), tuple(scale)
    model.weights = tuple(logistic(np.c_[np.ones(len(x)), (x - mean) / scale], y, weight, settings.ridge))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs plus a score from 0 to 1; a column of that name is replaced. Other columns pass through as they are."""
    docs = docs.drop(into)
    names = [f.name for f in docs.schema]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sizes, at = (own.sizes() if own.weights else None), names.index(text)
        for batch in batches:
            got = own.scores(sizes.of_batch(batch, at) if sizes else np.zeros((batch.num_rows, 3)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*names, into])

    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def teachable(doc_id: str = "doc_id") -> Column:
    """Rows that may teach: the others are held out to judge the result."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % 5 != 0
