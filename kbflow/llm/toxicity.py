"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NGRAMS = (3, 4, 5)
BITS = 18
#: Rows of each class that a model is fitted on at most, those of the smallest hashes of their ids: with at most
#: 2**BITS features a row this bounds the driver's memory; typical rows have a hundredth of that.
SAMPLE = 1500
#: Features of the whole sample that a fit takes at most, by default: with SAMPLE this bounds the driver's memory
#: however long the sampled texts are. Rows beyond it, in order of their hash, are no part of the sample.
ENTRIES = 24_000_000
THRESHOLD = 0.7
#: Entries of features that a step of the fit works on together.
PART = 1 << 20


def characters(text: str | None) -> np.ndarray:
    """The code points of a text, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    raw[(raw >= 65) & (raw <= 90)] += 32
    return raw


def features(text: str | None, ngrams: tuple[int, ...] = NGRAMS, bits: int = BITS) -> np.ndarray:
    """The hashed n-grams of characters that occur in a whole text, ascending and once each."""
    raw = characters(text)
    mark = _mark(bits)
    for n in ngrams:
        m = len(raw) - n + 1
        for at in range(0, m, 1 << 20):
            size = min(1 << 20, m - at)
            h = np.full(size, n, np.uint32)
            for k in range(n):
                h = (h * np.uint32(0x01000193)) ^ raw[at + k : at + k + size]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            mark[h & np.uint32((1 << bits) - 1)] = True
    found = np.flatnonzero(mark)
    mark[found] = False
    return found


_marks: dict[int, np.ndarray] = {}


def _mark(bits: int) -> np.ndarray:
    if bits not in _marks:
        _marks[bits] = np.zeros(1 << bits, bool)
    return _marks[bits]


@dataclass
class Model:
    """weights: of each hashed n-gram, with its log-count ratio multiplied in."""

    weights: np.ndarray
    bias: float
    ngrams: tuple[int, ...] = NGRAMS
    bits: int = BITS

    def score(self, text: str | None) -> float:
        z = float(self.weights[features(text, self.ngrams, self.bits)].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray, l2: float = 1e-3, steps: int = 150, rate: float = 0.05, ngrams: tuple[int, ...] = NGRAMS, bits: int = BITS) -> Model:
    """Regularised logistic regression on presence times log-count ratio, full batches, the same on every run.

    Without rows of both classes there is nothing to tell apart: every score is then the share of label 1 (0.5 without rows).
    """
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        share = np.clip(labels.mean() if len(labels) else 0.5, 1e-6, 1 - 1e-6)
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), ngrams, bits)
    filled = np.array([i for i, r in enumerate(rows) if len(r)], np.int64)
    sizes = np.array([len(rows[i]) for i in filled], np.int64)
    ends = np.cumsum(sizes)
    index = np.concatenate([rows[i] for i in filled]).astype(np.int32, copy=False) if len(filled) else np.zeros(0, np.int32)
    size = 1 << bits
    cuts = np.searchsorted(ends, np.arange(0, len(index), PART), side="left") if len(filled) else []
    parts = [(lo, hi, int(ends[lo] - sizes[lo]), int(ends[hi - 1])) for lo, hi in zip(cuts, [*cuts[1:], len(filled)], strict=True) if lo < hi]

    def summed(of_row: np.ndarray) -> np.ndarray:
        """For each feature the sum of ``of_row`` over the rows that have it; a part at a time, so that nothing of all entries' size is made."""
        out = np.zeros(size)
        for lo, hi, s, e in parts:
            out += np.bincount(index[s:e], weights=np.repeat(of_row[filled[lo:hi]], sizes[lo:hi]), minlength=size)
        return out

    p, q = 1 + summed(labels), 1 + summed(1 - labels)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())  # both classes count alike
    w, b = np.zeros(size), 0.0
    mean, var, mean_b, var_b = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.full(len(labels), b)
        scaled = w * ratio
        for lo, hi, s, e in parts:
            z[filled[lo:hi]] += np.add.reduceat(scaled[index[s:e]], ends[lo:hi] - sizes[lo:hi] - s)
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) * weight
        grad, grad_b = summed(off) * ratio + l2 * w, off.sum()
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        mean_b, var_b = 0.9 * mean_b + 0.1 * grad_b, 0.99 * var_b + 0.01 * grad_b * grad_b
        step = rate / (1 - 0.9**t)
        w -= step * mean / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
        b -= step * mean_b / (np.sqrt(var_b / (1 - 0.99**t)) + 1e-8)
    return Model((w * ratio).astype(np.float32), float(b), ngrams, bits)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()).astype(np.int32).tobytes() for t in batch.column(0)]
        yield pa.record_batch([pa.array(rows, pa.binary()), batch.column(1), batch.column(2)], names=["x", "label", "h"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """A model from the labelled rows: ``sample`` rows of each class at most, in the order of xxhash64(id); only these texts are read.

    Rows with a null id, or a label other than 0 and 1, teach nothing; of rows that repeat an id the least text does.
    The sample is two times ``sample`` ids with ``entries`` features at most, a size that no input changes, so its side
    of the join with the texts is broadcast.
    """
    own = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("label")).where("k IS NOT NULL AND label IN (0, 1)").distinct()
    own = own.withColumn("h", F.xxhash64("k"))
    chosen = own.where("label = 1").orderBy("h", "k").limit(sample).unionByName(own.where("label = 0").orderBy("h", "k").limit(sample))
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    held = texts.join(F.broadcast(chosen), "k").groupBy("k", "label", "h").agg(F.min("text").alias("text"))
    found = held.select("text", "label", "h").mapInArrow(_sample, "x binary, label int, h long")
    rows, kept, total = sorted(found.collect(), key=lambda r: (r.h, r.label, r.x)), [], 0
    for r in rows:
        if (total := total + len(r.x) // 4) > entries:
            break
        kept.append(r)
    return fit([np.frombuffer(r.x, np.int32) for r in kept], np.array([r.label for r in kept]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row, whole texts; null and empty texts have the score of no n-gram at all."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([own.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; all columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts):
        return texts.map(sent.value.score)

    return docs.where(of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) < threshold)


def held_out(id_col: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 1 of 3."""
    return F.crc32(id_col.cast("string")) % 3 == 1


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
