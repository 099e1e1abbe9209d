"""Operator 6: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

1. Presence counts of hashed character n-grams, by class, over all training rows (fixed-size count tables).
2. Each n-gram's log-count ratio r; the n-grams that tell the classes apart best are kept.
3. Logistic regression on presence times r, fitted on a bounded sample of training rows (`sample_rows`).
4. A text's score is the sigmoid of its bias plus the sum of its distinct kept n-grams' weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, destroyed, saved, slices, spread, summed_counts, two_columns
from .jaccard import mixed

SIZES, BITS = (3, 4, 5, 6), 19
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ngram_codes(text: str) -> np.ndarray:
    """A hash in [0, 2^BITS) for each character n-gram of the lower-cased text, in which other space is one space."""
    c = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    with np.errstate(over="ignore"):
        c = (c + np.uint64(1)) * _STEP
        c ^= c >> np.uint64(29)
        for n in range(1, max(SIZES) + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * _STEP + c[n - 1 :]
            if n in SIZES:
                out.append(((h ^ h >> np.uint64(31)) * _STEP >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    """place: for each hash the feature's number plus one, or 0; weight: by feature; all of fixed size."""

    place: np.ndarray
    weight: np.ndarray
    bias: float

    def present(self, text: str) -> np.ndarray:
        got = self.place[ngram_codes(text)]
        return np.unique(got[got > 0]).astype(np.int64) - 1

    def score(self, text: str) -> float:
        z = self.bias + float(self.weight[self.present(text)].sum())
        return 1 / (1 + np.exp(-min(max(z, -500.0), 500.0)))


def _logistic(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, l2: float, steps: int, memory: int = 10) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean log loss plus l2 / 2 times the squared weights, by L-BFGS."""
    at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    x, n = r[col], max(len(y), 1)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(at, x * v[col], minlength=len(y)) + v[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        grad = np.append(np.bincount(col, x * g[at], minlength=len(r)) + l2 * v[:-1], g.sum())
        return float(np.logaddexp(0, z).sum() - (y * z).sum()) / n + l2 / 2 * float(v[:-1] @ v[:-1]), grad

    v = np.zeros(len(r) + 1)
    f, g = loss(v)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, back = -g, []
        for s, t in reversed(past):
            k = (s @ d) / (s @ t)
            back.append(k)
            d = d - k * t
        if past:
            s, t = past[-1]
            d = d * (s @ t) / (t @ t)
        for (s, t), k in zip(past, reversed(back), strict=True):
            d = d + s * (k - (t @ d) / (s @ t))
        step, slope = 1.0, g @ d
        while step > 1e-10:
            new = v + step * d
            f2, g2 = loss(new)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        if step <= 1e-10 or f - f2 < 1e-9 * max(f, 1e-9):
            break
        if (new - v) @ (g2 - g) > 1e-14:
            past = [*past, (new - v, g2 - g)][-memory:]
        v, f, g = new, f2, g2
    return v[:-1], float(v[-1])


def train(labelled: DataFrame, features: int = 2048, sample_rows: int = 20_000, alpha: float = 1.0, l2: float = 1e-5, steps: int = 300) -> Model:
    """labelled: doc_id, text, y (0 or 1; other rows are ignored). Counts cover all rows; the fit takes the sample_rows
    rows with the lowest hashes of their ids. Without rows of both classes every score is the share of class 1
    (0.5 without rows).
    """
    rows = labelled.where("y in (0, 1)").select("doc_id", "text", F.col("y").cast("int").alias("y"))
    size = 1 << BITS

    def add(c: np.ndarray, b: pa.RecordBatch) -> None:
        for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            c[np.unique(ngram_codes(t)) + y * size] += 1
            c[2 * size + y] += 1

    c = summed_counts(rows, add, 2 * size + 64)
    (n0, n1), c0, c1 = c[2 * size : 2 * size + 2], c[:size], c[size : 2 * size]
    none = Model(np.zeros(size, np.int32), np.zeros(0), 0.0)
    if not n0 or not n1:
        none.bias = float(np.log((n1 + 0.5) / (n0 + 0.5)))
        return none
    p1, p0 = (c1 + alpha) / (n1 + 2 * alpha), (c0 + alpha) / (n0 + 2 * alpha)
    # the ratio is shrunk by twice its standard error, so that n-grams seen by chance in one class count little
    r, err = np.log(p1 / p0), np.sqrt((1 - p1) / (c1 + alpha) + (1 - p0) / (c0 + alpha))
    r = np.sign(r) * np.maximum(0, np.abs(r) - 2 * err)
    gain = np.abs(r) * np.maximum(p1, p0)
    kept = np.argsort(-gain, kind="stable")[:features]
    kept = kept[gain[kept] > 0]
    place = np.zeros(size, np.int32)
    place[kept] = np.arange(1, len(kept) + 1)
    model = Model(place, np.zeros(len(kept)), 0.0)

    share = min(1.0, 1.2 * sample_rows / float(n0 + n1))  # a little more, then exactly sample_rows of the lowest hashes
    few = rows.withColumn("h", F.xxhash64("doc_id")).where(F.col("h") <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))))
    sparse = arrow_schema("h long, y int, f binary")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(2), pa.array([model.present(t).astype("<u4").tobytes() for t in b.column(1).to_pylist()], pa.binary())], schema=sparse)

    got = few.mapInArrow(featurise, "h long, y int, f binary").orderBy("h", "y", "f").limit(sample_rows).toArrow()
    x = [np.frombuffer(f, "<u4").astype(np.int64) for f in got.column("f").to_pylist()]
    model.weight, model.bias = _logistic(x, r[kept], np.array(got.column("y").to_pylist(), float), l2, steps)
    model.weight = model.weight * r[kept]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


#: Bits of the filter of labelled ids: 512 KB.
FILTER = 1 << 22


def _slot(ids: pa.Array) -> np.ndarray:
    return (mixed(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(FILTER)).astype(np.int64)


def labelled_texts(docs: DataFrame, y: DataFrame) -> DataFrame:
    """doc_id, text, y of each row of docs that has a label in y (doc_id, not null, and y).

    Texts meet their labels compressed, in one shuffle. A filter of fixed size goes to the scan, so that texts without a
    label mostly stay where they are; with very many labels it lets more texts through, and the join drops them.
    """

    def mark(c: np.ndarray, b: pa.RecordBatch) -> None:
        c[_slot(b.column(0))] = 1

    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(summed_counts(y.select("doc_id"), mark, FILTER) > 0))
    packed, plain = arrow_schema("doc_id long, z binary"), arrow_schema("doc_id long, text string, y int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, press = np.unpackbits(sent.value) > 0, zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            b = b.filter(b.column(0).is_valid())
            b = b.filter(pa.array(there[_slot(b.column(0))], pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress(t.encode()) for t in b.column(1).to_pylist()], pa.binary())], schema=packed)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = zstandard.ZstdDecompressor()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([back.decompress(z).decode() for z in b.column(1).to_pylist()], pa.string()), b.column(2)], schema=plain)

    some = spread(two_columns(docs, "doc_id", "text")).mapInArrow(pack, "doc_id long, z binary")
    met = saved(some.join(y.select("doc_id", F.col("y").cast("int").alias("y")), "doc_id").select("doc_id", "z", "y"))
    destroyed(sent)
    return met.mapInArrow(unpack, "doc_id long, text string, y int")


def train_on(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """A model from the labels outside the held-out third, each joined with its text."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("y")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.dropDuplicates(["doc_id", "y"])
    return train(labelled_texts(docs, y), **options)


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row; null and empty texts get the score of their (few) n-grams. The score needs the text alone.

    The model is sent once to each executor; its size is fixed (2 MB for the places, 8 bytes a feature).
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    out = arrow_schema("doc_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in b.column(1).to_pylist()], pa.float64())], schema=out)

    return spread(two_columns(df, id_col, text_col)).mapInArrow(run, "doc_id long, score double")


def without_toxic(df: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose score is below the threshold. A null text counts as empty."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(sent.value.score).astype("float64")

    return df.where(score(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))) < threshold)


def predictions(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
