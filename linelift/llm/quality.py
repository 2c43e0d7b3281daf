"""Quality classifier: hashed word n-gram logistic regression trained by FTRL-proximal.

Every word gives two symbols: itself in lower case, and its shape (runs of capitals, small
letters, digits, each mark). N-grams of both, and the marker n-grams of a word that repeats
one or two places on, are hashed into 2 ** BITS weights. A feature's value is its
share of the text's n-grams of its kind, times SCALE; the score is the logistic function of
the sparse dot product with the weights plus a bias.

The model is fitted on a bounded sample of labelled rows: at most ``max_rows``, those whose
id has the smallest MD5. Scoring is one map-side pass over all whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linelift.llm.common import need_columns, ship_package

BITS = 18
SCALE = 8.0
MAX_ROWS = 8192
"""Labelled rows that the model is fitted on."""
EPOCHS = 4
WORDS_CACHED = 300_000

ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shape(word: str) -> str:
    """Letters as x or X, digits as 0, runs of one kind once or twice, of the whole word."""
    out: list[str] = []
    for c in word:
        s = "0" if c.isdigit() else ("X" if c.isupper() else "x") if c.isalpha() else c
        if out[-2:] != [s, s]:
            out.append(s)
    return "".join(out)


class _Symbols(dict):
    """Word -> 64 bits: hash of its lower case (upper half) and of its shape (lower half)."""

    def __missing__(self, word: str) -> int:
        value = (xxhash.xxh32_intdigest(word.lower()) << 32) | xxhash.xxh32_intdigest(
            shape(word), seed=1)
        if len(word) <= 64:
            if len(self) >= WORDS_CACHED:
                self.clear()
            self[word] = value
        return value


_symbols = _Symbols()


def _hash(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), kind, np.uint64)
    for p, m in zip(parts, _MIX):
        h = (h ^ p) * m
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> tuple[list[np.ndarray], int]:
    """Indices by kind, repeated as they occur, and the number of words."""
    tokens = (text or "").split()
    if not tokens:
        return [], 0
    s = np.fromiter(map(_symbols.__getitem__, tokens), np.uint64, len(tokens))
    word, form = s >> np.uint64(32), s & np.uint64(0xFFFFFFFF)
    out = [_hash(1, word), _hash(2, form)]
    if len(s) > 1:
        same = (word[1:] == word[:-1]).astype(np.uint64)
        out += [_hash(3, word[:-1], word[1:]), _hash(4, form[:-1], form[1:]), _hash(5, same)]
    if len(s) > 2:
        same = (word[2:] == word[:-2]).astype(np.uint64)
        out += [_hash(6, form[:-2], form[1:-1], form[2:]), _hash(7, same)]
    return out, len(tokens)


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's features as (indices, values), each index once."""
    kinds, _ = features(text)
    if not kinds:
        return np.empty(0, np.int64), np.empty(0)
    values = np.concatenate([np.full(len(k), SCALE / len(k)) for k in kinds])
    index, where = np.unique(np.concatenate(kinds), return_inverse=True)
    return index, np.bincount(where, values)


def sparse_dot(weights: np.ndarray, text: str | None) -> float:
    return float(sum(SCALE * weights[k].mean() for k in features(text)[0]))


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the bias is the last coordinate."""

    def __init__(self, size: int):
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)

    def weights(self, index=slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, index: np.ndarray, values: np.ndarray, label: int) -> None:
        index, values = np.append(index, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(index)
        gradient = (logistic(float(w @ values)) - label) * values
        n = self.n[index]
        rate = (np.sqrt(n + gradient ** 2) - np.sqrt(n)) / ALPHA
        self.z[index] += gradient - rate * w
        self.n[index] = n + gradient ** 2


def logistic(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(x, -35.0), 35.0)))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(*sparse(text), label) for batch in batches
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    model = Ftrl(1 << BITS)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            model.update(*rows[i])
    w = model.weights()
    index = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(w[index])], ["at", "weight"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights (the bias last) from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    Rows that ``held_out`` picks are never read as labels. Null ids and null labels are
    left out; of several labels of a document the largest counts. Without any labelled row
    all weights are 0, and all scores 0.5.
    """
    ship_package(docs.sparkSession)
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()
                           & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("quality").alias("_label"))
              .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(max_rows))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows rows
            .groupBy("doc_id").agg(F.max("text").alias("text"), F.max("_label").alias("_label")))
    fitted = (rows.repartition(1).sortWithinPartitions(F.md5(F.col("doc_id").cast("string")
                                                             .cast("binary")))
              .select("text", "_label").mapInArrow(_fit, "at long, weight double").toArrow())
    weights = np.zeros((1 << BITS) + 1)
    weights[fitted["at"].to_numpy()] = fitted["weight"].to_numpy()
    return weights


def scores(docs: DataFrame, weights: np.ndarray, *, keep_above: float | None = None,
           column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 (higher: label 1 is likelier) of each whole text.

    A null or empty text has the bias alone. With ``keep_above``, rows with a lower score go.
    An input column named like ``column`` is replaced; others pass through.
    """
    need_columns(docs, "text")
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop(column)
    at = docs.columns.index("text")
    table = spark.sparkContext.broadcast(weights.astype(np.float32))
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = table.value
        bias = float(w[-1])
        for batch in batches:
            values = [logistic(sparse_dot(w, text.as_py()) + bias) for text in batch.column(at)]
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())],
                                             [*batch.schema.names, column])
            if keep_above is not None:
                out = out.filter(pa.array([v >= keep_above for v in values], pa.bool_()))
            yield out

    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3,
            max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out (its label was not for
    training), score, predicted (1 if score >= ``threshold``).

    Only texts enter a score. Repeated rows score once each; a null doc_id is never held out;
    an empty table gives no rows.
    """
    need_columns(docs, "doc_id", "text")
    need_columns(labels, "doc_id", "quality")
    docs = docs.select("doc_id", "text")
    scored = scores(docs, train(docs, labels, max_rows=max_rows))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
