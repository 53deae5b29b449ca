"""Quality classifier: supervised subword embeddings.

A document is a bag of hashed features: its words, its pairs of neighbouring words (a word followed
by itself is one feature, whatever the word) and its character 3- and 4-grams over UTF-8 bytes. Each
feature has a learned vector; a document is their average; a softmax layer gives the classes. Numpy
stochastic gradient descent trains vectors and layer together on at most ``SAMPLE`` labelled rows a
class, chosen by hash among the rows that training may see. That is the only bound: scoring reads
every whole text.

As the layer is linear, a feature's share of the score is one number, so the model that tasks get is
``BUCKETS`` floats (0.5 MB) whatever the size of the corpus.

Defined cases: a null or empty text has no features and gets the score of the layer's bias. Labels
that are null, or other than 0 and 1, and labels without a document are not learned from. If one
class has no rows, every score is that of the other. Rows that repeat a ``doc_id`` are scored each.
An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.llm import common
from lumenflow.llm.shingles import spans

BUCKETS = 1 << 17
DIM = 12
#: Labelled rows of each class that are learned from at most.
SAMPLE = 1500
EPOCHS = 3
RATE = 1.0
THRESHOLD = 0.7

_U32, _U64 = np.uint32, np.uint64
_SHIFT = _U32(32 - 17)


def features(text: str | None) -> np.ndarray:
    """Feature numbers of a text, with repeats."""
    data = (text or "").encode()
    if not data.strip():
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(_U32)
    three = b[:-2] | b[1:-1] << _U32(8) | b[2:] << _U32(16)
    four = three[:-1] | b[3:] << _U32(24)
    grams = [(three * _U32(0x9E3779B1) + _U32(0x3C6EF372)) >> _SHIFT, (four * _U32(0x85EBCA77)) >> _SHIFT]
    white = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = edge[::2], edge[1::2]
    words = spans(data, starts, ends)
    same = words[1:] == words[:-1]
    pairs = np.where(same, _U64(0x1234567), words[:-1] * _U64(0x9E3779B97F4A7C15) ^ words[1:] * _U64(0xC2B2AE3D27D4EB4F))
    grams += [(words >> _U64(47)).astype(_U32), ((pairs * _U64(0xD6E8FEB86659FD93)) >> _U64(47)).astype(_U32)]
    return np.concatenate(grams)


def train(texts: list[str | None], labels: list[int], seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights of features and the bias, in log-odds of class 1."""
    rng = np.random.default_rng(seed)
    n1 = sum(labels)
    if n1 in (0, len(labels)):
        return np.zeros(BUCKETS, np.float32), 0.0 if not labels else 20.0 if n1 else -20.0
    docs = []
    for t in texts:
        f, c = np.unique(features(t), return_counts=True)
        docs.append((f, (c / max(1, c.sum())).astype(np.float32)))
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    layer[:] = rng.normal(0, 0.3, (2, DIM))
    weight = {1: len(labels) / (2 * n1), 0: len(labels) / (2 * (len(labels) - n1))}
    steps, step = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            f, share = docs[i]
            rate = RATE * (1 - step / steps)
            step += 1
            rows = embed[f]
            h = share @ rows
            z = layer @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= min(4.0, weight[labels[i]])
            back = p @ layer
            layer -= rate * np.outer(p, h)
            bias -= 0.1 * rate * p
            # A feature's step is scaled to its share's root, so that long documents move their features too.
            embed[f] = rows - rate * np.sqrt(share)[:, None] * back
    return (embed @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def _score(weights: np.ndarray, bias: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.empty(b.num_rows)
            for i, t in enumerate(b.column(1).to_pylist()):
                f = features(t)
                z[i] = bias + (float(weights[f].mean(dtype=np.float64)) if len(f) else 0.0)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def held_out(id_col: str | Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 4, is 2."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on a bounded sample: the ``sample`` ids of each class with the least hash; where an id repeats, its least text."""
    told = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(~held_out("doc_id")).filter("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = None
    for y in (0, 1):
        part = told.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    got = sorted(got.toArrow().to_pylist(), key=lambda r: r["doc_id"])  # 2 * sample rows at most
    return train([r["text"] for r in got], [r["y"] for r in got])


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted."""
    common.ship(docs.sparkSession)
    weights, bias = fit(docs, labels, label_col, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", held_out("doc_id"))
    return rows.mapInArrow(_score(weights, bias, threshold), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts as class 1, with the columns they had."""
    common.ship(docs.sparkSession)
    weights, bias = fit(docs, labels, label_col, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.array([bias + (float(weights[f].mean(dtype=np.float64)) if len(f := features(t)) else 0.0) for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) >= threshold, pa.bool_()))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
