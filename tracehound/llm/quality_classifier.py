"""Operator 3, quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot products.

Features of a text (all of it): one- and two-word grams of the lower-cased words, the same
of the word shapes (small letters left out, capitals and digits as one mark each, other
characters kept), whether a two-word gram came earlier in the text, and the length class;
each hashed to one of ``2**BITS`` columns, with log(1 + count) values scaled to length 1.

Training takes a bounded sample: the ``max_train`` labelled ids with the smallest hash.
Each of ``shards`` tasks runs FTRL over its part of the sample and returns one weight
vector of fixed size (2**BITS floats); their mean is the model, which is broadcast (1 MB,
whatever the input). Scoring is one pass over the documents without a shuffle.

Defined results: null text is the empty text (scored by bias and length class); a label
repeated for an id counts once, by its largest value, null labels not at all; without
any labelled row every score is 0.5; repeated rows are scored each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, gram_hashes, long_ids, mix, with_column_names, word_hashes, words

BITS = 18
MAX_TRAIN = 6_000
SHARDS = 2
EPOCHS = 2
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 8.0, 1.0, 1e-4, 1e-3

_SHAPE = bytes(0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))
_SMALL = bytes(c for c in range(256) if 0x61 <= c <= 0x7A or c >= 0x80)
_SALT = {name: np.uint64(k) for name, k in (("shape1", 0x5EED01), ("shape2", 0x5EED02), ("again", 0x5EED03), ("length", 0x5EED04))}


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct columns and their values; column 0 is the bias."""
    text = text or ""
    h = word_hashes(words(text))
    shapes = word_hashes(text.encode("utf-8", "surrogatepass").translate(_SHAPE, _SMALL).split())
    grams = [h, mix(shapes ^ _SALT["shape1"])]
    if len(h) > 1:
        two = gram_hashes(h, 2)
        _, first = np.unique(two, return_index=True)
        again = np.ones(len(two), bool)
        again[first] = False
        grams += [two, mix(gram_hashes(shapes, 2) ^ _SALT["shape2"]), mix(again.astype(np.uint64) ^ _SALT["again"])]
    grams.append(mix(np.array([len(h).bit_length()], np.uint64) ^ _SALT["length"]))
    col = (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int32)
    idx, n = np.unique(col, return_counts=True)
    val = np.log1p(n)
    val = (val / np.sqrt((val * val).sum())).astype(np.float32)
    return np.concatenate([[0], idx[idx > 0]]).astype(np.int32), np.concatenate([[0.2], val[idx > 0]]).astype(np.float32)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal over the examples, in order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weight(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for idx, val, y in examples:
            w = weight(idx)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ val, -35, 35)))
            g = (p - y) * val
            root = np.sqrt(n[idx] + g * g)
            z[idx] += g - (root - np.sqrt(n[idx])) / ALPHA * w
            n[idx] += g * g
    return weight(np.arange(1 << BITS)).astype(np.float32)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fs = [features(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays(
            [b.column("order"), b.column("shard"), b.column("y"), pa.array([i.tobytes() for i, _ in fs], pa.binary()),
             pa.array([v.tobytes() for _, v in fs], pa.binary())], ["order", "shard", "y", "idx", "val"])


def _train_shard(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["order", "y"], kind="stable")
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for i, v, y in zip(part.idx, part.val, part.y)]
    return pd.DataFrame({"weights": [ftrl(rows).tobytes()]})


def train(docs: DataFrame, labelled: DataFrame, max_train: int = MAX_TRAIN, shards: int = SHARDS) -> np.ndarray:
    """``labelled`` has ``doc_id`` and ``y`` (0 or 1). Returns the fixed-size weights."""
    order = F.xxhash64(F.col("doc_id"))
    sample = (labelled.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").cast("double").alias("y"))
              .withColumn("order", order).orderBy("order", "doc_id").limit(max_train)
              .withColumn("shard", F.pmod(F.col("order"), F.lit(shards)).cast("int")))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_train narrow rows
    feats = rows.select("order", "shard", "y", "text").mapInArrow(
        _feature_batches, "order long, shard int, y double, idx binary, val binary")
    models = feats.groupBy("shard").applyInPandas(_train_shard, "weights binary").collect()  # shards x 1 MB
    if not models:
        return np.zeros(1 << BITS, np.float32)
    return np.mean([np.frombuffer(m.weights, np.float32) for m in models], axis=0)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            s = []
            for t in b.column("text"):
                idx, val = features(t.as_py())
                s.append(float(1.0 / (1.0 + np.exp(-np.clip(np.dot(w[idx], val), -35, 35)))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query: learn from ids whose crc32 mod 5 is not 0, score all."""
    d = long_ids(with_column_names(docs, "doc_id", "text"))
    lab = long_ids(with_column_names(labels, "doc_id", "quality")).where(fold("doc_id", 5) != 0)
    out = score(d, train(d, lab.select("doc_id", F.col("quality").alias("y"))))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                      F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
