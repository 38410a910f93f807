"""Operator 9, language-model scoring by deleted interpolation.

Tokens are lower-cased words and one end per text. The probability of a token after its
context (the token before it, or the start) mixes maximum-likelihood estimates of three orders,

    P(w | h) = l2(b) c(h w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1),

where b is the class of the context's frequency c(h) (two classes to a doubling) and the weights
l(b) sum to 1. They are learned by expectation-maximisation on held-out counts: every training
token is held out in turn, that is, predicted from counts from which it has been deleted.

1. Texts are packed in pages. Every page sends its distinct words and word pairs (64-bit hashes,
   whatever the number of buckets) with their training counts to buckets, which add them up over
   all documents and answer each page, key by key, by how much the total is above its own.
2. Each page meets its answers; every token's two counts are written, per document, and the page's
   held-out tokens counted by (class, probability bins of half an octave): a table of bounded
   size, on which the driver runs the EM.
3. A pass over the counts scores.

Totals are 64-bit; a document's are stored in 32 bits where they fit. The number of buckets grows
with the input, so that a bucket's keys fit a task (``BUCKET_BYTES`` of text to a bucket).

Nothing is cut off: every n-gram of every training text counts, the key exchange grows
with the corpus and is spread over buckets by hash, whatever the words' frequencies.

Defined results: a null text is empty (one end token); repeated rows are scored, and learned
from, each; a null doc_id is neither held out nor learned from; without training text the
model is uniform over one unknown word (score 0); extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, mix, word_hashes, written
from .pages import PAGE_BYTES, bucket_bits, by_bucket, pack, squeeze, stretch, totals, unpack

EM_ROUNDS = 60
BUCKET_BYTES = 48 << 20
CLASSES = 96
END, START = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"\n", b"\n\n"))  # no word holds white space
_PAIR = np.uint64(0x9FB21C651E98DF25)
_BIN0, _BINS = 0, 80  # half-octaves of a probability; 0 is probability 0


def tokens_of(raw: bytes) -> np.ndarray:
    return np.append(word_hashes(raw.lower().split()), END)


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    before = np.concatenate([[START], tokens[:-1]])
    return mix(mix(before) * _PAIR + tokens)


def page_keys(docs: list[tuple[np.ndarray, bool]], pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of a page, their counts in its training texts, and the place of
    every token's key among them."""
    make = pairs_of if pairs else mix
    every = np.concatenate([make(t) for t, _ in docs])
    learn = np.repeat([f for _, f in docs], [len(t) for t, _ in docs]).astype(np.int64)
    order = np.argsort(every, kind="stable")
    s = every[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    first = np.flatnonzero(new)
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[first], np.add.reduceat(learn[order], first), place


def _request(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                docs = [(tokens_of(raw), f) for _, _, f, raw in unpack(r["rid"], r["doc_id"], r["flag"], r["size"], r["texts"])]
                for pairs in (False, True):
                    keys, counts, _ = page_keys(docs, pairs)
                    bucket, at = by_bucket(keys, bits)
                    keys = keys.astype("<u8")
                    n = len(bucket)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["page"]] * n, pa.int64()), pa.array(bucket, pa.int32()), pa.array([pairs] * n, pa.bool_()),
                         pa.array([squeeze(keys[s], ascending=True) for s in at], pa.binary()),
                         pa.array([squeeze(counts[s].astype("<u4")) for s in at], pa.binary())],
                        ["page", "bucket", "pairs", "vals", "times"])

    return run


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket of one order: sums over the pages. Back goes, for every key of a page in the
    page's order, how much the total is above the page's own count. A last row (page -1) has
    the distinct and all training tokens of the bucket."""
    pairs = bool(group.pairs.iloc[0])
    vals = [stretch(v, "<u8", ascending=True) for v in group.vals]
    own = [stretch(t, "<u4") for t in group.times]
    keys, counts = np.concatenate(vals), np.concatenate(own).astype(np.int64)
    total = totals(keys, counts)
    more, at, out = (total - counts).astype("<u8"), 0, []
    for page, bucket, v in zip(group.page, group.bucket, vals):
        out.append((page, bucket, pairs, squeeze(more[at:at + len(v)]), 0, 0))
        at += len(v)
    _, first = np.unique(keys, return_index=True)
    out.append((-1, group.bucket.iloc[0], pairs, b"", int((total[first] > 0).sum()), int(counts.sum())))
    return pd.DataFrame(out, columns=["page", "bucket", "pairs", "more", "distinct", "tokens"])


def _stored(counts: np.ndarray) -> bytes:
    return counts.astype("<u4" if int(counts.max()) < 1 << 32 else "<u8").tobytes()


def _restored(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u8").astype(np.int64)


def _counts(bits: int, total: int):
    """Per document the training counts of its tokens and pairs, over the whole corpus; a last row
    per page has its held-out tokens by cell."""
    def run(page: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for p in page.itertuples():
            rows = [(rid, doc, f, tokens_of(raw)) for rid, doc, f, raw in unpack(p.rid, p.doc_id, p.flag, p.size, p.texts)]
            found = []
            for pairs in (False, True):
                keys, counts, place = page_keys([(t, f) for _, _, f, t in rows], pairs)
                where = dict(zip(*(x if isinstance(x, list) else x.tolist() for x in by_bucket(keys, bits))))
                got = answers[answers.pairs == pairs]
                for bucket, more in zip(got.bucket, got.more):
                    counts[where[bucket]] += stretch(more, "<u8").astype(np.int64)
                found.append(counts[place])
            c1, c2 = found
            size = np.array([len(t) for _, _, _, t in rows])
            start = np.concatenate([[0], np.cumsum(size)])
            n_texts = int(c1[start[1] - 1])   # the count of the end token, which closes every text
            for (rid, doc, f, t), a, e in zip(rows, start, start[1:]):
                out.append((rid, doc, f, len(t), n_texts, _stored(c1[a:e]), _stored(c2[a:e]), None, None))
            ctx = np.concatenate([[n_texts], c1[:-1]])
            ctx[start[:-1]] = n_texts
            learn = np.repeat([f for _, _, f, _ in rows], size)
            cells, n = np.unique(_cells(c1[learn], c2[learn], ctx[learn], total), return_counts=True)
            out.append((None, None, None, None, None, None, None, cells.astype("<i4").tobytes(), n.astype("<i4").tobytes()))
        return pd.DataFrame(out, columns=["rid", "doc_id", "learn", "n", "n_texts", "c1", "c2", "cells", "times"]).astype(
            {"rid": "Int64", "doc_id": "Int64", "learn": "boolean", "n": "Int64", "n_texts": "Int64"})

    return run


def context_class(c: np.ndarray) -> np.ndarray:
    return np.minimum(CLASSES - 1, np.floor(2 * np.log2(c + 1))).astype(np.int64)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for probability 0, else 1 + its half-octaves below 1."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.clip(np.round(-2 * np.log2(np.maximum(p, 1e-300))), 0, _BINS), 0).astype(np.int64)


def _cells(c1: np.ndarray, c2: np.ndarray, ctx: np.ndarray, total: int) -> np.ndarray:
    """The cell (context class, probability bins) of each training token when it is held out."""
    side = _BINS + 2
    ctx = ctx - 1
    p2 = (c2 - 1) / np.maximum(ctx, 1)
    p1 = (c1 - 1) / max(total - 1, 1)
    return (context_class(ctx) * side + _bin(p2)) * side + _bin(p1)


def _held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages' held-out tokens by cell, one table per task."""
    seen = np.zeros(CLASSES * (_BINS + 2) ** 2, np.int64)
    for b in batches:
        for cells, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen[np.frombuffer(cells, "<i4")] += np.frombuffer(times, "<i4")
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["cell", "n"])


def learn_weights(cells: np.ndarray, n: np.ndarray, vocabulary: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """EM per context class: the weights (l2, l1, l0) that make the held-out tokens likeliest.
    A class without held-out tokens takes the weights of the next lower one."""
    side = _BINS + 2
    cls, b2, b1 = cells // (side * side), cells // side % side, cells % side
    prob = lambda b: np.where(b > 0, 2.0 ** (-(b - 1) / 2), 0.0)
    p = np.stack([prob(b2), prob(b1), np.full(len(b1), 1.0 / (vocabulary + 1))])
    weights = np.full((CLASSES, 3), 1 / 3)
    for _ in range(rounds):
        share = weights[cls].T * p
        share *= n / share.sum(axis=0)
        mass = np.stack([np.bincount(cls, weights=s, minlength=CLASSES) for s in share], axis=1)
        held = mass.sum(axis=1) > 0
        weights[held] = (mass[held] + 1e-3) / (mass[held].sum(axis=1, keepdims=True) + 3e-3)
    last = np.array([0.0, 0.0, 1.0])
    for k in range(CLASSES):
        if held[k] if len(cells) else False:
            last = weights[k]
        weights[k] = last
    return weights


def token_counts(docs: DataFrame, learn) -> tuple[DataFrame, int, int]:
    """A written table of the token counts of every document and the held-out cells of every page,
    the distinct training tokens (V) and all of them (N). ``learn`` is a boolean column: may this
    text be learned from?"""
    spark = docs.sparkSession
    pages = pack(docs, F.monotonically_increasing_id(), learn, "lm-pages")
    bits = max(bucket_bits(spark), min(24, (pages.count() * PAGE_BYTES // BUCKET_BYTES).bit_length()))
    asked = pages.mapInArrow(_request(bits), "page long, bucket int, pairs boolean, vals binary, times binary")
    answers = written(asked.groupBy("bucket", "pairs").applyInPandas(
        _answer, "page long, bucket int, pairs boolean, more binary, distinct long, tokens long"), "lm-answers")
    size = answers.where("page = -1 and not pairs").agg(F.sum("distinct"), F.sum("tokens")).first()
    vocabulary, total = size[0] or 0, size[1] or 0
    back = answers.where("page >= 0").select("page", "bucket", "pairs", "more")
    table = written(pages.groupBy("page").cogroup(back.groupBy("page")).applyInPandas(
        _counts(bits, total), "rid long, doc_id long, learn boolean, n long, n_texts long, c1 binary, c2 binary, cells binary, times binary"), "lm-counts")
    return table, vocabulary, total


def score(docs: DataFrame, learn) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    table, vocabulary, total = token_counts(docs, learn)
    seen = (table.where("cells IS NOT NULL").select("cells", "times").mapInArrow(_held_out, "cell long, n long")
            .groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toPandas())  # at most classes x bins^2 rows
    weights = learn_weights(seen.cell.to_numpy(np.int64), seen.n.to_numpy(np.int64), vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            known, base, got = [], [], []
            for n, n_texts, r1, r2 in zip(*(b.column(k).to_pylist() for k in ("n", "n_texts", "c1", "c2"))):
                c1, c2 = _restored(r1, n), _restored(r2, n)
                ctx = np.append(n_texts, c1[:-1])
                l2, l1, l0 = w[context_class(ctx)].T
                p = l2 * (c2 / np.maximum(ctx, 1)) + l1 * (c1 / max(total, 1)) + l0 / (vocabulary + 1)
                known.append(int((c1 > 0).sum()))
                base.append(float(np.log10((c1 + 0.1) / (total + 0.1 * (vocabulary + 1))).sum()))
                got.append(float(np.log10(p).sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n"), pa.array(known, pa.int64()), pa.array([total] * len(known), pa.int64()),
                 pa.array(base, pa.float64()), pa.array(got, pa.float64())],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return table.where("cells IS NULL").select("doc_id", "n", "n_texts", "c1", "c2").mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def digest(docs: DataFrame) -> DataFrame:
    """The registered query: learn from ids whose crc32 mod 10 is not 0, score all."""
    out = score(docs, fold("doc_id", 10) != 0)
    return out.select("doc_id", F.coalesce(fold("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score")
