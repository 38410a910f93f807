"""Texts packed in pages, and a key exchange between pages and buckets.

Corpus-wide lookups of short keys (shingles, n-grams) go in two steps: every page sends its
distinct keys to buckets by their leading bits, and each bucket answers every page about the
keys that it sent. A page is a run of whole rows of about ``PAGE_BYTES`` of text, written once;
its texts are one zstandard blob, so it moves to meet its answers at a fraction of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

PAGE_BYTES = 14 << 20
PAGE_ROWS = 8192
SCHEMA = "page long, rid binary, doc_id binary, flag binary, size binary, texts binary"
COLUMNS = ["page", "rid", "doc_id", "flag", "size", "texts"]
_NO_ID = np.iinfo(np.int64).min


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held, page = [], 0, None
    zip_ = zstandard.ZstdCompressor(level=3)

    def out():
        rid, doc, flag, raw = zip(*rows)
        sizes = np.array([-1 if t is None else len(t) for t in raw], "<i4")
        return pa.RecordBatch.from_arrays(
            [pa.array([page], pa.int64()), *[pa.array([x], pa.binary()) for x in (
                np.array(rid, "<i8").tobytes(), np.array([_NO_ID if d is None else d for d in doc], "<i8").tobytes(),
                np.array(flag, bool).tobytes(), sizes.tobytes(), zip_.compress(b"".join(t for t in raw if t)))]], COLUMNS)

    for b in batches:
        for part, rid, doc, flag, text in zip(*(b.column(k) for k in ("part", "rid", "doc_id", "flag", "text"))):
            raw = text.as_py()
            raw = None if raw is None else raw.encode("utf-8", "surrogatepass")
            if rows and (held >= PAGE_BYTES or len(rows) >= PAGE_ROWS):
                yield out()
                rows, held, page = [], 0, page + 1
            page = part.as_py() << 32 if page is None else page
            rows.append((rid.as_py(), doc.as_py(), bool(flag.as_py()), raw))
            held += len(raw or b"")
    if rows:
        yield out()


def pack(docs: DataFrame, rid, flag, name: str) -> DataFrame:
    """A written table of pages from ``doc_id`` and ``text``, a row number and a flag per row."""
    d = docs.select(F.spark_partition_id().alias("part"), rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                    F.coalesce(flag, F.lit(False)).alias("flag"), "text")
    return written(d.mapInArrow(_pack, SCHEMA), name)


def unpack(rid: bytes, doc_id: bytes, flag: bytes, size: bytes, texts: bytes) -> Iterator[tuple[int, int | None, bool, bytes]]:
    """``rid, doc_id, flag, text`` of the rows of a page; a null text is empty."""
    raw, at = zstandard.ZstdDecompressor().decompress(texts), 0
    for r, d, f, n in zip(np.frombuffer(rid, "<i8").tolist(), np.frombuffer(doc_id, "<i8").tolist(), np.frombuffer(flag, bool).tolist(),
                          np.frombuffer(size, "<i4").tolist()):
        n = max(n, 0)
        yield r, None if d == _NO_ID else d, f, raw[at:at + n]
        at += n


def bucket_bits(spark: SparkSession) -> int:
    """So many leading bits that there are two to four buckets to a shuffle partition."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(24, max(4, (2 * parts - 1).bit_length()))


def by_bucket(keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[slice]]:
    """The buckets of sorted 64-bit keys and where each lies."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cut[1:], len(keys))
    return bucket[cut], [slice(a, e) for a, e in zip(cut, ends)]


def squeeze(numbers: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned integers (their differences, if ascending) as byte planes under zstandard."""
    if ascending:
        numbers = np.diff(numbers, prepend=numbers.dtype.type(0))
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def stretch(raw: bytes, dtype: str, ascending: bool = False) -> np.ndarray:
    """The numbers that ``squeeze`` packed."""
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1)
    numbers = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(numbers, dtype=dtype) if ascending else numbers


def totals(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For every key the sum of the weights of all equal keys."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(np.add.reduceat(weights[order], first), np.diff(np.append(first, len(keys))))
    return out
