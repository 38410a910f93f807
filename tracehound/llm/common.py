"""Helpers shared by the operators: table access, word hashing, folds, clash-free columns."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: The contract's word: a run of characters other than space, \t, \n, \v, \f and \r.
#: ``bytes.split()`` splits on exactly these six, ``bytes.lower()`` lowers exactly A-Z.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"
#: Words in a shingle and the least Jaccard similarity (per cent) of near-duplicates.
SHINGLE_WORDS = 5
MIN_SIMILARITY_PCT = 75

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col, buckets: int):
    """crc32 of the id as text, modulo ``buckets``; the id may be null (then null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % buckets


def words(text: str | None, lower: bool = True) -> list[bytes]:
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class _Memo(dict):
    """Word -> 64-bit hash; frequent words are looked up instead of hashed again. Emptied
    when full, so a worker's memory stays bounded."""

    limit = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_memo = _Memo()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memo.__getitem__, ws), np.uint64, len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrap-around arithmetic on unsigned 64-bit integers)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


_MULT = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order; the whole sequence as one run when it
    is shorter than ``n`` (nothing when there are no words)."""
    if len(h) == 0:
        return h
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, np.uint64(m), np.uint64)
    for k in range(m):
        out += h[k:len(h) - m + 1 + k] * _MULT[k]
    return mix(out)


def shingle_set(text: str | bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a lower-cased text (or its UTF-8)."""
    ws = text.lower().split() if isinstance(text, bytes) else words(text)
    return np.unique(gram_hashes(word_hashes(ws), SHINGLE_WORDS))


def with_column_names(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input, whatever they are
    called, never meet the columns that an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def long_ids(df: DataFrame, col: str = "doc_id") -> DataFrame:
    return df.withColumn(col, F.col(col).cast(T.LongType()))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes to the shared folder (zstd, for wide binary rows) and reads
    the table back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
