"""Operator 1, token-id output: canonical length-limited Huffman coding of token ids from
global counts, in independent blocks with bit-offset checkpoints, decoded by table.

1. Texts are range-partitioned by doc_id, sorted and encoded to ids once; the ids are
   written as an intermediate table with each document's offset in its partition.
2. The ids are counted over all documents (per task first, then one sum per id); the
   length-limited code (package-merge, at most ``max_bits`` bits) is made from the counts.
   Only the counts, at most one row per vocabulary entry, reach the driver.
3. Each task packs runs of whole documents into segments of about ``SEGMENT_IDS`` ids. The
   file format is a Parquet data set with one row per segment: ``part``, ``start`` (ids of
   all documents before it), ``doc_ids`` and ``counts`` (little-endian arrays), ``n_ids``,
   ``checkpoints`` (the bit offset of every block of ``BLOCK_IDS`` ids, unsigned 64-bit)
   and ``payload`` (the bits, most significant first). ``<path>/codebook`` holds
   ``(symbol, bits)``; canonical codes follow from these lengths alone.
4. Any block decodes by itself from its checkpoint. A segment's blocks are decoded in
   step, one table lookup of ``max_bits`` bits per id.

Defined results: a null text is the empty text (only the end id); repeated doc_ids are
kept as separate documents in order of their text's hash; a null doc_id sorts first; an
empty table gives an empty data set and codebook; extra columns are not read.
"""

from __future__ import annotations

import gc
import json
import os
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import long_ids, with_column_names, written

END_ID = 2
MAX_BITS = 16
BLOCK_IDS = 512
SEGMENT_IDS = 1 << 20
TEXT_BYTES = 4 << 20  # of texts encoded together
ASKED = 2000  # unknown pieces for one call of the library
ASKED_WHOLE = 100  # unknown whole texts for one call
_ID = np.dtype("<u4")


def id_type(vocabulary: int) -> np.dtype:
    """Ids of a small vocabulary take two bytes in the intermediate table."""
    return np.dtype("<u2") if vocabulary <= 1 << 16 else _ID


def _width(raw: bytes, n: int) -> np.dtype:
    return np.dtype("<u2") if n and len(raw) == 2 * n else _ID


# --- text to ids -------------------------------------------------------------------------

#: Kinds of UTF-8 bytes. Letters, digits and the bytes of U+00C0 to U+024F are plain.
_SPACE, _LINE, _MARK, _C2, _C9, _ODD = range(1, 7)


def _byte_kinds() -> bytes:
    kinds = bytearray([_ODD]) * 256
    for b in (*range(0x80, 0xC0), *range(0xC3, 0xC9)):
        kinds[b] = 0
    for b in range(0x21, 0x7F):
        kinds[b] = 0 if chr(b).isalnum() else _MARK
    kinds[0x20], kinds[0x0A], kinds[0xC2], kinds[0xC9] = _SPACE, _LINE, _C2, _C9
    return bytes(kinds)


_KINDS = _byte_kinds()


class TextEncoder:
    """The ``tokenizers`` library with a bounded memo of the texts' pieces, which lives as
    long as its worker process. The memo has two generations: when the younger is full, the
    elder is forgotten, so that frequent pieces stay.

    A text of printable characters up to U+024F without a space beside other white space is
    cut before each space, before each run of line feeds and before marks that follow a letter
    or a digit. GPT-2's pre-tokenizer cuts there too, whatever stands around, so the ids of a
    text are those of its pieces. Any other text (rare characters, whose classes could differ
    between libraries) is one piece. All of a slice's texts are cut at once, as an array over
    their bytes, and only its distinct pieces become Python strings."""

    generation = 400_000
    longest = 200  # characters of a piece that is remembered
    _shared: dict[str, TextEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        #: tokens that the library cuts out of a text before all else; a text with one is encoded whole
        #: by an untouched tokenizer, and the other need not look for them
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        made = json.loads(self.tokenizer.to_str())
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = id_type(size)
        #: ids whose token begins with the byte-level mark of a space
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        cutter = made.get("pre_tokenizer") or {}
        #: whether the library cuts as GPT-2 does; if not, texts are cut at spaces only
        self.parts = made.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        self.line_feed = self.library(["\n"])[0].tolist()
        self.memo: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> TextEncoder:
        if path not in cls._shared:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            cls._shared[path] = cls(path)
        return cls._shared[path]

    @cached_property
    def untouched(self):
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of the texts begin, and which texts are one piece."""
        raw, kinds = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_KINDS), np.uint8)
        at = np.flatnonzero(kinds != 0)
        # what stands before a text's first byte belongs to another text; a text begins a piece in any
        # case, and one that is taken for odd by mistake is encoded rightly too
        kind, before = kinds[at], kinds[at - 1]
        odd = [at[(kind == _ODD) | ((kind == _SPACE) & ((before == _SPACE) | (before == _LINE))) | ((kind == _LINE) & (before == _SPACE))]]
        for lead, fits in ((_C2, lambda x: x >= 0xA1), (_C9, lambda x: x < 0x90)):
            leads = at[kind == lead]
            odd.append(leads[~fits(raw[np.minimum(leads + 1, len(raw) - 1)])])
        for token in self.added:
            token, k = token.encode(), -1
            while (k := data.find(token, k + 1)) >= 0:
                odd.append(np.array([k]))
        whole = np.unique(np.searchsorted(starts, np.concatenate(odd), "right") - 1)
        begins = np.zeros(len(raw) + 1, bool)
        begins[at[kind == _SPACE]] = True
        if self.parts:
            begins[at[(kind == _LINE) & (before != _LINE)]] = True
            marks = at[kind == _MARK]
            last, lead = raw[marks - 1], raw[marks - 2]
            # the end of U+00C0 to U+024F, but for the signs of multiplication and division
            wide = (last >= 0x80) & (lead >= 0xC3) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
            begins[marks[wide | ((last < 0x80) & (kinds[marks - 1] == 0))]] = True
        for k in whole.tolist():
            begins[starts[k]:starts[k + 1] if k + 1 < len(starts) else len(raw)] = False
        begins[starts] = True
        return np.flatnonzero(begins[:-1]), whole

    def _unknown(self, pieces: list[str]) -> list[str]:
        """The pieces in neither generation; those in the elder move to the younger."""
        memo, elder = self.memo, self.elder
        new = [p for p in pieces if p not in memo]
        if not elder:
            return new
        found = [elder.get(p) for p in new]
        memo.update((p, ids) for p, ids in zip(new, found) if ids is not None)
        return [p for p, ids in zip(new, found) if ids is None]

    def _ask(self, pieces: list[str], opens) -> None:
        """Encodes the pieces in a row, if every one opens with an id that ``opens`` tells and has no other such."""
        for k in range(0, len(pieces), ASKED):
            some = pieces[k:k + ASKED]
            ids, = self.library(["".join(some)])
            at = np.flatnonzero(opens(ids))
            if len(at) == len(some):
                raw, w = ids.tobytes(), self.dtype.itemsize
                ends = (np.append(at[1:], len(ids)) * w).tolist()
                self.memo.update(zip(some, [raw[a:e] for a, e in zip((at * w).tolist(), ends)]))
            else:
                self.memo.update((p, i.tobytes()) for p, i in zip(some, self.library(some)))

    def _learn(self, pieces: list[str], whole: set[str]) -> None:
        """Words after a space, and those after a line feed, are encoded together, the rest one by one."""
        words, lines, rest = [], [], []
        for p in pieces:
            if p in whole or p[-1] <= " ":
                rest.append(p)
            elif p[0] == " ":
                words.append(p)
            elif self.parts and p[0] == "\n" != p[1]:
                lines.append(p)
            else:
                rest.append(p)
        self._ask(words, self.opens.__getitem__)
        if len(self.line_feed) == 1:
            self._ask(lines, lambda ids: ids == self.line_feed[0])
        else:
            rest += lines
        special = {p for p in whole if any(a in p for a in self.added)}
        self.memo.update((p, np.array(self.untouched.encode(p, add_special_tokens=False).ids, self.dtype).tobytes()) for p in special)
        for some, run in (([p for p in rest if p not in whole], ASKED), (list(whole.intersection(rest) - special), ASKED_WHOLE)):
            for k in range(0, len(some), run):
                self.memo.update((p, i.tobytes()) for p, i in zip(some[k:k + run], self.library(some[k:k + run])))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end."""
        if len(self.memo) > self.generation:
            self.memo, self.elder = {}, self.memo
        texts = texts.cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = data.slice(at[0], at[-1] - at[0]).to_pybytes() if at[-1] > at[0] else b""
        at = at - at[0]
        if not data:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        cuts, whole = self._cuts(data, at[:-1])
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        keys = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()  # str objects, sooner than by to_pylist
        if new := self._unknown(keys):
            self._learn(new, {data[at[k]:at[k + 1]].decode() for k in whole.tolist()})
        found = pa.array(list(map(self.memo.__getitem__, keys)), pa.large_binary())
        for p in [p for p in new if len(p) > self.longest]:
            del self.memo[p]
        row = found.take(pieces.indices)
        _, offsets, data = row.buffers()
        ends = np.frombuffer(offsets, np.int64)[row.offset:row.offset + len(row) + 1] // self.dtype.itemsize
        return np.frombuffer(data, self.dtype)[:ends[-1]], ends[np.searchsorted(cuts, at[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of the vocabulary's width."""
        ids, ends = self.ids(pa.array(texts, pa.large_string()))
        return [ids[a:e].tobytes() for a, e in zip([0, *ends.tolist()], ends.tolist())]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, about ``TEXT_BYTES`` of text at a time (a longer text by itself)."""
    for b in batches:
        if len(b):
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = (np.flatnonzero(np.diff(size // TEXT_BYTES)) + 1).tolist()
            for k, e in zip([0, *cuts], [*cuts, len(b)]):
                yield b.slice(k, e - k)


def token_rows(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """``part, doc_id, at, n, ids, seen``: documents in ascending id order within and across
    parts; ``at`` counts the ids before a document in its part. A last row of each part, with a
    null ``n``, has the part's count of every id (as 64-bit integers) in ``seen``, a column of its own, so that
    the counts are read without the ids."""
    names = ["part", "doc_id", "at", "n", "ids", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at, part = TextEncoder.of(path), 0, None
        seen = np.zeros(max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1), np.int64)
        for b in slices(batches):
            ids, ends = encoder.ids(b.column("text"))
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            ns = np.diff(ends, prepend=0)
            seen += np.bincount(ids, minlength=len(seen))
            part = b.column("part")[0].as_py()
            held = pa.Array.from_buffers(pa.binary(), len(ns), [None, pa.py_buffer(np.append(0, ends * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [b.column("part"), b.column("doc_id"), pa.array(at + ends - ns), pa.array(ns), held, pa.nulls(len(ns), pa.binary())], names)
            at += int(ends[-1])
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([None], pa.int64()), pa.array([at]), pa.array([None], pa.int64()),
                                              pa.array([None], pa.binary()), pa.array([seen.astype("<i8").tobytes()], pa.binary())], names)

    def uncollected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the memo's many objects are in no cycle, and each collection would walk them all
        try:
            yield from run(batches)
        finally:
            gc.enable()

    order = [F.col("doc_id"), F.xxhash64("text")]
    d = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*order)
         .sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    return d.mapInArrow(uncollected, "part int, doc_id long, at long, n long, ids binary, seen binary")


# --- the code ----------------------------------------------------------------------------

def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``max_bits`` bits (package-merge)."""
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    n = len(symbols)
    if n <= 1:
        return {s: 1 for s in symbols}
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit codes of {max_bits} bits")
    leaves = np.array([counts[s] for s in symbols], np.int64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        half = len(level) // 2
        merged = np.concatenate([leaves, level[:2 * half:2] + level[1:2 * half:2]])
        order = np.argsort(merged, kind="stable")
        level = merged[order]
        is_leaf.append(order < n)
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        taken = int(flags[:take].sum())
        bits[:taken] += 1
        take = 2 * (take - taken)
    return dict(zip(symbols, bits.tolist()))


class Code:
    """Canonical code: symbols in order of (length, symbol) get consecutive codes."""

    def __init__(self, lengths: dict[int, int], max_bits: int = MAX_BITS):
        self.max_bits = max_bits
        self.symbols = np.array(sorted(lengths, key=lambda s: (lengths[s], s)), np.uint32)
        self.bits = np.array([lengths[s] for s in self.symbols.tolist()], np.uint64)
        codes, code, last = [], 0, 0
        for b in self.bits.tolist():
            code <<= b - last
            codes.append(code)
            code, last = code + 1, b
        size = int(self.symbols.max()) + 1 if len(self.symbols) else 1
        self.bits_of, self.code_of = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.bits_of[self.symbols], self.code_of[self.symbols] = self.bits, np.array(codes, np.uint64)
        # table: every max_bits-bit look-ahead -> symbol and length
        fill = (np.uint64(1) << (np.uint64(max_bits) - self.bits)).astype(np.int64)
        rest = (1 << max_bits) - int(fill.sum())
        self.table_symbol = np.concatenate([np.repeat(self.symbols, fill), np.zeros(rest, np.uint32)])
        self.table_bits = np.concatenate([np.repeat(self.bits, fill), np.ones(rest, np.uint64)]).astype(np.int64)

    def encode(self, ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[bytes, np.ndarray]:
        """Bits of all ids and the bit offset at which each block begins."""
        if not len(ids):
            return b"", np.zeros(0, "<u8")
        marks, total = [], 0
        out = np.zeros(len(ids) * self.max_bits // 32 + 3, np.uint64)
        for k in range(0, len(ids), 64 * block):  # pieces that stay in the processor's cache
            piece = ids[k:k + 64 * block]
            bits = self.bits_of[piece]
            at = np.cumsum(bits) - bits + np.uint64(total)
            total = int(at[-1] + bits[-1])
            word = (at >> np.uint64(5)).astype(np.int64)
            value = self.code_of[piece] << (np.uint64(64) - (at & np.uint64(31)) - bits)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
            out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
            marks.append(at[::block])
        return out.astype(">u4").tobytes()[:(total + 7) // 8], np.concatenate(marks).astype("<u8")

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int, block: int = BLOCK_IDS) -> np.ndarray:
        """The ids of all blocks whose checkpoints are given; the last may be short."""
        if n == 0:
            return np.zeros(0, np.uint32)
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        ahead = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        pos, end = checkpoints.astype(np.int64), 8 * len(payload)
        out = np.empty((min(block, n), len(pos)), np.uint32)
        mask = np.uint32((1 << self.max_bits) - 1)
        for k in range(len(out)):
            look = (ahead[pos >> 3] >> (32 - self.max_bits - (pos & 7)).astype(np.uint32)) & mask
            out[k] = self.table_symbol[look]
            pos = np.minimum(pos + self.table_bits[look], end)  # a short last block runs into the end
        return out.T.reshape(-1)[:n] if len(out) == block else out[:n, 0]


# --- files -------------------------------------------------------------------------------

def count_ids(rows: DataFrame) -> DataFrame:
    """``symbol, n`` over all documents, from the parts' counts; each task sums its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for counts in b.column(0).to_pylist():
                got = np.frombuffer(counts, "<i8")
                total = got + total if len(total) else got.copy()
        s = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(total[s], pa.int64())], ["symbol", "n"])

    return rows.where("seen IS NOT NULL").select("seen").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID,
              max_bits: int = MAX_BITS) -> None:
    """Encodes all documents into the file format at ``path``."""
    spark = docs.sparkSession
    rows = written(token_rows(docs, tokenizer_path, end_id), "token-rows")
    counts = {r.symbol: r.n for r in count_ids(rows).toLocalIterator()}
    rows = rows.where("n IS NOT NULL")
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(s, b) for s, b in lengths.items()], "symbol long, bits int").coalesce(1) \
        .write.parquet(f"{path}/codebook")
    # one row per part: the ids of all parts before it
    parts = rows.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = spark.sparkContext.broadcast(
        {r.part: r.base for r in parts.select("part", F.coalesce(before, F.lit(0)).alias("base")).collect()})
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, base = Code(shared.value, max_bits), bases.value
        docs_, ids_, held, key = [], [], 0, None

        def segment():
            ids = np.concatenate(ids_).astype(_ID)
            payload, checkpoints = code.encode(ids)
            part, start = key
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([[d for d, _ in docs_]], pa.list_(pa.int64())),
                 pa.array([np.array([n for _, n in docs_], "<i8").tobytes()], pa.binary()),
                 pa.array([checkpoints.tobytes()], pa.binary()), pa.array([payload], pa.binary())],
                ["part", "start", "n_ids", "doc_ids", "counts", "checkpoints", "payload"])

        for b in batches:
            for part, doc, at, n, ids in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "at", "n", "ids"))):
                if docs_ and (key[0] != part or key[1] + held != base[part] + at or held >= SEGMENT_IDS):
                    yield segment()
                    docs_, ids_, held = [], [], 0
                if not docs_:
                    key = (part, base[part] + at)
                docs_.append((doc, n))
                ids_.append(np.frombuffer(ids, _width(ids, n)))
                held += n
        if docs_:
            yield segment()

    rows.select("part", "doc_id", "at", "n", "ids").mapInArrow(
        run, "part int, start long, n_ids long, doc_ids array<long>, counts binary, checkpoints binary, payload binary"
    ).write.option("compression", "none").parquet(f"{path}/segments")


def read_ids(spark: SparkSession, path: str, with_ids: bool = True, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document decoded from the files: ``doc_id, start, n_tokens,
    ids_crc32`` and, with ``with_ids``, ``ids`` (array of longs)."""
    lengths = {r.symbol: r.bits for r in spark.read.parquet(f"{path}/codebook").toLocalIterator()}
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value, max_bits)
        for b in batches:
            for r in b.to_pylist():
                counts = np.frombuffer(r["counts"], "<i8")
                ids = code.decode(r["payload"], np.frombuffer(r["checkpoints"], "<u8"), r["n_ids"]).astype(_ID)
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(ids[a:e].tobytes()) for a, e in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["start"], pa.int64()),
                        pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(np.append(starts, ends[-1:]).astype(np.int32), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return spark.read.parquet(f"{path}/segments").mapInArrow(run, schema)


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The registered query: write the files, read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write_ids(long_ids(with_column_names(docs, "doc_id", "text")), path, tokenizer_path)
    return read_ids(spark, path, with_ids=False)
