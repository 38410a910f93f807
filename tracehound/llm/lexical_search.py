"""Ranked lexical search over impact vectors in norm buckets (after LEMP).

A document's vector has a coordinate per query term that it holds: the term's impact in it times
the root of the term's weight; a query's has its count of the term times that root. The score is
their inner product. The vectors of a task's rows are sorted by length (norm) and cut into
buckets, each a row of a written table. A query skips a bucket if its own norm times the bucket's
largest can't reach the query's threshold (Cauchy-Schwarz). Inside a bucket it reads the lists of
its largest coordinates only, as many as leave a rest that can't reach the threshold alone; every
document found there must reach it with its partial score and the Cauchy-Schwarz bound of the
rest. Survivors are scored exactly in 64-bit integers.

The first buckets are searched first; their 20th best scores are thresholds for all others, whose
table is filtered by norm when it is read. A document that ties with the threshold is kept, and
bounds have slack for rounding, so the result is exact. Nothing is shuffled but term counts and
each task's best rows. The queries are taken in blocks of about ``BLOCK_BYTES`` of text: what is
sent to the tasks has that bound, whatever the number of items.

Defined cases: a null text has no term; an item without a term or without a hit has no rows; each
row of the items is an item of its own, also with a repeated or null item_id, and each row of the
documents a document; a null doc_id comes after all others. Long texts are whole; rows of one
task are packed about ``RUN_COORDS`` coordinates at a time. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import with_column_names, written

TOP = 20
BLOCK_BYTES = 8 << 20
PAGE_BYTES = 4 << 20
BUCKET_DOCS, BUCKET_COORDS = 2048, 1 << 19
#: Coordinates (12 bytes each) that a task sorts at once.
RUN_COORDS = 2 << 20
SLACK = 1 + 1e-9
NO_ID = np.iinfo(np.int64).max   # a null doc_id sorts last

#: The contract's terms on UTF-8 bytes: ASCII letters and digits and all bytes from 0x80.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

VECTORS = "n binary, doc_id binary, coords binary, term binary, tf binary, n_docs long, n_terms long, df_term binary, df binary"
BUCKETS = "longest double, first boolean, doc_id binary, coords binary, term binary, impact binary"
HITS = "query long, item_id long, doc_id long, score long"


def terms(raw: bytes | None) -> list[bytes]:
    return raw.translate(_TABLE).split() if raw else []


def _batch(schema: str, *values) -> pa.RecordBatch:
    types = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], types[t]) for (_, t), v in zip(fields, values)], [n for n, _ in fields])


def _vectors(vocabulary: dict[bytes, int]):
    """Pages of documents as sparse counts of the vocabulary's terms; at the end of a task a row
    with its share of the corpus counts."""
    def page(rows):
        n = np.array([r[1] for r in rows], "<i8")
        found = [r[2] for r in rows]
        size = len(vocabulary) or 1
        key = np.concatenate([f + size * i for i, f in enumerate(found)]) if found else np.empty(0, np.int64)
        key, tf = np.unique(key, return_counts=True)
        where, term = np.divmod(key, size)
        return (n.tobytes(), np.array([r[0] for r in rows], "<i8").tobytes(), np.bincount(where, minlength=len(rows)).astype("<i4").tobytes(),
                term.astype("<i4").tobytes(), tf.astype("<i4").tobytes()), term

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms, rows, held = np.zeros(len(vocabulary), np.int64), 0, 0, [], 0
        get = vocabulary.get
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = text.as_py()
                words = terms(raw)
                n_docs, n_terms, held = n_docs + bool(words), n_terms + len(words), held + len(raw or b"")
                found = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                found = found[found >= 0]
                if len(found):
                    rows.append((NO_ID if doc is None else doc, len(words), found))
                if rows and held >= PAGE_BYTES:
                    packed, seen = page(rows)
                    df += np.bincount(seen, minlength=len(df))
                    yield _batch(VECTORS, *packed, None, None, None, None)
                    rows, held = [], 0
        packed, seen = page(rows)
        df += np.bincount(seen, minlength=len(df))
        used = np.flatnonzero(df)
        yield _batch(VECTORS, *packed, n_docs, n_terms, used.astype("<i4").tobytes(), df[used].astype("<i8").tobytes())
    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' document frequencies, summed up to ``RUN_COORDS`` entries at a time."""
    names = ["term", "df"]

    def out(t, c):
        t, c = np.concatenate(t), np.concatenate(c)
        u, inverse = np.unique(t, return_inverse=True)
        total = np.zeros(len(u), np.int64)
        np.add.at(total, inverse, c)
        return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(total)], names)
    t, c, held = [], [], 0
    for b in batches:
        for x, y in zip(b.column(0), b.column(1)):
            t.append(np.frombuffer(x.as_py(), "<i4"))
            c.append(np.frombuffer(y.as_py(), "<i8"))
            held += len(t[-1])
            if held >= RUN_COORDS:
                yield out(t, c)
                t, c, held = [], [], 0
    if t:
        yield out(t, c)


def _buckets(weight: np.ndarray, n_docs: int, n_terms: int):
    """Vectors by descending norm, in buckets. ``longest`` is a bucket's largest norm, ``first``
    marks the first bucket of a run."""
    def cut(run):
        doc, coords, term, impact = (np.concatenate(x) for x in zip(*run))
        start = np.concatenate([[0], np.cumsum(coords)])
        square = np.add.reduceat(weight[term] * impact.astype(np.float64) ** 2, start[:-1])
        order = np.lexsort((doc, -square))
        a = 0
        while a < len(order):
            e = a + max(1, min(BUCKET_DOCS, int(np.searchsorted(np.cumsum(coords[order[a:a + BUCKET_DOCS]]), BUCKET_COORDS, "right"))))
            pick = order[a:e]
            at = np.repeat(start[pick] - np.concatenate([[0], np.cumsum(coords[pick])[:-1]]), coords[pick]) + np.arange(coords[pick].sum())
            yield _batch(BUCKETS, float(np.sqrt(square[pick[0]])), a == 0, doc[pick].tobytes(), coords[pick].astype("<i4").tobytes(),
                         term[at].astype("<i4").tobytes(), impact[at].astype("<i4").tobytes())
            a = e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for raw in zip(*(b.column(k).to_pylist() for k in range(5))):
                n, doc, coords, term, tf = (np.frombuffer(x, d).astype(np.int64) for x, d in zip(raw, ("<i8", "<i8", "<i4", "<i4", "<i4")))
                m = np.repeat(75 + (25 * n * n_docs) // n_terms, coords)
                impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
                keep = weight[term] > 0
                row = np.repeat(np.arange(len(doc)), coords)[keep]
                left = np.bincount(row, minlength=len(doc))
                rows.append((doc[left > 0], left[left > 0], term[keep], impact[keep]))
                held += int(keep.sum())
                if held >= RUN_COORDS:
                    yield from cut(rows)
                    rows, held = [], 0
        if held:
            yield from cut(rows)
    return run


class Query:
    """An item: its terms by descending coordinate, with count times weight (``gain``) and the
    norms of what is left from each on (``rest``)."""

    def __init__(self, number: int, item_id: int | None, counts: dict[int, int], weight: np.ndarray):
        self.number, self.item_id = number, item_id
        t = np.array(sorted(counts), np.int64)
        c = np.array([counts[x] for x in t.tolist()], np.int64)
        t, c = t[weight[t] > 0], c[weight[t] > 0]
        coordinate = c * np.sqrt(weight[t].astype(np.float64))
        order = np.lexsort((t, -coordinate))
        self.term, self.gain = t[order], (c * weight[t])[order]
        self.rest = np.sqrt(np.concatenate([np.cumsum(coordinate[order][::-1] ** 2)[::-1], [0.0]]))
        self.norm = float(self.rest[0])


def _search(queries: list[Query], weight: np.ndarray, thresholds: dict[int, int]):
    """Each query's best ``TOP`` documents of a task's buckets that reach its threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q.number: (np.empty(0, np.int64), np.empty(0, np.int64)) for q in queries}   # scores, documents
        least = {q.number: thresholds.get(q.number, 1) for q in queries}
        gain = np.zeros(len(weight), np.int64)
        for b in batches:
            for longest, *raw in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("longest", "doc_id", "coords", "term", "impact"))):
                alive = [q for q in queries if q.norm * longest * SLACK >= least[q.number]]   # Cauchy-Schwarz on the bucket
                if not alive:
                    continue
                doc, coords, term, impact = (np.frombuffer(x, d).astype(np.int64) for x, d in zip(raw, ("<i8", "<i4", "<i4", "<i4")))
                row = np.repeat(np.arange(len(doc)), coords)
                start = np.concatenate([[0], np.cumsum(coords)])
                part = weight[term] * impact.astype(np.float64) ** 2
                square = np.bincount(row, part, len(doc))
                order = np.argsort(term, kind="stable")
                lists = term[order]
                for q in alive:
                    focus = int(np.searchsorted(-(q.rest * longest * SLACK), -least[q.number], "right"))   # lists whose rest can still reach it
                    focus = min(focus, len(q.term))
                    score, covered = np.zeros(len(doc), np.int64), np.zeros(len(doc))
                    a, e = np.searchsorted(lists, q.term[:focus]), np.searchsorted(lists, q.term[:focus], "right")
                    for k in range(focus):
                        at = order[a[k]:e[k]]
                        score[row[at]] += q.gain[k] * impact[at]
                        covered[row[at]] += part[at]
                    bound = score + q.rest[focus] * np.sqrt(np.maximum(square * SLACK - covered, 0.0))
                    left = np.flatnonzero((score > 0) & (bound * SLACK >= least[q.number]))
                    if not len(left):
                        continue
                    gain[q.term] = q.gain   # survivors: whole vectors, in integers
                    at = np.repeat(start[left] - np.concatenate([[0], np.cumsum(coords[left])[:-1]]), coords[left]) + np.arange(coords[left].sum())
                    exact = np.add.reduceat(gain[term[at]] * impact[at], np.concatenate([[0], np.cumsum(coords[left])[:-1]]))
                    gain[q.term] = 0
                    s, d = np.concatenate([best[q.number][0], exact]), np.concatenate([best[q.number][1], doc[left]])
                    top = np.lexsort((d, -s))[:TOP]
                    top = top[s[top] >= least[q.number]]
                    best[q.number] = s[top], d[top]
                    if len(top) == TOP:
                        least[q.number] = max(least[q.number], int(s[top[-1]]))
        for q in queries:
            s, d = best[q.number]
            if len(s):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q.number] * len(s), pa.int64()), pa.array([q.item_id] * len(s), pa.int64()),
                     pa.array(d, mask=d == NO_ID), pa.array(s)], ["query", "item_id", "doc_id", "score"])
    return run


def _top(hits: DataFrame) -> DataFrame:
    """The best rows per query: first per query and slice of the tasks, then per query."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rank = F.row_number()
    some = hits.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = some.withColumn("rank", rank.over(Window.partitionBy("query", "slice").orderBy(*order))).where(F.col("rank") <= TOP).drop("slice")
    return some.withColumn("rank", rank.over(Window.partitionBy("query").orderBy(*order)).cast("int")).where(F.col("rank") <= TOP)


def _search_block(docs: DataFrame, items: list) -> DataFrame:
    """The hits of the queries ``items`` (rows ``query, item_id, text``)."""
    spark = docs.sparkSession
    counted, vocabulary = [], {}
    for r in items:
        c: dict[int, int] = {}
        for w in terms(r["text"]):
            t = vocabulary.setdefault(w, len(vocabulary))
            c[t] = c.get(t, 0) + 1
        counted.append((r["query"], r["item_id"], c))
    if not vocabulary:
        return spark.createDataFrame([], HITS)
    vectors = written(docs.mapInArrow(_vectors(vocabulary), VECTORS), "search-vectors")
    total = vectors.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = total["n"] or 0, total["l"] or 0
    if not n_docs:
        return spark.createDataFrame([], HITS)
    df = np.zeros(len(vocabulary), np.int64)
    shares = vectors.where("df IS NOT NULL").select("df_term", "df").mapInArrow(_counts, "term long, df long")
    for r in shares.groupBy("term").agg(F.sum("df").alias("df")).collect():   # one row per term of the block
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    queries = [q for q in (Query(*c, weight) for c in counted) if len(q.term)]
    pages = vectors.where(F.length("doc_id") > 0).select("n", "doc_id", "coords", "term", "tf")
    buckets = written(pages.mapInArrow(_buckets(weight, n_docs, n_terms), BUCKETS), "search-buckets")
    first = written(buckets.where("first").mapInArrow(_search(queries, weight, {}), HITS), "search-first")
    seen = {r["query"]: r["score"] for r in _top(first).where(F.col("rank") == TOP).select("query", "score").collect()}   # one row per query at most
    reach = min((seen.get(q.number, 1) / (q.norm * SLACK) for q in queries), default=math.inf)   # no query needs shorter vectors
    others = buckets.where(~F.col("first") & (F.col("longest") >= reach))
    return first.unionByName(others.mapInArrow(_search(queries, weight, seen), HITS))


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``query, item_id, rank, doc_id, score``: the best ``TOP`` documents of every row of
    ``items`` (``item_id, text``); ``query`` is that row's number."""
    docs = with_column_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    items = with_column_names(items, "item_id", "text").select(
        F.monotonically_increasing_id().alias("query"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    items = written(items, "search-items")
    held = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-held // BLOCK_BYTES))
    # by turns over the blocks, so that each has about the same number of items
    dealt = F.pmod(F.shiftrightunsigned("query", 33) + F.col("query"), F.lit(blocks))
    found = None
    for k in range(blocks):
        hits = _search_block(docs, items.where(dealt == k).collect())   # about BLOCK_BYTES
        found = hits if found is None else found.unionByName(hits)
    return _top(found).select("query", "item_id", "rank", "doc_id", "score")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items).select("item_id", "rank", "doc_id", "score")


DIGEST_SQL = f"""WITH t AS (SELECT k, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents) d),
len AS (SELECT k, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY k),
tot AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM len),
q AS (SELECT query, any_value(item_id) AS item_id, term, count(*) AS c FROM (SELECT query, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS query, item_id, text FROM benchmark) b) x GROUP BY query, term),
tf AS (SELECT k, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, tot GROUP BY term),
s AS (SELECT q.query, any_value(q.item_id) AS item_id, k, any_value(len.doc_id) AS doc_id,
  CAST(sum(q.c * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * len.n * tot.nd) // tot.l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN len USING (k), tot GROUP BY q.query, k),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= {TOP}"""
