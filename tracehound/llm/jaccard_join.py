"""Operator 4, n-gram Jaccard join with token-combination prefixes.

Two texts are linked when the sets of their five-word shingles have a Jaccard similarity of
at least 0.75. Tokens are shingle hashes; a *class* is all documents with one set.

1. Document frequencies. The input is packed in pages, runs of rows of bounded bytes. Every page
   sends its distinct tokens, four bytes each in buckets by their leading bits and packed as
   differences, to the buckets' tasks, which answer each page with those of its tokens that
   other sets have too, and their frequency class.
2. Prefixes. A set's tokens are ordered by (frequency class, hash). With n tokens, a linked set
   misses at most m - 1 = n - ceil(0.75 n) of them. A set with m tokens that nobody else has is
   linked with nothing and leaves. For the others, rare tokens index singly; frequent ones
   (a document frequency of 32 and more) are dealt to sub-classes and index as combinations
   of two within a sub-class. The prefix is extended until no choice of m - 1 missing tokens
   can spoil all: each rare token counts one, each sub-class its tokens less one, m in all.
   Of two linked sets, the prefix that ends first lies in the other's, so both hold a common
   rare token or a common pair. Sub-classes are counted by size band (factor 4/3); a set indexes
   under its own band and the next, so sets that can be linked share a band.
3. Clusters. Sets with a common index key are candidates; each key links its sets with its
   smallest one, and connected components give clusters no link crosses.
4. Verification, exactly, in blocks of ``BLOCK`` sets: first each cluster's diagonal blocks and
   its first block against all; then, numbered anew by component, all pairs of blocks that are
   not yet one component. A pair of blocks is one row group of bounded size, counted by
   token in a task, which returns a spanning forest of its links; no pairs are emitted.
5. Components of the links; the smallest doc_id of a component names it.

Nothing is capped: clusters of any size are verified whole, block by block. Defined results:
fewer than five words give the whole sequence as one shingle; null, empty or blank texts have
no shingles and are linked with nothing; repeated rows are rows of one class; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIN_SIMILARITY_PCT, mix, shingle_set, written
from .components import connected, numbered
from .pages import pack, squeeze, stretch, unpack

FREQUENT = 20  # frequency class (four to a doubling) of 32 sets and more
SUBCLASS_TOKENS = 32  # set tokens to a sub-class: about 8 of a prefix
SMALL_BAND = 8  # bands below hold sets of under ten tokens: single tokens only
BLOCK = 128
BUCKET_BYTES = 6 << 20  # of packed text to a bucket of tokens, and 64 buckets at least
TOKEN_COLUMNS = 4096

_BAND_LOW = [0, 1]
while _BAND_LOW[-1] < 1 << 62:  # smallest size of each band; the next is 4/3 of it at least
    _BAND_LOW.append(max(_BAND_LOW[-1] + 1, -(-4 * _BAND_LOW[-1] // 3)))
_BAND_LOW = np.array(_BAND_LOW, np.int64)


def prefix_budget(n: int) -> int:
    """m: one more than the tokens that a linked set can miss."""
    return n - (-(-MIN_SIMILARITY_PCT * n // 100)) + 1


def set_digest(tokens: np.ndarray) -> int:
    """A signed 64-bit digest of a sorted set of tokens."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def index_keys(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray | None:
    """The index keys of a set, or None if it is linked with nothing. ``classes``: 0 for a
    token of this set only, else its frequency class."""
    n = len(tokens)
    m = prefix_budget(n)
    if n == 0 or int((classes == 0).sum()) >= m:
        return None
    order = np.lexsort((tokens, classes))
    tokens, classes = tokens[order], classes[order]
    band = int(np.searchsorted(_BAND_LOW, n, side="right")) - 1
    out = []
    for b in (band, band + 1):
        salt = mix(np.array([b], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
        if b < SMALL_BAND:
            single, pair = np.arange(m), np.zeros(0, np.int64)
        else:
            frequent = classes >= FREQUENT
            parts = max(1, int(_BAND_LOW[b]) // SUBCLASS_TOKENS)
            sub = np.where(frequent, (mix(tokens) % np.uint64(parts)).astype(np.int64), -1)
            counts = np.ones(n, np.int64)
            _, first = np.unique(sub, return_index=True)
            counts[first[sub[first] >= 0]] = 0
            end = int(np.searchsorted(np.cumsum(counts), m)) + 1
            if end > n:
                raise AssertionError("a prefix must hold its budget")
            single, pair = np.flatnonzero(~frequent[:end]), np.flatnonzero(frequent[:end])
        single = single[classes[single] > 0]
        out.append(mix(tokens[single] ^ salt))
        if len(pair):
            pair = pair[np.lexsort((tokens[pair], sub[pair]))]
            s, h = sub[pair], tokens[pair]
            for gap in range(1, len(pair)):
                same = s[gap:] == s[:-gap]
                if not same.any():
                    break
                out.append(mix(mix(h[:-gap][same] ^ salt) + h[gap:][same]))
    return np.unique(np.concatenate(out))


# --- 1: document frequencies -------------------------------------------------------------

def _requests(bits: int):
    shift = np.uint64(32 - bits)

    def rows(page: int, sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(list(sets.values())) >> shift, return_counts=True)
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        low = keys.astype("<u4")
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cut[1:], len(keys))
        many = [np.flatnonzero(counts[a:e] > 1).astype("<u4") for a, e in zip(cut, ends)]
        return pa.RecordBatch.from_arrays(
            [pa.array([page] * len(cut), pa.int64()), pa.array(bucket[cut], pa.int32()),
             pa.array([squeeze(low[a:e], ascending=True) for a, e in zip(cut, ends)], pa.binary()),
             pa.array([x.tobytes() for x in many], pa.binary()),
             pa.array([counts[a:e][x].astype("<u4").tobytes() for a, e, x in zip(cut, ends, many)], pa.binary())],
            ["page", "bucket", "vals", "many", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sets = {}
                for _, _, _, raw in unpack(r["rid"], r["doc_id"], r["flag"], r["size"], r["texts"]):
                    s = shingle_set(raw)
                    if len(s):
                        sets[set_digest(s)] = s
                if sets:
                    yield rows(r["page"], sets)

    return run


def _answers(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket: its tokens from all pages; back go the shared ones with their class."""
    vals = [stretch(v, "<u4", ascending=True) for v in group.vals]
    size = np.array([len(v) for v in vals])
    every = np.concatenate(vals)
    times = np.ones(len(every), np.uint32)
    for start, many, n in zip(np.cumsum(size) - size, group.many, group.times):
        times[start + np.frombuffer(many, "<u4")] = np.frombuffer(n, "<u4")
    order = np.argsort(every, kind="stable").astype(np.uint32)  # a bucket's tokens are far below 2**32
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    total = np.add.reduceat(times[order], first, dtype=np.int64)
    runs = np.diff(np.append(first, len(every)))
    del every, times, first
    # class 0: in no other set
    cls = np.empty(len(order), np.uint8)
    cls[order] = np.repeat(np.minimum(255, np.floor(4 * np.log2(total))).astype(np.uint8), runs)
    out, at = [], 0
    for page, bucket, v in zip(group.page, group.bucket, vals):
        shared = cls[at:at + len(v)] > 0
        if shared.any():
            out.append((page, bucket, squeeze(v[shared], ascending=True), squeeze(cls[at:at + len(v)][shared])))
        at += len(v)
    return pd.DataFrame(out, columns=["page", "bucket", "vals", "cls"])


# --- 2: prefixes -------------------------------------------------------------------------

def _index(bits: int):
    shift = np.uint64(32 - bits)

    def run(page: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if len(answers):
            known = np.concatenate([(np.uint64(b) << np.uint64(32)) | stretch(v, "<u4", ascending=True).astype(np.uint64)
                                    for b, v in zip(answers.bucket, answers.vals)])
            cls = np.concatenate([stretch(c, "<u1") for c in answers.cls])
            order = np.argsort(known, kind="stable")
            known, cls = known[order], cls[order]
        else:
            known, cls = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        out = []
        for rid, doc, raw in ((r, d, raw) for p in page.itertuples() for r, d, _, raw in unpack(p.rid, p.doc_id, p.flag, p.size, p.texts)):
            s = shingle_set(raw)
            tokens = keys = None
            digest = None
            if len(s):
                digest = set_digest(s)
                look = s >> shift
                at = np.searchsorted(known, look)
                at[at == len(known)] = 0
                hit = known[at] == look if len(known) else np.zeros(len(s), bool)
                got = index_keys(s, np.where(hit, cls[at] if len(known) else 0, 0))
                if got is not None:
                    tokens, keys = s.tobytes(), got.view(np.int64)
            out.append((rid, doc, len(s), digest, tokens, keys))
        return pd.DataFrame(out, columns=["rid", "doc_id", "n", "digest", "tokens", "keys"]).astype({"rid": "int64", "doc_id": "Int64", "n": "int64", "digest": "Int64"})

    return run


# --- 4: verification ---------------------------------------------------------------------

def links_in_blocks(node: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different components."""
    n = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    _, token, times = np.unique(every, return_inverse=True, return_counts=True)
    keep = times[token] > 1  # others are in no intersection
    owner, token = owner[keep], token[keep]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, TOKEN_COLUMNS):
        a, e = np.searchsorted(token, [at, at + TOKEN_COLUMNS])
        has = np.zeros((len(sets), TOKEN_COLUMNS), np.float32)
        has[owner[a:e], token[a:e] - at] = 1
        both += has @ has.T  # exact: whole numbers far below 2**24
    both = both.astype(np.int64)
    linked = 100 * both >= MIN_SIMILARITY_PCT * (n[:, None] + n[None, :] - both)
    linked &= comp[:, None] != comp[None, :]
    root = {c: c for c in comp.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        a, b = find(int(comp[i])), find(int(comp[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(node[i]), int(node[j])))
    return out


def _verify_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("node", kind="stable")
    found = links_in_blocks(group.node.to_numpy(), group.comp.to_numpy(), [np.frombuffer(t, np.uint64) for t in group.tokens])
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _verify(nodes: DataFrame, placed: DataFrame, off_diagonal: bool) -> DataFrame:
    """Links ``a, b`` found by comparing blocks. ``placed``: ``cluster, node, comp, rank``."""
    placed = placed.withColumn("block", F.floor(F.col("rank") / BLOCK))
    blocks = placed.groupBy("cluster", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    other = blocks.select("cluster", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = blocks.join(other, "cluster").where("block <= block2")
    if not off_diagonal:
        pairs = pairs.where("block = block2 or block = 0")
    pairs = pairs.where("not (lo = hi and lo2 = hi2 and lo = lo2)").select("cluster", "block", "block2")
    sides = pairs.select("cluster", F.col("block").alias("at"), "block", "block2").union(
        pairs.where("block <> block2").select("cluster", F.col("block2").alias("at"), "block", "block2"))
    # dealt by block, not by cluster alone: a hot cluster's blocks go to different tasks
    at = ["cluster", "at"]
    rows = (placed.withColumnRenamed("block", "at").repartition(*at).join(sides.repartition(*at), at)
            .select("node", "comp", "cluster", "block", "block2").join(nodes.select("node", "tokens"), "node"))
    return rows.groupBy("cluster", "block", "block2").applyInPandas(_verify_group, "a long, b long")


def classes(docs: DataFrame, row_id: str | None = None) -> DataFrame:
    """``rid, doc_id, n_shingles, class_id, component_id, component`` of every row: ``class_id`` is the
    smallest doc_id with the same set, ``component_id`` the smallest one reachable by links.
    ``row_id`` names a column of ``docs`` with a distinct long for each row, which comes back
    as ``rid``; without it rows are numbered here. ``component`` tells the components apart whatever
    their doc_ids are (null without a shingle)."""
    rid = F.col(f"`{row_id}`") if row_id else F.monotonically_increasing_id()
    d = pack(docs, rid, F.lit(False), "jaccard-docs")
    # by the input's size, so that a bucket's tokens fit a task and its messages aren't tiny
    packed = d.agg(F.sum(F.length("texts"))).first()[0] or 0
    bits = min(24, max(6, (packed // BUCKET_BYTES).bit_length()))
    asked = d.mapInArrow(_requests(bits), "page long, bucket int, vals binary, many binary, times binary")
    answers = asked.groupBy("bucket").applyInPandas(_answers, "page long, bucket int, vals binary, cls binary")
    sets = written(d.groupBy("page").cogroup(answers.groupBy("page")).applyInPandas(
        _index(bits), "rid long, doc_id long, n long, digest long, tokens binary, keys array<long>"), "jaccard-sets")

    # one node for each class that may have links
    held = sets.where("digest is not null")
    one = held.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.min("rid").alias("rid"))
    nodes = written(held.where("tokens is not null").join(one.select("rid"), "rid", "left_semi")
                    .select(F.col("digest").alias("node"), "tokens", "keys"), "jaccard-nodes")
    keys = nodes.select("node", F.explode("keys").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    near = keys.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = connected(near).withColumnRenamed("label", "cluster")

    placed = numbered(clusters.withColumn("comp", F.col("node")), "cluster", [F.xxhash64("node")], "jaccard-blocks")
    links = written(_verify(nodes, placed, off_diagonal=False), "jaccard-links")
    comps = connected(links)
    again = clusters.join(comps, "node", "left").select("cluster", "node", F.coalesce("label", "node").alias("comp"))
    placed = numbered(again, "cluster", [F.col("comp"), F.col("node")], "jaccard-blocks")
    rest = placed.join(placed.groupBy("cluster").agg(F.max("rank").alias("last"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                       .where(f"last >= {BLOCK} and lo <> hi").select("cluster"), "cluster", "left_semi")
    links = written(links.union(_verify(nodes, rest, off_diagonal=True)), "jaccard-links")
    comps = connected(links)

    # names: the smallest doc_id of the component's classes
    named = one.join(comps, one.digest == comps.node, "left").select(
        "digest", "class_id", F.coalesce("label", "digest").alias("comp"))
    least = named.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    named = written(named.join(least, "comp").select("digest", "class_id", "component_id", F.col("comp").alias("component")), "jaccard-names")
    return sets.select("rid", "doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left").select(
        "rid", "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def digest(docs: DataFrame) -> DataFrame:
    """The registered query."""
    return classes(docs).select("doc_id", "n_shingles", "component_id")


#: DuckDB SQL of the registered query: all pairs that share a shingle, then closure.
DIGEST_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p+4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
          JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
