"""The prefix trie of conversations, by union-find over the neighbours of their sorted order.

A conversation is one row: a 16-byte key per turn, strung together, and the turns' lengths. The
rows are range-partitioned and sorted by (keys, conv_id), so equal conversations are next to each
other and a much repeated one is spread over tasks. In a partition every pair of neighbours gives
an edge as deep as their common prefix; union-find takes the edges in descending depth, and every
merge of components makes a branching node or adds a child to one. The other nodes lie on the
edges between branching nodes.

Only the path to a partition's first and the path to its last conversation can go on in other
partitions. Their nodes leave the partition as partial sums (its contracted forest); all other
nodes are final, but for the parent's id where that is such a node. The common prefixes across
the partitions' boundaries give edges again: the same union-find, over two vertices a partition,
says which partial nodes are one. That graph and the sums collected for it are as large as the
number of partitions, not the data.

``ends_sha256`` of a node across partitions is a running hash over blocks of ids in their order
(a block holds up to ``BLOCK_IDS`` of them), since SHA-256 is sequential.

Defined cases: a null role or text is empty; null turns come first, equal turns in the order of
role and text; rows without a conv_id belong to no conversation; equal rows are turns each of
their own; an empty table has no nodes. A conversation must fit a row (some 50 bytes a turn) and
a partition's conversations (about ``PART_BYTES`` of keys) a task; long texts don't matter, since
only their digest and length are kept. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import long_ids, with_column_names, written

GROUP, HEAD = 100, 6      # the first crc32(c) % 6 turns come from conversation c - c % 100
KEY = 16                  # bytes of a turn's key
PART_BYTES = 8 << 20
BLOCK_IDS = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()

#: kind 0: a final node; 1: a partial node of a first (side 0) or last (side 1) path; 2: a block
#: of ids that end at a partial node; 3: the partition's first and last keys. ``pid, side, depth``
#: name a partial node: for kind 0 the parent, unless parent_conv_id is known.
FOREST = ("kind int, pid int, side int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, chars long, block long, ids binary, last binary, ends_sha256 string")
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_FIELDS = [(n, _TYPES[t]) for n, t in (f.split() for f in FOREST.split(", "))]


def _turns(rows: DataFrame, *by) -> DataFrame:
    """A row per conversation: its turns in order, each ``(digest, chars)``."""
    order = [F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), F.col("role").alias("c"), *[F.col(x) for x in by]]
    t = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*order, F.col("digest"), F.col("chars")))).alias("turns"))
    return t


def conversations_in_order(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` with ``turns`` an array of ``(digest, chars)``. Texts stay behind, but for
    conversations with two different texts under one turn and role, whose order they give."""
    rows = long_ids(with_column_names(conversations, "conv_id", "turn", "role", "text"), "conv_id").where("conv_id IS NOT NULL")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows = rows.withColumn("chars", F.length("text").cast("long"))
    narrow = written(_turns(rows), "trie-turns")
    same = F.zip_with("turns", F.slice("turns", F.lit(2), F.size("turns")), lambda x, y: F.coalesce(
        x["a"].eqNullSafe(y["a"]) & x["b"].eqNullSafe(y["b"]) & (x["c"] == y["c"]) & (x["digest"] != y["digest"]), F.lit(False)))
    tied = narrow.where(F.exists(same, lambda x: x)).select("conv_id")
    pick = F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("turns")
    out = narrow.select("conv_id", pick)
    if tied.isEmpty():
        return out
    return out.join(tied, "conv_id", "left_anti").unionByName(_turns(rows.join(tied, "conv_id", "left_semi"), "text").select("conv_id", pick))


def rebuilt(convs: DataFrame) -> DataFrame:
    """The contract's conversations: the first h turns of ``c - c % 100``, then c's own after its
    first h. A head is five turns at most and has at most 199 takers."""
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    none = F.array().cast("array<struct<digest:string,chars:bigint>>")
    return convs.withColumn("base", base).join(heads, "base", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _common(a: bytes, b: bytes) -> int:
    """How many turns two conversations have in common from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) // KEY


def _merge(depth: list[int], edges: list[int]) -> tuple[list[int], list[int], list[list[int]]]:
    """Union-find over the edges between neighbours in descending depth. ``depth`` has the leaves'
    and gets the branching nodes'; returns it, every node's parent (-1: none) and children. A
    leaf that begins its right neighbours is a node with children itself."""
    depth, root, top = list(depth), list(range(len(depth))), list(range(len(depth)))
    parent, kids = [-1] * len(depth), [[] for _ in depth]

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for i in sorted(range(len(edges)), key=lambda i: -edges[i]):
        a, b = find(i), find(i + 1)
        left, right = top[a], top[b]
        if depth[left] != edges[i]:
            depth.append(edges[i])
            parent.append(-1)
            kids.append([left])
            parent[left] = left = len(depth) - 1
        # edges of one depth come from left to right, so the right component is deeper
        kids[left].append(right)
        parent[right] = left
        root[b] = a
        top[a] = left
    return depth, parent, kids


def _digest_of(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class _Rows:
    """Collects rows of ``FOREST`` and gives them out as record batches."""

    def __init__(self):
        self.rows = []

    def add(self, kind, pid, side=None, depth=None, conv=None, parent=None, n=None, children=None, leaves=None, saved=None, chars=None,
            block=None, ids=None, last=None, sha=None):
        self.rows.append((kind, pid, side, depth, conv, parent, n, children, leaves, saved, chars, block, ids, last, sha))

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*self.rows), _FIELDS)], [n for n, _ in _FIELDS])
            self.rows = []


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a sorted partition."""
    rows = ((p, k, c, s) for b in batches for p, k, c, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)))
    keys, ids, chars, pid = [], [], [], None
    for (pid, key), group in groupby(rows, key=lambda r: r[:2]):
        members = list(group)
        keys.append(key)
        ids.append([r[2] for r in members])
        chars.append(members[0][3].values.to_numpy() if len(key) else np.empty(0, np.int64))
    if not keys:
        return
    edges = [_common(a, b) for a, b in zip(keys, keys[1:])]
    depth, parent, kids = _merge([len(k) // KEY for k in keys], edges)
    size, n_leaf = len(depth), len(keys)
    n = [len(ids[i]) if i < n_leaf else 0 for i in range(size)]
    least = [ids[i][0] if i < n_leaf else None for i in range(size)]
    some = [i if i < n_leaf else -1 for i in range(size)]   # a leaf below, for the lengths of the turns
    leaves, saved, above = [0] * size, [0] * size, [0] * size
    path = [None] * size
    for x, side in ((n_leaf - 1, 1), (0, 0)):
        while x >= 0:
            path[x] = side
            x = parent[x]
    up = sorted(range(size), key=lambda x: -depth[x])
    for x in up:   # children first: sums, then what the edge to the parent saves (``above``)
        for y in kids[x]:
            n[x] += n[y]
            least[x] = least[y] if least[x] is None else min(least[x], least[y])
            some[x] = some[y] if some[x] < 0 else some[x]
            leaves[x] += leaves[y]
            saved[x] += saved[y] + above[y]
        if not kids[x]:
            leaves[x] = 1
        own = chars[some[x]]
        if depth[x]:
            saved[x] += (n[x] - 1) * int(own[depth[x] - 1])
        start = depth[parent[x]] if parent[x] >= 0 else -1
        above[x] = (n[x] - 1) * int(own[max(start, 0):max(depth[x] - 1, 0)].sum())
    out = _Rows()
    out.add(3, pid, ids=keys[0], last=keys[-1])
    for x in reversed(up):
        p = parent[x]
        start = depth[p] if p >= 0 else -1
        own, total, ends = chars[some[x]], saved[x], x < n_leaf
        for d in range(depth[x], start, -1):
            at_x = d == depth[x]
            if d and not at_x:
                total += (n[x] - 1) * int(own[d - 1])
            if path[x] is None:
                hangs = p >= 0 and path[p] is not None and d - 1 == start
                out.add(0, pid, path[p] if hangs else None, d, least[x], None if hangs else (least[p] if d - 1 == start else least[x]), n[x],
                        len(kids[x]) if at_x else 1, leaves[x], total, sha=_digest_of(ids[x]) if at_x and ends else EMPTY)
            else:   # what hangs off this node and lies in this partition alone
                off = [y for y in kids[x] if path[y] is None] if at_x else []
                out.add(1, pid, path[x], d, least[x], None, n[x], len(off), sum(leaves[y] for y in off), sum(saved[y] + above[y] for y in off),
                        int(own[d - 1]) if d else 0)
                if at_x and ends:
                    for k in range(0, len(ids[x]), BLOCK_IDS):
                        out.add(2, pid, path[x], d, block=k, ids=",".join(map(str, ids[x][k:k + BLOCK_IDS])).encode())
        yield from out.batches(20_000)
    yield from out.batches()


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the partitions' first and last keys, in order: the common depth within a partition and
    with the one before it."""
    before = None
    for b in batches:
        rows = []
        for pid, first, last in zip(*(b.column(k).to_pylist() for k in range(3))):
            rows.append((pid, _common(first, last), -1 if before is None else _common(before, first)))
            before = last
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["pid", "within", "before"])


class Merged:
    """The union-find over the partitions: vertices are the first (2i) and last (2i + 1) path of
    partition i, neighbours are joined as deep as they have their nodes in common."""

    def __init__(self, bounds: list[tuple[int, int, int]]):
        bounds = sorted(bounds)
        self.index = {pid: i for i, (pid, _, _) in enumerate(bounds)}
        weights = [w for i, (_, within, before) in enumerate(bounds) for w in ((before, within) if i else (within,))]
        leaf = max([0, *weights]) + 1   # deeper than every edge
        self.depth, self.parent, self.kids = _merge([leaf] * (2 * len(bounds)), weights)

    def component(self, pid: int, side: int, depth: int) -> int:
        """The component of a path's node: the highest that still joins at this depth."""
        x = 2 * self.index[pid] + side
        while self.parent[x] >= 0 and self.depth[self.parent[x]] >= depth:
            x = self.parent[x]
        return x

    def below(self, totals: dict[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Per component the leaves and savings of the components below it."""
        whole, out = {}, []
        for x in sorted(range(len(self.depth)), key=lambda x: -self.depth[x]):
            under = [sum(whole[y][k] for y in self.kids[x]) for k in (0, 1)]
            own = totals.get(x, (0, 0))
            whole[x] = (under[0] + own[0], under[1] + own[1])
            out.append((x, *under))
        return out


def _named(merged: Merged):
    """Adds the component of a row's path node (``component``) and of the node above (``over``)."""
    def run(batches):
        for b in batches:
            where = [b.column(b.schema.get_field_index(n)).to_pylist() for n in ("pid", "side", "depth", "up")]
            mine = [merged.component(p, s, d - u) for p, s, d, u in zip(*where)]
            over = [merged.component(p, s, max(d - u - 1, 0)) for p, s, d, u in zip(*where)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mine, pa.int64()), pa.array(over, pa.int64())],
                                             [*b.schema.names, "component", "over"])
    return run


def _with_component(rows: DataFrame, merged: Merged, up: int) -> DataFrame:
    rows = rows.withColumn("up", F.lit(up).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_named(merged), f"{schema}, component long, over long").drop("up")


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running SHA-256 over the blocks of each node, which come in order; blocks are not held."""
    rows = ((c, d, i) for b in batches for c, d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)))
    for (component, depth), blocks in groupby(rows, key=lambda r: r[:2]):
        sha, first = hashlib.sha256(), True
        for _, _, ids in blocks:
            if not first:
                sha.update(b",")
            sha.update(ids.as_py())
            first = False
        yield pa.RecordBatch.from_arrays([pa.array([component], pa.int64()), pa.array([depth], pa.int64()), pa.array([sha.hexdigest()])],
                                         ["component", "depth", "ends"])


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(convs: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row per node of the trie of ``convs(conv_id, turns)`` (unique conv_ids)."""
    spark = convs.sparkSession
    strung = written(convs.select(F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), "")).alias("keys"), "conv_id",
                                  F.transform("turns", lambda x: x["chars"]).alias("chars")), "trie-keys")
    if partitions is None:
        held = strung.agg(F.sum(F.length("keys") + 64)).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // PART_BYTES))
    ordered = strung.repartitionByRange(partitions, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    forest = written(ordered.select(F.spark_partition_id().alias("pid"), "keys", "conv_id", "chars").mapInArrow(_forest, FOREST), "trie-forest")

    edges = forest.where("kind = 3").select("pid", "ids", "last").repartition(1).sortWithinPartitions("pid")
    merged = Merged([tuple(r) for r in edges.mapInArrow(_boundaries, "pid long, within long, before long").collect()])
    partial = _with_component(forest.where("kind = 1"), merged, 0)
    nodes = written(partial.groupBy("component", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("chars").alias("chars"),
        F.max("over").alias("over")), "trie-partial")
    steps = nodes.where("depth > 0").groupBy(F.col("over").alias("component"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("more"))
    on = ["component", "depth"]
    nodes = nodes.join(steps, on, "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = nodes.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn(
        "saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars"))
    sums = own.groupBy("component").agg(F.sum("n_leaves"), F.sum("saved_tokens")).collect()   # four rows a partition at most
    below = spark.createDataFrame(merged.below({r[0]: (r[1], r[2]) for r in sums}), "component long, below_leaves long, below_saved long")
    deeper = Window.partitionBy("component").orderBy(F.col("depth").desc())
    blocks = _with_component(forest.where("kind = 2").select("pid", "side", "depth", "block", "ids"), merged, 0)
    ends = blocks.repartition(*on).sortWithinPartitions(*on, "pid", "block").select(*on, "ids").mapInArrow(
        _hash_blocks, "component long, depth long, ends string")
    above = nodes.select(F.col("component").alias("over"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    shared = own.join(below, "component").withColumn("n_leaves", F.sum("n_leaves").over(deeper) + F.col("below_leaves")).withColumn(
        "saved_tokens", F.sum("saved_tokens").over(deeper) + F.col("below_saved"))
    shared = shared.join(above, ["over", "depth"], "left").join(ends, on, "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY)))

    final = forest.where("kind = 0")
    hanging = _with_component(final.where("side IS NOT NULL").select("pid", "side", *[c for c in NODE if c != "parent_conv_id"]), merged, 1)
    parents = nodes.select("component", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    return (final.where("side IS NULL").select(*NODE).unionByName(hanging.join(parents, on).select(*NODE)).unionByName(shared.select(*NODE)))


def digest(conversations: DataFrame) -> DataFrame:
    return prefix_trie(rebuilt(conversations_in_order(conversations)))


_CRC = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), "
        "lambda acc, x: list_reduce(list_prepend(xor(acc, x), CAST(range(8) AS BIGINT[])), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)")
DIGEST_SQL = f"""WITH c AS (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_CRC} % {HEAD} AS h FROM (SELECT DISTINCT conv_id FROM c) x),
r AS (SELECT i.conv_id, c.role, c.text, row_number() OVER (PARTITION BY i.conv_id ORDER BY c.conv_id IS DISTINCT FROM i.base OR c.pos > i.h, c.pos) AS d
  FROM ids i JOIN c ON (c.conv_id = i.base AND c.pos <= i.h) OR (c.conv_id = i.conv_id AND c.pos > i.h)),
p AS (SELECT conv_id, d, length(text) AS chars, string_agg(sha256(length(role) || ':' || role || text), '') OVER (
    PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS prefix FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
k AS (SELECT conv_id, d, chars, CASE WHEN d = 0 THEN '' ELSE sha256(prefix) END AS node, max(d) OVER (PARTITION BY conv_id) AS len FROM p),
n AS (SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
  sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len = d), '')) AS ends_sha256 FROM k GROUP BY d, node),
up AS (SELECT DISTINCT a.d, a.node, b.node AS above FROM k a JOIN k b ON b.conv_id = a.conv_id AND b.d = a.d - 1),
kids AS (SELECT d - 1 AS d, above AS node, count(*) AS n FROM up GROUP BY 1, 2),
pairs AS (SELECT DISTINCT a.d, a.node, b.d AS dd, b.node AS dnode FROM k a JOIN k b ON b.conv_id = a.conv_id AND b.d >= a.d),
sub AS (SELECT p.d, p.node, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved
  FROM pairs p JOIN n m ON m.d = p.dd AND m.node = p.dnode LEFT JOIN kids ON kids.d = p.dd AND kids.node = p.dnode GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, COALESCE(kids.n, 0) AS n_children, s.n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN sub s ON s.d = n.d AND s.node = n.node LEFT JOIN kids ON kids.d = n.d AND kids.node = n.node
LEFT JOIN up ON up.d = n.d AND up.node = n.node LEFT JOIN n q ON q.d = n.d - 1 AND q.node = up.above"""
