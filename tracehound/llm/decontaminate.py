"""Operator 6, benchmark decontamination: SimHash fingerprints of item-sized windows, a
multi-index over Hamming blocks, exact weighted-shingle similarity.

1. Seeds. A window can only be similar to an item if they have a five-word shingle in common,
   so windows are laid where a document holds a benchmark shingle: as many words as the
   item has, aligned on that shingle (and moved inside the text at its ends). Windows without a
   common shingle have similarity 0; leaving them out before fingerprinting loses nothing.
2. Fingerprints. A window's and an item's 64-bit SimHash over their words (each bit is the
   majority of the words' hash bits, repeated words counting repeatedly).
3. Multi-index. The 64 bits are cut into ``BLOCKS`` blocks. Two fingerprints within ``RADIUS`` differ
   by at most RADIUS // BLOCKS bits in some block; items are indexed under every value that
   near to each of their blocks, so equality joins on (window size, block, value) find all
   items within the radius. Farther ones that meet by chance are dropped by their whole distance.
   A window at the limit of 0.75 can be farther than the radius (words replaced in one run: up to
   28 bits seen), so the index alone loses some; step 4 finds those.
4. Probes. A similarity of 0.75 needs three quarters of the item's shingles at least, so of any
   quarter of them and one more the window holds one. Each item's rarest ones (by items) are its
   probes; a window that holds one is paired with the item at any distance. So no seeded window
   of 0.75 is lost.
5. Verification. Shingles weighted by how often they occur: the sum of the smaller weights over
   the sum of the larger ones must be at least 0.75.

DataFrame functions only. The item tables (shingles, index) are broadcast when their counted
rows are at most ``BROADCAST_ROWS``, else joined by shuffle. Words are runs of non-white characters,
lower-cased. Defined results: items and documents without words match nothing; an item of
fewer than five words is one shingle of all its words; equal items match each; of several
windows for the same document and item the most similar is kept (then the nearest, then the
first); repeated rows give the same answer once per doc_id; empty tables give no rows;
extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MIN_SIMILARITY_PCT, SHINGLE_WORDS, SPACE_RE, long_ids, with_column_names, written

RADIUS = 14
BLOCKS = 5
BROADCAST_ROWS = 1_000_000

_WIDTH = [64 // BLOCKS + (k < 64 % BLOCKS) for k in range(BLOCKS)]
_START = [sum(_WIDTH[:k]) for k in range(BLOCKS)]


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _hashed_words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), SPACE_RE), ""), lambda w: F.xxhash64(w))


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words of an array of word hashes."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))


def simhash(words: Column) -> Column:
    """64-bit SimHash of an array of hashes."""
    def bit(b: Column) -> Column:
        ones = F.aggregate(words, F.lit(0), lambda acc, h: acc + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(2 * ones > F.size(words), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def _block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, _START[k]).bitwiseAND(F.lit((1 << _WIDTH[k]) - 1)).cast("int")


def weighted_similarity(a: Column, b: Column) -> tuple[Column, Column]:
    """Sums of the smaller and of the larger weights of two shingle arrays, a shingle's
    weight being how often the array holds it."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    weighed = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))
    common = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(weighed)
    return common, F.size(a) + F.size(b) - common


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_table(items: DataFrame) -> DataFrame:
    """``item, item_id, words, shingles, fingerprint, len, gram`` of all items with words."""
    d = items.select(F.col("item_id"), _hashed_words("text").alias("words")).where(F.size("words") > 0)
    d = d.withColumn("len", F.size("words")).withColumn("gram", F.least("len", F.lit(SHINGLE_WORDS)))
    shingles = F.lit(None)
    for size in range(1, SHINGLE_WORDS + 1):
        shingles = F.when(F.col("gram") == size, _shingles(F.col("words"), size)).otherwise(shingles)
    return written(d.withColumn("shingles", shingles).withColumn("fingerprint", simhash(F.col("words")))
                   .withColumn("item", F.monotonically_increasing_id()), "bench-items")


def item_index(items: DataFrame) -> DataFrame:
    """``len, block, value, item, fingerprint``: every value near to each block."""
    reach = RADIUS // BLOCKS

    def values(k: int) -> Column:
        own = _block(F.col("fingerprint"), k)
        return F.array(*[own.bitwiseXOR(F.lit(m)) for m in _masks(_WIDTH[k], reach)])

    entries = F.array(*[F.struct(F.lit(k).alias("block"), values(k).alias("values")) for k in range(BLOCKS)])
    return (items.select("len", "gram", "item", "fingerprint", F.explode(entries).alias("e"))
            .select("len", "item", F.col("fingerprint").alias("item_fingerprint"), F.col("e.block").alias("block"),
                    F.explode("e.values").alias("value")))


def item_probes(items: DataFrame) -> DataFrame:
    """``len, h, item, item_fingerprint``: of every item the rarest shingles, one occurrence more
    than a window of the least similarity can lack."""
    each = items.select("item", "len", F.col("fingerprint").alias("item_fingerprint"), F.size("shingles").alias("n"),
                        F.posexplode("shingles").alias("at", "h"))
    spread = each.groupBy("len", "h").agg(F.count_distinct("item").alias("items"))
    order = Window.partitionBy("item").orderBy("items", "h", "at")
    lack = F.floor((100 - MIN_SIMILARITY_PCT) * F.col("n") / 100)
    return (each.join(spread, ["len", "h"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= lack + 1)
            .select("len", "h", "item", "item_fingerprint").distinct())


def matches(docs: DataFrame, items: DataFrame, row_id: str | None = None) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, distance, similarity``: the best window of every
    contaminated (document, item). ``row_id`` names a column of ``docs`` with a distinct long for
    each row; then the answers are by row, with that number first as ``rid``. Without it the rows are
    numbered by their place in two scans, so ``docs`` must be a table read from files; for anything
    else (a shuffled or sampled frame) write it first or give ``row_id``."""
    rid = F.col(f"`{row_id}`") if row_id else F.monotonically_increasing_id()
    by = ["rid", "doc_id"] if row_id else ["doc_id"]
    d = docs.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text",
                    F.xxhash64("text").alias("text_hash")).where("text is not null")
    table = item_table(long_ids(with_column_names(items, "item_id", "text"), "item_id"))
    n_items = table.count()
    grams = [r.gram for r in table.select("gram").distinct().collect()]  # at most five
    windows = None
    for gram in grams:
        own = (table.where(F.col("gram") == gram).select("len", F.posexplode("shingles").alias("at", "h"))
               .groupBy("h", "at", "len").agg(F.count(F.lit(1)).alias("c")).drop("c"))
        own = written(own, "bench-shingles")
        # "outer": else the optimiser makes every list once more, in a filter under the scan
        hits = (d.select("rid", "text_hash", _hashed_words("text").alias("words"))
                .select("rid", "text_hash", F.size("words").alias("n"), _shingles(F.col("words"), gram).alias("grams"))
                .select("rid", "text_hash", "n", F.posexplode_outer("grams").alias("pos", "h"))
                .join(_small(own, own.count()), "h")
                .select("rid", "text_hash", "len", F.lit(gram).alias("gram"),
                        F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("n") - F.col("len"))).alias("start")))
        windows = hits if windows is None else windows.unionByName(hits)
    if windows is None:
        return docs.sparkSession.createDataFrame([], "".join(f"{c} long, " for c in by) + " item_id long, start_word int, n_words int, distance int, similarity double")
    # equal texts have equal windows: their first row stands for all of them
    windows = written(windows.groupBy("text_hash", "len", "gram", "start").agg(F.min("rid").alias("rid")), "bench-windows")

    # the windows' words, from their texts; a shuffle join by row number at any size (the seeded
    # rows grow with the corpus, so they are never broadcast), in which no key repeats
    slots = windows.groupBy("rid").agg(F.collect_list(F.struct("start", "len", "gram")).alias("slots"))
    cut = (d.join(slots.hint("merge"), "rid").select("text_hash", _hashed_words("text").alias("all_words"), "slots")
           .select("text_hash", "all_words", F.explode_outer("slots").alias("s"))
           .select("text_hash", F.col("s.start").alias("start"), F.col("s.len").alias("len"), F.col("s.gram").alias("gram"),
                   F.slice("all_words", F.col("s.start") + 1, F.col("s.len")).alias("words")))
    prints = written(cut.withColumn("fingerprint", simhash(F.col("words"))).withColumn("window", F.monotonically_increasing_id()),
                     "bench-prints")
    keys = F.array(*[F.struct(F.lit(k).alias("block"), _block(F.col("fingerprint"), k).alias("value")) for k in range(BLOCKS)])
    near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint")))
    index = item_index(table)
    per_item = sum(len(_masks(w, RADIUS // BLOCKS)) for w in _WIDTH)
    pairs = (prints.select("window", "len", "fingerprint", F.inline(keys)).join(_small(index, n_items * per_item), ["len", "block", "value"])
             .withColumn("distance", near).where(F.col("distance") <= RADIUS).select("window", "item", "distance"))
    shingles = F.lit(None)
    for gram in grams:
        shingles = F.when(F.col("gram") == gram, _shingles(F.col("words"), gram)).otherwise(shingles)
    probes = written(item_probes(table), "bench-probes")
    probed = (prints.select("window", "len", "fingerprint", F.explode_outer(shingles).alias("h"))
              .join(_small(probes, probes.count()), ["len", "h"]).select("window", "item", near.alias("distance")))
    pairs = pairs.unionByName(probed).groupBy("window", "item").agg(F.min("distance").alias("distance"))
    told = (pairs.join(prints, "window")
            .join(_small(table.select("item", "item_id", F.col("shingles").alias("item_shingles")), n_items), "item"))
    told = told.withColumn("shingles", shingles)
    least, most = weighted_similarity(F.col("shingles"), F.col("item_shingles"))
    told = (told.select("text_hash", "item_id", "start", "len", "distance", least.alias("least"), most.alias("most"))
            .where(100 * F.col("least") >= MIN_SIMILARITY_PCT * F.col("most"))
            .withColumn("similarity", F.col("least") / F.col("most")))
    best = F.max_by(F.struct("start", "len", "distance", "similarity"), F.struct("similarity", -F.col("distance"), -F.col("start")))
    told = written(told.groupBy("text_hash", "item_id").agg(best.alias("b")), "bench-matches").select("text_hash", "item_id", "b.*")
    return (d.select(*by, "text_hash").join(told, "text_hash").groupBy(*by, "item_id").agg(best.alias("b"))
            .select(*by, "item_id", F.col("b.start").alias("start_word"), F.col("b.len").alias("n_words"),
                    F.col("b.distance").cast("int").alias("distance"), F.col("b.similarity").alias("similarity")))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The registered query."""
    return matches(docs, items)
