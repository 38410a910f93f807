"""Operator 7, language identification by compression.

For every language a zstandard raw-content dictionary is made from a bounded sample of
labelled texts. A lower-cased text is compressed once with each dictionary; the language whose
dictionary gives the smallest result wins. When the second smallest is within
``min_margin`` of it (relative to the spread that a text of this size can show), the
answer is rejected: ``confident`` is false, and the general interface can put ``und``.

The sample: per language the ids whose hash falls in a share that gives ``docs_per_language``
ids on average (all ids of a smaller language). Every one of them gives an equal share of about
``dictionary_bytes`` in all, in ``PASSAGES`` passages spread evenly over its whole text; a short
text gives itself. The dictionaries (languages x 64 kB on average) are broadcast.
Prediction reads every whole text in one pass without a shuffle.

Defined results: null text or a text without a letter gives ``und``, score 0, not
confident; equal sizes go to the alphabetically first language; with no labelled row at
all every answer is ``und``; rows repeated in the input are answered each; extra columns
are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, long_ids, with_column_names

DOCS_PER_LANGUAGE = 400
DICTIONARY_BYTES = 64_000
PASSAGES = 4
#: Short matches count in short texts: a lazy search for matches of four bytes and more.
PARAMETERS = zstandard.ZstdCompressionParameters(
    window_log=20, hash_log=16, chain_log=16, search_log=4, min_match=4, target_length=16,
    strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
MIN_MARGIN = 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE,
          dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries from ``doc_id, text, lang``. The ids are chosen on narrow
    rows with one count per language and no window, so a language that holds most of the
    rows moves only its few candidates."""
    narrow = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang")
    share_of = F.least(F.lit(1.0), F.lit(float(docs_per_language)) / F.col("n"))  # one count per language
    sizes = narrow.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    ids = narrow.join(F.broadcast(sizes), "lang").where(draw < share_of).select("doc_id", "lang").distinct()
    texts = docs.join(F.broadcast(ids), ["doc_id", "lang"]).where("text is not null")
    # one text per id, however often it is repeated; a smaller language's ids give more each
    one = texts.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    share = F.greatest(F.lit(dictionary_bytes // docs_per_language), F.floor(F.lit(dictionary_bytes) / F.count(F.lit(1)).over(Window.partitionBy("lang"))))
    one = one.withColumn("share", share.cast("int")).withColumn("span", F.floor(F.col("share") / PASSAGES).cast("int"))
    step = (F.length("text") - F.col("span")) / float(PASSAGES - 1)
    spread = F.concat_ws(" ", *[F.substr("text", (1 + F.floor(step * k)).cast("int"), F.col("span")) for k in range(PASSAGES)])
    part = one.select("lang", "doc_id", F.when(F.length("text") <= F.col("share"), F.col("text")).otherwise(spread).alias("text"))
    out: dict[str, list[bytes]] = {}
    for r in part.orderBy("lang", F.xxhash64("doc_id")).toLocalIterator():
        out.setdefault(r.lang, []).append(r.text.lower().encode("utf-8", "surrogatepass") + b"\n")
    return {k: b"".join(v) for k, v in out.items() if sum(map(len, v)) >= 8}


class Model:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.by_lang = []
        for lang in sorted(dictionaries):
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=PARAMETERS)
            self.by_lang.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=PARAMETERS)))

    def predict(self, text: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, bool]:
        """Language, score in 0..1 (a soft-min over the compressed sizes) and confidence."""
        if not self.by_lang or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        raw = text.lower().encode("utf-8", "surrogatepass")
        sizes = sorted((len(c.compress(raw)), lang) for lang, c in self.by_lang)
        best = sizes[0][0]
        score = 1.0 / sum(math.exp(max(-60.0, (best - s) * 0.25)) for s, _ in sizes)
        sure = len(sizes) < 2 or (sizes[1][0] - best) >= max(2, min_margin * min(best, 4000))
        return sizes[0][1], score, sure


def predict(docs: DataFrame, dictionaries: dict[str, bytes], reject: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score, confident``; with ``reject`` narrow margins give ``und``."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(held.value)
        for b in batches:
            rows = [model.predict(t.as_py()) for t in b.column("text")]
            langs = [UNKNOWN if reject and not sure else lang for lang, _, sure in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(langs, pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.bool_())], ["doc_id", "lang_pred", "score", "confident"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, confident boolean")


def digest(docs: DataFrame) -> DataFrame:
    """The registered query: learn from ids whose crc32 mod 4 is not 2, predict all."""
    d = long_ids(with_column_names(docs, "doc_id", "text", "lang"))
    out = predict(d, learn(d.where(fold("doc_id", 4) != 2)))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "confident")
