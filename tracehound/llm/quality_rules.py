"""Operator 10, quality rules: a rule bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one
failure bit per rule (``rule_mask``); policies are versioned sets of rules, applied later
with a bitwise AND, and ablations ("how many more documents would stay without rule r?")
come from one aggregation over the distinct masks, without reading a text again.

Defined results: a null text counts as empty (no words: ``few_words`` fails); ties and
repeated rows are rows like any other and each gets its own ledger row; an empty table
gives an empty ledger; columns of the input beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, long_ids, with_column_names, word_hashes

WINDOW_WORDS = 8
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

#: Rule name -> condition under which a document fails it, over the ledger's measurements.
#: A rule's place in this list is its bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "dup_lines": "100 * n_dup_lines > 70 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "capitals": "100 * n_upper > 50 * n_letters",
    "letters": "100 * n_letters < 50 * word_chars",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "full-1": tuple(RULES),
}
DEFAULT_POLICY = "full-1"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


def repeated_words(ws: list[bytes], width: int = WINDOW_WORDS) -> int:
    """Words covered by any window of ``width`` words that the text holds twice or more."""
    if len(ws) <= width:
        return 0
    grams = gram_hashes(word_hashes(ws), width)
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    hits = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(ws) + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    # letters and capitals: ASCII by byte class; beyond ASCII every code point counts as a letter
    beyond = len(text) - len(raw.translate(None, bytes(range(128, 256))))
    upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    lower = len(raw) - len(raw.translate(None, bytes(range(97, 123))))
    return (len(ws), len(text) - (len(raw) - len(raw.translate(None, SPACES))),
            len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(ws), len(lines), upper, upper + lower + beyond)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(t.as_py()) for t in b.column("text")]
        cols = list(zip(*rows)) if rows else [[] for _ in MEASURES]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", *MEASURES])


def rule_ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``rule_mask``: one row per document, no shuffle."""
    d = long_ids(with_column_names(docs, "doc_id", "text"))
    out = d.mapInArrow(_measure_batches, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(cond), F.lit(BIT[name])).otherwise(F.lit(0)) for name, cond in RULES.items()]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return out.withColumn("rule_mask", mask.cast("long"))


def policy_mask(version: str = DEFAULT_POLICY, without: str | None = None) -> int:
    return sum(BIT[r] for r in POLICIES[version] if r != without)


def apply_policy(ledger: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """Adds ``kept`` under a policy version and ``policy``, the version's name."""
    return (ledger.withColumn("kept", F.col("rule_mask").bitwiseAND(F.lit(policy_mask(version))) == 0)
            .withColumn("policy", F.lit(version)))


def ablations(ledger: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of a policy: documents failing it (``n_failed``), documents that fail only
    it (``n_only``, which would stay without it) and documents kept by the whole policy.

    The ledger is first counted by mask (at most 2^rules rows, combined map-side); the
    rules meet that small table, never the documents."""
    masks = ledger.groupBy("rule_mask").agg(F.count(F.lit(1)).alias("n"))
    full = F.lit(policy_mask(version))
    aggs = []
    for r in POLICIES[version]:
        failed = F.col("rule_mask").bitwiseAND(F.lit(BIT[r])) != 0
        only = F.col("rule_mask").bitwiseAND(full) == BIT[r]
        aggs += [F.struct(F.lit(r).alias("rule"), F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"),
                          F.coalesce(F.sum(F.when(only, F.col("n"))), F.lit(0)).alias("n_only"),
                          F.coalesce(F.sum(F.when(F.col("rule_mask").bitwiseAND(full) == 0, F.col("n"))),
                                     F.lit(0)).alias("n_kept"))]
    return masks.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def digest(docs: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """The contract's columns of the registered query, from the ledger."""
    base = policy_mask("base-1")
    out = apply_policy(rule_ledger(docs), version)
    failed = F.col("rule_mask").bitwiseAND(F.lit(base)) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"), "rule_mask")


#: DuckDB SQL of the registered query (independent: lists and windows instead of hashes).
DIGEST_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT doc_id, p, array_to_string(ws[p:p+7], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 7, 0))) AS p FROM w)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM pos) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, p + unnest(generate_series(0, 7)) AS q FROM hit) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters
      FROM w LEFT JOIN rep USING (doc_id)),
k AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 70 * n_lines THEN 8 ELSE 0 END)
       + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)
       + (CASE WHEN 100 * n_upper > 50 * n_letters THEN 32 ELSE 0 END)
       + (CASE WHEN 100 * n_letters < 50 * word_chars THEN 64 ELSE 0 END) AS rule_mask FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, rule_mask = 0 AS kept, rule_mask::BIGINT AS rule_mask
FROM k
"""
