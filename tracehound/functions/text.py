"""Report text helpers (P16-P21) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ANSWER
from .urn import strip_ws

# ---- fixed values that must equal the reference's output format -------------
CONF_ICONS = {"high": "[!!!]", "medium": "[!! ]", "low": "[!  ]"}
UNKNOWN_ICON = "•"
OWNER_UNKNOWN = "owner unknown"
STATUS_APPLIED = "[OK] APPLIED"
STATUS_ATTEMPTED = "[..] attempted"
FALLBACK_MISSING = "LLM did not return valid JSON"
FENCE = "```"
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_fence(text) -> Column:
    """If the (stripped) text starts with a code fence, keep what lies between the
    first two fences, drop a leading 'json', strip again. Otherwise the stripped text."""
    return _unfenced(strip_ws(_c(text)))


def _unfenced(t: Column) -> Column:
    inner = F.coalesce(F.try_element_at(F.split(t, FENCE), F.lit(2)), F.lit(""))
    return F.when(t.startswith(FENCE), strip_ws(F.regexp_replace(inner, "^json", ""))).otherwise(t)


_ANSWER_CHECKED = T.StructType(list(ANSWER.fields) + [T.StructField("_corrupt_record", T.StringType())])
_JSON_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def _parsed(t: Column) -> Column:
    return F.from_json(t, _ANSWER_CHECKED, _JSON_OPTS)


def answer_is_valid(text) -> Column:
    """True when the text (after P17) is exactly one JSON object: parsable, not corrupt,
    and with nothing after the closing brace (``from_json`` ignores trailing text)."""
    t = strip_fence(text)
    return _valid(t, _parsed(t))


def _valid(t: Column, p: Column) -> Column:
    return F.coalesce(t.startswith("{") & t.endswith("}") & p.isNotNull()
                      & p["_corrupt_record"].isNull(), F.lit(False))


def parse_answer(text) -> Column:
    """Parse a stored answer into the report struct, with the reference's fallback
    (summary = the text, no suspects, a missing-evidence note) when it is not one JSON
    object. A list or other non-object JSON also takes the fallback (SURVEY 2.12 #14b)."""
    t = strip_fence(text)
    return _answer(t, _parsed(t))


def parsed_answers(df: DataFrame, text: str, name: str = "parsed") -> DataFrame:
    """``df`` with the column ``name``, P16 of its column ``text``, found in steps: a row's text is
    stripped and parsed once, where the one expression of :func:`parse_answer` does so wherever it
    mentions them."""
    df = df.withColumn("_stripped", strip_ws(F.col(text)))
    df = df.withColumn("_stripped", _unfenced(F.col("_stripped")))
    df = df.withColumn("_read", _parsed(F.col("_stripped")))
    return df.withColumn(name, _answer(F.col("_stripped"), F.col("_read"))).drop("_stripped", "_read")


def _answer(t: Column, p: Column) -> Column:
    empty = F.array().cast(ANSWER["suspects"].dataType)
    fallback = F.struct(t.alias("summary"), empty.alias("suspects"),
                        F.lit(FALLBACK_MISSING).alias("missing_evidence"))
    good = F.struct(p["summary"].alias("summary"),
                    F.coalesce(p["suspects"], empty).alias("suspects"),
                    p["missing_evidence"].alias("missing_evidence"))
    return F.when(_valid(t, p), good).otherwise(fallback)


def conf_icon(conf) -> Column:
    """Confidence -> icon; anything else -> bullet."""
    c = F.lower(F.coalesce(_c(conf).cast("string"), F.lit("")))
    out = F.lit(UNKNOWN_ICON)
    for k, v in reversed(list(CONF_ICONS.items())):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def owner_display(owner) -> Column:
    """P20: owner or 'owner unknown'."""
    return F.coalesce(F.nullif(_c(owner), F.lit("")), F.lit(OWNER_UNKNOWN))


def action_status(applied) -> Column:
    """P21: '[OK] APPLIED' when the write was verified, else '[..] attempted'."""
    return F.when(F.coalesce(_c(applied), F.lit(False)), F.lit(STATUS_APPLIED)).otherwise(F.lit(STATUS_ATTEMPTED))
