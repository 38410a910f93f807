"""URN column functions (P1-P3, P18) and URN builders.

All are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes leading/trailing whitespace; Spark's trim only
# removes spaces, so strip with an explicit whitespace class.
_WS = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    return F.regexp_replace(_c(x), _WS, "")


def urn_tail(urn) -> Column:
    """Text after the last '(' with trailing ')' removed."""
    return F.rtrim(F.substring_index(_c(urn), "(", -1), F.lit(")"))


def urn_name(urn) -> Column:
    """Second-to-last comma part of the URN tail; the whole URN if fewer than 2 parts."""
    u = _c(urn)
    parts = F.split(urn_tail(u), ",")
    return F.when(u.isNull(), F.lit(None)).when(
        F.size(parts) >= 2, strip_ws(F.try_element_at(parts, F.lit(-2)))).otherwise(u)


def urn_platform(urn) -> Column:
    """Platform id after 'dataPlatform:', '' when absent."""
    return F.regexp_extract(_c(urn), r"dataPlatform:([^,]+)", 1)


def tag_short(tag_urn) -> Column:
    """Text after the last ':'."""
    return F.substring_index(_c(tag_urn), ":", -1)


def dataset_urn(platform, name, env: str = "PROD") -> Column:
    """Build ``urn:li:dataset:(urn:li:dataPlatform:<platform>,<name>,<env>)``."""
    return F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:"), _c(platform), F.lit(","),
                    _c(name), F.lit("," + env + ")"))


def tag_urn(name) -> Column:
    return F.concat(F.lit("urn:li:tag:"), _c(name))
