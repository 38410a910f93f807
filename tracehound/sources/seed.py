"""Catalog writes of the seed step, as set operations.

The reference plants assets and lineage one call at a time; here both are DataFrame
upserts that can take any number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urn import dataset_urn


def upsert_entities(current: DataFrame, updates: DataFrame, version_col: str = "version") -> DataFrame:
    """Union the updates with the current entities and keep the latest version of each
    URN. Both inputs carry ``version_col``; a missing or NULL URN in ``updates`` is built
    from ``platform`` and ``name``. Ties on the version prefer the update."""
    if "urn" not in updates.columns:
        updates = updates.withColumn("urn", dataset_urn(F.col("platform"), F.col("name")))
    elif {"platform", "name"} <= set(updates.columns):
        updates = updates.withColumn("urn", F.coalesce(F.col("urn"), dataset_urn(F.col("platform"), F.col("name"))))
    both = (current.withColumn("_src", F.lit(0))
            .unionByName(updates.withColumn("_src", F.lit(1)), allowMissingColumns=True))
    # an aggregate, not a window: an asset with very many updates is reduced before the shuffle
    latest = F.max_by(F.struct(*[c for c in both.columns if c != "_src"]), F.struct(version_col, "_src"))
    return both.groupBy(F.col("urn").alias("_urn")).agg(latest.alias("r")).select("r.*")


def chain_edges(assets: DataFrame, chain: str = "chain", pos: str = "pos", urn: str = "urn") -> DataFrame:
    """S6 + W7: a chain of n assets gives n-1 edges, each asset to its successor.

    With dense positions (0..n-1, as in a list) the successor is an equi-join on
    ``pos + 1``: no window, so one very long chain is spread over many tasks instead of
    being sorted in one."""
    a = assets.select(F.col(chain).alias("_c"), F.col(pos).alias("_p"), F.col(urn).alias("upstream"))
    b = assets.select(F.col(chain).alias("_c"), (F.col(pos) - 1).alias("_p"), F.col(urn).alias("downstream"))
    return a.join(b, ["_c", "_p"]).select(F.col("_c").alias(chain), "upstream", "downstream")
