"""URL filters by a path-template tree.

Every host has a tree of path segments. Level by level, a segment value that only few of its
parent's pages have becomes the wildcard ``*`` (runs of digits are ``#`` from the start), and
sibling branches whose labelled shares of good pages don't differ significantly are merged into
one branch (``en|fr``). A template's purity is its labelled share of good pages, smoothed
towards its parent's, up to the host's and the corpus's; templates of low purity are rejected.
Explicit rules come first.

Only SQL functions, joins and aggregates. Pages are counted per host and path shape before
anything else, so a host with a third of all pages is a few rows; the joins back are on (host,
shape) and left to adaptive execution. The tree's levels are written tables.

Defined cases: a URL that is null or lacks ``://`` has an empty host and path and is judged like
a host of its own; an empty path is the host's root; a path beyond ``MAX_DEPTH`` segments keeps
its first ones and one wildcard for the rest; a page without any label takes its parent's
purity, and with no label at all everything is allowed. Repeated pages count each time, very
long URLs are ordinary rows, further columns of the inputs are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import long_ids, with_column_names, written

#: The contract's rules: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: A value stays a branch of its own if at least 1 of so many of its parent's pages have it ...
LITERAL_SHARE = 16
#: ... and at least so many pages.
LITERAL_PAGES = 4
#: Pages' worth of the parent's purity in a branch's purity.
PRIOR = 8.0
#: Neighbouring branches differ at 5 per cent.
Z_CUT = 1.96
#: A template whose purity is less is rejected.
MIN_PURITY = 0.5
MAX_DEPTH = 8


def url_parts(url) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as text) and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def shape_of(path) -> Column:
    """The path with every run of digits as ``#`` (which no path holds)."""
    return F.regexp_replace(path, "[0-9]+", "#")


def _segments(shape) -> Column:
    s = F.split(shape, "/", -1)
    s = F.slice(s, F.lit(2), F.size(s))
    return F.when(F.size(s) > MAX_DEPTH, F.concat(F.slice(s, 1, MAX_DEPTH), F.array(F.lit("**")))).otherwise(s)


def _smoothed(good, labelled, towards) -> Column:
    return (good + F.lit(PRIOR) * towards) / (labelled + F.lit(PRIOR))


def _level(shapes: DataFrame, level: int) -> DataFrame:
    """One level of all trees: generalise, merge, smooth; the shapes with their next branch."""
    node = ["host", "template"]
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
    active = shapes.where(F.size("segments") >= level).withColumn("child", F.col("segments")[level - 1])
    kids = active.groupBy(*node, "child").agg(*sums, F.first("purity").alias("purity"))
    parents = kids.groupBy(*node).agg(F.sum("n").alias("parent_n"))
    kids = written(kids.join(parents, node).withColumn("segment", F.when(
        (F.col("n") * LITERAL_SHARE >= F.col("parent_n")) & (F.col("n") >= LITERAL_PAGES), F.col("child")).otherwise("*")), "url-kids")
    # at most LITERAL_SHARE + 1 branches to a parent from here on
    branches = kids.groupBy(*node, "segment").agg(*sums, F.first("purity").alias("purity"))
    w = Window.partitionBy(*node).orderBy("own", "segment")
    g, n = F.col("good"), F.col("labelled")
    g0, n0 = F.lag("good").over(w), F.lag("labelled").over(w)
    pooled = (g + g0 + 1) / (n + n0 + 2)
    z = F.abs((g + 1) / (n + 2) - (g0 + 1) / (n0 + 2)) / F.sqrt(pooled * (1 - pooled) * (1 / (n + 1) + 1 / (n0 + 1)))
    cut = branches.withColumn("own", _smoothed(g, n, F.col("purity"))).withColumn("differs", F.coalesce((z >= Z_CUT).cast("int"), F.lit(0)))
    cut = cut.withColumn("part", F.sum("differs").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = cut.groupBy(*node, "part").agg(*sums, F.first("purity").alias("purity"), F.array_sort(F.collect_list("segment")).alias("members"))
    merged = merged.select(*node, F.explode("members").alias("segment"), F.array_join("members", "|").alias("branch"),
                           _smoothed(g, n, F.col("purity")).alias("next_purity"), n.alias("branch_labelled"))
    step = kids.select(*node, "child", "segment").join(merged, [*node, "segment"]).drop("segment")
    out = active.join(step, [*node, "child"]).select(
        "host", "shape", "segments", "n", "labelled", "good", F.concat("template", F.lit("/"), "branch").alias("template"),
        F.col("next_purity").alias("purity"), F.col("branch_labelled").alias("support"))
    return written(out.unionByName(shapes.where(F.size("segments") < level)), "url-level")


def template_tree(counts: DataFrame) -> DataFrame:
    """``host, shape, template, purity, support`` of every (host, shape) of ``counts`` (``host,
    shape, n, labelled, good``, each pair once); ``support`` is the template's labelled pages."""
    hosts = counts.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("good").alias("host_good"))
    total = counts.agg(F.sum("labelled").alias("l"), F.sum("good").alias("g")).select(
        ((F.coalesce("g", F.lit(0)) + 1) / (F.coalesce("l", F.lit(0)) + 2)).alias("p")).first()["p"]
    shapes = written(counts.join(hosts, "host").select(
        "host", "shape", _segments(F.col("shape")).alias("segments"), "n", "labelled", "good", F.lit("").alias("template"),
        _smoothed(F.col("host_good"), F.col("host_labelled"), F.lit(total)).alias("purity"), F.col("host_labelled").alias("support")), "url-level")
    for level in range(1, (shapes.agg(F.max(F.size("segments"))).first()[0] or 0) + 1):
        shapes = _level(shapes, level)
    return shapes.select("host", "shape", "template", "purity", "support")


def shape_counts(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """Pages, labelled and good pages per (host, shape) from ``urls(host, path, key)`` and
    ``labelled(key, good)`` with unique keys. Pages are counted per key before the join."""
    per_key = urls.groupBy("host", shape_of("path").alias("shape"), "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.join(labelled, "key", "left").groupBy("host", "shape").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good").isNotNull(), F.col("n")).otherwise(0)).alias("labelled"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"))


def url_filter(pages: DataFrame, labelled: DataFrame, key: Column, rules=RULES) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict, template, purity``. ``key`` (over ``host``
    and ``path``) is matched with ``labelled(key, good)``, whose repeated keys count as good only
    if all of their rows are."""
    host, path = url_parts("url")
    urls = with_column_names(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    known = labelled.where(F.col("key").isNotNull() & F.col("good").isNotNull()).groupBy("key").agg(F.bool_and("good").alias("good"))
    tree = template_tree(shape_counts(urls.withColumn("key", key), known))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow")
    return urls.withColumn("shape", shape_of("path")).join(tree, ["host", "shape"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), "template", "purity", "support")


def document_number() -> Column:
    """The last number in the path: the pages' URLs end in the number of the document they show."""
    return F.try_to_number(F.regexp_extract("path", r"([0-9]{1,18})[^0-9]*$", 1), F.lit("9" * 18)).cast("long")


def document_labels(labels: DataFrame) -> DataFrame:
    """A document is good if its quality is 1 and it isn't toxic, bad if either fails."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return long_ids(with_column_names(labels, "doc_id", "quality", "toxic")).select(
        F.col("doc_id").alias("key"), F.when(bad, False).when(good, True).alias("good"))


def digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    out = url_filter(pages, document_labels(labels), document_number())
    return out.withColumn("purity", F.round("purity", 6))


def _digest_sql() -> str:
    rule = verdict = "NULL"
    for v, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    smooth = lambda g, n, p: f"(({g}) + {PRIOR} * {p}) / (({n}) + {PRIOR})"
    sql = f"""WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
us AS (SELECT *, regexp_replace(path, '[0-9]+', '#', 'g') AS shape, TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT) AS key FROM u),
known AS (SELECT doc_id AS key, bool_and(good) AS good FROM (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN false
    WHEN quality = 1 AND toxic = 0 THEN true END AS good FROM labels) x WHERE doc_id IS NOT NULL AND good IS NOT NULL GROUP BY 1),
counts AS (SELECT host, shape, count(*) AS n, count(good) AS labelled, count(*) FILTER (WHERE good) AS good FROM us LEFT JOIN known USING (key) GROUP BY ALL),
total AS (SELECT (sum(good) + 1) / (sum(labelled) + 2) AS p FROM counts),
hosts AS (SELECT host, sum(labelled) AS host_labelled, sum(good) AS host_good FROM counts GROUP BY 1),
parts AS (SELECT *, string_split(shape, '/')[2:] AS s FROM counts),
l0 AS (SELECT host, shape, CASE WHEN len(s) > {MAX_DEPTH} THEN s[1:{MAX_DEPTH}] || ['**'] ELSE s END AS segments, n, labelled, good, '' AS template,
  {smooth('host_good', 'host_labelled', 'p')} AS purity, host_labelled AS support FROM parts JOIN hosts USING (host), total)"""
    for k in range(1, MAX_DEPTH + 2):
        sums = "sum(n) AS n, sum(labelled) AS labelled, sum(good) AS good, any_value(purity) AS purity"
        sql += f""",
a{k} AS (SELECT *, segments[{k}] AS child FROM l{k - 1} WHERE len(segments) >= {k}),
k{k} AS (SELECT *, CASE WHEN n * {LITERAL_SHARE} >= sum(n) OVER (PARTITION BY host, template) AND n >= {LITERAL_PAGES} THEN child ELSE '*' END AS segment
  FROM (SELECT host, template, child, {sums} FROM a{k} GROUP BY host, template, child) x),
b{k} AS (SELECT *, {smooth('good', 'labelled', 'purity')} AS own FROM (SELECT host, template, segment, {sums} FROM k{k} GROUP BY host, template, segment) x),
g{k} AS (SELECT *, lag(good) OVER w AS g0, lag(labelled) OVER w AS n0 FROM b{k} WINDOW w AS (PARTITION BY host, template ORDER BY own, segment)),
d{k} AS (SELECT *, COALESCE(CAST(abs((good + 1) / (labelled + 2) - (g0 + 1) / (n0 + 2)) / sqrt((good + g0 + 1) / (labelled + n0 + 2)
    * (1 - (good + g0 + 1) / (labelled + n0 + 2)) * (1 / (labelled + 1) + 1 / (n0 + 1))) >= {Z_CUT} AS INT), 0) AS differs FROM g{k}),
p{k} AS (SELECT *, sum(differs) OVER (PARTITION BY host, template ORDER BY own, segment ROWS UNBOUNDED PRECEDING) AS part FROM d{k}),
m{k} AS (SELECT *, {smooth('good', 'labelled', 'purity')} AS next_purity FROM (SELECT host, template, part, {sums}, list_sort(list(segment)) AS members
  FROM p{k} GROUP BY host, template, part) x),
l{k} AS (SELECT a.host, a.shape, a.segments, a.n, a.labelled, a.good, a.template || '/' || array_to_string(m.members, '|') AS template,
  m.next_purity AS purity, m.labelled AS support FROM a{k} a JOIN k{k} k ON k.host = a.host AND k.template = a.template AND k.child = a.child
  JOIN m{k} m ON m.host = a.host AND m.template = a.template AND list_contains(m.members, k.segment)
  UNION ALL SELECT host, shape, segments, n, labelled, good, template, purity, support FROM l{k - 1} WHERE len(segments) < {k})"""
    return sql + f"""
SELECT page_id, us.host, path, {rule.replace('host', 'us.host')} AS rule, COALESCE({verdict.replace('host', 'us.host')},
  CASE WHEN purity < {MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity, CAST(support AS BIGINT) AS support
FROM us JOIN l{MAX_DEPTH + 1} t ON t.host = us.host AND t.shape = us.shape"""


DIGEST_SQL = _digest_sql()
