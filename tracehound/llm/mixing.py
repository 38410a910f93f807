"""Operator 2, mixing sources to target weights by soft membership.

1. A classifier made from a labelled table predicts the domain posteriors of every document:
   naive Bayes over the presence of hashed words and of three form marks (share of distinct
   words, symbols, length), on the ``MAX_FEATURES`` features that differ most
   between domains (z score). ``keep_domain`` scores their absence too, so that a text without
   any telling word has a sure posterior and not the prior's; for three domains on texts with
   copies that made the posteriors worse (README). It learns from a bounded sample, the
   ``MAX_TRAIN`` labelled ids with the smallest hash; the model table is bounded too and is
   broadcast.
2. Nonnegative document rates are fitted by least squares. With n_d tokens, posteriors p_dk
   and T tokens in all, the mix is A_k = sum_d r_d n_d p_dk / T; minimised is
   sum_k (A_k - t_k)^2 + ridge * sum_d (n_d / T)(r_d - 1)^2 over 0 <= r (and r <= most). In the
   metric n_d / T the projected gradient vanishes where r_d = max(0, 1 - p_d . v) with the k numbers
   v = (A - t) / ridge, the same for all documents. They minimise a convex, piecewise quadratic
   function of k numbers, found by Newton steps with a line search; a step is two aggregations to
   a few sums over the written posterior table, and no rate is kept between steps. It ends when
   the residual, ridge * v - (A - t), is under ``RESIDUAL``, and raises if it doesn't get there. A
   warning tells by how much the best mix misses targets that can't be reached.

DataFrame functions only. Defined results: a null or empty text has no tokens, the
posteriors of no feature and rate 1 (it can't change the mix); a label repeated for an id counts once
(largest domain name); null labels are ignored; with no labelled row there is nothing to fit
and all rates are 1 and posteriors null; repeated rows get equal rates; extra columns are not read.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, long_ids, with_column_names, written

MAX_TRAIN = 6_000
MAX_FEATURES = 4_096
TEMPER = 1.0
RIDGE = 1e-6
STEPS = 60
RESIDUAL = 1e-7
LINE = 24
BIAS = "\u0001bias"
TOLERANCE = 1e-4
#: A document whose posterior is at least this is surely of its domain.
SURE = 0.95

#: Target token shares of the registered query.
TARGETS = {"good": 0.85, "poor": 0.05, "toxic": 0.10}

def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


def _marked(docs: DataFrame) -> DataFrame:
    """``rid, doc_id, n_tokens, feature hashes`` of every whole text."""
    text = F.coalesce("text", F.lit(""))
    rid = F.col("rid") if "rid" in docs.columns else F.monotonically_increasing_id()
    d = docs.select(rid.alias("rid"), "doc_id", text.alias("text"))
    d = d.withColumn("words", F.array_remove(F.split(F.lower("text"), SPACE_RE), ""))
    n = F.size("words")
    d = d.withColumn("kinds", F.array_distinct("words"))
    symbols = sum((F.length("text") - F.length(F.replace("text", F.lit(c), F.lit(""))) for c in "#*$%&|<"), F.lit(0))
    tenth = lambda x: F.floor(10 * x).cast("string")
    some = F.greatest(n, F.lit(1))
    form = F.array(F.lit(BIAS), F.concat(F.lit("\u0001kinds"), tenth(F.size("kinds") / some)),
                   F.concat(F.lit("\u0001symbols"), tenth(F.least(symbols / some, F.lit(2.0)))),
                   F.concat(F.lit("\u0001length"), F.floor(F.log2(some)).cast("string")))
    return d.select("rid", "doc_id", n.cast("long").alias("n_tokens"), F.concat("kinds", form).alias("marks"))


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], max_train: int = MAX_TRAIN,
          max_features: int = MAX_FEATURES, absences: bool = False) -> DataFrame | None:
    """Model table ``h, w_0 .. w_k-1`` from ``labelled(doc_id, domain)``: at most
    ``max_features`` rows, and one on the feature that every document has, with the prior. With
    ``absences`` that one has the weights of the absence of all others too, and theirs are those
    of presence less absence."""
    sample = (labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id")
              .agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    marks = _marked(docs.join(F.broadcast(sample), "doc_id", "left_semi")).select("rid", "doc_id", "marks")
    marks = marks.join(F.broadcast(sample), "doc_id")
    one = [F.sum(F.when(F.col("domain") == k, 1).otherwise(0)).alias(f"c_{i}") for i, k in enumerate(domains)]
    size = marks.agg(*one).first()
    sizes = [size[i] or 0 for i in range(len(domains))]
    if not sum(sizes):
        return None
    total = float(sum(sizes))
    c = (marks.select("domain", F.explode_outer("marks").alias("m")).groupBy(F.xxhash64("m").alias("h")).agg(*one)
         .withColumn("c", sum((F.col(f"c_{i}") for i in range(1, len(domains))), F.col("c_0"))))
    q = F.col("c") / total
    z = F.greatest(*[F.abs(F.col(f"c_{i}") - s * q) / F.sqrt(s * q * (1 - q) + 0.5) for i, s in enumerate(sizes)], F.lit(0.0))
    of_all = (F.col("c") + 0.5) / (total + 1.0)
    best = c.where("c >= 4").where(F.col("h") != F.xxhash64(F.lit(BIAS))).withColumn("z", z).where("z >= 4").orderBy(F.desc("z"), "h").limit(max_features)
    best = written(best.select("h", of_all.alias("q"), *[((F.col(f"c_{i}") + 0.5) / (s + 1.0)).alias(f"q_{i}") for i, s in enumerate(sizes)]),
                   "mixing-features")
    away = [F.log1p(-F.col(f"q_{i}")) if absences else F.lit(0.0) for i in range(len(domains))]
    absent = best.agg(*[F.sum(x) for x in away]).first()
    weights = [(TEMPER * (F.log(f"q_{i}") - F.log("q") - x)).alias(f"w_{i}") for i, x in enumerate(away)]
    prior = docs.sparkSession.range(1).select(F.xxhash64(F.lit(BIAS)).alias("h"), *[
        F.lit(float(np.log((s + 0.5) / (total + 1)) + TEMPER * (absent[i] or 0.0))).alias(f"w_{i}") for i, s in enumerate(sizes)])
    return best.select("h", *weights).unionByName(prior)


def posteriors(docs: DataFrame, model: DataFrame, domains: list[str]) -> DataFrame:
    """``rid, doc_id, n_tokens, p_<domain>..`` of every row. The words meet the broadcast
    model before anything moves; what is shuffled is a few sums per document. (No list of
    marks is empty; ``explode_outer`` keeps the optimiser from testing that by making every
    list once more in a filter under the scan.)"""
    hits = (_marked(docs).select("rid", "doc_id", "n_tokens", F.explode_outer("marks").alias("m"))
            .withColumn("h", F.xxhash64("m")).join(F.broadcast(model), "h"))
    logit = (hits.groupBy("rid", "doc_id", "n_tokens").agg(*[F.sum(f"w_{i}").alias(f"l_{i}") for i in range(len(domains))]))
    top = F.greatest(*[F.col(f"l_{i}") for i in range(len(domains))], F.lit(-1e300))
    e = [F.exp(F.col(f"l_{i}") - top) for i in range(len(domains))]
    norm = sum(e[1:], e[0])
    return logit.select("rid", "doc_id", "n_tokens", *[(x / norm).alias(f"p_{k}") for x, k in zip(e, domains)])


def fit_rates(table: DataFrame, targets: dict[str, float], upsample: bool = True, ridge: float = RIDGE,
              steps: int = STEPS, most: float | None = None) -> DataFrame:
    """Adds ``rate`` to a written table of ``n_tokens`` and ``p_<domain>``. With ``upsample``
    the mix keeps the corpus's token total; without, it is the largest mix with the target
    shares that no domain must be repeated for. No rate is above ``most``."""
    domains = list(targets)
    p = [F.col(f"p_{k}") for k in domains]
    share = F.col("n_tokens") / F.lit(1.0)
    sums = [F.sum(share)] + [F.sum(share * x) for x in p]
    row = table.agg(*sums).first()
    total = row[0] or 0.0
    if not total:
        return table.withColumn("rate", F.lit(1.0))
    k = len(domains)
    have = np.array(row[1:]) / total
    want = np.array([targets[d] for d in domains], float)
    want = want / want.sum()
    if not upsample:
        want = want * min(h / w for h, w in zip(have, want) if w > 0)
    v = np.zeros(k)
    for _ in range(steps):
        rate = projected(p, v, most)
        free = (rate > 0) if most is None else (rate > 0) & (rate < most)
        row = table.agg(*[F.sum(rate * share * x) for x in p],
                        *[F.sum(F.when(free, share * x * y).otherwise(0.0)) for x in p for y in p]).first()
        mix, active = np.array(row[:k]) / total, np.array(row[k:]).reshape(k, k) / total
        slope = ridge * v + want - mix
        if np.abs(slope).max() < RESIDUAL:
            break
        move = -np.linalg.solve(active + ridge * np.eye(k), slope)
        tries = [v + move * 2.0 ** -j for j in range(LINE)]
        sums = table.agg(*[F.sum(share * _bowl(p, x, most)) for x in tries]).first()
        v = tries[int(np.argmin([ridge * x @ x / 2 + want @ x + s / total for x, s in zip(tries, sums)]))]
    else:
        raise RuntimeError(f"the rates don't converge in {steps} steps: residual {np.abs(slope).max():.1e}")
    if np.abs(mix - want).max() > TOLERANCE:
        warnings.warn(f"the targets can't be reached: mix {dict(zip(domains, mix.round(5).tolist()))}, wanted {dict(zip(domains, want.round(5).tolist()))}")
    return table.withColumn("rate", F.when(F.col("n_tokens") == 0, 1.0).otherwise(projected(p, v, most)))


def projected(p: list[Column], v: np.ndarray, most: float | None = None) -> Column:
    """The rates of the k numbers ``v``, projected on 0 <= r <= most."""
    rate = F.greatest(F.lit(0.0), _unprojected(p, v))
    return rate if most is None else F.least(F.lit(most), rate)


def _unprojected(p: list[Column], v: np.ndarray) -> Column:
    return F.lit(1.0) - sum((x * F.lit(float(y)) for x, y in zip(p, v)), F.lit(0.0))


def _bowl(p: list[Column], v: np.ndarray, most: float | None) -> Column:
    """The integral of the projected rate over the unprojected one, from 0."""
    x, rate = _unprojected(p, v), projected(p, v, most)
    return rate * x - rate * rate / 2


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], upsample: bool = True,
        row_id: str | None = None) -> DataFrame:
    """``rid, doc_id, n_tokens, p_<domain>.., rate`` for every row of ``docs``; ``rid`` is the
    column ``row_id`` (a distinct long for each row), or a number given here."""
    rid = F.col(f"`{row_id}`") if row_id else F.monotonically_increasing_id()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rid.alias("rid"))
    table = predicted(d, labelled, list(targets))
    return _unfitted(d, list(targets)) if table is None else fit_rates(table, targets, upsample)


def predicted(d: DataFrame, labelled: DataFrame, domains: list[str], absences: bool = False) -> DataFrame | None:
    """The written posteriors of ``d(rid, doc_id, text)``; None without a labelled row."""
    model = learn(d, labelled, domains, absences=absences)
    return None if model is None else written(posteriors(d, written(model, "mixing-model"), domains), "mixing-posteriors")


def _unfitted(d: DataFrame, domains: list[str]) -> DataFrame:
    return _marked(d).select("rid", "doc_id", "n_tokens", *[F.lit(None).cast("double").alias(f"p_{k}") for k in domains],
                             F.lit(1.0).alias("rate"))


def keep_domain(docs: DataFrame, labelled: DataFrame, domain: str, others: list[str], row_id: str) -> DataFrame:
    """``rid, copies`` (0 or 1) for every row of ``docs``: the mix is brought to the one that the
    documents surely of ``domain`` (posterior at least ``SURE``) have, the purest that the
    posteriors let a mix be. No rate is above 1 and those documents stay, each once; only what
    is in doubt is rounded by hash. If no document is sure, nothing can be told apart and all stay."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(f"`{row_id}`").alias("rid"))
    domains = [domain, *others]
    table = predicted(d, labelled, domains, absences=True)
    everything = d.select("rid", F.lit(1).alias("copies"))
    if table is None:
        return everything
    sure = F.col(f"p_{domain}") >= SURE
    pure = table.where(sure).agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{k}")) for k in domains]).first()
    if not pure[0]:
        return everything
    rates = fit_rates(table, dict(zip(domains, map(float, pure))), upsample=False, most=1.0)
    return rates.select("rid", F.when(sure, 1).otherwise(copies(F.col("rate"), F.col("rid"))).alias("copies"))


def copies(rate: Column, key: Column) -> Column:
    """How often a document is taken: its rate, rounded up or down by a hash of its id, so
    that the expected number is the rate."""
    u = F.pmod(F.xxhash64(key, F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def digest(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The registered query: rates of all documents for ``TARGETS``."""
    lab = long_ids(with_column_names(labels, "doc_id", "quality", "toxic"))
    out = mix(docs, lab.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")), targets or TARGETS)
    return out.drop("rid").withColumn("copies", copies(F.col("rate"), F.col("doc_id")))
