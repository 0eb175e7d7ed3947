"""Mixing documents to target weights with soft membership, in DataFrame operations only.

A labelled table names the domain of some documents.  Its rows' text statistics give, by
sums that Spark aggregates, a linear discriminant classifier (shared covariance), which
predicts every document's posterior over the domains.  Nonnegative rates r, one for each
document, then minimise the squared distance of the expected token totals
sum(r * tokens * posterior) from the targets, starting at r = 1, by projected gradient
steps in the token-weighted metric: r <- max(0, r + posterior . d), where d is the residual
scaled by the active documents' small Gram matrix.  A step needs one aggregation of a few dozen
sums; rates are an expression of the steps so far, so no iteration writes the table.

What reaches the driver are sums whose number depends on the domains and statistics alone.  Beyond
``DOMAINS`` domains the rarer ones are one domain, "other", whose target is the sum of theirs.
Targets that the steps don't reach (they may be out of reach for nonnegative rates) are reported by a warning.  Rates become whole copies by unbiased rounding with a hash of the
document, so expected totals are kept.

Defined cases: null and empty texts have zero tokens, statistics of an empty text and rate 1;
rows that repeat are rated alike, each for itself; labels without a document, or null, are left out;
without labelled rows there is one domain, "all"; an empty table stays empty.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.llm._store import Store

DOMAINS, STEPS, TOLERANCE = 64, 30, 1e-6
#: The domain of labelled rows whose domain isn't among the DOMAINS - 1 most frequent, where there are more than DOMAINS.
OTHER = "other"
#: Residual, as a share of the targets, from which a mix is reported as unfinished.
REPORTED = 1e-2
#: Statistics as (regular expression counted, share of characters it stands for).
_COUNTED = ("[A-Z]", "[#$%&*]", "[!|]", "[.,]", "[éèêàçù]", "[ñáíóú]", "[äöüß]", "[0-9@/:]", "th|ing", "[jkqwxyz]")
_SIZE = len(_COUNTED) + 3


def statistics(text: Column) -> list[Column]:
    """Bounded statistics of a whole text, for the classifier."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(text) + F.lit(1.0)
    words = F.split(F.lower(text), "\\s+")
    shares = [F.regexp_count(text, F.lit(p)) / n for p in _COUNTED]
    return [F.log(n) / 10, n / (F.size(words) + 1) / 10, F.size(F.array_distinct(words)) / F.size(words), *(F.sqrt(s) for s in shares)]


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\S+")).cast("double")


def _x(i: int) -> Column:
    return F.get("x", F.lit(i))


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domains, weights and offsets of the discriminants, from rows (domain, x)."""
    sums = [F.sum(_x(i)).alias(f"s{i}") for i in range(_SIZE)] + [F.sum(_x(i) * _x(j)).alias(f"q{i}_{j}") for i in range(_SIZE) for j in range(i + 1)]
    found = [r.asDict() for r in rows.groupBy("domain").agg(F.count("*").alias("n"), *sums).orderBy(F.desc("n"), "domain").limit(DOMAINS + 1).collect()]
    if not found:
        return ["all"], np.zeros((1, _SIZE)), np.zeros(1)
    if len(found) > DOMAINS:  # the rarer ones together
        found = [r for r in found[: DOMAINS - 1] if r["domain"] != OTHER]
        rest = rows.where(~F.col("domain").isin([r["domain"] for r in found])).agg(F.count("*").alias("n"), *sums).first()
        found.append(rest.asDict() | {"domain": OTHER})
    found = sorted(found, key=lambda r: r["domain"])
    n = np.array([r["n"] for r in found], float)
    mean = np.array([[r[f"s{i}"] for i in range(_SIZE)] for r in found]) / n[:, None]
    square = np.zeros((_SIZE, _SIZE))
    for r in found:
        for i in range(_SIZE):
            for j in range(i + 1):
                square[i, j] += r[f"q{i}_{j}"]
                square[j, i] = square[i, j]
    spread = (square - (mean * n[:, None]).T @ mean) / max(1.0, n.sum() - len(n))
    spread += np.diag(np.maximum(1e-6, 0.02 * np.diag(spread)))
    weights = np.linalg.solve(spread, mean.T).T
    return [r["domain"] for r in found], weights, np.log(n / n.sum()) - 0.5 * (weights * mean).sum(1)


def _posteriors(weights: np.ndarray, offsets: np.ndarray) -> Column:
    """Softmax of the discriminants over the statistics x."""
    scores = F.array(*(sum((_x(i) * float(w[i]) for i in range(_SIZE)), F.lit(float(b))) for w, b in zip(weights, offsets, strict=True)))

    def softmax(s: Column) -> Column:
        e = F.transform(s, lambda v: F.exp(v - F.array_max(s)))
        return F.get(F.transform(F.array(e), lambda a: F.transform(a, lambda v: v / F.aggregate(a, F.lit(0.0), lambda p, q: p + q))), F.lit(0))

    return F.get(F.transform(F.array(scores), softmax), F.lit(0))


def _p(d: int) -> Column:
    return F.get("posterior", F.lit(d))


def solve(members: DataFrame, target: np.ndarray) -> tuple[Column, np.ndarray]:
    """The rate as an expression over (n_tokens, posterior), and the totals it reaches."""
    k = len(target)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]

    def totals(rate: Column) -> tuple[np.ndarray, np.ndarray]:
        mass = F.col("n_tokens")
        active = F.when(rate > 0, mass).otherwise(0.0)
        row = members.agg(*(F.sum(mass * rate * _p(d)).alias(f"m{d}") for d in range(k)), *(F.sum(active * _p(i) * _p(j)).alias(f"g{i}_{j}") for i, j in pairs)).first()
        gram = np.zeros((k, k))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
        return np.array([row[f"m{d}"] or 0.0 for d in range(k)]), gram

    steps: list[np.ndarray] = []

    def rate(steps: list[np.ndarray]) -> Column:
        r = F.lit(1.0)
        for d in steps:
            r = F.greatest(F.lit(0.0), r + sum((_p(i) * float(d[i]) for i in range(k)), F.lit(0.0)))
        return r

    reached, gram = totals(rate(steps))
    scale = max(1.0, float(np.abs(target).sum()))
    shrink = 1.0
    for _ in range(STEPS):
        residual = target - reached
        error = float(np.abs(residual).sum()) / scale
        if error < TOLERANCE or shrink < 1e-3:
            break
        ridge = 1e-9 * max(1.0, float(np.trace(gram)) / k)
        step = shrink * np.linalg.solve(gram + ridge * np.eye(k), residual)
        tried, tried_gram = totals(rate([*steps, step]))
        if float(np.abs(target - tried).sum()) / scale < error:
            steps.append(step)
            reached, gram = tried, tried_gram
            shrink = min(1.0, 2 * shrink)
        else:
            shrink /= 2
    return rate(steps), reached


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, factors: dict[str, float] | Callable[[str], float] | None = None, size: float = 1.0, default: float = 1.0) -> DataFrame:
    """The rows of ``docs`` with n_tokens, posterior (map of domain to probability), rate and copies.

    labelled: (doc_id, domain).  Targets are either ``weights``, shares of ``size`` times all
    tokens (domains not named share nothing), or ``factors`` of each domain's own expected
    total, by name (``default`` for domains not named) or by a function of it.
    """
    store = Store(docs.sparkSession, "mixing")
    named = ("n_tokens", "posterior", "rate", "copies", "draw")
    base = docs.select(*(c for c in docs.columns if c not in named))
    kept = base.select(F.struct(*(F.col(c) for c in base.columns if c != "text")).alias("row"), F.xxhash64("doc_id", "text").alias("draw"), tokens(F.col("text")).alias("n_tokens"), F.array(*statistics(F.col("text"))).alias("x"))
    measured = store.put(kept, "measured")
    marks = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).where("doc_id is not null and domain is not null").distinct()
    domains, w, b = fit(measured.select(F.col("row.doc_id").cast("long").alias("doc_id"), "x").join(marks, "doc_id"))
    members = store.put(measured.select("row", "draw", "n_tokens", _posteriors(w, b).alias("posterior")), "members")
    natural = members.agg(*(F.sum(F.col("n_tokens") * _p(d)).alias(f"m{d}") for d in range(len(domains)))).first()
    own = np.array([natural[d] or 0.0 for d in range(len(domains))])
    if weights is None:
        of = factors if callable(factors) else lambda d: (factors or {}).get(d, default)
        target = own * np.array([of(d) for d in domains])
    else:
        share = np.array([weights.get(d, 0.0) for d in domains])
        if OTHER in domains and OTHER not in weights:
            share[domains.index(OTHER)] = sum(w for d, w in weights.items() if d not in domains)
        target = size * own.sum() * share / max(share.sum(), 1e-300)
    rate, reached = solve(members, target)
    off = float(np.abs(target - reached).sum()) / max(1.0, float(np.abs(target).sum()))
    if off > REPORTED:
        logging.getLogger("rowsmith").warning("mixing: totals are off their targets by %.3g of these", off)
    rated = members.withColumn("rate", rate)
    uniform = F.shiftrightunsigned("draw", 11).cast("double") * math.pow(2.0, -53)
    posterior = F.map_from_arrays(F.array(*(F.lit(d) for d in domains)), F.col("posterior"))
    return rated.select("row.*", "draw", "n_tokens", posterior.alias("posterior"), "rate", F.floor(F.col("rate") + uniform).cast("long").alias("copies"))


def domains_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): language and quality of the labelled documents."""
    joined = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")), "doc_id")
    return joined.where("quality is not null").select("doc_id", F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.when(F.col("quality") > 0, "good").otherwise("poor")).alias("domain"))


def apply_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Every row of ``docs`` as often as its ``copies`` say; rows are matched by id and text."""
    draws = mixed.groupBy(F.col("doc_id").alias("id"), "draw").agg(F.first("copies").alias("copies"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").alias("own_id"), F.xxhash64("doc_id", "text").alias("own"))
    joined = rows.join(draws, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("draw")))
    return joined.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
