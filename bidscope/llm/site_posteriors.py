"""Quality classifier: a document's own evidence combined with posteriors of its host and path.

Levels run from coarse to fine (host, then path in it). A site with few documents is shrunk towards the
level above, the hosts towards the global rate; how strongly is estimated from how much sites differ.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from bidscope.llm.robust_rules import NAMES, text_statistics, vectors
from bidscope.session import stage

TRAIN_ROWS = 20_000  # labelled rows the classifier is fitted on; the rest of the labels is not needed
PENALTY = 1.0
ROUNDS = 25
MILLION = 1_000_000  # probabilities are summed as whole millionths, so sums do not depend on task order
MAX_BROADCAST_SITES = 10_000


def _features(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, x * x])


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Ridge logistic regression on standardised statistics and their squares: means, scales, weights, bias.

    Taken are the rows whose ids have the smallest hashes, ``TRAIN_ROWS`` of them in expectation; every task
    sends only its part. Without rows of both kinds the evidence is the same for every document.
    """
    share = TRAIN_ROWS / max(1, labelled.count())
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / float(1 << 63)
    rows = labelled.filter(place < share).select(*NAMES, "quality").collect()
    rows.sort()
    x = np.array([[r[n] for n in NAMES] for r in rows], dtype=float).reshape(len(rows), len(NAMES))
    y = np.array([float(r["quality"]) for r in rows])
    means = x.mean(0) if len(x) else np.zeros(len(NAMES))
    scales = np.maximum(x.std(0), 1.0) if len(x) else np.ones(len(NAMES))
    weights, bias = np.zeros(2 * len(NAMES)), 0.0
    if len(set(y)) < 2:
        return means, scales, weights, bias
    design = np.hstack([_features((x - means) / scales), np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    ridge = np.full(len(w), PENALTY)
    ridge[-1] = 1e-6
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - ridge * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        w = w + np.linalg.solve(curve, slope)
    return means, scales, w[:-1], float(w[-1])


def _logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(sites: DataFrame, above: Column) -> float:
    """How many documents the level above is worth: method of moments on the sites' rates about it."""
    rate = F.col("_sum") / F.col("_n") / MILLION
    found = sites.agg(
        F.sum(F.col("_n") * (rate - above) ** 2).alias("between"),
        F.sum(above * (1 - above)).alias("within"),
        F.sum(F.col("_n") * above * (1 - above)).alias("all"),
        F.sum("_n").alias("n"),
    ).first()
    if not found["n"] or not found["all"]:
        return 1.0
    spread = (found["between"] - found["within"]) / found["n"]
    return float(min(1e6, max(1.0, found["all"] / found["n"] / spread - 1 if spread > 0 else 1e6)))


def score(docs: DataFrame, labels: DataFrame, levels: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``doc_id, evidence, site_rate, posterior, kept`` per document.

    ``evidence`` is the classifier's log odds from the whole text; ``site_rate`` the shrunk rate of the
    document's finest site, without the document itself; ``posterior`` joins both. All documents count
    towards the sites, only the classifier is fitted on a bounded sample of ``labels``. Null levels are
    sites of their own, a null text is an empty one, repeated rows count as often as they stand there;
    labels without a document or a quality are ignored. An empty table gives an empty result.
    """
    keys = [f"_site{i}" for i in range(len(levels))]
    texts = docs.select("doc_id", "text", "lang", "source", F.struct(*levels).alias("_levels"))
    rows = vectors(text_statistics(texts, "_levels"))
    site = [F.coalesce(F.concat(F.lit("="), F.col(f"_levels.{c}").cast("string")), F.lit("")) for c in levels]
    rows = stage(rows.select("doc_id", *NAMES, *[s.alias(k) for s, k in zip(site, keys)]), "evidence")
    known = labels.filter(F.col("quality").isNotNull()).select("doc_id", "quality")
    means, scales, weights, bias = fit(rows.join(known, "doc_id"))
    x = [(F.col(n) - float(m)) / float(s) for n, m, s in zip(NAMES, means, scales)]
    evidence = F.lit(bias)
    for term, w in zip([*x, *[a * a for a in x]], weights):
        evidence = evidence + float(w) * term
    evidence = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), evidence))
    rows = rows.select("doc_id", *keys, F.round(evidence, 6).alias("evidence"))
    rows = rows.withColumn("_p", F.round(MILLION * _sigmoid(F.col("evidence"))).cast("long"))
    whole = rows.agg(F.sum("_p").alias("p"), F.count(F.lit(1)).alias("n")).first()
    base = min(0.999, max(0.001, whole["p"] / whole["n"] / MILLION)) if whole["n"] else 0.5

    prior: Column = F.lit(base)
    for depth in range(1, len(keys) + 1):
        by = keys[:depth]
        sites = rows.groupBy(*by).agg(F.sum("_p").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        sites = sites if depth == 1 else sites.join(above, by[:-1])
        sites = stage(sites, f"sites-{depth}")
        strength = _strength(sites, prior if depth == 1 else F.col("_rate"))
        rate = (strength * prior + F.col("_sum") / MILLION) / (strength + F.col("_n"))
        above = sites.select(*by, F.greatest(F.lit(0.001), F.least(F.lit(0.999), rate)).alias("_rate"))
        finest = sites.select(*by, "_sum", "_n", prior.alias("_above"), F.lit(strength).alias("_strength"))
        prior = F.col("_rate")
    finest = F.broadcast(finest) if finest.count() <= MAX_BROADCAST_SITES else finest
    joined = rows.join(finest, keys)
    others = (F.col("_strength") * F.col("_above") + (F.col("_sum") - F.col("_p")) / MILLION) / (F.col("_strength") + F.col("_n") - 1)
    site_rate = F.greatest(F.lit(0.001), F.least(F.lit(0.999), others))
    posterior = _sigmoid(F.col("evidence") + _logit(F.col("site_rate")) - float(np.log(base / (1 - base))))
    out = joined.withColumn("site_rate", site_rate).withColumn("posterior", posterior)
    return out.select(
        "doc_id",
        F.round("evidence", 4).alias("evidence"),
        F.round("site_rate", 4).alias("site_rate"),
        F.round("posterior", 4).alias("posterior"),
        (F.col("posterior") >= 0.5).alias("kept"),
    )
