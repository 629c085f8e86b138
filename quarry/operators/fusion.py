"""Fusion of probability signals: log odds, probabilistic Boolean, adaptive, attention, learned, and staged retrieval.

A document that a signal lacks has that signal's default, 0.5 (1 - r) + 0.01 r, with r the share of the union that the signal covers. All
signals are put into one wide row a document by a single grouped pass, never by a chain of joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scored

EPS = 1e-10


def logit(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.ln(c / (1 - c))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gate(x: Column, gating: str = "none", beta: float = 1.0) -> Column:
    if gating == "relu":
        return F.greatest(x, F.lit(0.0))
    if gating == "swish":
        return x * sigmoid(beta * x)
    return x


def wide(signals: Sequence[DataFrame], default: float | None = None) -> DataFrame:
    """(doc_id, p0, p1, ...): one row a document of the union; absent signals have their coverage default, or the one given."""
    rows = None
    for k, s in enumerate(signals):
        one = s.select("doc_id", F.lit(k).alias("k"), F.col("score").cast("double").alias("score"))
        rows = one if rows is None else rows.unionAll(one)
    n = len(signals)
    per = rows.groupBy("doc_id").agg(*[F.max(F.when(F.col("k") == k, F.col("score"))).alias(f"p{k}") for k in range(n)])
    if default is not None:
        return per.select("doc_id", *[F.coalesce(f"p{k}", F.lit(default)).alias(f"p{k}") for k in range(n)])
    r = F.broadcast(per.agg(*[(F.count(f"p{k}") / F.greatest(F.count("*"), F.lit(1))).alias(f"r{k}") for k in range(n)]))  # one row
    return per.crossJoin(r).select("doc_id", *[F.coalesce(F.col(f"p{k}"), 0.5 * (1 - F.col(f"r{k}")) + 0.01 * F.col(f"r{k}")).alias(f"p{k}") for k in range(n)])


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in df.columns if c != "doc_id"]


def log_odds_column(ps: Sequence[Column], alpha: float = 0.5, weights: Sequence[float] | None = None, gating: str = "none", beta: float = 1.0) -> Column:
    """sigmoid(n^alpha * sum of w_i logit(p_i)), w_i = 1/n without weights. One signal is itself; none is 0.5."""
    if not ps:
        return F.lit(0.5)
    if len(ps) == 1:
        return ps[0]
    w = weights or [1 / len(ps)] * len(ps)
    total = sum((gate(logit(p), gating, beta) * float(v) for p, v in zip(ps[1:], w[1:], strict=True)), gate(logit(ps[0]), gating, beta) * float(w[0]))
    return sigmoid(total * len(ps) ** alpha)


def log_odds(signals: Sequence[DataFrame], alpha: float = 0.5, gating: str = "none", beta: float = 1.0, weights: Sequence[float] | None = None, k: int | None = None) -> DataFrame:
    w = wide(signals)
    out = w.select("doc_id", log_odds_column(_columns(w), alpha, weights, gating, beta).alias("score"))
    return scored.top_k(out, k) if k else out


def prob_and(signals: Sequence[DataFrame]) -> DataFrame:
    w = wide(signals)
    return w.select("doc_id", F.exp(sum((F.ln(F.greatest(p, F.lit(EPS))) for p in _columns(w)), F.lit(0.0))).alias("score"))


def prob_or(signals: Sequence[DataFrame]) -> DataFrame:
    w = wide(signals)
    return w.select("doc_id", (1 - F.exp(sum((F.ln(F.greatest(1 - p, F.lit(EPS))) for p in _columns(w)), F.lit(0.0)))).alias("score"))


def prob_not(signal: DataFrame, universe: DataFrame) -> DataFrame:
    """1 - p over all documents; absent ones count as 0.01."""
    return universe.select("doc_id").join(signal, "doc_id", "left").select("doc_id", (1 - F.coalesce("score", F.lit(0.01))).alias("score"))


def adaptive(signals: Sequence[DataFrame], base_alpha: float = 0.5, errors: Sequence[float] | None = None) -> DataFrame:
    """alpha is the mean over signals of base * (0.5 + coverage * (1 - calibration error)); coverage comes from one aggregate."""
    rows = wide(signals)
    union_n = rows.count()
    counts = [s.count() for s in signals]
    errors = errors or [0.0] * len(signals)
    alpha = sum(base_alpha * (0.5 + (c / max(1, union_n)) * (1 - e)) for c, e in zip(counts, errors, strict=True)) / len(signals)
    return rows.select("doc_id", log_odds_column(_columns(rows), alpha).alias("score"))


def adaptive_weights(coverage: Sequence[float], errors: Sequence[float], variances: Sequence[float], base: float = 0.5) -> list[float]:
    raw = [min(1.0, max(0.01, base * c * (1 - e) / (1 + v))) for c, e, v in zip(coverage, errors, variances, strict=True)]
    return [r / sum(raw) for r in raw]


def softmax(x: Sequence[float]) -> list[float]:
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def attention(signals: Sequence[DataFrame], features: Sequence[float], matrix: Sequence[Sequence[float]] | None = None, alpha: float = 0.5, normalized: bool = False) -> DataFrame:
    """Weights are the softmax of a matrix times the query's features, found once on the driver; normalized shifts logits to mean zero."""
    if len(signals) < 2:
        raise ValueError("attention needs two signals")
    m = np.asarray(matrix) if matrix is not None else np.zeros((len(signals), len(features)))
    weights = softmax((m @ np.asarray(features)).tolist())
    w = wide(signals)
    ps = _columns(w)
    if normalized:
        mean = F.broadcast(w.agg(*[F.avg(logit(p)).alias(f"m{k}") for k, p in enumerate(ps)]))
        w = w.crossJoin(mean)
        ps = [sigmoid(logit(p) - F.col(f"m{k}")) for k, p in enumerate(ps)]
    return w.select("doc_id", log_odds_column(ps, alpha, weights).alias("score"))


def multihead(signals: Sequence[DataFrame], features: Sequence[float], heads: int = 4, alpha: float = 0.5, seed: int = 0, normalized: bool = False) -> DataFrame:
    """The mean of several attention heads' log odds, each with a seeded matrix."""
    w = wide(signals)
    ps, rng = _columns(w), np.random.default_rng(seed)
    parts = [log_odds_column(ps, alpha, softmax((rng.normal(0, 0.1, (len(ps), len(features))) @ np.asarray(features)).tolist())) for _ in range(heads)]
    return w.select("doc_id", sigmoid(sum((logit(p) for p in parts), F.lit(0.0)) / heads).alias("score"))


def learned(signals: Sequence[DataFrame], weights: Sequence[float], alpha: float = 0.5) -> DataFrame:
    w = wide(signals)
    total = sum(weights)
    return w.select("doc_id", log_odds_column(_columns(w), alpha, [x / total for x in weights]).alias("score"))


def learn_weights(signals: Sequence[DataFrame], labels: DataFrame, steps: int = 100, rate: float = 0.5) -> list[float]:
    """Weights by gradient descent on log loss; each step is one aggregate. labels: (doc_id, label)."""
    w = wide(signals)
    rows = w.join(labels, "doc_id").select("label", *[logit(p).alias(f"x{k}") for k, p in enumerate(_columns(w))]).persist()
    theta = np.zeros(len(signals))
    for _ in range(steps):
        own = np.exp(theta - theta.max())
        own /= own.sum()
        z = sum((F.col(f"x{k}") * float(own[k]) for k in range(len(own))), F.lit(0.0))
        g = F.col("label") - sigmoid(z)
        got = rows.agg(*[F.avg(g * (F.col(f"x{k}") - z)) for k in range(len(own))]).first()
        theta = theta + rate * own * np.array([float(v or 0) for v in got])
    rows.unpersist()
    own = np.exp(theta - theta.max())
    return (own / own.sum()).tolist()


def staged(stages: Sequence[tuple[DataFrame, float]]) -> DataFrame:
    """(signal, cutoff) pairs: an integer cutoff keeps the best, a fraction those at least so good. A stage rescores what it knows."""
    now = None
    for signal, cut in stages:
        if now is None:
            now = signal.select("doc_id", "score")
        else:
            fresh = signal.select("doc_id", F.col("score").alias("fresh"))
            now = now.join(fresh, "doc_id", "left").select("doc_id", F.coalesce("fresh", "score").alias("score"))
        now = scored.top_k(now, int(cut)) if float(cut).is_integer() and cut >= 1 else now.where(F.col("score") >= cut)
    return now


def progressive(stages: Sequence[tuple[Sequence[DataFrame], int]], alpha: float = 0.5, gating: str = "none") -> DataFrame:
    """Each stage adds its signals, fuses all so far over the candidates left, and keeps the k best."""
    signals: list[DataFrame] = []
    kept = None
    for own, k in stages:
        signals += own if kept is None else [s.join(kept.select("doc_id"), "doc_id", "left_semi") for s in own]
        if kept is not None:
            signals = [s.join(kept.select("doc_id"), "doc_id", "left_semi") for s in signals]
        kept = log_odds(signals, alpha, gating, k=k)
    return kept


def fold(signals: Sequence[DataFrame], fn: Callable[[list[Column]], Column]) -> DataFrame:
    w = wide(signals)
    return w.select("doc_id", fn(_columns(w)).alias("score"))
