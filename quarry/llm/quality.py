"""Quality rules: robust multivariate outliers among documents of one language and source.

Counts of each text give a vector of transformed statistics: log mean word length, log number of words, and the arc sines of the
root shares of symbols, repeated lines and words in repeated windows (shares of ``PSEUDO`` units more than there are, so that one count
in a short text isn't far out). Each (lang, source) group has its own minimum-covariance-determinant estimate, regularised as Boudt et
al. do (2020), so that it exists at every size: of subsets of ``SUPPORT`` of the group, the one is sought whose

    K = (PRIOR * T + h * c * S) / (PRIOR + h)         h: subset's weight; S: its covariance; c: consistency factor

has the least determinant. T, diagonal, is the language's own robust scatter (itself drawn smoothly toward that of all rows), so a group
of one document is held against its language and a large one against itself, with no size at which the rule changes. The centre
is the subset's mean with the language's centre as one document more. Concentration steps run from three starts (the language's
centre and scatter; the group's medians and deviations; its mean and covariance) until no determinant falls further; the least is
taken. A document whose squared Mahalanobis distance is beyond the chi-square quantile is rejected.

A statistic may be the same in most documents of a group (no symbols, no repeats): then its variance is taken as the sampling variance
of such a share, 1 / (4 * units), averaged over the subset. Nothing else bounds the scales.

Each step is two grouped sums over a staged table of a few numbers a document (a histogram of distances, then moments), combined
before the shuffle, so a group may hold any share of all rows. Documents in the histogram's cell at the subset's edge share what is
left of its weight, so its weight is exactly the support. Equal vectors, such as those of copies, are one observation.

Cases: null and empty texts have no words and fail the base rule; null lang or source are values of their own; repeated rows get
the same verdict; ties of distance are in the support by equal parts; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, small, staged, table

WORDS = re.compile(WORD)
SYMBOLS = re.compile(r"[#*$%&|<>]")
MIN_WORDS = 50
SUPPORT = 0.75
#: Documents that the language's scatter counts for beside a group's own.
PRIOR = 20
#: Units added below each share.
PSEUDO = 10
#: A step that lowers no group's log determinant by more ends the search; so many steps are taken at most.
SETTLED, STEPS = 1e-3, 40
#: Of the chi-square distribution; one clean document in as many is beyond.
BEYOND = 1e-6
FEATURES = ("x0", "x1", "x2", "x3", "x4")
SHARES = ("x2", "x3", "x4")
NOISE = ("v2", "v3", "v4")
RIDGE = 1e-6
FINE = 32


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word)"""
    text = text or ""
    words = WORDS.findall(text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORDS.search(line):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), dup, repeated(words), lines


def repeated(words: list[str], width: int = 3) -> int:
    """Words that stand in a window of the width that is found twice or more."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    times, total, covered = Counter(windows), 0, 0
    if len(times) == len(windows):
        return 0
    for k, w in enumerate(windows):
        if times[w] > 1:
            total += k + width - max(covered, k)
            covered = k + width
    return total


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES, *NOISE)


def vectors(c: np.ndarray) -> list[np.ndarray]:
    """The five statistics and the sampling variances of the last three, from rows of counts()."""
    n = np.maximum(c[:, 0], 1).astype(float)
    units = [c[:, k] + PSEUDO for k in (1, 5, 0)]
    shares = [np.arcsin(np.sqrt(np.minimum(1.0, c[:, k] / u))) for k, u in zip((2, 3, 4), units, strict=True)]
    return [np.log((c[:, 1] + 1) / n), np.log(n), *shares, *(1 / (4 * u) for u in units)]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, source, counts, base_failed, x0..x4, v2..v4)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.array([counts(t.as_py()) for t in b.column(3)], dtype=np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), *(pa.array(c[:, k]) for k in range(5)), *map(pa.array, vectors(c))], names=["doc_id", "lang", "source", *NAMES])

    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    ddl = f"doc_id {kind}, lang string, source string, " + ", ".join(f"{n} {'double' if n in FEATURES + NOISE else 'long'}" for n in NAMES)
    out = docs.select(F.col(id_col).alias("doc_id"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return d * (1 - 2 / (9 * d) + z * math.sqrt(2 / (9 * d))) ** 3


D = len(FEATURES)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
PARAMS = [f"m{i}" for i in range(D)] + [f"p{i}{j}" for i, j in PAIRS] + ["logdet"]
STARTS = 3


def distance() -> Column:
    """Squared Mahalanobis distance from columns m (centre) and p (upper half of the precision)."""
    out = F.lit(0.0)
    for i, j in PAIRS:
        out = out + (1 if i == j else 2) * F.col(f"p{i}{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}"))
    return out


def _observations(stats: DataFrame) -> DataFrame:
    """(lang_key, key, x, v): the distinct vectors of each group that pass the base rule."""
    named = stats.where(~F.col("base_failed")).select(F.to_json(F.struct("lang")).alias("lang_key"), F.to_json(F.struct("lang", "source")).alias("key"), *FEATURES, *NOISE)
    return staged(named.distinct(), "observed")


def _scatter(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, c0.., t0..): medians, and squared deviations by the median one, at least the sampling variance."""
    mid = rows.groupBy(*by).agg(*[F.percentile_approx(f"x{i}", 0.5, 10_000).alias(f"c{i}") for i in range(D)])
    mid = small(mid, "medians")
    joined = rows.join(mid, by) if by else rows.join(F.broadcast(mid))  # without keys, one row
    keep = [f"c{i}" for i in range(D)]
    off = joined.groupBy(*by, *keep).agg(
        F.count("*").cast("double").alias("n"),
        *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), 0.5, 10_000).alias(f"s{i}") for i in range(D)],
        *[F.avg(v).alias(v) for v in NOISE],
    )
    least = lambda i: F.col(f"v{i}") if f"v{i}" in NOISE else F.lit(RIDGE)
    return off.select(*by, "n", *keep, *[F.greatest(F.pow(1.4826 * F.col(f"s{i}"), F.lit(2)), least(i)).alias(f"t{i}") for i in range(D)])


def _priors(rows: DataFrame) -> DataFrame:
    """(lang_key, c0.., t0..): each language's centre and scatter, drawn toward those of all rows by their numbers."""
    every = _scatter(rows, []).select(*[F.col(f"{k}{i}").alias(f"all_{k}{i}") for i in range(D) for k in "ct"])
    own = _scatter(rows, ["lang_key"]).join(F.broadcast(every))  # one row
    toward = lambda k, i, w: ((F.col("n") * F.col(f"{k}{i}") + w * F.col(f"all_{k}{i}")) / (F.col("n") + w)).alias(f"{k}{i}")
    return small(own.select("lang_key", *[toward("c", i, 1) for i in range(D)], *[toward("t", i, PRIOR) for i in range(D)]), "priors")


def solved(n: float, mean: np.ndarray, cov: np.ndarray, noise: np.ndarray, centre: np.ndarray, target: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(centre, precision, log determinant) of the regularised estimate from a subset's moments."""
    k = (np.diag(target) * PRIOR + n * factor * cov) / (PRIOR + n)
    least = np.array([RIDGE, RIDGE, *noise])
    k = k + np.diag(np.maximum(least - np.diag(k), 0)) + np.eye(D) * 1e-12
    return (n * mean + centre) / (n + 1), np.linalg.inv(k), float(np.linalg.slogdet(k)[1])


def factor_of(support: float) -> float:
    """The support's covariance is too small; its known share of a normal distribution says by how much."""
    return support / max(1e-9, _inner_share(support)) if support < 1 else 1.0


def _moments(weighted: DataFrame, keys: list[str]) -> DataFrame:
    w = F.col("w")
    return weighted.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        *[F.sum(w * F.col(f"x{i}")).alias(f"s{i}") for i in range(D)],
        *[F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS],
        *[F.avg(v).alias(v) for v in NOISE],
    )


def _solve(sums: DataFrame, priors: DataFrame, factor: float) -> DataFrame:
    """Moments of subsets to estimates, in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                n, get = r["n"], lambda k: np.array([r[f"{k}{i}"] for i in range(D)])  # noqa: B023
                mean, cov = get("s") / n, np.zeros((D, D))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = r[f"q{i}{j}"] / n - mean[i] * mean[j]
                mid, prec, logdet = solved(n, mean, cov, np.array([r[v] for v in NOISE]), get("c"), get("t"), factor)
                out.append([r["key"], r["lang_key"], r["start"], *mid, *(prec[i, j] for i, j in PAIRS), logdet])
            yield pd.DataFrame(out, columns=["key", "lang_key", "start", *PARAMS])

    return sums.join(priors, "lang_key").mapInPandas(run, "key string, lang_key string, start int, " + ", ".join(f"{p} double" for p in PARAMS))


def _starts(rows: DataFrame, priors: DataFrame) -> DataFrame:
    """Three estimates a group: its language's, one from medians and deviations, and one from all its rows."""
    diagonal = lambda t: [(1 / F.col(f"{t}{i}") if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i, j in PAIRS]
    own = _scatter(rows, ["key", "lang_key"])
    drawn = own.join(priors.select("lang_key", *[F.col(f"t{i}").alias(f"lt{i}") for i in range(D)], *[F.col(f"c{i}").alias(f"lc{i}") for i in range(D)]), "lang_key")
    for i in range(D):
        drawn = drawn.withColumn(f"t{i}", (F.col("n") * F.col(f"t{i}") + PRIOR * F.col(f"lt{i}")) / (F.col("n") + PRIOR))
    names = ["key", "lang_key", "start", *PARAMS]
    high = F.lit(float("inf")).alias("logdet")
    of = lambda k, m, t: drawn.select("key", "lang_key", F.lit(k).alias("start"), *[F.col(f"{m}{i}").alias(f"m{i}") for i in range(D)], *diagonal(t), high).select(*names)
    third = _solve(_moments(rows.withColumn("w", F.lit(1.0)).withColumn("start", F.lit(2)), ["key", "lang_key", "start"]), priors, 1.0).withColumn("logdet", high)
    return small(of(0, "lc", "lt").unionByName(of(1, "c", "t")).unionByName(third.select(*names)), "starts")


def _step(rows: DataFrame, params: DataFrame, priors: DataFrame, support: float) -> DataFrame:
    """One concentration step for all groups and starts; an estimate is replaced only by one of a smaller determinant."""
    at = rows.join(params.drop("lang_key", "logdet"), "key").withColumn("cell", F.floor(F.log2(distance() + 1e-9) * FINE).cast("int")).select("key", "lang_key", "start", "cell", *FEATURES, *NOISE)
    cells = at.groupBy("key", "start", "cell").agg(F.count("*").alias("n"))
    group = W.partitionBy("key", "start")
    edge = (
        cells.withColumn("upto", F.sum("n").over(group.orderBy("cell")))
        .withColumn("want", F.greatest(F.floor(F.sum("n").over(group) * support), F.lit(1)))
        .where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
        .select("key", "start", F.col("cell").alias("edge"), ((F.col("want") - F.col("upto") + F.col("n")) / F.col("n")).alias("part"))
    )
    # One row a group and start.
    inner = at.join(small(edge, "edges"), ["key", "start"]).where(F.col("cell") <= F.col("edge")).withColumn("w", F.when(F.col("cell") == F.col("edge"), F.col("part")).otherwise(F.lit(1.0)))
    new = _solve(_moments(inner, ["key", "lang_key", "start"]), priors, factor_of(support))
    both = new.withColumn("old", F.lit(None).cast("double")).unionByName(params.withColumn("old", F.col("logdet")))
    best = both.groupBy("key", "lang_key", "start").agg(F.min_by(F.struct(*PARAMS), "logdet").alias("best"), F.max("old").alias("old"))
    return small(best.select("key", "lang_key", "start", "best.*", (F.col("old") - F.col("best.logdet")).alias("fell")), "step")


def estimates(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """(key, m, p, logdet): each group's estimate of the least determinant among its starts."""
    priors = _priors(rows)
    params = _starts(rows, priors)
    for _ in range(steps):
        now = _step(rows, params, priors, support)
        params = now.drop("fell")
        if (now.agg(F.max("fell")).first()[0] or 0.0) <= SETTLED:
            break
    return small(params.groupBy("key").agg(F.min_by(F.struct(*PARAMS), F.struct("logdet", "start")).alias("best")).select("key", "best.*"), "estimates")


def _inner_share(support: float) -> float:
    """P(chi2 with D + 2 degrees <= the support quantile of D degrees), by the same approximation run backwards."""
    from statistics import NormalDist

    x, d = chi2_quantile(support, D), D + 2
    return NormalDist().cdf(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))


def judge(docs: DataFrame, support: float = SUPPORT, steps: int = STEPS, beyond: float = BEYOND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts, base_failed, distance2 (null where the base rule failed) and kept."""
    stats = staged(statistics(docs, id_col, text_col), "statistics")
    found = estimates(_observations(stats), support, steps)
    cut = chi2_quantile(1 - beyond, D)
    return (
        stats.withColumn("key", F.to_json(F.struct("lang", "source")))
        .join(found, "key", "left")
        .withColumn("distance2", F.when(~F.col("base_failed"), distance()))
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cut))
        .drop(*PARAMS)
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
