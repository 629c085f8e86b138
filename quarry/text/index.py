"""Inverted index as tables, BM25 and its calibrations, priors, and multi-field match.

An index has ``postings(field, term, doc_id, tf, positions)`` and ``lengths(field, doc_id, len)``. A query reads the postings of its own terms
only (the filter reaches the scan of a written index) and joins lengths and two numbers a field.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from dataclasses import field as given

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import stage
from .analysis import ANALYZERS, Analyzer

K1, B = 1.2, 0.75


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10))
    return F.ln(c / (1 - c))


@dataclass
class Index:
    postings: DataFrame
    lengths: DataFrame
    analyzers: dict[str, Analyzer]
    #: (field, doc_id, tokens) of an index that isn't written: a query counts its terms in one pass over these.
    tokens: DataFrame | None = None
    #: field -> (terms, their staged counts): the last pass over the texts of such an index, which later queries of these terms read.
    counts: dict[str, tuple[list[str], DataFrame]] = given(default_factory=dict)
    #: (field, query) -> its terms.
    parsed: dict[tuple[str, str], list[str]] = given(default_factory=dict)

    @classmethod
    def build(cls, docs: DataFrame, fields: dict[str, str | Analyzer] | list[str], doc_id: str = "doc_id") -> Index:
        """fields: field -> analyzer or its name. One pass: tokens are exploded once and grouped by (field, doc, term)."""
        own = dict.fromkeys(fields, "standard") if isinstance(fields, list) else fields
        analyzers = {f: ANALYZERS[a] if isinstance(a, str) else a for f, a in own.items()}
        parts = [docs.select(F.lit(f).alias("field"), F.col(doc_id).alias("doc_id"), a(F.col(f)).alias("tokens")).where(F.col(f).isNotNull()) for f, a in analyzers.items()]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionAll(p)
        lengths = rows.select("field", "doc_id", F.size("tokens").alias("len"))
        postings = rows.select("field", "doc_id", F.posexplode("tokens").alias("pos", "term")).groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
        return cls(postings, lengths, analyzers, rows)

    def save(self, path: str) -> None:
        """Sorted by term inside each field's folder, so a query's terms prune row groups."""
        self.postings.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").partitionBy("field").parquet(f"{path}/lengths")

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzers: dict[str, Analyzer]) -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), analyzers)

    def terms(self, field: str, query: str) -> list[str]:
        """The query's tokens under the field's analyzer; one row on the driver."""
        if (field, query) not in self.parsed:
            spark = self.postings.sparkSession
            self.parsed[field, query] = spark.range(1).select(self.analyzers[field](F.lit(query)).alias("t")).first().t
        return self.parsed[field, query]

    def prepare(self, field: str, queries: Iterable[str]) -> None:
        """Count the terms of several queries in one pass over the texts; a written index has no need of it."""
        if self.tokens is not None:
            self._count(field, sorted({t for q in queries for t in self.terms(field, q)}))

    def _count(self, field: str, terms: list[str]) -> tuple[list[str], DataFrame]:
        """(terms, rows (doc_id, len, tfs)): each document's length and counts of the terms, staged; terms that the last pass had are read from it."""
        if field not in self.counts or not set(terms) <= set(self.counts[field][0]):
            own = self.tokens.where(F.col("field") == field).select("doc_id", F.size("tokens").alias("len"), F.filter("tokens", lambda x: x.isin(terms)).alias("few"))
            times = lambda t: F.size(F.filter("few", lambda x: x == t)).cast("long")
            tfs = F.array(*map(times, terms)).cast("array<long>")
            self.counts[field] = terms, stage(own.select("doc_id", "len", tfs.alias("tfs")), "counted")
        return self.counts[field]

    def stats(self, field: str) -> DataFrame:
        """One row: documents and their mean length."""
        return self.lengths.where(F.col("field") == field).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avgdl"))

    def _hits(self, field: str, query: str, k1: float, b: float) -> tuple[DataFrame, list[str]]:
        """(doc_id, term, tf, len, w): a row a posting of the query's terms, with its BM25 weight; a term given twice counts twice."""
        terms = self.terms(field, query)
        times = {t: float(terms.count(t)) for t in terms}
        if self.tokens is not None:
            hit, df, _, stats = self._counted(field, sorted(times))
            rows = hit.join(df, "term").crossJoin(F.broadcast(stats))
            return self._weighed(rows, times, k1, b), terms
        hit = self.postings.where((F.col("field") == field) & F.col("term").isin(sorted(times) or [""]))
        df = F.broadcast(hit.groupBy("term").agg(F.count("*").alias("df")))  # a row a query term
        rows = hit.join(df, "term").join(self.lengths.where(F.col("field") == field).select("doc_id", "len"), "doc_id").crossJoin(F.broadcast(self.stats(field)))
        return self._weighed(rows, times, k1, b), terms

    def _counted(self, field: str, terms: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(hits, df, lengths, stats) from one pass over the texts: each document's length and counts of the terms are staged, nothing else."""
        known, own = self._count(field, terms)
        wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
        own = own.select("doc_id", "len", F.array(*[F.col("tfs")[known.index(t)] for t in terms]).cast("array<long>").alias("tfs"))
        hit = own.where(F.exists("tfs", lambda n: n > 0)).select("doc_id", "len", F.posexplode("tfs").alias("k", "tf")).where("tf > 0").withColumn("term", F.element_at(wanted, F.col("k") + 1)).drop("k")
        df = F.broadcast(hit.groupBy("term").agg(F.count("*").alias("df")))  # a row a query term
        return hit, df, own.select("doc_id", "len"), own.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avgdl"))

    @staticmethod
    def _weighed(rows: DataFrame, times: dict[str, float], k1: float, b: float) -> DataFrame:
        idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        norm = k1 * (1 - b + b * F.when(F.col("avgdl") > 0, F.col("len") / F.col("avgdl")).otherwise(1.0))
        boost = F.lit(1.0)
        for t, n in times.items():
            if n != 1:
                boost = F.when(F.col("term") == t, n).otherwise(boost)
        return rows.withColumn("w", boost * (idf - idf / (1 + F.col("tf") / norm)))

    def match(self, field: str, query: str) -> DataFrame:
        """Documents with any of the terms, score 0."""
        terms = self.terms(field, query)
        return self.postings.where((F.col("field") == field) & F.col("term").isin(terms or [""])).select("doc_id").distinct().select("doc_id", F.lit(0.0).alias("score"))

    def phrase(self, field: str, query: str) -> DataFrame:
        """Documents in which the query's tokens stand one after the other; score is the number of places."""
        terms = self.terms(field, query)
        places = self.postings.where((F.col("field") == field) & F.col("term").isin(terms or [""])).select("doc_id", "term", F.explode("positions").alias("pos"))
        want = [F.when(F.col("term") == t, F.col("pos") - k) for k, t in enumerate(terms)]
        starts = places.select("doc_id", F.explode(F.array_compact(F.array(*want))).alias("start")).groupBy("doc_id", "start").agg(F.count("*").alias("n"))
        return starts.where(F.col("n") == len(terms)).groupBy("doc_id").agg(F.count("*").cast("double").alias("score"))

    def bm25(self, field: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
        rows, _ = self._hits(field, query, k1, b)
        return rows.groupBy("doc_id").agg(F.sum("w").alias("score"))

    def bayesian(self, field: str, query: str, alpha: float = 1.0, beta: float = 0.0, base_rate: float = 0.5, length_ratio: str = "reference") -> DataFrame:
        """Calibrated probabilities: a likelihood of each term's weight, a prior of its frequency and length, joined by mean log odds."""
        rows, terms = self._hits(field, query, K1, B)
        ratio = F.lit(1.0) if length_ratio == "reference" else F.when(F.col("avgdl") > 0, F.col("len") / F.col("avgdl")).otherwise(1.0)
        tf_prior = 0.2 + 0.7 * F.least(F.lit(1.0), F.col("tf") / 10)
        norm_prior = 0.3 + 0.6 * (1 - F.least(F.lit(1.0), F.abs(ratio - 0.5) * 2))
        prior = F.least(F.greatest(0.7 * tf_prior + 0.3 * norm_prior, F.lit(0.1)), F.lit(0.9))
        odds = logit(sigmoid(alpha * (F.col("w") - beta))) + logit(prior) + (math.log(base_rate / (1 - base_rate)) if base_rate != 0.5 else 0.0)
        # A term that a document lacks says nothing: log odds zero.
        return rows.groupBy("doc_id").agg((F.sum(odds) / max(1, len(set(terms)))).alias("x")).select("doc_id", sigmoid(F.col("x")).alias("score"))

    def multi_field(self, query: str, weights: dict[str, float]) -> DataFrame:
        """Weighted log odds of the fields' probabilities; a field without a hit counts 0.5."""
        parts = [self.bayesian(f, query).select("doc_id", (logit(F.col("score")) * w).alias("x")) for f, w in weights.items()]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionAll(p)
        return rows.groupBy("doc_id").agg(F.sum("x").alias("x")).select("doc_id", sigmoid(F.col("x") / sum(weights.values())).alias("score"))

    def with_prior(self, field: str, query: str, priors: DataFrame) -> DataFrame:
        """priors: (doc_id, prior). The posterior of the likelihood and an outside prior."""
        rows = self.bayesian(field, query).join(priors, "doc_id", "left")
        p = F.least(F.greatest(F.coalesce("prior", F.lit(0.5)), F.lit(1e-10)), F.lit(1 - 1e-10))
        return rows.select("doc_id", sigmoid(logit(F.col("score")) + logit(p)).alias("score"))


def recency_prior(age_days: Column, decay: float = 30.0) -> Column:
    return F.coalesce(0.5 + 0.4 * F.exp(-age_days / decay), F.lit(0.5))


def authority_prior(level: Column) -> Column:
    return F.when(level == "high", 0.8).when(level == "medium", 0.6).when(level == "low", 0.4).otherwise(0.5)


def query_features(index: Index, field: str, query: str) -> dict[str, float]:
    """Mean, greatest and least idf, coverage, length and vocabulary overlap of a query; one row reaches the driver."""
    terms = index.terms(field, query)
    hit = index.postings.where((F.col("field") == field) & F.col("term").isin(terms or [""])).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    r = hit.crossJoin(F.broadcast(index.stats(field))).agg(F.avg(idf).alias("mean"), F.max(idf).alias("most"), F.min(idf).alias("least"), F.sum("df").alias("df"), F.max("n_docs").alias("n"), F.count("*").alias("k")).first()
    n = max(1, len(set(terms)))
    return {"mean_idf": r["mean"] or 0.0, "max_idf": r["most"] or 0.0, "min_idf": r["least"] or 0.0, "coverage": min(1.0, (r["df"] or 0) / max(1, (r["n"] or 1))), "length": float(len(terms)), "overlap": r["k"] / n}


# --- calibration ------------------------------------------------------------------------------------------------------------------


def calibration(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """pairs: (score, label). One row: log loss, Brier score, expected calibration error, rows."""
    p = F.least(F.greatest(F.col("score"), F.lit(1e-15)), F.lit(1 - 1e-15))
    bucket = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    per = pairs.select("score", "label", bucket.alias("bin"), (-(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))).alias("ll"), F.pow(F.col("score") - F.col("label"), F.lit(2)).alias("sq"))
    cells = per.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("conf"), F.avg("label").alias("acc"), F.sum("ll").alias("ll"), F.sum("sq").alias("sq"))
    return cells.agg((F.sum("ll") / F.sum("n")).alias("log_loss"), (F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def reliability(pairs: DataFrame, bins: int = 10) -> DataFrame:
    bucket = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return pairs.groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("share"))


def learn_sigmoid(pairs: DataFrame, steps: int = 50, ridge: float = 1e-6) -> tuple[float, float]:
    """alpha and beta of P = sigmoid(alpha * (score - beta)), by Newton steps whose sums are Spark aggregates."""
    a = c = 0.0
    for _ in range(steps):
        p = sigmoid(F.lit(a) * F.col("score") + F.lit(c))
        w, g = p * (1 - p), F.col("label") - p
        r = pairs.agg(F.sum(g * F.col("score")), F.sum(g), F.sum(w * F.col("score") * F.col("score")), F.sum(w * F.col("score")), F.sum(w)).first()
        g0, g1, h00, h01, h11 = (float(x or 0) for x in r)
        h00, h11 = h00 + ridge, h11 + ridge
        det = h00 * h11 - h01 * h01
        if abs(det) < 1e-18:
            break
        da, dc = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, c = a + da, c + dc
        if abs(da) + abs(dc) < 1e-9:
            break
    return a, (-c / a if a else 0.0)
