"""Vector retrieval over ARRAY<FLOAT/DOUBLE> columns: exact cosine in JVM expressions, thresholds, calibrated search, inverted cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import scored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def cosine(a: Column, b: Column) -> Column:
    """Null where either has no length."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def similarities(vectors: DataFrame, query: Sequence[float], field: str = "embedding") -> DataFrame:
    size = math.sqrt(sum(float(x) ** 2 for x in query))
    if not size:
        return vectors.select("doc_id", F.lit(None).cast("double").alias("score")).where("score IS NOT NULL")
    unit = literal([float(x) / size for x in query])
    c = F.col(field)
    return vectors.select("doc_id", (dot(c, unit) / F.nullif(F.sqrt(dot(c, c)), F.lit(0.0))).alias("score")).where("score IS NOT NULL")


def knn(vectors: DataFrame, query: Sequence[float], k: int, field: str = "embedding", calibrated: bool = False) -> DataFrame:
    """The k nearest by cosine, ties by doc_id: each task keeps its k, one merges them. calibrated: (1 + cos) / 2."""
    best = scored.top_k(similarities(vectors, query, field), k)
    return best.withColumn("score", (1 + F.col("score")) / 2) if calibrated else best


def within(vectors: DataFrame, query: Sequence[float], threshold: float, field: str = "embedding") -> DataFrame:
    return similarities(vectors, query, field).where(F.col("score") >= threshold)


def exclude(vectors: DataFrame, positive: Sequence[float], negative: Sequence[float], k: int, threshold: float, field: str = "embedding") -> DataFrame:
    """The k nearest to positive without those as near as threshold to negative."""
    return scored.difference(knn(vectors, positive, k, field), within(vectors, negative, threshold, field))


def facet(docs: DataFrame, vectors: DataFrame, query: Sequence[float], threshold: float, column: str, field: str = "embedding") -> DataFrame:
    return scored.facet(docs.join(within(vectors, query, threshold, field).select("doc_id"), "doc_id"), column)


# --- calibrated search ----------------------------------------------------------------------------------------------------------------


def bayesian_knn(
    vectors: DataFrame,
    query: Sequence[float],
    k: int,
    field: str = "embedding",
    weights: DataFrame | None = None,
    base_rate: float = 0.5,
    bandwidth_scale: float = 1.0,
    compat: bool = False,
) -> DataFrame:
    """Probability of relevance from the ratio of two kernel densities of the distance 1 - cos: among the k found and in the background.

    weights: (doc_id, weight) of the found documents, such as text probabilities; equal without. compat: the relevant density is
    taken as twice the background's, so that the probability depends on the prior alone. The background is the mean and deviation
    of all distances, one aggregate; its density is normal with the rule-of-thumb widening.
    """
    all_ = similarities(vectors, query, field).withColumn("d", 1 - F.col("score"))
    stats = all_.agg(F.avg("d").alias("mu"), F.stddev_pop("d").alias("sd"), F.count("*").alias("n"))
    found = scored.top_k(all_.select("doc_id", "score", "d"), k)
    if weights is not None:
        found = found.join(weights.select("doc_id", "weight"), "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.01)))
    else:
        found = found.withColumn("weight", F.lit(1.0))
    gathered = found.agg(F.collect_list(F.struct("d", "weight")).alias("own"))  # k rows
    rows = found.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(gathered))
    h = F.greatest(1.06 * F.col("sd") * F.pow(F.greatest(F.col("n"), F.lit(1)), F.lit(-0.2)) * bandwidth_scale, F.lit(1e-6))
    bg_sd = F.sqrt(F.col("sd") * F.col("sd") + h * h)
    gauss = lambda x, sd: F.exp(-x * x / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))
    bg = F.greatest(gauss(F.col("d") - F.col("mu"), bg_sd), F.lit(1e-12))
    rows = rows.withColumn("h", h)
    kde = F.aggregate("own", F.lit(0.0), lambda s, x: s + x["weight"] * gauss(F.col("d") - x["d"], F.col("h"))) / F.aggregate("own", F.lit(0.0), lambda s, x: s + x["weight"])
    rel = 2 * bg if compat else F.greatest(kde, F.lit(1e-12))
    odds = rel / bg * (base_rate / (1 - base_rate))
    return rows.select("doc_id", F.least(F.greatest(odds / (1 + odds), F.lit(0.001)), F.lit(0.999)).alias("score"))


# --- inverted cells -------------------------------------------------------------------------------------------------------------------


def _nearest(centroids: np.ndarray):
    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=float).reshape(len(v), -1)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series((x / np.where(n > 0, n, 1) @ centroids.T).argmax(axis=1).astype("int32"))

    return cell


class Ivf:
    """k-means cells: trained on a bounded sample (``train`` rows, by a hash of doc_id), every vector gets its cell; a search reads nprobe cells.

    ``cells`` has (doc_id, embedding, cell) and can be written partitioned by cell, so a probe prunes files.
    """

    def __init__(self, vectors: DataFrame, nlist: int = 16, train: int = 4096, seed: int = 42, rounds: int = 15, field: str = "embedding"):
        rows = vectors.select("doc_id", F.col(field).alias("embedding")).where(F.size("embedding") > 0)
        sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train).select("embedding").collect()  # train rows at most
        x = np.array([r.embedding for r in sample], dtype=float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(seed)
        self.centroids = x[rng.permutation(len(x))[: min(nlist, len(x))]]
        for _ in range(rounds):
            own = (x @ self.centroids.T).argmax(axis=1)
            for k in range(len(self.centroids)):
                if (own == k).any():
                    c = x[own == k].mean(axis=0)
                    self.centroids[k] = c / max(np.linalg.norm(c), 1e-12)
        self.cells = rows.withColumn("cell", _nearest(self.centroids)("embedding"))

    def search(self, query: Sequence[float], k: int, nprobe: int = 4) -> DataFrame:
        q = np.asarray(query, dtype=float)
        near = np.argsort(-(self.centroids @ (q / max(np.linalg.norm(q), 1e-12))), kind="stable")[:nprobe].tolist()
        return knn(self.cells.where(F.col("cell").isin(near)), query, k)

    def density_prior(self, gamma: float = 0.5) -> DataFrame:
        """(cell, prior): (population / mean population) ^ gamma."""
        n = self.cells.groupBy("cell").agg(F.count("*").alias("n"))
        return n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("mean")))).select("cell", F.pow(F.col("n") / F.col("mean"), F.lit(gamma)).alias("prior"))


# --- joins ----------------------------------------------------------------------------------------------------------------------------


#: Rows a block: the product of two has some four million cells.
BLOCK = 2048


def _product(threshold: float):
    """Two blocks (doc_id, d, embedding) to the pairs (left_id, right_id, score) with cosine >= threshold."""

    def matrix(t: pa.Table) -> np.ndarray:
        own = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        return np.ascontiguousarray(own.reshape(t.num_rows, -1).T)  # a row a dimension

    def summed(x: np.ndarray, y: np.ndarray, i=slice(None), j=slice(None)) -> np.ndarray:
        """Dot products in the order of the dimensions, as dot() adds them."""
        out = 0.0
        for u, v in zip(x, y, strict=True):
            out = out + u[i] * v[j]
        return out

    def pairs(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            x, y = matrix(a), matrix(b)
            with np.errstate(all="ignore"):
                n = np.sqrt(np.multiply.outer(summed(x, x), summed(y, y)))
                # The product only leaves out what is surely below the threshold; pairs are scored by themselves. NaN counts as greatest, as in SQL.
                i, j = np.nonzero(~((x.T @ y) / n < threshold - 1e-9) & (n != 0))
                score = summed(x, y, i, j) / n[i, j]
            keep = (score >= threshold) | np.isnan(score)
            i, j, score = i[keep], j[keep], score[keep]
        else:
            i = j = np.array([], dtype=int)
            score = np.array([])
        return pa.table({"left_id": a["doc_id"].take(pa.array(i)), "right_id": b["doc_id"].take(pa.array(j)), "score": score})

    return pairs


def _near(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Both sides (doc_id, k, embedding): pairs of equal k with cosine >= threshold, exactly.

    Each k's rows are dealt to blocks of about BLOCK rows, and each two blocks meet as a matrix product in a task, so that a task's memory
    doesn't depend on the size of a k. The work is that of all pairs; a row is sent once for each block of the other side.
    """
    whole = F.col("k").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())
    a, b = (df.select("doc_id", "k", "embedding", F.size("embedding").alias("d")).where(whole & (F.col("d") > 0)) for df in (left, right))
    counts = [df.groupBy("k", "d").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"n{s}")) for df, s in ((a, "l"), (b, "r"))]
    blocks = counts[0].join(counts[1], ["k", "d"])

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.join(blocks, ["k", "d"]).withColumn(f"b{own}", F.pmod(F.xxhash64("doc_id"), F.col(f"n{own}")).cast("int"))
        rows = rows.withColumn(f"b{other}", F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)))
        return rows.select(*[F.col(c).alias(c) for c in ("k", "d", "bl", "br", "doc_id", "embedding")]).groupBy("k", "d", "bl", "br")  # named anew: both sides may be one table

    kind = lambda df: df.schema["doc_id"].dataType
    schema = StructType([StructField("left_id", kind(left)), StructField("right_id", kind(right)), StructField("score", DoubleType())])
    return dealt(a, "l", "r").cogroup(dealt(b, "r", "l")).applyInArrow(_product(threshold), schema)


def similarity_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs with cosine >= threshold. Both sides: (doc_id, embedding)."""
    return _near(*(df.select("doc_id", F.lit(0).alias("k"), "embedding") for df in (left, right)), threshold)


def hybrid_join(left: DataFrame, right: DataFrame, field: str, threshold: float) -> DataFrame:
    """Equality on a field, then cosine >= threshold."""
    return _near(*(df.select("doc_id", F.col(field).alias("k"), "embedding") for df in (left, right)), threshold)
