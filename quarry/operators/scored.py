"""The retrieval contract: a Scored DataFrame has one row a document, (doc_id, score, ...). Its Boolean algebra, joins and folds.

Union and intersection add the scores of a document that both have; difference and complement keep the left score or none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, score double"


def scored(df: DataFrame, score: Column | float = 0.0, doc_id: str = "doc_id") -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_id"), (score if isinstance(score, Column) else F.lit(float(score))).alias("score"))


def union(*parts: DataFrame) -> DataFrame:
    """Documents in any part; a single aggregate over the parts' rows, whatever their number."""
    rows = reduce(lambda a, b: a.unionAll(b), [p.select("doc_id", "score") for p in parts])
    return rows.groupBy("doc_id").agg(F.sum("score").alias("score"))


def intersect(*parts: DataFrame) -> DataFrame:
    """Documents in every part: one aggregate, no chain of joins."""
    rows = reduce(lambda a, b: a.unionAll(b), [p.select("doc_id", "score", F.lit(k).alias("part")) for k, p in enumerate(parts)])
    return rows.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == len(parts)).drop("n")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("doc_id"), "doc_id", "left_anti")


def complement(a: DataFrame, universe: DataFrame) -> DataFrame:
    return universe.join(a.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(0.0).alias("score"))


def top_k(a: DataFrame, k: int) -> DataFrame:
    """The k best; ties by doc_id."""
    return a.orderBy(F.col("score").desc(), F.col("doc_id")).limit(k)


def threshold(a: DataFrame, least: float) -> DataFrame:
    """Sparse threshold: max(0, score - least), zeros dropped."""
    return a.withColumn("score", F.col("score") - least).where("score > 0")


def with_fields(a: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """Documents' fields beside the score."""
    return a.join(docs.select("doc_id", *columns), "doc_id")


# --- joins of two scored sides: rows (left_id, right_id, score), scores added, null keys never match --------------------------


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{side}_{'id' if c == 'doc_id' else c}") for c in df.columns])


def join(left: DataFrame, right: DataFrame, left_field: str, right_field: str, how: str = "inner") -> DataFrame:
    """inner, left, right or full equi-join; Spark picks broadcast, hash or merge by size."""
    a, b = _side(left, "left"), _side(right, "right")
    lf, rf = ("left_id" if left_field == "doc_id" else f"left_{left_field}"), ("right_id" if right_field == "doc_id" else f"right_{right_field}")
    out = a.join(b, a[lf] == b[rf], how)
    return out.withColumn("score", F.coalesce("left_score", F.lit(0.0)) + F.coalesce("right_score", F.lit(0.0))).drop("left_score", "right_score")


def merge_join(left: DataFrame, right: DataFrame, left_field: str, right_field: str) -> DataFrame:
    return join(left, right.hint("merge"), left_field, right_field)


def index_join(left: DataFrame, right: DataFrame, left_field: str, right_field: str) -> DataFrame:
    """The right side is hashed once a partition and looked up."""
    return join(left, right.hint("shuffle_hash"), left_field, right_field)


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """The product, which the query asks for by name."""
    a, b = _side(left, "left"), _side(right, "right")
    return a.crossJoin(b).withColumn("score", F.col("left_score") + F.col("right_score")).drop("left_score", "right_score")


def semi(left: DataFrame, right: DataFrame, on: str | Column = "doc_id") -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: str | Column = "doc_id") -> DataFrame:
    return left.join(right, on, "left_anti")


def text_similarity_join(left: DataFrame, right: DataFrame, tokens: str = "tokens", threshold: float = 0.5) -> DataFrame:
    """Jaccard of token sets >= threshold, exactly, by prefix filtering: only the rarest tokens of each side are joined on.

    A pair at the threshold must share one of each set's first size - ceil(threshold * size) + 1 tokens in an order common to both
    sides; the order is by frequency, so common tokens, whatever share of rows has them, rarely make candidates. Empty sets match nothing.
    """
    a = left.select(F.col("doc_id").alias("left_id"), F.array_distinct(tokens).alias("left_tokens")).where(F.size("left_tokens") > 0)
    b = right.select(F.col("doc_id").alias("right_id"), F.array_distinct(tokens).alias("right_tokens")).where(F.size("right_tokens") > 0)
    freq = a.select(F.explode("left_tokens").alias("token")).unionAll(b.select(F.explode("right_tokens").alias("token"))).groupBy("token").agg(F.count("*").alias("df"))

    def prefixed(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(f"{side}_id", F.size(f"{side}_tokens").alias("n"), F.explode(f"{side}_tokens").alias("token")).join(freq, "token")
        ordered = rows.groupBy(f"{side}_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"))
        keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
        return ordered.select(f"{side}_id", F.explode(F.slice(F.col("o.token"), F.lit(1), keep.cast("int"))).alias("token"))

    pairs = prefixed(a, "left").join(prefixed(b, "right"), "token").select("left_id", "right_id").distinct()
    out = pairs.join(a, "left_id").join(b, "right_id")
    score = F.size(F.array_intersect("left_tokens", "right_tokens")) / F.size(F.array_union("left_tokens", "right_tokens"))
    return out.select("left_id", "right_id", score.alias("score")).where(F.col("score") >= threshold)


# --- monoids -------------------------------------------------------------------------------------------------------------------

#: Fold of a column with its value on no rows; partial and final aggregation are Spark's.
MONOIDS: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "avg": lambda c: F.coalesce(F.avg(c), F.lit(0.0)),
    "min": lambda c: F.coalesce(F.min(c), F.lit(float("inf"))),
    "max": lambda c: F.coalesce(F.max(c), F.lit(float("-inf"))),
    "quantile": lambda c: F.coalesce(F.percentile(c, 0.5), F.lit(0.0)),
}


def quantile(q: float) -> Callable[[Column], Column]:
    return lambda c: F.coalesce(F.percentile(c, q), F.lit(0.0))


def aggregate(source: DataFrame, field: str, monoid: str | Callable[[Column], Column]) -> DataFrame:
    """One row: doc_id 0 with the fold."""
    fold = MONOIDS[monoid] if isinstance(monoid, str) else monoid
    return source.agg(fold(F.col(field)).cast("double").alias("aggregate")).select(F.lit(0).cast("long").alias("doc_id"), "aggregate")


def group_by(source: DataFrame, group: str, field: str, monoid: str | Callable[[Column], Column]) -> DataFrame:
    """Groups with the fold; null groups dropped."""
    fold = MONOIDS[monoid] if isinstance(monoid, str) else monoid
    return source.where(F.col(group).isNotNull()).groupBy(group).agg(fold(F.col(field)).cast("double").alias("aggregate"))


def facet(source: DataFrame, *fields: str) -> DataFrame:
    """Value counts, values as text, nulls left out; with several fields, one pass over exploded pairs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet_field"), F.col(f).cast("string").alias("facet_value")) for f in fields]))
    out = source.select(pairs.alias("f")).select("f.*").where("facet_value IS NOT NULL").groupBy("facet_field", "facet_value").agg(F.count("*").alias("facet_count"))
    return out if len(fields) > 1 else out.drop("facet_field")


# --- hierarchical --------------------------------------------------------------------------------------------------------------


def path_filter(source: DataFrame, path: str, predicate: Callable[[Column], Column], repeated: bool = False) -> DataFrame:
    """Documents whose value at the dotted path holds; of an array, any element."""
    c = F.col(path)
    return source.where(F.exists(c, predicate) if repeated else predicate(c))


def path_project(source: DataFrame, *paths: str) -> DataFrame:
    return source.select("doc_id", *[F.col(p).alias(p.replace(".", "_")) for p in paths])


def path_unnest(source: DataFrame, path: str, alias: str = "unnested_data") -> DataFrame:
    return source.select("*", F.explode_outer(path).alias(alias))


def path_aggregate(source: DataFrame, path: str, monoid: str) -> DataFrame:
    """The fold of the array at the path inside each document; the array stays in its row."""
    c = F.col(path)
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    n = F.size(F.filter(c, lambda x: x.isNotNull()))
    fold = {
        "count": n.cast("double"),
        "sum": total,
        "avg": F.when(n > 0, total / n).otherwise(0.0),
        "min": F.coalesce(F.array_min(c).cast("double"), F.lit(float("inf"))),
        "max": F.coalesce(F.array_max(c).cast("double"), F.lit(float("-inf"))),
    }[monoid]
    return source.select("doc_id", fold.alias("aggregate"))
