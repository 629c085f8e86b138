"""Graph indexes as written tables, and matches that use vectors.

An index is a table laid out by what it is asked for, so that a question reads its own part: labels and properties by partition or sorted
ranges, neighbourhoods as sorted steps, label paths as their pairs. ``save`` writes to a folder, ``load`` reads it back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vector
from ..operators.lineage import settle, stage
from .core import Graph
from .paths import E, V, match


class LabelIndex:
    """label -> vertex ids, a folder a label."""

    def __init__(self, g: Graph, path: str):
        g.vertices.select("label", "id").repartition("label").write.mode("overwrite").partitionBy("label").parquet(path)
        self.df = g.vertices.sparkSession.read.parquet(path)

    def ids(self, label: str) -> DataFrame:
        return self.df.where(F.col("label") == label).select("id")

    def labels(self) -> DataFrame:
        return self.df.groupBy("label").agg(F.count("*").alias("n"))


class PropertyIndex:
    """(key, value, number, id) of vertices or edges, a folder a key, sorted by value: equality and ranges prune by stored minima."""

    def __init__(self, elements: DataFrame, path: str):
        rows = elements.select("id", F.explode("props").alias("key", "value")).withColumn("number", F.expr("try_cast(value AS double)"))
        rows.repartitionByRange("key", "number", "value").sortWithinPartitions("key", "number", "value").write.mode("overwrite").partitionBy("key").parquet(path)
        self.df = elements.sparkSession.read.parquet(path)

    def equal(self, key: str, value) -> DataFrame:
        return self.df.where((F.col("key") == key) & (F.col("value") == str(value))).select("id")

    def between(self, key: str, low: float | None = None, high: float | None = None) -> DataFrame:
        ok: Column = (F.col("key") == key) & F.col("number").isNotNull()
        ok = ok & (F.col("number") >= low) if low is not None else ok
        return self.df.where(ok & (F.col("number") <= high) if high is not None else ok).select("id")


class NeighborhoodIndex:
    """What lies within some hops of a vertex. Held are the steps, each once, sorted by where they start: one question walks from its own vertex.

    The pairs of all vertices are quadratic where many share a neighbour, so nothing makes them but ``pairs``.
    """

    def __init__(self, g: Graph, hops: int = 2, labels: str | Sequence[str] | None = None, direction: str = "both"):
        self.hops, self.ids = hops, g.vertices.select("id")
        self.steps = stage(g.steps(labels, direction).select("at", "to").distinct().repartitionByRange("at").sortWithinPartitions("at"), "steps")

    def _walk(self, ids: DataFrame, hops: int) -> DataFrame:
        """(id, near, depth) of the given vertices, by rounds of joins."""
        front = seen = ids.select("id", F.col("id").alias("near"), F.lit(0).alias("depth"))
        for d in range(1, hops + 1):
            nxt = front.join(self.steps, F.col("near") == F.col("at")).select("id", F.col("to").alias("near")).distinct()
            front = settle(nxt.join(seen.select("id", "near"), ["id", "near"], "left_anti").withColumn("depth", F.lit(d)))
            seen = seen.unionByName(front)
        return seen.where("depth > 0")

    def pairs(self) -> DataFrame:
        """(id, near, depth) of all vertices."""
        return self._walk(self.ids, self.hops)

    def of(self, vertex: int, depth: int | None = None) -> DataFrame:
        return self._walk(self.ids.where(F.col("id") == vertex), self.hops if depth is None else min(depth, self.hops)).select("near", "depth")


class PathIndex:
    """(path, start_id, end_id): pairs that label sequences join, each of the given ones held."""

    def __init__(self, g: Graph, sequences: Sequence[Sequence[str]]):
        out = None
        for labels in sequences:
            pairs = None
            for label in labels:
                e = g.edges.where(F.col("label") == label).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
                pairs = e if pairs is None else pairs.withColumnRenamed("b", "m").join(e.withColumnRenamed("a", "m"), "m").select("a", "b").distinct()
            one = pairs.select(F.lit("/".join(labels)).alias("path"), F.col("a").alias("start_id"), F.col("b").alias("end_id"))
            out = one if out is None else out.unionByName(one)
        self.df = stage(out.repartition("path"), "paths")

    def pairs(self, labels: Sequence[str], start: int | None = None) -> DataFrame:
        own = self.df.where(F.col("path") == "/".join(labels))
        return (own if start is None else own.where(F.col("start_id") == start)).select("start_id", "end_id")


class SubgraphIndex:
    """Matches of patterns, each found once and then read."""

    def __init__(self, g: Graph):
        self.g, self.held = g, {}

    def matches(self, vertices: dict[str, V], edges: list[E]) -> DataFrame:
        key = repr((vertices, edges))
        if key not in self.held:
            self.held[key] = stage(match(self.g, vertices, edges), "matches")
        return self.held[key]


def vertex_embedding(g: Graph, vectors: DataFrame, query: Sequence[float], threshold: float) -> DataFrame:
    """(doc_id, score): vertices whose vector is within the threshold. vectors: (id, embedding)."""
    own = g.vertices.select("id").join(vectors, "id").select(F.col("id").alias("doc_id"), "embedding")
    return vector.within(own, query, threshold)


def vector_match(g: Graph, vertices: dict[str, V], edges: list[E], variable: str, vectors: DataFrame, query: Sequence[float], threshold: float = 0.0) -> DataFrame:
    """The pattern's matches whose variable's vector is within the threshold, with the similarity as score."""
    near = vector.similarities(vectors.select(F.col("id").alias("doc_id"), "embedding"), query).where(F.col("score") >= threshold)
    return match(g, vertices, edges).join(near.select(F.col("doc_id").alias(variable), "score"), variable)


def graph_relational_join(found: DataFrame, variable: str, g: Graph, prop: str, rows: DataFrame, column: str) -> DataFrame:
    """Matches joined with a table's rows where a variable's property equals a column."""
    own = g.vertices.select(F.col("id").alias(variable), F.col("props")[prop].alias("_value")).where(F.col("_value").isNotNull())
    return found.join(own, variable).join(rows, F.col("_value") == F.col(column).cast("string")).drop("_value")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
