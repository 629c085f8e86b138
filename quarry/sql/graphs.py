"""Named graphs of a session, and the functions that read and change them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph.core import Graph
from ..operators.lineage import settle


def props_of(text: str | None) -> dict[str, str]:
    """'k=v,k=v' or a JSON object, values as text."""
    if not text:
        return {}
    if text.lstrip().startswith("{"):
        return {k: v if isinstance(v, str) else json.dumps(v) for k, v in json.loads(text).items()}
    return {k.strip(): v.strip() for k, _, v in (p.partition("=") for p in text.split(","))}


class Graphs:
    """Over the session's state, so that transactions restore graphs too."""

    def __init__(self, session):
        self.s = session

    def create(self, name: str) -> None:
        if name in self.s.state.graphs:
            raise ValueError(f"graph {name} exists")
        self.s.state.graphs[name] = Graph.empty(self.s.spark, name)

    def drop(self, name: str) -> None:
        if self.s.state.graphs.pop(name, None) is None:
            raise ValueError(f"no graph {name}")

    def _add(self, name: str, vertices: list[tuple] = (), edges: list[tuple] = ()) -> None:
        g = self.s.graph(name, create=True)
        v, e = g.vertices, g.edges
        if vertices:
            new = self.s.spark.createDataFrame(vertices, "id long, label string, props map<string,string>")
            v = v.join(new.select("id"), "id", "left_anti").select(*v.columns).unionByName(new, allowMissingColumns=True)
        if edges:
            new = self.s.spark.createDataFrame(edges, "id long, src long, dst long, label string, props map<string,string>")
            e = e.join(new.select("id"), "id", "left_anti").select(*e.columns).unionByName(new, allowMissingColumns=True)
        self.s.state.graphs[name] = Graph.of(settle(v), settle(e), name)

    def _said(self, what: str, value) -> DataFrame:
        return self.s.spark.createDataFrame([(value,)], f"{what} {'long' if isinstance(value, int) else 'string'}")

    def graph_add_vertex(self, id_: int, label: str, graph: str, props: str | None = None) -> DataFrame:
        self._add(graph, [(int(id_), label, props_of(props))])
        return self._said("graph_add_vertex", int(id_))

    def graph_add_edge(self, id_: int, src: int, dst: int, label: str, graph: str, props: str | None = None) -> DataFrame:
        self._add(graph, edges=[(int(id_), int(src), int(dst), label, props_of(props))])
        return self._said("graph_add_edge", int(id_))

    def _next(self, df: DataFrame) -> int:
        top = df.agg(F.max("id")).first()[0]
        return (top or 0) + 1

    def graph_create_node(self, graph: str, label: str, props: str | None = None) -> DataFrame:
        n = self._next(self.s.graph(graph, create=True).vertices)
        self._add(graph, [(n, label, props_of(props))])
        return self._said("id", n)

    def graph_create_edge(self, graph: str, label: str, src: int, dst: int, props: str | None = None) -> DataFrame:
        n = self._next(self.s.graph(graph, create=True).edges)
        self._add(graph, edges=[(n, int(src), int(dst), label, props_of(props))])
        return self._said("id", n)

    def graph_nodes(self, graph: str, label: str | None = None, wanted: str | None = None) -> DataFrame:
        v = self.s.graph(graph).vertices
        v = v.where(F.col("label") == label) if label else v
        for k, x in props_of(wanted).items():
            v = v.where(F.col("props")[k] == x)
        return v.select("id", "label", F.to_json("props").alias("properties"))

    def graph_edges(self, graph: str, kind: str | int | None = None, wanted: str | None = None, direction: str = "both") -> DataFrame:
        """(graph[, type][, filter]) or (graph, vertex[, type][, direction])."""
        e = self.s.graph(graph).edges
        if isinstance(kind, int):
            ends = {"out": F.col("src") == kind, "in": F.col("dst") == kind}
            e = e.where(ends.get(direction[:3].replace("outgoing", "out"), (F.col("src") == kind) | (F.col("dst") == kind)))
            e = e.where(F.col("label") == wanted) if wanted else e
        else:
            e = e.where(F.col("label") == kind) if kind else e
            for k, x in props_of(wanted).items():
                e = e.where(F.col("props")[k] == x)
        return e.select("id", "label", F.col("src").alias("source"), F.col("dst").alias("target"), F.to_json("props").alias("properties"))

    def graph_delete_node(self, graph: str, id_: int) -> DataFrame:
        g = self.s.graph(graph)
        self.s.state.graphs[graph] = Graph.of(settle(g.vertices.where(F.col("id") != int(id_))), settle(g.edges.where((F.col("src") != int(id_)) & (F.col("dst") != int(id_)))), graph)
        return self._said("deleted", int(id_))

    def graph_delete_edge(self, graph: str, id_: int) -> DataFrame:
        g = self.s.graph(graph)
        self.s.state.graphs[graph] = Graph.of(g.vertices, settle(g.edges.where(F.col("id") != int(id_))), graph)
        return self._said("deleted", int(id_))

    @staticmethod
    def _way(direction: str) -> str:
        return {"outgoing": "out", "incoming": "in"}.get(direction, direction)

    def graph_neighbors(self, graph: str, id_: int, kind: str | None = None, direction: str = "outgoing", depth: int = 1) -> DataFrame:
        return self.s.graph(graph).neighbors(int(id_), kind or None, self._way(direction), int(depth))

    def graph_traverse(self, graph: str, id_: int, kinds: str | list | None = None, direction: str = "outgoing", depth: int = 1, strategy: str = "bfs") -> DataFrame:
        labels = kinds.split(",") if isinstance(kinds, str) and kinds else kinds or None
        return self.s.graph(graph).neighbors(int(id_), labels, self._way(direction), int(depth))
