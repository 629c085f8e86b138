"""Property graphs as two DataFrames: vertices(graph, id, label, props) and edges(graph, id, src, dst, label, props); props is a map of text.

Traversals are loops of joins over a frontier; each round's frontier and visited set are DataFrames, lineage is cut by checkpoints.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import settle

VERTEX = "graph string, id long, label string, props map<string,string>"
EDGE = "graph string, id long, src long, dst long, label string, props map<string,string>"


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame
    name: str = ""

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame, name: str = "") -> Graph:
        """From any columns: missing graph, label and props are filled in."""
        v, e = vertices, edges
        fills = {"graph": F.lit(name), "label": F.lit("vertex"), "props": F.create_map().cast("map<string,string>")}
        for c, d in fills.items():
            v = v if c in v.columns else v.withColumn(c, d)
            e = e if c in e.columns else e.withColumn(c, F.lit("edge") if c == "label" else d)
        if "id" not in e.columns:
            e = e.withColumn("id", F.xxhash64("src", "dst", "label"))
        return cls(v.select("graph", "id", "label", "props"), e.select("graph", "id", "src", "dst", "label", "props"), name)

    @classmethod
    def empty(cls, spark: SparkSession, name: str = "") -> Graph:
        return cls(spark.createDataFrame([], VERTEX), spark.createDataFrame([], EDGE), name)

    # --- algebra -----------------------------------------------------------------------------------------------------------------

    def union(self, other: Graph) -> Graph:
        return Graph(self.vertices.unionByName(other.vertices).dropDuplicates(["id"]), self.edges.unionByName(other.edges).dropDuplicates(["id"]), self.name)

    def intersect(self, other: Graph) -> Graph:
        v = self.vertices.join(other.vertices.select("id"), "id", "left_semi")
        e = self.edges.join(other.edges.select("id"), "id", "left_semi")
        return Graph(v.select("graph", "id", "label", "props"), e.select("graph", "id", "src", "dst", "label", "props"), self.name)

    def difference(self, other: Graph) -> Graph:
        """Without the other's vertices and edges, and without edges whose end is gone."""
        v = self.vertices.join(other.vertices.select("id"), "id", "left_anti")
        e = self.edges.join(other.edges.select("id"), "id", "left_anti")
        for end in ("src", "dst"):
            e = e.join(v.select(F.col("id").alias(end)), end, "left_semi")
        return Graph(v.select("graph", "id", "label", "props"), e.select("graph", "id", "src", "dst", "label", "props"), self.name)

    def copy(self, name: str) -> Graph:
        return Graph(self.vertices.withColumn("graph", F.lit(name)), self.edges.withColumn("graph", F.lit(name)), name)

    def subgraph(self, ids: DataFrame) -> Graph:
        v = self.vertices.join(ids.select("id"), "id", "left_semi")
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(ids.select(F.col("id").alias(end)), end, "left_semi")
        return Graph(v.select("graph", "id", "label", "props"), e.select("graph", "id", "src", "dst", "label", "props"), self.name)

    # --- steps -------------------------------------------------------------------------------------------------------------------

    def steps(self, labels: str | Sequence[str] | None = None, direction: str = "out", edge_filter: Callable[[DataFrame], Column] | None = None) -> DataFrame:
        """(at, to, edge, label): the edges as steps."""
        e = self.edges
        if labels:
            e = e.where(F.col("label").isin([labels] if isinstance(labels, str) else list(labels)))
        if edge_filter is not None:
            e = e.where(edge_filter(e))
        out = e.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("id").alias("edge"), "label")
        back = e.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.col("id").alias("edge"), "label")
        return out if direction in ("out", "outgoing") else back if direction in ("in", "incoming") else out.unionAll(back)

    def bfs(self, start: DataFrame | int, hops: int, labels: str | Sequence[str] | None = None, direction: str = "out", edge_filter: Callable[[DataFrame], Column] | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(id, depth): vertices within hops of the start, which is at depth 0; allowed: only these are entered or expanded."""
        steps = self.steps(labels, direction, edge_filter).select("at", "to")
        spark = self.edges.sparkSession
        first = spark.createDataFrame([(start,)], "id long") if isinstance(start, int) else start.select("id").distinct()
        if allowed is not None:
            steps = steps.join(allowed.select(F.col("id").alias("to")), "to", "left_semi")
            first = first.join(allowed.select("id"), "id", "left_semi")
        seen = first.withColumn("depth", F.lit(0))
        front = seen
        for d in range(1, hops + 1):
            nxt = front.join(steps, front["id"] == steps["at"]).select(F.col("to").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
            front = settle(nxt)
            if front.isEmpty():
                break
            seen = seen.unionAll(front)
        return seen

    def traverse(self, start: int, label: str | None = None, hops: int = 1, score: float = 1.0, **more) -> DataFrame:
        """Scored: score / (1 + depth); the start is in it."""
        return self.bfs(start, hops, label, **more).select(F.col("id").alias("doc_id"), (F.lit(score) / (1 + F.col("depth"))).alias("score"))

    def neighbors(self, start: int, labels: str | None = None, direction: str = "out", depth: int = 1) -> DataFrame:
        """(id, label, depth, path): the least path by vertex ids for each reached vertex; the start is left out."""
        steps = self.steps(labels, direction).select("at", "to")
        spark = self.edges.sparkSession
        front = spark.createDataFrame([(start, [start])], "id long, path array<long>")
        seen = front.withColumn("depth", F.lit(0))
        for d in range(1, depth + 1):
            nxt = front.join(steps, front["id"] == steps["at"]).select(F.col("to").alias("id"), F.concat("path", F.array("to")).alias("path")).groupBy("id").agg(F.min("path").alias("path"))
            front = settle(nxt.join(seen.select("id"), "id", "left_anti"))
            if front.isEmpty():
                break
            seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
        return seen.where("depth > 0").join(self.vertices.select("id", "label"), "id").select("id", "label", "depth", "path")


def temporal(at: float | None = None, between: tuple[float, float] | None = None) -> Callable[[DataFrame], Column]:
    """Edges valid at a time, or at some time of a range. valid_from / valid_to are inclusive; else timestamp; untimed edges are valid."""
    if (at is None) == (between is None):
        raise ValueError("either a time or a range")

    def holds(e: DataFrame) -> Column:
        p = lambda k: F.try_element_at(e["props"], F.lit(k)).cast("double")
        lo, hi, t = p("valid_from"), p("valid_to"), p("timestamp")
        ranged = lo.isNotNull() | hi.isNotNull()
        if at is not None:
            in_range = F.coalesce(lo <= at, F.lit(True)) & F.coalesce(hi >= at, F.lit(True))
            point = t <= at
        else:
            in_range = F.coalesce(lo <= between[1], F.lit(True)) & F.coalesce(hi >= between[0], F.lit(True))
            point = t.between(*between)
        return F.when(ranged, in_range).when(t.isNotNull(), point).otherwise(True)

    return holds


# --- centrality -------------------------------------------------------------------------------------------------------------------


def pagerank(g: Graph, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, cut_every: int = 5) -> DataFrame:
    """Scored. Dangling mass is spread evenly; parallel edges count.

    Two shuffles a round at most, of one number a vertex and one an edge; joins merge, so that no round sends a number a vertex to the driver.
    """
    ids = settle(g.vertices.select("id").distinct())
    n = ids.count()
    if not n:
        return ids.select(F.col("id").alias("doc_id"), F.lit(0.0).alias("score"))
    e = g.edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    deg = e.groupBy("src").agg(F.count("*").alias("deg"))
    links = settle(e.join(deg, "src").select("src", "dst", (1 / F.col("deg")).alias("w")))
    rank = settle(ids.join(deg.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("deg").isNull().alias("dangling"), F.lit(1.0 / n).alias("r")))
    for k in range(1, iterations + 1):
        loose = rank.agg(F.sum(F.when(F.col("dangling"), F.col("r")).otherwise(0.0))).first()[0] or 0.0
        came = links.join(rank.select(F.col("id").alias("src"), "r").hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("w")).alias("in"))
        new = rank.join(came.hint("merge"), "id", "left").select("id", "dangling", F.col("r").alias("old"), ((1 - damping) / n + damping * (F.coalesce("in", F.lit(0.0)) + loose / n)).alias("r"))
        new = settle(new)
        moved = new.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] or 0.0
        rank = new.drop("old")
        if moved < tolerance:
            break
    return rank.select(F.col("id").alias("doc_id"), F.col("r").alias("score"))


def hits(g: Graph, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(doc_id, score, hub, authority): the hub uses the new authority; both have length 1; score is their sum.

    The rounds join by merging: a broadcast of a number a vertex would send it to the driver in every round.
    """
    ids = settle(g.vertices.select("id").distinct())
    e = settle(g.edges.select("src", "dst"))
    now = settle(ids.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("auth")))
    for _ in range(iterations):
        a = e.join(now.select(F.col("id").alias("src"), "hub").hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a"))
        na = F.broadcast(a.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na")))
        a = settle(ids.join(a.hint("merge"), "id", "left").crossJoin(na).select("id", F.coalesce(F.col("a") / F.col("na"), F.lit(0.0)).alias("a")))
        h = e.join(a.select(F.col("id").alias("dst"), "a").hint("merge"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("h"))
        nh = F.broadcast(h.agg(F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("nh")))
        new = settle(now.join(a.hint("merge"), "id").join(h.hint("merge"), "id", "left").crossJoin(nh).select("id", F.coalesce(F.col("h") / F.col("nh"), F.lit(0.0)).alias("hub"), F.col("a").alias("auth"), (F.abs(F.coalesce(F.col("h") / F.col("nh"), F.lit(0.0)) - F.col("hub")) + F.abs(F.col("a") - F.col("auth"))).alias("moved")))
        moved = new.agg(F.sum("moved")).first()[0] or 0.0
        now = new.drop("moved")
        if moved < tolerance:
            break
    return now.select(F.col("id").alias("doc_id"), (F.col("hub") + F.col("auth")).alias("score"), "hub", F.col("auth").alias("authority"))


def betweenness(g: Graph, max_depth: int = 1000) -> DataFrame:
    """Scored: Brandes over the undirected view, halved. All sources advance together: rows are (source, vertex), joins over the edges."""
    ids = g.vertices.select("id").distinct()
    e = g.edges.where("src <> dst").select("src", "dst")
    nbr = settle(e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().select(F.col("src").alias("at"), F.col("dst").alias("to")))
    front = settle(ids.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("paths")))
    levels, seen = [front], front.select("s", "v")
    for d in range(1, max_depth):
        nxt = front.join(nbr, front["v"] == nbr["at"]).groupBy("s", F.col("to").alias("v")).agg(F.sum("paths").alias("paths")).join(seen, ["s", "v"], "left_anti").select("s", "v", F.lit(d).alias("d"), "paths")
        front = settle(nxt)
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionAll(front.select("s", "v"))
    total = None
    dep = None
    for level in reversed(levels):
        below = level.withColumn("delta", F.lit(0.0)) if dep is None else level.join(dep, ["s", "v"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        below = settle(below)
        part = below.where("s <> v").select("v", "delta")
        total = part if total is None else total.unionAll(part)
        # What each vertex of this level gives to its predecessors, one level up.
        k = levels.index(level)
        if k:
            up = levels[k - 1].select("s", F.col("v").alias("u"), F.col("paths").alias("up"))
            give = below.join(nbr, below["v"] == nbr["at"]).select("s", F.col("to").alias("u"), (((1 + F.col("delta")) / F.col("paths"))).alias("x"))
            dep = give.join(up, ["s", "u"]).groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("x") * F.col("up")).alias("delta"))
    sums = total.groupBy("v").agg((F.sum("delta") / 2).alias("score"))
    return ids.join(sums, F.col("id") == F.col("v"), "left").select(F.col("id").alias("doc_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


# --- messages and embeddings ---------------------------------------------------------------------------------------------------------


def message_passing(g: Graph, rounds: int = 2, agg: str = "mean", prop: str | None = None) -> DataFrame:
    """Scored: h becomes h + the neighbours' aggregate, both directions, then the sigmoid; h starts as a property or 1."""
    start = F.coalesce(F.try_element_at("props", F.lit(prop)).cast("double"), F.lit(0.0)) if prop else F.lit(1.0)
    h = g.vertices.select("id", start.alias("h"))
    steps = g.steps(direction="both").select("at", "to")
    fn = {"mean": F.avg, "sum": F.sum, "max": F.max}[agg]
    for _ in range(rounds):
        came = steps.join(h.select(F.col("id").alias("to"), "h"), "to").groupBy(F.col("at").alias("id")).agg(fn("h").alias("m"))
        h = settle(h.join(came, "id", "left").select("id", (F.col("h") + F.coalesce("m", F.lit(0.0))).alias("h")))
    return h.select(F.col("id").alias("doc_id"), (1 / (1 + F.exp(-F.col("h")))).alias("score"))


def embedding(g: Graph, hops: int = 2) -> DataFrame:
    """(doc_id, score, embedding): degree share, neighbours' label shares in label order, and k-hop neighbour counts; score is the length."""
    steps = settle(g.steps(direction="both").select("at", "to"))
    ids = g.vertices.select("id", "label")
    labels = [r.label for r in ids.select("label").distinct().orderBy("label").collect()]  # vertex kinds, a schema's worth
    deg = steps.groupBy(F.col("at").alias("id")).agg(F.count("*").alias("deg"))
    most = F.broadcast(deg.agg(F.max("deg").alias("most")))
    hist = steps.join(ids.select(F.col("id").alias("to"), "label"), "to").groupBy(F.col("at").alias("id")).agg(*[(F.count(F.when(F.col("label") == x, 1)) / F.count("*")).alias(f"l{k}") for k, x in enumerate(labels)])
    out = ids.join(deg, "id", "left").crossJoin(most).join(hist, "id", "left")
    reach = steps.select(F.col("at").alias("id"), "to").distinct()
    for k in range(1, hops + 1):
        if k > 1:
            reach = settle(reach.select("id", F.col("to").alias("mid")).join(steps, F.col("mid") == F.col("at")).select("id", "to").unionAll(reach).distinct())
        n = reach.where("id <> to").groupBy("id").agg(F.count("*").alias(f"k{k}"))
        out = out.join(n, "id", "left")
    parts = [F.coalesce(F.col("deg") / F.col("most"), F.lit(0.0)), *[F.coalesce(f"l{k}", F.lit(0.0)) for k in range(len(labels))], *[F.coalesce(f"k{k}", F.lit(0)).cast("double") for k in range(1, hops + 1)]]
    vec = F.array(*parts)
    return out.select(F.col("id").alias("doc_id"), F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x)).alias("score"), vec.alias("embedding"))


def vertex_aggregate(source: DataFrame, g: Graph, prop: str, fn: str = "avg") -> DataFrame:
    """The fold of a property over the source's vertices, as every one's score."""
    own = source.select("doc_id").join(g.vertices.select(F.col("id").alias("doc_id"), F.try_element_at("props", F.lit(prop)).cast("double").alias("x")), "doc_id", "left")
    total = own.agg(F.coalesce({"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[fn]("x").cast("double"), F.lit(0.0)).alias("score"))
    return source.select("doc_id").crossJoin(F.broadcast(total))


# --- between paradigms ---------------------------------------------------------------------------------------------------------------


def to_graph(docs: DataFrame, name: str, label: Column | str, props: Sequence[str] = ()) -> DataFrame:
    lab = F.lit(label) if isinstance(label, str) else label
    pairs = [x for p in props for x in (F.lit(p), F.col(p).cast("string"))]
    return docs.select(F.lit(name).alias("graph"), F.col("doc_id").alias("id"), lab.alias("label"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("props"))


def from_graph(g: Graph) -> DataFrame:
    return g.vertices.select(F.col("id").alias("doc_id"), "label", "props")


def text_to_graph(docs: DataFrame, tokens: str = "tokens", window: int = 2) -> Graph:
    """Token vertices; an edge co_occurs between tokens at most window places apart in a document, with the least distance."""
    t = docs.select("doc_id", F.posexplode(tokens).alias("i", "a"))
    pair = docs.select("doc_id", F.posexplode(tokens).alias("i", "a"), F.col(tokens).alias("own"))
    near = pair.select("a", F.posexplode(F.slice("own", F.col("i") + 2, window)).alias("k", "b")).where("a <> b")
    e = near.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.col("k") + 1).alias("distance"))
    v = t.select("a").distinct().select(F.xxhash64("a").alias("id"), F.lit("token").alias("label"), F.create_map(F.lit("token"), F.col("a")).alias("props"))
    edges = e.select(F.xxhash64("x").alias("src"), F.xxhash64("y").alias("dst"), F.lit("co_occurs").alias("label"), F.create_map(F.lit("distance"), F.col("distance").cast("string")).alias("props"))
    return Graph.of(v, edges)


def semantic_search(g: Graph, start: int, hops: int, vectors: DataFrame, query: Sequence[float], threshold: float) -> DataFrame:
    """Reached vertices with cosine >= threshold; others are still expanded."""
    from ..operators.vector import within

    return g.bfs(start, hops).select(F.col("id").alias("doc_id")).join(within(vectors, query, threshold), "doc_id")


def graph_join(left: DataFrame, g: Graph, right: DataFrame, label: str | None = None) -> DataFrame:
    """left documents, their out-edges, right documents: (left_id, right_id, score)."""
    s = g.steps(label).select("at", "to")
    a = left.select(F.col("doc_id").alias("at"), F.col("score").alias("ls"))
    b = right.select(F.col("doc_id").alias("to"), F.col("score").alias("rs"))
    return a.join(s, "at").join(b, "to").select(F.col("at").alias("left_id"), F.col("to").alias("right_id"), (F.col("ls") + F.col("rs")).alias("score"))


def cross_paradigm_join(g: Graph, prop: str, docs: DataFrame, field: str) -> DataFrame:
    """Vertices whose property equals a document's field: (vertex_id, doc_id)."""
    v = g.vertices.select(F.col("id").alias("vertex_id"), F.try_element_at("props", F.lit(prop)).alias("k"))
    return v.join(docs.select("doc_id", F.col(field).cast("string").alias("k")), "k").select("vertex_id", "doc_id")


def graph_graph_join(left: DataFrame, right: DataFrame, variable: str) -> DataFrame:
    """Matches of two patterns that bind the variable alike."""
    keep = [c for c in right.columns if c != variable and c not in left.columns]
    return left.join(right.select(variable, *keep), variable)


# --- deltas and versions ----------------------------------------------------------------------------------------------------------------


@dataclass
class Delta:
    """Vertices and edges to add, ids to remove."""

    add_vertices: DataFrame | None = None
    add_edges: DataFrame | None = None
    drop_vertices: DataFrame | None = None
    drop_edges: DataFrame | None = None

    def apply(self, g: Graph) -> Graph:
        v, e = g.vertices, g.edges
        if self.drop_edges is not None:
            e = e.join(self.drop_edges.select("id"), "id", "left_anti")
        if self.drop_vertices is not None:
            gone = self.drop_vertices.select("id")
            v = v.join(gone, "id", "left_anti")
            for end in ("src", "dst"):
                e = e.join(gone.withColumnRenamed("id", end), end, "left_anti")
        if self.add_vertices is not None:
            v = v.join(self.add_vertices.select("id"), "id", "left_anti").unionByName(self.add_vertices)
        if self.add_edges is not None:
            e = e.join(self.add_edges.select("id"), "id", "left_anti").unionByName(self.add_edges)
        return Graph(v.select("graph", "id", "label", "props"), e.select("graph", "id", "src", "dst", "label", "props"), g.name)

    def inverse(self, g: Graph) -> Delta:
        """What undoes this delta on g: removed rows come back with their own values, with edges that fell with a vertex."""
        after = self.apply(g)
        back_v = g.vertices.join(after.vertices.select("id"), "id", "left_anti").select("graph", "id", "label", "props")
        back_e = g.edges.join(after.edges.select("id"), "id", "left_anti").select("graph", "id", "src", "dst", "label", "props")
        new_v = after.vertices.join(g.vertices.select("id"), "id", "left_anti")
        new_e = after.edges.join(g.edges.select("id"), "id", "left_anti")
        return Delta(back_v, back_e, new_v.select("id"), new_e.select("id"))


class Versions:
    """A graph's history: each version is an immutable pair of DataFrames."""

    def __init__(self, g: Graph):
        self.log = [g]

    @property
    def version(self) -> int:
        return len(self.log) - 1

    @property
    def graph(self) -> Graph:
        return self.log[-1]

    def apply(self, delta: Delta) -> int:
        self.log.append(delta.apply(self.graph))
        return self.version

    def rollback(self, version: int) -> Graph:
        if not 0 <= version <= self.version:
            raise ValueError(f"there is no version {version}")
        del self.log[version + 1 :]
        return self.graph


def grid_graph(spark: SparkSession, rows: int, cols: int, label: str = "adjacent") -> Graph:
    """Each cell, from 1 by rows, has edges to the right and downward."""
    n = rows * cols
    v = spark.range(1, n + 1).select("id", F.lit("cell").alias("label"))
    right = v.where((F.col("id") % cols) != 0).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = v.where(F.col("id") + cols <= n).select(F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    return Graph.of(v, right.unionAll(down).withColumn("label", F.lit(label)))
