"""Layered fusion over a graph, and a small image learner with an analytic head.

A state is (doc_id, ch): a channel vector a document. Layers map states to states: signals add log odds, edges propagate or convolve them,
dense layers, norms and pools work on channels. All but ``pool`` and ``attention`` are joins, aggregates and higher-order functions
inside Catalyst. ``pool`` is greedy in ascending ids and so runs per connected component, in a task each. ``attention`` compares all
documents with all: blocks of queries meet blocks of keys, each pair giving partial sums that are then combined, so no task holds
more than two blocks.

``deep_learn`` makes features of embeddings by fixed kernels and pools, sums their Gram matrix and class sums over the rows in tasks (one
matrix leaves each), and solves a ridge or elastic-net head; ``deep_predict`` gives class probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph.core import Graph
from . import fusion
from .lineage import settle

FLOOR, CEIL = 1e-10, 1 - 1e-10
BLOCK = 512


@dataclass(frozen=True)
class Layer:
    kind: str
    args: dict = field(default_factory=dict)


def layer(*signals: DataFrame) -> Layer:
    return Layer("signals", {"signals": signals})


def propagate(label: str | None, how: str = "mean", direction: str = "both") -> Layer:
    return Layer("propagate", {"label": label, "how": how, "direction": direction})


def convolve(label: str | None, weights: Sequence[float], direction: str = "both") -> Layer:
    return Layer("convolve", {"label": label, "weights": list(weights), "direction": direction})


def pool(label: str | None, how: str = "max", size: int = 2, direction: str = "both") -> Layer:
    return Layer("pool", {"label": label, "how": how, "size": size, "direction": direction})


def dense(weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Layer:
    return Layer("dense", {"weights": [list(w) for w in weights], "bias": list(bias)})


def flatten() -> Layer:
    return Layer("flatten")


def global_pool(how: str = "avg") -> Layer:
    return Layer("global_pool", {"how": how})


def softmax() -> Layer:
    return Layer("softmax")


def batch_norm(eps: float = 1e-5) -> Layer:
    return Layer("batch_norm", {"eps": eps})


def dropout(p: float) -> Layer:
    return Layer("dropout", {"p": p})


def attention(heads: int = 1, q=None, k=None, v=None) -> Layer:
    """Content attention; with matrices (dim x dim, rows in) for random_qk or learned_v."""
    return Layer("attention", {"heads": heads, "q": q, "k": k, "v": v})


def embed(vector: Sequence[float]) -> Layer:
    return Layer("embed", {"vector": list(vector)})


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(FLOOR)), F.lit(CEIL))
    return F.ln(c / (1 - c))


def _first(ch: Column, value: Column) -> Column:
    """ch with its first channel replaced."""
    return F.concat(F.array(value), F.slice(ch, 2, F.greatest(F.size(ch) - 1, F.lit(0))))


class Fusion:
    """Runs layers; gating applies where the layers say so, alpha where several signals meet."""

    def __init__(self, g: Graph | None = None, alpha: float = 0.5, gating: str = "none"):
        self.g, self.alpha, self.gating = g, alpha, gating
        self.values = False  # embeddings are plain values, not log odds

    def gate(self, c: Column) -> Column:
        return fusion.gate(c, self.gating)

    def run(self, layers: Sequence[Layer]) -> DataFrame:
        """(doc_id, ch, score): score is the first channel's probability, or the largest one after a softmax."""
        state: DataFrame | None = None
        last = ""
        for l_ in layers:
            state = getattr(self, l_.kind)(state, **l_.args)
            last = l_.kind if l_.kind != "dropout" else last
        score = F.array_max("ch") if last == "softmax" else sigmoid(F.get("ch", F.lit(0)))
        return state.select("doc_id", "ch", score.alias("score"))

    def signals(self, state: DataFrame | None, signals: Sequence[DataFrame]) -> DataFrame:
        wide = fusion.wide(signals)
        ps = [F.col(c) for c in wide.columns if c != "doc_id"]
        fused = ps[0] if len(ps) == 1 else fusion.log_odds_column(ps, self.alpha)
        new = wide.select("doc_id", self.gate(logit(fused)).alias("add"))
        if state is None:
            return new.select("doc_id", F.array("add").alias("ch"))
        both = state.join(new, "doc_id", "full")
        size = F.size(F.coalesce("ch", F.array(F.lit(0.0))))
        ch = F.coalesce(F.col("ch"), F.array_repeat(F.lit(0.0), size))
        return both.select("doc_id", _first(ch, ch[0] + F.coalesce("add", F.lit(0.0))).alias("ch"))

    def pairs(self, label: str | None, direction: str) -> DataFrame:
        if self.g is None:
            raise ValueError("this layer needs a graph")
        return self.g.steps(label, direction).select("at", "to").distinct()

    def propagate(self, state: DataFrame, label: str | None, how: str, direction: str) -> DataFrame:
        p = self.pairs(label, direction)
        have = settle(state)
        near = have.select(F.col("doc_id").alias("at")).join(p, "at").select(F.col("to").alias("id"))
        reached = have.select(F.col("doc_id").alias("id")).unionByName(near).distinct()
        heard = p.join(have.select(F.col("doc_id").alias("to"), sigmoid(F.col("ch")[0]).alias("p")), "to").join(reached, F.col("at") == F.col("id"), "left_semi")
        total = {"mean": F.avg("p"), "sum": F.least(F.sum("p"), F.lit(CEIL)), "max": F.max("p")}[how]
        got = heard.groupBy(F.col("at").alias("doc_id")).agg(self.gate(logit(total)).alias("add"))
        both = have.join(got, "doc_id", "full")
        zero = F.transform(F.sequence(F.lit(1), F.lit(1)), lambda _: F.lit(0.0))
        ch = F.coalesce(F.col("ch"), zero)
        return both.select("doc_id", _first(ch, ch[0] + F.coalesce("add", F.lit(0.0))).alias("ch"))

    def convolve(self, state: DataFrame, label: str | None, weights: list[float], direction: str) -> DataFrame:
        total = sum(weights)
        if total <= 0:
            return state
        p, have = self.pairs(label, direction), settle(state)
        value = F.col("ch")[0] if self.values else sigmoid(F.col("ch")[0])
        vals = have.select(F.col("doc_id").alias("to"), value.alias("v"))
        ring = have.select(F.col("doc_id").alias("root"), F.col("doc_id").alias("at"))
        seen, out = ring, None
        for w in weights[1:]:
            step = ring.join(p, "at").select("root", F.col("to").alias("at")).distinct()
            ring = settle(step.join(seen, ["root", "at"], "left_anti"))
            seen = seen.unionByName(ring)
            mean = ring.join(vals, F.col("at") == F.col("to")).groupBy("root").agg((F.avg("v") * (w / total)).alias("part"))
            out = mean if out is None else out.unionByName(mean)
        joined = have
        if out is not None:
            joined = have.join(out.groupBy("root").agg(F.sum("part").alias("more")), F.col("doc_id") == F.col("root"), "left")
        else:
            joined = have.withColumn("more", F.lit(0.0))
        x = value * (weights[0] / total) + F.coalesce("more", F.lit(0.0))
        new = self.gate(x) if self.values else F.col("ch")[0] + self.gate(logit(x))
        return joined.select("doc_id", _first(F.col("ch"), new).alias("ch"))

    def pool(self, state: DataFrame, label: str | None, how: str, size: int, direction: str) -> DataFrame:
        p, have = self.pairs(label, direction), settle(state)
        # Components over both ways: what a greedy search can reach never leaves one.
        nodes = p.select(F.col("at").alias("id")).union(p.select("to")).union(have.select("doc_id")).distinct()
        both = p.union(p.select("to", "at")).distinct()
        comp = settle(nodes.select("id", F.col("id").alias("root")))
        while True:
            least = both.join(comp, F.col("to") == F.col("id")).groupBy("at").agg(F.min("root").alias("near"))
            new = settle(comp.join(least, F.col("id") == F.col("at"), "left").select("id", F.least("root", F.coalesce("near", "root")).alias("root")))
            if new.join(comp.select("id", F.col("root").alias("was")), "id").where("root <> was").isEmpty():
                break
            comp = new
        rows = comp.join(have, F.col("id") == F.col("doc_id"), "left").join(p.groupBy(F.col("at").alias("from")).agg(F.array_sort(F.collect_list("to")).alias("near")), F.col("id") == F.col("from"), "left")

        def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
            near = {i: (list(n) if n is not None else []) for i, n in zip(pdf["id"], pdf["near"], strict=True)}
            ch = {i: np.array(c, dtype=float) for i, c in zip(pdf["id"], pdf["ch"], strict=True) if c is not None}
            left, out = set(ch), []
            for seed in sorted(ch):
                if seed not in left:
                    continue
                left.discard(seed)
                group, front, seen = [seed], [seed], {seed}
                while len(group) < size and front:
                    nxt = []
                    for f in front:
                        for n in near.get(f, []):
                            if n not in seen:
                                seen.add(n)
                                nxt.append(n)
                                if n in left:
                                    group.append(n)
                                    left.discard(n)
                                    if len(group) >= size:
                                        break
                        if len(group) >= size:
                            break
                    front = nxt
                stack = np.stack([ch[i] for i in group])
                out.append((min(group), (stack.max(axis=0) if how == "max" else stack.mean(axis=0)).tolist()))
            return pd.DataFrame(out, columns=["doc_id", "ch"])

        return rows.select("root", "id", "ch", "near").groupBy("root").applyInPandas(greedy, "doc_id long, ch array<double>")

    def dense(self, state: DataFrame, weights: list[list[float]], bias: list[float]) -> DataFrame:
        w = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in weights])
        b = F.array(*[F.lit(float(x)) for x in bias])
        dot = lambda row: F.aggregate(F.zip_with(F.col("ch"), row, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return state.select("doc_id", F.zip_with(F.transform(w, dot), b, lambda x, y: self.gate(x + y)).alias("ch"))

    def flatten(self, state: DataFrame) -> DataFrame:
        """One vector of all documents in order of id: a row by its meaning."""
        one = state.agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("doc_id", "ch"))).alias("all"))
        return one.where(F.col("doc_id").isNotNull()).select("doc_id", F.flatten(F.col("all.ch")).alias("ch"))

    def channels(self, state: DataFrame, *aggs: Column) -> DataFrame:
        """One row (first, n, k arrays): aggregates of v a channel, in order."""
        rows = state.select("doc_id", F.posexplode("ch").alias("c", "v")).groupBy("c").agg(F.min("doc_id").alias("first"), *aggs)
        names = [c for c in rows.columns if c not in ("c", "first")]
        listed = rows.agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("c", *names))).alias("all"))
        return listed.where(F.col("first").isNotNull()).select("first", *[F.col(f"all.{n}").alias(n) for n in names])

    def global_pool(self, state: DataFrame, how: str) -> DataFrame:
        one = self.channels(state, F.avg("v").alias("mean"), F.max("v").alias("most"))
        ch = {"avg": F.col("mean"), "max": F.col("most"), "avg_max": F.concat("mean", "most")}[how]
        return one.select(F.col("first").alias("doc_id"), ch.alias("ch"))

    def softmax(self, state: DataFrame) -> DataFrame:
        e = F.transform("ch", lambda x: F.exp(x - F.array_max("ch")))
        return state.select("doc_id", F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)).alias("ch"))

    def batch_norm(self, state: DataFrame, eps: float) -> DataFrame:
        have = settle(state)
        one = F.broadcast(self.channels(have, F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.count("*").alias("n")))  # one row
        scaled = F.transform("ch", lambda x, k: (x - F.get("mean", k)) / F.sqrt(F.get("var", k) + eps))
        return have.crossJoin(one).select("doc_id", F.when(F.get("n", F.lit(0)) < 2, F.col("ch")).otherwise(scaled).alias("ch"))

    def dropout(self, state: DataFrame, p: float) -> DataFrame:
        return state.select("doc_id", F.transform("ch", lambda x: x * (1 - p)).alias("ch"))

    def embed(self, state: DataFrame | None, vector: list[float]) -> DataFrame:
        self.values = True
        spark = (self.g.vertices if self.g else state).sparkSession
        new = spark.createDataFrame([(k, [float(x)]) for k, x in enumerate(vector, 1)], "doc_id long, ch array<double>")
        return new if state is None else state.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)

    def attention(self, state: DataFrame, heads: int, q, k, v) -> DataFrame:
        have = settle(state)
        mats = [None if m is None else np.asarray(m, dtype=float) for m in (q, k, v)]
        # Any cut will do: blocks only bound what meets.
        held = settle(have.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 + have.count() // BLOCK)).alias("b")).agg(F.collect_list(F.struct("doc_id", "ch")).alias("rows")))
        met = held.select(F.col("rows").alias("asks")).crossJoin(held.select(F.col("rows").alias("keys")))

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for asks, keys in zip(b["asks"], b["keys"], strict=True):
                    ids = [r["doc_id"] for r in asks]
                    a, x = np.array([r["ch"] for r in asks], dtype=float), np.array([r["ch"] for r in keys], dtype=float)
                    qs, ks, vs = (y if m is None else y @ m for y, m in zip((a, x, x), mats, strict=True))
                    n = a.shape[1]
                    h = heads if n % heads == 0 else 1
                    d = n // h
                    most, mass, out = [], [], []
                    for j in range(h):
                        part = slice(j * d, (j + 1) * d)
                        s = qs[:, part] @ ks[:, part].T / math.sqrt(d)
                        m = s.max(axis=1)
                        e = np.exp(s - m[:, None])
                        most.append(m)
                        mass.append(e.sum(axis=1))
                        out.append(e @ vs[:, part])
                    yield pd.DataFrame({"doc_id": ids, "most": np.stack(most, 1).tolist(), "mass": np.stack(mass, 1).tolist(), "out": np.concatenate(out, 1).tolist()})

        parts = met.mapInPandas(partial, "doc_id long, most array<double>, mass array<double>, out array<double>")

        def combine(pdf: pd.DataFrame) -> pd.DataFrame:
            most, mass, out = (np.array(pdf[c].tolist()) for c in ("most", "mass", "out"))
            scale = np.exp(most - most.max(axis=0))
            total = (scale * mass).sum(axis=0)
            width = out.shape[1] // most.shape[1]
            mixed = (np.repeat(scale, width, axis=1) * out).sum(axis=0) / np.repeat(total, width)
            return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "ch": [mixed.tolist()]})

        done = parts.groupBy("doc_id").applyInPandas(combine, "doc_id long, ch array<double>")
        return done.select("doc_id", F.transform("ch", self.gate).alias("ch"))


def deep_fusion(layers: Sequence[Layer], g: Graph | None = None, alpha: float = 0.5, gating: str = "none") -> DataFrame:
    return Fusion(g, alpha, gating).run(layers)


# --- solvers and kernels --------------------------------------------------------------------------------------------------------------


def ridge(gram: np.ndarray, cross: np.ndarray, lam: float) -> np.ndarray:
    """(X'X + lam I)^-1 X'Y, exactly."""
    return np.linalg.solve(gram + lam * np.eye(len(gram)), cross)


def elastic_net(gram: np.ndarray, cross: np.ndarray, n: int, l1: float, l2: float, steps: int = 200, tolerance: float = 1e-4) -> np.ndarray:
    """Proximal gradient on the mean squared error from the ridge solution."""
    w = ridge(gram, cross, max(l2, 1e-9) * n)
    rate = 1 / (np.linalg.eigvalsh(gram)[-1] / n + l2 + 1e-12)
    for _ in range(steps):
        moved = w - rate * ((gram @ w - cross) / n + l2 * w)
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * l1, 0)
        if np.abs(new - w).max() < tolerance:
            return new
        w = new
    return w


def prune(w: np.ndarray, ratio: float) -> np.ndarray:
    """Weights below the ratio-quantile of their sizes become zero."""
    return np.where(np.abs(w) < np.quantile(np.abs(w), ratio), 0.0, w) if ratio > 0 else w


def kernels(kind: str, count: int, channels: int, size: int = 3, seed: int = 42, patches: np.ndarray | None = None) -> np.ndarray:
    """(count, channels, size, size): kaiming, orthogonal, gabor, or kmeans over given patches."""
    r, flat = np.random.default_rng(seed), channels * size * size
    if kind == "kaiming":
        return r.normal(0, math.sqrt(2 / flat), (count, channels, size, size))
    if kind == "orthogonal":
        parts = []
        while sum(map(len, parts)) < count:
            q, _ = np.linalg.qr(r.normal(size=(flat, flat)))
            parts.append(q.T)
        return np.concatenate(parts)[:count].reshape(count, channels, size, size)
    if kind == "gabor":
        y, x = np.mgrid[: size, : size] - (size - 1) / 2
        out = []
        for k in range(count):
            a = math.pi * k / count
            u = x * math.cos(a) + y * math.sin(a)
            g = np.exp(-(x**2 + y**2) / (2 * (size / 3) ** 2)) * np.cos(2 * math.pi * u / (size / 1.5) + (k % 2) * math.pi / 2)
            out.append(np.repeat((g - g.mean())[None], channels, axis=0))
        return np.array(out)
    if kind == "kmeans":
        p = patches.reshape(len(patches), -1)
        p = p - p.mean(axis=1, keepdims=True)
        c = p[r.choice(len(p), count, replace=len(p) < count)]
        for _ in range(10):
            near = np.argmax(p @ c.T, axis=1)
            c = np.array([p[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(count)])
            c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-9
        return c.reshape(count, channels, size, size)
    raise ValueError(kind)


def grid_forward(x: np.ndarray, stages: Sequence[tuple[np.ndarray, int]]) -> np.ndarray:
    """x: (rows, channels, height, width). Each stage convolves with its kernels (same size), takes the positive part and averages blocks."""
    for k, block in stages:
        pad = k.shape[-1] // 2
        padded = np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, k.shape[-2:], axis=(2, 3))
        x = np.maximum(np.einsum("nchwij,kcij->nkhw", windows, k, optimize=True), 0)
        h, w = x.shape[2] // block * block, x.shape[3] // block * block
        if block > 1 and h and w:
            x = x[:, :, :h, :w].reshape(len(x), x.shape[1], h // block, block, w // block, block).mean(axis=(3, 5))
    return x.reshape(len(x), -1)


def grid_shape(dim: int) -> tuple[int, int, int]:
    """(channels, height, width) of a vector: a square of 1, 3 or 4 channels, else a row."""
    for c in (1, 3, 4):
        side = math.isqrt(dim // c)
        if side * side * c == dim:
            return c, side, side
    return 1, 1, dim


@dataclass
class DeepModel:
    classes: list
    shape: tuple[int, int, int]
    stages: list[tuple[np.ndarray, int]]
    weights: np.ndarray
    mean: np.ndarray
    bias: np.ndarray
    accuracy: float = 0.0

    def features(self, x: np.ndarray) -> np.ndarray:
        return grid_forward(x.reshape(len(x), *self.shape), self.stages)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (self.features(x) - self.mean) @ self.weights + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.scores(x) * 4.0
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def deep_learn(rows: DataFrame, stages: Sequence[tuple[str, int, int]] = (("orthogonal", 16, 2),), lam: float = 1.0, l1: float = 0.0, prune_ratio: float = 0.0, seed: int = 42, vector: str = "embedding", label: str = "label") -> DeepModel:
    """stages: (kernel kind, kernels, block). One pass over the rows for the moments; what leaves it is one matrix of features by features."""
    labels = [r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(10_001).collect()]
    if len(labels) > 10_000:
        raise ValueError("more than 10,000 classes")
    first = rows.select(F.size(vector).alias("n")).where(F.col(vector).isNotNull()).first()
    shape = grid_shape(first.n)
    built, channels = [], shape[0]
    for k, (kind, count, block) in enumerate(stages):
        patches = None
        if kind == "kmeans":
            some = np.array([r[0] for r in rows.select(vector).orderBy(F.xxhash64(vector)).limit(256).collect()], dtype=float)  # a bounded sample of patches
            x = grid_forward(some.reshape(len(some), *shape), built).reshape(len(some), channels, -1)
            side = math.isqrt(x.shape[2])
            grid = x[:, :, : side * side].reshape(len(some), channels, side, side)
            patches = np.lib.stride_tricks.sliding_window_view(grid, (3, 3), axis=(2, 3)).transpose(0, 2, 3, 1, 4, 5).reshape(-1, channels, 3, 3)
        built.append((kernels(kind, count, channels, seed=seed + k, patches=patches), block))
        channels = count
    model = DeepModel(labels, shape, built, np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    place = {c: k for k, c in enumerate(labels)}

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = cross = total = None
        count = np.zeros(len(labels))
        for b in batches:
            b = b[b["v"].notna() & b["y"].notna()]
            if not len(b):
                continue
            x = model.features(np.array(b["v"].tolist(), dtype=float))
            y = np.eye(len(labels))[[place[v] for v in b["y"]]]
            parts = (x.T @ x, x.T @ y, x.sum(axis=0))
            gram, cross, total = parts if gram is None else (gram + parts[0], cross + parts[1], total + parts[2])
            count += y.sum(axis=0)
        if gram is not None:
            yield pd.DataFrame({"gram": [gram.ravel().tolist()], "cross": [cross.ravel().tolist()], "total": [total.tolist()], "count": [count.tolist()]})

    ddl = "gram array<double>, cross array<double>, total array<double>, count array<double>"

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            for r in b.itertuples(index=False):
                now = [np.asarray(v) for v in r]
                held = now if held is None else [a + c for a, c in zip(held, now, strict=True)]
        if held is not None:
            yield pd.DataFrame({n: [v.tolist()] for n, v in zip(("gram", "cross", "total", "count"), held, strict=True)})

    slim = rows.select(F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("y"))
    (row,) = slim.mapInPandas(moments, ddl).repartition(1).mapInPandas(summed, ddl).collect()
    count, total = np.array(row["count"]), np.array(row["total"])
    n, d = count.sum(), len(total)
    mean, share = total / n, count / n
    gram = np.array(row["gram"]).reshape(d, d) - n * np.outer(mean, mean)
    cross = np.array(row["cross"]).reshape(d, len(labels)) - n * np.outer(mean, share)
    w = elastic_net(gram, cross, int(n), l1, lam / n) if l1 else ridge(gram, cross, lam)
    model.weights, model.mean, model.bias = prune(w, prune_ratio), mean, share
    said = deep_predict(rows.where(F.col(label).isNotNull()), model, vector, label)
    model.accuracy = said.agg(F.avg((F.col("predicted") == F.col(label).cast("string")).cast("double"))).first()[0]
    return model


def deep_predict(rows: DataFrame, model: DeepModel, vector: str = "embedding", *keep: str) -> DataFrame:
    """(keep..., predicted, probabilities); predicted is the class as text."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields) + (", " if keep else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = model.probabilities(np.array(b["__v"].tolist(), dtype=float)) if len(b) else np.zeros((0, len(model.classes)))
            out = b[list(keep)].copy()
            out["predicted"] = [str(model.classes[k]) for k in p.argmax(axis=1)] if len(b) else []
            out["probabilities"] = p.tolist()
            yield out

    return rows.where(F.col(vector).isNotNull()).select(*keep, F.col(vector).cast("array<double>").alias("__v")).mapInPandas(run, f"{ddl}predicted string, probabilities array<double>")


def model_layers(model: DeepModel) -> list[Layer]:
    """A trained head as layers of a fusion: dense over the features, then a softmax."""
    return [dense(model.weights.T.tolist(), (model.bias - model.mean @ model.weights).tolist()), softmax()]
