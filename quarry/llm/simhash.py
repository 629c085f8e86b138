"""SimHash near-dedup over a Gray-order hierarchical index.

A text's words (A-Z lower-cased) give shingles of three words, repeats included; each is hashed by XXH64 and a fingerprint bit is
set if more than half of the hashes have it. Fingerprints that differ in at most two bits are linked, and a document's component
is the smallest doc_id that it reaches.

Links are searched over distinct fingerprints only. Two that differ in at most two bits agree in one of three blocks of bits, so
each fingerprint goes to three shards, by block and its bits. A shard larger than ``SHARD`` is dealt again by three blocks of its
remaining bits, and so on; as the agreed bits run out, what is left of a shard is bounded by its free bits, however many near
copies a group has. Inside a shard the fingerprints are sorted by Gray rank, so that neighbours share most bits. Over them stands
a tree: an upper node has the bits that all its members share as a masked pattern. Pairs of nodes whose patterns differ in more than
two bits that both share are pruned with all below; the others are opened, down to pairs of fingerprints. A shard emits a spanning
forest of its links, never all pairs. Components are joined by alternating large and small stars over staged tables.

Cases: null and blank texts have fingerprint zero and are linked like any other; a text of one or two words is one shingle;
repeated rows and exact copies share a fingerprint; a null doc_id is never the smallest unless it is alone, then component_id is
null; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WORD, bounded_batches, fresh, lower_az, matched, staged, table

SEED = 42
DISTANCE = 2
SHARD = 4096
FANOUT = 8
WORDS = re.compile(WORD)
#: Shingles that are hashed at a time: bounds memory for texts of any length.
RUN = 1 << 14


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    words = WORDS.findall(lower_az(text or ""))
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, RUN):
        upto = min(n, at + RUN)
        parts = [words[at + k : upto + k] for k in range(width)] if len(words) >= width else [[" ".join(words)]]
        hashes = np.fromiter((digest(" ".join(g), seed) for g in zip(*parts, strict=True)), dtype=np.uint64, count=upto - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, type=pa.int64())], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected binary Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def close_pairs(fps: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places i < j in fps (sorted by Gray rank, distinct) within the distance, in blocks, by the tree over masked patterns."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [(fps, np.full(len(fps), full))]
    while len(levels[-1][0]) > FANOUT:
        bits, mask = levels[-1]
        at = np.arange(0, len(bits), FANOUT)
        ones, zeros = np.bitwise_and.reduceat(bits & mask, at), np.bitwise_or.reduceat(bits | ~mask, at)
        shared = np.bitwise_and.reduceat(mask, at) & ~(ones ^ zeros)
        levels.append((ones & shared, shared))
    top = np.arange(len(levels[-1][0]))
    a, b = (x.ravel() for x in np.meshgrid(top, top, indexing="ij"))
    yield from _open(levels, len(levels) - 1, a[a <= b], b[a <= b], distance)


def _open(levels: list, k: int, a: np.ndarray, b: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Prune pairs of nodes of level k, and go on with the children of the others, a block at a time."""
    bits, mask = levels[k]
    for at in range(0, len(a), 1 << 15):
        i, j = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
        near = np.bitwise_count((bits[i] ^ bits[j]) & mask[i] & mask[j]) <= distance
        i, j = i[near], j[near]
        if k == 0:
            keep = i < j
            if keep.any():
                yield i[keep], j[keep]
        elif len(i):
            below, step = len(levels[k - 1][0]), np.arange(FANOUT)
            x = np.repeat(i * FANOUT, FANOUT * FANOUT) + np.tile(np.repeat(step, FANOUT), len(i))
            y = np.repeat(j * FANOUT, FANOUT * FANOUT) + np.tile(step, FANOUT * len(i))
            keep = (x < below) & (y < below) & (x <= y)
            yield from _open(levels, k - 1, x[keep], y[keep], distance)


def forest(n: int, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: roots by repeated hooking, all of a block at once."""
    root, links = np.arange(n), []
    for i, j in blocks:
        while len(i):
            a, b = root[i], root[j]
            other = a != b
            i, j, a, b = i[other], j[other], a[other], b[other]
            if not len(i):
                break
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            # One pair hooks each higher root; the rest look again.
            _, first = np.unique(hi, return_index=True)
            root[hi[first]] = lo[first]
            links.extend(zip(i[first].tolist(), j[first].tolist(), strict=True))
            while (root[root] != root).any():
                root = root[root]
    return links


def _blocks(free: int, parts: int) -> list[int]:
    """The free bits (a mask) cut into masks of about equal size, in order."""
    bits = [1 << k for k in range(64) if free >> k & 1]
    cut = [round(len(bits) * k / parts) for k in range(parts + 1)]
    return [sum(bits[cut[k] : cut[k + 1]]) for k in range(parts)]


def links(distinct: DataFrame, distance: int = DISTANCE, shard: int = SHARD) -> DataFrame:
    """distinct: (fp). Pairs (a, b) that connect exactly what links of the given distance connect."""
    spark = distinct.sparkSession
    found = None
    #: Rows to deal: fp with the mask of bits that its shard has in common.
    todo = distinct.select("fp", F.lit(0).cast("long").alias("agreed"))
    while todo is not None:
        dealt = staged(_deal(todo, distance + 1), "shards")
        sizes = dealt.groupBy("agreed", "bits").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        large = staged(sizes.where(F.col("n") > shard).select("agreed", "bits"), "large")
        large = large.where(F.bit_count(F.bitwise_not("agreed")) > 12)  # a shard with fewer free bits can't be large for long
        again = not large.isEmpty()
        rest = dealt.join(F.broadcast(large) if large.count() < 10_000 else large, ["agreed", "bits"], "left_anti") if again else dealt
        pairs = _shards(rest, distance)
        found = pairs if found is None else found.unionByName(pairs)
        todo = dealt.join(large, ["agreed", "bits"], "left_semi").select("fp", "agreed") if again else None
    return staged(found.distinct(), "links") if spark else found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(todo: DataFrame, parts: int) -> DataFrame:
    """Each row once a block of the free bits of its shard; bits: what its new shard has in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, agreed = (np.asarray(b.column(k).to_numpy(zero_copy_only=False)).view(np.uint64) for k in (0, 1))
            for mask in np.unique(agreed):
                own = fp[agreed == mask]
                for block in _blocks(~int(mask) & (1 << 64) - 1, parts):
                    now = int(mask) | block
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own.view(np.int64)), pa.array(np.full(len(own), _signed(now), np.int64)), pa.array((own & np.uint64(now)).view(np.int64))],
                        names=["fp", "agreed", "bits"],
                    )

    return todo.mapInArrow(run, "fp long, agreed long, bits long")


def _shards(dealt: DataFrame, distance: int) -> DataFrame:
    """The links of each shard. Rows come sorted by shard; only the shard under way is held, and none is larger than the limit."""

    def of(fps: np.ndarray) -> list[tuple[int, int]]:
        fps = np.unique(fps.view(np.uint64))
        fps = fps[np.argsort(gray_rank(fps))]
        if len(fps) < 2:
            return []
        out = forest(len(fps), close_pairs(fps, distance))
        own = fps.view(np.int64)
        return [(int(own[i]), int(own[j])) for i, j in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []
        for b in batches:
            fp, agreed, bits = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            edge = np.flatnonzero((agreed[1:] != agreed[:-1]) | (bits[1:] != bits[:-1])) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if s == e:
                    continue
                if key != (now := (agreed[s], bits[s])):
                    if held and sum(map(len, held)) > 1:
                        out += of(np.concatenate(held))
                    held, key = [], now
                held.append(fp[s:e])
            yield _pairs(out)
            out = []
        if held and sum(map(len, held)) > 1:
            out += of(np.concatenate(held))
        yield _pairs(out)

    keyed = dealt.select("fp", "agreed", "bits").repartition("agreed", "bits").sortWithinPartitions("agreed", "bits")
    return keyed.mapInArrow(run, "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])


def components(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) -> (node, root), root the least node of its component: large and small stars in turn, staged each round."""
    edges = staged(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = staged(small, "small-star")
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.countDistinct("u")).first()
        if state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, root): one row a document; root is a fingerprint that stands for the component."""
    prints = staged(fingerprints(docs, id_col, text_col), "prints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), distance))
    comp = staged(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    ids = staged(comp.groupBy("root").agg(F.min("least").alias("component_id")).join(comp.select("fp", "root"), "root").select("fp", "component_id", "root"), "ids")
    # Copies share a fingerprint, perhaps a third of all rows: such keys are dealt out.
    return matched(prints, ids, "fp").select("doc_id", "fp", "component_id", "root")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of the least doc_id. All columns stay.

    Where rows share an id (or have none), the fingerprint says which of them is meant, and copies of that row leave one.
    """
    found = staged(near_duplicates(docs, distance, id_col, text_col), "found")
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays, stays_fp, own_fp = fresh(docs, "stays", "stays_fp", "own_fp")
    given = F.col(f"`{id_col}`")
    if found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs.join(own.select(F.col("doc_id").alias(stays)), given.eqNullSafe(F.col(stays)), "left_semi")
    one = own.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("one")).select(F.col("one.doc_id").alias(stays), F.col("one.fp").alias(stays_fp))
    out = with_fingerprint(docs, own_fp, text_col)
    out = out.join(one, given.eqNullSafe(F.col(stays)) & (F.col(own_fp) == F.col(stays_fp)), "left_semi")
    return out.dropDuplicates([id_col, own_fp]).drop(own_fp)


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs with the fingerprint of each text as a last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.names.index(text_col))
            fps = np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, type=pa.int64())], names=[*b.schema.names, name])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))
