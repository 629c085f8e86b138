"""Exact top-k of BM25 and of fused signals with less than all of the work: documents whose upper bound can't reach the k-th best are never scored.

The threshold is a proven lower bound of the k-th best score: the k-th largest weight within any one term (a document's score is no less
than one of its weights). Terms in ascending order of their upper bounds whose sum stays below the threshold are non-essential: a
document with none of the others can't be among the k. Block bounds do the same a range of doc_ids at a time, from a table of the
largest weight a (term, block) that is made with the index.

What is collected is a number or two a query term. Results equal the exhaustive ones; ties by doc_id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import fusion
from ..operators.lineage import stage
from .index import B, K1, Index

BLOCK = 128


def best(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.col("score").desc(), "doc_id").limit(k)


@dataclass
class Plan:
    """What bounds say of a query: per-term bounds and document counts, the threshold, and the essential terms."""

    bounds: dict[str, float]
    counts: dict[str, int]
    threshold: float
    essential: list[str]

    @property
    def skipped(self) -> float:
        """The share of postings that the essential terms leave out of the search for candidates."""
        total = sum(self.counts.values())
        return 1 - sum(self.counts[t] for t in self.essential) / total if total else 0.0


def analyse(hits: DataFrame, k: int) -> Plan:
    """hits: (doc_id, term, w). One pass: each term's largest weight, its documents, and its k-th largest weight."""
    at = W.partitionBy("term").orderBy(F.col("w").desc())
    # The k largest of a term by a bounded heap in each task would do; the window's sort is spillable and of the query's terms only.
    rows = hits.groupBy("term").agg(F.max("w").alias("bound"), F.count("*").alias("n")).collect()
    kth = {r.term: r.w for r in hits.withColumn("r", F.row_number().over(at)).where(F.col("r") == k).select("term", "w").collect()}
    bounds, counts = {r.term: r.bound for r in rows}, {r.term: r.n for r in rows}
    threshold = max(kth.values(), default=0.0)
    essential, total = [], 0.0
    for t in sorted(bounds, key=bounds.__getitem__):
        total += bounds[t]
        if total >= threshold:
            essential.append(t)
    return Plan(bounds, counts, threshold, essential)


def _hits(index: Index, field: str, query: str) -> DataFrame:
    rows, _ = index._hits(field, query, K1, B)
    return stage(rows.select("doc_id", "term", "w"), "hits")


def wand(index: Index, field: str, query: str, k: int) -> DataFrame:
    """(doc_id, score): candidates have an essential term and bounds that reach the threshold; only they are summed."""
    hits = _hits(index, field, query)
    plan = analyse(hits, k)
    if not plan.bounds:
        return best(hits.groupBy("doc_id").agg(F.sum("w").alias("score")), k)
    candidates = hits.where(F.col("term").isin(plan.essential)).select("doc_id").distinct()
    if len(plan.essential) == len(plan.bounds):
        candidates = None  # every posting is essential: nothing to leave out
    own = hits if candidates is None else hits.join(candidates, "doc_id", "left_semi")
    return best(own.groupBy("doc_id").agg(F.sum("w").alias("score")).where(F.col("score") >= plan.threshold - 1e-9), k)


def block_bounds(hits: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, block, bound): the largest weight of a term among so many doc_ids."""
    return hits.groupBy("term", F.floor(F.col("doc_id") / block).alias("block")).agg(F.max("w").alias("bound"))


def block_max(index: Index, field: str, query: str, k: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, score): only blocks of doc_ids whose terms' bounds together reach the threshold are scored."""
    hits = _hits(index, field, query)
    plan = analyse(hits, k)
    alive = block_bounds(hits, block).groupBy("block").agg(F.sum("bound").alias("most")).where(F.col("most") >= plan.threshold - 1e-9).select("block")
    own = hits.withColumn("block", F.floor(F.col("doc_id") / block)).join(alive, "block", "left_semi")
    return best(own.groupBy("doc_id").agg(F.sum("w").alias("score")), k)


def adaptive(index: Index, field: str, query: str, k: int) -> DataFrame:
    """wand where the bounds leave postings out, else block_max."""
    hits = _hits(index, field, query)
    plan = analyse(hits, k)
    return wand(index, field, query, k) if plan.skipped > 0 else block_max(index, field, query, k)


def fused(signals: Sequence[DataFrame], k: int, alpha: float = 0.5, tightened: bool = False) -> DataFrame:
    """Top-k of log-odds fusion. Log odds rise with each signal, so the fused largest scores of some documents bound all of them.

    Documents are grouped by the signals that they are in; a group whose bound is below the k-th best of those in all signals is left
    out whole. Tightened, groups are cut further by the first signal's score in steps of a tenth, so that bounds are nearer.
    """
    wide = fusion.wide(signals)
    names = [c for c in wide.columns if c != "doc_id"]
    score = fusion.log_odds_column([F.col(c) for c in names], alpha)
    present = None
    for i, s in enumerate(signals):
        own = s.select("doc_id", F.lit(1 << i).alias("bit"))
        present = own if present is None else present.unionByName(own)
    of = present.groupBy("doc_id").agg(F.bit_or("bit").alias("group"))
    flags = wide.join(of, "doc_id").withColumn("step", F.floor(F.col(names[0]) * 10) if tightened else F.lit(0).cast("long"))
    flags = stage(flags, "groups")
    tops = flags.groupBy("group", "step").agg(*[F.max(c).alias(c) for c in names]).select("group", "step", score.alias("bound"))  # a row a set of signals and step
    kth = best(flags.where(F.col("group") == (1 << len(names)) - 1).select("doc_id", score.alias("score")), k).agg(F.count("*").alias("n"), F.min("score").alias("low")).first()
    alive = tops.where(F.col("bound") >= (kth.low - 1e-12 if kth.n == k else 0.0)).select("group", "step")
    return best(flags.join(F.broadcast(alive), ["group", "step"], "left_semi").select("doc_id", score.alias("score")), k)
