"""Relational operators that add something to the DataFrame API: PostgreSQL's orders, frames, predicates and recursive queries.

Everything returns lazily evaluated DataFrames or Columns; plain select, filter, join and aggregate need no wrapper.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .lineage import settle


def keys(*names: str) -> list[Column]:
    """Sort keys ``"a"``, ``"a desc"``, ``"a desc nulls last"``; nulls last by default when ascending and first when descending."""
    out = []
    for name in names:
        m = re.fullmatch(r"\s*(.+?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*", name, re.I)
        c, down = F.expr(m[1]), (m[2] or "").lower() == "desc"
        first = m[3].lower() == "first" if m[3] else down
        out.append(getattr(c, f"{'desc' if down else 'asc'}_nulls_{'first' if first else 'last'}")())
    return out


def order_by(df: DataFrame, *names: str) -> DataFrame:
    return df.orderBy(*keys(*names))


def top_k(df: DataFrame, k: int, *names: str) -> DataFrame:
    """The first k rows of the order, without sorting the rest (TakeOrderedAndProject)."""
    return df.orderBy(*keys(*names)).limit(k)


def window(partition: Sequence[str] = (), order: Sequence[str] = (), frame: tuple[str, int | None, int | None] | None = None) -> WindowSpec:
    """frame: ("rows" or "range", start, end), None for unbounded. Ordered windows run to the current row, by rows; others see all."""
    w = W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0))
    if order:
        w = w.orderBy(*keys(*order))
    kind, lo, hi = frame or ("rows", None, 0 if order else None)
    bounds = (W.unboundedPreceding if lo is None else lo, W.unboundedFollowing if hi is None else hi)
    return w.rowsBetween(*bounds) if kind == "rows" else w.rangeBetween(*bounds)


def ranking(partition: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """For row_number, rank, lag and the like, which take no frame."""
    return (W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0))).orderBy(*keys(*order))


def ntile_even(n: int, partition: Sequence[str], order: Sequence[str]) -> Column:
    """floor((row - 1) * n / rows) + 1: the reference's buckets, which differ from ntile's where n doesn't divide the rows."""
    size = F.count(F.lit(1)).over(W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0)))
    return (F.floor((F.row_number().over(ranking(partition, order)) - 1) * n / size) + 1).cast("int")


def similar_to(c: Column, pattern: str) -> Column:
    """SQL's SIMILAR TO: the whole value, with % and _ beside regular-expression operators."""
    return c.rlike("^(?s:" + re.sub(r"[%_.^$\\]", lambda m: {"%": ".*", "_": ".", ".": r"\.", "^": r"\^", "$": r"\$", "\\": "\\"}[m[0]], pattern) + ")$")


def between_symmetric(c: Column, a: Column, b: Column) -> Column:
    return c.between(F.least(a, b), F.greatest(a, b))


def compare_any(c: Column, op: str, array: Column) -> Column:
    """c op ANY (array), three-valued: true if true for one, else null if unknown for one."""
    return F.exists(array, lambda x: _op(c, op, x))


def compare_all(c: Column, op: str, array: Column) -> Column:
    return F.forall(array, lambda x: _op(c, op, x))


def _op(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def is_distinct(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, limit: int = 1000, cut_every: int = 8) -> DataFrame:
    """WITH RECURSIVE by semi-naive rounds: step sees the newest rows only. UNION keeps rows that are new, UNION ALL all of them.

    Each round is settled in the shared folder, and every few rounds so is what has gathered, so plans stay small and nothing is held in memory.
    """
    newest = settle(seed.distinct() if distinct else seed)
    total = newest
    for k in range(1, limit + 1):
        newest = step(newest).toDF(*seed.columns)
        newest = settle(_minus(newest.distinct(), total) if distinct else newest)
        if newest.isEmpty():
            return total
        total = total.unionByName(newest)
        if k % cut_every == 0:
            total = settle(total)
    raise RuntimeError(f"the recursion didn't end in {limit} rounds")


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that aren't in b; nulls are equal."""
    renamed = b.select([F.col(f"`{c}`").alias(f"_b_{c}") for c in b.columns])
    cond = None
    for c in a.columns:
        one = a[c].eqNullSafe(renamed[f"_b_{c}"])
        cond = one if cond is None else cond & one
    return a.join(renamed, cond, "left_anti")


def set_op(left: DataFrame, right: DataFrame, op: str, all_rows: bool = False) -> DataFrame:
    """UNION, INTERSECT, EXCEPT by position under the left names; bag semantics with all_rows."""
    if len(left.columns) != len(right.columns):
        raise ValueError(f"{op}: {len(left.columns)} and {len(right.columns)} columns")
    right = right.toDF(*left.columns)
    if op == "union":
        both = left.unionAll(right)
        return both if all_rows else both.distinct()
    if op == "intersect":
        return left.intersectAll(right) if all_rows else left.intersect(right)
    if op == "except":
        return left.exceptAll(right) if all_rows else left.subtract(right)
    raise ValueError(op)


def values(spark: SparkSession, rows: Iterable[Sequence], types: Sequence[str]) -> DataFrame:
    """VALUES (..), (..): columns column1..n."""
    rows = [tuple(r) for r in rows]
    return spark.createDataFrame(rows, ", ".join(f"column{k} {t}" for k, t in enumerate(types, 1)))


def upsert(target: DataFrame, new: DataFrame, on: Sequence[str], update: dict[str, Column] | None, order: Sequence[str] = ()) -> DataFrame:
    """INSERT .. ON CONFLICT (on): keep the old row (update None) or set columns from ``old.x`` and ``new.x`` expressions.

    Of several new rows with one key the first in the given order counts, ties by all columns.
    """
    at = W.partitionBy(*on).orderBy(*order, F.to_json(F.struct(*new.columns)))
    new = new.withColumn("__k", F.row_number().over(at)).where("__k = 1").drop("__k")
    o, n = target.alias("old"), new.alias("new")
    hit = [F.col(f"old.{c}") == F.col(f"new.{c}") for c in on]
    fresh = n.join(o, hit, "left_anti").select([F.col(f"new.{c}") for c in target.columns])
    if update is None:
        return target.unionByName(fresh)
    one = new.withColumn("_hit", F.lit(True)).alias("new")
    joined = o.join(one, hit, "left")
    kept = joined.select([F.when(F.col("new._hit"), update[c]).otherwise(F.col(f"old.{c}")).alias(c) if c in update else F.col(f"old.{c}") for c in target.columns])
    return kept.unionByName(fresh)


def update_from(target: DataFrame, source: DataFrame, on: Column, sets: dict[str, Column], order: Sequence[str] = ()) -> DataFrame:
    """UPDATE .. FROM: target aliased ``t``, source ``s``; of several matching source rows the first in order wins."""
    t = settle(target.withColumn("_row", F.monotonically_increasing_id())).alias("t")  # numbers must not change between its two uses
    hit = t.join(source.alias("s"), on).select("t._row", *[v.alias(f"_set_{c}") for c, v in sets.items()], *[F.expr(f"s.{k}").alias(f"_o{i}") for i, k in enumerate(order)])
    w = W.partitionBy("_row").orderBy(*[f"_o{i}" for i in range(len(order))], F.to_json(F.struct(*[f"_set_{c}" for c in sets])))
    first = hit.withColumn("_k", F.row_number().over(w)).where("_k = 1").withColumn("_hit", F.lit(True))
    out = t.join(first, "_row", "left")
    return out.select([F.when(F.col("_hit"), F.col(f"_set_{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in sets else F.col(f"t.{c}").alias(c) for c in target.columns])


def delete_using(target: DataFrame, source: DataFrame, on: Column) -> DataFrame:
    """DELETE .. USING: target aliased ``t``, source ``s``."""
    return target.alias("t").join(source.alias("s"), on, "left_anti")
