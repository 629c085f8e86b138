"""Mixing sources to target weights by Pareto order sampling.

Sources get shares of all words by weight, at most ``max_copies`` times their own size. A source's documents are each taken
``floor(target / size)`` times for certain; the rest of the target is drawn without replacement, with unequal probabilities:
a document's inclusion probability is proportional to its size,

    p_i = min(1, rate * size_i),        rate such that the expected words, the sum of p_i * size_i, are the source's remaining ones;

where it would pass 1, the document is one more certain copy. Every document gets a uniform number u from a digest of its id and the
ranking variable

    q_i = (u_i / (1 - u_i)) / (p_i / (1 - p_i))        (0 for certain ones)

and the smallest q are taken until the source's remaining words are reached (Rosén's order sampling; the target is in words, so the sample's
fixed size is in words too, not in draws, which would miss it). The rate is found over the distinct sizes of a source. The cut-off is
found by two histograms of q / (1 + q) and an exact look into one bin, so that no source, however large, is sorted in one task. One last
document, the one whose size is nearest to the words still missing, closes the gap.

Only the table of sources, a few numbers a source, is sorted in one task: its order says which weight a source has.

Cases: null text has size 0; a null source is a source of its own, the last; sources of size 0 have target 0; rows that agree in
id, source and size are taken or left together; a null id draws by its text's digest; an empty table gives no rows. Further columns
of the input are not used by the query; ``take`` keeps them all, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, small, staged, table

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BINS = 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1), from the first 48 bits of the id's MD5 (a null id's: of its text's): reruns and other engines agree."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    head = F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("long")
    return (head + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds target: the share by weight, capped, with the excess reshared.

    Resharing until none is above its cap ends where the capped sources are those of the smallest cap / weight; the common level
    of the others is (total - their caps) / (all weights - their weights). One row a source passes one sort.
    """
    every = W.partitionBy(F.lit(0))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    wt = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    cap = (F.col("source_size") * max_copies).cast("long")
    fill = W.orderBy((F.col("cap") / F.col("wt")), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    return (
        sizes.select("source", "source_size", wt.alias("wt"), cap.alias("cap"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("all_wt", F.sum("wt").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("all_wt") - F.coalesce(F.sum("wt").over(before), F.lit(0))))
        .withColumn("open", F.col("level") * F.col("wt") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("wt"), "level"))).over(every)["level"])
        .select("source", "source_size", F.when(F.col("level") * F.col("wt") <= F.col("cap"), F.col("level") * F.col("wt")).otherwise(F.col("cap").cast("double")).alias("target"))
    )


def _cut(cells: DataFrame, keys: list[str], bin_name: str, need: Column) -> DataFrame:
    """The bin in which the running words of the group reach what it needs, and the words before it. cells: one row a bin."""
    w = W.partitionBy(*keys).orderBy(bin_name)
    return (
        cells.withColumn("upto", F.sum("words").over(w))
        .withColumn("before", F.col("upto") - F.col("words"))
        .where((F.col("before") <= need) & (F.col("upto") > need))
        .drop("words", "upto")
    )


def rates(base: DataFrame, facts: DataFrame) -> DataFrame:
    """(key, rate, top): inclusion probabilities are rate * size for sizes up to top and 1 for larger ones.

    From the largest size down, the rate that the rest would have if all larger ones were certain; the first that keeps its own below 1.
    """
    size = F.col("size").cast("decimal(38,0)")
    cells = base.where(F.col("size") > 0).groupBy("key", "size").agg(F.count("*").cast("decimal(20,0)").alias("n")).join(facts.where(F.col("p") > 0).select("key", "need"), "key")
    down = W.partitionBy("key").orderBy(F.col("size").desc())
    words, squares = (F.col("n") * size).cast("decimal(38,0)"), (F.col("n") * size * size).cast("decimal(38,0)")
    larger = F.coalesce(F.sum(words).over(down.rowsBetween(W.unboundedPreceding, -1)).cast("double"), F.lit(0.0))
    rest = F.sum(squares).over(down.rowsBetween(W.currentRow, W.unboundedFollowing)).cast("double")
    found = cells.select("key", "size", ((F.col("need") - larger) / rest).alias("rate")).where(F.col("rate") * F.col("size") < 1)
    return small(found.groupBy("key").agg(F.max_by("rate", "size").alias("rate"), F.max("size").alias("top")), "rates")


def draws(base: DataFrame, facts: DataFrame) -> DataFrame:
    """base: (doc_id, source, size, u); facts: targets() of it. Adds source_size, target and copies, a long."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    facts = small(
        facts.withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("times"))
        .withColumn("p", F.col("times") - F.col("whole"))
        .withColumn("need", F.col("p") * F.col("source_size"))
        .withColumn("key", key)
        .drop("times", "source"),
        "targets",
    )
    keyed = base.withColumn("key", key)
    chance = F.col("rate") * F.col("size")
    q = F.when(F.col("size") > F.coalesce("top", F.lit(0)), F.lit(0.0)).otherwise((F.col("u") / (1 - F.col("u"))) * ((1 - chance) / chance))
    cell = F.floor(F.col("q") / (1 + F.col("q")) * (BINS * BINS)).cast("int")
    drawn = staged(
        keyed.join(facts, "key")
        .join(rates(keyed, facts), "key", "left")
        .withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), q))
        .drop("rate", "top")
        .withColumn("cell", F.least(cell, F.lit(BINS * BINS - 1)))
        .withColumn("b1", F.floor(F.col("cell") / BINS).cast("int")),
        "drawn",
    )
    able = drawn.where(F.col("q").isNotNull() & (F.col("size") > 0))
    one = small(_cut(able.groupBy("key", "need", "b1").agg(F.sum("size").alias("words")), ["key"], "b1", F.col("need")).withColumnRenamed("before", "before1"), "cut1")
    inner = able.join(one.select("key", "b1", "before1"), ["key", "b1"])
    two = small(_cut(inner.groupBy("key", "b1", "need", "before1", "cell").agg(F.sum("size").alias("words")), ["key"], "cell", F.col("need") - F.col("before1")).withColumn("before2", F.col("before1") + F.col("before")), "cut2")
    at = F.struct("q", F.col("doc_id").alias("id"), "size")
    ranked = W.partitionBy("key").orderBy("q", F.col("doc_id"), "size").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = (
        able.join(two.select("key", "cell", "before2"), ["key", "cell"])
        .withColumn("upto", F.col("before2") + F.sum("size").over(ranked))
        .where(F.col("upto") <= F.col("need"))
        .groupBy("key")
        .agg(F.max(at).alias("last"), F.max("upto").alias("got"))
    )
    # Sources that never exceed their need (rounding only) have no cut; all their documents are drawn.
    state = small(
        two.select("key", "cell", "before2", "need").join(last, "key", "left").select("key", F.col("cell").alias("cut"), "last", (F.col("need") - F.coalesce("got", "before2")).alias("gap")),
        "state",
    )
    inside = (F.col("cell") < F.col("cut")) | ((F.col("cell") == F.col("cut")) & F.col("last").isNotNull() & (at <= F.col("last")))
    rest = able.join(state, "key").where(~inside)
    near = F.abs(F.col("size") - F.col("gap"))
    closing = small(rest.groupBy("key", "gap").agg(F.min(F.struct(near.alias("off"), "q", F.col("doc_id").alias("id"), "size")).alias("close")), "closing")
    again = rest.join(closing.select("key", "close"), "key").where((F.col("q") == F.col("close.q")) & F.col("doc_id").eqNullSafe(F.col("close.id")) & (F.col("size") == F.col("close.size")))
    fits = small(
        again.groupBy("key", "gap", "close").agg(F.count("*").alias("n")).where(F.abs(F.col("n") * F.col("close.size") - F.col("gap")) < F.col("gap")).select("key", "close"),
        "fits",
    )
    closes = F.col("close").isNotNull() & (F.col("q") == F.col("close.q")) & F.col("doc_id").eqNullSafe(F.col("close.id")) & (F.col("size") == F.col("close.size"))
    extra = F.col("q").isNotNull() & (F.col("size") > 0) & (F.col("cut").isNull() | inside | closes)
    return (
        drawn.join(state, "key", "left")
        .join(fits, "key", "left")
        .withColumn("copies", F.col("whole") + F.when(extra, F.lit(1)).otherwise(F.lit(0)))
        .select(*base.columns, "source_size", "target", F.col("copies").cast("long").alias("copies"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, u, source_size, target, copies): how often the mix takes each document. One row a document."""
    said = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), uniform(F.col(id_col), F.col(text_col)).alias("u"))
    base = staged(said, "sizes")
    facts = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies)
    return draws(base, facts)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


ORACLE = f"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 12))::BIGINT + 0.5::DOUBLE) / {1 << 48}::DOUBLE AS u
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS wt,
      3 * source_size AS cap, sum(source_size) OVER () AS total FROM sizes),
f AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(wt) OVER () - coalesce(sum(wt) OVER b, 0))::DOUBLE AS lv FROM w
      WINDOW b AS (ORDER BY cap::DOUBLE / wt, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (SELECT arg_min(lv, cap::DOUBLE / wt) FROM f WHERE lv * wt <= cap) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN level * wt <= cap THEN level * wt ELSE cap::DOUBLE END AS target FROM g),
x AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS times FROM t),
y AS (SELECT *, floor(times) AS whole, times - floor(times) AS p, (times - floor(times)) * source_size AS need FROM x),
z AS (SELECT y.source, b.size, any_value(y.need) AS need, count(*) AS n FROM base b JOIN y ON b.source IS NOT DISTINCT FROM y.source WHERE b.size > 0 AND y.p > 0 GROUP BY y.source, b.size),
zz AS (SELECT source, size, (need - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(n * size * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate FROM z),
rates AS (SELECT source, arg_max(rate, size) AS rate, max(size) AS top FROM zz WHERE rate * size < 1 GROUP BY source),
d AS (SELECT b.*, y.source_size, y.target, y.whole, y.need,
      CASE WHEN p > 0 AND b.size > 0 THEN CASE WHEN b.size > coalesce(top, 0) THEN 0 ELSE (u / (1 - u)) * ((1 - rate * b.size) / (rate * b.size)) END END AS q
      FROM base b JOIN y ON b.source IS NOT DISTINCT FROM y.source LEFT JOIN rates ON b.source IS NOT DISTINCT FROM rates.source),
r AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS FIRST, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d),
s AS (SELECT *, q IS NOT NULL AND size > 0 AND upto <= need AS inside FROM r),
gap AS (SELECT source, min(need) - coalesce(sum(size) FILTER (WHERE inside), 0) AS gap FROM s GROUP BY source),
n AS (SELECT s.doc_id, s.source, s.size, s.q, gap.gap, row_number() OVER (PARTITION BY s.source ORDER BY abs(s.size - gap.gap), s.q, s.doc_id, s.size) AS k
      FROM s JOIN gap ON s.source IS NOT DISTINCT FROM gap.source WHERE NOT s.inside AND s.q IS NOT NULL AND s.size > 0),
c AS (SELECT n.source, n.doc_id, n.size, n.q FROM n WHERE k = 1 AND abs(n.size * (SELECT count(*) FROM n m WHERE m.source IS NOT DISTINCT FROM n.source AND m.doc_id IS NOT DISTINCT FROM n.doc_id AND m.q = n.q AND m.size = n.size) - n.gap) < n.gap)
SELECT s.doc_id, s.size, s.source_size::BIGINT AS source_size, s.target,
       ((s.whole + CASE WHEN s.inside OR c.source IS NOT NULL OR c.doc_id IS NOT NULL THEN 1 ELSE 0 END) * s.size)::BIGINT AS taken,
       s.source, (s.whole + CASE WHEN s.inside OR c.source IS NOT NULL OR c.doc_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS copies
FROM s LEFT JOIN c ON s.source IS NOT DISTINCT FROM c.source AND s.doc_id IS NOT DISTINCT FROM c.doc_id AND s.q = c.q AND s.size = c.size
"""


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: docs with each row as often as it is taken. All columns stay."""
    chosen = mix(docs, weights, max_copies, id_col, text_col, source_col).where("copies > 0")
    i, s, n, u, times, copy = fresh(docs, "id", "source", "size", "u", "times", "copy")
    keys = chosen.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(n), F.col("u").alias(u), F.col("copies").cast("int").alias(times)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).cast("string").eqNullSafe(F.col(s)) & (n_words(F.col(text_col)) == F.col(n)) & (uniform(F.col(id_col), F.col(text_col)) == F.col(u))
    return docs.join(keys, same).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(copy)).drop(copy)
