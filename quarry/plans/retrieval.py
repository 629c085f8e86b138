"""Queries over text, vector, hybrid, fusion and hierarchical operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, scored, vector
from ..text import analysis, fts, highlight
from ..text import index as ix
from .registry import query
from .tables import Tables

Q1, Q2 = "the thing", "that erin"
SIMPLE = analysis.ANALYZERS["simple"]


def _index(t: Tables) -> ix.Index:
    return ix.Index.build(t.documents, {"text": "simple"})


_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


def _bm25_sql(q: str, alias: str = "", text: str = "text") -> str:
    """CTEs h (doc_id, term, w, tf, len) and s (doc_id, score) of a query."""
    terms = ", ".join(f"'{w}'" for w in q.split())
    return f"""t{alias} AS (SELECT doc_id, {_TOK.replace("(text)", f"({text})")} AS toks FROM documents WHERE text IS NOT NULL), l{alias} AS (SELECT doc_id, len(toks) AS len FROM t{alias}),
 st{alias} AS (SELECT count(*) AS n, avg(len) AS avgdl FROM l{alias}), p{alias} AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM t{alias}) WHERE term IN ({terms}) GROUP BY ALL),
 df{alias} AS (SELECT term, count(*) AS df FROM p{alias} GROUP BY term),
 h{alias} AS (SELECT doc_id, term, tf, len, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, idf - idf / (1 + tf / (1.2 * (0.25 + 0.75 * len / avgdl))) AS w FROM p{alias} JOIN df{alias} USING (term) JOIN l{alias} USING (doc_id), st{alias}),
 s{alias} AS (SELECT doc_id, sum(w) AS score FROM h{alias} GROUP BY doc_id),
 b{alias} AS (SELECT doc_id, 1 / (1 + exp(-sum(w + ln(pr / (1 - pr))) / {len(set(q.split()))})) AS score FROM
  (SELECT *, least(greatest(0.7 * (0.2 + 0.7 * least(1, tf / 10)) + 0.3 * 0.3, 0.1), 0.9) AS pr FROM h{alias}) GROUP BY doc_id)"""


@query("text_match_bm25", f"WITH {_bm25_sql(Q1)} SELECT doc_id, score, lang, source FROM s JOIN documents USING (doc_id)")
def _(spark, d):
    t = Tables(spark, d)
    return scored.with_fields(_index(t).bm25("text", Q1), t.documents, "lang", "source")


@query("text_match_top_k", f"WITH {_bm25_sql(Q1)} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 20")
def _(spark, d):
    return scored.top_k(_index(Tables(spark, d)).bm25("text", Q1), 20)


@query("bayesian_match", f"WITH {_bm25_sql(Q1)} SELECT doc_id, score FROM b")
def _(spark, d):
    return _index(Tables(spark, d)).bayesian("text", Q1)


@query("term_retrieval", f"WITH {_bm25_sql(Q2)} SELECT doc_id, 0.0::DOUBLE AS score FROM s")
def _(spark, d):
    return _index(Tables(spark, d)).match("text", Q2)


@query("phrase_match", f"WITH t AS (SELECT doc_id, {_TOK} AS toks FROM documents), x AS (SELECT doc_id, unnest(range(1, len(toks))) AS i, toks FROM t) SELECT doc_id, count(*)::DOUBLE AS score FROM x WHERE toks[i] = 'of' AND toks[i + 1] = 'the' GROUP BY doc_id")
def _(spark, d):
    return _index(Tables(spark, d)).phrase("text", "of the")


@query("bayesian_with_prior", f"WITH {_bm25_sql(Q1)}, q AS (SELECT doc_id, score, CASE doc_id % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 0.6 WHEN 2 THEN 0.4 ELSE 0.5 END AS p FROM b) SELECT doc_id, 1 / (1 + exp(-(ln(score / (1 - score)) + ln(p / (1 - p))))) AS score FROM q")
def _(spark, d):
    t = Tables(spark, d)
    level = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "none"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return _index(t).with_prior("text", Q1, t.documents.select("doc_id", ix.authority_prior(level).alias("prior")))


@query("recency_prior", "SELECT o_orderkey, 0.5 + 0.4 * exp(-datediff('day', o_orderdate, TIMESTAMP '1999-01-01') / 30.0) AS prior FROM orders")
def _(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", ix.recency_prior(F.datediff(F.lit("1999-01-01").cast("date"), "o_orderdate")).alias("prior"))


_LOGIT = "coalesce(ln({0}.score / (1 - {0}.score)), 0)"


@query("multi_field_match", f"WITH {_bm25_sql(Q1)}, {_bm25_sql(Q1, '2', 'split_part(text, chr(10), 1)')} SELECT doc_id, 1 / (1 + exp(-({_LOGIT.format('b')} + 2 * {_LOGIT.format('b2')}) / 3)) AS score FROM b FULL JOIN b2 USING (doc_id)")
def _(spark, d):
    t = Tables(spark, d)
    docs = t.documents.withColumn("head", F.substring_index("text", "\n", 1))
    return ix.Index.build(docs, {"text": "simple", "head": "simple"}).multi_field(Q1, {"text": 1.0, "head": 2.0})


@query(
    "fts_mini_language",
    f"""WITH t AS (SELECT doc_id, coalesce({_TOK}, []) AS k FROM documents)
    SELECT doc_id FROM t WHERE (contains(' ' || array_to_string(k, ' ') || ' ', ' of the ') OR list_contains(k, 'erin')) AND NOT list_contains(k, 'moron')""",
)
def _(spark, d):
    t = Tables(spark, d)
    return fts.search(_index(t), '("of the" OR erin) AND NOT moron', t.documents.select("doc_id"), "text").select("doc_id")


@query("highlight")
def _(spark, d):
    return Tables(spark, d).documents.select("doc_id", highlight.highlight(F.col("text"), "thing", max_fragments=2).alias("marked"))


@query("analyzer_simple", f"SELECT doc_id, {_TOK} AS tokens FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return Tables(spark, d).documents.where("text IS NOT NULL").select("doc_id", SIMPLE(F.col("text")).alias("tokens"))


@query("analyzer_filters", "SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 5) AS long_words, list_filter(regexp_extract_all(lower(p_name), '[a-z]+'), lambda x: x NOT IN ('a', 'and', 'of', 'the', 'in')) AS plain FROM part")
def _(spark, d):
    n = F.col("p_name")
    return Tables(spark, d).part.select("p_partkey", analysis.length(5)(F.filter(F.split(F.lower(n), " "), lambda t: t != "")).alias("long_words"), analysis.stop(["a", "and", "of", "the", "in"])(analysis.lowercase(analysis.letter(n))).alias("plain"))


@query("analyzer_ngrams", "SELECT r_regionkey, flatten([[substring(r_name, i, k) FOR i IN range(1, length(r_name) - k + 2)] FOR k IN [2, 3] IF k <= length(r_name)]) AS grams, [substring(lower(r_name), 1, k) FOR k IN range(1, least(length(r_name), 20) + 1)] AS edges FROM region")
def _(spark, d):
    n = F.col("r_name")
    return Tables(spark, d).region.select("r_regionkey", analysis.ngrams(n, 2, 3).alias("grams"), analysis.edge_ngram(1, 20)(F.array(F.lower(n))).alias("edges"))


@query("analyzer_html", "SELECT page_id, regexp_replace(html, '(?s)<[^>]*>', ' ', 'g') <> html AS stripped FROM pages")
def _(spark, d):
    return Tables(spark, d).pages.select("page_id", (analysis.pattern_replace("(?s)<[^>]*>", " ")(F.col("html")) != F.col("html")).alias("stripped"))


@query("analyzer_standard")
def _(spark, d):
    return Tables(spark, d).benchmark.select("item_id", analysis.ANALYZERS["standard"](F.col("text")).alias("tokens"))


@query(
    "calibration_report",
    """WITH x AS (SELECT (doc_id * 37 % 100 + 0.5) / 100 AS score, toxic AS label FROM labels), c AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS conf, avg(label) AS acc,
       sum(-(label * ln(score) + (1 - label) * ln(1 - score))) AS ll, sum(pow(score - label, 2)) AS sq FROM x GROUP BY 1)
       SELECT sum(ll) / sum(n) AS log_loss, sum(sq) / sum(n) AS brier, sum(n * abs(conf - acc)) / sum(n) AS ece, sum(n)::BIGINT AS n FROM c""",
)
def _(spark, d):
    pairs = Tables(spark, d).labels.select((((F.col("doc_id") * 37) % 100 + 0.5) / 100).alias("score"), F.col("toxic").alias("label"))
    return ix.calibration(pairs)


@query("reliability", "WITH x AS (SELECT (doc_id * 37 % 100 + 0.5) / 100 AS score, toxic AS label FROM labels) SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, avg(score) AS mean_score, avg(label) AS share FROM x GROUP BY 1")
def _(spark, d):
    pairs = Tables(spark, d).labels.select((((F.col("doc_id") * 37) % 100 + 0.5) / 100).alias("score"), F.col("toxic").alias("label"))
    return ix.reliability(pairs)


# --- vectors -------------------------------------------------------------------------------------------------------------------------

_VQ = [((k * 7) % 11 - 5) / 5 for k in range(64)]
_VN = [((k * 5) % 13 - 6) / 6 for k in range(64)]


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _cos_sql(v: list[float]) -> str:
    lit = "[" + ", ".join(f"{x!r}::DOUBLE" for x in v) + "]"
    return f"(SELECT vec_id AS doc_id, label, list_cosine_similarity(embedding::DOUBLE[], {lit}) AS score FROM embeddings)"


query("knn", f"SELECT doc_id, score FROM {_cos_sql(_VQ)} ORDER BY score DESC, doc_id LIMIT 25")(lambda spark, d: vector.knn(_vectors(Tables(spark, d)), _VQ, 25))
query("knn_calibrated", f"SELECT doc_id, (1 + score) / 2 AS score FROM {_cos_sql(_VQ)} ORDER BY score DESC, doc_id LIMIT 25")(lambda spark, d: vector.knn(_vectors(Tables(spark, d)), _VQ, 25, calibrated=True))
query("vector_threshold", f"SELECT doc_id, score FROM {_cos_sql(_VQ)} WHERE score >= 0.05")(lambda spark, d: vector.within(_vectors(Tables(spark, d)), _VQ, 0.05))
query("vector_exclude", f"WITH a AS (SELECT doc_id, score FROM {_cos_sql(_VQ)} ORDER BY score DESC, doc_id LIMIT 30), b AS (SELECT doc_id FROM {_cos_sql(_VN)} WHERE score >= 0.05) SELECT * FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)")(
    lambda spark, d: vector.exclude(_vectors(Tables(spark, d)), _VQ, _VN, 30, 0.05)
)
query("vector_facet", f"SELECT label::VARCHAR AS facet_value, count(*) AS facet_count FROM {_cos_sql(_VQ)} WHERE score >= 0.02 GROUP BY 1")(lambda spark, d: vector.facet(_vectors(Tables(spark, d)).drop("embedding"), _vectors(Tables(spark, d)), _VQ, 0.02, "label"))


@query("vector_similarity_join", "SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 3 = 0 AND b.vec_id % 4 = 1 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.25")
def _(spark, d):
    v = _vectors(Tables(spark, d))
    return vector.similarity_join(v.where("doc_id % 3 = 0"), v.where("doc_id % 4 = 1"), 0.25)


@query("hybrid_join", "SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b USING (label) WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def _(spark, d):
    v = _vectors(Tables(spark, d))
    return vector.hybrid_join(v, v, "label", 0.3)


@query("bayesian_knn")
def _(spark, d):
    return vector.bayesian_knn(_vectors(Tables(spark, d)), _VQ, 20)


@query("ivf_search", f"SELECT doc_id, score FROM {_cos_sql(_VQ)} ORDER BY score DESC, doc_id LIMIT 20")
def _(spark, d):
    return vector.Ivf(_vectors(Tables(spark, d)), nlist=8, train=2000).search(_VQ, 20, nprobe=8)


_JACC = """WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS k FROM benchmark WHERE text IS NOT NULL)
SELECT a.item_id AS left_id, b.item_id AS right_id, len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) AS score FROM t a, t b
WHERE len(a.k) > 0 AND len(b.k) > 0 AND len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) >= 0.3"""


@query("text_similarity_join", _JACC)
def _(spark, d):
    t = Tables(spark, d).benchmark.where("text IS NOT NULL").select(F.col("item_id").alias("doc_id"), SIMPLE(F.col("text")).alias("tokens"))
    return scored.text_similarity_join(t, t, threshold=0.3)


@query("hybrid_text_vector", f"WITH {_bm25_sql(Q1)}, v AS (SELECT doc_id, score FROM {_cos_sql(_VQ)} WHERE score >= 0.02) SELECT doc_id, s.score + v.score AS score FROM s JOIN v USING (doc_id)")
def _(spark, d):
    t = Tables(spark, d)
    return scored.intersect(_index(t).bm25("text", Q1), vector.within(_vectors(t), _VQ, 0.02))


@query("posting_algebra", f"WITH {_bm25_sql(Q1, '1')}, {_bm25_sql(Q2, '2')}, u AS (SELECT doc_id, sum(score) AS score FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY doc_id), i AS (SELECT doc_id, s1.score + s2.score AS score FROM s1 JOIN s2 USING (doc_id)), df AS (SELECT * FROM s1 WHERE doc_id NOT IN (SELECT doc_id FROM s2)), c AS (SELECT doc_id, 0.0 AS score FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s1)) SELECT 'union' AS op, * FROM u UNION ALL SELECT 'intersect', * FROM i UNION ALL SELECT 'difference', * FROM df UNION ALL SELECT 'complement', * FROM c")
def _(spark, d):
    t = Tables(spark, d)
    i = _index(t)
    a, b = i.bm25("text", Q1), i.bm25("text", Q2)
    parts = {"union": scored.union(a, b), "intersect": scored.intersect(a, b), "difference": scored.difference(a, b), "complement": scored.complement(a, t.documents.select("doc_id"))}
    out = None
    for op, p in parts.items():
        one = p.select(F.lit(op).alias("op"), "doc_id", "score")
        out = one if out is None else out.unionAll(one)
    return out


@query("sparse_threshold", f"WITH {_bm25_sql(Q1)} SELECT doc_id, score - 0.5 AS score FROM s WHERE score > 0.5")
def _(spark, d):
    return scored.threshold(_index(Tables(spark, d)).bm25("text", Q1), 0.5)


# --- fusion ----------------------------------------------------------------------------------------------------------------------------

_SIG = """WITH a AS (SELECT vec_id AS doc_id, (vec_id * 13 % 97 + 1) / 99.0 AS score FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id AS doc_id, (vec_id * 29 % 89 + 1) / 91.0 AS score FROM embeddings WHERE vec_id % 3 = 0),
w0 AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.score AS pa, b.score AS pb FROM a FULL JOIN b ON a.doc_id = b.doc_id), r AS (SELECT count(pa) / count(*) AS ra, count(pb) / count(*) AS rb FROM w0),
w AS (SELECT doc_id, coalesce(pa, 0.5 * (1 - ra) + 0.01 * ra) AS p0, coalesce(pb, 0.5 * (1 - rb) + 0.01 * rb) AS p1 FROM w0, r), l AS (SELECT *, ln(p0 / (1 - p0)) AS l0, ln(p1 / (1 - p1)) AS l1 FROM w) """


def _signals(t: Tables) -> list[DataFrame]:
    v = t.embeddings
    return [v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), ((F.col("vec_id") * 13 % 97 + 1) / 99.0).alias("score")), v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("doc_id"), ((F.col("vec_id") * 29 % 89 + 1) / 91.0).alias("score"))]


query("fuse_log_odds", _SIG + "SELECT doc_id, 1 / (1 + exp(-(l0 + l1) / 2 * sqrt(2))) AS score FROM l")(lambda spark, d: fusion.log_odds(_signals(Tables(spark, d))))
query("fuse_log_odds_top_k", _SIG + "SELECT doc_id, 1 / (1 + exp(-(l0 + l1) / 2 * sqrt(2))) AS score FROM l ORDER BY score DESC, doc_id LIMIT 15")(lambda spark, d: fusion.log_odds(_signals(Tables(spark, d)), k=15))
query("fuse_log_odds_relu", _SIG + "SELECT doc_id, 1 / (1 + exp(-(greatest(l0, 0) + greatest(l1, 0)) / 2 * sqrt(2))) AS score FROM l")(lambda spark, d: fusion.log_odds(_signals(Tables(spark, d)), gating="relu"))
query("fuse_log_odds_swish", _SIG + "SELECT doc_id, 1 / (1 + exp(-(l0 / (1 + exp(-l0)) + l1 / (1 + exp(-l1))) / 2 * sqrt(2))) AS score FROM l")(lambda spark, d: fusion.log_odds(_signals(Tables(spark, d)), gating="swish"))
query("fuse_prob_and", _SIG + "SELECT doc_id, p0 * p1 AS score FROM w")(lambda spark, d: fusion.prob_and(_signals(Tables(spark, d))))
query("fuse_prob_or", _SIG + "SELECT doc_id, 1 - (1 - p0) * (1 - p1) AS score FROM w")(lambda spark, d: fusion.prob_or(_signals(Tables(spark, d))))
query("fuse_prob_not", _SIG + "SELECT e.vec_id AS doc_id, 1 - coalesce(a.score, 0.01) AS score FROM embeddings e LEFT JOIN a ON e.vec_id = a.doc_id")(lambda spark, d: fusion.prob_not(_signals(Tables(spark, d))[0], Tables(spark, d).embeddings.select(F.col("vec_id").alias("doc_id"))))
query("fuse_learned", _SIG + "SELECT doc_id, 1 / (1 + exp(-(0.25 * l0 + 0.75 * l1) * sqrt(2))) AS score FROM l")(lambda spark, d: fusion.learned(_signals(Tables(spark, d)), [1, 3]))
query("fuse_attention", _SIG + "SELECT doc_id, 1 / (1 + exp(-(exp(1.0) * l0 + l1) / (exp(1.0) + 1) * sqrt(2))) AS score FROM l")(lambda spark, d: fusion.attention(_signals(Tables(spark, d)), [1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]]))
query("fuse_multihead")(lambda spark, d: fusion.multihead(_signals(Tables(spark, d)), [0.5, 1.0, 0.2], 4))
query("fuse_adaptive", _SIG + ", n AS (SELECT (SELECT count(*) FROM w) AS u, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb) SELECT doc_id, 1 / (1 + exp(-(l0 + l1) / 2 * pow(2, (0.5 * (0.5 + na / u) + 0.5 * (0.5 + nb / u)) / 2))) AS score FROM l, n")(lambda spark, d: fusion.adaptive(_signals(Tables(spark, d))))
query("staged_retrieval", _SIG + ", x AS (SELECT * FROM a ORDER BY score DESC, doc_id LIMIT 60), y AS (SELECT x.doc_id, coalesce(b.score, x.score) AS score FROM x LEFT JOIN b ON x.doc_id = b.doc_id) SELECT * FROM y WHERE score >= 0.4")(lambda spark, d: fusion.staged([(_signals(Tables(spark, d))[0], 60), (_signals(Tables(spark, d))[1], 0.4)]))
query(
    "progressive_fusion",
    """WITH a AS (SELECT vec_id AS id, (vec_id * 13 % 97 + 1) / 99.0::DOUBLE AS p FROM embeddings WHERE vec_id % 2 = 0 ORDER BY p DESC, id LIMIT 60),
    w AS (SELECT id, p, CASE WHEN id % 3 = 0 THEN (id * 29 % 89 + 1) / 91.0::DOUBLE END AS q FROM a), r AS (SELECT count(q) / count(*)::DOUBLE AS r FROM w),
    z AS (SELECT id, p, coalesce(q, 0.5 * (1 - r) + 0.01 * r) AS q FROM w, r)
    SELECT id AS doc_id, 1 / (1 + exp(-(ln(p / (1 - p)) + ln(q / (1 - q))) / 2 * sqrt(2))) AS score FROM z ORDER BY score DESC, doc_id LIMIT 10""",
)(lambda spark, d: fusion.progressive([([_signals(Tables(spark, d))[0]], 60), ([_signals(Tables(spark, d))[1]], 10)]))


@query("vector_density_prior")
def _(spark, d):
    return vector.Ivf(_vectors(Tables(spark, d)), nlist=8, train=2000).density_prior()


# --- hierarchical ----------------------------------------------------------------------------------------------------------------------

_NEST = "(SELECT o_orderkey AS doc_id, array_agg(l_quantity ORDER BY l_linenumber) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"


def _nested(t: Tables) -> DataFrame:
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag"))).alias("items"))
    return t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("doc_id"), F.struct("items", F.col("o_orderstatus").alias("status")).alias("doc"))


for _m, _f in {"count": "len(q)", "sum": "list_sum(q)", "avg": "list_avg(q)", "min": "list_min(q)", "max": "list_max(q)"}.items():
    query(f"path_aggregate_{_m}", f"SELECT doc_id, {_f}::DOUBLE AS aggregate FROM {_NEST}")(lambda spark, d, m=_m: scored.path_aggregate(_nested(Tables(spark, d)), "doc.items.l_quantity", m))
query("path_filter", f"SELECT doc_id FROM {_NEST} WHERE len(list_filter(q, lambda x: x > 49)) > 0")(lambda spark, d: scored.path_filter(_nested(Tables(spark, d)), "doc.items.l_quantity", lambda x: x > 49, True).select("doc_id"))
query("path_project", "SELECT o_orderkey AS doc_id, o_orderstatus AS doc_status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")(lambda spark, d: scored.path_project(_nested(Tables(spark, d)), "doc.status"))
query("path_unnest", "SELECT o_orderkey AS doc_id, l_quantity AS unnested_data FROM orders JOIN lineitem ON o_orderkey = l_orderkey")(lambda spark, d: scored.path_unnest(_nested(Tables(spark, d)), "doc.items.l_quantity").select("doc_id", "unnested_data"))
