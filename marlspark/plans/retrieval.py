"""Retrieval queries: documents as chunks, benchmark texts or fixed strings as queries, labels as gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import retrieval as R
from .registry import query, table

QUERY = "the edition of the src1 nation and the estion license version 2"
TERMS = f"list_transform(regexp_extract_all(text, '{T.CODE_TOKEN}'), lambda x: lower(x))"
QTERMS = f"list_transform(regexp_extract_all(q, '{T.CODE_TOKEN}'), lambda x: lower(x))"
LEXICAL = f"""
q AS (SELECT 0 AS query_id, '{QUERY}' AS q), qt AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({QTERMS}) AS term FROM q) GROUP BY 1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
pt AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({TERMS.replace('text', 'source')}) AS term FROM documents) WHERE term IN (SELECT term FROM qt)),
sc AS (SELECT doc_id, sum(s) AS s FROM (SELECT doc_id, qtf * (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS s FROM tf JOIN df USING (term) JOIN qt USING (term) CROSS JOIN n UNION ALL SELECT doc_id, 2.0 FROM pt) GROUP BY 1),
lexical AS (SELECT doc_id, source, round(s, 6) AS score FROM sc JOIN documents USING (doc_id) WHERE s > 0)
"""


def _lexical(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    q = spark.createDataFrame([(0, QUERY)], "query_id int, query string")
    return R.tfidf(docs, q, "doc_id", "text", path_col="source").drop("query_id").join(docs.select("doc_id", "source"), "doc_id")


@query("x5_tfidf_topk", f"WITH {LEXICAL} SELECT doc_id, score FROM lexical ORDER BY score DESC, source, doc_id LIMIT 8")
def x5(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(_lexical(spark, sf), 8, [F.desc("score"), "source", "doc_id"]).select("doc_id", "score")


@query("a6_term_frequency", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY ALL")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return R.term_counts(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query("a5_document_frequency", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY 1")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return R.document_frequency(R.term_counts(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text"))


COS = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))))"
DENSE = f"dense AS (SELECT e.vec_id, max({COS}) AS dense FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id % 100 = 0) v GROUP BY 1)"


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return R.dense_scores(e, e.filter("vec_id % 100 = 0").select(F.col("embedding").alias("query_vector")), "vec_id", "embedding")


@query("x6_cosine", f"WITH {DENSE} SELECT vec_id, round(dense, 6) AS dense FROM dense")
def x6(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf).withColumn("dense", F.round("dense", 6))


@query("w3_dense_topk", f"WITH {DENSE} SELECT vec_id, round(dense, 6) AS dense FROM dense ORDER BY round(dense, 6) DESC, vec_id LIMIT 10")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(_dense(spark, sf).withColumn("dense", F.round("dense", 6)), 10, [F.desc("dense"), "vec_id"])


TOP = "l AS (SELECT doc_id, score FROM lexical ORDER BY score DESC, source, doc_id LIMIT 100), d AS (SELECT vec_id AS doc_id, dense FROM dense ORDER BY round(dense, 6) DESC, 1 LIMIT 100)"


def _tops(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lexical = R.top_k(_lexical(spark, sf), 100, [F.desc("score"), "source", "doc_id"]).select("doc_id", "score")
    dense = R.top_k(_dense(spark, sf).select(F.col("vec_id").alias("doc_id"), "dense"), 100, [F.desc(F.round("dense", 6)), "doc_id"])
    return lexical, dense


@query("x7_fusion", f"WITH {LEXICAL}, {DENSE}, {TOP} SELECT doc_id, round(0.45 * coalesce(score, 0) / (SELECT coalesce(max(score), 1) FROM l) + 0.55 * greatest(0, coalesce(dense, 0)), 6) AS score FROM l FULL JOIN d USING (doc_id)")
def x7(spark: SparkSession, sf: str) -> DataFrame:
    return R.fused(*_tops(spark, sf), "doc_id")


@query("w2_hybrid_topk", f"WITH {LEXICAL}, {DENSE}, {TOP}, f AS (SELECT doc_id, round(0.45 * coalesce(score, 0) / (SELECT coalesce(max(score), 1) FROM l) + 0.55 * greatest(0, coalesce(dense, 0)), 6) AS score FROM l FULL JOIN d USING (doc_id)) SELECT doc_id, score FROM f ORDER BY score DESC, doc_id LIMIT 12")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(R.fused(*_tops(spark, sf), "doc_id"), 12, [F.desc("score"), "doc_id"])


@query("x8_candidate_fusion", f"WITH {LEXICAL}, {DENSE}, {TOP}, f AS (SELECT doc_id, round(0.45 * score / (SELECT coalesce(max(score), 1) FROM l) + 0.55 * coalesce(dense.dense, 0), 6) AS score FROM l LEFT JOIN dense ON vec_id = doc_id) SELECT * FROM f WHERE score > 0")
def x8(spark: SparkSession, sf: str) -> DataFrame:
    dense = _dense(spark, sf).select(F.col("vec_id").alias("doc_id"), "dense")
    return R.fused_candidates(_tops(spark, sf)[0], dense, "doc_id")


BLEND = "c AS (SELECT doc_id, score, coalesce(dense.dense, 0) AS rerank FROM l LEFT JOIN dense ON vec_id = doc_id), s AS (SELECT min(score) AS a, max(score) AS b, min(rerank) AS x, max(rerank) AS y FROM c), b AS (SELECT doc_id, round(0.5 * CASE WHEN a = b THEN 0 ELSE (score - a) / (b - a) END + 0.5 * CASE WHEN x = y THEN 0 ELSE (rerank - x) / (y - x) END, 6) AS blend FROM c CROSS JOIN s)"


@query("x9_blend", f"WITH {LEXICAL}, {DENSE}, {TOP}, {BLEND} SELECT doc_id, blend FROM b ORDER BY blend DESC, doc_id LIMIT 40")
def x9(spark: SparkSession, sf: str) -> DataFrame:
    dense = _dense(spark, sf).select(F.col("vec_id").alias("doc_id"), F.col("dense").alias("rerank"))
    c = _tops(spark, sf)[0].join(dense, "doc_id", "left").fillna(0.0, ["rerank"])
    b = R.blended(c, "score", "rerank", 0.5).select("doc_id", F.round("blend", 6).alias("blend"))
    return R.top_k(b, 40, [F.desc("blend"), "doc_id"])


@query("w4_reranked_topk", "SELECT user_id, event_id, round(value, 0) AS score FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(value, 0) DESC, event_id) <= 5")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "events").select("user_id", "event_id", F.round("value", 0).alias("score"))
    return R.reranked(c, "user_id", "score", "event_id", 5).drop("rank")


# Metrics: per benchmark item, the documents ranked by shared tokens; gold are the labelled good ones.
RANKED = f"""
bq AS (SELECT item_id, unnest({TERMS.replace('text', 'b.text')}) AS term FROM benchmark b), bt AS (SELECT DISTINCT item_id, term FROM bq),
dt AS (SELECT DISTINCT doc_id, unnest({TERMS}) AS term FROM documents), ov AS (SELECT item_id, doc_id, count(*) AS n FROM bt JOIN dt USING (term) GROUP BY ALL),
ch AS (SELECT item_id, doc_id, source AS file, n_chars, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM ov JOIN documents USING (doc_id) QUALIFY rank <= 50),
gold AS (SELECT DISTINCT item_id, source AS file FROM (SELECT DISTINCT item_id FROM ch) CROSS JOIN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 1)),
fr AS (SELECT item_id, file, row_number() OVER (PARTITION BY item_id ORDER BY min(rank), file) AS rank FROM ch GROUP BY item_id, file),
jr AS (SELECT fr.*, CASE WHEN g.file IS NULL THEN 0 ELSE 1 END AS rel, ng.n_gold FROM fr LEFT JOIN gold g USING (item_id, file) JOIN (SELECT item_id, count(*) AS n_gold FROM gold GROUP BY 1) ng USING (item_id))
"""


def _ranking(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(the 50 best documents of each item, the files that are good for all items)."""
    terms = lambda df, key: df.select(key, F.array_distinct(T.code_tokens(F.col("text"))).alias("terms"))
    docs = table(spark, sf, "documents")
    best = R.most_shared(terms(docs, "doc_id"), terms(table(spark, sf, "benchmark"), "item_id"), "doc_id", "item_id", 50)
    top = best.join(docs.select("doc_id", F.col("source").alias("file"), "n_chars"), "doc_id")
    return top, docs.join(table(spark, sf, "labels").filter("quality = 1"), "doc_id").select(F.col("source").alias("file")).distinct()


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    top, gold = _ranking(spark, sf)
    return M.judged(M.file_ranks(top, "item_id", "file", "rank"), gold, "item_id", "file")


@query("w5_file_ranks", f"WITH {RANKED} SELECT item_id, file, rank, rel, n_gold FROM jr")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("item_id", "file", F.col("rank").cast("long").alias("rank"), "rel", "n_gold")


@query("w6_recall_precision", f"WITH {RANKED} SELECT item_id, " + ", ".join(f"sum(rel) FILTER (rank <= {k}) / max(n_gold) AS recall_{k}, sum(rel) FILTER (rank <= {k}) > 0 AS hit_{k}, sum(rel) FILTER (rank <= {k}) / {k} AS precision_{k}" for k in M.CUTOFFS) + " FROM jr GROUP BY 1")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    m = M.measured(_judged(spark, sf), "item_id")
    return m.select("item_id", *[f"{n}_{k}" for k in M.CUTOFFS for n in ("recall", "hit", "precision")])


@query("w7_ndcg", f"WITH {RANKED} SELECT item_id, " + ", ".join(f"round(sum(rel / log2(rank + 1)) FILTER (rank <= {k}) / list_sum(list_transform(range(1, least(max(n_gold), {k}) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_{k}" for k in M.CUTOFFS) + " FROM jr GROUP BY 1")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    return M.measured(_judged(spark, sf), "item_id").select("item_id", *[f"ndcg_{k}" for k in M.CUTOFFS])


@query("w8_mrr", f"WITH {RANKED} SELECT item_id, coalesce(1 / min(CASE WHEN rel = 1 THEN rank END), 0) AS mrr FROM jr GROUP BY 1")
def w8(spark: SparkSession, sf: str) -> DataFrame:
    return M.measured(_judged(spark, sf), "item_id").select("item_id", "mrr")


@query("w10_context_efficiency", f"WITH {RANKED}, r AS (SELECT ch.*, CASE WHEN g.file IS NULL THEN 0 ELSE 1 END AS rel FROM ch LEFT JOIN gold g USING (item_id, file)) SELECT item_id, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(ceil(sum(n_chars) / 4) AS BIGINT) AS tokens, round(sum(CASE WHEN rel = 0 THEN n_chars ELSE 0 END) / sum(n_chars), 6) AS irrelevant_rate, round(sum(rel) * 1000 / ceil(sum(n_chars) / 4), 6) AS hits_per_1000_tokens FROM r GROUP BY 1")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    top, gold = _ranking(spark, sf)
    return M.context_efficiency(M.judged(top, gold, "item_id", "file"), "item_id", "n_chars")


@query("j9_relevance_flag", f"WITH {RANKED} SELECT item_id, doc_id, CASE WHEN g.file IS NULL THEN 0 ELSE 1 END AS rel FROM ch LEFT JOIN gold g USING (item_id, file)")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    top, gold = _ranking(spark, sf)
    return M.judged(top, gold, "item_id", "file").select("item_id", "doc_id", "rel")


@query("w13_budget_packing", "WITH b AS (SELECT source, doc_id, text, row_number() OVER w AS rank, sum(length(text)) OVER w AS e FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) QUALIFY rank <= 200), t AS (SELECT *, 12000 - (e - length(text)) AS l FROM b) SELECT source, doc_id, rank, md5(CASE WHEN e <= 12000 THEN text ELSE substr(text, 1, CAST(l - 15 AS INT)) || chr(10) || '...[truncated]' END) AS taken_md5, CAST(least(e, 12000) AS BIGINT) AS used FROM t WHERE e <= 12000 OR l > 35")
def w13(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's first 200 documents stand for the candidates of a query."""
    top = R.top_k(table(spark, sf, "documents").select("source", "doc_id", "text"), 200, [F.col("doc_id")], ["source"])
    p = R.packed_blocks(top, ["source"], [F.col("doc_id")], "text")
    return p.select("source", "doc_id", F.col("rank").cast("long").alias("rank"), F.md5("taken").alias("taken_md5"), F.col("used").cast("long").alias("used"))


@query("w12_interleave", "WITH m AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS r FROM part QUALIFY r < 40), x AS (SELECT 1000000 + s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS r FROM supplier QUALIFY r < 12) SELECT id, row_number() OVER (ORDER BY k, id) - 1 AS place FROM (SELECT id, r * 10 AS k FROM m UNION ALL SELECT id, r * 30 + 5 FROM x)")
def w12(spark: SparkSession, sf: str) -> DataFrame:
    """The best 40 of one list with the best 12 of another: a context's candidates, which are bounded by their top-k."""

    def best(df: DataFrame, key: str, by: str, k: int) -> DataFrame:
        top = R.top_k(df, k, [F.desc(by), F.col(key)])
        return R.top_k(top.withColumn("_all", F.lit(0)), k, [F.desc(by), F.col(key)], ["_all"]).select(F.col(key).alias("id"), (F.col("rank") - 1).alias("rank"))

    main, extra = best(table(spark, sf, "part"), "p_partkey", "p_retailprice", 40), best(table(spark, sf, "supplier"), "s_suppkey", "s_acctbal", 12)
    return R.interleaved(main, extra.withColumn("id", F.col("id") + 1000000)).select("id", F.col("place").cast("long").alias("place"))


SYMBOLS = r"c AS (SELECT doc_id, source, text, regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]{5,}', 0) AS symbol FROM documents), t AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS symbol FROM c)"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "text", F.regexp_extract("text", "[A-Za-z_][A-Za-z0-9_]{5,}", 0).alias("symbol"))


@query("j4_symbol_references", f"WITH {SYMBOLS} SELECT DISTINCT s.symbol, t.doc_id, t.source FROM (SELECT * FROM c WHERE doc_id % 100 = 0 AND symbol <> '') s JOIN t ON t.symbol = s.symbol AND t.source <> s.source")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf)
    return R.references(c.filter("doc_id % 100 = 0"), c, "doc_id", "source", "symbol", "text")


@query("j5_same_file_calls", f"WITH {SYMBOLS} SELECT a.doc_id AS seed_id, b.doc_id FROM (SELECT * FROM c WHERE doc_id % 100 = 0) a JOIN c b ON a.source = b.source AND a.doc_id <> b.doc_id WHERE (b.symbol <> '' AND list_contains(regexp_extract_all(a.text, '[A-Za-z_][A-Za-z0-9_]*'), b.symbol)) OR (a.symbol <> '' AND list_contains(regexp_extract_all(b.text, '[A-Za-z_][A-Za-z0-9_]*'), a.symbol))")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf)
    return R.same_file(c.filter("doc_id % 100 = 0"), c, "doc_id", "source", "symbol", "text")
