"""Runnable queries of the search operators, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import vector as V
from corpuslens.operators import lexical_index as L
from corpuslens.operators import metrics as M
from corpuslens.operators import ordering as O
from corpuslens.operators import retrieval as R
from corpuslens.operators import vector_index as X
from corpuslens.plans import twin as S
from corpuslens.plans.registry import query
from corpuslens.session import fresh_path
from corpuslens.sources import views
from corpuslens.sources.readers import write_table
from corpuslens.sources.tables import table

KEYS = ["doc_id", "chunk_index"]
K = 10


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def lexical(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    return R.bm25_topk(views.queries(spark, sf), views.chunks(spark, sf), KEYS, k)


def overlap(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    return R.term_overlap_topk(views.queries(spark, sf), views.chunks(spark, sf), KEYS, k)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def dense(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    q = views.vector_queries(spark, sf).select("query_id", "embedding")
    return R.dense_topk(q, vectors(spark, sf), k, skip_self=True)


BM25_CTES = S.ctes(S.CHUNKS, S.QUERIES, S.bm25("v_chunks", "doc_id, chunk_index", K))


@query("r3_bm25_topk", BM25_CTES + "SELECT query_id, doc_id, chunk_index, round(score,6) AS score, CAST(rank AS INT) AS rank FROM bm_top")
def bm25_topk(spark, sf):
    return lexical(spark, sf).select("query_id", *KEYS, r6("score"), "rank")


@query("r3_bm25_indexed", BM25_CTES + "SELECT query_id, doc_id, chunk_index, round(score,6) AS score, CAST(rank AS INT) AS rank FROM bm_top")
def bm25_indexed(spark, sf):
    """The same from the stored index: texts are read when it is built, not when it is searched."""
    path = fresh_path(spark, "lexical-index")
    L.build_lexical_index(views.chunks(spark, sf), path, KEYS)
    best, _ = L.search_lexical_index(spark, path, views.queries(spark, sf), KEYS, K)
    return best.select("query_id", *KEYS, r6("score"), "rank")


PAGES_SQL = (
    S.ctes(
        S.PAGES,
        "v_lq AS (SELECT item_id AS query_id, text AS query_text, l.lang FROM benchmark CROSS JOIN (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l)",
        S.bm25("v_pages", "doc_id, page", K, k1=1.2, dedupe=False, scope="lang", floor=False, queries="v_lq"),
    ).replace("sum(qtf", "lang, sum(qtf").replace("GROUP BY query_id, doc_id, page)", "GROUP BY query_id, lang, doc_id, page)").replace(
        "PARTITION BY query_id ORDER", "PARTITION BY query_id, lang ORDER"
    )
    + "SELECT query_id, lang, doc_id, page, round(score,6) AS score, CAST(rank AS INT) AS rank FROM bm_top"
)


def language_queries(spark: SparkSession, sf: str) -> DataFrame:
    langs = table(spark, sf, "documents").agg(F.collect_set("lang").alias("_langs"))  # one row, as long as there are languages
    q = views.queries(spark, sf).crossJoin(F.broadcast(langs)).withColumn("lang", F.explode("_langs")).drop("_langs")
    return q.withColumn("query_id", F.concat_ws("|", "query_id", "lang"))


def by_language(top: DataFrame) -> DataFrame:
    part = F.split("query_id", r"\|")
    return top.select(
        part[0].cast("long").alias("query_id"), part[1].alias("lang"), "doc_id", F.col("page").cast("long").alias("page"), r6("score"), "rank"
    )


@query("r4_bm25_pages", PAGES_SQL)
def bm25_pages(spark, sf):
    """Each query searches the pages of one language scope at a time, statistics per scope."""
    return by_language(R.bm25_topk(language_queries(spark, sf), views.pages(spark, sf), ["doc_id", "page"], K, k1=1.2, dedupe_query_terms=False, scope=["lang"], floor_average=False))


@query("r4_bm25_pages_indexed", PAGES_SQL)
def bm25_pages_indexed(spark, sf):
    """The same from a stored index with statistics for each language."""
    path = fresh_path(spark, "page-index")
    L.build_lexical_index(views.pages(spark, sf), path, ["doc_id", "page"], k1=1.2, scope=["lang"], floor_average=False)
    best, _ = L.search_lexical_index(spark, path, language_queries(spark, sf), ["doc_id", "page"], K, scope=["lang"], dedupe_query_terms=False)
    return by_language(best)


@query("r1_dense_topk", S.ctes(S.dense(K)) + "SELECT query_id, vec_id, round(score,6) AS score, CAST(rank AS INT) AS rank FROM de_top")
def dense_topk(spark, sf):
    return dense(spark, sf).select("query_id", "vec_id", r6("score"), "rank")


@query("r1_dense_topk_blocked", S.ctes(S.dense(5)) + "SELECT query_id, vec_id, round(score,6) AS score, CAST(rank AS INT) AS rank FROM de_top")
def dense_topk_blocked(spark, sf):
    """The path for query sets above the broadcast bound."""
    q = views.vector_queries(spark, sf).select("query_id", "embedding")
    return R.dense_topk(q, vectors(spark, sf), 5, skip_self=True, max_broadcast=0).select("query_id", "vec_id", r6("score"), "rank")


@query(
    "r2_dense_topk_approx",
    "SELECT vec_id AS query_id, least(10, n - 1) AS found, n AS indexed, true AS recall_reached FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id % 100 = 0",
)
def dense_topk_approx(spark, sf):
    """Results from the stored index of each vector whose id 100 divides, vectors indexed, and whether their mean recall is 0.9."""
    path = fresh_path(spark, "vector-index")
    X.build_vector_index(vectors(spark, sf), path, dim=64)
    asks = vectors(spark, sf).filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    near = X.search_vector_index(spark, path, asks, K, X.probes_for(spark, path, K, 0.97), skip_self=True)
    near = write_table(near.select("query_id", F.col("vec_id").alias("item")), fresh_path(spark, "near"))
    exact = R.dense_topk(asks, vectors(spark, sf), K, skip_self=True).select("query_id", F.col("vec_id").alias("item"))
    recall = M.evidence_recall(exact, near, "item", "recall").agg(F.avg("recall") >= 0.9)
    indexed = X.indexed_vectors(spark, path).select("n_vectors")
    found = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    return found.select("query_id", "found", indexed.scalar().alias("indexed"), recall.scalar().alias("recall_reached"))


OVERLAP_CTES = S.ctes(S.CHUNKS, S.QUERIES, S.overlap("v_chunks", "doc_id, chunk_index", K))


@query("r9_term_overlap_topk", OVERLAP_CTES + "SELECT query_id, doc_id, chunk_index, overlap, CAST(rank AS INT) AS rank FROM ov_top")
def term_overlap_topk(spark, sf):
    return overlap(spark, sf).select("query_id", *KEYS, "overlap", "rank")


FUSION_CTES = (
    S.CHUNKS,
    S.QUERIES,
    S.bm25("v_chunks", "doc_id, chunk_index", K),
    S.overlap("v_chunks", "doc_id, chunk_index", K),
    "both_r AS (SELECT query_id, doc_id, chunk_index, 0 AS ordinal, rank FROM bm_top UNION ALL "
    "SELECT query_id, doc_id, chunk_index, 1 AS ordinal, rank FROM ov_top)",
    S.rrf("both_r", "doc_id, chunk_index", K),
)


def two_rankings(spark, sf) -> DataFrame:
    a = lexical(spark, sf).select("query_id", *KEYS, "rank", F.lit(0).alias("ordinal"))
    b = overlap(spark, sf).select("query_id", *KEYS, "rank", F.lit(1).alias("ordinal"))
    return O.union_stages(a, b)


@query("r5_rrf_fuse", S.ctes(*FUSION_CTES) + "SELECT query_id, doc_id, chunk_index, round(score,6) AS score, CAST(rank AS INT) AS rank FROM rrf_top")
def rrf_fuse(spark, sf):
    return R.rrf_fuse(two_rankings(spark, sf), KEYS, K).select("query_id", *KEYS, r6("score"), "rank")


@query(
    "u1_union_stages",
    S.ctes(*FUSION_CTES) + "SELECT ordinal, CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT query_id) AS n_queries, CAST(max(rank) AS INT) AS deepest FROM both_r GROUP BY ordinal",
)
def union_stages(spark, sf):
    return two_rankings(spark, sf).groupBy("ordinal").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("query_id").alias("n_queries"), F.max("rank").alias("deepest")
    )


# Chunks as the vector side: a document's chunks share the vector of (doc_id mod number of vectors).
HYBRID = (
    S.dense(K),
    "dr AS (SELECT query_id, vec_id AS doc_id, 0 AS ordinal, rank, score FROM de_top)",
    "lab AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, CASE WHEN a.label=b.label THEN 1.0 ELSE 0.0 END + 1.0/(1+abs(a.vec_id-b.vec_id)) AS score "
    "FROM embeddings a JOIN embeddings b ON abs(a.vec_id-b.vec_id) BETWEEN 1 AND 20)",
    "lr AS (SELECT query_id, doc_id, 1 AS ordinal, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, doc_id) AS rank FROM lab) WHERE rank<=10)",
    "hr AS (SELECT * FROM dr UNION ALL SELECT * FROM lr)",
    S.rrf("hr", "doc_id", K),
)


def neighbour_ranking(spark, sf) -> DataFrame:
    """A second ranking of vectors by label agreement and id distance, within twenty ids."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    near = e.select("vec_id", "label", F.explode(F.sequence(F.col("vec_id") - 20, F.col("vec_id") + 20)).alias("o"))
    other = e.select(F.col("vec_id").alias("o"), F.col("label").alias("_l2"))
    gap = F.abs(F.col("vec_id") - F.col("o"))
    s = near.filter(gap > 0).join(other, "o").select(
        F.col("vec_id").alias("query_id"),
        F.col("o").alias("doc_id"),
        (F.when(F.col("label") == F.col("_l2"), 1.0).otherwise(0.0) + 1.0 / (1 + gap)).alias("score"),
    )
    return O.topk_scored(s, ["query_id"], "score", ["doc_id"], K)


def hybrid_frame(spark, sf) -> DataFrame:
    d = write_table(dense(spark, sf).withColumnRenamed("vec_id", "doc_id"), fresh_path(spark, "dense"))  # searched once, ranked twice
    return R.hybrid_search(d, neighbour_ranking(spark, sf), ["doc_id"], K)


@query(
    "r6_hybrid_search",
    S.ctes(*HYBRID)
    + "SELECT 'dense' AS stage, query_id, doc_id, CAST(rank AS INT) AS rank, round(score,6) AS score FROM dr UNION ALL "
    "SELECT 'lexical', query_id, doc_id, CAST(rank AS INT), round(score,6) FROM lr UNION ALL "
    "SELECT 'hybrid', query_id, doc_id, CAST(rank AS INT), round(score,6) FROM rrf_top",
)
def hybrid_search(spark, sf):
    return hybrid_frame(spark, sf).select("stage", "query_id", "doc_id", "rank", r6("score"))


# The rewrite of a query is its word-reversed text; document language alternates so only some need it.
REWRITES = (
    S.QUERIES,
    "v_rw AS (SELECT query_id, query_text, CASE query_id % 4 WHEN 0 THEN 'fa' WHEN 1 THEN 'en' WHEN 2 THEN NULL ELSE 'fa' END AS scope_language, "
    "CASE WHEN query_id % 4 = 3 THEN chr(1587) || chr(1604) || chr(1575) || chr(1605) || ' ' || query_text ELSE query_text END AS rewrite FROM v_queries)",
    "v_st AS (SELECT *, CASE WHEN scope_language IS NULL OR scope_language NOT IN ('fa','en') OR scope_language = 'en' THEN 'not_needed' "
    "WHEN rewrite <> query_text AND regexp_matches(rewrite, '[" + S.AR + "]') THEN 'success' ELSE 'fallback' END AS rewrite_status FROM v_rw)",
)


def rewrite_queries(spark, sf) -> DataFrame:
    q = views.queries(spark, sf)
    m = F.col("query_id") % 4
    return q.withColumns(
        {
            "scope_language": F.when(m == 0, "fa").when(m == 1, "en").when(m == 3, "fa"),
            "rewrite": F.when(m == 3, F.concat(F.lit("سلام "), F.col("query_text"))).otherwise(F.col("query_text")),
        }
    )


@query(
    "r7_rewrite_fuse",
    S.ctes(
        S.CHUNKS,
        *REWRITES,
        S.bm25("v_chunks", "doc_id, chunk_index", K),
        "v_again AS (SELECT query_id, rewrite AS query_text FROM v_st WHERE rewrite_status='success')",
        S.bm25("v_chunks", "doc_id, chunk_index", K, queries="v_again", name="rw"),
        "fr AS (SELECT query_id, doc_id, chunk_index, 0 AS ordinal, rank FROM bm_top SEMI JOIN v_again USING (query_id) UNION ALL "
        "SELECT query_id, doc_id, chunk_index, 1, rank FROM rw_top)",
        S.rrf("fr", "doc_id, chunk_index", K),
    )
    + "SELECT query_id, doc_id, chunk_index, CAST(rank AS INT) AS rank, round(score,6) AS score FROM rrf_top UNION ALL "
    "SELECT query_id, doc_id, chunk_index, CAST(rank AS INT), round(score,6) FROM bm_top ANTI JOIN v_again USING (query_id)",
)
def rewrite_fuse(spark, sf):
    q = rewrite_queries(spark, sf)
    st = q.withColumn("rewrite_status", R.rewrite_status(F.col("query_text"), F.col("rewrite"), F.col("scope_language")))
    again = st.filter("rewrite_status = 'success'").select("query_id", F.col("rewrite").alias("query_text"))
    second = R.bm25_topk(again, views.chunks(spark, sf), KEYS, K)
    return R.rewrite_fuse(lexical(spark, sf), second, st, KEYS, K).select("query_id", *KEYS, "rank", r6("score"))


RETRIEVE = (
    S.CHUNKS,
    *REWRITES,
    S.bm25("v_chunks", "doc_id, chunk_index", 20),
    "v_again AS (SELECT query_id, rewrite AS query_text FROM v_st WHERE rewrite_status='success')",
    S.bm25("v_chunks", "doc_id, chunk_index", 20, queries="v_again", name="rw"),
    "fr AS (SELECT query_id, doc_id, chunk_index, 0 AS ordinal, rank FROM bm_top SEMI JOIN v_again USING (query_id) UNION ALL "
    "SELECT query_id, doc_id, chunk_index, 1, rank FROM rw_top)",
    S.rrf("fr", "doc_id, chunk_index", 20),
    "cand AS (SELECT query_id, doc_id, chunk_index, rank FROM rrf_top UNION ALL SELECT query_id, doc_id, chunk_index, rank FROM bm_top ANTI JOIN v_again USING (query_id))",
    "pq AS (SELECT query_id, query_text || CASE WHEN rewrite_status='success' THEN chr(10) || rewrite ELSE '' END AS pair_query FROM v_st)",
    "ext AS (SELECT query_id, doc_id, chunk_index, (31 * length(pair_query) + 7 * length(text)) % 101 AS es FROM cand JOIN v_chunks USING (doc_id, chunk_index) JOIN pq USING (query_id) WHERE length(pair_query) % 5 <> 0)",
    "rr AS (SELECT query_id, doc_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY es DESC NULLS LAST, rank) AS rank "
    "FROM cand LEFT JOIN ext USING (query_id, doc_id, chunk_index))",
    "rr20 AS (SELECT * FROM rr WHERE rank <= 20)",
    "par AS (SELECT r.*, c.source || '/' || (r.chunk_index // 4) AS p FROM rr20 r JOIN v_chunks c ON c.doc_id=r.doc_id AND c.chunk_index=r.chunk_index)",
    "parn AS (SELECT *, (SELECT count(DISTINCT (b.doc_id, b.p)) FROM par b WHERE b.query_id=a.query_id) AS np, "
    "row_number() OVER (PARTITION BY query_id, doc_id, p ORDER BY rank) AS nth FROM par a)",
    "fin AS (SELECT query_id, doc_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM parn WHERE np <= 1 OR nth <= 2)",
)


def length_model():
    """Stand-in for a model: a score from the lengths of both texts; it has no answer for every fifth query length."""

    def score(queries: list[str], texts: list[str]) -> list[float]:
        return [float((31 * len(q) + 7 * len(t)) % 101) for q, t in zip(queries, texts, strict=True) if len(q) % 5]

    return score


def run_retrieve(spark, sf):
    chunks = views.chunks(spark, sf)
    search = lambda q, k: R.bm25_topk(q, chunks, KEYS, k)
    parents = chunks.select(*KEYS, "text", F.concat_ws("/", "source", F.floor(F.col("chunk_index") / 4).cast("string")).alias("parent_id"))
    return R.retrieve(rewrite_queries(spark, sf), search, KEYS, 20, K, chunks=parents, score=("lengths", length_model))


@query(
    "r8_retrieve",
    S.ctes(*RETRIEVE)
    + "SELECT f.query_id, f.doc_id, f.chunk_index, CAST(f.rank AS INT) AS rank, s.rewrite_status, "
    "CASE WHEN s.rewrite_status='success' THEN 2 ELSE 1 END AS search_count, 1 AS reranker_count FROM fin f JOIN v_st s USING (query_id) WHERE f.rank <= 10",
)
def retrieve(spark, sf):
    final, telemetry = run_retrieve(spark, sf)
    return final.join(telemetry, "query_id").select(
        "query_id", *KEYS, "rank", "rewrite_status", "search_count", "reranker_count"
    )


@query(
    "j11_rerank_with_scores",
    S.ctes(
        S.CHUNKS, S.QUERIES, S.bm25("v_chunks", "doc_id, chunk_index", 20),
        "ext AS (SELECT query_id, doc_id, chunk_index, CAST((doc_id * 31 + chunk_index * 7) % 101 AS DOUBLE) AS es FROM bm_top WHERE query_id % 3 <> 0 AND doc_id % 4 <> 0)",
        "rr AS (SELECT query_id, doc_id, chunk_index, es, row_number() OVER (PARTITION BY query_id ORDER BY es DESC NULLS LAST, rank) AS rank "
        "FROM bm_top LEFT JOIN ext USING (query_id, doc_id, chunk_index))",
    )
    + "SELECT query_id, doc_id, chunk_index, es AS rerank_score, CAST(rank AS INT) AS rank FROM rr WHERE rank <= 10",
)
def rerank_with_scores(spark, sf):
    cand = lexical(spark, sf, R.overfetch(20, K))
    ext = cand.filter((F.col("query_id") % 3 != 0) & (F.col("doc_id") % 4 != 0)).select(
        "query_id", *KEYS, ((F.col("doc_id") * 31 + F.col("chunk_index") * 7) % 101).cast("double").alias("score")
    )
    return R.rerank_with_scores(cand, ext, KEYS, K).select("query_id", *KEYS, "rerank_score", "rank")


@query(
    "t4_diversify",
    S.ctes(
        S.CHUNKS, S.QUERIES, S.bm25("v_chunks", "doc_id, chunk_index", 20),
        "par AS (SELECT r.*, c.source || '/' || (r.chunk_index // 4) AS p FROM bm_top r JOIN v_chunks c ON c.doc_id=r.doc_id AND c.chunk_index=r.chunk_index)",
        "parn AS (SELECT *, (SELECT count(DISTINCT (b.doc_id, b.p)) FROM par b WHERE b.query_id=a.query_id) AS np, "
        "row_number() OVER (PARTITION BY query_id, doc_id, p ORDER BY rank) AS nth FROM par a)",
        "fin AS (SELECT query_id, doc_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM parn WHERE np <= 1 OR nth <= 2)",
    )
    + "SELECT query_id, doc_id, chunk_index, CAST(rank AS INT) AS rank FROM fin WHERE rank <= 10",
)
def diversify(spark, sf):
    parents = views.chunks(spark, sf).select(
        *KEYS, F.concat_ws("/", "source", F.floor(F.col("chunk_index") / 4).cast("string")).alias("parent_id")
    )
    return R.diversify(lexical(spark, sf, 20).join(parents, KEYS), K).select("query_id", *KEYS, "rank")


@query("t1_topk_per_query", S.ctes(S.dense(3, skip_self=False)) + "SELECT query_id, vec_id, round(score,6) AS score, CAST(rank AS INT) AS rank FROM de_top")
def topk_per_query(spark, sf):
    q = views.vector_queries(spark, sf).select("query_id", "embedding")
    wide = R.dense_topk(q, vectors(spark, sf), 12).drop("rank")
    return O.topk_scored(wide, ["query_id"], "score", ["vec_id"], 3).select("query_id", "vec_id", r6("score"), "rank")


IR = (S.CHUNKS, S.QUERIES, S.QRELS, S.bm25("v_chunks", "doc_id, chunk_index", K),
      "v_run AS (SELECT query_id, doc_id AS item, rank FROM bm_top)")


def doc_run(spark, sf) -> DataFrame:
    """BM25 chunk ranking read as a document ranking; repeats stay, as the metrics define them."""
    return lexical(spark, sf).select("query_id", F.col("doc_id").alias("item"), "rank")


@query("r11_evaluate_run", S.ctes(*IR, S.ir_metrics("v_qrels", "v_run")) + f"SELECT query_id, {S.rounded(S.metric_names())} FROM ir_scores")
def evaluate_run(spark, sf):
    s = M.evaluate_run(views.qrels(spark, sf), doc_run(spark, sf))
    return s.select("query_id", *[r6(n) for n in M.metric_names()])


@query(
    "r11_evaluate_run_means",
    S.ctes(*IR, S.ir_metrics("v_qrels", "v_run"))
    + "SELECT count(*) AS query_count, " + ", ".join(f"round(avg({n}),6) AS {n}" for n in S.metric_names()) + " FROM ir_scores",
)
def evaluate_run_means(spark, sf):
    s = M.mean_metrics(M.evaluate_run(views.qrels(spark, sf), doc_run(spark, sf)), M.metric_names())
    return s.select("query_count", *[r6(n) for n in M.metric_names()])


TREC = (
    *HYBRID,
    "v_vqrels AS (SELECT a.vec_id AS query_id, b.vec_id AS item, 1 AS grade FROM embeddings a JOIN embeddings b ON a.label=b.label AND a.vec_id<>b.vec_id)",
    "v_runs AS (SELECT 'dense' AS stage, query_id, doc_id AS item, rank FROM dr UNION ALL SELECT 'lexical', query_id, doc_id, rank FROM lr UNION ALL "
    "SELECT 'hybrid', query_id, doc_id, rank FROM rrf_top)",
)


@query(
    "r12_evaluate_run_trec",
    S.ctes(
        *TREC,
        "q2 AS (SELECT s.stage || '|' || q.query_id AS query_id, q.item, q.grade FROM v_vqrels q JOIN (SELECT DISTINCT stage, query_id FROM v_runs) s USING (query_id))",
        "run2 AS (SELECT stage || '|' || query_id AS query_id, item, rank FROM v_runs)",
        S.ir_metrics("q2", "run2"),
    )
    + "SELECT split_part(query_id,'|',1) AS stage, count(*) AS query_count, " + ", ".join(f"round(avg({n}),6) AS {n}" for n in S.metric_names())
    + " FROM ir_scores GROUP BY 1",
)
def evaluate_run_trec(spark, sf):
    """Vectors that share a label are relevant to each other."""
    runs = hybrid_frame(spark, sf).select("stage", "query_id", F.col("doc_id").alias("item"), "rank")
    s = M.evaluate_stages(table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), "label"), runs)
    return s.select("stage", "query_count", *[r6(n) for n in M.metric_names()])


@query(
    "r13_metric_parity",
    S.ctes(
        *IR, S.ir_metrics("v_qrels", "v_run"),
        "dd AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT query_id, item, min(rank) AS rank FROM v_run GROUP BY ALL))",
        S.ir_metrics("v_qrels", "dd", name="tr"),
        "la AS (UNPIVOT (SELECT * FROM ir_scores) ON COLUMNS(* EXCLUDE query_id) INTO NAME metric VALUE value)",
        "lb AS (UNPIVOT (SELECT * FROM tr_scores) ON COLUMNS(* EXCLUDE query_id) INTO NAME metric VALUE value)",
    )
    + "SELECT query_id, metric, round(la.value,6) AS local, round(lb.value,6) AS standard FROM la JOIN lb USING (query_id, metric) WHERE abs(la.value-lb.value) > 1e-9",
)
def metric_parity(spark, sf):
    qrels, run = views.qrels(spark, sf), doc_run(spark, sf)
    a = M.metrics_long(M.evaluate_run(qrels, run), M.metric_names())
    b = M.metrics_long(M.evaluate_run_trec(qrels, run), M.metric_names())
    return M.metric_parity(a, b, 1e-9).select("query_id", "metric", r6("local"), r6("standard"))


@query(
    "r14_evidence_recall",
    S.ctes(*IR)
    + "SELECT q.query_id, round(count(DISTINCT r.item)::DOUBLE / count(DISTINCT q.item), 6) AS recall FROM v_qrels q "
    "LEFT JOIN v_run r ON r.query_id=q.query_id AND r.item=q.item GROUP BY q.query_id",
)
def evidence_recall(spark, sf):
    return M.evidence_recall(views.qrels(spark, sf), doc_run(spark, sf), "item", "recall").select("query_id", r6("recall"))


@query(
    "r15_page_projection",
    S.ctes(
        S.CHUNKS, S.QUERIES, S.bm25("v_chunks", "doc_id, chunk_index", 20),
        "pp AS (SELECT b.query_id, b.rank, sha256(d.text) || '#page=' || ((b.chunk_index-1)//2) AS item, (b.chunk_index-1)//2 AS page FROM bm_top b JOIN documents d USING (doc_id))",
        "pf AS (SELECT query_id, item, min(rank) AS r FROM pp WHERE page <> 0 GROUP BY ALL)",
    )
    + "SELECT query_id, item, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INT) AS rank FROM pf",
)
def page_projection(spark, sf):
    d = views.docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("doc_hash"))
    ranking = lexical(spark, sf, 20).withColumn("page", F.floor((F.col("chunk_index") - 1) / 2).cast("int"))
    return R.page_projection(ranking.join(d, "doc_id")).select("query_id", "item", "rank")


@query(
    "r10_scope_language",
    "SELECT source, CASE WHEN count(DISTINCT CASE WHEN lang IN ('fa','en') THEN lang END) = 1 THEN max(CASE WHEN lang IN ('fa','en') THEN lang END) "
    "ELSE 'mixed' END AS scope_language FROM documents GROUP BY source",
)
def scope_language(spark, sf):
    return R.scope_language(views.docs(spark, sf), ["source"])


@query(
    "r16_embed_corpus",
    S.ctes(
        S.CHUNKS,
        "tk AS (SELECT doc_id, chunk_index, ('0x' || substring(md5(t),1,8))::BIGINT AS h FROM (SELECT doc_id, chunk_index, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM v_chunks WHERE chunk_index % 3 <> 0))",
        "dm AS (SELECT doc_id, chunk_index, h % 64 AS d, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM tk GROUP BY ALL)",
        "nm AS (SELECT doc_id, chunk_index, CASE WHEN sum(v*v) > 0 THEN sum(d*v)/sqrt(sum(v*v)) ELSE 0 END AS n FROM dm GROUP BY ALL)",
        "rd AS (SELECT doc_id, chunk_index, list_sum(list_transform(range(1, 65), lambda i: ((i-1) * (chunk_index % i))::DOUBLE))/sqrt(list_sum(list_transform(range(1, 65), lambda i: ((chunk_index % i) * (chunk_index % i))::DOUBLE))) AS n FROM v_chunks WHERE chunk_index % 3 = 0)",
    )
    + "SELECT c.doc_id, count(*) AS n, round(sum(coalesce(nm.n, rd.n, 0)), 4) AS weighted FROM v_chunks c LEFT JOIN nm USING (doc_id, chunk_index) LEFT JOIN rd USING (doc_id, chunk_index) GROUP BY c.doc_id",
)
def embed_corpus(spark, sf):
    """Every third chunk arrives with a vector; the hook fills the others. One row per document."""
    c = views.chunks(spark, sf)
    ready = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.col("chunk_index") % i).cast("double"))
    c = c.select(*KEYS, "text", F.when(F.col("chunk_index") % 3 == 0, ready).alias("embedding"))
    e = R.embed_corpus(c, R.hash_embed(64))
    weighted = F.aggregate(F.transform("embedding", lambda v, i: v * i), F.lit(0.0), lambda total, v: total + v)
    return e.groupBy("doc_id").agg(F.count("embedding").alias("n"), F.round(F.sum(F.coalesce(F.nanvl(weighted, F.lit(0.0)), F.lit(0.0))), 4).alias("weighted"))


@query(
    "r16_l2_normalize",
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda u: u::DOUBLE*u::DOUBLE))))), 6) AS unit_sum "
    "FROM embeddings",
)
def l2_normalize(spark, sf):
    unit = V.l2_normalize(F.col("embedding"))
    return vectors(spark, sf).select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, v: a + v), 6).alias("unit_sum"))


@query(
    "p1_scope_filter",
    S.ctes(
        S.CHUNKS, S.QUERIES, "mine AS (SELECT * FROM v_chunks WHERE source = 'src1')",
        S.bm25("mine", "doc_id, chunk_index", K),
    )
    + "SELECT query_id, doc_id, chunk_index, round(score,6) AS score, CAST(rank AS INT) AS rank FROM bm_top",
)
def scope_filter(spark, sf):
    """Statistics and ranks of one owner's chunks only."""
    mine = R.scope_filter(views.chunks(spark, sf).withColumn("owner", F.col("source")), owner="src1")
    return R.bm25_topk(views.queries(spark, sf), mine, KEYS, K).select("query_id", *KEYS, r6("score"), "rank")


FLAG = S.ctes(
    *FUSION_CTES, S.QRELS,
    "par AS (SELECT r.*, c.source || '/' || (r.chunk_index // 4) AS p FROM rrf_top r JOIN v_chunks c ON c.doc_id=r.doc_id AND c.chunk_index=r.chunk_index)",
    "parn AS (SELECT *, (SELECT count(DISTINCT (b.doc_id, b.p)) FROM par b WHERE b.query_id=a.query_id) AS np, "
    "row_number() OVER (PARTITION BY query_id, doc_id, p ORDER BY rank) AS nth FROM par a)",
    "v_run AS (SELECT query_id, doc_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM parn WHERE np <= 1 OR nth <= 2)",
    S.ir_metrics("v_qrels", "v_run"),
) + f"SELECT query_id, {S.rounded(S.metric_names())} FROM ir_scores"


@query("flagship_hybrid_evaluation", FLAG)
def flagship(spark, sf):
    """Two rankings, fused, diversified and scored against passage judgments."""
    fused = R.rrf_fuse(two_rankings(spark, sf), KEYS, K)
    parents = views.chunks(spark, sf).select(
        *KEYS, F.concat_ws("/", "source", F.floor(F.col("chunk_index") / 4).cast("string")).alias("parent_id")
    )
    final = R.diversify(fused.join(parents, KEYS), K)
    scores = M.evaluate_run(views.qrels(spark, sf), final.select("query_id", F.col("doc_id").alias("item"), "rank"))
    return scores.select("query_id", *[r6(n) for n in M.metric_names()])
