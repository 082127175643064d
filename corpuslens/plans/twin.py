"""Building blocks of the SQL twins (DuckDB dialect)."""

from __future__ import annotations

AR = r"\x{0600}-\x{06ff}"
NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def fold(x: str) -> str:
    pairs = ((0x64A, 0x6CC), (0x649, 0x6CC), (0x643, 0x6A9), (0x629, 0x647))
    out = f"coalesce({x},'')"
    for a, b in pairs:
        out = f"replace({out}, chr({a}), chr({b}))"
    return out


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({fold(x)}, '[0-9A-Za-z{AR}]{{2,}}'), lambda t: lower(t))"


def terms(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({fold(x)}), '[0-9a-z{AR}]{{2,}}'))"


def visible(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def compact(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({fold(x)}), '^\\s*#{{1,3}}\\s+', ''), '[^0-9A-Za-z{AR}]+', '', 'g')"


def count_re(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def wilson(n: str, d: str) -> str:
    """value, percentage, wilson_low, wilson_high columns."""
    z = "1.959963984540054::DOUBLE"
    p = f"({n}::DOUBLE/{d}::DOUBLE)"
    sc = f"(1+({z}*{z})/({d}::DOUBLE))"
    center = f"(({p}+({z}*{z})/(2*({d}::DOUBLE)))/{sc})"
    half = f"({z}*sqrt(({p}*(1-{p})+({z}*{z})/(4*({d}::DOUBLE)))/({d}::DOUBLE))/{sc})"
    guard = lambda e: f"CASE WHEN {d} > 0 THEN {e} ELSE 0.0 END"
    return (
        f"round({guard(p)}, 6) AS value, round({guard(p)}*100, 6) AS percentage, "
        f"round({guard(f'greatest(0.0, {center}-{half})')}, 6) AS wilson_low, "
        f"round({guard(f'least(1.0, {center}+{half})')}, 6) AS wilson_high"
    )


LINES = (
    "v_lines AS (SELECT doc_id, lang, source, unnest(range(len(a))) AS line_no, unnest(a) AS line "
    "FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS a FROM documents))"
)

PAGES = (
    "v_pages AS (SELECT doc_id, lang, line_no // 5 + 1 AS page, string_agg(line, chr(10) ORDER BY line_no) AS text "
    f"FROM (SELECT doc_id, lang, unnest(range(len(a))) AS line_no, unnest(a) AS line "
    "FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS a FROM documents)) GROUP BY ALL)"
)

CHUNKS = (
    "v_chunk_raw AS (SELECT doc_id, lang, source, s AS char_start, least(s+800, length(text)) AS char_end, "
    f"{strip('substring(text, s+1, 800)')} AS text "
    "FROM (SELECT doc_id, lang, source, text, unnest(range(0, length(text), 650)) AS s FROM documents)),\n"
    "v_chunks AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) AS chunk_index, "
    "char_start, char_end, text FROM v_chunk_raw WHERE text <> '')"
)

MARKDOWN = (
    LINES
    + ",\nv_markdown AS (SELECT doc_id, lang, source, string_agg("
    "concat_ws(chr(10)||chr(10), CASE WHEN line_no % 5 = 0 THEN '<!-- page:' || (line_no//5+1) || ' -->' END, "
    "CASE WHEN line_no % 20 = 0 THEN '# Chapter ' || (line_no//20+1) END, "
    "CASE WHEN line_no % 20 = 10 THEN '## ' || substring(line,1,40) END, line), chr(10)||chr(10) ORDER BY line_no) AS text "
    "FROM v_lines GROUP BY ALL)"
)

QUERIES = "v_queries AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"


def _shingles(x: str) -> str:
    w = f"regexp_split_to_array(lower({strip(x)}), '\\s+')"
    return f"list_distinct(list_transform(range(1, len({w})-6), lambda i: array_to_string(({w})[i:i+7], ' ')))"


QRELS = (
    "v_words_q AS (SELECT item_id, regexp_split_to_array(lower(" + strip("text") + "), '\\s+') AS w FROM benchmark),\n"
    "v_words_d AS (SELECT doc_id, regexp_split_to_array(lower(" + strip("text") + "), '\\s+') AS w FROM documents),\n"
    "v_runs_q AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') AS run FROM "
    "(SELECT item_id, w, unnest(range(1, len(w)-6)) AS i FROM v_words_q)),\n"
    "v_runs_d AS (SELECT doc_id, array_to_string(w[i:i+7], ' ') AS run FROM "
    "(SELECT doc_id, w, unnest(range(1, len(w)-6)) AS i FROM v_words_d)),\n"
    "v_qrels AS (SELECT DISTINCT item_id AS query_id, doc_id AS item, 2 AS grade FROM v_runs_q JOIN v_runs_d USING (run))"
)

VEC_QUERIES = "v_vq AS (SELECT vec_id AS query_id, embedding, label FROM embeddings)"

USAGE = (
    "v_usage AS (SELECT event_id, event_id // 3 AS request_id, user_id, event_type AS feature, "
    "CASE WHEN event_type IN ('view','click') THEN 'embedding' ELSE 'chat_completion' END AS operation_type, "
    "'p' || (user_id % 3) AS provider, 'vendor/m' || (event_id % 4) || '-large' AS model, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) // 3 AS output_tokens, "
    "CAST(round(value, 2) AS DECIMAL(18,8)) AS cost_usd, round(value*10, 1) AS latency_ms, "
    "CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, ts AS created_at FROM events)"
)

INTERVALS = (
    "v_intervals AS (SELECT o_orderkey AS interval_id, o_custkey AS user_id, o_orderdate AS starts_at, "
    "o_orderdate + INTERVAL 30 DAYS AS expires_at, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'cancelled' END AS status "
    "FROM orders)"
)

EVAL = """v_eval AS (SELECT l.doc_id AS case_id, source, lang AS expected_route,
 CASE WHEN n_chars % 11 = 0 THEN 'xx' ELSE lang END AS actual_route,
 CASE WHEN n_chars % 5 = 0 THEN NULL ELSE lang END AS expected_intent,
 CASE WHEN n_chars % 7 = 0 THEN 'xx' ELSE lang END AS actual_intent,
 CASE n_chars % 3 WHEN 0 THEN 'required' WHEN 1 THEN 'forbidden' ELSE 'allowed' END AS retrieval_policy,
 n_chars % 2 = 0 AS retrieval_called,
 CASE WHEN n_chars % 4 = 0 THEN NULL ELSE n_chars % 4 = 1 END AS rewrite_expected,
 quality = 1 AS rewrite_correct,
 CASE WHEN n_chars % 6 = 0 THEN NULL ELSE n_chars % 6 = 1 END AS reranker_expected,
 n_chars % 6 < 3 AS reranker_called,
 CASE WHEN n_chars % 10 = 0 THEN NULL ELSE n_chars % 10 < 7 END AS citation_required,
 quality = 1 AS citation_valid,
 quality = 1 AND n_chars % 2 = 0 AS citation_document_correct,
 quality = 1 AND toxic = 0 AS citation_page_correct,
 toxic = 0 AS all_required_claims_cited,
 n_chars % 3 = 0 AS contains_numeric_claim,
 n_chars % 3 = 0 AND toxic = 1 AS unsupported_numeric_citation_failure,
 toxic = 1 AS metadata_only_citation_failure,
 quality = 1 AS followup_resolved, toxic = 0 AS history_used_correctly,
 n_chars % 9 <> 0 AS selected_asset_persisted, n_chars % 8 <> 0 AS conversation_id_persisted,
 n_chars % 11 <> 0 AS route_correct,
 CASE WHEN n_chars % 13 = 0 THEN NULL ELSE true END AS evidence_available,
 quality = 1 AS answer_correct, n_chars % 2 = 0 AS required_concepts_covered, toxic = 0 AS grounded,
 n_chars % 5 <> 0 AS citations_correct, true AS output_complete, true AS no_internal_message_exposed,
 quality = 1 AS acceptable_answer_match,
 CASE WHEN n_chars % 2 = 0 THEN 1.0 ELSE 0.5 END AS required_concept_coverage,
 n_chars % 29 = 0 AS normalized_answer_match, toxic = 1 AS forbidden_claim, n_chars % 17 = 0 AS false_refusal, n_chars % 4 <> 3 AS answerable,
 n_chars % 19 = 0 AS truncation, n_chars % 23 = 0 AS generic_failure, n_chars::DOUBLE AS latency_ms
 FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def bm25(pool: str, keys: str, k: int, k1: float = 1.5, b: float = 0.75, dedupe: bool = True, scope: str = "",
         floor: bool = True, queries: str = "v_queries", name: str = "bm") -> str:
    """CTEs ending in <name>_top(query_id, keys, score, rank)."""
    sc = f"{scope}, " if scope else ""
    on = f"USING ({scope}, term)" if scope else "USING (term)"
    stats = (
        f"{name}_stats AS (SELECT {sc}count(*) AS n, avg(len(toks)) AS av FROM {name}_pool "
        + (f"GROUP BY {scope}" if scope else "")
        + ")"
    )
    join_stats = f"JOIN {name}_stats USING ({scope})" if scope else f"CROSS JOIN {name}_stats"
    qtf = "1" if dedupe else "count(*)"
    av = "greatest(av, 1)" if floor else "av"
    return ",\n".join(
        [
            f"{name}_pool AS (SELECT {sc}{keys}, {tokens('text')} AS toks FROM {pool})",
            stats,
            f"{name}_tf AS (SELECT {sc}{keys}, len(toks) AS dl, term, count(*) AS tf FROM "
            f"(SELECT {sc}{keys}, toks, unnest(toks) AS term FROM {name}_pool) GROUP BY ALL)",
            f"{name}_df AS (SELECT {sc}term, count(*) AS df FROM {name}_tf GROUP BY ALL)",
            f"{name}_q AS (SELECT query_id, {sc}term, {qtf} AS qtf FROM "
            f"(SELECT query_id, {sc}unnest({tokens('query_text')}) AS term FROM {queries}) GROUP BY query_id, {sc}term)",
            f"{name}_score AS (SELECT query_id, {keys}, sum(qtf * ln(1+(n-df+0.5)/(df+0.5)) * tf * ({k1}+1)/"
            f"(tf+{k1}*(1-{b}+{b}*dl/{av}))) AS score FROM {name}_tf JOIN {name}_df {on} JOIN {name}_q {on} "
            f"{join_stats} GROUP BY query_id, {keys})",
            f"{name}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
            f"ORDER BY round(score, 9) DESC, {keys}) AS rank FROM {name}_score WHERE score > 0) WHERE rank <= {k})",
        ]
    )


def overlap(pool: str, keys: str, k: int, name: str = "ov") -> str:
    return ",\n".join(
        [
            f"{name}_d AS (SELECT {keys}, unnest({terms('text')}) AS term FROM {pool})",
            f"{name}_q AS (SELECT query_id, unnest({terms('query_text')}) AS term FROM v_queries)",
            f"{name}_s AS (SELECT query_id, {keys}, count(*) AS overlap FROM {name}_d JOIN {name}_q USING (term) GROUP BY ALL)",
            f"{name}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, {keys}) AS rank "
            f"FROM {name}_s) WHERE rank <= {k})",
        ]
    )


def rrf(source: str, keys: str, k: int, name: str = "rrf") -> str:
    """source has query_id, ordinal, rank, keys. Ends in <name>_top."""
    return ",\n".join(
        [
            f"{name}_s AS (SELECT query_id, {keys}, sum(1.0::DOUBLE/(60+rank)) AS score, "
            f"min(ordinal * 1000000 + rank) AS first FROM {source} GROUP BY ALL)",
            f"{name}_top AS (SELECT query_id, {keys}, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
            f"ORDER BY round(score, 9) DESC, first) AS rank FROM {name}_s) WHERE rank <= {k})",
        ]
    )


def dense(k: int, skip_self: bool = True, name: str = "de") -> str:
    cond = "WHERE a.vec_id <> b.vec_id" if skip_self else ""
    return (
        f"{name}_s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, "
        f"list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a CROSS JOIN embeddings b {cond}),\n"
        f"{name}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank "
        f"FROM {name}_s) WHERE rank <= {k})"
    )


def ir_metrics(qrels: str, run: str, ks=(1, 5, 10), name: str = "ir") -> str:
    """CTEs ending in <name>_scores(query_id, mrr, ap, recall_k, ...)."""
    agg, ideal, out = [], [], []
    for k in ks:
        agg.append(
            f"sum(CASE WHEN rank<={k} AND isnew THEN 1 ELSE 0 END) AS found_{k}, "
            f"sum(CASE WHEN rank<={k} AND rel THEN 1 ELSE 0 END) AS relk_{k}, "
            f"sum(CASE WHEN rank<={k} THEN coalesce(grade,0)/log2(rank+1.0::DOUBLE) END) AS dcg_{k}"
        )
        ideal.append(f"sum(CASE WHEN grade>0 AND pos<={k} THEN grade/log2(pos+1.0::DOUBLE) END) AS idcg_{k}")
        out.append(
            f"coalesce(CASE WHEN rels>0 THEN found_{k}::DOUBLE/rels ELSE 0.0 END, 0.0) AS recall_{k}, "
            f"coalesce(relk_{k}/{k}.0::DOUBLE, 0.0) AS precision_{k}, "
            f"CASE WHEN coalesce(relk_{k},0)>0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_rate_{k}, "
            f"coalesce(CASE WHEN idcg_{k}>0 THEN dcg_{k}/idcg_{k} END, 0.0) AS ndcg_{k}"
        )
    return ",\n".join(
        [
            f"{name}_j AS (SELECT r.query_id, r.item, r.rank, q.grade, coalesce(q.grade>0,false) AS rel FROM {run} r "
            f"LEFT JOIN {qrels} q ON r.query_id=q.query_id AND r.item=q.item)",
            f"{name}_n AS (SELECT *, rel AND row_number() OVER (PARTITION BY query_id,item ORDER BY rank)=1 AS isnew FROM {name}_j)",
            f"{name}_h AS (SELECT *, sum(isnew::INT) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM {name}_n)",
            f"{name}_a AS (SELECT query_id, max(CASE WHEN rel THEN 1.0::DOUBLE/rank END) AS mrr0, "
            f"sum(CASE WHEN isnew THEN hits::DOUBLE/rank END) AS ap0, {', '.join(agg)} FROM {name}_h GROUP BY query_id)",
            f"{name}_p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item) AS pos FROM {qrels})",
            f"{name}_i AS (SELECT query_id, sum((grade>0)::INT) AS rels, {', '.join(ideal)} FROM {name}_p GROUP BY query_id)",
            f"{name}_scores AS (SELECT i.query_id, coalesce(mrr0,0.0) AS mrr, "
            f"coalesce(CASE WHEN rels>0 THEN ap0/rels END, 0.0) AS ap, {', '.join(out)} "
            f"FROM {name}_i i LEFT JOIN {name}_a a ON i.query_id=a.query_id)",
        ]
    )


def metric_names(ks=(1, 5, 10)) -> list[str]:
    return ["mrr", "ap"] + [f"{m}_{k}" for k in ks for m in ("recall", "precision", "hit_rate", "ndcg")]


def rounded(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)
