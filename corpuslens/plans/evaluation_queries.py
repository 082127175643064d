"""Runnable queries of answer scoring, records, routing and telemetry, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.operators import evaluation as V
from corpuslens.operators import relational as B
from corpuslens.plans import twin as S
from corpuslens.plans.registry import query
from corpuslens.sources import views
from corpuslens.sources.tables import table



def answered(spark, sf):
    """Assistant turns as answers: (query_id, conv, turn, question, answer)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = views.turns(spark, sf).withColumn("q", F.coalesce(F.lag("text").over(w), F.lit("")))
    return t.filter("role = 'assistant'").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "conv_id", "turn", F.col("q").alias("query"), F.col("text").alias("answer")
    )


ANSWERED = (
    "an AS (SELECT conv_id || ':' || turn AS query_id, conv_id, turn, coalesce(q,'') AS query, text AS answer FROM "
    "(SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations) WHERE role='assistant')"
)


def tailed(a, tails: dict[int, str], base: int):
    """Answers with a further end that depends on the turn."""
    tail = F.lit("")
    for turn, text in tails.items():
        tail = F.when(F.col("turn") % base == turn, F.lit(text)).otherwise(tail)
    return a.withColumn("answer", F.concat("answer", tail))


def tailed_sql(name: str, tails: dict[int, str], base: int) -> str:
    cases = " ".join(f"WHEN {turn} THEN {S.q(text)}" for turn, text in tails.items())
    return f"{name} AS (SELECT query_id, conv_id, turn, query, answer || CASE turn % {base} {cases} ELSE '' END AS answer FROM an)"


# Norm and tokens of answers in Latin script.
MACROS = (
    "nrm AS (SELECT query_id, {norm} AS norm, {question} AS qnorm FROM {frame})",
    "tok AS (SELECT query_id, {tokens} AS tokens, list_filter({topic}, lambda t: NOT list_contains({stop}, t) AND NOT regexp_matches(t, '^[0-9]+$')) AS topic FROM nrm)",
)


def _norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^a-z0-9؀-ۿ.%<>=]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _tokens_sql(x: str) -> str:
    stemmed = "CASE WHEN regexp_matches(t, '^[a-z]{5,}ly$') THEN left(t, length(t)-2) WHEN regexp_matches(t, '^[a-z]{4,}s$') THEN left(t, length(t)-1) ELSE t END"
    stop = "[" + ", ".join(S.q(w) for w in V.SCORE_STOPWORDS) + "]"
    return f"list_filter(list_transform(regexp_extract_all({x}, '{V.SCORE_TOKEN}'), lambda t: {stemmed}), lambda t: NOT list_contains({stop}, t))"


def word_ctes(frame: str) -> tuple[str, ...]:
    parts = {
        "frame": frame, "norm": _norm_sql("answer"), "question": _norm_sql("query"), "tokens": _tokens_sql("norm"), "topic": _tokens_sql("qnorm"),
        "stop": "[" + ", ".join(S.q(w) for w in V.QUESTION_STOPWORDS) + "]",
    }
    out = []
    for macro in MACROS:
        for name, text in parts.items():
            macro = macro.replace("{" + name + "}", text)
        out.append(macro)
    return tuple(out)


ENDS = {1: " ...", 3: "\nInsufficient information.", 4: "\nUnable to generate it."}


def answer_tasks(spark, sf):
    """Concepts are the answer's own last line and, every other turn, words it lacks; claims likewise. Some answers are
    cut, refuse or report a failure."""
    a = tailed(answered(spark, sf), ENDS, 5)
    last = F.element_at(F.split("answer", "\n"), -1)
    absent = F.lit("zzz qqq 77.5")
    c = F.col("conv_id")
    kinds = F.array(*[F.lit(x) for x in ("answerable", "unanswerable", "conflicting", "ambiguous")])
    return a.select(
        "query_id", "query", "answer",
        F.element_at(kinds, (c % 4 + 1).cast("int")).alias("answerability"),
        F.when(c % 3 == 0, F.array("answer")).otherwise(F.array(absent)).alias("acceptable_answers"),
        F.when(c % 5 == 0, F.array().cast("array<string>")).when(c % 2 == 0, F.array(last, absent)).otherwise(F.array(last)).alias("required_concepts"),
        F.when(c % 7 == 0, F.array(last, absent)).otherwise(F.array(absent)).alias("forbidden_claims"),
    )


@query(
    "v7_score_answers",
    S.ctes(
        ANSWERED, tailed_sql("an2", ENDS, 5), *word_ctes("an2"),
        "s AS (SELECT query_id, conv_id, conv_id%3=0 AS ex, CASE WHEN conv_id%5=0 THEN 1.0 WHEN conv_id%2=0 THEN 0.5 ELSE 1.0 END AS cov, conv_id%5=0 AS noc, conv_id%7=0 AS forb, conv_id%4=1 AS una, conv_id%4=0 AS able, "
        f"regexp_matches(answer, {S.q(V.REFUSAL)}) AND NOT regexp_matches(query, {S.q(V.EXCLUSION_QUESTION)}) AS ref, regexp_matches(answer, {S.q(V.TRUNCATION)}) AS cut, "
        f"regexp_matches(answer, {S.q(V.GENERIC_FAILURE)}) AS gen, len(list_intersect(topic, tokens)) > 0 AS met FROM an2 JOIN tok USING (query_id))",
        "r AS (SELECT *, una AND ref AND met AND NOT forb AS right_refusal FROM s)",
    )
    + "SELECT query_id, ex AS normalized_answer_match, ex OR right_refusal OR (cov=1.0 AND NOT forb AND NOT una AND NOT ref) OR (noc AND ex) AS acceptable_answer_match, CAST(cov AS DOUBLE) AS required_concept_coverage, forb AS forbidden_claim, "
    "ref AS refusal_detected, right_refusal AS refusal_correct, able AND ref AS false_refusal, gen AS generic_failure, cut AS truncation FROM r",
)
def score_answers(spark, sf):
    t = answer_tasks(spark, sf)
    s = V.score_answers(t.drop("answer"), t.select("query_id", "answer"))
    flags = ["refusal_detected", "refusal_correct", "false_refusal", "generic_failure", "truncation"]
    return s.select("query_id", "normalized_answer_match", "acceptable_answer_match", "required_concept_coverage", "forbidden_claim", *flags)


CONCLUSIONS = {1: "\n\nTherefore it requires care.", 2: "\n\nAnd so on."}


@query(
    "v8_score_summaries",
    S.ctes(
        ANSWERED, tailed_sql("an2", CONCLUSIONS, 3), *word_ctes("an2"),
        "s AS (SELECT query_id, conv_id, turn, CASE WHEN conv_id%3=0 THEN 0.5 ELSE 1.0 END AS kc, CASE WHEN conv_id%5=0 THEN 0.5 ELSE 0.0 END AS con, conv_id%2=0 AS need, turn%3+1 AS least, CASE WHEN conv_id%4=0 THEN 0.5 ELSE 1.0 END AS sec, "
        f"regexp_matches(norm, {S.q(V.CONCLUSION_WORDS)}) OR len(list_filter([" + ", ".join(S.q(x) for x in V.CONCLUSION_CUES) + "], lambda w: contains("
        + _norm_sql(r"list_filter(regexp_split_to_array(answer, '\n\s*\n+'), lambda x: trim(x, ' ' || chr(10)) <> '')[-1]") + ", w))) >= 2 AS ends FROM an2 JOIN nrm USING (query_id))",
    )
    + "SELECT query_id, CAST(sec AS DOUBLE) AS section_coverage, CAST(kc AS DOUBLE) AS key_claim_recall, NOT need OR ends AS conclusion_coverage, CAST(con AS DOUBLE) AS contamination_rate, round(least(1.0, 2.0::DOUBLE/least),6) AS page_diversity, "
    "sec=1.0 AND kc=1.0 AND con=0.0 AND (NOT need OR ends) AND least<=2 AS passed FROM s",
)
def score_summaries(spark, sf):
    a = tailed(answered(spark, sf), CONCLUSIONS, 3)
    last = F.element_at(F.split("answer", "\n"), -1)
    first = F.split("answer", "\n")[0]
    c = F.col("conv_id")
    tasks = a.select(
        "query_id",
        F.when(c % 4 == 0, F.array(first, F.lit("zzz qqq 77.5"))).otherwise(F.array(first)).alias("required_sections"),
        F.when(c % 3 == 0, F.array(last, F.lit("zzz qqq 77.5"))).otherwise(F.array(last)).alias("required_key_claims"),
        F.when(c % 5 == 0, F.array(first, F.lit("zzz"))).otherwise(F.array(F.lit("zzz"))).alias("contamination_blacklist"),
        (c % 2 == 0).alias("conclusion_required"),
        (F.col("turn") % 3 + 1).cast("int").alias("minimum_page_diversity"),
    )
    s = V.score_summaries(tasks, a.select("query_id", "answer", F.array(F.lit(1), F.lit(2), F.lit(2)).alias("cited")))
    return s.withColumn("page_diversity", F.round("page_diversity", 6))


REC = (
    "r AS (SELECT doc_id, source, n_chars AS n, text, doc_id%5<>0 AS need, doc_id%4 AS k, doc_id%3 AS s FROM documents)",
    "x AS (SELECT *, s>0 AS has, CASE WHEN s>0 THEN k<>3 ELSE NOT need END AS valid, CASE WHEN s>0 THEN doc_id%6<>1 ELSE NOT need END AS docok, "
    "CASE WHEN need THEN s>0 AND k<2 ELSE true END AS pageok, doc_id%7<>0 AS acc, doc_id%11=0 AS forb, doc_id%9=0 AS nums, doc_id%8=0 AS cross_l FROM r)",
)


def record_frames(spark, sf):
    """Documents as tasks with responses: which flags hold depends on the document number."""
    d, i = views.docs(spark, sf), F.col("doc_id")
    k, s = i % 4, i % 3
    tasks = d.select(
        i.alias("query_id"), F.col("source").alias("filename"),
        F.when(i % 9 == 0, "local_factual").when(i % 8 == 0, "cross_language").otherwise("analytical").alias("task_type"),
        F.col("lang").alias("expected_intent"), F.when(i % 2 == 0, "focused_rag").otherwise("free_chat").alias("expected_route"),
        F.when(i % 3 == 0, "required").otherwise("allowed").alias("retrieval_policy"), (i % 5 != 0).alias("citation_required"), F.lit(1).alias("minimum_citations"),
        F.array(F.lit(1), F.lit(2), F.lit(3)).alias("relevant_pages"),
    )
    name = F.when(i % 6 == 1, "other").otherwise(F.col("source"))
    label = F.when(k == 0, F.concat(name, F.lit(" - صفحه 2"))).when(k == 1, F.concat(name, F.lit(" - pages 1-3"))).when(k == 2, F.concat(name, F.lit(" - page 9"))).otherwise(name)
    responses = d.select(
        i.alias("query_id"), F.when(i % 10 == 0, "").otherwise(F.col("text")).alias("answer"),
        F.when(s == 0, F.array().cast("array<string>")).when(s == 1, F.array(label)).otherwise(F.array(label, label)).alias("sources"),
        F.col("lang").alias("actual_intent"), F.when(i % 4 < 2, "focused_rag").otherwise("free_chat").alias("actual_route"),
        (i % 2 == 0).alias("retrieved"), (i % 13 == 0).alias("history_resolved"), (i % 6 == 0).alias("reused"), (i % 16 == 0).alias("rewrite_used"),
        (i % 2).cast("int").alias("reranker_count"), F.col("n_chars").cast("double").alias("latency_ms"),
    )
    scores = d.select(
        i.alias("query_id"), (i % 7 != 0).alias("acceptable_answer_match"), (i % 11 == 0).alias("forbidden_claim"),
        F.when(i % 3 == 0, 0.5).otherwise(1.0).alias("required_concept_coverage"), F.lit(False).alias("generic_failure"), (i % 17 == 0).alias("truncation"),
    )
    return tasks, responses, scores


@query(
    "v9_build_eval_records",
    S.ctes(*REC)
    + "SELECT doc_id AS query_id, doc_id%2=0 AND doc_id%6<>0 AS retrieval_called, doc_id%9<>0 AND cross_l AS rewrite_expected, (doc_id%16=0)=(doc_id%9<>0 AND cross_l) AS rewrite_correct, doc_id%6=0 AS reranker_expected, doc_id%2=1 AS reranker_called, "
    "need AS citation_required, valid AS citation_valid, docok AS citation_document_correct, pageok AS citation_page_correct, CASE WHEN need THEN has AND pageok ELSE true END AS all_required_claims_cited, "
    "nums AS contains_numeric_claim, nums AND acc AND NOT forb AND NOT has AS unsupported_numeric_citation_failure, has AND k=3 AS metadata_only_citation_failure, (doc_id%2=0)=(doc_id%4<2) AS route_correct, "
    "has OR doc_id%2=0 OR doc_id%13=0 AS evidence_available, acc AND NOT forb AS answer_correct, doc_id%3<>0 AS required_concepts_covered, (NOT need OR has) AND NOT forb AS grounded, "
    "valid AND docok AND pageok AND (CASE WHEN need THEN has AND pageok ELSE true END) AS citations_correct, doc_id%10<>0 AND doc_id%17<>0 AS output_complete, true AS no_internal_message_exposed FROM x",
)
def build_eval_records(spark, sf):
    r = V.build_eval_records(*record_frames(spark, sf))
    return r.drop("expected_intent", "actual_intent", "expected_route", "actual_route", "retrieval_policy", "latency_ms")


# --------------------------------------------------------------------------------------------- routing

# One question in eight gets a phrase that names a routing cue; the rest of the text is the turn's own.
PHRASES = ["", " how many percent?", " summarize the whole document", " on page 12", " in the table", " retry", " according to this", " “quoted words here”"]


def requests(spark, sf):
    t = B.previous_turn(views.turns(spark, sf)).filter("role <> 'assistant'")
    c, n = F.col("conv_id"), F.col("turn")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), ((c + n) % 8 + 1).cast("int"))
    text = F.when((c + n) % 8 == 5, "Retry!").otherwise(F.concat("text", phrase))
    return t.select(
        "conv_id", "turn", text.alias("query_text"), F.col("answered_before").alias("has_history"), (c % 3).cast("int").alias("document_count"),
        (c * 1000).alias("token_estimate"),
    )


def cue(name: str) -> str:
    return f"regexp_matches(x, {S.q('(?i)' + V.CUES[name])})"


def _case(values) -> str:
    return " ".join(f"WHEN {c} THEN '{v}'" for c, v in values)


def _routes() -> tuple[str, ...]:
    role = " ".join(f"WHEN regexp_matches(lower(x), {S.q('(?i)' + p)}) THEN '{r}'" for p, r in V.SECTION_ROLES)
    past, sc = "has_history", "document_count>0"
    rules = [
        (f"{cue('retry')} AND {past}", "retry_previous|retry_previous|conversation_only|retry_previous_operation|previous|f"),
        (f"{cue('evidence_followup')} AND {past} AND NOT qd", "conversational_followup|conversational_followup|history_aware_retrieval|history_reference_requires_new_evidence|focused|f"),
        (f"({cue('short_followup')} OR {cue('anaphoric')}) AND {past} AND NOT qd", "conversational_followup|conversational_followup|conversation_only|clarify_previous_assistant_response|previous_evidence|f"),
        (f"qd AND {sc}", "explain|focused_rag|quoted_document_explanation|explicit_quoted_document_text|focused|f"),
        (f"NOT ({sc})", "free_chat|free_chat|conversation_only|no_document_scope|none|f"),
        (f"{cue('summary')} AND {cue('full_scope')} AND document_count=1 AND token_estimate<=24000", "comprehensive_summary|comprehensive_summary|direct_whole_document|full_document_summary_requested|comprehensive|t"),
        (f"{cue('summary')} AND {cue('full_scope')}", "comprehensive_summary|comprehensive_summary|hierarchical_section_aware|full_document_summary_requested|comprehensive|t"),
        (cue("table"), "specific_section|specific_section|table_or_structured_document|table_or_structured_data_cue|table|t"),
        (f"tp IS NOT NULL OR ({cue('section')} AND tr IS NOT NULL)", "specific_section|specific_section|local_hybrid_retrieval|explicit_page_or_section_requested|section|t"),
        (cue("summary"), "focused_summary|focused_rag|local_hybrid_retrieval|focused_summary_requested|focused|f"),
        (cue("definition"), "exact_answer|focused_rag|local_hybrid_retrieval|definition_fact_requested|focused|f"),
        (cue("numeric"), "exact_answer|focused_rag|local_hybrid_retrieval|numeric_fact_requested|focused|f"),
        (cue("attributed"), "exact_answer|focused_rag|local_hybrid_retrieval|attributed_fact_requested|focused|f"),
        (cue("compare"), "compare|analytical|local_hybrid_retrieval|comparison_requested|multi_source|f"),
        (cue("extract"), "extract|focused_rag|local_hybrid_retrieval|structured_extraction_requested|focused|f"),
        (cue("explain"), "explain|focused_rag|local_hybrid_retrieval|explanation_requested|expanded|f"),
        (cue("analytical"), "analytical|analytical|local_hybrid_retrieval|cross_section_analysis_requested|multi_section|t"),
    ]
    phrases = "[" + ",".join(S.q(p) for p in PHRASES) + "]"
    return (
        "rt0 AS (SELECT *, coalesce(max(CASE WHEN role='assistant' AND trim(text)<>'' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)=1 AS has_history FROM conversations)",
        f"rt1 AS (SELECT conv_id, turn, has_history, CAST(conv_id%3 AS INT) AS document_count, conv_id*1000 AS token_estimate, trim(CASE WHEN (conv_id+turn)%8=5 THEN 'Retry!' ELSE text || {phrases}[(conv_id+turn)%8+1] END, ' '||chr(10)) AS x FROM rt0 WHERE role<>'assistant')",
        f"rt2 AS (SELECT *, {cue('quoted')} AS qd, CAST(nullif(regexp_extract(x, {S.q('(?i)' + V.PAGE_CUE)}, 1),'') AS INT) AS tp, CASE {role} ELSE nullif(trim(regexp_extract(x, {S.q('(?i)' + V.NAMED_SECTION)}, 1)),'') END AS tr FROM rt1)",
        f"rt3 AS (SELECT *, CASE {_case(rules)} ELSE 'exact_answer|focused_rag|local_hybrid_retrieval|default_grounded_question|focused|f' END AS pl, len(regexp_extract_all(x,'[؟?]')) AS mk FROM rt2)",
        "rt4 AS (SELECT *, split_part(pl,'|',1) AS intent, split_part(pl,'|',2) AS route, split_part(pl,'|',3) AS route_implementation, split_part(pl,'|',4) AS reason, split_part(pl,'|',5) AS coverage, split_part(pl,'|',6)='t' AS requires_document_map FROM rt3)",
    )


BUDGET_SQL = "CASE intent " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in V.BUDGETS.items()) + " END AS candidate_k, CASE intent " + " ".join(
    f"WHEN '{k}' THEN {v[1]}" for k, v in V.BUDGETS.items()
) + " END AS evidence_k"


@query(
    "v10_route_requests",
    S.ctes(*_routes())
    + f"SELECT conv_id, turn, intent, route, route_implementation, reason, coverage, requires_document_map, CASE WHEN {cue('detail')} THEN 'detailed' ELSE 'concise' END AS detail, "
    "CASE WHEN reason='table_or_structured_data_cue' THEN 'table' ELSE tr END AS target_section, tp AS target_page, intent IN ('retry_previous','conversational_followup') AS history_required, "
    f"(mk>=2 OR (mk>=1 AND regexp_matches(x, {S.q('(?i)' + V.ALSO)}))) AND route IN ('focused_rag','analytical') AS decompose_query, {BUDGET_SQL} FROM rt4",
)
def route_requests(spark, sf):
    r = V.route_requests(requests(spark, sf))
    return r.drop("query_text", "has_history", "document_count", "token_estimate", "use_reranker", "max_subqueries")


CAPS = "[" + ",".join(f"'{c}'" for c in V.CAPABILITIES) + ",'nonsense']"
NORET = "('conversation_explanation','general_chat','clarification_required')"
DECIDE = (
    f"dc0 AS (SELECT *, {CAPS}[(conv_id+turn*3)%12+1] AS di, CASE WHEN conv_id%13=0 THEN 'no_document' ELSE ['no_document','single_document','multiple_documents'][document_count+1] END AS scope, turn%5<>0 AS uh, "
    f"CASE WHEN conv_id%11=0 THEN 'general_chat' ELSE {CAPS}[(conv_id+turn*3)%12+1] END AS tc, CASE WHEN turn%6=5 THEN 0.4 ELSE 0.9 END AS conf FROM rt4)",
    f"dc1 AS (SELECT *, CASE WHEN conv_id%17=0 THEN di IN {NORET} ELSE di NOT IN {NORET} END AS rr FROM dc0)",
    f"dc2 AS (SELECT *, CASE WHEN di='nonsense' OR tc='nonsense' THEN 'invalid_supervisor_json' WHEN conf<0.65 THEN 'low_supervisor_confidence' WHEN scope<>['no_document','single_document','multiple_documents'][document_count+1] THEN 'scope_count_mismatch' "
    f"WHEN tc<>di THEN 'intent_capability_mismatch' WHEN rr=(di IN {NORET}) THEN 'retrieval_requirement_mismatch' WHEN di='conversation_explanation' AND NOT uh THEN 'history_requirement_mismatch' WHEN di='quoted_text_explanation' AND NOT qd THEN 'quoted_text_missing' END AS failure_code, "
    f"(starts_with(di,'multi_document_') AND document_count<2) OR (di='single_document_summary' AND document_count<>1) OR (di='conversation_explanation' AND NOT has_history) OR (di NOT IN {NORET} AND document_count<1) AS unclear, "
    "CASE WHEN route_implementation='conversation_only' AND intent='conversational_followup' THEN 'conversation_explanation' WHEN route_implementation='conversation_only' THEN 'general_chat' "
    "WHEN route_implementation IN ('direct_whole_document','hierarchical_section_aware') THEN CASE WHEN document_count>1 THEN 'multi_document_summary' ELSE 'single_document_summary' END WHEN route_implementation='table_or_structured_document' THEN 'table_or_numeric_qa' "
    "WHEN route_implementation='quoted_document_explanation' THEN 'quoted_text_explanation' WHEN route='specific_section' THEN 'section_lookup' WHEN route='analytical' THEN CASE WHEN document_count>1 AND intent='compare' THEN 'multi_document_comparison' ELSE 'analytical_synthesis' END "
    "ELSE 'document_question_answering' END AS fb FROM dc1)",
    "dc3 AS (SELECT *, CASE WHEN failure_code IS NOT NULL THEN fb WHEN unclear THEN 'clarification_required' ELSE di END AS vi FROM dc2)",
)
PLAN_SQL = "CASE WHEN failure_code IS NOT NULL THEN route_implementation ELSE CASE vi " + " ".join(
    f"WHEN '{k}' THEN " + ("CASE WHEN token_estimate<=24000 THEN 'direct_whole_document' ELSE 'hierarchical_section_aware' END" if v[2] is None else f"'{v[2]}'")
    for k, v in V.CAPABILITY_PLANS.items()
) + " END END AS implementation"


@query("v11_validate_decisions", S.ctes(*_routes(), *DECIDE) + f"SELECT conv_id, turn, failure_code, failure_code IS NOT NULL AS fallback_used, vi AS validated_intent, {PLAN_SQL} FROM dc3")
def validate_decisions(spark, sf):
    r = V.route_requests(requests(spark, sf))
    c, n, k = F.col("conv_id"), F.col("turn"), F.col("document_count")
    decided = F.element_at(F.array(*[F.lit(x) for x in (*V.CAPABILITIES, "nonsense")]), ((c + n * 3) % 12 + 1).cast("int"))
    scopes = F.array(*[F.lit(x) for x in ("no_document", "single_document", "multiple_documents")])
    quiet = decided.isin(*V.NO_RETRIEVAL)
    d = r.withColumns(
        {
            "decided_intent": decided,
            "scope": F.when(c % 13 == 0, "no_document").otherwise(F.element_at(scopes, k + 1)),
            "uses_history": n % 5 != 0,
            "requires_retrieval": F.when(c % 17 == 0, quiet).otherwise(~quiet),
            "target_capability": F.when(c % 11 == 0, "general_chat").otherwise(decided),
            "confidence": F.when(n % 6 == 5, 0.4).otherwise(0.9),
        }
    )
    return V.validate_decisions(d).select("conv_id", "turn", "failure_code", "fallback_used", "validated_intent", F.col("plan.implementation").alias("implementation"))


# --------------------------------------------------------------------------------------------- telemetry


@query(
    "v12_execution_telemetry",
    S.ctes(
        "e AS (SELECT event_id // 3 AS r, event_id, CAST(round(value,2) AS DECIMAL(18,2)) AS v, event_id%2=0 AS fb, event_id%9 AS pg, event_type FROM events)",
        "g AS (SELECT r, min(event_id) AS i, sum(v) AS v, count(*) AS n, CAST(sum(fb::INT) AS INT) AS nf, list_sort(list_distinct(list(pg) FILTER (WHERE pg<>0))) AS pages FROM e GROUP BY r)",
        "h AS (SELECT *, list_filter([CASE WHEN r%4=0 THEN 'section_coverage_failure' END, CASE WHEN r%5=0 THEN 'timeout' END, CASE WHEN r%6=0 THEN 'invalid_json' END], lambda x: x IS NOT NULL) AS f FROM g)",
    )
    + "SELECT r AS request_id, CAST(1 + (r%3=0)::INT + n + nf + 1 AS INT) AS generation_calls, round(CAST(v AS DOUBLE) + 0.25 + CASE WHEN r%3=0 THEN 0.5 ELSE 0 END + 0.125, 6) AS provider_cost, "
    "CASE WHEN len(f)>0 THEN 'failed' ELSE 'passed' END AS validation_result, array_to_string(f, ',') AS codes, CASE WHEN r%7=0 THEN '1,2' ELSE coalesce(array_to_string(pages, ','),'') END AS pages_considered, r%3=0 AS fallback_used FROM h",
)
def execution_telemetry(spark, sf):
    e = table(spark, sf, "events")
    r = F.floor(F.col("event_id") / 3).cast("long")
    section = F.struct(F.round("value", 2).alias("primary_cost"), F.lit(0.0).alias("fallback_cost"), (F.col("event_id") % 2 == 0).alias("fallback_used"))
    g = e.groupBy(r.alias("request_id")).agg(F.collect_list(section).alias("sections"), F.collect_list((F.col("event_id") % 9).cast("int")).alias("chunk_pages"))
    i = F.col("request_id")
    runs = g.withColumns(
        {
            "generation": F.struct(
                F.lit(0.25).alias("primary_cost"), F.when(i % 3 == 0, 0.5).alias("fallback_cost"), (i % 3 == 0).alias("fallback_used"),
                F.when(i % 5 == 0, "timeout").alias("error_category"),
            ),
            "supervisor": F.struct(F.lit(0.125).alias("cost_usd"), F.lit(1).alias("requests"), F.lit(False).alias("fallback_used")),
            "hard_failures": F.when(i % 4 == 0, F.array(F.lit("section_coverage_failure"))),
            "citation_status": F.when(i % 6 == 0, "invalid_json").otherwise("validated"),
            "pages": F.when(i % 7 == 0, F.array(F.lit(1), F.lit(2))),
        }
    )
    t = V.execution_telemetry(runs)
    return t.select(
        "request_id", "generation_calls", F.round("provider_cost", 6).alias("provider_cost"), "validation_result", F.array_join("validation_failure_codes", ",").alias("codes"),
        F.array_join(F.transform("pages_considered", lambda p: p.cast("string")), ",").alias("pages_considered"), "fallback_used",
    )
