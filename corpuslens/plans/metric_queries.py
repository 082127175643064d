"""Runnable queries of metrics and reports, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import metrics as M
from corpuslens.plans import twin as S
from corpuslens.plans.registry import query
from corpuslens.sources import views
from corpuslens.sources.tables import table

PROP = ("value", "percentage", "wilson_low", "wilson_high")


def shown(df, *keys):
    return df.select(
        *keys, F.col("numerator").cast("long").alias("numerator"), F.col("denominator").cast("long").alias("denominator"),
        *[F.round(F.col(c), 6).alias(c) for c in PROP],
    )


def b(e: str) -> str:
    return f"CAST(sum(CASE WHEN {e} THEN 1 ELSE 0 END) AS BIGINT)"


def rate_sql(named) -> str:
    parts = []
    for name, ok, elig in named:
        parts.append(
            f"SELECT '{name}' AS metric, {b(f'({elig}) AND ({ok})')} AS numerator, {b(elig)} AS denominator FROM v_eval"
        )
    return (
        S.ctes(S.EVAL, "r AS (" + " UNION ALL ".join(parts) + ")")
        + f"SELECT metric, numerator, denominator, {S.wilson('numerator', 'denominator')} FROM r"
    )


@query(
    "a1_proportion",
    S.ctes(S.EVAL, f"g AS (SELECT source, {b('citation_required AND citation_valid')} AS numerator, {b('citation_required')} AS denominator FROM v_eval GROUP BY source)")
    + f"SELECT source, numerator, denominator, {S.wilson('numerator', 'denominator')} FROM g",
)
def proportion(spark, sf):
    r = views.eval_records(spark, sf)
    return shown(M.proportion(r, F.col("citation_valid"), F.col("citation_required"), ["source"]), "source")


@query(
    "a2_routing_metrics",
    rate_sql(
        [
            ("intent_classification_accuracy", "expected_intent IS NOT DISTINCT FROM actual_intent", "expected_intent IS NOT NULL"),
            ("route_selection_accuracy", "expected_route IS NOT DISTINCT FROM actual_route", "expected_route IS NOT NULL"),
            ("retrieval_necessity_accuracy", "retrieval_called = (retrieval_policy='required')", "retrieval_policy IN ('required','forbidden')"),
            ("unnecessary_retrieval_rate", "retrieval_called", "retrieval_policy='forbidden'"),
            ("missing_retrieval_rate", "NOT retrieval_called", "retrieval_policy='required'"),
            ("rewrite_correctness", "rewrite_correct", "rewrite_expected IS NOT NULL"),
            ("reranker_call_correctness", "reranker_called = reranker_expected", "reranker_expected IS NOT NULL"),
        ]
    ),
)
def routing_metrics(spark, sf):
    return shown(M.routing_metrics(views.eval_records(spark, sf)), "metric")


@query(
    "a3_citation_metrics",
    rate_sql(
        [
            ("citation_validity", "citation_valid", "coalesce(citation_required,true)"),
            ("citation_document_accuracy", "citation_document_correct", "coalesce(citation_required,true)"),
            ("citation_page_accuracy", "citation_page_correct", "coalesce(citation_required,true)"),
            ("citation_recall", "all_required_claims_cited", "coalesce(citation_required,true)"),
            ("unsupported_numeric_citation_failure", "unsupported_numeric_citation_failure", "contains_numeric_claim"),
            ("metadata_only_citation_failure", "metadata_only_citation_failure", "coalesce(citation_required,true)"),
        ]
    ),
)
def citation_metrics(spark, sf):
    return shown(M.citation_metrics(views.eval_records(spark, sf)), "metric")


@query(
    "a4_conversation_metrics",
    rate_sql(
        [
            ("followup_resolution_accuracy", "followup_resolved", "true"),
            ("history_use_accuracy", "history_used_correctly", "true"),
            ("unnecessary_retrieval_rate", "retrieval_called", "retrieval_policy='forbidden'"),
            ("selected_asset_persistence", "selected_asset_persisted", "true"),
            ("conversation_id_persistence", "conversation_id_persisted", "true"),
        ]
    ),
)
def conversation_metrics(spark, sf):
    return shown(M.conversation_metrics(views.eval_records(spark, sf)), "metric")


STRICT = " AND ".join(f"coalesce({f},false)" for f in M.SUCCESS_FLAGS)


@query(
    "a5_grounded_success",
    S.ctes(
        S.EVAL,
        f"g AS (SELECT coalesce(expected_route,'None') AS route, {b(STRICT)} AS numerator, count(*) AS denominator FROM v_eval GROUP BY 1 "
        f"UNION ALL SELECT '(overall)', {b(STRICT)}, count(*) FROM v_eval)",
    )
    + f"SELECT route, numerator, denominator, {S.wilson('numerator', 'denominator')} FROM g",
)
def grounded_success(spark, sf):
    return shown(M.grounded_success(views.eval_records(spark, sf)), "route")


def _report_sql() -> str:
    named = [
        ("route_accuracy", "coalesce(route_correct,false)"),
        ("retrieval_necessity_accuracy", "(retrieval_policy='required' AND retrieval_called) OR (retrieval_policy='forbidden' AND NOT retrieval_called) OR retrieval_policy='allowed'"),
        ("acceptable_answer_match", "answer_correct"),
        ("citation_page_accuracy", "citation_page_correct"),
        ("strict_gts", STRICT),
    ]
    inner = ", ".join(f"{b(e)} AS n_{n}" for n, e in named)
    outer = []
    for n, _ in named:
        w = S.wilson(f"n_{n}", "count").split(", round(")
        cols = S.wilson(f"n_{n}", "count")
        cols = cols.replace(" AS value", f" AS {n}").replace(" AS wilson_low", f" AS {n}_low").replace(" AS wilson_high", f" AS {n}_high").replace(
            " AS percentage", f" AS {n}_pct"
        )
        assert w
        outer.append(cols)
    return (
        S.ctes(
            S.EVAL,
            f"g AS (SELECT expected_route, count(*) AS count, {inner}, quantile_cont(latency_ms,0.5) AS p50, quantile_cont(latency_ms,0.95) AS p95 FROM v_eval GROUP BY 1)",
            f"o AS (SELECT expected_route, count, {', '.join(outer)}, round(p50,6) AS latency_p50_ms, round(p95,6) AS latency_p95_ms FROM g)",
        )
        + "SELECT * EXCLUDE (" + ", ".join(f"{n}_pct" for n, _ in named) + ") FROM o"
    )


@query("a6_group_report", _report_sql())
def group_report(spark, sf):
    g = M.group_report(views.eval_records(spark, sf), "expected_route")
    return g.select(*[c if c in ("expected_route", "count") else F.round(F.col(c), 6).alias(c) for c in g.columns])


@query(
    "a7_percentile_linear",
    "SELECT event_type, round(quantile_cont(value,0.25),6) AS p25, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.95),6) AS p95 FROM events GROUP BY event_type",
)
def percentile_linear(spark, sf):
    e = table(spark, sf, "events")
    p = M.exact_percentiles(e, "value", [0.25, 0.5, 0.95], ["event_type"])
    return p.select("event_type", *[F.round(a, 6).alias(n) for a, n in (("p0", "p25"), ("p1", "p50"), ("p2", "p95"))])


@query(
    "a7_percentile_overall",
    "SELECT round(quantile_cont(l_extendedprice,0.5),6) AS p50, round(quantile_cont(l_extendedprice,0.95),6) AS p95 FROM lineitem",
)
def percentile_overall(spark, sf):
    p = M.exact_percentiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.5, 0.95])
    return p.select(F.round("p0", 6).alias("p50"), F.round("p1", 6).alias("p95"))


@query(
    "a8_generation_aggregate",
    rate_sql(
        [
            ("normalized_answer_match", "normalized_answer_match", "true"),
            ("acceptable_answer_match", "acceptable_answer_match", "true"),
            ("forbidden_claim_rate", "forbidden_claim", "true"),
            ("generic_failure_rate", "generic_failure", "true"),
            ("false_refusal_rate", "false_refusal", "answerable"),
            ("truncation_rate", "truncation", "true"),
        ]
    )
    + " UNION ALL SELECT 'required_concept_coverage_mean', NULL, NULL, round(avg(required_concept_coverage),6), NULL, NULL, NULL FROM v_eval",
)
def generation_aggregate(spark, sf):
    return shown(M.generation_aggregate(views.eval_records(spark, sf)), "metric")


PAIRS = (
    "v_pairs AS (SELECT 'quality' AS label, quality=1 AS expected, n_chars>=400 AS predicted FROM labels JOIN documents USING (doc_id) "
    "UNION ALL SELECT 'toxic', toxic=1, n_chars<300 FROM labels JOIN documents USING (doc_id))",
    f"cm AS (SELECT label, {b('expected AND predicted')} AS tp, {b('NOT expected AND NOT predicted')} AS tn, "
    f"{b('NOT expected AND predicted')} AS fp, {b('expected AND NOT predicted')} AS fn, count(*)::DOUBLE AS n FROM v_pairs GROUP BY label "
    f"UNION ALL SELECT '(pooled)', {b('expected AND predicted')}, {b('NOT expected AND NOT predicted')}, "
    f"{b('NOT expected AND predicted')}, {b('expected AND NOT predicted')}, count(*)::DOUBLE FROM v_pairs)",
    "pr AS (SELECT *, tp::DOUBLE/greatest(tp+fp,1) AS p, tp::DOUBLE/greatest(tp+fn,1) AS r, (tp+fn)/n AS ye, (tp+fp)/n AS yp, (tp+tn)/n AS ag FROM cm)",
)


@query(
    "a9_classification_stats",
    S.ctes(*PAIRS)
    + "SELECT label, tp, tn, fp, fn, round(ag,6) AS accuracy, round(p,6) AS precision, round(r,6) AS recall, round(2*p*r/greatest(p+r,1e-12),6) AS f1 FROM pr",
)
def classification_stats(spark, sf):
    return M.classification_stats(views.judge_pairs(spark, sf)).drop("kappa")


@query(
    "a10_cohens_kappa",
    S.ctes(*PAIRS) + "SELECT label, round((ag-(ye*yp+(1-ye)*(1-yp)))/greatest(1-(ye*yp+(1-ye)*(1-yp)),1e-12),6) AS kappa FROM pr",
)
def cohens_kappa(spark, sf):
    return M.classification_stats(views.judge_pairs(spark, sf)).select("label", "kappa")


@query(
    "a11_bootstrap_mean_ci",
    S.ctes(
        "vals AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, quality::DOUBLE AS v FROM labels JOIN documents USING (doc_id))",
        "ns AS (SELECT lang, count(*) AS n FROM vals GROUP BY lang)",
        "dr AS (SELECT lang, b, CAST(('0x' || substring(md5('17:' || b || ':' || i),1,15)) AS BIGINT) % n AS j FROM vals JOIN ns USING (lang), (SELECT unnest(range(2000)) AS b))",
        "ms AS (SELECT dr.lang, b, avg(v) AS m FROM dr JOIN vals ON vals.lang=dr.lang AND vals.i=dr.j GROUP BY ALL)",
        "so AS (SELECT lang, list_sort(list(m)) AS s FROM ms GROUP BY lang)",
    )
    + "SELECT lang, round(s[51],6) AS low, round(s[1950],6) AS high FROM so",
)
def bootstrap_mean_ci(spark, sf):
    j = table(spark, sf, "labels").join(views.docs(spark, sf).select("doc_id", "lang"), "doc_id")
    ci = M.bootstrap_mean_ci(j, "quality", ["doc_id"], F.floor(F.col("doc_id") / 4096), ["lang"])
    return ci.select("lang", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "a14_judge_summary",
    S.ctes(S.EVAL)
    + "SELECT 'answer_correct' AS dimension, round(avg(answer_correct::INT),6) AS mean, CAST(sum(answer_correct::INT) AS BIGINT) AS pass_count, count(*) AS count FROM v_eval UNION ALL "
    "SELECT 'grounded', round(avg(grounded::INT),6), CAST(sum(grounded::INT) AS BIGINT), count(*) FROM v_eval UNION ALL "
    "SELECT 'citation_page_correct', round(avg(citation_page_correct::INT),6), CAST(sum(citation_page_correct::INT) AS BIGINT), count(*) FROM v_eval",
)
def judge_summary(spark, sf):
    dims = ["answer_correct", "grounded", "citation_page_correct"]
    r = views.eval_records(spark, sf).select("case_id", *[F.col(d).cast("int").alias(d) for d in dims])
    return M.judge_summary(r, dims).select("dimension", F.round("mean", 6).alias("mean"), "pass_count", "count")


@query(
    "a14_judge_composite",
    S.ctes(
        S.EVAL,
        "vals AS (SELECT row_number() OVER (ORDER BY case_id) - 1 AS i, (answer_correct::INT + grounded::INT + citation_page_correct::INT) / 3.0::DOUBLE AS v FROM v_eval)",
        "ns AS (SELECT count(*) AS n FROM vals)",
        "dr AS (SELECT b, CAST(('0x' || substring(md5('17:' || b || ':' || i),1,15)) AS BIGINT) % n AS j FROM vals, ns, (SELECT unnest(range(2000)) AS b))",
        "ms AS (SELECT b, avg(v) AS m FROM dr JOIN vals ON vals.i=dr.j GROUP BY b)",
        "so AS (SELECT list_sort(list(m)) AS s FROM ms)",
    )
    + "SELECT (SELECT round(avg(v),6) FROM vals) AS mean_composite_score, (SELECT n FROM ns) AS count, round(s[51],6) AS low, round(s[1950],6) AS high FROM so",
)
def judge_composite(spark, sf):
    dims = ["answer_correct", "grounded", "citation_page_correct"]
    score = sum((F.col(d).cast("int") for d in dims), F.lit(0)) / 3.0
    r = views.eval_records(spark, sf).select("case_id", score.alias("score"))
    c = M.judge_composite(r, "score", ["case_id"], F.floor(F.col("case_id") / 4096))
    return c.select(*[F.round(x, 6).alias(x) if x != "count" else F.col(x) for x in ("mean_composite_score", "count", "low", "high")])


@query(
    "a14_judge_disagreements",
    S.ctes(S.EVAL)
    + "SELECT case_id, 'answer_correct' AS dimension FROM v_eval WHERE answer_correct IS DISTINCT FROM citation_page_correct UNION ALL "
    "SELECT case_id, 'grounded' FROM v_eval WHERE grounded IS DISTINCT FROM required_concepts_covered",
)
def judge_disagreements(spark, sf):
    r = views.eval_records(spark, sf)
    return M.disagreements(r, [("answer_correct", "citation_page_correct"), ("grounded", "required_concepts_covered")])


@query(
    "a14_score_histogram",
    S.ctes(S.EVAL)
    + "SELECT CAST(s AS VARCHAR) AS score, count(*) AS count FROM (SELECT answer_correct::INT + grounded::INT + citation_page_correct::INT AS s FROM v_eval) GROUP BY 1",
)
def score_histogram(spark, sf):
    r = views.eval_records(spark, sf)
    total = sum((F.col(c).cast("int") for c in ("answer_correct", "grounded", "citation_page_correct")), F.lit(0))
    return M.score_histogram(r.withColumn("s", total), "s")
