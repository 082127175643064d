"""Runnable streaming queries: each drains the tables through a real stream and reads the result back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.plans import twin as S
from corpuslens.plans.corpus_queries import CHUNKED, CLEAN, quality_sql
from corpuslens.plans.registry import query
from corpuslens.session import fresh_path
from corpuslens.sources import views
from corpuslens.sources.tables import table
from corpuslens.streaming import jobs as J


def _ingest_sql() -> str:
    clean = [p.replace("SELECT doc_id, replace(replace(line,'.',''),'/','') AS stem FROM v_lines WHERE line_no=0", "SELECT doc_id, '' AS stem FROM documents") for p in CLEAN]
    chunked = [p.replace("FROM v_markdown)", "FROM cl9)") for p in CHUNKED[1:]]
    return S.ctes(*clean, *quality_sql("cl9", "CAST(NULL AS BIGINT)", "false", "false"), *chunked, "nc AS (SELECT doc_id, count(*) AS n, sum(length(text)) AS chars FROM v_struct GROUP BY doc_id)") + (
        "SELECT q.doc_id, CASE WHEN idx THEN 'scanned' ELSE 'failed' END AS status, CASE WHEN NOT idx THEN warn END AS reason, CASE WHEN idx THEN coalesce(nc.n,0) ELSE 0 END AS n_chunks, "
        "CAST(CASE WHEN idx THEN coalesce(chars,0) ELSE 0 END AS BIGINT) AS chars FROM q4 q LEFT JOIN nc USING (doc_id) WHERE trim(q.text, ' '||chr(10)) <> ''"
    )


@query("x1_ingest_stream", _ingest_sql())
def ingest_stream(spark, sf):
    path = fresh_path(spark, "ingest")
    raw = J.table_stream(spark, sf, "documents")
    J.ingest_stream(raw.select("doc_id", views.markdown_column(F.col("text")).alias("text")), path)
    chunks, status = J.ingested(spark, path)
    per = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"))
    return status.join(per, "doc_id", "left").select(
        "doc_id", "status", "reason", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("c", F.lit(0)).alias("chars")
    )


STATUS = "['uploaded','scanning','scanned','failed','stored']"


def status_events(e):
    names = F.array(*[F.lit(s) for s in ("uploaded", "scanning", "scanned", "failed", "stored")])
    return e.select(
        F.col("user_id").alias("asset_id"), F.col("ts").alias("at"), "event_id", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("status"),
        F.col("value").alias("quality_score"),
    )


@query(
    "x2_latest_status",
    f"SELECT user_id AS asset_id, {STATUS}[event_id%5+1] AS status, CASE WHEN event_id%5>1 THEN round(value,6) END AS quality_score, epoch_us(ts) AS at FROM "
    "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1",
)
def latest_status(spark, sf):
    path = fresh_path(spark, "status")
    J.drain(J.latest_status_stream(status_events(J.table_stream(spark, sf, "events"))), path, "update")
    r = J.newest_of(J.results(spark, path), "asset_id", ["at", "event_id"])
    return r.select("asset_id", "status", F.round("quality_score", 6).alias("quality_score"), F.unix_micros("at").alias("at"))


WINDOWED = (
    "count(*) AS n_events, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, round(avg(latency_ms),4) AS avg_latency_ms"
)


def usage_stream(spark, sf):
    return views.usage_of(J.table_stream(spark, sf, "events"))


def shown(r):
    return r.select(
        F.unix_micros("window_start").alias("window_start"), "feature", "provider", "model", "n_events", "input_tokens",
        F.col("cost_usd").cast("double").alias("cost_usd"), F.round("avg_latency_ms", 4).alias("avg_latency_ms"),
    )


@query(
    "x3_usage_windows",
    S.ctes(S.USAGE) + f"SELECT epoch_us(date_trunc('hour', created_at)::TIMESTAMP) AS window_start, feature, provider, model, {WINDOWED} FROM v_usage GROUP BY 1,2,3,4",
)
def usage_windows(spark, sf):
    path = fresh_path(spark, "windows")
    J.drain(J.usage_windows(usage_stream(spark, sf)), path, "update")
    return shown(J.results(spark, path, ["window_start", "feature", "provider", "model"]))


@query(
    "x3_usage_windows_sliding",
    S.ctes(S.USAGE, "sl AS (SELECT *, unnest(range(2)) AS i FROM v_usage)")
    + f"SELECT (epoch_us(created_at)//1800000000 - i)*1800000000 AS window_start, feature, provider, model, {WINDOWED} FROM sl GROUP BY 1,2,3,4",
)
def usage_windows_sliding(spark, sf):
    path = fresh_path(spark, "sliding")
    J.drain(J.usage_windows(usage_stream(spark, sf), slide="30 minutes"), path, "update")
    return shown(J.results(spark, path, ["window_start", "feature", "provider", "model"]))


@query(
    "x3_usage_sessions",
    S.ctes(
        S.USAGE,
        "o AS (SELECT *, epoch_us(created_at) AS us, lag(epoch_us(created_at)) OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS p FROM v_usage)",
        "g AS (SELECT *, sum(CASE WHEN p IS NULL OR us-p>1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS s FROM o)",
        "w AS (SELECT max(epoch_us(created_at)) - 3600000000 AS wm FROM v_usage)",
    )
    + "SELECT user_id, min(us) AS session_start, max(us)+1800000000 AS session_end, count(*) AS n_events, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd FROM g GROUP BY user_id, s HAVING max(us)+1800000000 <= (SELECT wm // 1000 * 1000 FROM w)",
)
def usage_sessions(spark, sf):
    """Sessions closed by the watermark; the ones still open at the end are not emitted."""
    path = fresh_path(spark, "sessions")
    J.drain_append(J.usage_sessions(usage_stream(spark, sf), "user_id"), path)
    r = J.results(spark, path)
    return r.select(
        "user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n_events",
        F.col("cost_usd").cast("double").alias("cost_usd"),
    )


THROTTLE = (
    S.ctes(
        "e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)",
        "r AS (SELECT event_id, user_id, n, 'accepted' AS decision, [t] AS h FROM e WHERE n=1 UNION ALL SELECT event_id, user_id, n, d, CASE WHEN d='accepted' THEN list_append(hk, t) ELSE hk END FROM "
        "(SELECT e.event_id, e.user_id, e.n, e.t, hk, CASE WHEN len(hk)>0 AND e.t - hk[len(hk)] < 3600000000 THEN 'too_fast' WHEN len(hk)>=3 THEN 'too_many' ELSE 'accepted' END AS d "
        "FROM (SELECT r.user_id, r.n, e2.t AS t2, list_filter(r.h, lambda x: e2.t - x < 86400000000) AS hk FROM r JOIN e e2 ON e2.user_id=r.user_id AND e2.n=r.n+1) q JOIN e ON e.user_id=q.user_id AND e.n=q.n+1))",
    )
    + "SELECT event_id, user_id, decision FROM r"
)
LIMITS = {"gap_s": 3600, "limit": 3, "window_s": 86_400}


@query("x4_throttle", THROTTLE)
def throttle(spark, sf):
    return J.throttle(table(spark, sf, "events"), "user_id", "ts", "event_id", **LIMITS)


@query("x4_throttle_stream", THROTTLE)
def throttle_stream(spark, sf):
    path = fresh_path(spark, "throttle")
    J.drain_append(J.throttle_stream(J.table_stream(spark, sf, "events"), "user_id", "ts", "event_id", **LIMITS), path)
    return J.results(spark, path)


@query(
    "x5_dedupe_events",
    "WITH d AS (SELECT event_id, event_type, unnest(range(1 + event_id % 3)) AS copy FROM events) SELECT event_type, count(DISTINCT event_id) AS n, CAST(sum(DISTINCT event_id) AS BIGINT) AS ids FROM d GROUP BY event_type",
)
def dedupe_events(spark, sf):
    """Events are delivered once, twice or three times."""
    path = fresh_path(spark, "dedupe")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3))
    J.drain_append(J.dedupe_events(J.table_stream(spark, sf, "events").withColumn("copy", copies), ["event_id"], "ts").drop("copy"), path)
    return J.results(spark, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "x6_assemble_responses",
    "SELECT conv_id AS request_id, arg_max(text, turn) FILTER (WHERE role='assistant') AS answer, arg_min(text, turn) FILTER (WHERE role='system') AS plan, arg_min(text, turn) FILTER (WHERE role='user') AS conversation, "
    "count(*) AS n_events, CASE WHEN count(*) FILTER (WHERE role='assistant')=0 THEN 'missing_final' END AS error FROM conversations GROUP BY conv_id",
)
def assemble_responses(spark, sf):
    path = fresh_path(spark, "responses")
    t = J.table_stream(spark, sf, "conversations")
    kind = F.when(F.col("role") == "assistant", "final").when(F.col("role") == "system", "trace").otherwise("conversation")
    e = t.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), kind.alias("type"), F.col("text").alias("payload"))
    at = F.timestamp_seconds(F.col("request_id") * 60 + F.col("seq") * 50)  # long requests run into the next period
    J.drain(J.assemble_responses_stream(e.withColumn("at", at), period="2 minutes"), path, "update")
    return J.responses_of(J.results(spark, path)).select("request_id", "answer", "plan", "conversation", "n_events", "error")


@query(
    "x7_recent_count_stream",
    "WITH s AS (SELECT *, unnest(range(6)) AS i FROM events) SELECT (epoch_us(ts)//600000000 - i)*600000000 AS window_start, user_id, count(*) AS n FROM s GROUP BY 1, 2",
)
def recent_count_stream(spark, sf):
    path = fresh_path(spark, "recent")
    J.drain(J.recent_counts(J.table_stream(spark, sf, "events"), "user_id", "ts", "1 hour", "10 minutes"), path, "update")
    return J.results(spark, path, ["window_start", "user_id"]).select(F.unix_micros("window_start").alias("window_start"), "user_id", "n")
