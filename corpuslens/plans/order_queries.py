"""Runnable queries of ordered scans, sampling, packing and set operations, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import corpus as C
from corpuslens.operators import ordering as O
from corpuslens.operators import relational as B
from corpuslens.operators import retrieval as R
from corpuslens.plans import twin as S
from corpuslens.plans.registry import query
from corpuslens.sources import views
from corpuslens.sources.tables import table


@query(
    "w1_latest_per_key",
    "SELECT user_id, event_id, event_type, round(value,6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1",
)
def latest_per_key(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return O.latest_per_key(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query(
    "w2_history_window",
    "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r<=8",
)
def history_window(spark, sf):
    return O.last_n(views.turns(spark, sf), ["conv_id"], ["turn"], 8)


@query(
    "w2_history_at_turn",
    "SELECT conv_id, turn, len(h) AS n_before, array_to_string(h, '|') AS roles FROM (SELECT conv_id, turn, coalesce(list(role) OVER "
    "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) AS h FROM conversations)",
)
def history_at_turn(spark, sf):
    h = B.with_history(views.turns(spark, sf))
    roles = F.array_join(F.transform("history", lambda x: x["role"]), "|")
    return h.select("conv_id", "turn", F.size("history").cast("long").alias("n_before"), roles.alias("roles"))


@query(
    "w3_history_digest",
    S.ctes(
        "l AS (SELECT conv_id, turn, role, " + S.visible("text") + " AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)",
        "k AS (SELECT conv_id, string_agg(role || ': ' || substring(body,1,500), chr(10) ORDER BY turn) FILTER (WHERE role IN ('user','assistant') AND body<>'') AS d FROM l WHERE r<=4 GROUP BY conv_id)",
    )
    + "SELECT conv_id, coalesce(d,'(none)') AS digest FROM k",
)
def history_digest(spark, sf):
    return B.history_digest(views.turns(spark, sf))


@query(
    "w4_previous_turn",
    "SELECT conv_id, turn, last_value(CASE WHEN role='assistant' AND trim(text)<>'' THEN text END IGNORE NULLS) OVER w AS previous_answer, "
    "last_value(CASE WHEN role='user' AND trim(text)<>'' THEN text END IGNORE NULLS) OVER w AS previous_question, "
    "coalesce(max(CASE WHEN role='assistant' AND trim(text)<>'' THEN 1 ELSE 0 END) OVER w, 0)=1 AS answered_before "
    "FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def previous_turn(spark, sf):
    return B.previous_turn(views.turns(spark, sf)).select("conv_id", "turn", "previous_answer", "previous_question", "answered_before")


@query(
    "w6_consecutive_groups",
    S.ctes(
        "l AS (SELECT conv_id, turn, role, text, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role AND "
        "row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 0 ELSE 1 END AS ch FROM conversations)",
        "g AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM l)",
    )
    + "SELECT conv_id, CAST(grp AS BIGINT) AS group_no, min(role) AS role, count(*) AS n, min(turn) AS first_turn, CAST(max(length(text)) AS INT) AS longest FROM g GROUP BY conv_id, grp",
)
def consecutive_groups(spark, sf):
    g = O.island_ids(views.turns(spark, sf), ["conv_id"], ["turn"], F.col("role"), "group_no")
    return g.groupBy("conv_id", "group_no").agg(
        F.min("role").alias("role"), F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"), F.max(F.length("text")).alias("longest")
    )


@query(
    "w7_line_signature_counts",
    S.ctes(S.LINES, f"s AS (SELECT doc_id, line_no, {S.compact('line')} AS signature FROM v_lines)")
    + "SELECT doc_id, CAST(line_no AS INT) AS line_no, signature, count(*) OVER (PARTITION BY doc_id, signature) AS seen FROM s",
)
def line_signature_counts(spark, sf):
    return C.line_signature_counts(views.lines(spark, sf)).select("doc_id", "line_no", "signature", "seen")


@query(
    "w9_sliding_count",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM events",
)
def sliding_count(spark, sf):
    return O.sliding_count(table(spark, sf, "events"), ["user_id"], "ts", 86_400).select("event_id", "recent")


@query(
    "w9_rank_hot_keys",
    "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events",
)
def rank_hot_keys(spark, sf):
    """Position of every event inside its (few, huge) types, by daily buckets."""
    e = table(spark, sf, "events").select("event_id", "event_type", "ts")
    day = F.date_trunc("day", F.col("ts"))
    return O.bucketed_rank(e, ["event_type"], day, [F.col("ts"), F.col("event_id")], "pos").select("event_id", "pos")


# Exams: an order is an exam, its lines are questions; two line statuses make the question types.
EXAM = (
    "v_exam AS (SELECT l_orderkey AS exam_id, l_linenumber AS question_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS position, "
    "CASE WHEN l_linestatus='F' THEN 'descriptive' ELSE 'multiple_choice' END AS type, CASE WHEN l_quantity % 3 = 0 THEN NULL ELSE l_quantity % 3 END AS points FROM lineitem)"
)


def exam(spark, sf):
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    q = F.col("l_quantity") % 3
    return li.select(
        F.col("l_orderkey").alias("exam_id"),
        F.col("l_linenumber").alias("question_id"),
        F.row_number().over(w).alias("position"),
        F.when(F.col("l_linestatus") == "F", "descriptive").otherwise("multiple_choice").alias("type"),
        F.when(q != 0, q).alias("points"),
    )


@query(
    "w10_apportion_points",
    S.ctes(
        EXAM,
        "w0 AS (SELECT *, CASE WHEN points>0 THEN points WHEN type='descriptive' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM v_exam)",
        "w1 AS (SELECT *, count(*) OVER (PARTITION BY exam_id) AS n, w / sum(w) OVER (PARTITION BY exam_id) * 9 AS ex FROM w0)",
        "w2 AS (SELECT *, ex-floor(ex) AS fr, CASE WHEN n<=9 THEN 1 ELSE 0 END AS fl FROM w1)",
        "w3 AS (SELECT *, greatest(CAST(floor(ex) AS BIGINT), fl) AS u FROM w2)",
        "w4 AS (SELECT *, 9 - sum(u) OVER (PARTITION BY exam_id) AS diff, row_number() OVER (PARTITION BY exam_id ORDER BY fr DESC, position)-1 AS up, "
        "coalesce(sum(u-fl) OVER (PARTITION BY exam_id ORDER BY fr, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS taken FROM w3)",
        "w5 AS (SELECT *, CASE WHEN diff>0 THEN diff//n + CASE WHEN up < diff % n THEN 1 ELSE 0 END ELSE 0 END AS extra, "
        "CASE WHEN diff<0 THEN greatest(0, least(u-fl, -diff-taken)) ELSE 0 END AS cut FROM w4)",
    )
    + "SELECT exam_id, position, CAST((u+extra-cut) AS DOUBLE)/2 AS points FROM w5",
)
def apportion_points(spark, sf):
    return O.apportion_points(exam(spark, sf), "exam_id", "position", 4.5).select(
        "exam_id", F.col("position").cast("long").alias("position"), "points"
    )


@query(
    "w11_number_citations",
    S.ctes(
        "u AS (SELECT l_orderkey AS answer_id, l_linenumber AS pos, 'src' || (l_partkey % 5) AS label FROM lineitem)",
        "f AS (SELECT answer_id, label, min(pos) AS fp FROM u GROUP BY ALL)",
        "m AS (SELECT answer_id, label, dense_rank() OVER (PARTITION BY answer_id ORDER BY fp) AS marker FROM f)",
    )
    + "SELECT answer_id, pos, label, CAST(marker AS INT) AS marker FROM (SELECT DISTINCT * FROM u) JOIN m USING (answer_id, label)",
)
def number_citations(spark, sf):
    u = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("src"), (F.col("l_partkey") % 5).cast("string")).alias("label")
    )
    return O.number_citations(u.distinct(), "answer_id", "pos", "label").select("answer_id", "pos", "label", "marker")


@query("t2_recent_first", "SELECT event_id, user_id, epoch_us(ts) AS at FROM events ORDER BY ts DESC, event_id LIMIT 50")
def recent_first(spark, sf):
    e = O.recent_first(table(spark, sf, "events"), [F.col("ts").desc(), F.col("event_id")], 50)
    return e.select("event_id", "user_id", F.unix_micros("ts").alias("at"))


@query(
    "t3_oldest_pending",
    "SELECT o_orderkey AS asset_id, epoch_us(o_orderdate) AS created_at FROM orders WHERE o_orderstatus='P' ORDER BY o_orderdate, o_orderkey LIMIT 1",
)
def oldest_pending(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return O.recent_first(o, [F.col("o_orderdate"), F.col("o_orderkey")], 1).select(
        F.col("o_orderkey").alias("asset_id"), F.unix_micros("o_orderdate").alias("created_at")
    )


@query(
    "t5_cap_evenly",
    S.ctes(
        S.CHUNKS,
        "n AS (SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index)-1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM v_chunks)",
    )
    + "SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index FROM n WHERE n <= 7 OR pos IN (SELECT round_even(i*(n-1)/6.0::DOUBLE, 0) FROM (SELECT unnest(range(7)) AS i))",
)
def cap_evenly(spark, sf):
    return O.cap_evenly(views.chunks(spark, sf), ["doc_id"], ["chunk_index"], 7).select("doc_id", "chunk_index")


@query(
    "t6_anchor_sample",
    S.ctes(
        S.CHUNKS,
        "n AS (SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index)-1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM v_chunks)",
    )
    + "SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index FROM n WHERE n<=3 OR pos IN (0, n//2, n-1) OR (n>=8 AND pos IN (n//4, 3*n//4))",
)
def anchor_sample(spark, sf):
    return O.anchor_sample(views.chunks(spark, sf), ["doc_id"], ["chunk_index"]).select("doc_id", "chunk_index")


@query(
    "t6_anchor_sample_wide",
    S.ctes(
        S.LINES,
        "n AS (SELECT doc_id, line_no, line_no AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM v_lines)",
    )
    + "SELECT doc_id, CAST(line_no AS INT) AS line_no FROM n WHERE n<=8 OR pos IN (0,1,n-2,n-1,n//4,n//2,3*n//4)",
)
def anchor_sample_wide(spark, sf):
    return O.anchor_sample(views.lines(spark, sf), ["doc_id"], ["line_no"], wide=True).select("doc_id", "line_no")


@query(
    "t7_pack_by_budget",
    S.ctes(
        S.LINES,
        "sz AS (SELECT doc_id, line_no, length(line)+length(source)+32 AS s FROM v_lines)",
        "rec AS (SELECT doc_id, line_no, s AS used, 1 AS batch FROM sz WHERE line_no=0 UNION ALL "
        "SELECT sz.doc_id, sz.line_no, CASE WHEN rec.used+sz.s>2000 THEN sz.s ELSE rec.used+sz.s END, CASE WHEN rec.used+sz.s>2000 THEN rec.batch+1 ELSE rec.batch END "
        "FROM rec JOIN sz ON sz.doc_id=rec.doc_id AND sz.line_no=rec.line_no+1)",
    )
    + "SELECT doc_id, CAST(line_no AS INT) AS line_no, batch FROM rec",
)
def pack_by_budget(spark, sf):
    l = views.lines(spark, sf)
    size = F.length("line") + F.length("source") + 32
    return O.pack_by_budget(l, ["doc_id"], ["line_no"], size, 2000).select("doc_id", "line_no", "batch")


@query(
    "t8_truncate_to_budget",
    S.ctes(
        S.CHUNKS,
        "b AS (SELECT doc_id, chunk_index, text, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS bef FROM v_chunks)",
        "f AS (SELECT *, chunk_index=1 OR bef+length(text)<=7000 AS fits FROM b)",
        "k AS (SELECT *, coalesce(max(CASE WHEN fits THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS broken FROM f)",
    )
    + "SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, CASE WHEN fits THEN text ELSE substring(text,1,CAST(7000-bef AS BIGINT)) END AS text FROM k WHERE broken=0 AND (fits OR 7000-bef>600)",
)
def truncate_to_budget(spark, sf):
    return O.truncate_to_budget(views.chunks(spark, sf), ["doc_id"], ["chunk_index"], "text", 7000).select("doc_id", "chunk_index", "text")


@query(
    "u2_merge_case_sets",
    "WITH a AS (SELECT doc_id, quality AS score, 0 AS o FROM labels WHERE quality=1 UNION ALL SELECT doc_id, toxic*10, 1 FROM labels WHERE toxic=1) "
    "SELECT doc_id, CAST(arg_min(score, o) AS INT) AS score, string_agg(CASE o WHEN 0 THEN 'core' ELSE 'expanded' END, ',' ORDER BY o) AS subsets FROM a GROUP BY doc_id",
)
def merge_case_sets(spark, sf):
    l = table(spark, sf, "labels")
    core = l.filter("quality = 1").select("doc_id", F.col("quality").alias("score"))
    more = l.filter("toxic = 1").select("doc_id", (F.col("toxic") * 10).alias("score"))
    m = O.merge_case_sets([("core", core), ("expanded", more)], "doc_id")
    return m.select("doc_id", "score", F.array_join("subsets", ",").alias("subsets"))


@query(
    "u3_array_set_operations",
    f"SELECT conv_id, turn, len(list_intersect(a,b)) AS n_both, len(list_filter(a, lambda x: NOT list_contains(b,x))) AS n_missing, len(list_distinct(list_concat(a,b))) AS n_any FROM "
    f"(SELECT conv_id, turn, {S.terms('text')} AS a, {S.terms('p')} AS b FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations))",
)
def array_set_operations(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = views.turns(spark, sf).withColumn("p", F.lag("text").over(w))
    t = t.withColumns({"a": T.term_set(F.col("text")), "b": T.term_set(F.col("p"))})
    return t.select(
        "conv_id",
        "turn",
        F.size(F.array_intersect("a", "b")).cast("long").alias("n_both"),
        F.size(F.array_except("a", "b")).cast("long").alias("n_missing"),
        F.size(F.array_union("a", "b")).cast("long").alias("n_any"),
    )


@query(
    "u4_dedupe_first",
    "SELECT source, lang, arg_min(doc_id, doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source, lang",
)
def dedupe_first(spark, sf):
    d = views.docs(spark, sf).select("source", "lang", "doc_id", "n_chars")
    return O.dedupe_first(d, ["source", "lang"], ["doc_id"])


@query(
    "t4_parent_identity",
    S.ctes(S.CHUNKS) + "SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, CASE WHEN chunk_index % 2 = 0 THEN source ELSE CAST(chunk_index AS VARCHAR) END AS identity FROM v_chunks",
)
def parent_identity(spark, sf):
    c = views.chunks(spark, sf).select(
        "doc_id", "chunk_index", F.lit("").alias("parent_id"), F.when(F.col("chunk_index") % 2 == 0, F.col("source")).alias("parent_title")
    )
    return c.select("doc_id", "chunk_index", R.parent_identity(c).alias("identity"))
