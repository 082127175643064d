"""Runnable queries of evidence operators, citations and tables in text, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import corpus as C
from corpuslens.operators import evidence as E
from corpuslens.plans import twin as S
from corpuslens.plans.corpus_queries import HEADED, PARENTS, blocks, parented
from corpuslens.plans.registry import query
from corpuslens.plans.retrieval_queries import KEYS, lexical
from corpuslens.sources import views
from corpuslens.sources.tables import table

AR = S.AR
TITLED = "(parent_title || ' ' || p.text)"
QUOTE_SQL = f"regexp_extract(q.query_text, {S.q(E.QUOTED)}, 1)"
COMMA = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# --------------------------------------------------------------------------------------------- expansion


@query(
    "j4_expand_parents",
    S.ctes(
        S.CHUNKS, S.QUERIES, S.bm25("v_chunks", "doc_id, chunk_index", 5),
        "sp AS (SELECT DISTINCT query_id, doc_id, chunk_index//4 AS p FROM bm_top)",
        "g AS (SELECT sp.query_id, c.doc_id, c.chunk_index FROM sp JOIN v_chunks c ON c.doc_id=sp.doc_id AND c.chunk_index//4=sp.p)",
        "n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, chunk_index)-1 AS pos, count(*) OVER (PARTITION BY query_id) AS n FROM g)",
    )
    + "SELECT query_id, doc_id, CAST(chunk_index AS INT) AS chunk_index FROM n WHERE n<=12 OR pos IN (SELECT round_even(i*(n-1)/11.0::DOUBLE,0) FROM (SELECT unnest(range(12)) AS i))",
)
def expand_parents(spark, sf):
    parent = F.concat_ws("/", "source", F.floor(F.col("chunk_index") / 4).cast("string"))
    c = views.chunks(spark, sf).withColumn("parent_id", parent)
    seeds = lexical(spark, sf, 5).join(c.select(*KEYS, "parent_id"), KEYS)
    return E.expand_parents(seeds, c, 12)


LOCAL_Q = (
    "lq AS (SELECT doc_id AS query_id, doc_id, b.text AS query_text, CASE doc_id % 5 WHEN 0 THEN 'comparison' WHEN 1 THEN 'relation_two' WHEN 2 THEN 'abstract' WHEN 3 THEN 'full_summary' ELSE 'fact' END AS kind "
    "FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"
)


def local_queries(spark, sf):
    """One question per document, inside that document."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("_i"), F.col("text").alias("query_text"))
    m = F.col("doc_id") % 5
    kind = F.when(m == 0, "comparison").when(m == 1, "relation_two").when(m == 2, "abstract").when(m == 3, "full_summary").otherwise("fact")
    d = views.docs(spark, sf).select(F.col("doc_id").alias("query_id"), "doc_id", (F.col("doc_id") % b.count()).alias("_i"), kind.alias("kind"))
    return d.join(b, "_i").drop("_i")


@query(
    "j5_hierarchy_expand",
    S.ctes(
        *PARENTS, LOCAL_Q,
        f"hj AS (SELECT q.query_id, q.kind, p.*, coalesce(parent_id, parent_title) AS pk, len(list_intersect({S.terms('query_text')}, {S.terms(TITLED)})) AS ov FROM lq q JOIN pt p ON p.doc_id=q.doc_id)",
        "s8 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ov DESC, chunk_index) AS r FROM hj WHERE ov>0 AND kind NOT IN ('abstract','full_summary'))",
        "fp AS (SELECT query_id, kind, doc_id, pk, min(r) AS r FROM s8 WHERE r<=8 GROUP BY ALL)",
        "fk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS k FROM fp)",
        "gx AS (SELECT f.query_id, p.doc_id, p.chunk_index, row_number() OVER (PARTITION BY f.query_id ORDER BY p.chunk_index) AS c FROM fk f JOIN pt p ON p.doc_id=f.doc_id AND coalesce(p.parent_id,p.parent_title)=f.pk "
        "WHERE k <= CASE WHEN contains(kind,'comparison') OR contains(kind,'relation') THEN 3 ELSE 1 END)",
    )
    + "SELECT query_id, doc_id, chunk_index FROM gx WHERE c<=12 UNION ALL SELECT query_id, doc_id, chunk_index FROM hj WHERE (kind='abstract' AND parent_role='abstract') OR (kind='full_summary' AND parent_role<>'references')",
)
def hierarchy_expand(spark, sf):
    return E.hierarchy_expand(local_queries(spark, sf), parented(spark, sf))


@query(
    "j8_overlap_graph",
    S.ctes(
        *PARENTS, LOCAL_Q,
        "gc AS (SELECT doc_id, chunk_index, text, coalesce(parent_id, parent_title) AS g FROM pt)",
        "go AS (SELECT doc_id, g, min(chunk_index) AS o FROM gc GROUP BY ALL)",
        f"gt AS (SELECT DISTINCT doc_id, g, unnest({S.terms('text')}) AS term FROM gc)",
        f"wq AS (SELECT query_id, doc_id, unnest({S.terms('query_text')}) AS term FROM lq)",
        "hs AS (SELECT query_id, doc_id, g, count(*) AS n FROM wq JOIN gt USING (doc_id, term) GROUP BY ALL)",
        "sd AS (SELECT * FROM (SELECT h.*, o, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, o) AS r FROM hs h JOIN go USING (doc_id, g)) WHERE r<=2)",
        "ew AS (SELECT s.query_id, s.doc_id, s.g AS seed, b.g, (SELECT count(*) FROM gt x JOIN gt y ON x.doc_id=y.doc_id AND x.term=y.term WHERE x.doc_id=s.doc_id AND x.g=s.g AND y.g=b.g) AS w, b.o FROM sd s JOIN go b ON b.doc_id=s.doc_id AND b.g<>s.g)",
        "nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, seed ORDER BY w DESC, o) AS r FROM ew) WHERE r=1)",
        "pick AS (SELECT query_id, doc_id, g FROM sd UNION SELECT query_id, doc_id, g FROM nb)",
        "outp AS (SELECT p.query_id, c.doc_id, c.chunk_index, row_number() OVER (PARTITION BY p.query_id ORDER BY o, c.chunk_index) AS position FROM pick p JOIN go USING (doc_id, g) JOIN gc c USING (doc_id, g))",
    )
    + "SELECT query_id, doc_id, chunk_index, CAST(position AS INT) AS position FROM outp WHERE position<=12",
)
def overlap_graph(spark, sf):
    return E.overlap_graph(local_queries(spark, sf), parented(spark, sf))


AUG = (
    *PARENTS,
    "aq AS (SELECT b.item_id AS query_id, d.doc_id, b.text || CASE b.item_id % 4 WHEN 0 THEN ' which method and sample' WHEN 1 THEN ' how many and how much' WHEN 2 THEN ' important weight percent' ELSE ' “' || string_split(d0.text, '. ')[1] || '”' END AS query_text "
    "FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id JOIN documents d0 ON d0.doc_id = b.item_id)",
    "rk AS (SELECT query_id, d AS doc_id, 1 AS chunk_index, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d) AS INT) AS rank FROM (SELECT query_id, min(doc_id) AS d FROM aq GROUP BY query_id UNION ALL SELECT query_id, max(doc_id) FROM aq GROUP BY query_id HAVING min(doc_id)<max(doc_id)))",
    f"aj AS (SELECT q.query_id, q.query_text, {S.terms('q.query_text')} AS qt, p.doc_id, p.chunk_index, p.page, p.parent_role, p.text, {S.terms('p.text')} AS tt, {S.terms(QUOTE_SQL)} AS qq "
    "FROM aq q JOIN pt p ON p.doc_id=q.doc_id WHERE NOT EXISTS (SELECT 1 FROM rk WHERE rk.query_id=q.query_id AND rk.doc_id=p.doc_id AND rk.chunk_index=p.chunk_index))",
)


def lst(values) -> str:
    return "[" + ",".join(S.q(v) for v in values) + "]"


def aug_sql(where: str, order: str, take: int, slot: int) -> str:
    return (
        S.ctes(
            *AUG,
            f"ex AS (SELECT query_id, doc_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY {order}, doc_id, chunk_index) AS r FROM aj WHERE {where})",
            f"bo AS (SELECT query_id, doc_id, chunk_index, rank, 1 AS slot FROM rk UNION ALL SELECT query_id, doc_id, chunk_index, r, {slot} FROM ex WHERE r<={take})",
        )
        + "SELECT query_id, doc_id, CAST(chunk_index AS INT) AS chunk_index, slot<>1 AS added, CAST(row_number() OVER (PARTITION BY query_id ORDER BY slot, rank) AS INT) AS rank FROM bo"
    )


def augment(spark, sf, policy: str):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    d = views.docs(spark, sf)
    quote = d.select(F.col("doc_id").alias("query_id"), F.split("text", r"\. ")[0].alias("_s"))
    m = F.col("query_id") % 4
    tail = (
        F.when(m == 0, " which method and sample").when(m == 1, " how many and how much").when(m == 2, " important weight percent")
        .otherwise(F.concat(F.lit(" “"), F.col("_s"), F.lit("”")))
    )
    q = b.join(quote, "query_id").select("query_id", F.concat("text", tail).alias("query_text"))
    q = q.join(d.select("doc_id", (F.col("doc_id") % b.count()).alias("query_id")), "query_id")
    ends = q.groupBy("query_id").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    rows = F.array_distinct(F.array("a", "b"))
    ranking = ends.select("query_id", F.posexplode(rows).alias("_p", "doc_id"), F.lit(1).alias("chunk_index")).withColumn("rank", F.col("_p") + 1)
    return E.augment_evidence(ranking, q, parented(spark, sf), policy).select("query_id", *KEYS, "added", "rank")


PG = "coalesce(nullif(page,0), 1000000000)"


@query(
    "j6_augment_method",
    aug_sql(
        f"(len(list_intersect(qt,{lst(E.METHOD_CUES)}))>=2 OR len(regexp_extract_all(query_text, {S.q(E.HOW_MANY)}))>=2) AND parent_role IN ('abstract','method','methods','methodology')",
        f"len(list_intersect(tt,{lst(E.METHOD_CUES)})) DESC, {PG}", 2, 2,
    ),
)
def augment_method(spark, sf):
    return augment(spark, sf, "method")


@query("j6_augment_metric_abstract", aug_sql(f"len(list_intersect(qt,{lst(E.METRIC_CUES)}))>=2 AND parent_role='abstract'", PG, 1, 2))
def augment_metric(spark, sf):
    return augment(spark, sf, "metric_abstract")


@query(
    "j6_augment_numeric_abstract",
    aug_sql(
        f"regexp_matches(query_text,{S.q(E.NUMERIC_FACT)}) AND parent_role='abstract' AND regexp_matches(text,'[0-9]')",
        f"CASE WHEN regexp_matches(query_text,{S.q(E.PERCENT)}) AND contains(text,'%') THEN 1 ELSE 0 END DESC, len(list_intersect(qt,tt)) DESC, "
        f"CASE WHEN regexp_matches(text,'[{AR}]')=regexp_matches(query_text,'[{AR}]') THEN 1 ELSE 0 END DESC, {PG}", 2, 0,
    ),
)
def augment_numeric(spark, sf):
    return augment(spark, sf, "numeric_abstract")


@query(
    "j6_augment_quoted",
    aug_sql(
        "len(qq)>0 AND len(list_intersect(qq,tt)) >= greatest(2, round_even(len(qq)*0.6::DOUBLE,0))",
        f"CASE WHEN contains(array_to_string(list_sort(tt),' '), array_to_string(list_sort(qq),' ')) THEN 1 ELSE 0 END DESC, len(list_intersect(qq,tt)) DESC, {PG}", 3, 0,
    ),
)
def augment_quoted(spark, sf):
    return augment(spark, sf, "quoted")


# --------------------------------------------------------------------------------------------- coverage

COVER = (
    *PARENTS,
    "cv AS (SELECT doc_id AS answer_id, chunk_index AS pos, replace(parent_title,'Discussion','Conclusion') AS k, source, page, CASE WHEN chunk_index%3=0 THEN page+1 END AS page_end FROM pt)",
    "rq AS (SELECT answer_id, k, min(pos) AS pos FROM cv GROUP BY ALL)",
    "us AS (SELECT answer_id, k, min(-pos) AS u FROM cv WHERE pos%5<>4 GROUP BY ALL)",
    "cg AS (SELECT answer_id, list(k ORDER BY u) AS covered FROM us GROUP BY 1)",
    "rg AS (SELECT answer_id, list(k ORDER BY pos) AS required FROM rq GROUP BY 1)",
    "pg AS (SELECT answer_id, list_sort(list_distinct(flatten(list(range(page, coalesce(page_end,page)+1))))) AS pages FROM cv GROUP BY 1)",
    "al AS (SELECT p.answer_id, coalesce(covered,[]) AS covered, list_filter(required, lambda x: NOT list_contains(coalesce(covered,[]),x)) AS missing, pages, len(list_intersect(coalesce(covered,[]),required))::DOUBLE/len(required) AS r FROM pg p JOIN rg USING (answer_id) LEFT JOIN cg USING (answer_id))",
    "fl AS (SELECT *, len(list_filter(missing, lambda x: contains(lower(x),'conclusion')))>0 OR r<0.85 AS hard FROM al)",
)


def coverage_frames(spark, sf):
    p = parented(spark, sf)
    ev = p.select(
        F.col("doc_id").alias("answer_id"), F.col("chunk_index").alias("pos"), F.replace("parent_title", F.lit("Discussion"), F.lit("Conclusion")).alias("coverage_key"),
        "source", "page", F.when(F.col("chunk_index") % 3 == 0, F.col("page") + 1).alias("page_end"), "doc_id",
    )
    req = ev.groupBy("answer_id", "coverage_key").agg(F.min("pos").alias("pos"))
    used = ev.filter(F.col("pos") % 5 != 4).select(
        "answer_id", (-F.col("pos")).alias("pos"), F.concat(F.lit("e"), F.col("pos").cast("string")).alias("evidence_id")
    )
    return ev, req, used


@query(
    "a15_section_coverage",
    S.ctes(*COVER)
    + "SELECT answer_id, array_to_string(covered,'|') AS covered, array_to_string(missing,'|') AS missing, array_to_string(pages,',') AS pages, round(r,4) AS coverage_ratio, NOT hard AS coverage_passed, "
    "CASE WHEN len(missing)>0 AND NOT hard THEN 'optional_section_omission' END AS soft_warning FROM fl",
)
def section_coverage(spark, sf):
    s = E.section_coverage(*coverage_frames(spark, sf))
    return s.select("answer_id", F.array_join("covered", "|").alias("covered"), F.array_join("missing", "|").alias("missing"), COMMA("pages").alias("pages"), "coverage_ratio", "coverage_passed", "soft_warning")


@query("a15_source_page_ranges", S.ctes(*COVER) + "SELECT answer_id, source, CAST(min(page) AS INT) AS page_start, CAST(max(coalesce(page_end,page)) AS INT) AS page_end FROM cv GROUP BY ALL")
def source_page_ranges(spark, sf):
    return E.source_page_ranges(coverage_frames(spark, sf)[0])


@query(
    "a15_multi_document_covered",
    "SELECT source AS answer_id, NOT bool_or(doc_id % 10 = 3) AS all_documents_covered FROM documents WHERE doc_id % 10 <> 4 GROUP BY source",
)
def multi_document_covered(spark, sf):
    """Answers over all documents of a source, some of which are never cited."""
    d = views.docs(spark, sf).select(F.col("source").alias("answer_id"), F.col("doc_id").alias("pos"), "doc_id")
    used = d.filter(F.col("doc_id") % 10 != 3).select("answer_id", F.concat(F.lit("S"), F.col("pos").cast("string")).alias("evidence_id"))
    return E.multi_document_covered(d, d.filter(F.col("doc_id") % 10 != 4).select("answer_id", "doc_id"), used)


# --------------------------------------------------------------------------------------------- responses


def responses(spark, sf):
    """A structured answer per document, broken in one of fourteen ways by document number."""
    d = views.docs(spark, sf)
    m = F.col("doc_id") % 14
    text = F.concat("text", F.lit(" end."))
    js = lambda t, ids, head='{"answerable":true,"paragraphs":[': F.concat(F.lit(head), F.to_json(F.struct(t.alias("text"), ids.alias("evidence_ids"))), F.lit("]}"))
    ids = lambda *xs: F.array(*[F.lit(x) for x in xs])
    good = js(text, ids("E1", "s2"))
    raw = (
        F.when(m == 0, "  ")
        .when(m == 1, F.concat(F.lit("answer: "), F.col("source")))
        .when(m == 2, '{"answerable":"yes","paragraphs":[]}')
        .when(m == 3, '{"answerable":true}')
        .when(m == 4, js(text, ids("E1"), '{"answerable":false,"paragraphs":['))
        .when(m == 5, '{"answerable":false,"paragraphs":[]}')
        .when(m == 6, '{"answerable":true,"paragraphs":[]}')
        .when(m == 7, F.concat(F.lit('{"answerable":true,"paragraphs":["'), "source", F.lit('"]}')))
        .when(m == 8, js(F.concat(text, F.lit(" [S1] more.")), ids("E1")))
        .when(m == 9, js(F.concat(text, F.lit(" because ")), ids("E1")))
        .when(m == 10, js(F.concat(text, F.lit(" as follows:")), ids("E1")))
        .when(m == 11, js(text, ids("E1", "E2", "E3", "E4")))
        .when(m == 12, js(text, ids("E1", "E99")))
        .otherwise(F.concat(F.lit("```json\n"), good, F.lit("\n```")))
    )
    return d.select(F.col("doc_id").alias("response_id"), raw.alias("raw"), F.lit(5).alias("evidence_count"))


@query(
    "v1_validate_responses",
    "SELECT doc_id AS response_id, CASE doc_id % 14 WHEN 0 THEN 'primary_response_missing' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'schema_validation_failure' WHEN 3 THEN 'required_response_fields_missing' "
    "WHEN 4 THEN 'schema_validation_failure' WHEN 6 THEN 'schema_validation_failure' WHEN 7 THEN 'schema_validation_failure' WHEN 8 THEN 'citation_marker_format_invalid' WHEN 9 THEN 'truncated_output' "
    "WHEN 10 THEN 'unfinished_output' WHEN 11 THEN 'citation_marker_format_invalid' WHEN 12 THEN 'citation_marker_format_invalid' END AS error FROM documents",
)
def validate_responses(spark, sf):
    return E.validate_responses(responses(spark, sf)).select("response_id", "error")


CLEANED = r"regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '\s+([.!?؟،؛:])', '\1', 'g')"


@query(
    "v2_repair_responses",
    "SELECT doc_id AS response_id, " + CLEANED.format(x="text || ' end.' || CASE WHEN doc_id%14=8 THEN '  more.' ELSE '' END")
    + " AS text, CASE WHEN doc_id%14=8 OR doc_id%14=12 THEN 'E1' WHEN doc_id%14=11 THEN 'E1,E2,E3' ELSE 'E1,E2' END AS ids FROM documents WHERE doc_id%14 IN (8,11,12,13)",
)
def repair_responses(spark, sf):
    r = E.repair_responses(responses(spark, sf)).filter("repaired is not null")
    p = F.col("repaired")[0]
    return r.select("response_id", p["text"].alias("text"), F.array_join(p["evidence_ids"], ",").alias("ids"))


# Conversation turns as evidence and as claims about them; every text names a few numbers.
def _support_sql() -> str:
    stop = lst(E.CLAIM_STOPWORDS)

    def num(x: str) -> str:
        return rf"list_distinct(regexp_extract_all(regexp_replace({x}, ',', '.', 'g'), '[0-9]+(?:\.[0-9]+)?'))"

    def ct(x: str) -> str:
        return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[A-Za-z{AR}]{{3,}}'), lambda w: NOT list_contains({stop}, w)))"

    steps = []
    prev = "p0"
    for i in (1, 2, 3):
        steps.append(
            f"b{i} AS (SELECT p.answer_id, p.claim_no, c.id, c.nums, len(list_intersect(c.nums, p.lft)) AS g, row_number() OVER (PARTITION BY p.answer_id, p.claim_no ORDER BY len(list_intersect(c.nums, p.lft)) DESC, c.scope DESC, c.prop DESC, c.th DESC, c.qh DESC, c.width, c.pos) AS r "
            f"FROM {prev} p JOIN ca c ON c.answer_id=p.answer_id AND c.claim_no=p.claim_no AND NOT list_contains(p.sel, c.id))"
        )
        steps.append(
            f"p{i} AS (SELECT p.answer_id, p.claim_no, CASE WHEN coalesce(b.g,0)>0 THEN list_append(p.sel, b.id) ELSE p.sel END AS sel, CASE WHEN coalesce(b.g,0)>0 THEN list_filter(p.lft, lambda x: NOT list_contains(b.nums, x)) ELSE p.lft END AS lft "
            f"FROM {prev} p LEFT JOIN b{i} b ON b.answer_id=p.answer_id AND b.claim_no=p.claim_no AND b.r=1)"
        )
        prev = f"p{i}"
    return (
        S.ctes(
            "ev AS (SELECT conv_id AS answer_id, turn+1 AS pos, 'E' || (turn+1) AS id, text || ' score ' || turn || ',5 of ' || (turn // 2) AS t, role AS k, turn AS page, turn + turn % 3 AS page_end FROM conversations)",
            f"e2 AS (SELECT *, {num('t')} AS en, {ct('t')} AS et, greatest(0, coalesce(nullif(page_end,0),page)-page) AS width FROM ev)",
            "cl AS (SELECT conv_id AS answer_id, turn AS claim_no, text || CASE turn % 3 WHEN 0 THEN ' with 1.5 and 2.5' WHEN 1 THEN '' ELSE ' with ' || (turn // 2) || ' and 77.7' END AS t, ['E1', 'E3'] AS prop FROM conversations)",
            f"c2 AS (SELECT *, {num('t')} AS cn, {ct('t')} AS ctm FROM cl)",
            "sc AS (SELECT c.answer_id, c.claim_no, list(DISTINCT e.k) AS sk FROM c2 c JOIN e2 e ON e.answer_id=c.answer_id AND list_contains(c.prop, e.id) GROUP BY ALL)",
            "ca AS (SELECT c.answer_id, c.claim_no, e.pos, e.id, list_intersect(c.cn, e.en) AS nums, 0 AS qh, len(list_intersect(c.ctm, e.et)) AS th, list_contains(c.prop, e.id) AS prop, coalesce(list_contains(s.sk, e.k), false) AS scope, e.width, len(c.cn) AS ncn, len(c.ctm) AS nct "
            "FROM c2 c JOIN e2 e ON e.answer_id=c.answer_id LEFT JOIN sc s ON s.answer_id=c.answer_id AND s.claim_no=c.claim_no WHERE NOT (len(c.cn)>0 AND len(list_intersect(c.cn, e.en))=0))",
            "so AS (SELECT *, max(th) OVER (PARTITION BY answer_id, claim_no) AS mx FROM ca WHERE ncn=0 AND scope AND NOT prop AND th>0)",
            "s3 AS (SELECT answer_id, claim_no, list(id ORDER BY qh DESC, width, pos)[1:3] AS ids FROM so WHERE th=mx GROUP BY ALL)",
            "he AS (SELECT answer_id, claim_no, list(id ORDER BY pos)[1:3] AS ids FROM ca WHERE ncn=0 AND prop AND (th>0 OR nct=0) GROUP BY ALL)",
            "p0 AS (SELECT answer_id, claim_no, []::VARCHAR[] AS sel, cn AS lft FROM c2 WHERE len(cn)>0)",
            *steps,
        )
        + "SELECT c.answer_id, c.claim_no, array_to_string(CASE WHEN len(cn)=0 THEN coalesce(s3.ids, he.ids, c.prop[1:3]) WHEN len(p3.lft)>0 THEN []::VARCHAR[] ELSE p3.sel END, ',') AS supporting, "
        "CASE WHEN len(cn)=0 THEN CASE WHEN s3.ids IS NOT NULL THEN 'repaired' ELSE 'retained' END WHEN len(p3.lft)>0 THEN 'anchor_mismatch' WHEN p3.sel <> c.prop[1:len(p3.sel)] THEN 'repaired' ELSE 'retained' END AS status "
        "FROM c2 c LEFT JOIN s3 USING (answer_id, claim_no) LEFT JOIN he USING (answer_id, claim_no) LEFT JOIN p3 ON p3.answer_id=c.answer_id AND p3.claim_no=c.claim_no"
    )


@query("v3_verify_support", _support_sql())
def verify_support(spark, sf):
    t, n = views.turns(spark, sf), F.col("turn")
    s = lambda c: c.cast("string")
    half = F.floor(n / 2)
    ev = t.select(
        F.col("conv_id").alias("answer_id"), (n + 1).alias("pos"), F.concat(F.lit("E"), s(n + 1)).alias("evidence_id"),
        F.concat("text", F.lit(" score "), s(n), F.lit(",5 of "), s(half)).alias("text"), F.col("role").alias("coverage_key"), n.alias("page"), (n + n % 3).alias("page_end"),
    )
    extra = F.when(n % 3 == 0, " with 1.5 and 2.5").when(n % 3 == 1, "").otherwise(F.concat(F.lit(" with "), s(half), F.lit(" and 77.7")))
    cl = t.select(F.col("conv_id").alias("answer_id"), n.alias("claim_no"), F.concat("text", extra).alias("text"), F.array(F.lit("E1"), F.lit("E3")).alias("proposed"))
    return E.verify_support(cl, ev).select("answer_id", "claim_no", F.array_join("supporting", ",").alias("supporting"), "status")


@query(
    "v4_render_citations",
    S.ctes(
        "pa AS (SELECT conv_id AS a, turn AS p, " + CLEANED.format(x="text") + " AS t FROM conversations)",
        "u AS (SELECT conv_id AS a, turn AS p, 1 AS i, 'src' || (turn % 3) AS l FROM conversations WHERE turn%4<>3 UNION ALL SELECT conv_id, turn, 2, 'src' || (turn % 2) FROM conversations WHERE turn%4<>3)",
        "f AS (SELECT a, l, min(p*1000+i) AS fp FROM u GROUP BY ALL)",
        "m AS (SELECT a, l, dense_rank() OVER (PARTITION BY a ORDER BY fp) AS k FROM f)",
        "x AS (SELECT u.a, p, k, min(i) AS i FROM u JOIN m USING (a, l) GROUP BY ALL)",
        "y AS (SELECT a, p, string_agg('[S' || k || ']', ' ' ORDER BY i) AS mk FROM x GROUP BY ALL)",
        "z AS (SELECT pa.a, pa.p, t || ' ' || mk AS line FROM pa LEFT JOIN y ON y.a=pa.a AND y.p=pa.p)",
        "s AS (SELECT a, string_agg(l, '|' ORDER BY k) AS src FROM m GROUP BY a)",
    )
    + "SELECT z.a AS answer_id, string_agg(line, chr(10)||chr(10) ORDER BY p) AS answer, coalesce(any_value(src),'') AS sources, CAST(count(line) AS INT) AS paragraphs, CAST(count(*)-count(line) AS BIGINT) AS rejected, "
    "CASE WHEN count(line)>0 THEN 'validated' ELSE 'no_supported_paragraphs' END AS status FROM z LEFT JOIN s ON s.a=z.a GROUP BY z.a",
)
def render_citations(spark, sf):
    t = views.turns(spark, sf).select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("par_no"), "text")
    p = F.col("par_no")
    two = F.array(
        F.struct(F.lit(1).alias("id_no"), F.concat(F.lit("src"), (p % 3).cast("string")).alias("label")),
        F.struct(F.lit(2).alias("id_no"), F.concat(F.lit("src"), (p % 2).cast("string")).alias("label")),
    )
    used = t.filter(p % 4 != 3).select("answer_id", "par_no", F.inline(two))
    r = E.render_citations(t, used)
    return r.select("answer_id", "answer", F.array_join("sources", "|").alias("sources"), "paragraphs", "rejected", "status")


@query(
    "v4_move_markers",
    S.ctes(
        "s AS (SELECT doc_id, unnest(range(len(a))) AS i, trim(unnest(a)) AS p FROM (SELECT doc_id, string_split(replace(text, chr(10), ' [S2]' || chr(10) || chr(10)), chr(10)||chr(10)) AS a FROM documents))",
        "r AS (SELECT doc_id, i, " + CLEANED.format(x="replace(p, '[S2]', '')") + " AS b, contains(p, '[S2]') AS m FROM s WHERE p<>'')",
    )
    + "SELECT doc_id AS answer_id, string_agg(b || CASE WHEN m THEN ' [S2]' ELSE '' END, chr(10)||chr(10) ORDER BY i) AS answer FROM r WHERE b<>'' GROUP BY doc_id",
)
def move_markers(spark, sf):
    d = views.docs(spark, sf)
    text = F.replace("text", F.lit("\n"), F.lit(" [S2]\n\n"))
    return E.move_markers(d.select(F.col("doc_id").alias("answer_id"), text.alias("text"), F.lit(2).alias("n_sources"))).select("answer_id", "answer")


def _clean_head(x: str) -> str:
    bad = rf"{x} IS NULL OR {x}='' OR {x}='[]' OR regexp_matches({x},'(?i)www\.|https?://|takbook|\.com') OR length({x})>80 OR len(string_split_regex({x}, '\s+'))>10 OR regexp_matches({x},'(\.|؟|!|\[1\])$')"
    return f"CASE WHEN NOT ({bad}) THEN {x} END"


@query(
    "v5_citation_labels",
    S.ctes(*HEADED)
    + f"SELECT b.doc_id, CAST(b.block_no AS INT) AS block_no, concat_ws(' - ', d.source, coalesce({_clean_head('b.subsection')}, {_clean_head('b.section')}, {_clean_head('b.chapter')}), "
    f"CASE WHEN b.page<>0 AND b.page%3=0 THEN {S.q(C.PAGE_MANY)} || b.page || {S.q(C.PAGE_TO)} || (b.page+2) WHEN b.page<>0 THEN {S.q(C.PAGE_ONE)} || b.page END) AS label FROM v_body b JOIN documents d USING (doc_id)",
)
def citation_labels(spark, sf):
    b = C.fill_headings(blocks(spark, sf)).join(views.docs(spark, sf).select("doc_id", "source"), "doc_id")
    b = b.withColumn("page_end", F.when(F.col("page") % 3 == 0, F.col("page") + 2))
    return b.select("doc_id", "block_no", C.citation_label(b).alias("label"))


@query(
    "v6_cited_pages",
    S.ctes(
        "l AS (SELECT l_orderkey AS a, l_linenumber AS k, l_suppkey % 50 + 1 AS n FROM lineitem)",
        "p AS (SELECT a, unnest(CASE k % 4 WHEN 0 THEN [n] WHEN 1 THEN range(n, n+3) WHEN 2 THEN [3,4,5,6,7] ELSE []::BIGINT[] END) AS pg FROM l)",
        "g AS (SELECT a, string_agg(CAST(pg AS VARCHAR), ',' ORDER BY pg) AS pages FROM (SELECT DISTINCT a, pg FROM p) GROUP BY a)",
    )
    + "SELECT DISTINCT l.a AS answer_id, coalesce(pages,'') AS pages FROM l LEFT JOIN g ON g.a=l.a",
)
def cited_pages(spark, sf):
    k, n = F.col("l_linenumber") % 4, F.col("l_suppkey") % 50 + 1
    label = (
        F.when(k == 0, F.concat(F.lit("report - صفحه "), n.cast("string")))
        .when(k == 1, F.concat(F.lit("report, Pages "), n.cast("string"), F.lit(" - "), (n + 2).cast("string")))
        .when(k == 2, "report - صفحات ۷ تا ۳")
        .otherwise("report 12")
    )
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.collect_list(label).alias("labels"))
    return g.select("answer_id", COMMA(E.cited_pages(F.col("labels"))).alias("pages"))


# --------------------------------------------------------------------------------------------- tables in text

ROWS = (
    "pr AS (SELECT p_brand, p_size, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS k FROM part)",
    "rw AS (SELECT p_brand || '/' || p_size || '/' || ((k-1)//99) AS g, (k-1)%99+1 AS k, CASE k % 2 WHEN 0 THEN 1 ELSE 2 END AS page, p_name || ' ' || p_brand || ' item' AS label, 0.25::DOUBLE + (p_partkey % 7) / 10.0 AS v FROM pr)",
    "dg AS (SELECT *, translate(regexp_replace(regexp_replace(CAST(round(v,2) AS VARCHAR), '0+$', ''), '\\.$', ''), '0123456789.', '۰۱۲۳۴۵۶۷۸۹٫') AS value FROM rw)",
)


def part_tables(spark, sf):
    """Two pages of collapsed table text per (brand, size) and run of 99 parts, since a rank has at most two digits."""
    from pyspark.sql import Window

    p = table(spark, sf, "part")
    n = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    r = p.withColumn("n", n - 1).select(
        F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), F.floor(F.col("n") / 99).cast("string")).alias("g"),
        (F.col("n") % 99 + 1).alias("k"),
        F.when(F.col("n") % 2 == 1, 1).otherwise(2).alias("page"),
        F.concat("p_name", F.lit(" "), "p_brand", F.lit(" item")).alias("label"),
        F.format_string("%.2f", F.lit(0.25) + (F.col("p_partkey") % 7) / 10.0).alias("v"),
    )
    cell = F.struct("k", F.concat_ws(" ", "label", "v", F.col("k").cast("string")).alias("c"))
    pages = r.groupBy("g", "page").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    text = F.concat(F.lit("Table "), F.length("g").cast("string"), F.lit(" option score rank "), F.array_join(F.transform("c", lambda x: x["c"]), "  "))
    return pages.select("g", "page", text.alias("text"))


@query(
    "c19_extract_ranked_rows",
    S.ctes(*ROWS) + "SELECT g, page, CAST(row_number() OVER (PARTITION BY g, page ORDER BY k) AS INT) AS row_no, label, value, CAST(k AS INT) AS rank FROM dg",
)
def extract_ranked_rows(spark, sf):
    return E.extract_ranked_rows(part_tables(spark, sf), ["g"], "page")


@query(
    "c20_table_pages",
    S.ctes(
        S.PAGES,
        "tp AS (SELECT doc_id, page, CASE WHEN (doc_id+page)%4=0 THEN text || chr(10) || '  Table ' || (doc_id%5) || '. ' || lang WHEN (doc_id+page)%4=1 THEN text || ' see table ' || (doc_id%5) ELSE text END AS t FROM v_pages)",
        "q AS (SELECT doc_id AS query_id, doc_id, CASE WHEN doc_id%2=0 THEN CAST(doc_id%3 AS VARCHAR) ELSE '' END AS no FROM documents)",
    )
    + r"SELECT query_id, q.doc_id, CAST(page AS INT) AS page FROM q JOIN tp USING (doc_id) WHERE CASE WHEN no='' THEN regexp_matches(t, '(?i)(?:جدول|table)\s*[0-9]+') ELSE regexp_matches(t, '(?im)^\s*(?:جدول|table)\s*' || no || '\b') END",
)
def table_pages(spark, sf):
    p, i = views.pages(spark, sf), F.col("doc_id")
    m = (i + F.col("page")) % 4
    no = (i % 5).cast("string")
    text = F.when(m == 0, F.concat("text", F.lit("\n  Table "), no, F.lit(". "), "lang")).when(m == 1, F.concat("text", F.lit(" see table "), no)).otherwise(F.col("text"))
    q = views.docs(spark, sf).select(
        i.alias("query_id"), "doc_id", F.when(i % 2 == 0, F.concat(F.lit("What does Table "), (i % 3).cast("string"), F.lit(" show"))).otherwise("What do they show").alias("query_text")
    )
    return E.table_pages(q, p.select("doc_id", "page", text.alias("text")))


TABLE_TERMS = "list_filter({terms}, lambda t: NOT list_contains({stop}, t))"


def _table_terms(x: str) -> str:
    return TABLE_TERMS.format(terms=S.terms(x), stop=lst(E.TABLE_STOPWORDS))


@query(
    "c21_table_lookup",
    S.ctes(
        *ROWS,
        "o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY page, k) AS row_no FROM dg)",
        "h AS (SELECT g, length(g)%2=0 AS premise, length(g)%3=0 AS named, 'Which option is the ' || arg_max(label, k) AS ask FROM dg GROUP BY g)",
        "t AS (SELECT o.*, premise FROM o JOIN h USING (g) WHERE k=2 AND NOT named)",
        "c AS (SELECT t.g, arg_min(o.label, o.row_no) AS fix FROM t JOIN o ON o.g=t.g AND o.row_no<>t.row_no AND o.value='۰٫۳۵' WHERE premise AND t.value<>'۰٫۳۵' GROUP BY t.g)",
        f"w AS (SELECT o.g, o.label, o.value, o.k, o.row_no, {_table_terms('ask')} AS qt, {_table_terms('o.label')} AS lt FROM o JOIN h ON h.g=o.g AND named)",
        "v AS (SELECT *, len(list_intersect(qt, lt)) AS hits FROM w)",
        "b AS (SELECT * FROM v WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY g ORDER BY hits::DOUBLE/greatest(len(lt),1) DESC, hits DESC, row_no) = 1)",
    )
    + "SELECT t.g, label, value, CAST(k AS INT) AS rank, 'rank' AS matched_by, CASE WHEN premise THEN value='۰٫۳۵' END AS premise_correct, fix AS correction FROM t LEFT JOIN c USING (g) "
    "UNION ALL SELECT g, label, value, CAST(k AS INT), 'label', NULL, NULL FROM b WHERE hits >= 2",
)
def table_lookup(spark, sf):
    """A third of the tables are asked by the label of their last rank, the others by rank, half of those with a premise."""
    from pyspark.sql import Window

    rows = E.extract_ranked_rows(part_tables(spark, sf), ["g"], "page")
    rows = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("g").orderBy("page", "row_no")))
    by_rank = F.when(F.length("g") % 2 == 0, "Is the rank second at 0.35?").otherwise("Which was ranked 2")
    last = rows.groupBy("g").agg(F.max_by("label", "rank").alias("last"))
    q = last.select("g", F.when(F.length("g") % 3 == 0, F.concat(F.lit("Which option is the "), "last")).otherwise(by_rank).alias("query_text"))
    return E.table_lookup(q, rows, "g")


@query(
    "c22_extract_relations",
    "SELECT o_custkey AS g, CAST(arg_min(o_orderkey % 90 + 1, o_orderkey) FILTER (WHERE o_orderkey % 4 <> 0) AS VARCHAR) AS people, CAST(arg_min(o_orderkey % 40 + 2, o_orderkey) FILTER (WHERE o_orderkey % 4 <> 0) AS VARCHAR) AS factors, "
    "round(arg_min((o_orderkey % 80 + 10) / 100.0::DOUBLE, o_orderkey) FILTER (WHERE o_orderkey % 4 <> 0), 4) AS kappa, "
    "arg_min(['cost','service quality','time'][o_orderkey % 3 + 1], o_orderkey) FILTER (WHERE o_orderkey % 5 = 1) AS criterion, "
    "arg_min(translate('0.' || (o_orderkey % 8 + 11), '0123456789.', '۰۱۲۳۴۵۶۷۸۹٫'), o_orderkey) FILTER (WHERE o_orderkey % 5 = 1) AS weight, "
    "arg_min((o_orderkey % 50) || ',' || (o_orderkey % 30) || '.5,7', o_orderkey) FILTER (WHERE o_orderkey % 7 = 2) AS variance FROM orders GROUP BY o_custkey",
)
def extract_relations(spark, sf):
    """A methods sentence per order; some lack the agreement value, some name a criterion or explained variance."""
    i = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    tail = F.when(i % 4 == 0, ".").otherwise(F.concat(F.lit(" and reached Cohen's kappa of 0."), s(i % 80 + 10), F.lit(".")))
    name = F.element_at(F.array(F.lit("cost"), F.lit("service quality"), F.lit("time")), (i % 3 + 1).cast("int"))
    criterion = F.when(i % 5 == 1, F.concat(F.lit(" The "), name, F.lit(" criterion had a weight of 0."), s(i % 8 + 11), F.lit(" and was the most important."))).otherwise("")
    variance = F.when(i % 7 == 2, F.concat(F.lit(" They explained "), s(i % 50), F.lit("%, "), s(i % 30), F.lit(".5% and 7% of the variance."))).otherwise("")
    text = F.concat(F.lit("We spoke with "), s(i % 90 + 1), F.lit(" experts, found "), s(i % 40 + 2), F.lit(" key factors"), tail, criterion, variance)
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), i.alias("page"), F.lit("body").alias("parent_role"), text.alias("text"))
    r = E.extract_relations(p, ["g"])
    return r.select("g", "people", "factors", F.round("kappa", 4).alias("kappa"), "criterion", "weight", F.array_join("variance", ",").alias("variance"))
