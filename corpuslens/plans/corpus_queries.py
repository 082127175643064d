"""Runnable queries of the corpus-preparation jobs, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import corpus as C
from corpuslens.operators import relational as B
from corpuslens.plans import twin as S
from corpuslens.plans.registry import query
from corpuslens.sources import views

AR = S.AR
LET = f"[A-Za-z{AR}]"
DIG = r"[0-9\x{06f0}-\x{06f9}]"
ORD = C.ORDINALS
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
END = r"[.!?\x{061f}\x{06d4}]"

BLOCKS = (
    S.MARKDOWN,
    r"bk0 AS (SELECT doc_id, string_split_regex(text, '\n\s*\n+') AS seg, regexp_extract_all(text, '\n\s*\n+') AS sep FROM v_markdown)",
    "bk1 AS (SELECT doc_id, unnest(range(len(seg))) AS pos, unnest(seg) AS raw, unnest(list_concat(list_transform(sep, lambda s: length(s)), [0])) AS gap FROM bk0)",
    "bk2 AS (SELECT *, coalesce(sum(length(raw)+gap) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS cs, trim(raw, " + BLANKS + ") AS text FROM bk1)",
    r"bk3 AS (SELECT *, regexp_extract(text, '^<!--\s*page:(\d+)\s*-->$', 1) AS pg FROM bk2 WHERE text <> '')",
    "v_blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS block_no, text, CAST(cs AS BIGINT) AS char_start, CAST(cs+length(raw) AS BIGINT) AS char_end, "
    "CAST(last_value(nullif(pg,'') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS page, pg<>'' AS is_marker FROM bk3)",
)

HEADED = (
    *BLOCKS,
    r"hd0 AS (SELECT *, CASE WHEN regexp_matches(text, '^(#{1,3})\s+(.+)$') AND length(trim(regexp_extract(text, '^(#{1,3})\s+(.+)$', 2)))<=120 THEN length(regexp_extract(text, '^(#{1,3})\s+(.+)$', 1)) END AS lv, "
    r"trim(regexp_extract(text, '^(#{1,3})\s+(.+)$', 2)) AS ti FROM v_blocks)",
    "hd1 AS (SELECT *, sum(CASE WHEN lv IS NOT NULL THEN 1 ELSE 0 END) OVER w AS heading_group, sum(CASE WHEN lv=1 THEN 1 ELSE 0 END) OVER w AS n1, "
    "sum(CASE WHEN lv<=2 THEN 1 ELSE 0 END) OVER w AS n2, last_value(CASE WHEN lv=1 THEN ti END IGNORE NULLS) OVER w AS chapter FROM hd0 WINDOW w AS (PARTITION BY doc_id ORDER BY block_no))",
    "hd2 AS (SELECT *, last_value(CASE WHEN lv=2 THEN ti END IGNORE NULLS) OVER (PARTITION BY doc_id, n1 ORDER BY block_no) AS section, "
    "last_value(CASE WHEN lv=3 THEN ti END IGNORE NULLS) OVER (PARTITION BY doc_id, n2 ORDER BY block_no) AS subsection FROM hd1)",
    "v_body AS (SELECT * FROM hd2 WHERE lv IS NULL AND NOT is_marker)",
)


def md(spark, sf):
    return views.markdown(spark, sf)


def blocks(spark, sf):
    return C.split_blocks(md(spark, sf))


@query("c4_split_pages", S.ctes(S.MARKDOWN, r"p0 AS (SELECT doc_id, regexp_extract_all(text, '(?m)^<!--\s*page:(\d+)\s*-->\s*$', 1) AS n, string_split_regex(text, '(?m)^<!--\s*page:\d+\s*-->\s*$') AS b FROM v_markdown)")
       + "SELECT doc_id, CAST(unnest(n) AS INT) AS page, trim(unnest(b[2:]), " + BLANKS + ") AS text FROM p0")
def split_pages(spark, sf):
    return C.split_pages(md(spark, sf))


@query("c5_split_blocks", S.ctes(*BLOCKS) + "SELECT doc_id, CAST(block_no AS INT) AS block_no, text, char_start, char_end, page FROM v_blocks")
def split_blocks(spark, sf):
    return blocks(spark, sf)


@query("w5_fill_headings", S.ctes(*HEADED) + "SELECT doc_id, CAST(block_no AS INT) AS block_no, CAST(heading_group AS BIGINT) AS heading_group, chapter, section, subsection, page FROM v_body")
def fill_headings(spark, sf):
    return C.fill_headings(blocks(spark, sf)).select("doc_id", "block_no", "heading_group", "chapter", "section", "subsection", "page")


@query("c6_chunk_fixed", S.ctes(S.CHUNKS) + "SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, char_start, CAST(char_end AS BIGINT) AS char_end, text FROM v_chunks")
def chunk_fixed(spark, sf):
    return views.chunks(spark, sf).select("doc_id", "chunk_index", "char_start", "char_end", "text")


def pack_sql(name: str, source: str, keys: str, budget: int) -> str:
    """source(keys, seq from 1, s) to name(keys, seq, batch): greedy packing with reset as a recursive CTE."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"n.{k}=p.{k}" for k in ks)
    return (
        f"{name} AS (SELECT {keys}, seq, s AS used, 1 AS batch FROM {source} WHERE seq=1 UNION ALL "
        f"SELECT {', '.join('n.' + k for k in ks)}, n.seq, CASE WHEN p.used+n.s>{budget} THEN n.s ELSE p.used+n.s END, "
        f"CASE WHEN p.used+n.s>{budget} THEN p.batch+1 ELSE p.batch END FROM {name} p JOIN {source} n ON {on} AND n.seq=p.seq+1)"
    )


CHUNKED = (
    *HEADED,
    f"sn0 AS (SELECT doc_id, heading_group, block_no, string_split(regexp_replace(text, '({END})\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM v_body WHERE length(text)>1900)",
    "sn1 AS (SELECT doc_id, block_no, unnest(range(len(s)))+1 AS seq, unnest(s) AS s FROM sn0)",
    "sn2 AS (SELECT doc_id, block_no, seq, s AS cur, 1 AS piece FROM sn1 WHERE seq=1 UNION ALL SELECT n.doc_id, n.block_no, n.seq, "
    "CASE WHEN length(p.cur)+1+length(n.s)>1900 THEN n.s ELSE p.cur || ' ' || n.s END, CASE WHEN length(p.cur)+1+length(n.s)>1900 THEN p.piece+1 ELSE p.piece END "
    "FROM sn2 p JOIN sn1 n ON n.doc_id=p.doc_id AND n.block_no=p.block_no AND n.seq=p.seq+1)",
    "sn3 AS (SELECT doc_id, block_no, piece, arg_max(cur, seq) AS t FROM sn2 GROUP BY ALL)",
    "sn4 AS (SELECT doc_id, block_no, piece, unnest(range(0, length(t), 1900)) AS o, t FROM sn3)",
    "pc0 AS (SELECT doc_id, block_no, piece*100000+o AS sub, substring(t, o+1, 1900) AS t FROM sn4 UNION ALL SELECT doc_id, block_no, 0, text FROM v_body WHERE length(text)<=1900)",
    "pc1 AS (SELECT p.doc_id, CAST(b.heading_group AS BIGINT) AS hg, p.block_no, p.sub, p.t, length(p.t) AS s, b.char_start, b.char_end, b.page, b.chapter, b.section, b.subsection, "
    "row_number() OVER (PARTITION BY p.doc_id, b.heading_group ORDER BY p.block_no, p.sub) AS seq FROM pc0 p JOIN v_body b ON b.doc_id=p.doc_id AND b.block_no=p.block_no)",
    pack_sql("pk", "pc1", "doc_id, hg", 1400),
    "ch0 AS (SELECT c.doc_id, c.hg, k.batch, string_agg(t, chr(10)||chr(10) ORDER BY c.seq) AS body, arg_min(char_start, c.seq) AS char_start, arg_max(char_end, c.seq) AS char_end, "
    "arg_min(coalesce(page,-1), c.seq) AS page, min(chapter) AS chapter, min(section) AS section, min(subsection) AS subsection FROM pc1 c JOIN pk k ON k.doc_id=c.doc_id AND k.hg=c.hg AND k.seq=c.seq GROUP BY ALL)",
    "ch1 AS (SELECT *, lag(body) OVER (PARTITION BY doc_id, hg ORDER BY batch) AS pv, row_number() OVER (PARTITION BY doc_id ORDER BY hg, batch) AS chunk_index FROM ch0)",
    f"ch2 AS (SELECT *, right(pv,252) AS tl, regexp_matches(left(pv, length(pv)-252) || regexp_extract(right(pv,252), '^\\s*'), '{END}\\s+$') AS atc FROM ch1)",
    f"ch3 AS (SELECT *, CASE WHEN pv IS NULL OR length(pv)<=252 THEN '' ELSE trim(CASE WHEN atc THEN tl WHEN regexp_matches(tl, '(?s)^.*?{END}\\s+(.*)$') THEN regexp_extract(tl, '(?s)^.*?{END}\\s+(.*)$', 1) ELSE tl END, {BLANKS}) END AS tail FROM ch2)",
    "v_struct AS (SELECT doc_id, chunk_index, chapter, section, subsection, nullif(page,-1) AS page, char_start, char_end, CASE WHEN tail<>'' THEN tail || chr(10)||chr(10) || body ELSE body END AS text FROM ch3)",
)


@query(
    "c7_chunk_structured",
    S.ctes(*CHUNKED) + "SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, chapter, section, subsection, CAST(page AS INT) AS page, char_start, char_end, text FROM v_struct",
)
def chunk_structured(spark, sf):
    return C.chunk_structured(blocks(spark, sf))


@query(
    "c8_context_header",
    S.ctes(*HEADED)
    + "SELECT doc_id, CAST(block_no AS INT) AS block_no, concat_ws(chr(10), CASE WHEN chapter<>'' THEN 'Chapter: '||chapter END, CASE WHEN section<>'' THEN 'Section: '||section END, "
    "CASE WHEN subsection<>'' THEN 'Subsection: '||subsection END, CASE WHEN page<>0 THEN 'Page: '||page END) || CASE WHEN chapter IS NULL AND section IS NULL AND subsection IS NULL AND page IS NULL THEN '' ELSE chr(10)||chr(10) END || text AS embedded_text FROM v_body",
)
def context_header(spark, sf):
    return C.context_header(C.fill_headings(blocks(spark, sf))).select("doc_id", "block_no", "embedded_text")


# --------------------------------------------------------------------------------------------- cleaning

CLEAN = (
    S.MARKDOWN,
    "nm AS (SELECT doc_id, replace(replace(line,'.',''),'/','') AS stem FROM v_lines WHERE line_no=0)",
    r"cl0 AS (SELECT m.doc_id, stem, unnest(range(len(a))) AS line_no, unnest(a) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM v_markdown) m JOIN nm USING (doc_id))",
    "cl1 AS (SELECT *, " + S.visible("raw") + " AS line FROM cl0)",
    "cl2 AS (SELECT *, " + S.compact("line") + " AS sig, " + S.compact("stem") + r" AS tsig, regexp_matches(line, '^\s*<!--\s*page:\d+\s*-->\s*$') AS mk, regexp_matches(line, '^\s*#{1,3}\s+') AS hd, "
    + S.count_re("line", LET) + r" AS nlet, regexp_replace(line, '\s+', '', 'g') AS pk FROM cl1)",
    r"cl3 AS (SELECT *, min(CASE WHEN regexp_matches(line, '(?i)^\s*#{1,3}\s+(فصل|بخش|chapter|part)\b') THEN line_no END) OVER (PARTITION BY doc_id) AS fc, "
    + S.count_re("pk", LET) + " AS pl, " + S.count_re("pk", DIG) + " AS pd, length(pk) AS pn FROM cl2)",
    "cl4 AS (SELECT *, min(CASE WHEN line_no>fc AND length(line)>=180 AND nlet>=120 THEN line_no END) OVER (PARTITION BY doc_id) AS fb, "
    f"sum(CASE WHEN line<>'' AND NOT mk AND regexp_matches(sig,'{LET}') AND length(line)<=100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sig) AS seen, tsig<>'' AND sig=tsig AS ttl FROM cl3)",
    r"cl5 AS (SELECT *, CASE WHEN line='' OR mk THEN '-' WHEN line_no<fc THEN 'front_matter' WHEN line_no>fc AND line_no<fb AND NOT hd THEN 'preface_toc' "
    r"WHEN regexp_matches(line, '(?i)(https?://|www\.|takbook(?:\.com)?)') THEN 'url_or_watermark' WHEN (pl=0 AND pn<=8) OR (pn<=40 AND pd>=3 AND pl<=6 AND pd>=pl*2) THEN 'tiny_code' END AS early FROM cl4)",
    "cl6 AS (SELECT *, sum(CASE WHEN early IS NULL AND ttl THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS turn FROM cl5)",
    "cl7 AS (SELECT doc_id, line_no, CASE WHEN early IS NULL AND ttl THEN stem ELSE line END AS line, CASE WHEN early='-' THEN NULL WHEN early IS NOT NULL THEN early "
    "WHEN sig<>'' AND seen>=5 AND NOT hd AND NOT (ttl AND turn=1) THEN 'repeated_line' END AS reason FROM cl6)",
    "cl8 AS (SELECT doc_id, line_no, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS pv FROM cl7 WHERE reason IS NULL)",
    "cl9 AS (SELECT doc_id, trim(string_agg(line, chr(10) ORDER BY line_no), " + BLANKS + ") || chr(10) AS text FROM cl8 WHERE NOT (line='' AND coalesce(pv='',false)) GROUP BY doc_id)",
)


def named_markdown(spark, sf):
    first = F.split("text", "\n")[0]
    names = views.docs(spark, sf).select("doc_id", F.concat(F.translate(first, "./", ""), F.lit(".txt")).alias("filename"))
    return md(spark, sf).join(names, "doc_id")


@query("c1_clean_corpus", S.ctes(*CLEAN) + "SELECT d.doc_id, c.text, CAST(coalesce((SELECT count(*) FROM cl7 x WHERE x.doc_id=d.doc_id AND reason IS NOT NULL),0) AS BIGINT) AS removed_lines FROM documents d JOIN cl9 c USING (doc_id)")
def clean_corpus(spark, sf):
    return C.clean_corpus(named_markdown(spark, sf)).select("doc_id", "text", "removed_lines")


@query("c1_removed_by_reason", S.ctes(*CLEAN) + "SELECT doc_id, reason, count(*) AS n FROM cl7 WHERE reason IS NOT NULL GROUP BY ALL")
def removed_by_reason(spark, sf):
    c = C.clean_corpus(named_markdown(spark, sf))
    return c.filter("removed_by_reason is not null").select("doc_id", F.explode("removed_by_reason").alias("reason", "n"))


PAGE_LINES = (
    S.MARKDOWN,
    "pl0 AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM v_markdown))",
    "pl AS (SELECT doc_id, line_no//20 AS page, line_no, CASE WHEN line_no % 20 = 18 THEN '12 ' || l ELSE l END AS line FROM pl0)",
    f"pv AS (SELECT *, {S.visible('line')} AS v, regexp_replace(lower({S.visible('line')}), '[^a-z{AR}]+|[\\x{{06f0}}-\\x{{06f9}}\\x{{0660}}-\\x{{0669}}]+', '', 'g') AS sig FROM pl)",
    "tp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS r FROM pv WHERE v<>'')",
    "rp AS (SELECT doc_id, sig, count(*) AS seen FROM tp WHERE r<=3 AND length(sig) BETWEEN 5 AND 140 GROUP BY ALL)",
    "np AS (SELECT doc_id, count(DISTINCT page) AS n FROM pl GROUP BY doc_id)",
    "fu AS (SELECT doc_id, sig AS signature, seen FROM rp JOIN np USING (doc_id) WHERE seen >= greatest(2, ceil(n*0.30::DOUBLE)))",
)


def page_lines(spark, sf):
    d = md(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    line = F.when(F.col("line_no") % 20 == 18, F.concat(F.lit("12 "), "line")).otherwise(F.col("line"))
    return d.select("doc_id", F.floor(F.col("line_no") / 20).alias("page"), "line_no", line.alias("line"))


@query("w8_repeated_margins", S.ctes(*PAGE_LINES) + "SELECT doc_id, signature, seen FROM fu")
def repeated_margins(spark, sf):
    return C.repeated_margins(page_lines(spark, sf))


@query(
    "c2_strip_page_furniture",
    S.ctes(
        *PAGE_LINES,
        "i0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no)-1 AS i, count(*) OVER (PARTITION BY doc_id, page) AS n, "
        "sum((v<>'')::INT) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS vis, lead(v) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS nx FROM pv)",
        r"i1 AS (SELECT *, min(CASE WHEN n>=8 AND i>=greatest(1, floor(n*0.68::DOUBLE)) AND v='' AND regexp_matches(nx, '^[0-9]+\s+\S') AND length(nx)>45 THEN i+1 END) OVER (PARTITION BY doc_id, page) AS foot FROM i0)",
    )
    + "SELECT doc_id, page, CAST(line_no AS INT) AS line_no, line FROM i1 WHERE (foot IS NULL OR i<foot) AND NOT (v<>'' AND vis<=3 AND EXISTS (SELECT 1 FROM fu WHERE fu.doc_id=i1.doc_id AND fu.signature=i1.sig))",
)
def strip_page_furniture(spark, sf):
    return C.strip_page_furniture(page_lines(spark, sf))


# --------------------------------------------------------------------------------------------- structure

CHW = rf"(?i)^(chapter|part|فصل|بخش)\s+([0-9۰-۹]+|[a-zA-Z]+|{ORD})(?:\s*[:\.\-–—]\s*|\s+|$)(.*)$"
NUM = r"^([0-9۰-۹]+)[\.\)]\s+(\S.*)$"
BUL = r"^([-*•])\s+(.*)$"
PUN = r"[.!۔:,،؛]\s*$"
STRUCT = (
    S.LINES,
    "ln AS (SELECT doc_id, line_no, CASE line_no % 9 WHEN 4 THEN '1. ' || line WHEN 5 THEN '2) ' || line WHEN 7 THEN '- ' || line WHEN 2 THEN '3. ' || line ELSE line END AS line FROM v_lines)",
    r"s0 AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(trim(line), '^\s*\[[^\]]*\]\s*$') THEN '' ELSE trim(line) END AS t FROM ln)",
    f"s1 AS (SELECT *, CASE WHEN regexp_matches(t, {S.q(BUL)}) THEN 'bullet' WHEN regexp_matches(t, {S.q(NUM)}) THEN 'numbered' END AS mark, "
    rf"list_filter(string_split_regex(t, '\s+'), lambda w: regexp_matches(w, '[A-Za-z]')) AS ws, t<>'' AND length(t)<=90 AND NOT regexp_matches(t, {S.q(PUN)}) AS sh, trim(regexp_extract(t, {S.q(CHW)}, 3)) AS rest FROM s0)",
    rf"s2 AS (SELECT *, CASE WHEN sh AND ((regexp_matches(t, {S.q(CHW)}) AND NOT (regexp_matches(rest,'[A-Za-z]') AND regexp_matches(rest,'^\p{{Ll}}'))) OR regexp_matches(t, {S.q(NUM)})) THEN 'strong' "
    rf"WHEN sh AND len(regexp_extract_all(t, '(?:^|[^0-9A-Za-z_\x{{c0}}-\x{{24f}}])[0-9۰-۹][0-9۰-۹,\.–—-]*'))<3 AND len(ws)>0 AND ((upper(t)=t AND lower(t)<>t) OR len(list_filter(ws, lambda w: regexp_matches(w,'^\p{{Lu}}'))) >= greatest(1, len(ws)-1)) THEN 'weak' END AS h FROM s1)",
    "s3 AS (SELECT *, CASE WHEN t='' THEN 'blank' WHEN mark='bullet' THEN 'bullet' WHEN mark='numbered' AND (coalesce(lag(mark) OVER w='numbered',false) OR coalesce(lead(mark) OVER w='numbered',false)) THEN 'numbered' "
    "WHEN h IS NOT NULL THEN 'heading' WHEN mark IS NULL AND length(t)<=55 THEN 'short' ELSE 'para' END AS k0 FROM s2 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))",
    "s4 AS (SELECT *, CASE WHEN lag(k0) OVER (PARTITION BY doc_id ORDER BY line_no) IS NOT DISTINCT FROM k0 THEN 0 ELSE 1 END AS c FROM s3)",
    "s5 AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM s4)",
    "s6 AS (SELECT *, CASE WHEN k0='short' AND count(*) OVER (PARTITION BY doc_id, run)>=3 THEN 'implicit' WHEN k0='short' THEN 'para' ELSE k0 END AS kind FROM s5)",
    "s7 AS (SELECT *, CASE WHEN kind<>'heading' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END AS c2 FROM s6)",
    "s8 AS (SELECT *, sum(c2) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM s7)",
    f"s9 AS (SELECT *, CASE kind WHEN 'bullet' THEN '- ' || trim(regexp_extract(t, {S.q(BUL)}, 2)) WHEN 'numbered' THEN regexp_extract(t, {S.q(NUM)}, 1) || '. ' || trim(regexp_extract(t, {S.q(NUM)}, 2)) WHEN 'implicit' THEN '- ' || t ELSE t END AS sx FROM s8 WHERE kind<>'blank')",
    "sa AS (SELECT doc_id, b, kind, min(h) AS h, CASE WHEN kind='para' THEN string_agg(sx,' ' ORDER BY line_no) ELSE string_agg(sx,chr(10) ORDER BY line_no) END AS text FROM s9 GROUP BY doc_id, b, kind)",
    "sb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS block_no FROM sa)",
    rf"sc AS (SELECT *, block_no=1 AND kind IN ('para','heading') AND text<>'' AND length(text)<=80 AND NOT regexp_matches(text, {S.q(PUN)}) AND regexp_matches(text,'[\p{{L}}\p{{N}}_]') AS ttl FROM sb)",
)


@query(
    "c3_detect_structure",
    S.ctes(*STRUCT)
    + "SELECT doc_id, CAST(block_no AS INT) AS block_no, CASE WHEN ttl THEN 'heading' WHEN kind IN ('bullet','numbered','implicit') THEN 'list' ELSE kind END AS kind, "
    "CASE WHEN ttl THEN 1 WHEN kind='heading' AND h='strong' THEN 2 WHEN kind='heading' THEN 3 END AS level, CASE WHEN ttl THEN 'strong' WHEN kind='heading' THEN h END AS strength, text FROM sc",
)
def detect_structure(spark, sf):
    l = views.lines(spark, sf)
    m = F.col("line_no") % 9
    line = F.when(m == 4, F.concat(F.lit("1. "), "line")).when(m == 5, F.concat(F.lit("2) "), "line")).when(m == 7, F.concat(F.lit("- "), "line")).when(
        m == 2, F.concat(F.lit("3. "), "line")
    ).otherwise(F.col("line"))
    return C.detect_structure(l.select("doc_id", "line_no", line.alias("line")))


# --------------------------------------------------------------------------------------------- profile

BODY_RE = r"regexp_replace(regexp_replace({x}, '(?m)^<!--\s*page:(\d+)\s*-->$', '', 'g'), '(?m)^(#{{1,3}})\s+(.+)$', '\2', 'g')"


def quality_sql(src: str, pages: str, required: str, weak: str) -> list[str]:
    """CTEs q0..q2 over src(doc_id, text, ...): body, penalties, score, warnings."""
    return [
        f"q0 AS (SELECT *, trim({BODY_RE.format(x='text')}, {BLANKS}) AS body FROM {src})",
        f"q1 AS (SELECT *, length(body) AS n, {S.count_re('body', LET)} AS nl, {S.count_re('body', '[' + AR + ']')} AS nar, {S.count_re('body', '[A-Za-z]')} AS nla, "
        f"{pages} AS pgs, {required} AS req, {weak} AS weak FROM q0)",
        "q2 AS (SELECT *, nl/greatest(n,1)::DOUBLE AS lr, n/greatest(coalesce(pgs,1),1)::DOUBLE AS dens FROM q1)",
        "q3 AS (SELECT *, round(greatest(0.0, least(1.0, 1.0::DOUBLE - CASE WHEN req THEN 0.75 ELSE 0 END - CASE WHEN n<80 THEN 0.65 WHEN n<300 THEN 0.2 ELSE 0 END - CASE WHEN lr<0.35 THEN 0.25 ELSE 0 END "
        "- CASE WHEN pgs IS NOT NULL AND dens<30 THEN 0.2 ELSE 0 END - CASE WHEN weak THEN 0.08 ELSE 0 END)),3) AS score, "
        "array_to_string(list_filter([CASE WHEN req THEN 'ocr_required_but_not_applied' END, CASE WHEN n<80 THEN 'very_little_extracted_text' WHEN n<300 THEN 'little_extracted_text' END, "
        "CASE WHEN lr<0.35 THEN 'low_letter_ratio' END, CASE WHEN pgs IS NOT NULL AND dens<30 THEN 'low_text_density' END, CASE WHEN weak THEN 'weak_document_structure' END], lambda w: w IS NOT NULL), ',') AS warn FROM q2)",
        "q4 AS (SELECT *, NOT req AND n>=80 AND score>=0.45 AS idx FROM q3)",
    ]


@query(
    "c10_quality_gate",
    S.ctes(*quality_sql("documents", "CASE WHEN doc_id%5=0 THEN doc_id%60+1 END", "doc_id%23=0", "doc_id%6=0"))
    + "SELECT doc_id, CASE WHEN NOT idx THEN 'rejected' WHEN warn<>'' THEN 'warning' ELSE 'ready' END AS status, CAST(score AS DOUBLE) AS score, idx AS indexable, warn AS warnings, "
    "CAST(nl AS BIGINT) AS letters, round(lr,4) AS letter_ratio, CASE WHEN pgs IS NOT NULL THEN round(dens,1) END AS avg_chars_per_page FROM q4",
)
def quality_gate(spark, sf):
    i = F.col("doc_id")
    d = views.docs(spark, sf).withColumns(
        {
            "page_count": F.when(i % 5 == 0, (i % 60 + 1).cast("int")),
            "ocr_required": i % 23 == 0,
            "structure_confidence": F.when(i % 6 == 0, "low"),
        }
    )
    q = C.quality_gate(d)
    return q.select(
        "doc_id", "quality.status", "quality.score", "quality.indexable", F.array_join("quality.warnings", ",").alias("warnings"),
        "quality.metrics.letters", "quality.metrics.letter_ratio", "quality.metrics.avg_chars_per_page",
    )


CHAPTER_SQL = rf"(?i)^(?:فصل|chapter|part)\s+(?:[0-9۰-۹]+|[ivxlcdm]+|{ORD})\b"
PROFILE = (
    S.MARKDOWN,
    "src AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (SELECT d.text FROM documents d WHERE d.doc_id = v_markdown.doc_id) ELSE text END AS text FROM v_markdown)",
    *quality_sql("src", "CAST(NULL AS BIGINT)", "false", "false"),
    r"pf0 AS (SELECT *, list_transform(regexp_extract_all(text, '(?m)^(#{1,3})\s+(.+)$', 2), lambda h: trim(h)) AS hs, regexp_extract_all(text, '(?m)^(#{1,3})\s+(.+)$', 1) AS ms, "
    r"list_transform(regexp_extract_all(text, '(?m)^<!--\s*page:(\d+)\s*-->$', 1), lambda p: CAST(p AS INT)) AS pg, "
    r"len(list_filter(string_split_regex(body, '\n\s*\n+'), lambda p: trim(p, ' '||chr(10))<>'')) AS paras, "
    r"len(regexp_extract_all(body, '(?m)(?:^|\s)(?:\d{1,2}:)?\d{1,2}:\d{2}(?:\s|$)')) AS st, "
    r"len(regexp_extract_all(body, '(?m)^[^\n:]{1,40}:\s+\S')) + len(regexp_extract_all(body, '(?m)(?:^|\s)(?:(?:VICE\s+)?CHAIRMAN|PRESIDENT|GOVERNOR|MR|MS|DR)\.?\s+[A-Z][A-Z''’-]{1,30}\.\s+')) AS sp, "
    r"len(regexp_extract_all(body, '(?:^|\n)[^\n]{2,180}[؟?]\s*(?:\n|$)')) AS qu FROM q4)",
    f"pf1 AS (SELECT *, len(list_filter(hs, lambda h: regexp_matches(h, {S.q(CHAPTER_SQL)}))) AS nch, hs[list_position(ms,'#')] AS title, lower(array_to_string(hs[1:5],' ')) AS lead5, lower(array_to_string(hs,' ')) AS allh FROM pf0)",
    "pf2 AS (SELECT *, CASE WHEN NOT idx THEN 'noisy_scan|quality_review' WHEN nch>=2 THEN 'chaptered_book|chapter' WHEN st>=3 OR sp>=greatest(4, paras//5) THEN 'transcript|semantic_window' "
    "WHEN qu>=greatest(3, paras//5) THEN 'faq_or_notes|heading_or_semantic' WHEN len(pg)>=4 AND n/greatest(len(list_distinct(pg)),1)::DOUBLE<700 THEN 'slide_deck|page' "
    "WHEN len(hs)>=2 AND (regexp_matches(lead5,'abstract|چکیده|method|روش') OR regexp_matches(allh,'references|منابع|introduction|مقدمه')) THEN 'research_article|heading' "
    "WHEN len(hs)>=2 THEN 'sectioned_report|heading' WHEN len(pg)>0 THEN 'flat_document|page_window' ELSE 'flat_document|semantic_window' END AS v FROM pf1)",
)


def half_markdown(spark, sf):
    """Two documents in three as Markdown, the third as plain text, so several document types occur."""
    d = views.docs(spark, sf)
    return d.select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(views.markdown_column(F.col("text"))).alias("text"))


@query(
    "c9_profile_corpus",
    S.ctes(*PROFILE)
    + "SELECT doc_id, title, split_part(v,'|',1) AS document_type, split_part(v,'|',2) AS unit_strategy, CASE WHEN nar>nla*1.5 THEN 'fa' WHEN nla>nar*1.5 THEN 'en' WHEN nar>0 OR nla>0 THEN 'mixed' ELSE 'unknown' END AS language, "
    "sha256(text) AS content_hash, CAST(n AS BIGINT) AS char_count, CAST(list_max(pg) AS INT) AS page_count, CAST(len(hs) AS INT) AS heading_count, CAST(nch AS INT) AS chapter_count, CAST(paras AS INT) AS paragraph_count, "
    "array_to_string(list_filter(hs, lambda h: title IS NULL OR h<>title), '|') AS sections FROM pf2",
)
def profile_corpus(spark, sf):
    p = C.profile_corpus(half_markdown(spark, sf))
    return p.select(
        "doc_id", "title", "document_type", "unit_strategy", "language", "content_hash", "char_count", "page_count", "heading_count",
        "chapter_count", "paragraph_count", F.array_join("detected_sections", "|").alias("sections"),
    )


LATIN, PERSIAN = "abcdefghijklmnopqrstuvwxyz", "ابپتثجچحخدذرزژسشصضطظعغفقکگ"
FA_TEXT = f"translate(lower(replace(text, chr(10), ' ')), '{LATIN}', '{PERSIAN}')"


def _garbled_sql() -> str:
    stop = "[" + ", ".join(S.q(w) for w in C.FA_STOPWORDS) + "]"
    word = f"trim(regexp_replace({S.fold('t')}, '[{C.FA_MARKS}]', '', 'g'), {S.q(C.FA_EDGE)})"
    return S.ctes(
        S.PAGES,
        f"f AS (SELECT doc_id, page, CASE (doc_id + page) % 4 WHEN 0 THEN {FA_TEXT} WHEN 1 THEN replace({FA_TEXT}, ' ', ' است ') WHEN 2 THEN replace(replace({FA_TEXT}, ' ', ' است '), 'ث', 'ثًٌّ') ELSE replace(text, chr(10), ' ') END AS t FROM v_pages)",
        f"j AS (SELECT doc_id, page, {S.visible('t')} AS j FROM f)",
        f"c AS (SELECT *, length(regexp_replace(j, '[^{C.FA_LETTERS}]+', '', 'g')) AS fa, length(regexp_replace(j, '[^A-Za-z]+', '', 'g')) AS la, length(regexp_replace(j, '[^{C.FA_MARKS}]+', '', 'g')) AS marks, "
        f"list_filter(list_transform(regexp_split_to_array(j, '\\s+'), lambda t: {word}), lambda t: t <> '') AS toks FROM j)",
        f"n AS (SELECT *, len(toks) AS n, len(list_filter(toks, lambda t: list_contains({stop}, t))) AS hits FROM c)",
    ) + (
        "SELECT doc_id, CAST(page AS INT) AS page, fa >= 30 AND fa::DOUBLE / greatest(fa + la, 1) >= 0.35 AND (marks::DOUBLE / greatest(fa, 1) > 0.10 OR (n >= 10 AND hits::DOUBLE / greatest(n, 1) < 0.03)) AS garbled FROM n"
    )


@query("c11_garbled_pages", _garbled_sql())
def garbled_pages(spark, sf):
    """Pages in Latin letters, in Persian ones without any frequent word, with such words, and with marks besides."""
    one_line = F.replace("text", F.lit("\n"), F.lit(" "))
    fa = F.translate(F.lower(one_line), LATIN, PERSIAN)
    words = F.replace(fa, F.lit(" "), F.lit(" است "))
    m = (F.col("doc_id") + F.col("page")) % 4
    text = F.when(m == 0, fa).when(m == 1, words).when(m == 2, F.replace(words, F.lit("ث"), F.lit("ثًٌّ"))).otherwise(one_line)
    return C.garbled_pages(views.pages(spark, sf).withColumn("text", text)).select("doc_id", "page", "garbled")


@query(
    "c12_page_coverage",
    S.ctes(
        S.PAGES,
        "p AS (SELECT doc_id, text, length(text)<300 AS flagged, length(text)<300 AND doc_id%2=0 AS unres FROM v_pages)",
        "g AS (SELECT doc_id, count(*) AS page_count, CAST(sum(flagged::INT) AS BIGINT) AS pages_flagged, CAST(sum(unres::INT) AS BIGINT) AS pages_unresolved, sum(CASE WHEN unres THEN 0 ELSE length(trim(text, ' '||chr(10))) END) AS ch FROM p GROUP BY doc_id)",
    )
    + "SELECT doc_id, page_count, pages_flagged, pages_unresolved, round(pages_unresolved/page_count::DOUBLE,6) AS skipped_ratio, pages_unresolved/page_count::DOUBLE>0.05 AS blocking, "
    "CASE WHEN pages_flagged>0 AND pages_unresolved/page_count::DOUBLE>0.05 THEN 'ocr_required' WHEN pages_unresolved>0 THEN 'partial_ocr_unavailable' WHEN ch/page_count::DOUBLE<5 THEN 'ocr_required' "
    "WHEN ch/page_count::DOUBLE<50 THEN 'low_text_density_possible_scanned_pdf' END AS warning FROM g",
)
def page_coverage(spark, sf):
    short = F.length("text") < 300
    p = views.pages(spark, sf).withColumns({"flagged": short, "unresolved": short & (F.col("doc_id") % 2 == 0)})
    return C.page_coverage(p).withColumn("skipped_ratio", F.round("skipped_ratio", 6))


# --------------------------------------------------------------------------------------------- units

UNIT_ROLE = (
    "CASE WHEN regexp_matches(nt,'^(?:abstract|چکیده)$') THEN 'abstract' WHEN regexp_matches(nt,'^(?:introduction|مقدمه)$') THEN 'introduction' "
    "WHEN regexp_matches(nt,'^(?:references|bibliography|منابع|کتابنامه)$') THEN 'references' WHEN regexp_matches(nt,'conclusions?|جمع ?بندی|نتیجه ?گیری') THEN 'conclusion' "
    "WHEN regexp_matches(nt,'methods?|methodology|materials? and methods?|روش ?کار|روش ?شناسی') THEN 'methodology' WHEN regexp_matches(nt,'^(?:results?|findings?|یافته ?ها|نتایج)$') THEN 'findings' "
    "WHEN regexp_matches(nt,'^(?:discussion|بحث)$') THEN 'discussion' WHEN regexp_matches(nt,'practical implications?|پیامدهای عملی|کاربردهای عملی') THEN 'practical_implications' "
    "WHEN regexp_matches(nt,'acknowledg(?:e)?ments?|author contributions?|funding|financial support|ethics?|conflicts? of interests?|article info|publisher|journal') THEN 'administrative' "
    "WHEN ut IN ('page_window','semantic_window') THEN 'body' ELSE 'section' END"
)
TITLES = [
    "Abstract", "INTRODUCTION", "References", "Summary and conclusions", "Materials and Methods", "Results", "Discussion", "Practical implications",
    "Author contributions", "Conflict of interests", "Publisher", "Chapter one", "مقدمه", "نتیجه گیری", "منابع",
]


@query(
    "c14_section_roles",
    S.ctes(
        f"u AS (SELECT doc_id, [{', '.join(S.q(t) for t in TITLES)}][doc_id % {len(TITLES)} + 1] AS title, CASE WHEN doc_id%2=0 THEN 'section' ELSE 'page_window' END AS ut FROM documents)",
        "n AS (SELECT *, lower(title) AS nt FROM u)",
    )
    + f"SELECT doc_id, {UNIT_ROLE} AS role FROM n",
)
def section_roles(spark, sf):
    i = F.col("doc_id")
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (i % len(TITLES) + 1).cast("int"))
    return views.docs(spark, sf).select("doc_id", C.section_role(title, F.when(i % 2 == 0, "section").otherwise("page_window")).alias("role"))


CH_ID = rf"(?i)^(فصل|chapter|part)\s+([0-9۰-۹]+|[ivxlcdm]+|{ORD})\b"
UNITS = (
    *BLOCKS,
    r"ub0 AS (SELECT *, ['heading','chapter','page','semantic_window'][doc_id%4+1] AS strat, regexp_matches(text,'^(#{1,3})\s+(.+)$') AS h, length(regexp_extract(text,'^(#{1,3})\s+(.+)$',1)) AS lv, trim(regexp_extract(text,'^(#{1,3})\s+(.+)$',2)) AS ti FROM v_blocks)",
    rf"ub1 AS (SELECT *, CASE WHEN strat='chapter' THEN CASE WHEN h AND regexp_matches(ti,{S.q(CH_ID)}) THEN lower(regexp_extract(ti,{S.q(CH_ID)},1) || ' ' || regexp_extract(ti,{S.q(CH_ID)},2)) END "
    r"WHEN h AND lv<=2 THEN lower(regexp_replace(ti,'\s+',' ','g')) END AS k FROM ub0)",
    "ub2 AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk FROM ub1)",
    "ub3 AS (SELECT *, k IS NOT NULL AND k IS DISTINCT FROM pk AS st FROM ub2)",
    "ub4 AS (SELECT *, sum(st::INT) OVER (PARTITION BY doc_id ORDER BY block_no) AS seg, dense_rank() OVER (PARTITION BY doc_id ORDER BY page NULLS LAST) AS pr FROM ub3)",
    "us AS (SELECT doc_id, block_no, length(text) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS seq FROM ub4 WHERE strat='semantic_window' AND NOT is_marker)",
    pack_sql("uk", "us", "doc_id", 6500),
    "ub5 AS (SELECT b.*, CASE WHEN strat IN ('heading','chapter') THEN seg WHEN strat='page' THEN CASE WHEN page IS NOT NULL THEN (pr-1)//3 END ELSE uk.batch END AS u FROM ub4 b LEFT JOIN us ON us.doc_id=b.doc_id AND us.block_no=b.block_no LEFT JOIN uk ON uk.doc_id=us.doc_id AND uk.seq=us.seq)",
    "ub6 AS (SELECT *, bool_or(NOT is_marker AND NOT h) OVER (PARTITION BY doc_id, u) AS hb, bool_or(NOT is_marker) OVER (PARTITION BY doc_id, u) AS ht FROM ub5 WHERE u IS NOT NULL)",
    "ub7 AS (SELECT * FROM ub6 WHERE strat NOT IN ('heading','chapter') OR hb)",
    "ug AS (SELECT doc_id, u, strat, arg_min(ti, block_no) FILTER (WHERE st) AS op, string_agg(text, chr(10)||chr(10) ORDER BY CASE WHEN strat='page' THEN coalesce(page,0) ELSE 0 END, block_no) FILTER (WHERE NOT is_marker OR NOT ht) AS t, "
    "min(char_start) FILTER (WHERE NOT is_marker OR NOT ht) AS char_start, max(char_end) FILTER (WHERE NOT is_marker OR NOT ht) AS char_end, min(nullif(page,0)) FILTER (WHERE NOT is_marker OR NOT ht) AS page_start, "
    "max(nullif(page,0)) FILTER (WHERE NOT is_marker OR NOT ht) AS page_end, min(page) AS p0, max(page) AS p1 FROM ub7 GROUP BY doc_id, u, strat)",
    "uh AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY u) AS unit_order, sha256(t) AS text_hash FROM ug)",
    f"ui AS (SELECT *, CASE WHEN strat IN ('heading','chapter') THEN coalesce(nullif(op,''),{S.q(C.OPENING_TITLE)}) WHEN strat='page' THEN CASE WHEN p0=p1 THEN {S.q(C.PAGE_ONE)} || p0 ELSE {S.q(C.PAGE_MANY)} || p0 || {S.q(C.PAGE_TO)} || p1 END ELSE {S.q(C.WINDOW_TITLE)} || unit_order END AS title, "
    "CASE strat WHEN 'chapter' THEN 'chapter' WHEN 'heading' THEN 'section' WHEN 'page' THEN 'page_window' ELSE 'semantic_window' END AS ut FROM uh)",
    "uj AS (SELECT *, lower(title) AS nt FROM ui)",
    f"v_units AS (SELECT doc_id, CAST(unit_order AS INT) AS unit_order, format('u{{:04d}}-', unit_order) || substring(text_hash,1,10) AS unit_id, ut AS unit_type, {UNIT_ROLE} AS role, title, char_start, char_end, page_start, page_end, text_hash FROM uj)",
)


@query("c13_build_units", S.ctes(*UNITS) + "SELECT * FROM v_units")
def build_units(spark, sf):
    strategies = F.array(*[F.lit(s) for s in ("heading", "chapter", "page", "semantic_window")])
    p = views.docs(spark, sf).select("doc_id", F.element_at(strategies, (F.col("doc_id") % 4 + 1).cast("int")).alias("unit_strategy"))
    return C.build_units(blocks(spark, sf), p)


ASSIGN = (
    S.CHUNKS,
    S.LINES,
    "lo AS (SELECT doc_id, line_no, line, coalesce(sum(length(line)+1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS o FROM v_lines)",
    "un AS (SELECT doc_id, line_no//7+1 AS unit_order, min(o) AS char_start, max(o+length(line))-CASE WHEN (line_no//7)%3=1 THEN 400 ELSE 0 END AS char_end FROM lo GROUP BY doc_id, line_no//7)",
    "mi AS (SELECT doc_id, chunk_index, (char_start+char_end)//2 AS m FROM v_chunks)",
    "h1 AS (SELECT mi.doc_id, chunk_index, min(unit_order) AS a FROM mi JOIN un ON un.doc_id=mi.doc_id AND m BETWEEN un.char_start AND un.char_end GROUP BY ALL)",
    "h2 AS (SELECT mi.doc_id, chunk_index, min(unit_order) AS b FROM mi JOIN un ON un.doc_id=mi.doc_id AND chunk_index BETWEEN unit_order*2 AND unit_order*2+2 GROUP BY ALL)",
)


@query(
    "j3_assign_chunks_to_units",
    S.ctes(*ASSIGN)
    + "SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, 'u' || coalesce(a,b) AS parent_id, CASE WHEN coalesce(a,b) IS NOT NULL THEN CAST(coalesce(a,b)*2 AS INT) END AS parent_page_start FROM mi LEFT JOIN h1 USING (doc_id, chunk_index) LEFT JOIN h2 USING (doc_id, chunk_index)",
)
def assign_chunks_to_units(spark, sf):
    """Units of seven lines, some ending early so that the page fallback is needed."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    l = views.lines(spark, sf).withColumn("o", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
    u = l.groupBy("doc_id", F.floor(F.col("line_no") / 7).alias("k")).agg(
        F.min("o").alias("char_start"), F.max(F.col("o") + F.length("line")).alias("e")
    )
    order = (F.col("k") + 1).cast("int")
    u = u.select(
        "doc_id", order.alias("unit_order"), F.concat(F.lit("u"), order.cast("string")).alias("unit_id"), F.lit("t").alias("title"), F.lit("section").alias("unit_type"),
        F.lit("section").alias("role"), "char_start", (F.col("e") - F.when(F.col("k") % 3 == 1, 400).otherwise(0)).alias("char_end"),
        (order * 2).alias("page_start"), (order * 2 + 2).alias("page_end"),
    )
    c = views.chunks(spark, sf).withColumn("page", F.col("chunk_index"))
    return C.assign_chunks_to_units(c, u).select("doc_id", "chunk_index", "parent_id", "parent_page_start")


# --------------------------------------------------------------------------------------------- summaries

PARENTS = (
    S.CHUNKS,
    "pc AS (SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, source, text, (chunk_index-1)//3 AS g, chunk_index AS page FROM v_chunks)",
    "pt AS (SELECT *, CASE WHEN g%7=6 THEN NULL ELSE 'p' || g END AS parent_id, ['Abstract','Methods','Part ','Findings','References','Discussion','Part '][g%7+1] || CASE WHEN g%7 IN (2,6) THEN CAST(g AS VARCHAR) ELSE '' END AS parent_title, "
    "['abstract','methodology','section','findings','references','discussion','section'][g%7+1] AS parent_role, CASE WHEN g%2=0 THEN g*3+1 END AS parent_page_start, CASE WHEN g%2=0 THEN g*3+3 END AS parent_page_end FROM pc)",
)


def parented(spark, sf):
    c = views.chunks(spark, sf).select("doc_id", "chunk_index", "source", "text")
    g = F.floor((F.col("chunk_index") - 1) / 3).cast("int")
    m = (g % 7 + 1).cast("int")
    names = F.array(*[F.lit(x) for x in ("Abstract", "Methods", "Part ", "Findings", "References", "Discussion", "Part ")])
    roles = F.array(*[F.lit(x) for x in ("abstract", "methodology", "section", "findings", "references", "discussion", "section")])
    return c.select(
        "*",
        F.col("chunk_index").alias("page"),
        F.when(g % 7 != 6, F.concat(F.lit("p"), g.cast("string"))).alias("parent_id"),
        F.concat(F.element_at(names, m), F.when((g % 7).isin(2, 6), g.cast("string")).otherwise("")).alias("parent_title"),
        F.element_at(roles, m).alias("parent_role"),
        F.when(g % 2 == 0, g * 3 + 1).alias("parent_page_start"),
        F.when(g % 2 == 0, g * 3 + 3).alias("parent_page_end"),
        F.lit(None).cast("string").alias("subsection"),
        F.lit(None).cast("string").alias("section"),
        F.lit(None).cast("string").alias("chapter"),
    )


GROUPS = (
    *PARENTS,
    "sg0 AS (SELECT *, (SELECT count(DISTINCT b.parent_role) FROM pt b WHERE b.doc_id=pt.doc_id AND b.parent_role IN ('methodology','findings','discussion','conclusion'))>=3 AS applied, coalesce(parent_id, parent_title) AS own FROM pt WHERE parent_role<>'references')",
    "sg1 AS (SELECT *, last_value(CASE WHEN applied AND parent_role<>'section' THEN own END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS act FROM sg0)",
    "sg2 AS (SELECT *, CASE WHEN applied AND parent_role='section' THEN coalesce(act, own) ELSE own END AS group_key FROM sg1)",
    "sg3 AS (SELECT doc_id, group_key, arg_min(source || ' :: ' || CASE WHEN parent_role='abstract' THEN 'Abstract / چکیده' ELSE parent_title END, chunk_index) AS coverage_key, arg_min(parent_title, chunk_index) AS title, "
    "arg_min(parent_role, chunk_index) AS role, list_sort(list_distinct(flatten(list(range(coalesce(parent_page_start,page), coalesce(parent_page_end, parent_page_start, page)+1))))) AS pages, count(*) AS chunk_count, min(chunk_index) AS first_chunk, "
    "string_agg(text, chr(10)||chr(10) ORDER BY chunk_index) AS text FROM sg2 GROUP BY doc_id, group_key)",
)


@query("c15_substantive_groups", S.ctes(*GROUPS) + "SELECT doc_id, group_key, coverage_key, title, role, array_to_string(pages, ',') AS pages, chunk_count, first_chunk FROM sg3")
def substantive_groups(spark, sf):
    g = C.substantive_groups(parented(spark, sf))
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")
    return g.select("doc_id", "group_key", "coverage_key", "title", "role", pages.alias("pages"), "chunk_count", "first_chunk")


@query("c18_multi_document_evidence", S.ctes(*GROUPS) + "SELECT doc_id, group_key, coverage_key, title AS parent_title, CAST(pages[1] AS INT) AS page, CAST(pages[len(pages)] AS INT) AS page_end, text FROM sg3")
def multi_document_evidence(spark, sf):
    return C.multi_document_evidence(parented(spark, sf)).select("doc_id", "group_key", "coverage_key", "parent_title", "page", "page_end", "text")


@query("c18_multi_document_support", S.ctes(*GROUPS) + "SELECT s.doc_id, s.chunk_index, s.group_key, g.coverage_key, s.text FROM sg2 s JOIN sg3 g ON g.doc_id=s.doc_id AND g.group_key=s.group_key")
def multi_document_support(spark, sf):
    return C.multi_document_support(parented(spark, sf)).select("doc_id", "chunk_index", "group_key", "coverage_key", "text")


@query(
    "a17_corpus_totals",
    S.ctes(*PARENTS)
    + "SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS chunks, count(DISTINCT (doc_id, page)) AS pages, count(DISTINCT (doc_id, parent_id)) FILTER (WHERE parent_id IS NOT NULL) AS units, "
    "CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(greatest(1, CAST(round_even(length(text)/4.0::DOUBLE, 0) AS BIGINT))) AS BIGINT) AS tokens FROM pt GROUP BY source",
)
def corpus_totals(spark, sf):
    return B.corpus_stats(parented(spark, sf), ["source"], page="page", unit="parent_id")


EVIDENCE = (
    *PARENTS,
    f"e0 AS (SELECT *, coalesce(parent_id, {S.q(C.UNTITLED)}) AS k FROM pt)",
    "e1 AS (SELECT *, CASE WHEN lag(k) OVER (PARTITION BY doc_id ORDER BY chunk_index) IS NOT DISTINCT FROM k THEN 0 ELSE 1 END AS c FROM e0)",
    "e2 AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS grp FROM e1)",
    "e3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY chunk_index)-1 AS pos, count(*) OVER (PARTITION BY doc_id, grp) AS n FROM e2)",
    f"e4 AS (SELECT doc_id, CAST(grp AS BIGINT) AS group_no, chunk_index, source || ' - ' || {S.q(C.PAGE_ONE)} || page AS label, substring(text,1,1200) AS text FROM e3 WHERE n<=3 OR pos IN (0,n//2,n-1) OR (n>=8 AND pos IN (n//4,3*n//4)))",
    "e5 AS (SELECT *, sha256(string_agg(label || chr(10) || text, chr(10) ORDER BY chunk_index) OVER (PARTITION BY doc_id, group_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS h0, row_number() OVER (PARTITION BY doc_id ORDER BY group_no, chunk_index) AS mk FROM e4)",
    "e6 AS (SELECT doc_id, group_no, sha256(string_agg(label || chr(10) || text, chr(10) ORDER BY chunk_index)) AS content_hash FROM e4 GROUP BY ALL)",
)


@query(
    "c16_summary_evidence",
    S.ctes(*(p.replace("sha256(string_agg(label || chr(10) || text, chr(10) ORDER BY chunk_index) OVER (PARTITION BY doc_id, group_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS h0, ", "") for p in EVIDENCE))
    + "SELECT doc_id, group_no, chunk_index, label, text, content_hash, 'S' || mk AS marker FROM e5 JOIN e6 USING (doc_id, group_no)",
)
def summary_evidence(spark, sf):
    return C.summary_evidence(parented(spark, sf)).select("doc_id", "group_no", "chunk_index", "label", "text", "content_hash", "marker")


@query(
    "c16_summary_evidence_overall",
    S.ctes(
        S.CHUNKS,
        "o0 AS (SELECT doc_id, chunk_index, source || ' - ' || 'صفحه ' || chunk_index AS label, substring(text,1,1200) AS text, chunk_index-1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM v_chunks)",
    )
    + "SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, label, text FROM o0 WHERE n<=3 OR pos IN (0,n//2,n-1) OR (n>=8 AND pos IN (n//4,3*n//4))",
)
def summary_evidence_overall(spark, sf):
    return C.summary_evidence_overall(parented(spark, sf)).select("doc_id", "chunk_index", "label", "text")


@query(
    "w6_chapter_units",
    S.ctes(*EVIDENCE[:7])
    + "SELECT doc_id, CAST(grp AS BIGINT) AS group_no, min(k) AS group_key, arg_min(parent_title, -length(parent_title)*1000000+chunk_index) AS title, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages, count(*) AS chunk_count FROM e3 GROUP BY doc_id, grp",
)
def chapter_units(spark, sf):
    p = parented(spark, sf)
    g = C.consecutive_groups(p, C.chunk_group_key(), F.col("parent_title"))
    pages = F.array_join(F.transform("pages", lambda x: x.cast("string")), ",")
    return g.select("doc_id", "group_no", "group_key", "title", pages.alias("pages"), "chunk_count")


@query(
    "c17_stale_summaries",
    "SELECT doc_id AS asset_id, source AS unit_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 = 0",
)
def stale_summaries(spark, sf):
    d = views.docs(spark, sf)
    i = F.col("doc_id")
    u = d.select(i.alias("asset_id"), F.col("source").alias("unit_id"), F.sha2("text", 256).alias("content_hash"), F.lit("p").alias("provider"), F.lit("m").alias("model"))
    cache = d.filter(i % 4 != 0).select(
        i.alias("asset_id"), F.col("source").alias("unit_id"), F.sha2("text", 256).alias("content_hash"), F.lit("p").alias("provider"),
        F.when(i % 5 == 0, "old").otherwise("m").alias("model"),
    )
    return C.stale_summaries(u, cache).select("asset_id", "unit_id")


@query(
    "c23_rebuild_index",
    S.ctes(
        *CHUNKED, *[p for p in quality_sql("v_markdown", "CAST(NULL AS BIGINT)", "false", "false")],
        "nw AS (SELECT s.doc_id, count(*) AS n, CAST(sum(length(s.text)) AS BIGINT) AS chars FROM v_struct s JOIN q4 USING (doc_id) WHERE idx AND s.doc_id%3=0 GROUP BY s.doc_id)",
    )
    + "SELECT doc_id, n, chars FROM nw UNION ALL SELECT doc_id, 1, CAST(length(source) AS BIGINT) FROM documents WHERE doc_id%3<>0",
)
def rebuild_index(spark, sf):
    d = md(spark, sf)
    i = F.col("doc_id")
    indexed = d.select("doc_id", F.when(i % 3 == 0, "old").otherwise(F.sha2("text", 256)).alias("content_hash"), F.lit(C.PROCESSING_VERSION).alias("processing_version"))
    index = d.select("doc_id", F.lit(1).alias("chunk_index"), F.col("source").alias("text"))
    new = C.rebuild_index(d, indexed, index)
    return new.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


