"""Relational bookkeeping: upserts, lookups, enrichment, validity joins, usage and coverage reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions.numeric import one_if
from corpuslens.operators.ordering import history_before, last_before, latest_per_key, union_stages

Cols = Sequence[str]

# File extension to category; only text is processed.
CATEGORY_BY_EXTENSION = {
    ".txt": "text", ".pdf": "text", ".docx": "text",
    ".jpg": "image", ".jpeg": "image", ".png": "image", ".gif": "image", ".webp": "image", ".bmp": "image",
    ".mp3": "audio", ".wav": "audio", ".m4a": "audio", ".ogg": "audio",
    ".mp4": "video", ".mov": "video", ".webm": "video", ".mkv": "video", ".avi": "video",
}
PROCESSABLE = "text"
# Phrases that mark a refusal to answer an exam question.
BAD_ANSWER = r"(?iU)(نمی\s*دونم|نمیدونم|نمی\s*دانم|چرت|الکی|خاستگاری|خواستگاری|برو\s*بریم)"


def category_of(filename: Column) -> Column:
    """Category by extension, null for unknown ones."""
    ext = F.lower(F.regexp_extract(filename, r"(\.[^./]*)$", 1))
    lookup = F.create_map(*[F.lit(x) for pair in CATEGORY_BY_EXTENSION.items() for x in pair])
    return lookup[ext]


# ---------------------------------------------------------------------------------------------------
# index maintenance


def upsert_latest(base: DataFrame, updates: DataFrame, keys: Cols, order: Cols) -> DataFrame:
    """Insert or replace: per key the newest row wins, an update over the base on equal order.

    One map-side combined aggregate; repeating the same updates changes nothing.
    """
    both = union_stages(base.withColumn("_new", F.lit(0)), updates.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, [*order, "_new"]).drop("_new")


def chunk_key(doc_id: Column, chunk_index: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("_chunk"), chunk_index.cast("string"))


def delete_keys(base: DataFrame, doomed: DataFrame, keys: Cols) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, removed rows)."""
    gone = doomed.select(*keys).distinct()
    return base.join(gone, list(keys), "left_anti"), base.join(gone, list(keys), "left_semi")


def count_indexed(chunks: DataFrame, **scopes: Column) -> DataFrame:
    """One row: indexed chunks in all, and those of each named scope, from one pass."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(condition).alias(name) for name, condition in scopes.items()])


def list_chunks(
    chunks: DataFrame,
    owner: str | None = None,
    doc_ids: Sequence[int] | None = None,
    doc_id: int | None = None,
    source: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Optional filters combined; a non-empty id list wins over a single id. Ordered by document and chunk."""
    out = chunks
    if owner is not None:
        out = out.filter(F.col("owner") == owner)
    if doc_ids:
        out = out.filter(F.col("doc_id").isin(list(doc_ids)))
    elif doc_id is not None:
        out = out.filter(F.col("doc_id") == doc_id)
    if source is not None:
        out = out.filter(F.col("source") == source)
    out = out.orderBy("doc_id", "chunk_index")
    return out.limit(limit) if limit is not None else out


def manifest_of(content: DataFrame, path: str, body: str) -> DataFrame:
    return content.select(F.col(path).alias("path"), F.sha2(F.col(body), 256).alias("sha256"))


def manifest_verify(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of the old manifest that changed or are missing now."""
    now = new.select("path", F.col("sha256").alias("_now"))
    j = old.join(now, "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("_now")))
    return j.select("path", F.when(F.col("_now").isNull(), "missing").otherwise("changed").alias("problem"))


# ---------------------------------------------------------------------------------------------------
# filters


def load_usage(
    usage: DataFrame, since: datetime | None = None, user_id: int | None = None, prefix: str | None = None
) -> DataFrame:
    """Filters stay plain comparisons so they reach the scan."""
    out = usage
    if user_id is not None:
        out = out.filter(F.col("user_id") == user_id)
    if since is not None:
        out = out.filter(F.col("created_at") >= F.lit(since))
    if prefix is not None:
        out = out.filter(F.col("request_id").cast("string").startswith(prefix))
    return out


def ready_documents(assets: DataFrame, default_name: str = "untitled") -> DataFrame:
    ready = assets.filter((F.col("category") == PROCESSABLE) & (F.col("status") == "scanned"))
    return ready.withColumn("filename", F.coalesce("filename", F.lit(default_name)))


def validate_selection(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """Per request: ok / missing / invalid, and the names in request order when ok.

    ``requests`` carries (request_id, asset_ids array<string>).
    """
    ids = F.array_distinct(F.filter(F.transform("asset_ids", lambda a: T.strip(a)), lambda a: a != ""))
    flat = requests.select("request_id", F.posexplode_outer(ids).alias("pos", "asset_id"))
    a = assets.select("asset_id", "category", "status", "filename", F.lit(True).alias("_found"))
    j = flat.join(a, "asset_id", "left")
    wanted = F.col("asset_id").isNotNull()
    bad = (F.col("category") != PROCESSABLE) | (F.col("status") != "scanned")
    g = j.groupBy("request_id").agg(
        F.max(one_if(wanted & F.col("_found").isNull())).alias("_missing"),
        F.max(one_if(wanted & F.coalesce(bad, F.lit(False)))).alias("_invalid"),
        F.array_sort(F.collect_list(F.when(wanted, F.struct("pos", "filename")))).alias("_n"),
    )
    outcome = F.when(F.col("_missing") == 1, "missing").when(F.col("_invalid") == 1, "invalid").otherwise("ok")
    names = F.when(outcome == "ok", F.transform("_n", lambda x: x["filename"]))
    return g.select("request_id", outcome.alias("outcome"), names.alias("names"))


def answer_norm(c: Column) -> Column:
    folded = F.replace(F.translate(T.text_or_empty(c), "يكۀة", "یکهه"), F.lit("‌"), F.lit(" "))
    return F.lower(T.strip(folded))


def is_non_answer(answer: Column, prompt: Column) -> Column:
    a, p = answer_norm(answer), answer_norm(prompt)
    copied = (p != "") & (F.contains(p, a) | F.contains(a, p))
    return (F.length(a) < 18) | a.rlike(BAD_ANSWER) | copied


def non_answer_filter(answers: DataFrame) -> DataFrame:
    return answers.filter(is_non_answer(F.col("answer"), F.col("prompt")))


def patch_non_null(base: DataFrame, patch: DataFrame, key: str, backfill: bool = False) -> DataFrame:
    """Overwrite with the patch's non-null fields, or only fill nulls when ``backfill``."""
    fields = [c for c in patch.columns if c != key]
    j = base.join(patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in fields]), key, "left")
    pick = lambda c: F.coalesce(c, f"_p_{c}") if backfill else F.coalesce(f"_p_{c}", c)
    return j.select(*[pick(c).alias(c) if c in fields else F.col(c) for c in base.columns])


# ---------------------------------------------------------------------------------------------------
# joins


def enrich(fact: DataFrame, dims: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Inner equi-joins fact to dimension; the planner broadcasts whichever side its statistics allow."""
    out = fact
    for dim, key in dims:
        out = out.join(dim, key)
    return out


def active_as_of(probes: DataFrame, intervals: DataFrame, key: str, at: str) -> DataFrame:
    """The active interval in force per probe, the latest to expire.

    That interval is the key's latest-expiring active one whenever it is still open, so intervals are
    reduced to one row per key before the join; no probe meets all intervals of a busy key.
    """
    cols = [c for c in intervals.columns if c not in (key, "status")]
    best = (
        intervals.filter(F.col("status") == "active")
        .groupBy(key)
        .agg(F.max_by(F.struct(*cols), F.struct("expires_at", "interval_id")).alias("_b"))
    )
    return probes.join(best, key).filter(F.col("_b.expires_at") > F.col(at)).select(*probes.columns, "_b.*")


def reconcile(groups: DataFrame, owners: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Points per ownership class, first matching set wins, everything else is E; all five always reported."""
    tagged = union_stages(*[f.select("asset_id", F.lit(name).alias("class")) for name, f in owners])
    first = tagged.groupBy("asset_id").agg(F.min("class").alias("class"))
    j = groups.join(first, "asset_id", "left").withColumn(
        "class", F.when(F.coalesce("asset_id", F.lit("")) == "", "E").otherwise(F.coalesce("class", F.lit("E")))
    )
    empty = groups.sparkSession.createDataFrame([(c, 0) for c in "ABCDE"], "class string, point_count long")
    return union_stages(j.select("class", F.col("point_count").cast("long")), empty).groupBy("class").agg(
        F.sum(F.coalesce("point_count", F.lit(0))).alias("points")
    )


def exclude_seen(candidates: DataFrame, exclusions: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Leak guard: drop candidates whose value is in any exclusion set."""
    out = candidates
    for frame, key in exclusions:
        out = out.join(frame.select(key).distinct(), key, "left_anti")
    return out


def price_usage(usage: DataFrame, prices: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Cost per event: the larger of reported and calculated; price list entries match the model by substring,
    the first that fits wins. Only successful chat completions count."""
    rate = F.lit(0.0)
    for pattern, p_in, p_out in reversed(prices):
        calc = F.coalesce("input_tokens", F.lit(0)) * F.lit(p_in) / 1_000_000 + F.coalesce(
            "output_tokens", F.lit(0)
        ) * F.lit(p_out) / 1_000_000
        rate = F.when(F.contains(F.col("model"), F.lit(pattern)), calc).otherwise(rate)
    billed = usage.filter((F.col("operation_type") == "chat_completion") & (F.col("status") == "success"))
    reported = F.coalesce(F.col("cost_usd"), F.lit(0)).cast("double")
    return billed.withColumn("billed_usd", F.greatest(reported, rate))


# ---------------------------------------------------------------------------------------------------
# reports


def usage_rollup(usage: DataFrame, keys: Cols, mode: str = "group") -> DataFrame:
    """Requests, tokens, cost and latency totals; ``mode='rollup'`` adds subtotals."""
    g = usage.rollup(*keys) if mode == "rollup" else usage.groupBy(*keys)
    return g.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )


def coverage_counts(cases: DataFrame, category: str, document: str, merged: dict[str, Cols]) -> DataFrame:
    """Cases and distinct documents per category, with merged categories and a total."""
    base = cases.select(F.col(category).alias("category"), F.col(document).alias("document"))
    label = F.col("category")
    for name, members in merged.items():
        label = F.when(F.col("category").isin(list(members)), name).otherwise(label)
    both = base.withColumn("category", F.explode(F.array(label, F.lit("(total)"))))
    # Distinct documents are reduced per (category, document) first, so a busy category stays spread out.
    per_doc = both.groupBy("category", "document").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("category").agg(
        F.sum("n").alias("cases"), F.count("document").alias("documents"), F.max("n").alias("most_in_one_document")
    )


def admin_stats(users: DataFrame, subscriptions: DataFrame, now: datetime) -> DataFrame:
    live = subscriptions.filter((F.col("status") == "active") & (F.col("expires_at") > F.lit(now)))
    flagged = users.select("user_id").join(
        live.select("user_id").distinct().withColumn("_on", F.lit(1)), "user_id", "left"
    )
    return flagged.agg(F.count(F.lit(1)).alias("total_users"), F.count("_on").alias("subscribed_users"))


def corpus_stats(chunks: DataFrame, groups: Cols = (), page: str | None = None, unit: str | None = None) -> DataFrame:
    """Documents, chunks, characters and token estimate, with the columns named also pages and units.

    Pre-aggregated per document: pages and units are counted there, since their numbers repeat from one to the next.
    """
    counted = {name: F.count_distinct(column) for name, column in (("pages", page), ("units", unit)) if column}
    per_doc = chunks.groupBy(*groups, "doc_id").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.length("text")).alias("ch"), F.sum(T.token_estimate(F.length("text"))).alias("t"),
        *[count.alias(name) for name, count in counted.items()],
    )
    return per_doc.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("c").alias("chunks"),
        *[F.sum(name).alias(name) for name in counted],
        F.sum("ch").alias("characters"),
        F.sum("t").alias("tokens"),
    )


def grade_objective(questions: DataFrame, answers: DataFrame, by: str) -> DataFrame:
    """Multiple-choice scores per exam: correct only for a non-negative integer key equal to the selection."""
    j = questions.join(answers, [by, "question_id"], "left")
    mc = F.col("type") == "multiple_choice"
    stated = F.col("points").cast("double")
    points = F.greatest(F.lit(0.0), F.coalesce(stated, F.when(mc, 1.0).otherwise(5.0)))
    key = F.col("answer_index")
    chosen = F.col("answer").try_cast("int")
    right = mc & F.coalesce((key >= 0) & (chosen == key), F.lit(False))
    j = j.withColumns({"_max": points, "_got": F.when(right, points).otherwise(0.0), "_mc": mc, "_right": right})
    return j.groupBy(by).agg(
        F.sum(F.when(F.col("_mc"), F.col("_got")).otherwise(0.0)).alias("objective_score"),
        F.sum(F.when(F.col("_mc"), F.col("_max")).otherwise(0.0)).alias("objective_max"),
        F.sum(F.when(~F.col("_mc"), F.col("_max")).otherwise(0.0)).alias("descriptive_max"),
        F.sum(one_if(F.col("_right"))).alias("correct"),
    )


# ---------------------------------------------------------------------------------------------------
# conversations


def with_history(turns: DataFrame, n: int = 8) -> DataFrame:
    """Every turn with up to n earlier (role, text) pairs, oldest first."""
    bucket = F.floor(F.col("turn") / 1024)
    return history_before(turns, ["conv_id"], ["turn"], bucket, F.struct("role", "text"), n, "history")


def history_digest(turns: DataFrame, n: int = 4) -> DataFrame:
    """Digest of the last n messages per conversation: user and assistant lines only, 500 characters each."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = turns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    body = T.visible(F.col("text"))
    line = F.when(
        F.col("role").isin("user", "assistant") & (body != ""),
        F.struct("turn", F.concat("role", F.lit(": "), F.substring(body, 1, 500)).alias("t")),
    )
    g = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["t"]), "\n")
    return g.select("conv_id", F.when(F.size("_l") == 0, "(none)").otherwise(text).alias("digest"))


def previous_turn(turns: DataFrame) -> DataFrame:
    """Each turn with the latest earlier non-blank assistant and user messages and an answered-before flag."""
    filled = T.strip(T.text_or_empty(F.col("text"))) != ""
    says = lambda who: F.when((F.col("role") == who) & filled, F.col("text"))
    values = {"previous_answer": says("assistant"), "previous_question": says("user")}
    seen = last_before(turns, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1024), values)
    return seen.withColumn("answered_before", F.col("previous_answer").isNotNull())


# ---------------------------------------------------------------------------------------------------
# section lookup


def section_lookup(requests: DataFrame, chunks: DataFrame, cap: int = 14, pipe_rows: bool = True) -> DataFrame:
    """Chunks asked for by page, role, table/figure or heading terms, thinned evenly to the cap.

    ``requests`` carries (query_id, doc_id, target_section, target_page). Chunks meet requests on doc_id. A line between
    pipes makes a chunk a table, unless ``pipe_rows`` is false: then only the words for a table do.
    """
    from corpuslens.operators.ordering import cap_evenly

    heading = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("parent_title", "subsection", "section", "chapter") if c in chunks.columns])
    c = chunks.withColumns({"_terms": T.term_set(F.col("text")), "_head": T.term_set(heading)})
    target = T.strip(T.text_or_empty(F.col("target_section")))
    r = requests.withColumns({"_t": target, "_want": T.term_set(target)})
    j = r.join(c, "doc_id")
    role = F.coalesce(F.col("parent_role"), F.lit(""))
    t = F.col("_t")
    words = lambda *ws: F.arrays_overlap("_terms", F.array(*[F.lit(w) for w in ws]))
    overlap = F.size(F.array_intersect("_want", "_head"))
    named = t.isin("abstract", "introduction", "references", "conclusion")
    hit = (
        F.when(F.col("target_page").isNotNull(), F.coalesce("page", F.lit(0)) == F.col("target_page"))
        .when(named, role == t)
        .when(t == "table", words("table", "جدول") | (F.lit(pipe_rows) & F.col("text").rlike(r"(?m)^\s*\|.+\|\s*$")))
        .when(t == "figure", words("figure", "شکل"))
        .when(t != "", overlap > 0)
        .otherwise(False)
    )
    by_heading = F.col("target_page").isNull() & ~named & ~t.isin("table", "figure") & (t != "")
    j = j.withColumns({"_hit": hit, "_order": F.when(by_heading, -overlap).otherwise(0)})
    w = Window.partitionBy("query_id", "doc_id")
    tail = F.row_number().over(w.orderBy(F.when(role != "references", 0).otherwise(1), F.col("chunk_index").desc()))
    j = j.withColumns({"_any": F.max(one_if(F.col("_hit"))).over(w), "_tail": tail})
    fallback = (F.col("_any") == 0) & F.col("target_page").isNull() & (t == "conclusion") & (role != "references") & (F.col("_tail") <= 4)
    kept = j.filter(F.col("_hit") | fallback)
    kept = cap_evenly(kept, ["query_id", "doc_id"], ["_order", "chunk_index"], cap)
    return kept.select("query_id", "doc_id", "chunk_index", (-F.col("_order")).alias("heading_overlap"))
