"""Gold-set validation, seeded sampling, asset and label checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.numeric import one_if
from corpuslens.operators.ordering import topk, union_stages
from corpuslens.session import fresh_path
from corpuslens.sources.readers import write_table

Cols = Sequence[str]

# Vocabularies of the gold set.
ROUTES = (
    "focused_rag", "specific_section", "analytical", "comprehensive_summary", "conversational_followup",
    "retry_previous", "free_chat",
)
POLICIES = ("required", "allowed", "forbidden")
LABELS = (
    "title", "heading_1", "heading_2", "heading_3", "paragraph", "list_intro", "bullet", "numbered_list", "quote",
    "table_like", "noise_front_matter", "page_marker",
)
STRATUM_BY_TYPE = {
    "local_factual": "factual",
    "table_or_numerical": "numeric",
    "comprehensive_summary": "summary_analytical",
    "analytical": "summary_analytical",
    "cross_language": "cross_language",
    "no_answer_or_conflict": "no_answer_conflict",
    "quoted_document_explanation": "quoted_explanation",
    "page_specific": "page_specific",
}
STRATUM_QUOTAS = {
    "factual": 3, "numeric": 2, "summary_analytical": 2, "cross_language": 1, "no_answer_conflict": 1,
    "quoted_explanation": 1, "page_specific": 1,
}


def _violations(df: DataFrame, entity: Column, rules: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """One scan of the frame for all row-level rules: (rule, broken, detail)."""
    checks = F.array(
        *[
            F.when(
                F.coalesce(bad, F.lit(False)),
                F.struct(F.lit(rule).alias("rule"), entity.cast("string").alias("entity"), detail.cast("string").alias("detail")),
            )
            for rule, bad, detail in rules
        ]
    )
    return df.select(F.inline(F.array_compact(checks)))


def _duplicates(df: DataFrame, key: str, rule: str) -> DataFrame:
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return g.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("entity"), F.col("n").cast("string").alias("detail"))


def _count_rule(df: DataFrame, rule: str, low: int, high: int, value: Column | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if value is None else F.coalesce(F.sum(value), F.lit(0))
    g = df.agg(n.alias("n")).filter((F.col("n") < low) | (F.col("n") > high))
    return g.select(F.lit(rule).alias("rule"), F.lit("").alias("entity"), F.col("n").cast("string").alias("detail"))


def validate_goldset(
    manifest: DataFrame,
    tasks: DataFrame,
    conversations: DataFrame,
    qrels: DataFrame,
    bounds: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """All broken constraints as (rule, entity, detail) rows; an empty frame means a valid gold set.

    ``conversations`` has one row per conversation with a ``turns`` array; ``qrels`` has one row per judged page
    in order (query_id, pos, page, document_sha256).
    """
    bounds = bounds or {"tasks": (60, 75), "conversations": (8, 12), "turns": (20, 1 << 30), "documents": (20, 20)}
    none = F.lit("")
    doc = manifest.groupBy("filename").agg(F.first("sha256").alias("_sha"), F.first("page_count").alias("_pages"), F.lit(True).alias("_known"))
    t = tasks.join(doc, "filename", "left")
    known = F.col("_known").isNotNull()
    pages = F.coalesce("relevant_pages", F.array().cast("array<int>"))
    n_pages = F.size(pages)
    invalid = F.filter(pages, lambda p: (p < 1) | (p > F.col("_pages")))
    evidence = F.transform(F.coalesce("evidence_pages", F.array().cast("array<int>")), lambda p: p)
    task_rules = [
        ("task_unknown_filename", ~known, F.col("filename")),
        ("task_hash_mismatch", known & ~F.col("document_sha256").eqNullSafe(F.col("_sha")), none),
        ("task_pages_not_list", known & F.col("relevant_pages").isNull(), none),
        ("task_invalid_page", known & (F.size(invalid) > 0), F.array_join(F.transform(invalid, lambda p: p.cast("string")), ",")),
        ("task_invalid_route", known & ~F.coalesce(F.col("expected_route").isin(*ROUTES), F.lit(False)), F.col("expected_route")),
        ("task_invalid_policy", known & ~F.coalesce(F.col("retrieval_policy").isin(*POLICIES), F.lit(False)), F.col("retrieval_policy")),
        ("answerable_without_page", known & (F.col("answerability") == "answerable") & (n_pages == 0), none),
        ("unanswerable_without_guard", known & (F.col("answerability") == "unanswerable") & (F.coalesce(F.size("forbidden_claims"), F.lit(0)) <= 0), none),
        ("conflicting_needs_two_pages", known & (F.col("answerability") == "conflicting") & (n_pages < 2), none),
        ("ambiguous_needs_two_pages", known & (F.col("answerability") == "ambiguous") & (n_pages < 2), none),
        ("evidence_not_aligned", known & ~evidence.eqNullSafe(pages), none),
        ("summary_fields_missing", known & (F.col("task_type") == "comprehensive_summary") & ~F.coalesce("summary_fields_present", F.lit(False)), none),
        ("table_fields_missing", known & (F.coalesce("table_identifier", F.lit("")) != "") & ~F.coalesce("table_fields_present", F.lit(False)), none),
    ]
    c = conversations.join(doc, "filename", "left")
    ids = F.transform("turns", lambda x: x["turn_id"])
    wanted = F.transform(ids, lambda _, i: F.concat(F.lit("t"), (i + 1).cast("string")))
    conv_rules = [
        ("conversation_document_mismatch", F.col("_known").isNull() | ~F.col("document_sha256").eqNullSafe(F.col("_sha")), none),
        ("conversation_turn_order", ~ids.eqNullSafe(wanted), F.array_join(ids, ",")),
    ]
    turn = conversations.select("conversation_id", ids.alias("_ids"), F.posexplode("turns").alias("_i", "x"))
    earlier = F.slice("_ids", F.lit(1), F.col("_i"))
    ante = F.col("x")["antecedent"]
    turn_rules = [
        ("antecedent_not_earlier", ante.isNotNull() & ~F.array_contains(earlier, ante), ante),
        ("history_without_antecedent", F.coalesce(F.col("x")["must_use_history"], F.lit(False)) & (F.coalesce(ante, none) == ""), none),
        ("turn_invalid_route", ~F.coalesce(F.col("x")["expected_route"].isin(*ROUTES), F.lit(False)), F.col("x")["expected_route"]),
        ("turn_invalid_policy", ~F.coalesce(F.col("x")["retrieval_policy"].isin(*POLICIES), F.lit(False)), F.col("x")["retrieval_policy"]),
    ]
    judged = qrels.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "page"))), lambda x: x["page"]).alias("_judged"),
        F.collect_set("document_sha256").alias("_hashes"),
    )
    both = tasks.select("query_id", "relevant_pages", "document_sha256", F.lit(1).alias("_t")).join(
        judged.withColumn("_q", F.lit(1)), "query_id", "full_outer"
    )
    qrel_rules = [
        ("qrels_query_set_differs", F.col("_t").isNull() | F.col("_q").isNull(), none),
        (
            "qrels_pages_differ",
            F.col("_t").isNotNull() & ~F.coalesce("_judged", F.array().cast("array<int>")).eqNullSafe(F.coalesce("relevant_pages", F.array().cast("array<int>"))),
            none,
        ),
        ("qrels_hash_mismatch", F.col("_t").isNotNull() & F.exists("_hashes", lambda h: ~h.eqNullSafe(F.col("document_sha256"))), none),
    ]
    bad_hash = ~F.coalesce(F.col("sha256").rlike(r"^[0-9a-f]{64}$"), F.lit(False))
    out = [
        _duplicates(manifest, "filename", "manifest_duplicate_filename"),
        _violations(manifest, F.col("filename"), [("manifest_invalid_hash", bad_hash, F.col("sha256"))]),
        _duplicates(tasks, "query_id", "task_duplicate_id"),
        _violations(t, F.col("query_id"), task_rules),
        _duplicates(conversations, "conversation_id", "conversation_duplicate_id"),
        _violations(c, F.col("conversation_id"), conv_rules),
        _violations(turn, F.concat_ws(":", "conversation_id", F.col("x")["turn_id"]), turn_rules),
        _violations(both, F.col("query_id"), qrel_rules),
        _count_rule(tasks, "task_count_out_of_bounds", *bounds["tasks"]),
        _count_rule(conversations, "conversation_count_out_of_bounds", *bounds["conversations"]),
        _count_rule(conversations, "turn_count_out_of_bounds", *bounds["turns"], F.size("turns")),
        _count_rule(manifest, "document_count_out_of_bounds", *bounds["documents"]),
    ]
    return union_stages(*out)


# ---------------------------------------------------------------------------------------------------
# sampling


def stable_hash(seed: int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def stratum_of(task_type: Column) -> Column:
    """Stratum of a task type; an unknown type is an error."""
    out = F
    for kind, stratum in STRATUM_BY_TYPE.items():
        out = out.when(task_type == kind, stratum)
    return out.otherwise(F.raise_error(F.concat(F.lit("unmapped task type: "), F.coalesce(task_type, F.lit("null")))).cast("string"))


def _quota(stratum: Column, quotas: dict[str, int]) -> Column:
    out = F
    for name, n in quotas.items():
        out = out.when(stratum == name, n)
    return out.otherwise(0)


def stratified_sample(candidates: DataFrame, quotas: dict[str, int], seed: int, stratum: str = "stratum", key: str = "query_id") -> DataFrame:
    """First rows per stratum in seeded hash order. The constant bound prunes each task to the largest quota
    before anything is shuffled, so a stratum holding most rows costs no more than a small one."""
    hashed = candidates.withColumn("_h", stable_hash(seed, F.col(key)))
    top = topk(hashed, [stratum], [F.col("_h"), F.col(key)], max(quotas.values()), "pick")
    return top.filter(F.col("pick") <= _quota(F.col(stratum), quotas)).drop("_h")


def diverse_sample(
    candidates: DataFrame, quotas: dict[str, int], seed: int, cap: int = 2, stratum: str = "stratum", key: str = "query_id",
    document: str = "filename", fixture_prefix: str = "fixture-",
) -> DataFrame:
    """Seeded greedy choice preferring unseen documents, then real ones, with a cap on fixtures.

    Spark reduces the candidates to the rows a greedy pass could ever take: per stratum and document the first
    quota rows, and of those documents the first ``sum(quotas) + quota``. Each unit of quota is then one minimum over
    that small table; only the chosen row comes to the driver, which keeps what has been taken.
    """
    spark, total = candidates.sparkSession, sum(quotas.values())
    fixture = F.col(document).startswith(fixture_prefix)
    h = candidates.withColumns({"_h": stable_hash(seed, F.col(key)), "_fx": fixture}).filter(F.col(stratum).isin(*quotas))
    per_doc = topk(h, [stratum, document], [F.col("_h")], max(quotas.values()), "_d")
    heads = topk(per_doc.filter("_d = 1"), [stratum, "_fx"], [F.col("_h")], total + max(quotas.values()), "_r")
    pool = per_doc.join(heads.select(stratum, document), [stratum, document], "left_semi")
    pool = write_table(pool.select(stratum, key, document, "_h", "_fx"), fresh_path(spark, "candidates"))
    chosen: list[tuple] = []
    seen: set = set()
    fixtures = 0
    for name, quota in quotas.items():
        for _ in range(quota):
            options = pool.filter((F.col(stratum) == name) & ~F.col(key).isin([c[2] for c in chosen]))
            options = options if fixtures < cap else options.filter(~F.col("_fx"))
            place = F.struct(F.col(document).isin(sorted(seen)).alias("seen"), "_fx", "_h", F.col(key).alias("key"), F.col(document).alias("document"))
            best = options.agg(F.min(place)).first()[0]
            if best is None:
                raise ValueError(f"cannot satisfy stratum {name}")
            seen.add(best["document"])
            fixtures += int(best["_fx"])
            chosen.append((len(chosen) + 1, name, best["key"]))
    types = candidates.schema
    schema = f"pick int, `{stratum}` string, `{key}` {types[key].dataType.simpleString()}"
    picks = spark.createDataFrame(chosen, schema)
    return candidates.join(F.broadcast(picks), [stratum, key])  # one row per unit of quota


def sample_report(selection: DataFrame, dims: Cols, document: str = "filename", fixture_prefix: str = "fixture-") -> DataFrame:
    """(dimension, value, count) distributions plus the totals the hard checks look at."""
    parts = [
        selection.groupBy(F.col(d).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count")).withColumn("dimension", F.lit(d))
        for d in dims
    ]
    totals = selection.agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_distinct(document).alias("documents"),
        F.coalesce(F.sum(one_if(F.col(document).startswith(fixture_prefix))), F.lit(0)).alias("fixtures"),
    )
    long = totals.unpivot([], ["selected", "documents", "fixtures"], "value", "count").withColumn("dimension", F.lit("total"))
    return union_stages(*parts, long).select("dimension", "value", "count")


def check_sample(selection: DataFrame, size: int = 12, documents: int = 8, fixtures: int = 2, document: str = "filename") -> DataFrame:
    """The three hard checks as one row; a failed check raises when the row is read."""
    g = selection.agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_distinct(document).alias("documents"),
        F.coalesce(F.sum(one_if(F.col(document).startswith("fixture-"))), F.lit(0)).alias("fixtures"),
    )
    ok = (F.col("selected") == size) & (F.col("documents") >= documents) & (F.col("fixtures") <= fixtures)
    return g.withColumn("valid", F.when(ok, True).otherwise(F.raise_error(F.lit("sample breaks a hard check")).cast("boolean")))


# ---------------------------------------------------------------------------------------------------
# assets and labels


def verify_assets(assets: DataFrame, sources: DataFrame, version_prefix: str) -> DataFrame:
    """Owner, name, size and hash of an asset against its source; scanned ones also need the current version."""
    s = sources.select(
        "asset_id", F.col("user_id").alias("_u"), F.col("filename").alias("_f"), F.col("size_bytes").alias("_s"), F.col("sha256").alias("_h")
    )
    j = s.join(assets, "asset_id", "left")
    same = (
        F.col("user_id").eqNullSafe(F.col("_u"))
        & F.col("filename").eqNullSafe(F.col("_f"))
        & F.coalesce("size_bytes", F.lit(0)).eqNullSafe(F.col("_s"))
        & F.col("sha256").eqNullSafe(F.col("_h"))
    )
    fresh = F.when(F.col("status") == "scanned", F.coalesce("processing_version", F.lit("")).startswith(version_prefix)).otherwise(
        F.col("status").isin("uploaded", "scanning")
    )
    return j.select("asset_id", F.coalesce(same & fresh, F.lit(False)).alias("verified"))


def label_batch_check(labels: DataFrame, expected: DataFrame, allowed: Cols = LABELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first error per batch, final labels, status per document).

    ``labels``: (doc_id, batch, pos, index, label) as answered, in answer order. ``expected``: (doc_id, batch, index,
    orig_label). A failed batch falls back to the original labels.
    """
    want = expected.select("doc_id", "batch", "index", F.lit(True).alias("_want"))
    a = labels.join(want, ["doc_id", "batch", "index"], "left")
    nth = F.row_number().over(Window.partitionBy("doc_id", "batch", "index").orderBy("pos"))
    a = a.withColumn("_nth", nth)
    error = (
        F.when(F.col("_want").isNull(), "out_of_range")
        .when(F.col("_nth") > 1, "duplicate_index")
        .when(~F.coalesce(F.col("label").isin(*allowed), F.lit(False)), "label_not_allowed")
    )
    a = a.withColumn("_e", error)
    first = a.groupBy("doc_id", "batch").agg(
        F.min(F.when(F.col("_e").isNotNull(), F.struct("pos", "_e"))).alias("_f"),
        F.count_distinct(F.when(F.col("_want"), F.col("index"))).alias("_got"),
    )
    size = expected.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("_need"))
    b = size.join(first, ["doc_id", "batch"], "left").withColumn(
        "error",
        F.when(F.col("_f").isNotNull(), F.col("_f._e")).when(F.coalesce("_got", F.lit(0)) < F.col("_need"), "missing_indices"),
    )
    batches = b.select("doc_id", "batch", "error")
    answered = a.filter(F.col("_nth") == 1).select("doc_id", "batch", "index", "label")
    final = (
        expected.join(batches, ["doc_id", "batch"])
        .join(answered, ["doc_id", "batch", "index"], "left")
        .select("doc_id", "batch", "index", F.when(F.col("error").isNull(), F.col("label")).otherwise(F.col("orig_label")).alias("label"))
    )
    failed = F.sum(one_if(F.col("error").isNotNull()))
    status = batches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("batches"), failed.alias("fallbacks"))
    status = status.withColumn(
        "status", F.when(F.col("fallbacks") == 0, "passed").when(F.col("fallbacks") == F.col("batches"), "failed").otherwise("partial")
    )
    return batches, final, status
