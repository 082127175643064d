"""Lines that documents share, found by range-partitioned hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import scan, stored, unused_name

#: Code points below which a key is never looked up.
MIN_CHARS = 10
#: Lines on which hot hashes are looked for, at most. They decide how rows are dealt, never which lines stay.
SAMPLE_LINES = 4_000_000
#: A hash is hot from this many sampled lines and this share of a task's.
HOT_LINES, HOT_SHARE = 1000, 0.25
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"


def _text(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_keys(text: Column) -> Column:
    """Each line without white space at its ends and with A-Z in lower case; other letters keep their case."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.transform(lines_of(lowered), lambda line: F.btrim(line, F.lit(_SPACE)))


def _hashes(keys: Column, min_chars: int) -> Column:
    """Place and 128-bit hash of the keys that are long enough."""
    placed = F.transform(keys, lambda key, i: F.when(F.char_length(key) >= min_chars, F.struct(i.alias("pos"), F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))))
    return F.filter(placed, lambda x: x.isNotNull())


def _hot(each: DataFrame, n_lines: int, tasks: int) -> DataFrame:
    """(h1, h2) that a large share of a task's lines would have: at most tasks / HOT_SHARE rows of a bounded sample."""
    share = min(1.0, SAMPLE_LINES / max(n_lines, 1))
    some = each.select("h1", "h2") if share == 1.0 else each.select("h1", "h2").sample(share, seed=13)
    least = max(HOT_LINES, int(HOT_SHARE * share * n_lines / tasks))
    return some.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h1", "h2")


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep: which lines of each document stay, without its text.

    A key is a line without white space at its ends and with A-Z in lower case. All lines of a key of at least
    `min_chars` code points go, except in the smallest doc_id that holds it, where all stay. keep is a run-length coded
    bitmap: ascending line numbers at which runs end, kept and dropped ones in turn, beginning with a kept one (it may be
    empty); the last is n_lines or the end of a dropped run. `kept_text` applies it.

    Hashes (128 bits) are range-partitioned and sorted by hash, document and place, and the first document of each
    passes on down the run. A hash that fills a large part of a task takes no part in that: the smallest document of
    each such one is a map-side combined minimum, sent to where the lines lie; there are at most tasks / HOT_SHARE.

    Null and empty texts are one empty line. Rows of equal doc_id are the same document; rows that are equal in text
    too give one row. Null ids are one document after all others. An empty table gives no rows; further columns are
    not read.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _text(text).alias("t"))
    keys = whole.select("doc_id", F.xxhash64("t").alias("text_hash"), line_keys(F.col("t")).alias("keys"))
    lines = stored(keys.select("doc_id", "text_hash", F.size("keys").cast("long").alias("n_lines"), _hashes(F.col("keys"), min_chars).alias("hashes")), "line-hashes")
    each = lines.select("doc_id", "text_hash", F.explode("hashes").alias("h")).select("doc_id", "text_hash", "h.*")
    n_lines = lines.agg(F.sum(F.size("hashes"))).first()[0] or 0
    hot = F.broadcast(_hot(each, n_lines, tasks))
    owners = each.join(hot, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
    owners = F.broadcast(stored(owners, "hot-lines"))
    ordered = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = each.join(owners, ["h1", "h2"], "left_anti").repartitionByRange(tasks, "h1", "h2")
    streamed = ranged.withColumn("first_doc", F.first("doc_id").over(ordered))
    dropped = streamed.select("doc_id", "text_hash", "pos", "first_doc").unionByName(each.join(owners, ["h1", "h2"]).select("doc_id", "text_hash", "pos", "first_doc"))
    dropped = dropped.where(~F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("doc_id", "text_hash", F.lit(None).cast("long").alias("n_lines"), "pos")
    known = lines.select("doc_id", "text_hash", "n_lines", F.lit(None).cast("int").alias("pos"))
    gone = known.unionByName(dropped).groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("gone"))
    n_dropped = F.size("gone").cast("long")
    return gone.select("doc_id", "text_hash", "n_lines", n_dropped.alias("n_dropped"), _runs(F.col("gone"), F.col("n_lines").cast("int")).alias("keep"))


def _runs(gone: Column, n_lines: Column) -> Column:
    """Ends of the alternating runs, from the ascending numbers of the dropped lines."""
    begins = F.filter(gone, lambda p, i: ~F.coalesce(F.get(gone, i - 1) == p - 1, F.lit(False)))
    ends = F.transform(F.filter(gone, lambda p, i: ~F.coalesce(F.get(gone, i + 1) == p + 1, F.lit(False))), lambda p: p + 1)
    turns = F.flatten(F.zip_with(begins, ends, lambda b, e: F.array(b, e)))
    return F.when(F.coalesce(F.get(gone, F.size(gone) - 1) == n_lines - 1, F.lit(False)), turns).otherwise(F.array_append(turns, n_lines))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that the bitmap keeps, joined; a text that loses none comes back as it is."""
    lines = lines_of(text)
    begin = lambda at: F.coalesce(F.get(keep, at - 1), F.lit(0))
    kept = F.transform(F.sequence(F.lit(0), F.size(keep) - 1, F.lit(2)), lambda at: F.slice(lines, begin(at) + 1, F.get(keep, at) - begin(at)))
    return F.when(F.size(keep) == 1, text).otherwise(F.array_join(F.flatten(kept), "\n"))


def without_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents' rows with n_lines, n_dropped and kept_text; columns of those names are replaced.

    Every row comes back, repeated ones as often as they are there; further columns pass through.
    """
    bitmaps = keep_bitmaps(docs, doc_id, text, min_chars)
    names: dict[str, str] = {}
    for c in bitmaps.columns:
        names[c] = unused_name(f"_{c}", [*docs.columns, *names.values()])
    bits = bitmaps.toDF(*names.values())
    met = F.col(f"`{doc_id}`").eqNullSafe(F.col(names["doc_id"])) & (F.xxhash64(_text(text)) == F.col(names["text_hash"]))
    added = {"n_lines": F.col(names["n_lines"]), "n_dropped": F.col(names["n_dropped"]), "kept_text": kept_text(_text(text), F.col(names["keep"]))}
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    return docs.join(bits, met, "left").select(*own, *[value.alias(name) for name, value in added.items()])


def op13_line_dedup(spark, sf_dir):
    docs = without_shared_lines(scan(spark, sf_dir, "documents", "doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: The same in SQL.
OP13_SQL = """
with d as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), l as (
  select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), shared as (
  select key, min(doc_id) as first_doc from k where length(key) >= 10 group by key having min(doc_id) is distinct from max(doc_id)
), judged as (
  select k.*, shared.key is not null and k.doc_id is distinct from first_doc as gone from k left join shared using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by r, doc_id
"""
