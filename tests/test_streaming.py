import datetime as dt

from pyspark.sql import functions as F

from corpuslens.session import fresh_path
from corpuslens.sources import store as S
from corpuslens.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def feed(spark, tmp_path, batches):
    """One file per batch, so the stream sees them in order."""
    schema = "event_id long, user string, created_at timestamp, cost_usd double, feature string, provider string, model string, input_tokens long, latency_ms double"
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(i, u, T0 + dt.timedelta(minutes=m), 1.0, "f", "p", "m", 1, 1.0) for i, u, m in rows], schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"events{n}"))
    return spark.read.parquet(*[str(tmp_path / f"events{n}") for n in range(len(batches))]).schema


def stream(spark, tmp_path, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_late_rows_are_dropped_past_the_watermark(spark, tmp_path):
    schema = feed(spark, tmp_path, [[(1, "a", 10)], [(2, "a", 300)], [(5, "a", 310)], [(3, "a", 11)], [(4, "a", 600)]])
    path = fresh_path(spark, "late")
    w = J.usage_windows(stream(spark, tmp_path, schema), lateness="30 minutes")
    J.drain_append(w, path)
    got = {r["window_start"]: r["n_events"] for r in J.results(spark, path).collect()}
    assert got[T0] == 1


def test_throttle_state_survives_batches(spark, tmp_path):
    schema = feed(spark, tmp_path, [[(1, "a", 0), (2, "a", 1)], [(3, "a", 2), (4, "b", 2)], [(5, "a", 3), (6, "a", 100)]])
    path = fresh_path(spark, "gate")
    J.drain_append(J.throttle_stream(stream(spark, tmp_path, schema), "user", "created_at", "event_id", 30, 3, 600), path)
    got = {r["event_id"]: r["decision"] for r in J.results(spark, path).collect()}
    assert got == {1: "accepted", 2: "accepted", 3: "accepted", 4: "accepted", 5: "too_many", 6: "accepted"}


def test_replayed_ids_count_once(spark, tmp_path):
    schema = feed(spark, tmp_path, [[(1, "a", 0), (2, "a", 1)], [(1, "a", 0), (3, "a", 2)]])
    path = fresh_path(spark, "once")
    J.drain_append(J.dedupe_events(stream(spark, tmp_path, schema), ["event_id"], "created_at"), path)
    assert sorted(r["event_id"] for r in J.results(spark, path).collect()) == [1, 2, 3]


def status_of(e):
    return e.select(
        F.col("user").alias("asset_id"), F.col("created_at").alias("at"), "event_id",
        F.when(F.col("event_id") == 2, "uploaded").otherwise("scanned").alias("status"), F.lit(0.5).alias("quality_score"),
    )


def test_status_state_ends_and_the_result_is_that_of_the_batch(spark, tmp_path):
    day = 24 * 60
    batches = [[(1, "a", 0)], [(2, "a", 5), (3, "b", 1)], [(4, "c", 3 * day)], [(5, "c", 3 * day + 1)], [(6, "b", 20)], [(7, "d", 20 * day)]]
    schema = feed(spark, tmp_path, batches)
    path = fresh_path(spark, "state")
    left = J.drain(J.latest_status_stream(status_of(stream(spark, tmp_path, schema))), path, "update")
    got = {r["asset_id"]: (r["status"], r["quality_score"]) for r in J.newest_of(J.results(spark, path), "asset_id", ["at", "event_id"]).collect()}
    on_time = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path)).filter("event_id <> 6")  # 6 came after its day was closed
    assert got == {r["asset_id"]: (r["status"], r["quality_score"]) for r in J.latest_status(status_of(on_time)).collect()}
    assert got["a"] == ("uploaded", None) and got["b"] == ("scanned", 0.5)
    assert left == 1  # d's open day; the state of a, b and c is gone


def test_response_state_ends_and_requests_over_periods_are_whole(spark, tmp_path):
    rows = [(1, 0, "conversation", "q", 0), (1, 1, "trace", "plan", 30), (1, 2, "final", "early", 59), (1, 3, "final", "late", 61), (1, 4, "trace", "again", 62), (2, 0, "conversation", "x", 5)]
    later = [(3, 0, "final", "z", 6000)]
    schema = "request_id long, seq int, type string, payload string, minute int"
    for n, part in enumerate((rows[:3], rows[3:], later)):
        frame = spark.createDataFrame(part, schema).withColumn("at", F.lit(T0).cast("timestamp") + F.make_dt_interval(mins="minute")).drop("minute")
        frame.coalesce(1).write.parquet(str(tmp_path / f"responses{n}"))
    folder = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path))
    path = fresh_path(spark, "responses")
    left = J.drain(J.assemble_responses_stream(stream(spark, tmp_path, folder.schema)), path, "update")
    fields = ["request_id", "answer", "plan", "conversation", "n_events", "error"]
    read = lambda df: sorted(tuple(r) for r in df.select(*fields).collect())
    got = read(J.responses_of(J.results(spark, path)))
    assert got == read(J.assemble_responses(folder)) and got[0] == (1, "late", "plan", "q", 5, None) and got[1][5] == "missing_final"
    assert left == 1


def test_throttle_stream_equals_batch_for_a_busy_key_in_any_order(spark, tmp_path):
    """More rows of one key than an Arrow batch holds, unordered, over several files of one micro-batch."""
    n = 25_000
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), F.lit("a").alias("user"),
        (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=(F.col("id") * 7919 % n) * F.lit(7))).alias("created_at"),
    )
    folder = str(tmp_path / "busy.parquet")
    rows.repartition(5).write.parquet(folder)
    stored = spark.read.parquet(folder)
    batch = {r["event_id"]: r["decision"] for r in J.throttle(stored, "user", "created_at", "event_id", 10, 20, 600).collect()}
    path = fresh_path(spark, "busy")
    J.drain_append(J.throttle_stream(J.table_stream(spark, str(tmp_path), "busy"), "user", "created_at", "event_id", 10, 20, 600), path)
    got = {r["event_id"]: r["decision"] for r in J.results(spark, path).collect()}
    assert len(got) == n and got == batch


def test_streams_read_a_table_that_is_a_folder(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "things.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "things_other.parquet"))
    path = fresh_path(spark, "folder")
    J.drain_append(J.table_stream(spark, str(tmp_path), "things"), path)
    assert J.results(spark, path).count() == 100


CHUNKS = "doc_id long, chunk_index int, text string"


def test_an_update_rewrites_touched_buckets_only(spark):
    path = fresh_path(spark, "store")

    def files():
        return set(S.read_store(spark, path, CHUNKS).inputFiles())

    def rows(version=None):
        return sorted(tuple(r) for r in S.read_store(spark, path, CHUNKS, version).collect())

    def put(version, ids, chunks):
        S.upsert(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame([(i,) for i in ids], "doc_id long"), path, ["doc_id"], version, buckets=16)

    assert rows() == []
    first = [(i, c, f"{i}.{c}") for i in range(40) for c in range(3)]
    put(0, range(40), first)
    assert rows() == first
    before = files()
    put(1, [7], [(7, 0, "new")])  # delivered again, and shorter
    want = sorted([r for r in first if r[0] != 7] + [(7, 0, "new")])
    assert rows() == want and rows(0) == first
    assert len(before & files()) == len(before) - 1 and len(files()) == len(before)
    put(1, [7], [(7, 0, "repeated")])  # a finished version is not written again
    assert rows() == want
    put(3, [7, 8, 99], [(99, 0, "added")])  # two are gone
    assert rows() == sorted([r for r in want if r[0] not in (7, 8)] + [(99, 0, "added")])
    put(4, range(100), [])
    assert rows() == [] and S.versions(spark, path) == [0, 1, 3, 4]
    put(5, [1], [(1, 0, "back")])
    assert rows() == [(1, 0, "back")]


def test_old_versions_can_be_forgotten(spark):
    path = fresh_path(spark, "store")
    for version in range(4):
        rows = spark.createDataFrame([(i, 0, f"{version}") for i in range(version, 12, version + 1)], CHUNKS)
        S.upsert(rows, rows.select("doc_id"), path, ["doc_id"], version, buckets=8)
    want = {v: sorted(tuple(r) for r in S.read_store(spark, path, CHUNKS, v).collect()) for v in (2, 3)}
    stored = spark.read.parquet(f"{path}/data").inputFiles()
    S.forget(spark, path, keep=2)
    assert S.versions(spark, path) == [2, 3] and len(spark.read.parquet(f"{path}/data").inputFiles()) < len(stored)
    assert {v: sorted(tuple(r) for r in S.read_store(spark, path, CHUNKS, v).collect()) for v in (2, 3)} == want
    S.forget(spark, path, keep=2)
    assert S.versions(spark, path) == [2, 3]


def test_a_half_written_update_is_not_seen_and_can_be_repeated(spark):
    path = fresh_path(spark, "store")
    one, two = (spark.createDataFrame([(i, 0, t) for i in range(10)], CHUNKS) for t in ("one", "two"))
    S.upsert(one, one.select("doc_id"), path, ["doc_id"], 0, buckets=4)
    half = two.limit(3).withColumn("bucket", F.lit(1)).withColumn("written", F.lit(1))
    half.write.mode("append").partitionBy("bucket", "written").parquet(f"{path}/data")  # ended before its pointer
    assert {r["text"] for r in S.read_store(spark, path, CHUNKS).collect()} == {"one"}
    S.upsert(two, two.select("doc_id"), path, ["doc_id"], 1, buckets=4)
    assert sorted((r["doc_id"], r["text"]) for r in S.read_store(spark, path, CHUNKS).collect()) == [(i, "two") for i in range(10)]


def test_redelivered_documents_stand_in_the_index_once(spark, tmp_path):
    good = "# Chapter 1\n\n" + "\n\n".join(f"Paragraph {i} has words of its own, enough of them to be kept in the index {i}." for i in range(30))
    batches = [[(1, good), (2, good)], [(1, good[: len(good) // 3]), (1, good[: len(good) // 3]), (3, good)], [(2, "\n")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"docs{n}"))
    path = fresh_path(spark, "reindex")
    source = spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    J.ingest_stream(source, path, buckets=4)
    chunks, status = J.ingested(spark, path)
    alone = fresh_path(spark, "alone")
    spark.createDataFrame([batches[1][0], batches[1][2]], "doc_id long, text string").coalesce(1).write.parquet(f"{alone}/source")
    J.ingest_stream(spark.readStream.schema("doc_id long, text string").parquet(f"{alone}/source"), alone)
    want, _ = J.ingested(spark, alone)
    read = lambda df: sorted(str(r) for r in df.select(*sorted(df.columns)).collect())
    assert read(chunks) == read(want) and chunks.count() > 0
    assert {r["doc_id"]: r["status"] for r in status.collect()}.keys() == {1, 3}


def test_ingest_cuts_chunks_and_units_once(spark, tmp_path):
    """The range join reads both several times, so they are tables by then."""
    path, text = str(tmp_path), "# One\n\n" + "A sentence of the first part. " * 80
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{path}/source")
    J.ingest_stream(spark.readStream.schema("doc_id long, text string").parquet(f"{path}/source"), path, buckets=2)
    chunks, _ = J.ingested(spark, path)
    cut, units = spark.read.parquet(f"{path}/cut"), spark.read.parquet(f"{path}/units")
    assert units.count() > 0 and chunks.count() > 1
    assert {r["text"] for r in chunks.collect()} == {r["text"] for r in cut.collect()}
