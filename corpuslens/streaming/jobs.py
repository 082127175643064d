"""Structured Streaming forms of ingestion, status, usage, throttling and response assembly.

Every job writes each micro-batch under its own epoch folder, so a replayed batch overwrites itself, and
keeps its checkpoint in the shared folder. Finished results are read back as ordinary frames.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuslens.operators import corpus as C
from corpuslens.operators.ordering import latest_per_key
from corpuslens.session import use_utc
from corpuslens.sources.readers import write_table
from corpuslens.sources.store import BUCKETS, read_together, write_together
from corpuslens.sources.tables import spread

Cols = Sequence[str]


def table_stream(spark: SparkSession, directory: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """File stream over one table, a file or a folder of files, zone-less timestamps read as UTC.

    The path is a pattern that only the table's own name fits; a stream takes a single file only by a pattern.
    """
    use_utc(spark)
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    raw = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{directory}/{name}.parque[t]")
    )
    zoneless = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return raw.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else raw


def drain(stream: DataFrame, path: str, mode: str, each: Callable[[DataFrame, int], None] | None = None) -> int:
    """Run a stream over everything available now, one folder per epoch; returns the rows of state that are left."""

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/epoch={epoch}")

    job = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(each or store)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return sum(operator["numRowsTotal"] for operator in (job.lastProgress or {"stateOperators": []})["stateOperators"])


def drain_append(stream: DataFrame, path: str) -> None:
    """Append-only results go straight to the transactional file sink."""
    job = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()


def results(spark: SparkSession, path: str, keys: Cols | None = None) -> DataFrame:
    """All stored rows, or with keys the newest epoch's row per key (update mode)."""
    rows = spark.read.parquet(f"{path}/data")
    if keys is None:
        return rows
    return latest_per_key(rows, keys, ["epoch"]).drop("epoch")


# ---------------------------------------------------------------------------------------------------
# ingestion

STATUS = "doc_id long, status string, reason string, document_type string"


def ingest_stream(stream: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Clean, profile, gate, chunk and assign each batch, and put the result in the place of what the index had of its
    documents. Keys are deterministic, so re-delivery is harmless; a document that got shorter or is rejected leaves no
    chunks of its former self. Of the rows of one document in a batch the greatest text counts.

    Cleaned text, profiles, blocks, chunks and units are written once per epoch and read back: all that needs them
    starts from the files instead of repeating the work (the range join reads chunks three times and units twice), and
    a lost executor costs no recomputation. Only buckets of the batch's documents are rewritten, and chunks and status
    are committed together.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        once = spread(batch, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
        cleaned = C.clean_corpus(once).select("doc_id", "text")
        texts = write_table(cleaned, f"{path}/clean/epoch={epoch}")
        full = texts.filter(F.trim("text", F.lit(" \n")) != "")
        profiles = write_table(C.profile_corpus(spread(full, "doc_id")), f"{path}/profile/epoch={epoch}")
        good = F.col("quality.indexable")
        status = profiles.select(
            "doc_id",
            F.when(good, "scanned").otherwise("failed").alias("status"),
            F.when(~good, F.array_join("quality.warnings", ",")).alias("reason"),
            "document_type",
        )
        fit = profiles.filter(good).select("doc_id", "unit_strategy")
        blocks = write_table(C.split_blocks(spread(texts, "doc_id").join(fit, "doc_id", "left_semi")), f"{path}/blocks/epoch={epoch}")
        cut = write_table(C.chunk_structured(blocks), f"{path}/cut/epoch={epoch}")
        units = write_table(C.build_units(blocks, fit), f"{path}/units/epoch={epoch}")
        chunks = C.assign_chunks_to_units(cut, units)
        write_table(chunks.limit(0), f"{path}/chunk_schema")
        touched = texts.select("doc_id")
        write_together({"chunks": chunks, "status": status}, touched, path, ["doc_id"], epoch, buckets)

    drain(stream, path, "append", each)


def ingested(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Index and status as of the last finished batch."""
    chunks = spark.read.parquet(f"{path}/chunk_schema").schema
    return read_together(spark, path, "chunks", chunks), read_together(spark, path, "status", STATUS)


# ---------------------------------------------------------------------------------------------------
# per-key state and totals


def newest(events: DataFrame, key: str, order: Cols, fields: Cols) -> DataFrame:
    """Newest row per key as an aggregate, in batch and in update mode."""
    g = events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_n"))
    return g.select(key, *[F.col("_n").getField(f).alias(f) for f in fields])


def latest_status(events: DataFrame) -> DataFrame:
    """Newest state per asset; a re-queued or running scan clears what the previous scan derived.

    ``events``: (asset_id, at, event_id, status, quality_score).
    """
    open_ = F.col("status").isin("uploaded", "scanning")
    cleared = events.withColumn("quality_score", F.when(~open_, F.col("quality_score")))
    return newest(cleared, "asset_id", ["at", "event_id"], ["status", "quality_score", "at", "event_id"])


def latest_status_stream(events: DataFrame, period: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Streaming form: newest state per asset and period. State ends with the period.

    An asset's state of a period is dropped once the watermark has passed the period, so state holds the assets of open
    periods, not all that ever were. A row that comes after its period was dropped is too late and is not counted; one
    that is late but within an open period is. The newest row over the periods that were written (`newest_of`) is the
    batch result.
    """
    open_ = F.col("status").isin("uploaded", "scanning")
    cleared = events.withWatermark("at", lateness).withColumn("quality_score", F.when(~open_, F.col("quality_score")))
    fields = ["status", "quality_score", "at", "event_id"]
    g = cleared.groupBy(F.window("at", period).alias("w"), "asset_id").agg(F.max_by(F.struct(*fields), F.struct("at", "event_id")).alias("_n"))
    return g.select("asset_id", F.col("w.start").alias("period"), *[F.col("_n").getField(f).alias(f) for f in fields])


def newest_of(rows: DataFrame, key: str, order: Cols) -> DataFrame:
    """One row a key: the newest of those that a stream has written for its periods, whichever batch wrote them."""
    return latest_per_key(rows, [key], list(order))


def usage_windows(usage: DataFrame, lateness: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Requests, tokens, cost and latency per feature, provider, model and time window."""
    over = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    g = usage.withWatermark("created_at", lateness).groupBy(over.alias("w"), "feature", "provider", "model")
    return g.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    ).select(F.col("w.start").alias("window_start"), "feature", "provider", "model", "n_events", "input_tokens", "cost_usd", "avg_latency_ms")


def usage_sessions(usage: DataFrame, key: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Activity sessions per key; a session is emitted once the watermark has passed its end."""
    g = usage.withWatermark("created_at", lateness).groupBy(F.session_window("created_at", gap).alias("w"), key)
    return g.agg(F.count(F.lit(1)).alias("n_events"), F.sum("cost_usd").alias("cost_usd")).select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n_events", "cost_usd"
    )


def recent_counts(events: DataFrame, key: str, ts: str, size: str, slide: str, lateness: str = "10 minutes") -> DataFrame:
    """Trailing counts per key on a sliding window (the exact per-event form is the ordered scan)."""
    g = events.withWatermark(ts, lateness).groupBy(F.window(ts, size, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), key, "n")


def dedupe_events(events: DataFrame, keys: Cols, ts: str, lateness: str = "1 hour") -> DataFrame:
    """The same id is never counted twice within the watermark."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


PARTS = {"answer": ("final", F.max_by, F.max), "plan": ("trace", F.min_by, F.min), "conversation": ("conversation", F.min_by, F.min)}


def assemble_responses(events: DataFrame) -> DataFrame:
    """Per request: last final answer, first plan trace, first conversation event, error flag when there is no final.

    ``events``: (request_id, seq, type, payload).
    """
    return _finished(_parts(events, "request_id").select("request_id", *PARTS, "n_events"))


def _parts(events: DataFrame, *by) -> DataFrame:
    """Each part of a response with its place in the order of events, so that partial responses can be put together."""
    aggregates = [F.count("seq").alias("n_events")]
    for name, (kind, by_order, end) in PARTS.items():
        seq = F.when(F.col("type") == kind, F.col("seq"))
        aggregates += [by_order("payload", seq).alias(name), end(seq).alias(f"{name}_seq")]
    return events.groupBy(*by).agg(*aggregates)


def _finished(responses: DataFrame) -> DataFrame:
    return responses.withColumn("error", F.when(F.col("answer").isNull(), "missing_final"))


def assemble_responses_stream(events: DataFrame, period: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Streaming form over (request_id, seq, type, payload, at): the parts of a request by period. State ends with the period.

    The parts of a period are dropped from the state once the watermark has passed it; an event that comes later than
    that is not counted. A request over several periods is put together by `responses_of`.
    """
    dated = events.withWatermark("at", lateness)
    g = _parts(dated, F.window("at", period).alias("w"), "request_id")
    return g.withColumn("period", F.col("w.start")).drop("w")


def responses_of(rows: DataFrame) -> DataFrame:
    """One response a request from the parts that a stream has written for its periods; the newest batch's row of a period counts."""
    parts = latest_per_key(rows, ["request_id", "period"], ["epoch"])
    whole = [by_order(name, f"{name}_seq").alias(name) for name, (_, by_order, _) in PARTS.items()]
    return _finished(parts.groupBy("request_id").agg(*whole, F.sum("n_events").alias("n_events")))


# ---------------------------------------------------------------------------------------------------
# throttling


class _Gate:
    """Accepted times of one key inside the window, oldest first."""

    def __init__(self, gap: float, limit: int, window: float, times: Sequence[float] = ()) -> None:
        self.gap, self.limit, self.window, self.times = gap, limit, window, deque(times)

    def admit(self, now: float) -> str:
        while self.times and now - self.times[0] >= self.window:
            self.times.popleft()
        if self.times and now - self.times[-1] < self.gap:
            return "too_fast"
        if len(self.times) >= self.limit:
            return "too_many"
        self.times.append(now)
        return "accepted"


def calm_stretches(events: DataFrame, key: str, ts: str, window_s: int) -> DataFrame:
    """Splits a key's events wherever a whole window passed without any, since nothing is remembered across it.

    Only the occupied (key, slice) pairs are ordered, so a busy key is cut into many stretches.
    """
    slice_ = F.floor(F.unix_micros(ts) / (window_s * 1_000_000))
    e = events.withColumn("_slice", slice_)
    occupied = e.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_c")).drop("_c")
    w = Window.partitionBy(key).orderBy("_slice")
    apart = F.when(F.col("_slice") - F.lag("_slice").over(w) > 1, 1).otherwise(0)
    runs = occupied.withColumn("_apart", apart).withColumn("_run", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.join(runs.drop("_apart"), [key, "_slice"]).drop("_slice")


def throttle(events: DataFrame, key: str, ts: str, order: str, gap_s: int, limit: int, window_s: int) -> DataFrame:
    """Accept or reject each event by the gap to the last accepted one, then by accepted ones in the window.

    Rejected events are not remembered. Stretches are hashed over tasks and each task walks its sorted rows
    in Arrow batches holding only the current stretch's accepted times.
    """
    rows = calm_stretches(events.select(key, ts, order), key, ts, window_s)
    rows = rows.select(key, "_run", order, F.unix_micros(ts).alias("_us"))
    spread = rows.repartition(key, "_run").sortWithinPartitions(key, "_run", "_us", order)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, gate = None, None
        for pdf in frames:
            out = []
            for k, run, us in zip(pdf[key], pdf["_run"], pdf["_us"]):
                if (k, run) != current:
                    current, gate = (k, run), _Gate(gap_s * 1e6, limit, window_s * 1e6)
                out.append(gate.admit(us))
            yield pd.DataFrame({order: pdf[order], key: pdf[key], "decision": out})

    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    return spread.mapInPandas(walk, f"`{order}` {types[order]}, `{key}` {types[key]}, decision string")


def throttle_stream(
    events: DataFrame, key: str, ts: str, order: str, gap_s: int, limit: int, window_s: int, lateness: str = "10 minutes"
) -> DataFrame:
    """Streaming form: the accepted times of a key are its state, dropped once the watermark shows the key quiet.

    Rows of a key are decided in order of time inside a micro-batch; a row that comes in a later micro-batch is decided
    after all earlier ones, as the throttle it stands for would.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out_schema = f"`{order}` {types[order]}, `{key}` {types[key]}, decision string"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        gate = _Gate(gap_s * 1e6, limit, window_s * 1e6, state.get[0] if state.exists else ())
        # All frames of the key in one order: two numbers a row, whatever the size of an Arrow batch.
        rows = pd.concat([pdf[["_us", order]] for pdf in frames]).sort_values(["_us", order])
        yield pd.DataFrame({order: rows[order], key: k[0], "decision": [gate.admit(u) for u in rows["_us"]]})
        state.update((list(gate.times),))
        quiet_at = int((gate.times[-1] if gate.times else 0) / 1000) + window_s * 1000
        state.setTimeoutTimestamp(max(quiet_at, state.getCurrentWatermarkMs() + 1))

    slim = events.withWatermark(ts, lateness).select(key, order, ts, F.unix_micros(ts).cast("double").alias("_us"))
    return slim.groupBy(key).applyInPandasWithState(
        step, out_schema, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )

