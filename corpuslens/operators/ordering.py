"""Ranking, ordered scans, sampling by position and packing.

Keys that may be hot (a user, a source) go through aggregates that combine map-side, through
``WindowGroupLimit`` (row_number <= k), or through ordered scans split into bounded buckets. Plain
windows are used only where one group is one document, answer, query result or conversation turn set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[str]


def topk(df: DataFrame, keys: Cols, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best k rows per key; the planner prunes to k per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def topk_scored(df: DataFrame, keys: Cols, score: str, ties: Cols, k: int, rank: str = "rank") -> DataFrame:
    """Highest scores per key. Scores equal to nine digits are ties, settled by the tie columns."""
    # Whole billionths as a long: same ties as rounding to nine digits, without decimal arithmetic per row.
    nine = F.floor(F.col(score) * F.lit(1e9) + F.lit(0.5))
    return topk(df, keys, [nine.desc(), *[F.col(t).asc() for t in ties]], k, rank)


def recent_first(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def latest_per_key(df: DataFrame, keys: Cols, order: Cols) -> DataFrame:
    """Newest row per key as a map-side combined aggregate, so a hot key never lands in one sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest]).select(*df.columns)


def dedupe_first(df: DataFrame, keys: Cols, order: Cols) -> DataFrame:
    """First row per key in the given order (order matters, so not dropDuplicates)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest]).select(*df.columns)


def last_n(df: DataFrame, keys: Cols, order: Cols, n: int) -> DataFrame:
    """Last n rows per key."""
    return topk(df, keys, [F.col(c).desc() for c in order], n, "_back").drop("_back")


def bucketed_rank(df: DataFrame, keys: Cols, bucket: Column, order: Sequence[Column], out: str) -> DataFrame:
    """Position of each row in its key's order, for keys too large for one sort.

    ``bucket`` must not decrease along ``order``. Rows are ranked inside (key, bucket) and shifted by the
    number of rows in earlier buckets, which is a small frame.
    """
    b = df.withColumn("_bucket", bucket)
    sizes = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = b.withColumn("_pos", F.row_number().over(local))
    return (
        ranked.join(offsets, [*keys, "_bucket"])
        .withColumn(out, (F.col("_pos") + F.col("_before")).cast("long"))
        .drop("_bucket", "_pos", "_before")
    )


def sliding_count(df: DataFrame, keys: Cols, ts: str, seconds: int, out: str = "recent") -> DataFrame:
    """Rows of the same key in the trailing window, the row itself included.

    Every row is also sent to the next time slice, so a slice of one window length holds all a row needs
    and a busy key is spread over its slices.
    """
    micros = seconds * 1_000_000
    t = df.withColumn("_us", F.unix_micros(ts)).withColumn("_slice", F.floor(F.col("_us") / micros))
    spread = t.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(
        "_slice", F.when(F.col("_own"), F.col("_slice")).otherwise(F.col("_slice") + 1)
    )
    w = Window.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(-micros, 0)
    counted = spread.withColumn(out, F.count(F.lit(1)).over(w)).filter("_own")
    return counted.drop("_us", "_slice", "_own")


def history_before(
    df: DataFrame, keys: Cols, order: Cols, bucket: Column, value: Column, n: int, out: str, block: int = 1024
) -> DataFrame:
    """Up to n earlier values of the key at each row, oldest first.

    Rows are numbered per key and cut into blocks; the last n rows of a block also go to the next one, so a
    long conversation is spread over its blocks. ``bucket`` must not decrease along ``order``.
    """
    ranked = bucketed_rank(df.withColumn("_v", value), keys, bucket, [F.col(c) for c in order], "_at")
    at = F.col("_at") - 1
    own = F.floor(at / block)
    blocks = F.when(at % block >= block - n, F.array(own, own + 1)).otherwise(F.array(own))
    spread_rows = ranked.withColumns({"_own": own, "_block": F.explode(blocks)})
    w = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(-n, -1)
    filled = spread_rows.withColumn(out, F.collect_list("_v").over(w)).filter(F.col("_own") == F.col("_block"))
    return filled.drop("_v", "_at", "_own", "_block")


def last_before(df: DataFrame, keys: Cols, order: Cols, bucket: Column, values: dict[str, Column]) -> DataFrame:
    """Latest earlier non-null value per key at each row, for several values at once.

    Looks back inside the row's bucket, then at the newest value of earlier buckets (a small frame).
    """
    d = df.withColumns({"_bucket": bucket, **{f"_v_{k}": v for k, v in values.items()}})
    place = F.struct(*order)
    newest = [F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), place)).alias(f"_l_{k}") for k in values]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = d.groupBy(*keys, "_bucket").agg(*newest).select(
        *keys, "_bucket", *[F.last(f"_l_{k}", ignorenulls=True).over(before).alias(f"_c_{k}") for k in values]
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = d.withColumns({f"_h_{k}": F.last(f"_v_{k}", ignorenulls=True).over(local) for k in values})
    j = here.join(carried, [*keys, "_bucket"])
    return j.select(*df.columns, *[F.coalesce(f"_h_{k}", f"_c_{k}").alias(k) for k in values])


def island_ids(df: DataFrame, keys: Cols, order: Cols, marker: Column, out: str) -> DataFrame:
    """Consecutive rows with an equal marker share an id (1-based)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    m = df.withColumn("_marker", marker)
    change = F.when(F.lag("_marker").over(w).eqNullSafe(F.col("_marker")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    flagged = m.withColumn("_change", change)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn(out, F.sum("_change").over(run)).drop("_marker", "_change")


def even_positions(n: Column, limit: int) -> Column:
    """0-based positions kept when n items are thinned evenly to the limit."""
    if limit <= 0:
        return F.sequence(F.lit(0), n.cast("int") - 1)
    if limit == 1:
        return F.array(F.lit(0))
    every = F.sequence(F.lit(0), n.cast("int") - 1)
    picks = F.array_distinct(
        F.transform(
            F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (n - 1) / F.lit(limit - 1)).cast("int")
        )
    )
    return F.when(n <= limit, every).otherwise(picks)


def cap_evenly(df: DataFrame, keys: Cols, order: Cols, limit: int) -> DataFrame:
    """Thin each (bounded) group to evenly spaced rows."""
    if limit <= 0:
        return df
    w = Window.partitionBy(*keys)
    numbered = df.withColumn("_pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(w)
    )
    return numbered.filter(F.array_contains(even_positions(F.col("_n"), limit), F.col("_pos"))).drop("_pos", "_n")


def anchor_positions(n: Column) -> Column:
    """Start, middle, end, and quarters from eight items up."""
    n = n.cast("int")
    base = F.array(F.lit(0), n - 1, F.floor(n / 2).cast("int"))
    wide = F.array_union(base, F.array(F.floor(n / 4).cast("int"), F.floor(n * 3 / 4).cast("int")))
    return F.when(n <= 3, F.sequence(F.lit(0), n - 1)).when(n >= 8, wide).otherwise(base)


def window_anchor_positions(n: Column) -> Column:
    """Anchors for long reading windows: everything up to eight, then both ends and the quarters."""
    n = n.cast("int")
    wide = F.array_distinct(
        F.array(
            F.lit(0),
            F.lit(1),
            n - 2,
            n - 1,
            F.floor(n / 4).cast("int"),
            F.floor(n / 2).cast("int"),
            F.floor(n * 3 / 4).cast("int"),
        )
    )
    return F.when(n <= 8, F.sequence(F.lit(0), n - 1)).otherwise(wide)


def anchor_sample(df: DataFrame, keys: Cols, order: Cols, wide: bool = False) -> DataFrame:
    w = Window.partitionBy(*keys)
    numbered = df.withColumn("_pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(w)
    )
    picks = (window_anchor_positions if wide else anchor_positions)(F.col("_n"))
    return numbered.filter(F.array_contains(picks, F.col("_pos"))).drop("_pos", "_n")


PACK_BLOCK = 256  # elements packed before their batch numbers are put behind those of earlier blocks


def pack_array(sizes: Column, budget: int, max_items: int | None = None) -> Column:
    """Batch number (1-based) of every element when packed in order; a batch restarts when the next
    element would pass the budget. An oversize element still gets a batch of its own.

    Elements are taken in blocks: appending to an array copies it, so only short ones grow element by element.
    """
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("count"), none.alias("out"))

    def step(acc: Column, size: Column) -> Column:
        full = (acc["used"] + size > budget) & (acc["count"] > 0)
        if max_items is not None:
            full = full | (acc["count"] >= max_items)
        fresh = full | (acc["batch"] == 0)
        batch = F.when(fresh, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(
            batch.alias("batch"),
            F.when(fresh, size).otherwise(acc["used"] + size).cast("long").alias("used"),
            F.when(fresh, F.lit(1)).otherwise(acc["count"] + 1).alias("count"),
            F.concat(acc["out"], F.array(batch)).alias("out"),
        )

    def block(acc: Column, some: Column) -> Column:
        begin = F.struct(acc["s"]["batch"].alias("batch"), acc["s"]["used"].alias("used"), acc["s"]["count"].alias("count"), none.alias("out"))
        packed = F.aggregate(some, begin, step)
        return F.struct(packed.alias("s"), F.concat(acc["blocks"], F.array(acc["s"]["out"])).alias("blocks"))

    n_blocks = F.ceil(F.size(sizes) / PACK_BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(n_blocks, F.lit(1))), lambda i: F.slice(sizes, (i - 1) * PACK_BLOCK + 1, PACK_BLOCK))
    whole = F.struct(start.alias("s"), F.array().cast("array<array<int>>").alias("blocks"))
    return F.aggregate(blocks, whole, block, lambda acc: F.concat(F.flatten(acc["blocks"]), acc["s"]["out"]))


def pack_by_budget(
    df: DataFrame, keys: Cols, order: Cols, size: Column, budget: int, max_items: int | None = None
) -> DataFrame:
    """Greedy packing with reset inside each (bounded) group; adds ``batch``."""
    rest = [c for c in df.columns if c not in keys]
    packed = (
        df.withColumn("_size", size.cast("long"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(*order, "_size", F.struct(*rest).alias("_row")))).alias("_rows"))
        .withColumn("_batches", pack_array(F.transform("_rows", lambda r: r["_size"]), budget, max_items))
        .select(*keys, F.explode(F.arrays_zip("_rows", "_batches")).alias("_z"))
    )
    row = F.col("_z")["_rows"]["_row"]
    return packed.select(*keys, *[row[c].alias(c) for c in rest], F.col("_z")["_batches"].alias("batch"))


def truncate_to_budget(
    df: DataFrame, keys: Cols, order: Cols, text: str, budget: int, keep_cut_above: int = 600
) -> DataFrame:
    """Take texts until the budget would be passed; the first text beyond it is cut when enough room is left."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = df.withColumn("_before", before).withColumn("_pos", F.row_number().over(w))
    fits = (F.col("_pos") == 1) | (F.col("_before") + F.length(text) <= budget)
    sized = sized.withColumn("_fits", fits)
    broken = F.coalesce(
        F.max(F.when(~F.col("_fits"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    room = F.lit(budget) - F.col("_before")
    kept = sized.withColumn("_broken", broken).filter(
        (F.col("_broken") == 0) & (F.col("_fits") | (room > keep_cut_above))
    )
    cut = F.when(F.col("_fits"), F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), room.cast("int")))
    return kept.withColumn(text, cut).drop("_before", "_pos", "_fits", "_broken")


def union_stages(*frames: DataFrame) -> DataFrame:
    """Concatenate rankings of several stages, columns by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_case_sets(frames: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Union by id; the earliest set's row wins and the contributing sets are listed in order."""
    tagged = union_stages(
        *[f.withColumns({"_ord": F.lit(i), "_name": F.lit(name)}) for i, (name, f) in enumerate(frames)]
    )
    rest = [c for c in frames[0][1].columns if c != key]
    merged = tagged.groupBy(key).agg(
        F.min_by(F.struct(*rest), "_ord").alias("_row"),
        F.array_sort(F.collect_set(F.struct("_ord", "_name"))).alias("_sets"),
    )
    return merged.select(
        key,
        *[F.col("_row").getField(c).alias(c) for c in rest],
        F.transform("_sets", lambda s: s["_name"]).alias("subsets"),
    )


def apportion_points(questions: DataFrame, key: str, position: str, total: float) -> DataFrame:
    """Split a total into half points by weight with largest remainders, one unit each where affordable."""
    units_total = max(1, round(total * 2))
    w = Window.partitionBy(key)
    stated = F.coalesce(F.col("points").cast("double"), F.lit(0.0))
    weight = F.when(stated > 0, stated).when(F.col("type") == "descriptive", 3.0).otherwise(1.0)
    q = questions.withColumn("_w", weight)
    q = q.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "_exact", F.col("_w") / F.sum("_w").over(w) * F.lit(units_total)
    )
    q = q.withColumn("_frac", F.col("_exact") - F.floor("_exact"))
    floor_unit = F.when(F.col("_n") <= units_total, 1).otherwise(0)
    q = q.withColumn("_floor", floor_unit).withColumn(
        "_unit", F.greatest(F.floor("_exact"), F.col("_floor").cast("long"))
    )
    q = q.withColumn("_diff", F.lit(units_total) - F.sum("_unit").over(w))
    up = F.row_number().over(w.orderBy(F.col("_frac").desc(), F.col(position))) - 1
    extra = F.when(
        F.col("_diff") > 0,
        F.floor(F.col("_diff") / F.col("_n")) + F.when(up < F.col("_diff") % F.col("_n"), 1).otherwise(0),
    ).otherwise(0)
    q = q.withColumn("_extra", extra).withColumn("_room", F.col("_unit") - F.col("_floor"))
    down = w.orderBy(F.col("_frac").asc(), F.col(position)).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("_room").over(down), F.lit(0))
    cut = F.when(
        F.col("_diff") < 0, F.greatest(F.lit(0), F.least(F.col("_room"), -F.col("_diff") - taken))
    ).otherwise(0)
    units = F.col("_unit") + F.col("_extra") - cut
    return q.withColumn("points", units / 2).drop(
        "_w", "_n", "_exact", "_frac", "_floor", "_unit", "_diff", "_extra", "_room"
    )


def number_citations(used: DataFrame, answer: str, position: str, label: str) -> DataFrame:
    """Marker number of a label is the order of its first appearance in the answer."""
    firsts = used.groupBy(answer, label).agg(F.min(position).alias("_first"))
    w = Window.partitionBy(answer).orderBy("_first")
    return used.join(firsts.withColumn("marker", F.dense_rank().over(w)).drop("_first"), [answer, label])
