import datetime as dt
import random

from pyspark.sql import functions as F

from corpuslens.operators import ordering as O
from corpuslens.streaming import jobs as J


def test_packing_restarts_and_keeps_oversize_items(spark):
    df = spark.createDataFrame([("d", i, s) for i, s in enumerate([3, 3, 5, 20, 1, 1])], "k string, i int, s int")
    got = [r["batch"] for r in O.pack_by_budget(df, ["k"], ["i"], F.col("s"), 8).orderBy("i").collect()]
    assert got == [1, 1, 2, 3, 4, 4]
    capped = [r["batch"] for r in O.pack_by_budget(df, ["k"], ["i"], F.col("s"), 100, 2).orderBy("i").collect()]
    assert capped == [1, 1, 2, 2, 3, 3]


def test_even_cap_and_anchors(spark):
    df = spark.createDataFrame([("k", i) for i in range(10)], "k string, i int")
    assert sorted(r["i"] for r in O.cap_evenly(df, ["k"], [F.col("i")], 4).collect()) == [0, 3, 6, 9]
    assert [r["i"] for r in O.cap_evenly(df, ["k"], [F.col("i")], 1).collect()] == [0]
    assert O.cap_evenly(df, ["k"], [F.col("i")], 0).count() == 10
    assert sorted(r["i"] for r in O.anchor_sample(df, ["k"], [F.col("i")]).collect()) == [0, 2, 5, 7, 9]


def test_points_are_split_whole(spark):
    q = spark.createDataFrame(
        [("e", 1, "multiple_choice", None), ("e", 2, "descriptive", None), ("e", 3, "multiple_choice", 2.0)], "exam string, position int, type string, points double"
    )
    p = [r["points"] for r in O.apportion_points(q, "exam", "position", 5).orderBy("position").collect()]
    assert sum(p) == 5 and p == [1.0, 2.5, 1.5]


def events(spark, n=600, hot=0.5):
    rnd = random.Random(3)
    t0, rows, t = dt.datetime(2024, 1, 1), [], 0.0
    for i in range(n):
        t += rnd.choice([0.2, 0.7, 3.0, 30.0, 700.0])
        rows.append((i, "hot" if rnd.random() < hot else f"u{rnd.randrange(5)}", t0 + dt.timedelta(seconds=t)))
    return rows, spark.createDataFrame(rows, "event_id long, user string, ts timestamp")


def test_sliding_count_and_rank_match_brute_force(spark):
    rows, df = events(spark)
    want = {i: sum(1 for _, v, s in rows if v == u and t - dt.timedelta(seconds=60) <= s <= t) for i, u, t in rows}
    got = {r["event_id"]: r["recent"] for r in O.sliding_count(df, ["user"], "ts", 60).collect()}
    assert got == want
    ranked = O.bucketed_rank(df, ["user"], F.date_trunc("minute", "ts"), [F.col("ts"), F.col("event_id")], "pos")
    got = {r["event_id"]: r["pos"] for r in ranked.collect()}
    seen: dict = {}
    for i, u, _ in rows:
        seen[u] = seen.get(u, 0) + 1
        assert got[i] == seen[u]


def brute_throttle(rows, gap, limit, window):
    hist, out = {}, {}
    for i, u, t in rows:
        s = t.timestamp()
        h = hist.setdefault(u, [])
        h[:] = [x for x in h if s - x < window]
        if h and s - h[-1] < gap:
            out[i] = "too_fast"
        elif len(h) >= limit:
            out[i] = "too_many"
        else:
            out[i] = "accepted"
            h.append(s)
    return out


def test_throttle_matches_brute_force(spark):
    rows, df = events(spark)
    got = {r["event_id"]: r["decision"] for r in J.throttle(df, "user", "ts", "event_id", 1, 3, 60).collect()}
    assert got == brute_throttle(rows, 1, 3, 60)
    assert set(got.values()) == {"accepted", "too_fast", "too_many"}


def test_upsert_is_idempotent(spark):
    from corpuslens.operators.relational import upsert_latest

    base = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, v int, t string")
    new = spark.createDataFrame([("b", 1, "z"), ("c", 1, "w")], "id string, v int, t string")
    once = upsert_latest(base, new, ["id"], ["v"])
    want = {("a", "x"), ("b", "z"), ("c", "w")}
    assert {(r["id"], r["t"]) for r in once.collect()} == want
    assert {(r["id"], r["t"]) for r in upsert_latest(once, new, ["id"], ["v"]).collect()} == want


def test_look_back_across_blocks_matches_brute_force(spark):
    rnd = random.Random(11)
    rows = [("hot", i * 3, rnd.choice([None, str(i)])) for i in range(60)] + [("b", 1, "x"), ("b", 2, None)]
    df = spark.createDataFrame(rows, "k string, t long, v string")
    bucket = F.floor(F.col("t") / 20)
    got = {(r["k"], r["t"]): r["prev"] for r in O.last_before(df, ["k"], ["t"], bucket, {"prev": F.col("v")}).collect()}
    hist = O.history_before(df, ["k"], ["t"], bucket, F.struct("t"), 5, "h", block=8)
    past = {(r["k"], r["t"]): [x["t"] for x in r["h"]] for r in hist.collect()}
    for k, t, _ in rows:
        before = [(s, v) for j, s, v in rows if j == k and s < t]
        assert got[(k, t)] == next((v for _, v in reversed(before) if v is not None), None)
        assert past[(k, t)] == [s for s, _ in before][-5:]
