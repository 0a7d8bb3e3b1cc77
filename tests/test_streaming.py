from datetime import datetime, timedelta

from pyspark.sql import functions as F

from panelyard.streaming import feeds

T0 = datetime(2026, 9, 13, 17)


def stream_of(spark, path, batches, schema):
    """A stream with one file a batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in{k}")
        import os
        import shutil

        os.makedirs(f"{path}/in", exist_ok=True)
        part = next(f for f in os.listdir(f"{path}/in{k}") if f.endswith(".parquet"))
        shutil.copy(f"{path}/in{k}/{part}", f"{path}/in/{k:03}.parquet")
        os.utime(f"{path}/in/{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return feeds.events(spark, f"{path}/in", spark.createDataFrame(batches[0], schema).schema)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_final_status_is_never_replaced(spark, tmp_path):
    s = stream_of(spark, str(tmp_path), [[("g", at(0), "pre"), ("h", at(0), "pre")], [("g", at(60), "final")], [("g", at(90), "live"), ("h", at(30), "live"), ("h", at(10), "pre")]], "game string, ts timestamp, status string")
    got = feeds.collected(feeds.final_status(s, "game", "ts", "status"), f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    assert sorted((r["game"], r["status"]) for r in got) == [("g", "final"), ("g", "pre"), ("h", "live"), ("h", "pre")]


def test_change_events_tell_late_rows(spark, tmp_path):
    s = stream_of(spark, str(tmp_path), [[(1, at(0), "a"), (1, at(5), "b")], [(1, at(2), "c"), (1, at(9), "b"), (1, at(12), "a")]], "k long, ts timestamp, st string")
    got = feeds.collected(feeds.changes(s, "k", "ts", "st"), f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    assert sorted((r["was"], r["now"]) for r in got if not r["late"]) == [("a", "b"), ("b", "a")]
    assert [(r["ts"], r["was"], r["now"]) for r in got if r["late"]] == [(at(2), None, "c")]


def test_staleness_alerts(spark, tmp_path):
    s = stream_of(spark, str(tmp_path), [[("x", at(0)), ("y", at(0))], [("y", at(100))], [("y", at(200))], [("x", at(300)), ("y", at(300))]], "source string, ts timestamp")
    got = feeds.collected(feeds.stale_alerts(s, "source", "ts", 2.0), f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    assert ("x", "STALE") in {(r["source"], r["event"]) for r in got} and ("x", "FRESH") in {(r["source"], r["event"]) for r in got}
    assert not [r for r in got if r["source"] == "y"]


def test_open_close_counts_quotes_in_play(spark, tmp_path):
    s = stream_of(spark, str(tmp_path), [[("g", "p", at(0), 1.5), ("g", "p", at(20), 1.7)], [("g", "p", at(40), 9.0)]], "game string, prop string, ts timestamp, price double")
    kick = spark.createDataFrame([("g", at(30))], "game string, kickoff timestamp")
    got = feeds.collected(feeds.open_close(s, kick, "game", ["prop"], "ts", "price", "1 day"), f"{tmp_path}/out", f"{tmp_path}/cp", mode="complete").collect()
    assert [(r["open"], r["close"], r["quotes"], r["in_play"]) for r in got] == [(1.5, 1.7, 2, 1)]


def test_open_close_is_one_row_for_quotes_of_several_days(spark, tmp_path):
    day = 24 * 60
    s = stream_of(spark, str(tmp_path), [[("g", "p", at(0), 1.5), ("h", "p", at(0), 4.0)], [("g", "p", at(day), 1.6), ("g", "p", at(2 * day), 1.7)], [("g", "p", at(2 * day + 40), 9.0)]], "game string, prop string, ts timestamp, price double")
    kick = spark.createDataFrame([("g", at(2 * day + 30)), ("h", at(2 * day + 30))], "game string, kickoff timestamp")
    got = feeds.collected(feeds.open_close(s, kick, "game", ["prop"], "ts", "price", "1 day"), f"{tmp_path}/out", f"{tmp_path}/cp", mode="complete").collect()
    assert sorted((r["game"], r["open"], r["close"], r["quotes"], r["in_play"]) for r in got) == [("g", 1.5, 1.7, 3, 1), ("h", 4.0, 4.0, 1, 0)]


def test_rejected_rows_go_aside(spark, tmp_path):
    s = stream_of(spark, str(tmp_path), [[(1, 5.0), (2, None)], [(3, -1.0)]], "k long, v double")
    feeds.split_sink(s, F.col("v") > 0, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/cp").awaitTermination()
    assert [r["k"] for r in spark.read.parquet(f"{tmp_path}/good").collect()] == [1]
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/bad").collect()) == [2, 3]


def test_live_probability_follows_the_points(spark, tmp_path):
    s = stream_of(spark, str(tmp_path), [[("a", at(0), 10.0)], [("b", at(10), 40.0)]], "entity string, ts timestamp, points double")
    line = spark.createDataFrame([(1, 0, "a", 0.0, 0.1, 3.0, 0.3, 1.0), (1, 1, "b", 0.0, 0.1, 3.0, 0.3, 1.0)], "matchup int, side int, entity string, proj double, f double, a double, b double, g double")
    sums = s.groupBy("entity").agg(F.sum("points").alias("points"))
    feeds.live_probability(sums, line, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    p = {r["batch"]: r["p_a"] for r in spark.read.parquet(f"{tmp_path}/out/probability").collect()}
    assert p[0] > 0.9 and p[1] < 0.1
