from test_streaming import at, stream_of

from panelyard.streaming import feeds, timers

QUOTES = "game string, prop string, ts timestamp, price double"


def run(spark, stream, path):
    got = feeds.collected(stream, f"{path}/out", f"{path}/cp")
    return got


def state_rows(stream, path):
    """Rows of state after every batch."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return [p.stateOperators[0].numRowsTotal for p in q.recentProgress]


def test_close_comes_when_the_watermark_passes_kickoff(spark, tmp_path):
    batches = [
        [("g", "p", at(0), 1.5), ("g", "q", at(5), 3.0), ("h", "p", at(0), 4.0)],
        [("g", "p", at(20), 1.7), ("g", "p", at(20), 1.6), ("g", "p", at(40), 9.0), ("x", "p", at(1), 1.0)],
        [("g", "p", at(90), 8.0)],  # the watermark of the next batch is at 80: g closed, h open
        [("g", "p", at(25), 5.0), ("g", "p", at(95), 7.0), ("h", "p", at(30), 4.5)],
        [("h", "p", at(300), 6.0)],
    ]
    s = stream_of(spark, str(tmp_path), batches, QUOTES)
    kick = spark.createDataFrame([("g", at(30)), ("h", at(200)), ("n", None)], "game string, kickoff timestamp")
    stream = timers.close_at_kickoff(s, kick, "game", ["prop"], "ts", "price")
    sizes = state_rows(stream, tmp_path)
    rows = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()
    closed = {(r["game"], r["prop"]): r for r in rows if r["event"] == "close"}
    assert len(closed) == 3 == sum(r["event"] == "close" for r in rows)
    p, q, h = closed["g", "p"], closed["g", "q"], closed["h", "p"]
    assert (p["open"], p["close"], p["open_at"], p["close_at"], p["quotes"]) == (1.5, 1.7, at(0), at(20), 3)
    assert (q["open"], q["close"], q["quotes"], q["in_play"]) == (3.0, 3.0, 1, 0)
    assert (h["open"], h["close"], h["quotes"]) == (4.0, 4.5, 2)
    g = [r for r in rows if r["game"] == "g" and r["prop"] == "p"]
    assert sum(r["quotes"] + r["in_play"] + r["late"] for r in g) == 7 and sum(r["late"] for r in g) == 1
    assert sizes[-1] == 0 and max(sizes) > 0  # state ends with the kickoffs


def test_close_is_the_same_after_a_restart(spark, tmp_path):
    import os

    batches = [[("g", "p", at(0), 1.5)], [("g", "p", at(20), 1.7)], [("h", "p", at(500), 2.0)]]
    s = stream_of(spark, str(tmp_path / "a"), batches, QUOTES)
    kick = spark.createDataFrame([("g", at(30)), ("h", at(600))], "game string, kickoff timestamp")
    whole = timers.close_at_kickoff(s, kick, "game", ["prop"], "ts", "price")
    want = run(spark, whole, tmp_path / "a").collect()
    held = [f"{tmp_path}/a/in/{k:03}.parquet" for k in (1, 2)]
    s = stream_of(spark, str(tmp_path / "b"), batches[:1], QUOTES)
    parted = timers.close_at_kickoff(s, kick, "game", ["prop"], "ts", "price")
    run(spark, parted, tmp_path / "b")
    for k, path in enumerate(held, 1):  # the stream starts anew for each file
        os.rename(path, f"{tmp_path}/b/in/{k:03}.parquet")
        got = run(spark, timers.close_at_kickoff(feeds.events(spark, f"{tmp_path}/b/in", s.schema), kick, "game", ["prop"], "ts", "price"), tmp_path / "b")
    assert got.collect() == want and [(r["open"], r["close"]) for r in want] == [(1.5, 1.7)]


STATUS = "game string, ts timestamp, status string"


def test_final_is_for_ever_and_others_expire(spark, tmp_path):
    batches = [
        [("g", at(0), "pre"), ("h", at(0), "pre"), ("k", at(0), "pre")],
        [("g", at(100), "live"), ("h", at(10), "pre"), ("g", at(100), "delayed")],
        [("g", at(200), "final"), ("k", at(150), "live")],
        [("g", at(210), "live"), ("z", at(600), "pre")],  # the watermark of the next batch is at 590
        [("k", at(140), "final"), ("h", at(30), "live"), ("z", at(601), "pre")],  # late: a final counts, a status too old does not
        [("k", at(900), "live"), ("g", at(901), "pre")],
    ]
    s = stream_of(spark, str(tmp_path), batches, STATUS)
    stream = timers.expiring_status(s, "game", "ts", "status", 2.0)
    sizes = state_rows(stream, tmp_path)
    rows = sorted((r["game"], r["ts"], r["status"]) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect())
    assert [r[1:] for r in rows if r[0] == "g"] == [(at(0), "pre"), (at(100), "delayed"), (at(100), "live"), (at(200), "final")]
    assert [r[1:] for r in rows if r[0] == "h"] == [(at(0), "pre"), (at(130), "UNKNOWN")]
    assert [r[1:] for r in rows if r[0] == "k"] == [(at(0), "pre"), (at(120), "UNKNOWN"), (at(140), "final"), (at(150), "live")]
    assert [r[1:] for r in rows if r[0] == "z"] == [(at(600), "pre"), (at(721), "UNKNOWN")]
    assert sizes[-1] < max(sizes)


def test_status_is_the_same_in_one_batch_or_many(spark, tmp_path):
    rows = [("g", at(m), "live" if m % 7 else "pre") for m in range(0, 900, 55)] + [("h", at(m), "live") for m in (0, 30, 400)] + [("h", at(500), "final"), ("h", at(520), "live")]
    rows.sort(key=lambda r: r[1])
    got = []
    for n, batches in enumerate([[rows], [rows[k : k + 4] for k in range(0, len(rows), 4)]]):
        s = stream_of(spark, str(tmp_path / str(n)), batches, STATUS)
        got.append(sorted(map(tuple, run(spark, timers.expiring_status(s, "game", "ts", "status", 1.0), tmp_path / str(n)).collect())))
    assert got[0] == got[1] and ("h", at(90), "UNKNOWN") in got[0] and ("h", at(500), "final") == got[0][-1]


def test_kept_repeated_and_late_make_the_input(spark, tmp_path):
    batches = [[(1, at(0)), (1, at(0)), (2, at(5))], [(2, at(5)), (3, at(60))], [(4, at(70)), (9, at(1))], [(5, at(80)), (4, at(70)), (8, at(2)), (7, at(30))]]
    s = stream_of(spark, str(tmp_path), batches, "k long, ts timestamp")
    counts = timers.deduplicated(s, "ts", ["k"], "10 minutes", f"{tmp_path}/out", f"{tmp_path}/cp").orderBy("batch").collect()
    assert [r["n_in"] for r in counts] == [3, 2, 2, 4]
    assert all(r["n_in"] == r["n_kept"] + r["n_repeated"] + r["n_late"] for r in counts)
    kept = sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/out/rows").collect())
    assert len(kept) == sum(r["n_kept"] for r in counts) == len(set(kept))
    # the mark for lateness is that of the batch before: 1 comes while none has passed, 2 and 30 after 50 has
    assert [r["n_late"] for r in counts] == [0, 0, 0, 2] and [r["n_repeated"] for r in counts] == [1, 1, 0, 1] and kept == [1, 2, 3, 4, 5, 9]


def test_a_batch_writes_only_the_matchups_it_touches(spark, tmp_path):
    s = stream_of(spark, str(tmp_path), [[("a", 10.0), ("c", 1.0)], [("b", 40.0), (None, 3.0), ("zz", 1.0)], [("a", 100.0), ("a", 5.0)]], "entity string, points double")
    line = spark.createDataFrame([(m, side, e, 0.0, 0.1, 3.0, 0.3, 1.0) for m, side, e in ((1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "d"))], "matchup int, side int, entity string, proj double, f double, a double, b double, g double")
    timers.live_matchups(s, line, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    p = {(r["batch"], r["matchup"]): r["p_a"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(p) == {(0, 1), (0, 2), (1, 1), (2, 1)}
    assert p[0, 1] > 0.9 and p[1, 1] < 0.1 and p[2, 1] > 0.9 and p[0, 2] > 0.5
