"""Streaming queries: each runs over all events there are, from the same files as a stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from panelyard.plans.model_queries import cdf_sql
from panelyard.plans.registry import Tables, instants, query
from panelyard.streaming import feeds, timers


def source(t: Tables):
    path = f"{t.sf_dir}/events.parquet/*.parquet" if _is_folder(t) else f"{t.sf_dir}/events*.parquet"
    return instants(feeds.events(t.spark, path, t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema))


def _is_folder(t: Tables) -> bool:
    path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{t.sf_dir}/events.parquet")
    return path.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def place(t: Tables) -> tuple[str, str]:
    """New output and checkpoint folders beside the session's checkpoints; in local mode, where none are set, in a temporary folder."""
    root = t.spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not t.spark.sparkContext.master.startswith("local[") and t.spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="panelyard-")
    name = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    return f"{name}/out", f"{name}/check"


@query("s1_running_points", "SELECT make_timestamp(epoch_us(ts) // 300000000 * 300000000) AS window_start, user_id, sum(event_id)::BIGINT AS points, count(*) AS n FROM events GROUP BY ALL")
def s1(t: Tables):
    return feeds.collected(feeds.running_points(source(t).select("ts", "user_id", "event_id"), "ts", ["user_id"], "event_id"), *place(t), mode="complete")


@query("s7_without_repeats", "SELECT DISTINCT event_id FROM events")
def s7(t: Tables):
    return feeds.collected(feeds.without_repeats(source(t).select("ts", "event_id"), "ts", ["event_id"], "40 days").select("event_id"), *place(t))


@query("s8_sliding_windows", "SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n FROM (SELECT event_type, date_trunc('hour', ts) - INTERVAL (k) HOUR AS window_start FROM events, (VALUES (0), (1)) v(k)) GROUP BY ALL")
def s8(t: Tables):
    return feeds.collected(feeds.usage_windows(source(t).select("ts", "event_type"), "ts", ["event_type"], "2 hours", "1 hour"), *place(t), mode="complete")


@query("s8_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events), r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM r GROUP BY user_id, run""")
def s8b(t: Tables):
    return feeds.collected(feeds.sessions(source(t).select("ts", "user_id"), "ts", ["user_id"], "6 hours"), *place(t), mode="complete")


@query("s9_enriched", "SELECT event_id, s_nationkey FROM events LEFT JOIN supplier ON user_id = s_suppkey")
def s9(t: Tables):
    people = t.supplier.select(F.col("s_suppkey").alias("user_id"), "s_nationkey")
    return feeds.collected(feeds.enriched(source(t).select("event_id", "user_id"), people, "user_id").select("event_id", "s_nationkey"), *place(t))


@query("s5_change_events", "SELECT user_id, ts, was, event_type AS now FROM (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS was FROM events) WHERE was IS NOT NULL AND was <> event_type")
def s5(t: Tables):
    return feeds.collected(feeds.changes(source(t), "user_id", "ts", "event_type"), *place(t)).where("NOT late").drop("late")


KICKOFF = "TIMESTAMP '2024-01-10 00:00:00' + to_days((user_id % 10)::INT)"


@query("s3_open_close", f"SELECT user_id, event_type, kickoff, min_by(value, ts) FILTER (WHERE ts <= kickoff) AS open, max_by(value, ts) FILTER (WHERE ts <= kickoff) AS close, count(*) FILTER (WHERE ts <= kickoff) AS quotes, count(*) FILTER (WHERE ts > kickoff) AS in_play FROM (SELECT *, {KICKOFF} AS kickoff FROM events) GROUP BY ALL")
def s3(t: Tables):
    start = F.unix_timestamp(F.lit("2024-01-10 00:00:00"))
    kick = t.events.select("user_id").distinct().select("user_id", F.timestamp_seconds(start + (F.col("user_id") % 10) * 86400).alias("kickoff"))
    return feeds.collected(feeds.open_close(source(t).select("user_id", "event_type", "ts", "value"), kick, "user_id", ["event_type"], "ts", "value", "40 days"), *place(t), mode="complete")


@query("s4_final_status", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' ELSE max_by(event_type, (ts, event_type)) END AS status FROM events GROUP BY user_id")
def s4(t: Tables):
    turns = feeds.collected(feeds.final_status(source(t), "user_id", "ts", "event_type", "purchase"), *place(t))
    return turns.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", F.col("event_type") == "purchase")).alias("status"))


@query("s6_fresh_again", "SELECT user_id, ts AS at_time FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM (SELECT DISTINCT user_id, ts FROM events)) WHERE ts - before > INTERVAL 6 HOUR")
def s6(t: Tables):
    alerts = feeds.collected(feeds.stale_alerts(source(t).select("user_id", "ts"), "user_id", "ts", 6.0, "40 days"), *place(t))
    return alerts.where("event = 'FRESH'").select("user_id", F.col("at").alias("at_time"))


@query("s10_split_sink", "SELECT value > 20 AS accepted, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL")
def s10(t: Tables):
    out, check = place(t)
    feeds.split_sink(source(t).select("event_id", "value"), F.col("value") > 20, f"{out}/good", f"{out}/bad", check).awaitTermination()
    both = [t.spark.read.parquet(f"{out}/{k}").withColumn("accepted", F.lit(ok)) for k, ok in (("good", True), ("bad", False))]
    return both[0].unionByName(both[1]).groupBy("accepted").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("s2_live_probability", f"""
WITH p AS (SELECT user_id // 2 AS matchup, user_id % 2 AS side, count(*)::DOUBLE AS now FROM events GROUP BY ALL), w AS (SELECT a.matchup, (a.now - b.now) / (sqrt(2.0::DOUBLE) * sqrt(0.5::DOUBLE) * 9) AS z FROM p a JOIN p b ON a.matchup = b.matchup AND a.side = 0 AND b.side = 1)
SELECT matchup, round({cdf_sql("z")}, 7) AS p_a FROM w""")
def s2(t: Tables):
    out, check = place(t)
    points = source(t).groupBy(F.col("user_id").alias("entity")).agg(F.count(F.lit(1)).cast("double").alias("points"))
    line = t.events.select("user_id").distinct().select(F.floor(F.col("user_id") / 2).alias("matchup"), (F.col("user_id") % 2).alias("side"), F.col("user_id").alias("entity"), *[F.lit(v).alias(k) for k, v in (("proj", 20.0), ("f", 0.5), ("a", 3.0), ("b", 0.3), ("g", 1.0))])
    feeds.live_probability(points, line, out, check).awaitTermination()
    done = t.spark.read.parquet(f"{out}/probability")
    return done.where(F.col("batch") == done.agg(F.max("batch")).first()[0]).select("matchup", F.round("p_a", 7).alias("p_a"))


def arrivals(t: Tables, batch, *more) -> tuple:
    """The events (and ``more`` frames like them) as a stream of files that come one after the other by ``batch``, a column; with its output and checkpoint folders.

    Files are written batch by batch, as a feed would leave them, and read in
    order of their times.
    """
    out, check = place(t)
    rows = instants(t.spark.read.parquet(f"{t.sf_dir}/events.parquet"))
    for frame in more:
        rows = rows.unionByName(frame(rows))
    path = out.removesuffix("/out") + "/in"
    rows.withColumn("batch", batch).repartition("batch").write.partitionBy("batch").parquet(out.removesuffix("/out") + "/dealt")
    dealt = t.spark.read.parquet(out.removesuffix("/out") + "/dealt")
    for (b,) in sorted(dealt.select("batch").distinct().collect()):  # one for each of a fixed few batches
        dealt.where(F.col("batch") == b).drop("batch").coalesce(1).write.mode("append").parquet(path)
    return feeds.events(t.spark, path, rows.schema), out, check


#: Five days a batch; every eleventh event comes two batches later.
ARRIVE = "floor((date_part('day', ts) - 1) / 5)"
DELAYED = f"{ARRIVE} + CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END"
#: Batches of events and the marks of a watermark of two hours, in milliseconds.
MARKS = """
e AS (SELECT *, ({batch})::INT AS b FROM {rows}),
g AS (SELECT b, max(epoch_ms(ts)) AS top FROM e GROUP BY b),
w AS (SELECT g.b, coalesce(max(h.top) - 7200000, 0) AS mark FROM g LEFT JOIN g h ON h.b < g.b GROUP BY g.b),
z AS (SELECT max(top) - 7200000 AS last FROM g)"""


@query("s3_close_at_kickoff", f"""
WITH {MARKS.format(batch=DELAYED, rows="events")},
k AS (SELECT *, TIMESTAMP '2024-01-10 00:00:00' + to_days((user_id % 20)::INT) AS kickoff FROM e JOIN w USING (b)),
p AS (SELECT *, epoch_ms(kickoff) <= mark AS closed, ts <= kickoff AS early FROM k)
SELECT user_id, event_type, kickoff, min_by(value, (ts, value)) FILTER (WHERE early AND NOT closed) AS open, max_by(value, (ts, value)) FILTER (WHERE early AND NOT closed) AS close,
  count(*) FILTER (WHERE early AND NOT closed) AS quotes, count(*) FILTER (WHERE NOT early) AS in_play, count(*) FILTER (WHERE early AND closed) AS late
FROM p, z WHERE epoch_ms(kickoff) <= last GROUP BY ALL HAVING count(*) FILTER (WHERE NOT closed) > 0""")
def s3_timers(t: Tables):
    stream, out, check = arrivals(t, F.expr(DELAYED).cast("int"))
    start = F.unix_timestamp(F.lit("2024-01-10 00:00:00"))
    kick = t.events.select("user_id").distinct().select("user_id", F.timestamp_seconds(start + (F.col("user_id") % 20) * 86400).alias("kickoff"))
    rows = feeds.collected(timers.close_at_kickoff(stream, kick, "user_id", ["event_type"], "ts", "value", "2 hours"), out, check)
    sums = [F.sum(c).alias(c) for c in ("quotes", "in_play", "late")]
    return rows.groupBy("user_id", "event_type", "kickoff").agg(F.max("open").alias("open"), F.max("close").alias("close"), *sums, F.max(F.col("event") == "close").alias("closed")).where("closed").drop("closed")


@query("s4_expiring_status", f"""
WITH {MARKS.format(batch=ARRIVE, rows="events")},
f AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'purchase') AS done FROM e GROUP BY user_id),
o AS (SELECT user_id, ts, event_type AS status, done FROM e JOIN f USING (user_id) WHERE done IS NULL OR ts < done),
n AS (SELECT *, lag(status) OVER u AS was, lag(ts) OVER u AS before, coalesce(lead(ts) OVER u, done) AS next FROM o WINDOW u AS (PARTITION BY user_id ORDER BY ts, status))
SELECT user_id, ts, status FROM n WHERE was IS NULL OR was <> status OR ts > before + INTERVAL 12 HOUR
UNION ALL SELECT user_id, ts + INTERVAL 12 HOUR, 'UNKNOWN' FROM n, z WHERE next > ts + INTERVAL 12 HOUR OR next IS NULL AND epoch_us(ts) + 43200000000 <= last * 1000
UNION ALL SELECT user_id, done, 'purchase' FROM f WHERE done IS NOT NULL""")
def s4_timers(t: Tables):
    stream, out, check = arrivals(t, F.expr(ARRIVE).cast("int"))
    return feeds.collected(timers.expiring_status(stream, "user_id", "ts", "event_type", 12.0, "purchase", late="2 hours"), out, check).select("user_id", "ts", F.col("event_type").alias("status"))


AGAIN = "SELECT * FROM events UNION ALL SELECT event_id, ts, user_id, 'again', value, props FROM events WHERE event_id % 5 = 0"
TWICE = f"{DELAYED} + CASE WHEN event_type = 'again' AND event_id % 10 = 0 THEN 1 ELSE 0 END"


@query("s7_late_counted", f"""
WITH {MARKS.format(batch=TWICE, rows=f"({AGAIN})")},
l AS (SELECT b, lag(mark, 1, 0) OVER (ORDER BY b) AS mark FROM w),
r AS (SELECT e.*, epoch_us(ts) <= mark * 1000 AS late FROM e JOIN l USING (b)),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id, late ORDER BY b) AS n FROM r)
SELECT b::BIGINT AS batch, count(*) AS n_in, count(*) FILTER (WHERE NOT late AND n = 1) AS n_kept, count(*) FILTER (WHERE NOT late AND n > 1) AS n_repeated, count(*) FILTER (WHERE late) AS n_late FROM k GROUP BY b""")
def s7_counted(t: Tables):
    stream, out, check = arrivals(t, F.expr(TWICE).cast("int"), lambda e: e.where("event_id % 5 = 0").withColumn("event_type", F.lit("again")))
    return timers.deduplicated(stream.select("event_id", "ts"), "ts", ["event_id"], "2 hours", out, check)


@query("s2_live_matchups", f"""
WITH e AS (SELECT *, ({ARRIVE})::INT AS b FROM events), t AS (SELECT DISTINCT b, user_id // 2 AS matchup FROM e),
p AS (SELECT t.b, t.matchup, count(*) FILTER (WHERE user_id % 2 = 0)::DOUBLE AS a_now, count(*) FILTER (WHERE user_id % 2 = 1)::DOUBLE AS b_now FROM t JOIN e ON e.user_id // 2 = t.matchup AND e.b <= t.b GROUP BY ALL),
w AS (SELECT *, (a_now - b_now) / (sqrt(2.0::DOUBLE) * sqrt(0.5::DOUBLE) * 9) AS z FROM p WHERE matchup IN (SELECT user_id // 2 FROM events GROUP BY 1 HAVING count(DISTINCT user_id) = 2))
SELECT b AS batch, matchup, round({cdf_sql("z")}, 7) AS p_a FROM w""")
def s2_matchups(t: Tables):
    stream, out, check = arrivals(t, F.expr(ARRIVE).cast("int"))
    credits = stream.select(F.col("user_id").alias("entity"), F.lit(1.0).alias("points"))
    line = t.events.select("user_id").distinct().select(F.floor(F.col("user_id") / 2).alias("matchup"), (F.col("user_id") % 2).alias("side"), F.col("user_id").alias("entity"), *[F.lit(v).alias(k) for k, v in (("proj", 20.0), ("f", 0.5), ("a", 3.0), ("b", 0.3), ("g", 1.0))])
    timers.live_matchups(credits, line, out, check).awaitTermination()
    return t.spark.read.parquet(out).select("batch", "matchup", F.round("p_a", 7).alias("p_a"))
