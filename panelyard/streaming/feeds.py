"""Streaming forms of the feeds: running scores, open and close, change events, staleness, deduplication, windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream of the Parquet files under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def running_points(credits: DataFrame, ts: str, entity: Sequence[str], points: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Points of each entity in tumbling windows of event time."""
    return credits.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *entity).agg(F.sum(points).alias("points"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *entity, "points", "n")


def usage_windows(rows: DataFrame, ts: str, by: Sequence[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling or sliding windows."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def sessions(rows: DataFrame, ts: str, by: Sequence[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of rows no further apart than the gap."""
    return rows.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def open_close(quotes: DataFrame, kickoffs: DataFrame, key: str, by: Sequence[str], ts: str, value: str, late: str = "10 minutes") -> DataFrame:
    """First and last quote at or before kickoff per prop and kickoff, whatever time its quotes span; later ones counted.

    Kickoffs are a static side. One small state is held for each prop and
    kickoff, so the output is for complete or update mode.
    """
    j = quotes.withWatermark(ts, late).join(kickoffs, key)
    early = F.when(F.col(ts) <= F.col("kickoff"), F.col(ts))
    return j.groupBy(*dict.fromkeys([key, "kickoff", *by])).agg(F.min_by(value, early).alias("open"), F.max_by(value, early).alias("close"), F.count(early).alias("quotes"), F.count_if(F.col(ts) > F.col("kickoff")).alias("in_play"))


def without_repeats(rows: DataFrame, ts: str, key: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))


def enriched(rows: DataFrame, crosswalk: DataFrame, key: str) -> DataFrame:
    """A stream joined to the static crosswalk; unresolved ids stay, with nulls."""
    return rows.join(crosswalk, key, "left")


def changes(rows: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """An event each time a key's state turns, with the state before; the last state of each key is kept.

    A row older than the last one seen of its key is told as well, with ``late``
    set and no state before: whether it would have been a turn cannot be said.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, at = held.get if held.exists else (None, pd.Timestamp.min)
        df = pd.concat(batches).sort_values([ts, state])
        late = df[ts] < pd.Timestamp(at)
        fresh = df[~late]
        was = fresh[state].shift().astype(object)
        if len(fresh):
            was.iloc[0] = last
        turned = fresh[was.notna() & (was != fresh[state])]
        out = [pd.DataFrame({key: k[0], ts: turned[ts], "was": was[turned.index], "now": turned[state], "late": False}), pd.DataFrame({key: k[0], ts: df.loc[late, ts], "was": None, "now": df.loc[late, state], "late": True})]
        if len(fresh):
            last, at = fresh[state].iloc[-1], fresh[ts].iloc[-1]
        held.update((last, pd.Timestamp(at).to_pydatetime()))
        yield from (part for part in out if len(part))

    def fresh_index(k, batches, held):
        return step(k, (b.reset_index(drop=True) for b in [pd.concat(batches)]), held)

    kind = dict(rows.dtypes)[key]
    return rows.select(key, ts, state).groupBy(key).applyInPandasWithState(fresh_index, f"{key} {kind}, {ts} timestamp, was string, now string, late boolean", "last string, at timestamp", "append", GroupStateTimeout.NoTimeout)


def final_status(rows: DataFrame, key: str, ts: str, status: str, final: str = "final") -> DataFrame:
    """The status of each key as it turns: ``final`` stays, a late or repeated other status never replaces it."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, at = held.get if held.exists else (None, pd.Timestamp.min)
        at, before = pd.Timestamp(at), last
        df = pd.concat(batches).sort_values([ts, status])
        if last != final:
            done = df[df[status] == final]
            fresh = done if len(done) else df[df[ts] >= at]
            if len(fresh):
                one = fresh.iloc[0 if len(done) else -1]
                last, at = one[status], max(one[ts], at)
        held.update((last, at.to_pydatetime()))
        yield pd.DataFrame([(k[0], at, last)] if last != before else [], columns=[key, ts, status])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, ts, status).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp, {status} string", "last string, at timestamp", "append", GroupStateTimeout.NoTimeout)


def split_sink(rows: DataFrame, valid, good_path: str, bad_path: str, checkpoint: str):
    """Writes accepted and rejected rows of every batch to two places; a batch written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where(F.coalesce(valid, F.lit(False))).write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        batch.where(~F.coalesce(valid, F.lit(False))).write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into Parquet, and reads it back."""
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def live_probability(points: DataFrame, lineups: DataFrame, path: str, checkpoint: str):
    """Running points joined to static lineups: after every batch, P(first side wins) of each matchup, replaced as a whole.

    ``points`` is an update-mode stream of (entity, points); ``lineups`` has
    matchup, side, entity, proj, f, a, b, g. The latest points of each entity
    are kept beside the output and merged with every batch.
    """
    from panelyard.operators.probability import live_win_probability

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state, last = f"{path}/points/batch={number}", f"{path}/points/batch={number - 1}"
        now = batch.groupBy("entity").agg(F.max("points").alias("points"))
        if number:
            old = spark.read.schema(now.schema).parquet(last)
            now = old.join(now.select("entity"), "entity", "left_anti").unionByName(now)
        now.write.mode("overwrite").parquet(state)
        rows = lineups.join(spark.read.parquet(state), "entity", "left").withColumn("now", F.coalesce("points", F.lit(0.0))).withColumn("at", F.lit(number))
        live_win_probability(rows, "matchup", "side", "at").write.mode("overwrite").parquet(f"{path}/probability/batch={number}")

    return points.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stale_alerts(pulls: DataFrame, source: str, ts: str, limit_hours: float, late: str = "10 minutes") -> DataFrame:
    """A STALE event for each source when event time passes its limit without a refresh, and FRESH when it comes back."""
    wait = int(limit_hours * 3_600_000)

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if held.hasTimedOut:
            last, _ = held.get
            out.append((k[0], pd.Timestamp(last) + pd.Timedelta(milliseconds=wait), "STALE"))
            held.update((last, True))
        else:
            last, stale = held.get if held.exists else (None, False)
            times, gap = pd.concat(batches)[ts].drop_duplicates().sort_values(), pd.Timedelta(milliseconds=wait)
            last = last and pd.Timestamp(last)
            times = times[times > last] if last is not None else times
            before = times.shift()
            if len(times):
                before.iloc[0] = last if last is not None else times.iloc[0]
                wide = times - before > gap
                told = wide.copy()
                told.iloc[0] = wide.iloc[0] and not stale  # its STALE has gone out already
                back = wide.copy()
                back.iloc[0] = wide.iloc[0] or stale
                out = [(k[0], at, "STALE") for at in before[told] + gap] + [(k[0], at, "FRESH") for at in times[back]]
                last, stale = times.iloc[-1], False
            held.update((last.to_pydatetime(), stale))
            due = int(last.timestamp() * 1000) + wait
            if due > held.getCurrentWatermarkMs():
                held.setTimeoutTimestamp(due)
        yield pd.DataFrame(out, columns=[source, "at", "event"])

    kind = dict(pulls.dtypes)[source]
    return pulls.withWatermark(ts, late).select(source, ts).groupBy(source).applyInPandasWithState(step, f"{source} {kind}, at timestamp, event string", "last timestamp, stale boolean", "append", GroupStateTimeout.EventTimeTimeout)
