"""Streams whose state ends by timers on event time: prices at kickoff, statuses that expire, scores by matchup; and deduplication that counts what it drops."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(spark: SparkSession) -> None:
    """Timers and state variables need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def _instants(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Sets the watermark and carries the time on as microseconds (``at_us``).

    A column made from the time has no watermark of its own, so Spark does not
    drop late rows before the processor, which can tell and count them.
    """
    return rows.withWatermark(ts, late).withColumn("at_us", F.unix_micros(F.col(ts)))


def _up_to_ms(us: int) -> int:
    return -(-us // 1000)


class _OpenClose(StatefulProcessor):
    """State of many props of one kickoff, by their key: the first and last quote up to kickoff, and counts; all end with one timer."""

    def __init__(self, kind: str, keys: Sequence[str], columns: Sequence[str]):
        self.kind, self.keys, self.columns = kind, list(keys), list(columns)

    def init(self, handle) -> None:
        self.handle = handle
        names = ", ".join(f"k{i} array<string>" for i in range(len(self.keys)))
        self.held = handle.getValueState("props", f"{names}, open_us array<long>, open array<{self.kind}>, close_us array<long>, close array<{self.kind}>, quotes array<long>, in_play array<long>")

    def table(self, rows):
        return pd.DataFrame(rows, columns=self.columns, dtype=object)

    def handleInputRows(self, key, rows, timerValues):
        kick = key[0]
        parts = [zip(zip(*[df[c].tolist() for c in self.keys], strict=True), df["at_us"].tolist(), df["quote_"].tolist(), strict=True) for df in rows]
        if _up_to_ms(kick) <= timerValues.getCurrentWatermarkInMs():
            late: dict = {}
            for part in parts:
                for prop, us, _ in part:
                    late.setdefault(prop, [0, 0])[us > kick] += 1
            yield self.table([(*prop, kick, "after", None, None, None, None, 0, after, early) for prop, (early, after) in late.items()])
            return
        old = self.held.exists()
        n = len(self.keys)
        held = {}
        if old:
            state = list(self.held.get())
            held = dict(zip(zip(*state[:n], strict=True), map(list, zip(*state[n:], strict=True)), strict=True))
        for part in parts:
            for prop, us, quote in part:
                now = held.get(prop)
                if now is None:
                    now = held[prop] = [None, None, None, None, 0, 0]
                if us > kick:
                    now[5] += 1
                    continue
                now[4] += 1
                if now[0] is None or (us, quote) < (now[0], now[1]):
                    now[0], now[1] = us, quote
                if now[2] is None or (us, quote) > (now[2], now[3]):
                    now[2], now[3] = us, quote
        if not old:
            self.handle.registerTimer(_up_to_ms(kick))
        self.held.update((*map(list, zip(*held, strict=True)), *map(list, zip(*held.values(), strict=True))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, n = list(self.held.get()), len(self.keys)
        self.held.clear()
        yield self.table([(*x[:n], key[0], "close", *x[n:], 0) for x in zip(*state, strict=True)])

    def close(self) -> None:
        pass


def close_at_kickoff(quotes: DataFrame, kickoffs: DataFrame, key: str, by: Sequence[str], ts: str, value: str, late: str = "10 minutes", parts: int = 32) -> DataFrame:
    """One ``close`` row a prop as soon as the watermark passes its kickoff, in append mode; its state ends there.

    The row has the first and last quote at or before kickoff (``open_at``,
    ``open``, ``close_at``, ``close``; of quotes of one time the lesser opens and
    the greater closes), how many there were and how many came with a time after
    it (``in_play``); a prop with quotes in play alone has null prices. What
    arrives for a prop that is closed makes ``after`` rows, one a batch: ``late``
    counts quotes from before kickoff, which no longer change the prices, and
    ``in_play`` the others, so sums over a prop's rows count every quote once.
    Kickoffs are a static side; quotes without a kickoff, time or value are left
    out. State is one entry for each prop whose kickoff is still to come. Props
    of one kickoff are dealt into ``parts`` groups by a hash of their key, which
    are read, written and ended together: calls to the state store go by group
    and not by prop. Keys are of types that a string gives back.
    """
    timed(quotes.sparkSession)
    kinds, keys = dict(quotes.dtypes), [key, *by]
    j = _instants(quotes.where(F.col(value).isNotNull() & F.col(ts).isNotNull()), ts, late).join(kickoffs.where("kickoff IS NOT NULL"), key)
    j = j.select(*[F.col(c).cast("string").alias(c) for c in keys], F.unix_micros("kickoff").alias("kick_us"), F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("part_"), "at_us", F.col(value).alias("quote_"))
    schema = ", ".join([*(f"`{c}` string" for c in keys), f"kick_us long, event string, open_us long, open {kinds[value]}, close_us long, close {kinds[value]}, quotes long, in_play long, late long"])
    columns = [*keys, "kick_us", "event", "open_us", "open", "close_us", "close", "quotes", "in_play", "late"]
    out = j.groupBy("kick_us", "part_").transformWithStateInPandas(_OpenClose(kinds[value], keys, columns), schema, "append", "eventTime")
    at = lambda c: F.timestamp_micros(c)
    return out.select(*[F.col(c).cast(kinds[c]).alias(c) for c in keys], at("kick_us").alias("kickoff"), "event", at("open_us").alias("open_at"), "open", at("close_us").alias("close_at"), "close", "quotes", "in_play", "late")


class _Status(StatefulProcessor):
    """State of one key: its status, when that was seen, and (of one that is not final) the timer that ends it."""

    def __init__(self, hold_us: int, final: str, unknown: str, columns: Sequence[str]):
        self.hold, self.final, self.unknown, self.columns = hold_us, final, unknown, list(columns)

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("status", "status string, at long, due long")

    def handleInputRows(self, key, rows, timerValues):
        status, at, due = self.held.get() if self.held.exists() else (None, None, None)
        if status == self.final:
            return
        mark, before, out = timerValues.getCurrentWatermarkInMs(), due, []
        df = pd.concat(list(rows)).sort_values(["at_us", "status_"])
        done = df[df["status_"] == self.final]
        end = int(done["at_us"].iloc[0]) if len(done) else None
        for us, now in zip(df["at_us"].tolist(), df["status_"].tolist(), strict=True):
            if now == self.final or end is not None and us >= end:
                break
            if at is not None and us < at or _up_to_ms(us + self.hold) <= mark:
                continue
            if status is not None and us > at + self.hold:
                out.append((at + self.hold, self.unknown))
                status = None
            if now != status:
                out.append((us, now))
            status, at = now, us
        if end is not None:
            if status is not None and end > at + self.hold:
                out.append((at + self.hold, self.unknown))
            out.append((end, self.final))
            status, at = self.final, end
        if status is not None:
            due = None if status == self.final else _up_to_ms(at + self.hold)
            if before is not None and before != due:
                self.handle.deleteTimer(before)
            if due is not None and before != due:
                self.handle.registerTimer(due)
            self.held.update((status, at, due))
        if out:
            yield pd.DataFrame([(*key, *x) for x in out], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        status, at, due = self.held.get()
        if status != self.final and due == expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield pd.DataFrame([(*key, at + self.hold, self.unknown)], columns=self.columns)

    def close(self) -> None:
        pass


def expiring_status(rows: DataFrame, key: str, ts: str, status: str, hold_hours: float, final: str = "final", unknown: str = "UNKNOWN", late: str = "10 minutes") -> DataFrame:
    """The statuses of each key as they turn, in append mode: ``final`` is for ever, any other one ends ``hold_hours`` after it was last seen.

    A status that ends without a successor is followed by ``unknown`` at that
    time, and its key's state is dropped; so state is one row for each key seen
    lately and one for each that is final. A final that comes late is taken at
    its own time; whatever comes after it, or is older than the status held, or
    was already too old to say anything when it came, changes nothing. Of rows
    of one time the greater status stands. Rows without a key, time or status
    are left out.
    """
    timed(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    known = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(status).isNotNull())
    processor = _Status(round(hold_hours * 3_600_000_000), final, unknown, [key, "at_us", status])
    out = _instants(known, ts, late).select(key, "at_us", F.col(status).alias("status_")).groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, at_us long, `{status}` string", "append", "eventTime")
    return out.select(key, F.timestamp_micros("at_us").alias(ts), status)


class _Points(StatefulProcessor):
    """State of one matchup: the points of each of its starters."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def init(self, handle) -> None:
        self.points = handle.getMapState("points", "entity string", "points double")

    def handleInputRows(self, key, rows, timerValues):
        df = pd.concat(list(rows))
        for entity, more in df.groupby("entity")["points"].sum().items():
            held = self.points.getValue((entity,))[0] if self.points.containsKey((entity,)) else 0.0
            self.points.updateValue((entity,), (held + float(more),))
        yield pd.DataFrame([(*key, e[0], p[0]) for e, p in self.points.iterator()], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return iter([])

    def close(self) -> None:
        pass


def live_matchups(credits: DataFrame, lineups: DataFrame, path: str, checkpoint: str):
    """P(first side wins) of every matchup that a batch touches, one folder a batch; the last row of a matchup is what holds.

    ``credits`` is a stream of (entity, points) to be summed; ``lineups`` has
    matchup, side, entity, proj, f, a, b, g. State is one number for each starter
    who has scored, held by matchup: a batch reads and writes the matchups it
    touches and no other. A batch that is written again replaces itself. Credits
    without an entity or points, or of entities in no lineup, count nothing.
    """
    from panelyard.operators.probability import live_win_probability

    timed(credits.sparkSession)
    kind = dict(lineups.dtypes)["matchup"]
    places = lineups.select("matchup", F.col("entity").cast("string").alias("entity"))
    rows = credits.where("entity IS NOT NULL AND points IS NOT NULL").select(F.col("entity").cast("string").alias("entity"), F.col("points").cast("double").alias("points")).join(places, "entity")
    now = rows.groupBy("matchup").transformWithStateInPandas(_Points(["matchup", "entity", "now"]), f"matchup {kind}, entity string, now double", "append", "none")

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # the stream's state is read once
        sides = lineups.withColumn("entity", F.col("entity").cast("string")).join(batch.select("matchup").distinct(), "matchup", "left_semi")
        full = sides.join(batch, ["matchup", "entity"], "left").withColumn("now", F.coalesce("now", F.lit(0.0))).withColumn("at", F.lit(number))
        live_win_probability(full, "matchup", "side", "at").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return now.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(rows: DataFrame, ts: str, key: Sequence[str], late: str, path: str, checkpoint: str) -> DataFrame:
    """Writes each key once within the watermark to ``path``/rows, and returns what every batch held: ``batch``, ``n_in``, ``n_kept``, ``n_repeated``, ``n_late``.

    Spark's own deduplication runs on the JVM side with state that ends with the
    watermark; the counts are those that its state operator reports, so
    kept + repeated + late is the input of every batch. Late rows are those that
    the watermark of the batch before had passed. Counts are kept in
    ``path``/counts, a folder for each run; a run that fails keeps those of the
    batches it finished. Rows without a time count as input but are neither
    kept, repeated nor late.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    unique = rows.where(F.col(ts).isNotNull()).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))
    run = unique.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    finally:
        told = []
        for p in run.recentProgress:
            if p.numInputRows:
                late_rows = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
                repeated = sum(int(o.customMetrics.get("numDroppedDuplicateRows", 0)) for o in p.stateOperators)
                told.append((p.batchId, p.numInputRows, p.numInputRows - late_rows - repeated, repeated, late_rows))
        if told:
            spark.createDataFrame(told, "batch long, n_in long, n_kept long, n_repeated long, n_late long").write.mode("append").parquet(f"{path}/counts")
    return spark.read.schema("batch long, n_in long, n_kept long, n_repeated long, n_late long").parquet(f"{path}/counts")
