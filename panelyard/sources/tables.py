"""Reading, flattening and writing panel sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Spellings of a missing value.
MISSING = ["", "NA", "N/A", "NaN", "nan", "None", "NULL", "null", "<NA>"]


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV with a header, every spelling of missing read as null."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.csv(path, header=True)
    by_name = {c.strip().lower(): c for c in raw.columns}
    cols = []
    for f in kind:
        at = by_name.get(f.name.lower())
        value = F.trim(F.col(f"`{at}`")) if at else F.lit(None)
        cols.append(F.when(~value.isin(*MISSING), value).try_cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def import_with_reasons(raw: DataFrame, required: Sequence[str], numeric: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that can be used, and counts of the others by reason."""
    checks = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"{c} is missing")) for c in required]
    checks += [F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), F.lit(f"{c} is not a number")) for c in numeric]
    judged = raw.withColumn("__why", F.coalesce(*checks, F.lit(None)) if checks else F.lit(None))
    return judged.where("__why IS NULL").drop("__why"), judged.where("__why IS NOT NULL").groupBy(F.col("__why").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named columns are read."""
    return spark.read.parquet(path).select(*columns)


def read_documents(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = True) -> DataFrame:
    """Nested JSON documents of a declared shape, one a file or one a line, with the file each came from."""
    return spark.read.schema(schema).json(path, multiLine=multi_line).withColumn("source_file", F.col("_metadata.file_name"))


def load_events(spark: SparkSession, path: str, seasons: Sequence[int], columns: Sequence[str], season: str = "season") -> DataFrame:
    """Regular rows of the seasons asked for; the season filter and the columns reach the scan."""
    rows = spark.read.parquet(path).where(F.col(season).isin(*seasons))
    return regular_rows(rows).select(*columns)


def regular_rows(df: DataFrame) -> DataFrame:
    """Rows of the regular season by ``season_type``, else by ``game_type``, else all."""
    known = [F.col(c) for c in ("season_type", "game_type") if c in df.columns]
    return df.where(F.coalesce(*known, F.lit("REG")) == "REG")


def normalize_codes(df: DataFrame, columns: Sequence[str], aliases: Mapping[str, str]) -> DataFrame:
    """Old codes replaced in every named column that is there."""
    return df.replace(dict(aliases), subset=[c for c in columns if c in df.columns])


def unpivot_games(games: DataFrame, home: str, away: str, margin: str, keep: Sequence[str]) -> DataFrame:
    """A row for each side of a game: own code, opponent, home flag and the margin as that side sees it."""
    side = lambda a, b, h: F.struct(F.col(a).alias("side"), F.col(b).alias("opponent"), F.lit(h).alias("is_home"), (F.col(margin) if h else -F.col(margin)).alias("margin"))
    return games.select(*keep, F.inline(F.array(side(home, away, 1), side(away, home, 0))))


def scoring_gaps(spark: SparkSession, columns: Sequence[str], terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each rule term that the schema does not fully support: absent or partial, and what is missing."""
    rows = []
    for term, parts in terms.items():
        if gone := [c for c in parts if c not in columns]:
            rows.append((term, "absent" if len(gone) == len(parts) else "partial", gone))
    return spark.createDataFrame(rows, "term string, gap string, missing array<string>")


def flatten_prop_payload(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with bookmakers, markets and outcomes as one row an outcome, and counts of unusable ones by reason."""
    books = payloads.select(F.col("id").alias("event_id"), "home_team", "away_team", F.explode_outer("bookmakers").alias("b"))
    markets = books.select("event_id", "home_team", "away_team", F.col("b.key").alias("book"), F.explode_outer("b.markets").alias("m"))
    rows = markets.select("event_id", "home_team", "away_team", "book", F.col("m.key").alias("market"), F.explode_outer("m.outcomes").alias("o")).select("event_id", "home_team", "away_team", "book", "market", F.col("o.description").alias("player"), F.initcap("o.name").alias("side"), F.col("o.point").alias("point"), F.col("o.price").alias("price"))
    why = F.when(F.col("book").isNull(), "no bookmaker").when(F.col("market").isNull(), "no market").when(F.coalesce("player", F.lit("")) == "", "no player").when(~F.coalesce("side", F.lit("")).isin("Over", "Under", "Yes", "No"), "unknown side").when(F.col("price").isNull() | (F.abs("price") < 100), "unreadable price")
    judged = rows.withColumn("reason", why)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def flatten_price_history(histories: DataFrame, key: Sequence[str]) -> DataFrame:
    """Maps of books, markets, outcomes and players to one row a quote."""
    d = histories.select(*key, F.explode("bookmakers").alias("book", "b"))
    d = d.select(*key, "book", F.explode("b.markets").alias("market", "m"))
    d = d.select(*key, "book", "market", F.explode("m.outcomes").alias("outcome", "o"))
    d = d.select(*key, "book", "market", "outcome", F.explode("o.players").alias("player", "entries"))
    return d.select(*key, "book", "market", "outcome", "player", F.inline("entries"))


def flatten_rosters(snapshots: DataFrame) -> DataFrame:
    """A row for each player a roster holds; ``slot`` counts starters from 0 and is null on the bench."""
    r = snapshots.select("league_id", "week", F.explode("rosters").alias("r"))
    p = r.select("league_id", "week", F.col("r.roster_id").alias("roster_id"), F.col("r.starters").alias("starters"), F.explode("r.players").alias("player_id"))
    at = F.array_position("starters", F.col("player_id"))
    return p.select("league_id", "week", "roster_id", "player_id", F.when(at > 0, at - 1).alias("slot"))


def flatten_transactions(documents: DataFrame) -> DataFrame:
    """A row for each add and drop of a completed transaction."""
    t = documents.where("status = 'complete'")
    one = lambda c, k: t.where(F.col(c).isNotNull()).select("type", F.timestamp_millis("created").alias("at"), F.explode(c).alias("player_id", "roster_id"), F.lit(k).alias("action"), F.col("settings.waiver_bid").alias("bid"))
    return one("adds", "add").unionByName(one("drops", "drop"))


def flatten_series(df: DataFrame, key: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Parallel arrays as rows."""
    return df.select(*key, F.inline(F.arrays_zip(*arrays)))


def flatten_charts(df: DataFrame, kickoffs: DataFrame | None = None) -> DataFrame:
    """Depth charts of either layout as (season, week, team, position, gsis_id, rank).

    The weekly layout is renamed; the dated one takes, for each team and week,
    the last chart before that week's kickoff.
    """
    if "week" in df.columns:
        return df.select("season", "week", "team", F.col("depth_position").alias("position"), "gsis_id", F.col("depth_team").cast("int").alias("rank"))
    dates = df.select("team", "dt").distinct()
    last = kickoffs.join(dates, "team").where("dt < kickoff").groupBy("season", "week", "team").agg(F.max("dt").alias("dt"))
    return df.join(last, ["team", "dt"]).select("season", "week", "team", F.col("pos_abb").alias("position"), "gsis_id", F.col("pos_rank").cast("int").alias("rank"))


def append_snapshot(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Adds rows to a dated table with a digest of each row's content."""
    df.withColumn("digest", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)).write.mode("append").partitionBy(*partitions).parquet(path)


def upsert(base: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``fresh`` in place of those of the same key; other rows are kept."""
    return base.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def record_files(df: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """Documents with the stamp their file name carries, for ordering."""
    return df.withColumn("stamp", F.regexp_extract("source_file", pattern, group))


def run_manifest(sources: Mapping[str, DataFrame], as_of: Column, period: str) -> DataFrame:
    """A row a source: rows, periods covered and the time of the pull."""
    parts = [df.agg(F.lit(name).alias("source"), as_of.alias("as_of"), F.count(F.lit(1)).alias("n"), F.min(period).alias("first_period"), F.max(period).alias("last_period"), F.array_sort(F.collect_set(period)).alias("periods")) for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ambiguous_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of keys that occur once, and the keys that repeat with their counts."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return df.join(n.where("n = 1").select(*keys), list(keys), "left_semi"), n.where("n > 1")


def by_system(df: DataFrame, keys: Sequence[str], system: str, value: str, systems: Sequence[str]) -> DataFrame:
    """One row a key and one column a system; absent stays null."""
    return df.groupBy(*keys).pivot(system, list(systems)).agg(F.max(value))


def game_calendar(games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regular games with a kickoff instant, and the count of those without a readable time."""
    from panelyard.functions.scalars import local_to_utc

    timed = regular_rows(games).withColumn("kickoff", local_to_utc(F.col("gameday"), F.col("gametime")))
    return timed.where("kickoff IS NOT NULL"), timed.where("kickoff IS NULL").groupBy("season", "week").agg(F.count(F.lit(1)).alias("untimed"))


def ranking_as_of(rankings: DataFrame, event: Column, days: int, limits: Mapping[str, int]) -> DataFrame:
    """The latest scrape within ``days`` before the event: unique ids, at most so many of each category."""
    near = rankings.where((F.col("scraped") < event) & (F.col("scraped") >= event - F.expr(f"INTERVAL {days} DAYS")))
    last = near.join(near.agg(F.max("scraped").alias("scraped")), "scraped", "left_semi")  # one row
    one = last.withColumn("__k", F.row_number().over(Window.partitionBy("id").orderBy("rank"))).where("__k = 1").drop("__k")
    most = F.coalesce(*[F.when(F.col("category") == c, F.lit(n)) for c, n in limits.items()], F.lit(0))
    return one.withColumn("cat_rank", F.row_number().over(Window.partitionBy("category").orderBy("rank", "id"))).where(F.col("cat_rank") <= most)
