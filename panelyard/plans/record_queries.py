"""Queries over records: nested payloads, snapshots, quotes, identities and decisions derived from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyard.functions import scalars as S
from panelyard.operators import allocation as L
from panelyard.operators import blocks as B
from panelyard.operators import changes as C
from panelyard.operators import context as X
from panelyard.operators import features as H
from panelyard.operators import fitting as M
from panelyard.operators import identity as I
from panelyard.operators import market as K
from panelyard.operators import panels as P
from panelyard.operators import quality as Q
from panelyard.operators import reports as R
from panelyard.operators import scored as D
from panelyard.plans.registry import Tables, query
from panelyard.plans.stream_queries import place
from panelyard.sources import tables as A

# ---------------------------------------------------------------- sources

#: Order lines as quotes of a book (supplier) on a player (part): the price is American, the point a half.
QUOTES = """quotes AS (SELECT l_orderkey AS event_id, (l_suppkey % 7)::INT AS book, (l_linenumber % 2)::INT AS market, l_partkey AS player, CASE WHEN l_returnflag = 'R' THEN 'under' ELSE 'over' END AS side, floor(l_quantity) + 0.5 AS point,
  CASE WHEN l_linestatus = 'O' THEN 100 ELSE -100 END * (0.9 + l_discount * 10) AS price, l_shipdate AS seen, o_orderdate + INTERVAL 60 DAY AS kickoff FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def quotes(t: Tables):
    c = F.col
    l = P.spread(t.lineitem, "l_orderkey").join(t.orders.select(c("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return l.select(c("l_orderkey").alias("event_id"), (c("l_suppkey") % 7).cast("int").alias("book"), (c("l_linenumber") % 2).cast("int").alias("market"), c("l_partkey").alias("player"), F.when(c("l_returnflag") == "R", "under").otherwise("over").alias("side"), (F.floor("l_quantity") + 0.5).cast("double").alias("point"), (F.when(c("l_linestatus") == "O", 100).otherwise(-100) * (0.9 + c("l_discount") * 10)).alias("price"), c("l_shipdate").alias("seen"), (c("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("kickoff"))


@query("a1_read_csv", "SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_size END AS size, p_type FROM part")
def a1(t: Tables):
    """Parts written as CSV with the spellings of missing, and read back."""
    out, _ = place(t)
    spelled = F.get(F.array(*[F.lit(x) for x in ("NA", "", "nan", "null")]), (F.col("p_partkey") % 4).cast("int"))
    t.part.select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_size").cast("string")).otherwise(spelled).alias("SIZE"), F.col("p_type").alias(" p_type ")).write.option("header", True).csv(out)
    return A.read_csv(t.spark, out, "p_partkey long, size int, p_type string")


@query("a3_read_documents", "SELECT c_custkey AS entity, c_mktsegment AS segment, [c_nationkey, c_nationkey + 1] AS codes FROM customer")
def a3(t: Tables):
    """Customers written as nested documents, and read back by a declared shape."""
    out, _ = place(t)
    t.customer.select(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")).alias("who"), F.array("c_nationkey", F.col("c_nationkey") + 1).alias("codes")).write.json(out)
    d = A.read_documents(t.spark, out, "who struct<id: long, segment: string>, codes array<int>, absent string", multi_line=False)
    return d.select(F.col("who.id").alias("entity"), F.col("who.segment").alias("segment"), "codes")


@query("a14_dated_snapshots", "SELECT year(o_orderdate)::INT AS season, count(*) AS n, count(DISTINCT o_orderkey) AS digests FROM orders GROUP BY 1")
def a14(t: Tables):
    """Orders appended to a dated table one status after another, each row with a digest of its content."""
    out, _ = place(t)
    o = t.orders.select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("season"))
    for state in ("F", "O", "P"):
        A.append_snapshot(o.where(F.col("o_orderstatus") == state), out, ["season"])
    return t.spark.read.parquet(out).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("digest").alias("digests"))


@query("a4_load_events", "SELECT o_orderkey, o_custkey, year(o_orderdate)::INT AS season FROM orders WHERE year(o_orderdate) IN (1995, 1997) AND o_orderstatus <> 'P'")
def a4(t: Tables):
    path = f"{t.sf_dir}/orders.parquet"
    rows = t.spark.read.parquet(path).select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("season"), F.when(F.col("o_orderstatus") == "P", "PRE").otherwise("REG").alias("season_type"))
    return A.regular_rows(rows).where(F.col("season").isin(1995, 1997)).drop("season_type")


@query("a5_regular_rows", "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW'")
def a5(t: Tables):
    return A.regular_rows(t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "POST").otherwise("REG").alias("game_type"))).select("o_orderkey")


@query("a6_normalized_codes", "SELECT code, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'OPEN' ELSE o_orderstatus END AS code FROM orders) GROUP BY ALL")
def a6(t: Tables):
    return A.normalize_codes(t.orders.select(F.col("o_orderstatus").alias("code")), ["code", "absent"], {"F": "DONE", "O": "OPEN"}).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("a8_scoring_gaps", "SELECT * FROM (VALUES ('bonus', 'absent', ['bonus']), ('price', 'partial', ['rebate'])) v(term, gap, missing) WHERE (SELECT count(*) FROM lineitem) > 0")
def a8(t: Tables):
    gaps = A.scoring_gaps(t.spark, t.lineitem.columns, {"qty": ["l_quantity"], "price": ["l_extendedprice", "rebate"], "bonus": ["bonus"]})
    return gaps.join(F.broadcast(t.lineitem.agg(F.count(F.lit(1)).alias("n"))).where("n > 0").drop("n"))  # one row


PROP_SQL = f"""
WITH {QUOTES}, j AS (SELECT event_id, book, market, player, side, point, price, CASE WHEN price IS NULL OR abs(price) < 100 THEN 'unreadable price' END AS reason FROM quotes)"""


def payload(t: Tables):
    q = quotes(t)
    out = q.groupBy("event_id", "book", "market").agg(F.collect_list(F.struct(F.col("player").cast("string").alias("description"), F.col("side").alias("name"), "point", "price")).alias("outcomes"))
    mk = out.groupBy("event_id", "book").agg(F.collect_list(F.struct(F.col("market").alias("key"), "outcomes")).alias("markets"))
    return mk.groupBy(F.col("event_id").alias("id")).agg(F.collect_list(F.struct(F.col("book").alias("key"), "markets")).alias("bookmakers")).withColumn("home_team", F.lit("h")).withColumn("away_team", F.lit("a"))


@query("a9_prop_payload", PROP_SQL + " SELECT event_id, book, market, player::VARCHAR AS player, CASE side WHEN 'over' THEN 'Over' ELSE 'Under' END AS side, count(*) AS n, round(sum(price), 4) AS prices FROM j WHERE reason IS NULL GROUP BY ALL")
def a9(t: Tables):
    rows, _ = A.flatten_prop_payload(payload(t))
    return rows.groupBy("event_id", "book", "market", "player", "side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("prices"))


@query("g16_counts_by_reason", PROP_SQL + " SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY ALL")
def g16(t: Tables):
    return A.flatten_prop_payload(payload(t))[1]


def history(t: Tables):
    q = quotes(t)
    e = q.groupBy("event_id", "kickoff", "book", "market", "side", "player").agg(F.collect_list(F.struct(F.col("seen").alias("createdAt"), "price", "point")).alias("entries"))
    m = lambda df, by, key, value: df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), value))).alias("m"))
    o = m(e, ["event_id", "kickoff", "book", "market", "side"], "player", F.col("entries"))
    o = m(o, ["event_id", "kickoff", "book", "market"], "side", F.struct(F.col("m").alias("players")))
    o = m(o, ["event_id", "kickoff", "book"], "market", F.struct(F.col("m").alias("outcomes")))
    return m(o, ["event_id", "kickoff"], "book", F.struct(F.col("m").alias("markets"))).withColumnRenamed("m", "bookmakers")


@query("a10_price_history", f"WITH {QUOTES} SELECT event_id, book::VARCHAR AS book, market::VARCHAR AS market, side AS outcome, player::VARCHAR AS player, count(*) AS n, min(seen) AS first_at, round(sum(price), 4) AS prices FROM quotes GROUP BY ALL")
def a10(t: Tables):
    return A.flatten_price_history(history(t), ["event_id"]).groupBy("event_id", "book", "market", "outcome", "player").agg(F.count(F.lit(1)).alias("n"), F.min("createdAt").alias("first_at"), F.round(F.sum("price"), 4).alias("prices"))


OPEN_CLOSE_SQL = f"""
WITH {QUOTES}, g AS (SELECT book, market, player, kickoff, seen, min(price) AS price FROM quotes GROUP BY ALL)
SELECT book, market, player, kickoff, min_by(price, seen) FILTER (WHERE seen <= kickoff) AS open, max_by(price, seen) FILTER (WHERE seen <= kickoff) AS close, count(*) FILTER (WHERE seen > kickoff) AS in_play FROM g GROUP BY ALL"""


@query("k7_open_close", OPEN_CLOSE_SQL)
def k7(t: Tables):
    q = quotes(t).groupBy("book", "market", "player", "kickoff", "seen").agg(F.min("price").alias("price"))
    early = F.col("seen") <= F.col("kickoff")
    return q.groupBy("book", "market", "player", "kickoff").agg(F.min_by(F.when(early, F.col("price")), F.when(early, F.col("seen"))).alias("open"), F.max_by(F.when(early, F.col("price")), F.when(early, F.col("seen"))).alias("close"), F.count_if(~early).alias("in_play"))


@query("a22_long_quotes", f"""
WITH {QUOTES}, g AS (SELECT event_id, book, market, player, kickoff, seen, min(price) AS price FROM quotes GROUP BY ALL)
SELECT book, market, count(*) AS props, count(DISTINCT event_id) AS games, round(sum(first), 4) AS opens FROM (SELECT event_id, book, market, player, min_by(price, seen) AS first FROM g WHERE seen <= kickoff GROUP BY ALL) GROUP BY ALL""")
def a22(t: Tables):
    """One long table over all games from their reduced quotes, with the games counted."""
    rows = A.flatten_price_history(history(t), ["event_id", "kickoff"]).groupBy("event_id", "kickoff", "book", "market", "player", F.col("createdAt").alias("seen")).agg(F.min("price").alias("price"))
    long = rows.where("seen <= kickoff").groupBy("event_id", F.col("book").cast("int").alias("book"), F.col("market").cast("int").alias("market"), "player").agg(F.min_by("price", "seen").alias("first"))
    return long.groupBy("book", "market").agg(F.count(F.lit(1)).alias("props"), F.countDistinct("event_id").alias("games"), F.round(F.sum("first"), 4).alias("opens"))


def snapshot(t: Tables):
    """Orders as rosters: the parts of an order, those of its first two lines started."""
    l = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("players"), F.array_sort(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_partkey")))).alias("starters"))
    return t.orders.join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("league_id"), F.month("o_orderdate").alias("week")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("roster_id"), "players", "starters")).alias("rosters"))


@query("a11_rosters", """
SELECT o_custkey AS league_id, month(o_orderdate)::INT AS week, roster_id, player_id, CASE WHEN started THEN (count(*) FILTER (WHERE started) OVER (PARTITION BY roster_id ORDER BY player_id) - 1)::INT END AS slot
FROM (SELECT l_orderkey AS roster_id, l_partkey AS player_id, min(l_linenumber) <= 2 AS started FROM lineitem GROUP BY ALL) JOIN orders ON o_orderkey = roster_id""")
def a11(t: Tables):
    return A.flatten_rosters(snapshot(t)).withColumn("slot", F.col("slot").cast("int"))


@query("a12_hourly_series", "SELECT user_id, date_trunc('hour', ts) AS time, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def a12(t: Tables):
    h = t.events.groupBy("user_id", F.date_trunc("hour", "ts").alias("time")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    part = lambda c: F.transform("x", lambda s: s[c]).alias(c)
    wide = h.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("time", "n", "total"))).alias("x")).select("user_id", *[part(c) for c in ("time", "n", "total")])
    return A.flatten_series(wide, ["user_id"], ["time", "n", "total"])


@query("a13_depth_charts", """
WITH d AS (SELECT o_custkey AS team, o_orderdate AS dt, min(o_orderkey) AS gsis_id, count(*)::INT AS rank FROM orders GROUP BY ALL), k AS (SELECT DISTINCT o_custkey AS team, year(o_orderdate)::INT AS season, make_timestamp(year(o_orderdate), 7, 1, 0, 0, 0) AS kickoff FROM orders)
SELECT season, 1 AS week, team, 'X' AS position, gsis_id, rank FROM (SELECT k.season, k.team, max(d.dt) AS dt FROM k JOIN d ON d.team = k.team AND d.dt < k.kickoff GROUP BY ALL) JOIN d USING (team, dt)""")
def a13(t: Tables):
    d = t.orders.groupBy(F.col("o_custkey").alias("team"), F.col("o_orderdate").alias("dt")).agg(F.min("o_orderkey").alias("gsis_id"), F.count(F.lit(1)).alias("pos_rank")).withColumn("pos_abb", F.lit("X"))
    k = t.orders.select(F.col("o_custkey").alias("team"), F.year("o_orderdate").alias("season"), F.lit(1).alias("week")).distinct().withColumn("kickoff", F.make_date(F.col("season"), F.lit(7), F.lit(1)).cast("timestamp"))
    return A.flatten_charts(d, k)


@query("a23_game_calendar", """
SELECT season, count(*) FILTER (WHERE timed) AS games, count(*) FILTER (WHERE NOT timed) AS untimed, min(ko) FILTER (WHERE timed) AS first_kickoff FROM (
  SELECT year(o_orderdate)::INT AS season, o_orderpriority <> '5-LOW' AS timed, (o_orderdate + INTERVAL 13 HOUR) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS ko FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL""")
def a23(t: Tables):
    g = t.orders.select(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), F.when(F.col("o_orderstatus") == "P", "PRE").otherwise("REG").alias("game_type"), F.to_date("o_orderdate").alias("gameday"), F.when(F.col("o_orderpriority") != "5-LOW", "13:00").alias("gametime"))
    timed, untimed = A.game_calendar(g)
    a = timed.groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.min("kickoff").alias("first_kickoff"))
    return a.join(untimed.groupBy("season").agg(F.sum("untimed").alias("untimed")), "season")


@query("a24_ranking_as_of", """
WITH r AS (SELECT p_partkey AS id, p_brand AS category, p_size AS rank FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rank, id) AS cat_rank FROM r)
SELECT id, category, rank, cat_rank FROM k WHERE cat_rank <= CASE category WHEN 'Brand#1' THEN 20 WHEN 'Brand#2' THEN 5 ELSE 0 END""")
def a24(t: Tables):
    at = lambda days: F.to_timestamp(F.lit("2024-01-15")) - F.expr(f"INTERVAL {days} DAYS")
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.col("p_size").alias("rank"))
    scrapes = p.withColumn("scraped", at(2)).unionByName(p.withColumn("rank", F.col("rank") + 1).withColumn("scraped", at(9))).unionByName(p.withColumn("rank", -F.col("rank")).withColumn("scraped", at(-1)))
    return A.ranking_as_of(scrapes, F.to_timestamp(F.lit("2024-01-15")), 5, {"Brand#1": 20, "Brand#2": 5}).select("id", "category", "rank", "cat_rank")


@query("a25_import_reasons", "SELECT CASE WHEN k IS NULL THEN 'item is missing' ELSE 'amount is not a number' END AS reason, count(*) AS n FROM (SELECT CASE WHEN p_size > 5 THEN p_name END AS k, CASE WHEN p_size > 20 THEN p_type ELSE p_size::VARCHAR END AS v FROM part) WHERE k IS NULL OR try_cast(v AS DOUBLE) IS NULL GROUP BY ALL")
def a25(t: Tables):
    raw = t.part.select(F.when(F.col("p_size") > 5, F.col("p_name")).alias("item"), F.when(F.col("p_size") > 20, F.col("p_type")).otherwise(F.col("p_size").cast("string")).alias("amount"))
    return A.import_with_reasons(raw, ["item"], ["amount"])[1]


@query("a26_rederived", "SELECT p_partkey, p_name, s_suppkey AS entity FROM part JOIN (SELECT p_name, min(k) AS s_suppkey FROM (SELECT p_name, p_size AS k FROM part WHERE p_type = 'ECONOMY') GROUP BY p_name HAVING count(DISTINCT k) = 1) USING (p_name)")
def a26(t: Tables):
    known = t.part.where("p_type = 'ECONOMY'").select("p_name", F.col("p_size").alias("entity"))
    return B.rederived(t.part.select("p_partkey", "p_name"), known, "p_name", "entity")


@query("a17_file_stamps", "SELECT '1' AS stamp, count(*) AS n FROM nation")
def a17(t: Tables):
    named = t.nation.withColumn("source_file", F.lit("scan-1.json"))
    return A.record_files(named, r"-(\d+)\.json").groupBy("stamp").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- joins and identities


@query("j10_latest_before", "SELECT o.o_orderkey, (SELECT max(p.o_orderdate) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate) AS before FROM orders o")
def j10(t: Tables):
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("team"), F.col("o_orderdate").alias("at"))
    return P.asof_join(o, o.select("team", "at").distinct().withColumn("before", F.col("at")), ["team"], "at", ["before"]).select("o_orderkey", "before")


@query("j17_resolution", "SELECT status, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM events) AS share FROM (SELECT CASE WHEN event_type = 'error' THEN 'blank' WHEN s_suppkey IS NULL THEN 'unresolved' ELSE 'mapped' END AS status FROM events LEFT JOIN supplier ON user_id = s_suppkey) GROUP BY ALL")
def j17(t: Tables):
    rows = t.events.select(F.when(F.col("event_type") != "error", F.col("user_id")).alias("key"))
    return I.resolution_report(rows, t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("target")), "key", "target")


@query("j19_candidates", """
WITH nm AS (SELECT DISTINCT p_name AS name, (p_partkey % 25)::INT AS team, p_type AS market FROM part), r AS (SELECT s_suppkey AS player_id, s_nationkey AS team, (s_suppkey % 3)::INT AS pos FROM supplier), ok AS (SELECT *, length(market) % 2 AS a FROM nm)
SELECT name, team, player_id FROM (SELECT o.name, o.team, r.player_id, count(DISTINCT o.market) AS fit FROM ok o JOIN r USING (team) WHERE r.pos = o.a OR r.pos = 2 GROUP BY ALL) JOIN (SELECT name, team, count(DISTINCT market) AS n FROM nm GROUP BY ALL) USING (name, team) WHERE fit = n""")
def j19(t: Tables):
    names = t.part.select(F.col("p_name").alias("name"), (F.col("p_partkey") % 25).cast("int").alias("team"), F.col("p_type").alias("market")).distinct().withColumn("allowed_positions", F.array((F.length("market") % 2), F.lit(2)))
    rosters = t.supplier.select(F.col("s_suppkey").alias("player_id"), F.col("s_nationkey").alias("team"), (F.col("s_suppkey") % 3).cast("int").alias("position"))
    return X.candidates(names, rosters)


@query("j20_match_pairs", """
WITH g AS (SELECT o_orderdate AS day, least(o_custkey % 9, o_orderkey % 9) AS a, greatest(o_custkey % 9, o_orderkey % 9) AS b, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n = 1 THEN k END AS game_id FROM lineitem LEFT JOIN g ON g.day = l_shipdate AND a = least(l_partkey % 9, l_suppkey % 9) AND b = greatest(l_partkey % 9, l_suppkey % 9)""")
def j20(t: Tables):
    games = t.orders.select(F.col("o_orderdate").alias("day"), (F.col("o_custkey") % 9).alias("a"), (F.col("o_orderkey") % 9).alias("b"), F.col("o_orderkey").alias("game_id"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("day"), (F.col("l_suppkey") % 9).alias("a"), (F.col("l_partkey") % 9).alias("b"))
    return I.match_pairs(rows, games, "day", "a", "b", "game_id").select("l_orderkey", "l_linenumber", "l_partkey", "game_id")


@query("j21_ownership", "SELECT p_partkey, CASE WHEN o IS NULL THEN 'FREE' WHEN o = 3 THEN 'MINE' ELSE 'ROSTERED' END AS ownership FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey % 12) AS o FROM lineitem WHERE l_quantity > 48 GROUP BY ALL) ON l_partkey = p_partkey")
def j21(t: Tables):
    held = t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_suppkey") % 12).alias("owner"))
    return I.ownership(t.part.select("p_partkey"), held, "p_partkey", "owner", 3)


GRADE_SQL = f"""
WITH {QUOTES}, ln AS (SELECT event_id, book, market, player, min(point) AS point, min(1 / (1 + abs(price) / 100)) AS p_over FROM quotes GROUP BY ALL), oc AS (SELECT l_partkey AS player, round(avg(l_quantity), 3) AS actual FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
j AS (SELECT *, CASE WHEN actual <> point THEN (actual > point)::INT END AS hit, least(greatest(p_over, 1e-6), 1 - 1e-6) AS p FROM ln LEFT JOIN oc USING (player))
SELECT market, book, count(actual) AS settled, count(*) FILTER (WHERE actual IS NULL) AS void, round(avg(abs(actual - point)), 6) AS mae, round(avg(point - actual), 6) AS bias, round(avg((p - hit) ** 2), 6) AS brier, round(avg(-(hit * ln(p) + (1 - hit) * ln(1 - p))), 6) AS log_loss FROM j GROUP BY ALL"""


@query("j22_settled_quotes", GRADE_SQL)
def j22(t: Tables):
    lines = quotes(t).groupBy("event_id", "book", "market", "player").agg(F.min("point").alias("point"), F.min(1 / (1 + F.abs("price") / 100)).alias("p_over"))
    outcomes = t.lineitem.where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("player")).agg(F.round(F.avg("l_quantity"), 3).alias("actual"))
    g = K.book_grades(lines, outcomes, ["player"])
    return g.select("market", "book", "settled", "void", *[F.round(c, 6).alias(c) for c in ("mae", "bias", "brier", "log_loss")])


@query("j23_one_to_one", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def j23(t: Tables):
    return I.one_to_one(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("p_partkey")), t.part.select("p_partkey", "p_brand"), "p_partkey").drop("p_partkey")


# ---------------------------------------------------------------- aggregates and functions


@query("g2_per_game_rates", "SELECT entity, season, period, (sum(qty) OVER w)::DOUBLE / count(*) OVER w AS rate FROM facts WINDOW w AS (PARTITION BY entity, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def g2(t: Tables):
    return P.as_of_sums(t.facts, ["entity", "season"], "period", ["qty"]).select("entity", "season", "period", S.safe_ratio(F.col("qty_std"), F.col("games")).alias("rate"))


@query("g9_season_sums", "SELECT entity, season, sum(qty)::BIGINT AS qty, sum(pts)::BIGINT AS pts FROM facts GROUP BY ALL")
def g9(t: Tables):
    return t.facts.groupBy("entity", "season").agg(F.sum("qty").alias("qty"), F.sum("pts").alias("pts"))


@query("g10_distinct_counts", "SELECT cat, count(DISTINCT t) AS periods, count(DISTINCT entity) AS entities FROM facts GROUP BY ALL")
def g10(t: Tables):
    return t.facts.groupBy("cat").agg(F.countDistinct("t").alias("periods"), F.countDistinct("entity").alias("entities"))


@query("f3_counts_in_text", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS te FROM part")
def f3(t: Tables):
    text = F.concat(F.lit("1 RB, "), F.when(F.col("p_size") % 3 != 0, F.concat(F.col("p_size").cast("string"), F.lit(" TE"))).otherwise("3 WR"))
    return t.part.select("p_partkey", S.count_in_text(text, "TE").alias("te"))


@query("f4_split_lists", "SELECT p_partkey, unnest(list_filter(list_transform(string_split(p_name || ' ; ' || p_type || ';', ';'), lambda x: trim(x)), lambda x: x <> '')) AS member FROM part")
def f4(t: Tables):
    return t.part.select("p_partkey", F.explode(S.split_list(F.concat("p_name", F.lit(" ; "), "p_type", F.lit(";")))).alias("member"))


@query("f5_tokens", "SELECT o_custkey AS entity, month(o_orderdate)::INT AS period, o_orderstatus AS opponent, round(o_totalprice / 1000, 1) AS points FROM orders")
def f5(t: Tables):
    token = F.concat_ws(":", F.month("o_orderdate").cast("string"), "o_orderstatus", F.round(F.col("o_totalprice") / 1000, 1).cast("string"))
    lists = t.orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(token), "  ").alias("x"))
    return lists.select(F.col("o_custkey").alias("entity"), F.inline(S.parse_tokens(F.col("x"))))


@query("f6_safe_ratio", "SELECT entity, t, CASE WHEN returns > 0 THEN lines::DOUBLE / returns END AS ratio FROM facts")
def f6(t: Tables):
    return t.facts.select("entity", "t", S.safe_ratio(F.col("lines"), F.col("returns")).alias("ratio"))


@query("f12_over_league", "SELECT entity, t, (qty - lines * 25.5::DOUBLE) / (lines + 4) AS over FROM facts")
def f12(t: Tables):
    return t.facts.select("entity", "t", S.over_league(F.col("qty"), F.col("lines"), F.lit(25.5), 4).alias("over"))


@query("f17_season_of", "SELECT o_orderkey, (year(o_orderdate) - (month(o_orderdate) < 3)::INT)::INT AS season FROM orders")
def f17(t: Tables):
    return t.orders.select("o_orderkey", S.season_of(F.col("o_orderdate")).alias("season"))


@query("f18_ages", "SELECT event_id, round((epoch_us(TIMESTAMP '2024-02-15 12:00:00') - epoch_us(ts)) / 3.6e9, 6) AS hours, CASE WHEN dayofweek((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') IN (0, 1, 4) THEN 6 ELSE 24 END AS age_limit FROM events")
def f18(t: Tables):
    return t.events.select("event_id", F.round(S.age_hours(F.col("ts"), F.to_timestamp(F.lit("2024-02-15 12:00:00"))), 6).alias("hours"), S.age_limit(F.col("ts"), F.lit(24), F.lit(6)).alias("age_limit"))


@query("f19_clock", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber >= 5 THEN 3600 + greatest(600 - l_quantity * 20, 0) ELSE greatest(3600 - l_quantity * 60, 0) END AS elapsed FROM lineitem")
def f19(t: Tables):
    left = F.when(F.col("l_linenumber") >= 5, F.col("l_quantity") * 20).otherwise(F.col("l_quantity") * 60)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.clock_elapsed(F.col("l_linenumber"), left).alias("elapsed"))


@query("f20_ages_at", "SELECT o_orderkey, date_diff('day', DATE '1970-06-15', o_orderdate::DATE) / 365.25 AS age FROM orders")
def f20(t: Tables):
    return t.orders.select("o_orderkey", S.age_years(F.to_date(F.lit("1970-06-15")), F.col("o_orderdate")).alias("age"))


@query("f21_distance_buckets", "SELECT (floor(least(l_quantity * 2, 60) / 5) * 5)::INT AS bucket, count(*) AS n FROM lineitem GROUP BY ALL")
def f21(t: Tables):
    return t.lineitem.groupBy(S.distance_bucket(F.col("l_quantity") * 2).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("f26_json_fields", "SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events")
def f26(t: Tables):
    return t.events.select("event_id", S.json_field(F.col("props"), "$.k").alias("k"))


# ---------------------------------------------------------------- scored tables

#: Facts as a stat line: passing, rushing, receiving and kicking from the measures.
LINE = """st AS (SELECT entity, grp AS team, cat, CASE cat WHEN 'BUILDING' THEN 'K' ELSE 'WR' END AS position, season, period AS week, t, qty AS passing_yards, (lines % 4)::BIGINT AS passing_tds, returns AS passing_interceptions, (qty // 2)::BIGINT AS rushing_yards, (lines % 3)::BIGINT AS rushing_tds, lines AS receptions, (qty // 3)::BIGINT AS receiving_yards,
  (lines % 2)::BIGINT AS fg_made_40_49, returns AS fg_missed, lines AS pat_made FROM facts)"""
OFFENSE_SQL = "(0.04::DOUBLE * passing_yards + 4 * passing_tds - passing_interceptions + 0.1::DOUBLE * rushing_yards + 6 * rushing_tds + 0.5::DOUBLE * receptions + 0.1::DOUBLE * receiving_yards)"
KICK_SQL = "(4 * fg_made_40_49 + pat_made - fg_missed)::DOUBLE"


def stat_lines(t: Tables):
    c = F.col
    return t.facts.select("entity", c("grp").alias("team"), "cat", F.when(c("cat") == "BUILDING", "K").otherwise("WR").alias("position"), "season", c("period").alias("week"), "t", c("qty").alias("passing_yards"), (c("lines") % 4).alias("passing_tds"), c("returns").alias("passing_interceptions"), F.floor(c("qty") / 2).alias("rushing_yards"), (c("lines") % 3).alias("rushing_tds"), c("lines").alias("receptions"), F.floor(c("qty") / 3).alias("receiving_yards"), (c("lines") % 2).alias("fg_made_40_49"), c("returns").alias("fg_missed"), c("lines").alias("pat_made"))


def facts_sql(body: str) -> str:
    """``st`` defined after ``facts``."""
    return f"WITH {LINE} {body}" if not body.lstrip().startswith(",") else f"WITH {LINE}{body}"


@query("d2_kicker_points", facts_sql(f"SELECT entity, t, {KICK_SQL} AS points FROM st"))
def d2(t: Tables):
    s = stat_lines(t)
    return s.select("entity", "t", D.weighted_score(s.columns, D.KICKING).alias("points"))


@query("d3_defense_points", """
WITH s AS (SELECT entity, t, (lines % 3)::BIGINT AS sacks, (returns % 2)::BIGINT AS interceptions, CASE WHEN qty % 10 <> 0 THEN (qty % 45)::BIGINT END AS allowed FROM facts)
SELECT entity, t, CASE WHEN allowed IS NOT NULL THEN sacks + 2 * interceptions + CASE WHEN allowed <= 0 THEN 10 WHEN allowed <= 6 THEN 7 WHEN allowed <= 13 THEN 4 WHEN allowed <= 20 THEN 1 WHEN allowed <= 27 THEN 0 WHEN allowed <= 34 THEN -1 ELSE -4 END END::DOUBLE AS points FROM s""")
def d3(t: Tables):
    s = t.facts.select("entity", "t", (F.col("lines") % 3).alias("sacks"), (F.col("returns") % 2).alias("interceptions"), F.when(F.col("qty") % 10 != 0, F.col("qty") % 45).alias("allowed"))
    return s.select("entity", "t", D.defense_score(s.columns, F.col("allowed")).alias("points"))


@query("d4_routed_points", facts_sql(f"SELECT entity, t, round(CASE WHEN position = 'K' THEN {KICK_SQL} ELSE {OFFENSE_SQL} END, 6) AS points FROM st"))
def d4(t: Tables):
    s = stat_lines(t)
    return s.select("entity", "t", F.round(D.routed_score(s.columns), 6).alias("points"))


@query("d5_player_weeks", facts_sql(f"""
SELECT entity, season, week, round(CASE WHEN position = 'K' THEN {KICK_SQL} ELSE {OFFENSE_SQL} END, 6) AS points, CASE WHEN targets IS NULL AND carries IS NULL THEN NULL ELSE coalesce(targets, 0)::DOUBLE + coalesce(carries, 0) END AS opportunities, snaps FROM (SELECT *, CASE WHEN receptions % 2 = 0 THEN receptions END AS targets, CASE WHEN rushing_tds > 0 THEN rushing_yards END AS carries FROM st)
LEFT JOIN (SELECT o_custkey AS entity, year(o_orderdate)::INT AS season, month(o_orderdate)::INT AS week, max(o_orderkey % 70) AS snaps FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL) USING (entity, season, week)"""))
def d5(t: Tables):
    w = stat_lines(t).withColumnRenamed("entity", "player_id").withColumn("targets", F.when(F.col("receptions") % 2 == 0, F.col("receptions"))).withColumn("carries", F.when(F.col("rushing_tds") > 0, F.col("rushing_yards")))
    snaps = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), (F.col("o_orderkey") % 70).alias("offense_snaps"), F.lit(0.5).alias("offense_pct"))
    return D.player_weeks(w, snaps).select(F.col("player_id").alias("entity"), "season", "week", F.round("points", 6).alias("points"), F.col("opportunities").cast("double").alias("opportunities"), F.col("offense_snaps").alias("snaps"))


@query("d6_expected_share", facts_sql(f", x AS (SELECT entity, team, t, {OFFENSE_SQL} AS p FROM st) SELECT entity, t, round(p, 6) AS expected_points, round(CASE WHEN sum(p) OVER w > 0 THEN p / sum(p) OVER w END, 8) AS expected_share FROM x WINDOW w AS (PARTITION BY team, t)"))
def d6(t: Tables):
    got = B.expected_share(stat_lines(t).withColumnRenamed("passing_yards", "pass_yards_exp"), {"pass_yards_exp": "passing_yards"}, "team", ["t"])
    return got.select("entity", "t", F.round("expected_points", 6).alias("expected_points"), F.round("expected_share", 8).alias("expected_share"))


@query("d7_component_points", facts_sql("SELECT entity, t, round(0.04::DOUBLE * passing_yards + 4 * passing_tds - passing_interceptions, 6) AS pass_points, round(0.1::DOUBLE * rushing_yards + 6 * rushing_tds, 6) AS rush_points, round(0.5::DOUBLE * receptions + 0.1::DOUBLE * receiving_yards, 6) AS receive_points FROM st"))
def d7(t: Tables):
    s = stat_lines(t)
    return s.select("entity", "t", *[F.round(c, 6).alias(k) for k, c in B.component_points(s.columns).items()])


@query("d8_defense_history", """
WITH g AS (SELECT season, period AS week, grp AS team, sum(lines)::BIGINT % 5 AS sacks, sum(returns)::BIGINT % 4 AS interceptions, sum(qty)::BIGINT % 40 AS score FROM facts GROUP BY ALL), o AS (SELECT season, week, (team + 1) % 25 AS team, score AS allowed FROM g WHERE team % 2 = 0 UNION ALL SELECT season, week, team - 1, score FROM g WHERE team % 2 = 1)
SELECT season, week, team, (sacks + 2 * interceptions + CASE WHEN allowed <= 0 THEN 10 WHEN allowed <= 6 THEN 7 WHEN allowed <= 13 THEN 4 WHEN allowed <= 20 THEN 1 WHEN allowed <= 27 THEN 0 WHEN allowed <= 34 THEN -1 WHEN allowed > 34 THEN -4 END)::DOUBLE AS points
FROM g LEFT JOIN (SELECT a.season, a.week, a.team, h.score AS allowed FROM g a JOIN g h USING (season, week) WHERE (a.team % 2 = 0 AND h.team = a.team + 1) OR (a.team % 2 = 1 AND h.team = a.team - 1)) USING (season, week, team)""")
def d8(t: Tables):
    g = t.facts.groupBy("season", F.col("period").alias("week"), F.col("grp").alias("team")).agg((F.sum("lines") % 5).alias("sacks"), (F.sum("returns") % 4).alias("interceptions"), (F.sum("qty") % 40).alias("score"))
    home = g.where("team % 2 = 0").select("season", "week", F.col("team").alias("home_team"), (F.col("team") + 1).alias("away_team"), F.col("score").alias("home_score"))
    games = home.join(g.select("season", "week", F.col("team").alias("away_team"), F.col("score").alias("away_score")), ["season", "week", "away_team"])
    return X.defense_history(g, games).select("season", "week", "team", "points")


@query("d9_volume_history", "SELECT grp AS team, t, sum(qty + lines + returns)::BIGINT AS plays, sum(qty + returns)::DOUBLE / sum(qty + lines + returns) AS pass_rate, sum(cents)::DOUBLE / sum(qty + lines + returns) AS epa_per_play FROM facts GROUP BY ALL")
def d9(t: Tables):
    g = t.facts.groupBy(F.col("grp").alias("team"), "t").agg(F.sum("qty").alias("attempts"), F.sum("lines").alias("carries"), F.sum("returns").alias("sacks"), F.sum("cents").alias("epa"))
    return B.volume_history(g).select("team", "t", "plays", "pass_rate", "epa_per_play")


#: Orders as weekly reports.
REPORT_SQL = "CASE o_orderstatus WHEN 'F' THEN 'Out' WHEN 'O' THEN 'Questionable' END AS report_status, CASE o_orderpriority WHEN '1-URGENT' THEN 'Did Not Participate In Practice' WHEN '2-HIGH' THEN 'Limited Participation' END AS practice_status"


def reports(t: Tables):
    return t.orders.select(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), F.col("o_orderkey"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", "Out").when(F.col("o_orderstatus") == "O", "Questionable").alias("report_status"), F.when(F.col("o_orderpriority") == "1-URGENT", "Did Not Participate In Practice").when(F.col("o_orderpriority") == "2-HIGH", "Limited Participation").alias("practice_status"))


@query("d11_practice_flags", f"SELECT o_orderkey, (coalesce(report_status, '') = 'Out')::INT AS is_out, 0 AS is_doubtful, (coalesce(report_status, '') = 'Questionable')::INT AS is_questionable, (coalesce(practice_status, '') LIKE 'Did Not%')::INT AS did_not_practice, (coalesce(practice_status, '') LIKE 'Limited%')::INT AS limited FROM (SELECT o_orderkey, {REPORT_SQL} FROM orders)")
def d11(t: Tables):
    return D.practice_flags(reports(t)).select("o_orderkey", "is_out", "is_doubtful", "is_questionable", "did_not_practice", "limited")


@query("d12_latest_status", f"""
WITH r AS (SELECT o_custkey AS player_id, year(o_orderdate) * 12 + month(o_orderdate) AS t, max(coalesce(report_status, 'None')) AS status FROM (SELECT *, {REPORT_SQL} FROM orders) WHERE o_orderpriority <> '5-LOW' GROUP BY ALL)
SELECT f.entity, f.t, (SELECT max_by(r.status, r.t) FROM r WHERE r.player_id = f.entity AND r.t <= f.t) AS status FROM facts f""")
def d12(t: Tables):
    r = t.orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_custkey").alias("entity"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("t"), F.when(F.col("o_orderstatus") == "F", "Out").when(F.col("o_orderstatus") == "O", "Questionable").otherwise("None").alias("s")).groupBy("entity", "t").agg(F.max("s").alias("status"))
    return H.latest_status(t.facts.select("entity", "t"), r, ["entity"], "t", "status").select("entity", "t", "status")


@query("d14_availability", f"""
WITH w AS (SELECT entity AS player_id, season, period AS week, grp AS team FROM facts), ro AS (SELECT * FROM w WHERE player_id % 4 <> 0), rp AS (SELECT o_custkey AS player_id, year(o_orderdate)::INT AS season, month(o_orderdate)::INT AS week, max(CASE report_status WHEN 'Out' THEN 3 WHEN 'Questionable' THEN 1 ELSE 0 END) AS sev FROM (SELECT *, {REPORT_SQL} FROM orders) GROUP BY ALL)
SELECT w.player_id, w.season, w.week, CASE WHEN sev = 3 OR (EXISTS (SELECT 1 FROM ro WHERE ro.season = w.season AND ro.week = w.week AND ro.team = w.team) AND w.player_id % 4 = 0) THEN 'out' WHEN sev = 1 THEN 'questionable' END AS availability FROM w LEFT JOIN rp USING (player_id, season, week)""")
def d14(t: Tables):
    w = t.facts.select(F.col("entity").alias("player_id"), "season", F.col("period").alias("week"), F.col("grp").alias("team"))
    return D.availability(w, w.where("player_id % 4 <> 0"), reports(t).select("player_id", "season", "week", "report_status")).select("player_id", "season", "week", "availability")


@query("d20_schedule_context", """
WITH g AS (SELECT o_orderkey AS game_id, year(o_orderdate)::INT AS season, month(o_orderdate)::INT AS week, (o_custkey % 25)::INT AS home_team, (o_orderkey % 25)::INT AS away_team, round(o_totalprice / 10000, 2) AS total_line, (o_custkey % 7 - 3)::DOUBLE AS spread_line FROM orders), m AS (SELECT season + 1 AS season, avg(total_line) AS mean FROM g GROUP BY season)
SELECT game_id, team, opponent, is_home, implied, spread, round(total_line - mean, 6) AS total_over_last, roof FROM (SELECT *, home_team AS team, away_team AS opponent, 1 AS is_home, (total_line + spread_line) / 2 AS implied, spread_line AS spread FROM g UNION ALL SELECT *, away_team, home_team, 0, (total_line - spread_line) / 2, -spread_line FROM g) LEFT JOIN m USING (season) LEFT JOIN (SELECT n_nationkey AS home_team, n_name AS roof FROM nation) USING (home_team)""")
def d20(t: Tables):
    c = F.col
    g = t.orders.select(c("o_orderkey").alias("game_id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), (c("o_custkey") % 25).cast("int").alias("home_team"), (c("o_orderkey") % 25).cast("int").alias("away_team"), F.round(c("o_totalprice") / 10000, 2).alias("total_line"), (c("o_custkey") % 7 - 3).cast("double").alias("spread_line")).withColumn("stadium_id", c("home_team"))
    got = X.schedule_context(g, t.nation.select(c("n_nationkey").alias("stadium_id"), c("n_name").alias("roof"), F.lit("UTC").alias("tz")))
    return got.select("game_id", "team", "opponent", "is_home", "implied", "spread", F.round("total_over_last", 6).alias("total_over_last"), "roof")


@query("d33_week_usage_line", "SELECT f.entity, f.t, f.qty, f.lines, p.qty AS last_qty FROM facts f LEFT JOIN facts p ON p.entity = f.entity AND p.t = f.t - 1")
def d33(t: Tables):
    """One period's usage and actuals beside the period before; absent is absent."""
    f = t.facts.select("entity", "t", "qty", "lines")
    return f.join(f.select("entity", (F.col("t") + 1).alias("t"), F.col("qty").alias("last_qty")), ["entity", "t"], "left")


@query("d26_dated_import", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN k IS NULL THEN 'no id' WHEN dated > TIMESTAMP '1998-06-01' THEN 'dated in the future' WHEN count(*) OVER (PARTITION BY k) > 1 THEN 'id repeats' END AS reason FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey * 10 + o_orderkey % 10 END AS k, o_orderdate AS dated FROM orders)) WHERE reason IS NOT NULL GROUP BY ALL")
def d26(t: Tables):
    rows = t.orders.select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") * 10 + F.col("o_orderkey") % 10).alias("k"), F.col("o_orderdate").alias("at"))
    return X.dated_import(rows, F.to_timestamp(F.lit("1998-06-01")), "k", "at")[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("d22_manager_profile", """
WITH p AS (SELECT s_nationkey AS manager, s_suppkey AS player_id, (s_suppkey % 40)::DOUBLE AS adp, (s_suppkey % 37)::INT AS pick, list_extract(['QB', 'RB', 'WR', 'TE'], (s_suppkey % 4)::INT + 1) AS position, (s_suppkey % 12)::INT AS round FROM supplier), r AS (SELECT c_nationkey AS manager, count(*) AS seasons, sum(c_custkey % 5)::BIGINT AS wins, sum(c_custkey % 3)::BIGINT AS losses FROM customer GROUP BY ALL)
SELECT manager, picks, round(mean_reach, 8) AS mean_reach, first_qb, first_te, seasons, wins, losses, CASE WHEN wins + losses > 0 THEN wins::DOUBLE / (wins + losses) END AS win_share FROM (SELECT manager, count(*) AS picks, avg(adp - pick) AS mean_reach, min(round) FILTER (WHERE position = 'QB') AS first_qb, min(round) FILTER (WHERE position = 'TE') AS first_te FROM p GROUP BY ALL) FULL JOIN r USING (manager)""")
def d22(t: Tables):
    k = F.col("s_suppkey")
    p = t.supplier.select(F.col("s_nationkey").alias("manager"), k.alias("player_id"), (k % 40).cast("double").alias("adp"), (k % 37).cast("int").alias("pick"), F.get(F.array(*[F.lit(x) for x in ("QB", "RB", "WR", "TE")]), (k % 4).cast("int")).alias("position"), (k % 12).cast("int").alias("round"))
    r = t.customer.select(F.col("c_nationkey").alias("manager"), (F.col("c_custkey") % 5).alias("wins"), (F.col("c_custkey") % 3).alias("losses"), F.col("c_acctbal").alias("pf"))
    return X.manager_profile(p, r).select("manager", "picks", F.round("mean_reach", 8).alias("mean_reach"), F.col("first_QB").alias("first_qb"), F.col("first_TE").alias("first_te"), "seasons", "wins", "losses", "win_share")


@query("d24_window_opponents", """
WITH s AS (SELECT DISTINCT grp AS team, period AS week, (grp * 7 + period) % 27 AS opponent FROM facts), m AS (SELECT grp AS opponent, sum(pts)::DOUBLE AS v FROM facts GROUP BY ALL), j AS (SELECT * FROM s LEFT JOIN m USING (opponent))
SELECT team, CASE WHEN count(*) FILTER (WHERE week <= 4) > 0 AND count(*) FILTER (WHERE week <= 4) = count(v) FILTER (WHERE week <= 4) THEN sum(v) FILTER (WHERE week <= 4) / count(*) FILTER (WHERE week <= 4) END AS early, CASE WHEN count(*) FILTER (WHERE week = 12) > 0 AND count(*) FILTER (WHERE week = 12) = count(v) FILTER (WHERE week = 12) THEN sum(v) FILTER (WHERE week = 12) / count(*) FILTER (WHERE week = 12) END AS late FROM j GROUP BY ALL""")
def d24(t: Tables):
    s = t.facts.select(F.col("grp").alias("team"), F.col("period").alias("week"), ((F.col("grp") * 7 + F.col("period")) % 27).alias("opponent")).distinct()
    return X.window_opponents(s, t.facts.groupBy(F.col("grp").alias("team")).agg(F.sum("pts").cast("double").alias("value")), {"early": (1, 4), "late": (12, 12)})


@query("d28_roster_evidence", "SELECT c_custkey AS player_id, c_nationkey AS team, qty, n_name AS game, CASE WHEN c_custkey % 3 = 0 THEN 'Out' END AS designation FROM customer LEFT JOIN (SELECT entity, sum(qty)::BIGINT AS qty FROM facts GROUP BY 1) ON entity = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def d28(t: Tables):
    ro = t.customer.select(F.col("c_custkey").alias("player_id"), F.col("c_nationkey").alias("team"))
    notes = ro.where("player_id % 3 = 0").select("player_id", F.lit("Out").alias("designation"))
    return X.roster_evidence(ro, t.facts.groupBy(F.col("entity").alias("player_id")).agg(F.sum("qty").alias("qty")), t.nation.select(F.col("n_nationkey").alias("team"), F.col("n_name").alias("game")), notes).select("player_id", "team", "qty", "game", "designation")


@query("d30_participation_base", "SELECT s_suppkey AS target, l_orderkey, max(l_quantity) AS l_quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def d30(t: Tables):
    cw = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_suppkey").alias("target"))
    return B.participation_base(t.lineitem.select("l_suppkey", "l_orderkey", "l_quantity"), cw, "l_suppkey", "target", ["l_orderkey"], "l_quantity")


@query("d31_platform_rows", "SELECT entity, cat, pts::DOUBLE AS points, CASE WHEN cat = 'QB' THEN qty + lines WHEN cat = 'RB' THEN lines + returns ELSE returns END::DOUBLE AS opportunities, tag FROM (SELECT entity, list_extract(['QB', 'RB', 'WR'], (entity % 3)::INT + 1) AS cat, sum(pts) AS pts, sum(qty) AS qty, sum(lines) AS lines, sum(returns) AS returns, CASE WHEN entity % 5 = 0 THEN 'Out' END AS tag FROM facts GROUP BY entity)")
def d31(t: Tables):
    m = t.facts.groupBy("entity").agg(*[F.sum(c).cast("double").alias(c) for c in ("pts", "qty", "lines", "returns")])
    doc = m.select("entity", F.get(F.array(F.lit("QB"), F.lit("RB"), F.lit("WR")), (F.col("entity") % 3).cast("int")).alias("cat"), F.create_map(F.lit("pts_half_ppr"), F.col("pts"), F.lit("pass_att"), F.col("qty"), F.lit("rush_att"), F.col("lines"), F.lit("rec_tgt"), F.col("returns")).alias("stats"), F.when(F.col("entity") % 5 == 0, "Out").alias("injury_status"))
    return B.platform_rows(doc, "cat")


# ---------------------------------------------------------------- features


@query("h5_own_and_opponent", """
WITH g AS (SELECT grp AS team, season, period, sum(qty)::BIGINT AS qty FROM facts GROUP BY ALL), r AS (SELECT team, season, period, (sum(qty) OVER w)::DOUBLE / count(*) OVER w AS m FROM g WINDOW w AS (PARTITION BY team, season ORDER BY period))
SELECT g.team, g.season, g.period, (SELECT max_by(r.m, r.period) FROM r WHERE r.team = g.team AND r.season = g.season AND r.period < g.period) AS own, (SELECT max_by(r.m, r.period) FROM r WHERE r.team = (g.team + 1) % 25 AND r.season = g.season AND r.period < g.period) AS opp FROM g""")
def h5(t: Tables):
    g = t.facts.groupBy(F.col("grp").alias("team"), "season", "period").agg(F.sum("qty").alias("qty"))
    got = B.own_and_opponent(g, g.select("team", "season", "period", ((F.col("team") + 1) % 25).alias("opponent")), "season", "period", ["qty"])
    return got.select("team", "season", "period", F.col("qty_mean").alias("own"), F.col("opp_qty_mean").alias("opp"))


@query("h26_script_interaction", "SELECT entity, t, (qty - 25.0::DOUBLE) * (lines - 4.0::DOUBLE) AS product FROM facts")
def h26(t: Tables):
    return t.facts.select("entity", "t", B.interaction(F.col("qty"), F.col("lines"), 25.0, 4.0).alias("product"))


@query("h27_calendar_effects", """
WITH g AS (SELECT o_orderkey, o_custkey AS team, o_orderdate AS k, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS d FROM orders)
SELECT team, k, count(*) AS n, max(least(greatest(coalesce(d, 4), 4), 14))::INT AS rest, sum((d <= 5)::INT)::BIGINT AS short_weeks FROM g GROUP BY ALL""")
def h27(t: Tables):
    g = t.orders.select("o_orderkey", F.col("o_custkey").alias("team"), F.col("o_orderdate").alias("k"), F.lit(1.0).alias("z"), F.lit(0.0).alias("h"))
    return H.calendar_effects(g, "team", "k", "z", "h").groupBy("team", "k").agg(F.count(F.lit(1)).alias("n"), F.max("rest").alias("rest"), F.sum("short_week").alias("short_weeks"))


@query("h28_weather_interaction", "SELECT entity, t, (CASE WHEN returns > 0 THEN returns END - 1.0::DOUBLE) * (qty - 20.0::DOUBLE) AS product FROM facts")
def h28(t: Tables):
    return t.facts.select("entity", "t", B.interaction(F.when(F.col("returns") > 0, F.col("returns")), F.col("qty"), 1.0, 20.0).alias("product"))


@query("h35_feature_union", "SELECT f.entity, f.t, f.qty, f.lines, b.cents FROM facts f LEFT JOIN facts b ON b.entity = f.entity AND b.t = f.t AND b.returns > 0")
def h35(t: Tables):
    f = t.facts
    return B.feature_union(f.select("entity", "t", "qty", "lines"), f.where("returns > 0").select("entity", "t", "qty", "cents"), ["entity", "t"])


@query("h36_early_priors", """
WITH y AS (SELECT entity, any_value(grp) AS team, season, sum(qty)::DOUBLE / count(*) AS rate FROM facts GROUP BY entity, season), co AS (SELECT DISTINCT grp AS team, season, (grp + season // 2) % 5 AS coach FROM facts)
SELECT y.entity, y.season, p.rate AS prior_rate, (lag_c <> coach)::INT AS new_coach, round(-ln(y.entity % 50 + 1.0), 10) + 0 AS capital FROM y LEFT JOIN y p ON p.entity = y.entity AND p.season + 1 = y.season LEFT JOIN (SELECT *, lag(coach) OVER (PARTITION BY team ORDER BY season) AS lag_c FROM co) c ON c.team = y.team AND c.season = y.season""")
def h36(t: Tables):
    y = t.facts.groupBy("entity", "season").agg(F.min("grp").alias("team"), (F.sum("qty") / F.count(F.lit(1))).alias("rate"))
    co = t.facts.select(F.col("grp").alias("team"), "season").distinct().withColumn("coach", (F.col("team") + F.floor(F.col("season") / 2)) % 5)
    draft = y.select("entity", (F.col("entity") % 50).alias("pick"), F.to_date(F.lit("1970-01-01")).alias("born")).distinct()
    got = B.early_priors(y.select("entity", "season", "team"), draft, y.select("entity", "season", "rate"), co, "season", F.to_date(F.lit("1996-01-01")))
    return got.select("entity", "season", "prior_rate", "new_coach", (F.round("capital", 10) + 0).alias("capital"))


@query("h37_counting_rates", """
WITH y AS (SELECT entity, season + 1 AS season, sum(lines)::DOUBLE / count(DISTINCT period) AS prior FROM facts GROUP BY entity, season)
SELECT f.entity, f.season, f.period, round((coalesce(sum(lines) OVER w, 0) + 3 * prior) / (count(*) OVER w + 3), 8) AS lines_rate FROM facts f LEFT JOIN y USING (entity, season) WINDOW w AS (PARTITION BY f.entity, f.season ORDER BY f.period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def h37(t: Tables):
    return B.counting_rates(t.facts, ["entity"], "season", "period", ["lines"], 3).select("entity", "season", "period", F.round("lines_rate", 8).alias("lines_rate"))


# ---------------------------------------------------------------- estimators


@query("m1_evidence", """
WITH f AS (SELECT *, sum(qty) OVER (PARTITION BY grp, t) AS team FROM facts WHERE t <= 23970), e AS (SELECT entity, any_value(grp) AS grp, any_value(cat) AS cat, count(DISTINCT t) AS periods, sum(qty)::BIGINT AS total, sum(qty)::DOUBLE / sum(team) AS share FROM f GROUP BY entity)
SELECT entity, grp, cat, periods, total, round(share, 10) AS share FROM e""")
def m1(t: Tables):
    return B.evidence(t.facts, "entity", "grp", "cat", "t", 23970, "qty").select("entity", "grp", "cat", "periods", "total", F.round("share", 10).alias("share"))


@query("m3_override", "SELECT entity, t, pts::DOUBLE AS model_mean, CASE WHEN returns > 2 THEN 0 ELSE pts END::DOUBLE AS pts, CASE WHEN returns > 2 THEN 0 ELSE lines END::DOUBLE AS spread FROM facts")
def m3(t: Tables):
    f = t.facts.select("entity", "t", F.col("pts").cast("double").alias("pts"), F.col("lines").cast("double").alias("spread"), "returns")
    return M.override(f, "pts", "spread", F.col("returns") > 2).select("entity", "t", "model_mean", "pts", "spread")


@query("m13_future_matchups", "SELECT a.team, a.opponent, a.is_home, round(20 + o.x + d.y + CASE WHEN a.is_home = 1 THEN 0.9 ELSE -0.9 END, 8) AS implied FROM (SELECT DISTINCT grp AS team, (grp + period) % 25 AS opponent, period % 2 AS is_home FROM facts) a LEFT JOIN (SELECT grp AS team, avg(qty) AS x FROM facts GROUP BY 1) o USING (team) LEFT JOIN (SELECT grp AS opponent, avg(lines) AS y FROM facts GROUP BY 1) d USING (opponent)")
def m13(t: Tables):
    s = t.facts.select(F.col("grp").alias("team"), ((F.col("grp") + F.col("period")) % 25).alias("opponent"), (F.col("period") % 2).alias("is_home")).distinct()
    strength = t.facts.groupBy(F.col("grp").alias("team")).agg(F.avg("qty").alias("offense"), F.avg("lines").alias("defense"))
    return M.future_matchups(s, strength, 20.0).select("team", "opponent", "is_home", F.round("implied", 8).alias("implied"))


@query("m17_market_contender", """
WITH r AS (SELECT entity, sum(qty)::DOUBLE AS yards, sum(lines)::DOUBLE AS catches FROM facts GROUP BY entity), e AS (SELECT entity, max(qty)::DOUBLE AS yards FROM facts WHERE returns > 1 GROUP BY entity)
SELECT entity, CASE WHEN e.yards IS NOT NULL THEN 1 ELSE 0 END AS quoted, round(CASE WHEN e.yards IS NOT NULL THEN 0.1::DOUBLE * e.yards + 0.5::DOUBLE * r.catches END, 8) AS points, CASE WHEN e.yards IS NULL THEN 'no market' END AS reason FROM r LEFT JOIN e USING (entity)""")
def m17(t: Tables):
    rates = t.facts.groupBy("entity").agg(F.sum("qty").cast("double").alias("yards"), F.sum("lines").cast("double").alias("catches"))
    exp = t.facts.where("returns > 1").groupBy("entity").agg(F.max("qty").cast("double").alias("expected")).withColumn("stat", F.lit("yards"))
    return M.market_contender(rates, exp, {"yards": 0.1, "catches": 0.5}).select("entity", "quoted", F.round("points", 8).alias("points"), "reason")


@query("m25_draft_surplus", """
WITH per AS (SELECT (entity % 60)::INT AS pick, median(pts)::DOUBLE AS m, count(*) AS n FROM facts GROUP BY 1), c AS (SELECT a.pick, CASE WHEN sum(b.n) >= 5 THEN quantile_cont(b.m, 0.5) END AS expected FROM per a JOIN (SELECT *, row_number() OVER (ORDER BY pick) AS k FROM per) b ON b.k BETWEEN (SELECT count(*) FROM per x WHERE x.pick <= a.pick) - 7 AND (SELECT count(*) FROM per x WHERE x.pick <= a.pick) + 7 GROUP BY a.pick)
SELECT entity, t, round(pts - expected, 8) AS surplus FROM facts JOIN c ON c.pick = entity % 60""")
def m25(t: Tables):
    f = t.facts.select("entity", "t", (F.col("entity") % 60).cast("int").alias("pick"), "pts")
    return M.draft_surplus(f, "pick", "pts").select("entity", "t", F.round("surplus", 8).alias("surplus"))


@query("m26_shape_and_outcome", """
WITH r AS (SELECT grp, t, count(*) FILTER (WHERE cat = 'BUILDING') AS a, count(*) FILTER (WHERE cat = 'MACHINERY') AS b, sum(pts)::DOUBLE AS y FROM facts GROUP BY ALL) SELECT 'BUILDING' AS category, round(corr(a, y), 8) AS r FROM r UNION ALL SELECT 'MACHINERY', round(corr(b, y), 8) FROM r""")
def m26(t: Tables):
    f = t.facts
    return B.shape_and_outcome(f, f.groupBy("grp", "t").agg(F.sum("pts").cast("double").alias("y")), ["grp", "t"], "cat", ["BUILDING", "MACHINERY"], "y").withColumn("r", F.round("r", 8))


@query("m27_training_table", "SELECT f.entity, f.t, f.qty AS feature, f.lines AS baseline, o.cents AS outside, f.pts AS actual FROM facts f LEFT JOIN facts o ON o.entity = f.entity AND o.t = f.t AND o.returns > 0")
def m27(t: Tables):
    f = t.facts
    return B.training_table(f.select("entity", "t", F.col("qty").alias("feature")), f.select("entity", "t", F.col("lines").alias("baseline")), f.where("returns > 0").select("entity", "t", F.col("cents").alias("outside")), f.select("entity", "t", F.col("pts").alias("actual")), ["entity", "t"])


@query("m32_parameter_search", "SELECT n, round(s / n, 6) AS score, a FROM (SELECT count(*) AS n, sum(abs(pts - 100 * qty // 25))::DOUBLE AS s0, sum(abs(pts - 4.0 * qty)) AS s4, sum(abs(pts - 5.0 * qty)) AS s5, least(s4, s5) AS s, CASE WHEN s4 <= s5 THEN 4.0 ELSE 5.0 END::DOUBLE AS a FROM facts)")
def m32(t: Tables):
    got = B.parameter_search(t.facts, [{"a": 4.0}, {"a": 5.0}], lambda g: F.abs(F.col("pts") - g["a"] * F.col("qty")))
    return got.select("n", F.round("score", 6).alias("score"), "a")


@query("m33_frozen_encoding", "SELECT entity, t, coalesce(q, 0) AS q, (q IS NOT NULL)::INT AS q__known, coalesce(r, 0) AS r FROM (SELECT entity, t, CASE WHEN returns > 0 THEN qty END AS q, CASE WHEN lines > 1 THEN lines END AS r FROM facts)")
def m33(t: Tables):
    rows = t.facts.select("entity", "t", F.when(F.col("returns") > 0, F.col("qty")).alias("q"), F.when(F.col("lines") > 1, F.col("lines")).alias("r"))
    return B.encoded_like(rows, {"q": True, "r": False})


# ---------------------------------------------------------------- market


@query("k2_one_sided", f"""
WITH {QUOTES}, pr AS (SELECT event_id, book, market, player, point, count(*) AS n, max(CASE WHEN price >= 100 THEN 100 / (price + 100) WHEN price <= -100 THEN -price / (-price + 100) END) FILTER (WHERE side = 'over') AS qo, max(CASE WHEN price >= 100 THEN 100 / (price + 100) WHEN price <= -100 THEN -price / (-price + 100) END) FILTER (WHERE side = 'under') AS qu FROM (SELECT event_id, book, market, 1 AS player, 1 AS point, side, price FROM quotes) GROUP BY ALL),
tw AS (SELECT event_id, book, median(qo + qu - 1) AS m FROM pr WHERE n = 2 AND qo IS NOT NULL AND qu IS NOT NULL GROUP BY ALL)
SELECT event_id, book, player, seen, round(CASE WHEN price >= 100 THEN 100 / (price + 100) WHEN price <= -100 THEN -price / (-price + 100) END / (1 + m), 8) AS p_yes, CASE WHEN m IS NOT NULL THEN 'one-sided' END AS method FROM quotes LEFT JOIN tw USING (event_id, book)""")
def k2(t: Tables):
    q = quotes(t)
    main, _ = K.devig(q.withColumns({"player": F.lit(1), "point": F.lit(1), "side": F.initcap("side")}))
    got = K.one_sided(q, main)
    return got.select("event_id", "book", "player", "seen", F.round("p_yes", 8).alias("p_yes"), "method")


@query("k8_payload_summary", f"WITH {QUOTES} SELECT event_id, count(DISTINCT book) AS books, count(DISTINCT market) AS markets, count(DISTINCT player) AS players, count(*) AS quotes FROM quotes GROUP BY ALL")
def k8(t: Tables):
    return B.payload_summary(quotes(t))


@query("k10_catalogue", "SELECT DISTINCT p_type AS sport, p_brand AS market, upper(p_brand) AS name FROM part")
def k10(t: Tables):
    s = t.part.groupBy("p_type").agg(F.collect_set(F.struct(F.col("p_brand").alias("key"), F.upper("p_brand").alias("name"))).alias("markets"))
    return B.catalogue(s.groupBy(F.lit(1).alias("k")).agg(F.collect_list(F.struct(F.col("p_type").alias("key"), "markets")).alias("sports")))


@query("k12_due_games", "SELECT o_orderkey AS game_id FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01' AND o_orderdate <= TIMESTAMP '1996-06-11' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def k12(t: Tables):
    held = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("game_id"))
    return K.due(t.orders.select(F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").alias("k")), "k", F.to_timestamp(F.lit("1996-06-01")), 240.0, held, "game_id").select("game_id")


@query("k13_slots_to_cover", "SELECT year(o_orderdate)::INT AS season, count(DISTINCT o_orderkey) AS games, count(DISTINCT month(o_orderdate)) AS weeks, count(*) AS instants FROM orders, (VALUES (5), (60)) v(lead) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1 AND lead = 5) GROUP BY ALL")
def k13(t: Tables):
    g = t.orders.select(F.col("o_orderkey").alias("game_id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"))
    return B.slots_to_cover(g, t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("game_id"), F.lit(5).alias("lead_minutes")), [5, 60])
