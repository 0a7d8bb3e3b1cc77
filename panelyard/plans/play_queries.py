"""Queries over play-like rows: order lines read as plays of a game, suppliers as sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.functions import scalars as S
from panelyard.operators import blocks as B
from panelyard.operators import features as H
from panelyard.operators import panels as P
from panelyard.operators import plays as Y
from panelyard.operators import scored as D
from panelyard.plans.registry import Tables
from panelyard.plans.registry import query as plain_query

PLAYS = """plays AS (
  SELECT l_orderkey AS game_id, l_linenumber * 10000000 + l_partkey AS play_id, year(o_orderdate)::INT AS season, month(o_orderdate)::INT AS week, (l_suppkey % 32)::INT AS posteam, l_suppkey AS passer_id,
    CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey ELSE l_partkey % 500 END AS rusher_id, CASE WHEN l_linenumber % 4 <> 0 THEN l_partkey END AS receiver_id, (l_returnflag <> 'R')::INT AS pass_attempt, (l_returnflag = 'R')::INT AS rush_attempt,
    (l_returnflag <> 'R' AND l_quantity < 5)::INT AS sack, (l_returnflag = 'R' AND l_linestatus = 'O')::INT AS qb_scramble, (l_returnflag <> 'R' OR l_linestatus = 'O')::INT AS qb_dropback, (l_quantity = 50)::INT AS qb_spike, (l_linenumber = 7)::INT AS two_point_attempt,
    l_discount * 10 AS wp, l_linenumber % 5 + 1 AS qtr, l_quantity * 30 AS half_seconds_remaining, CASE WHEN l_linenumber <> 3 THEN l_quantity - 10 END AS air_yards, l_quantity AS yards, l_quantity * 2 AS yardline_100, l_linenumber % 4 + 1 AS down,
    round(l_tax * 100)::INT AS ydstogo, l_linenumber // 2 AS fixed_drive, l_shipdate AS at, round(l_extendedprice * 100)::BIGINT AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def query(name: str, sql: str | None = None):
    """As ``registry.query``; SQL that reads ``plays`` gets its definition."""
    if sql is not None and " plays" in sql:
        body = sql.strip()
        sql = f"WITH {PLAYS}, {body[4:].lstrip()}" if body[:4].upper() == "WITH" else f"WITH {PLAYS} {body}"
    return plain_query(name, sql)


def plays(t: Tables):
    l = P.spread(t.lineitem, "l_orderkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    run, c = F.col("l_returnflag") == "R", F.col
    return l.select(
        c("l_orderkey").alias("game_id"), (c("l_linenumber") * 10000000 + c("l_partkey")).alias("play_id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), (c("l_suppkey") % 32).cast("int").alias("posteam"), c("l_suppkey").alias("passer_id"),
        F.when(c("l_linenumber") % 3 == 0, c("l_suppkey")).otherwise(c("l_partkey") % 500).alias("rusher_id"), F.when(c("l_linenumber") % 4 != 0, c("l_partkey")).alias("receiver_id"), (~run).cast("int").alias("pass_attempt"), run.cast("int").alias("rush_attempt"),
        (~run & (c("l_quantity") < 5)).cast("int").alias("sack"), (run & (c("l_linestatus") == "O")).cast("int").alias("qb_scramble"), (~run | (c("l_linestatus") == "O")).cast("int").alias("qb_dropback"), (c("l_quantity") == 50).cast("int").alias("qb_spike"), (c("l_linenumber") == 7).cast("int").alias("two_point_attempt"),
        (c("l_discount") * 10).alias("wp"), (c("l_linenumber") % 5 + 1).alias("qtr"), (c("l_quantity") * 30).alias("half_seconds_remaining"), F.when(c("l_linenumber") != 3, c("l_quantity") - 10).alias("air_yards"), c("l_quantity").alias("yards"), (c("l_quantity") * 2).alias("yardline_100"), (c("l_linenumber") % 4 + 1).alias("down"),
        F.round(c("l_tax") * 100).cast("int").alias("ydstogo"), F.floor(c("l_linenumber") / 2).cast("int").alias("fixed_drive"), c("l_shipdate").alias("at"), F.round(c("l_extendedprice") * 100).cast("long").alias("cents"),
    )


TARGET = "(pass_attempt = 1 AND sack = 0 AND receiver_id IS NOT NULL)"
DESIGNED = "(rush_attempt = 1 AND qb_scramble = 0)"
SCRIMMAGE = "((pass_attempt = 1 OR rush_attempt = 1 OR qb_dropback = 1) AND two_point_attempt = 0)"
AIMED = "(pass_attempt = 1 AND sack = 0 AND qb_spike = 0 AND two_point_attempt = 0 AND air_yards IS NOT NULL)"
n_if = lambda c: f"count(*) FILTER (WHERE {c})"


@query("b1_renamed_columns", "SELECT o_orderkey AS game_id, o_custkey AS entity, o_orderstatus AS state FROM orders")
def b1(t: Tables):
    from panelyard.sources.tables import read_columns

    return read_columns(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderstatus"]).withColumnsRenamed({"o_orderkey": "game_id", "o_custkey": "entity", "o_orderstatus": "state"})


@query("b2_derived_columns", "SELECT entity, t, (lines + returns)::BIGINT AS opps, cents::DOUBLE / qty AS per_unit, (pts - 4 * qty)::BIGINT AS over_expected FROM facts")
def b2(t: Tables):
    return t.facts.withColumns({"opps": F.col("lines") + F.col("returns"), "per_unit": S.safe_ratio(F.col("cents"), F.col("qty")), "over_expected": F.col("pts") - 4 * F.col("qty")}).select("entity", "t", "opps", "per_unit", "over_expected")


@query("b4_play_kinds", f"SELECT season, posteam, {n_if(TARGET)} AS targets, {n_if(DESIGNED)} AS runs, {n_if('qb_scramble = 1')} AS scrambles FROM plays GROUP BY ALL")
def b4(t: Tables):
    return plays(t).groupBy("season", "posteam").agg(F.count_if(Y.is_target()).alias("targets"), F.count_if(Y.is_designed_run()).alias("runs"), F.count_if(Y.is_scramble()).alias("scrambles"))


@query("b5_neutral_plays", f"SELECT season, week, {n_if(SCRIMMAGE)} AS scrimmage, {n_if(SCRIMMAGE + ' AND wp BETWEEN 0.2 AND 0.8 AND qtr <= 3 AND half_seconds_remaining > 120')} AS neutral FROM plays GROUP BY ALL")
def b5(t: Tables):
    return plays(t).groupBy("season", "week").agg(F.count_if(Y.is_scrimmage()).alias("scrimmage"), F.count_if(Y.is_neutral()).alias("neutral"))


@query("b6_deep_throws", f"SELECT passer_id, {n_if(AIMED)} AS aimed, {n_if(AIMED + ' AND air_yards >= 20')} AS deep FROM plays GROUP BY ALL")
def b6(t: Tables):
    return plays(t).groupBy("passer_id").agg(F.count_if(Y.is_aimed_pass()).alias("aimed"), F.count_if(Y.is_deep()).alias("deep"))


#: Report texts for parts, by size.
REPORTS = ["Hamstring", "quad contusion", "Squad travel", "Not Injury Related - resting player", "illness", "Knee", "rest", "Hip Flexor strain", "nir", "Shoulder", "coach's decision", "calf/ankle", "restricted motion", " ", "COVID-19 protocol", "Thigh, Personal", "arrest of play"]
REPORT_SQL = "list_extract([" + ", ".join("'" + r.replace("'", "''") + "'" for r in REPORTS) + f"], (p_size % {len(REPORTS) + 1}) + 1)"


@query("b7_injury_texts", f"""
SELECT p_partkey, report, coalesce(regexp_matches(lower(report), '\\b(hamstrings?|groin|calf|calves|quads?|quadriceps?|thigh|pectoral|oblique|abdomen|abdominal|adductor)\\b|hip flexor'), false) AS soft,
  coalesce(lower(trim(report)) NOT IN ('', 'other', 'nir') AND NOT regexp_matches(lower(report), 'not injury related|personal|coach|suspension|decision|travel|inactive|load management|covid|discipline|illness|\\brest\\b|\\bresting\\b'), false) AS injured
FROM (SELECT p_partkey, {REPORT_SQL} AS report FROM part)""")
def b7(t: Tables):
    report = F.get(F.array(*[F.lit(r) for r in REPORTS]), F.col("p_size") % (len(REPORTS) + 1))
    r = t.part.select("p_partkey", report.alias("report"))
    return r.select("p_partkey", "report", Y.is_soft_tissue(F.col("report")).alias("soft"), Y.is_real_injury(F.col("report")).alias("injured"))


STATUS_SQL = "list_extract(['ACT', 'RES', 'PUP', 'NFI', 'DEV', 'SUS'], (p_size % 7) + 1) AS status, list_extract(['A01', 'R01', 'R/Retired', 'P02', 'R48'], (p_partkey % 6)::INT + 1) AS code"


def statuses(t: Tables):
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    return t.part.select("p_partkey", pick(["ACT", "RES", "PUP", "NFI", "DEV", "SUS"], F.col("p_size") % 7).alias("status"), pick(["A01", "R01", "R/Retired", "P02", "R48"], F.col("p_partkey") % 6).alias("code"))


@query("b8_on_reserve", f"SELECT p_partkey, coalesce(status IN ('RES', 'PUP', 'NFI', 'SUS'), false) OR coalesce(code LIKE 'R%' AND code <> 'R/Retired', false) AS reserve FROM (SELECT p_partkey, {STATUS_SQL} FROM part)")
def b8(t: Tables):
    return statuses(t).select("p_partkey", Y.on_reserve(F.col("status"), F.col("code")).alias("reserve"))


@query("h4_reserve_as_of", f"""
WITH r AS (SELECT season, player_id, week, max((coalesce(status IN ('RES', 'PUP', 'NFI', 'SUS'), false) OR coalesce(code LIKE 'R%' AND code <> 'R/Retired', false))::INT) = 1 AS reserve
  FROM (SELECT *, {STATUS_SQL} FROM (SELECT DISTINCT season, week, rusher_id AS player_id FROM plays) JOIN part ON p_partkey = player_id) GROUP BY ALL),
g AS (SELECT DISTINCT season, week, receiver_id AS player_id FROM plays WHERE receiver_id IS NOT NULL)
SELECT g.season, g.week, g.player_id, (SELECT max_by(r.reserve, r.week) FROM r WHERE r.season = g.season AND r.player_id = g.player_id AND r.week <= g.week) AS reserve FROM g""")
def h4(t: Tables):
    p = plays(t)
    g = p.where("receiver_id IS NOT NULL").select("season", "week", F.col("receiver_id").alias("player_id")).distinct()
    r = p.select("season", "week", F.col("rusher_id").alias("player_id")).distinct().join(statuses(t).withColumnRenamed("p_partkey", "player_id"), "player_id").withColumnRenamed("code", "status_description_abbr")
    return Y.reserve_as_of(g, r).select("season", "week", "player_id", "reserve")


@query("h13_run_kinds", f"SELECT posteam, season, {n_if(DESIGNED)} AS designed, {n_if('qb_scramble = 1')} AS scrambles, {n_if(DESIGNED + ' AND ydstogo <= 1 AND rusher_id = passer_id')} AS sneaks, {n_if(DESIGNED + ' AND yardline_100 <= 5')} AS goal_line FROM plays GROUP BY ALL")
def h13(t: Tables):
    return Y.run_kinds(plays(t), ["posteam", "season"])


@query("h17_relief", """
WITH d AS (SELECT * FROM plays WHERE qb_dropback = 1), s AS (SELECT season, week, game_id, posteam, min_by(passer_id, (play_id, cents, passer_id)) AS starter, count(*) AS team_dropbacks FROM d GROUP BY ALL), p AS (SELECT game_id, posteam, passer_id, count(*) AS dropbacks FROM d GROUP BY ALL)
SELECT game_id, posteam, count(*) AS passers, sum(dropbacks)::BIGINT AS dropbacks, max(dropbacks)::DOUBLE / any_value(team_dropbacks) AS top_share FROM p JOIN s USING (game_id, posteam) GROUP BY ALL""")
def h17(t: Tables):
    r = Y.relief(plays(t).withColumn("score_differential", F.col("down") * 5))
    return r.groupBy("game_id", "posteam").agg(F.count(F.lit(1)).alias("passers"), F.sum("dropbacks").alias("dropbacks"), F.max("share").alias("top_share"))


@query("d17_event_history", f"""
WITH g AS (SELECT DISTINCT season, week, posteam, receiver_id FROM plays WHERE receiver_id IS NOT NULL), o AS (SELECT season, week, posteam, receiver_id, {n_if('yardline_100 <= 20')} AS red, {n_if('air_yards >= 20')} AS deep FROM plays GROUP BY ALL), m AS (SELECT season, week, posteam, {n_if('yardline_100 <= 20')} AS red_team, {n_if('air_yards >= 20')} AS deep_team FROM plays GROUP BY ALL)
SELECT g.*, coalesce(red, 0) AS red, coalesce(deep, 0) AS deep, coalesce(red_team, 0) AS red_team, coalesce(deep_team, 0) AS deep_team FROM g LEFT JOIN o USING (season, week, posteam, receiver_id) LEFT JOIN m USING (season, week, posteam)""")
def d17(t: Tables):
    p = plays(t)
    return Y.event_history(p, p.where("receiver_id IS NOT NULL"), "receiver_id", "posteam", ["season", "week"], {"red": F.col("yardline_100") <= 20, "deep": F.col("air_yards") >= 20})


@query("d10_routes", """
WITH o AS (SELECT game_id, play_id, string_split(string_agg(DISTINCT rusher_id::VARCHAR || ' ; ' || coalesce(receiver_id::VARCHAR, ''), ';'), ';') AS xs FROM plays GROUP BY ALL),
u AS (SELECT DISTINCT game_id, play_id, trim(unnest(xs)) AS player_id FROM o), dr AS (SELECT game_id, play_id, posteam FROM plays WHERE qb_dropback = 1), p AS (SELECT game_id, posteam, player_id, count(*) AS routes FROM dr JOIN u USING (game_id, play_id) WHERE player_id <> '' GROUP BY ALL), tm AS (SELECT game_id, posteam, count(*) AS dropbacks FROM dr GROUP BY ALL)
SELECT game_id, posteam, player_id, routes, dropbacks, routes::DOUBLE / dropbacks AS route_share FROM p JOIN tm USING (game_id, posteam) QUALIFY row_number() OVER (PARTITION BY game_id, player_id ORDER BY routes DESC, posteam) = 1""")
def d10(t: Tables):
    p = plays(t)
    on = p.select("game_id", "play_id", F.explode(F.array(F.col("rusher_id").cast("string"), F.col("receiver_id").cast("string"))).alias("x")).where("x IS NOT NULL")
    part = on.groupBy("game_id", "play_id").agg(F.array_join(F.array_sort(F.collect_set("x")), " ; ").alias("offense_players"))
    return Y.routes(p, part).select("game_id", "posteam", "player_id", "routes", "dropbacks", "route_share")


@query("d15_play_credits", """
WITH c AS (SELECT game_id, play_id, passer_id, rusher_id, receiver_id, CASE WHEN pass_attempt = 1 THEN yards END AS py, CASE WHEN rush_attempt = 1 THEN yards END AS ry, (pass_attempt = 1 AND yards > 40)::INT AS ptd, (rush_attempt = 1 AND yards > 45)::INT AS rtd, sack, (pass_attempt = 1 AND sack = 0)::INT AS done FROM plays),
x AS (SELECT passer_id AS entity, 0.04::DOUBLE * coalesce(py, 0) + 4 * ptd - sack AS points FROM c UNION ALL SELECT rusher_id, 0.1::DOUBLE * coalesce(ry, 0) + 6 * rtd FROM c UNION ALL SELECT receiver_id, 0.5::DOUBLE * done + 0.1::DOUBLE * coalesce(py, 0) + 6 * ptd FROM c)
SELECT entity, count(*) AS plays, round(sum(points), 4) AS points FROM x WHERE entity IS NOT NULL AND points <> 0 GROUP BY ALL""")
def d15(t: Tables):
    p = plays(t)
    passed, ran = F.col("pass_attempt") == 1, F.col("rush_attempt") == 1
    p = p.select("game_id", "play_id", "passer_id", "rusher_id", "receiver_id", F.when(passed, F.col("yards")).alias("passing_yards"), (passed & (F.col("yards") > 40)).cast("int").alias("pass_touchdown"), F.col("sack").alias("interception"), F.when(ran, F.col("yards")).alias("rushing_yards"), (ran & (F.col("yards") > 45)).cast("int").alias("rush_touchdown"), (passed & (F.col("sack") == 0)).cast("int").alias("complete_pass"), F.when(passed, F.col("yards")).alias("receiving_yards"))
    return D.credits(p).groupBy("entity").agg(F.count(F.lit(1)).alias("plays"), F.round(F.sum("points"), 4).alias("points"))


@query("d19_special_events", """
WITH k AS (SELECT *, list_extract(['field_goal', 'kickoff', 'punt', 'pass'], (l % 4)::INT + 1) AS play_type FROM (SELECT *, play_id // 10000000 AS l FROM plays))
SELECT kind, team, count(*) AS n, sum(value)::DOUBLE AS value, sum(distance)::DOUBLE AS distance FROM (
  SELECT 'field_goal' AS kind, posteam AS team, (yards < 40)::INT AS value, yards + 10 AS distance FROM k WHERE play_type = 'field_goal' UNION ALL SELECT 'try', posteam, (yards < 25)::INT, NULL FROM k WHERE two_point_attempt = 1
  UNION ALL SELECT 'kick_return', posteam, air_yards, NULL FROM k WHERE play_type = 'kickoff' AND air_yards IS NOT NULL UNION ALL SELECT 'punt_return', (posteam + 1) % 32, air_yards, NULL FROM k WHERE play_type = 'punt' AND air_yards IS NOT NULL) GROUP BY ALL""")
def d19(t: Tables):
    kind = F.get(F.array(*[F.lit(x) for x in ("field_goal", "kickoff", "punt", "pass")]), (F.floor(F.col("play_id") / 10000000) % 4).cast("int"))
    p = plays(t).withColumns({"play_type": kind, "field_goal_result": F.when(F.col("yards") < 40, "made").otherwise("missed"), "kick_distance": F.col("yards") + 10, "two_point_conv_result": F.when(F.col("yards") < 25, "success").otherwise("failure"), "return_yards": F.col("air_yards"), "defteam": (F.col("posteam") + 1) % 32})
    return B.special_events(p).groupBy("kind", "team").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.sum("distance").alias("distance"))


@query("h11_tendency_observations", f"""
WITH s AS (SELECT * FROM plays WHERE {SCRIMMAGE}), q AS (SELECT * FROM s WHERE wp BETWEEN 0.2 AND 0.8 AND qtr <= 3 AND half_seconds_remaining > 120),
runs AS (SELECT passer_id, posteam, season, week, game_id, max(n) AS top, sum(n) AS al FROM (SELECT passer_id, posteam, season, week, game_id, rusher_id, count(*) AS n FROM plays WHERE {DESIGNED} GROUP BY ALL) GROUP BY ALL HAVING sum(n) >= 2)
SELECT kind, person, count(*) AS n, round(sum(value), 6) AS total FROM (
  SELECT 'proe' AS kind, passer_id AS person, CASE WHEN yardline_100 <= 20 THEN 1 ELSE 0 END AS z, yards::DOUBLE / 50 AS value FROM s UNION ALL SELECT 'pass_rate', passer_id, 0, pass_attempt FROM q
  UNION ALL SELECT 'go', passer_id, 0, 1 FROM plays WHERE down = 4 AND ydstogo <= 5 AND wp BETWEEN 0.1 AND 0.9 UNION ALL SELECT 'concentration', passer_id, 0, top::DOUBLE / al FROM runs UNION ALL SELECT 'te_target', passer_id, 0, (down = 2)::INT FROM plays WHERE {TARGET}) GROUP BY ALL""")
def h11(t: Tables):
    p = plays(t).withColumns({"pass_oe": F.col("yards") / 50, "receiver_position": F.when(F.col("down") == 2, "TE").otherwise("WR"), "game_seconds_remaining": F.col("half_seconds_remaining")})
    o = Y.tendency_observations(p, "passer_id", 2).where("kind <> 'pace'")
    return o.groupBy("kind", F.col("passer_id").alias("person")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("h12_caller_blocks", f"""
WITH o AS (SELECT passer_id AS person, posteam, season, week, avg(pass_attempt) AS rate, count(*) AS n FROM plays WHERE {SCRIMMAGE} GROUP BY ALL),
w AS (SELECT *, sum(rate * n) OVER v AS x, sum(n) OVER v AS m FROM o WINDOW v AS (PARTITION BY person, season ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT person, posteam, season, week, round(x / m, 8) AS caller_rate, round((x / m - 0.5) * (n - 1), 8) + 0 AS caller_x_volume FROM w""")
def h12(t: Tables):
    """A caller's pass rate to date, and its product with this week's volume."""
    o = plays(t).where(Y.is_scrimmage()).groupBy(F.col("passer_id").alias("person"), "posteam", "season", "week").agg(F.sum("pass_attempt").alias("passes"), F.count(F.lit(1)).alias("n"))
    per = o.groupBy("person", "season", "week").agg(F.sum("passes").alias("passes"), F.sum("n").alias("all_n"))
    to_date = P.as_of_sums(per, ["person", "season"], "week", ["passes", "all_n"]).withColumn("rate", S.safe_ratio(F.col("passes_std"), F.col("all_n_std"))).select("person", "season", "week", "rate")
    j = o.join(to_date, ["person", "season", "week"])
    return j.select("person", "posteam", "season", "week", F.round("rate", 8).alias("caller_rate"), F.round(B.interaction(F.col("rate"), F.col("n"), 0.5, 1.0), 8).alias("caller_x_volume"))


@query("h15_vacated_roles", """
WITH w AS (SELECT season, week, posteam, receiver_id, count(*) AS tg, (receiver_id % 3)::INT AS role FROM plays WHERE receiver_id IS NOT NULL GROUP BY ALL),
s AS (SELECT *, tg::DOUBLE / sum(tg) OVER (PARTITION BY season, week, posteam) AS share, receiver_id % 7 = 0 AS away FROM w),
v AS (SELECT *, coalesce(sum(share) FILTER (WHERE away) OVER r, 0) AS vacated, coalesce(sum(share) FILTER (WHERE NOT away) OVER r, 0) AS here FROM s WINDOW r AS (PARTITION BY season, week, posteam, role))
SELECT season, week, posteam, receiver_id, round(vacated, 8) AS vacated, round(CASE WHEN vacated = 0 OR away THEN 0 WHEN here > 0 THEN vacated * share / here END, 8) AS pickup FROM v""")
def h15(t: Tables):
    return _vacated(t, "role")


@query("h7_vacated_share", """
WITH w AS (SELECT season, week, posteam, receiver_id, count(*) AS tg FROM plays WHERE receiver_id IS NOT NULL GROUP BY ALL),
s AS (SELECT *, tg::DOUBLE / sum(tg) OVER (PARTITION BY season, week, posteam) AS share, receiver_id % 7 = 0 AS away FROM w),
v AS (SELECT *, coalesce(sum(share) FILTER (WHERE away) OVER r, 0) AS vacated, coalesce(sum(share) FILTER (WHERE NOT away) OVER r, 0) AS here FROM s WINDOW r AS (PARTITION BY season, week, posteam))
SELECT season, week, posteam, receiver_id, round(vacated, 8) AS vacated, round(CASE WHEN vacated = 0 OR away THEN 0 WHEN here > 0 THEN vacated * share / here END, 8) AS pickup FROM v""")
def h7(t: Tables):
    return _vacated(t, None)


def _vacated(t: Tables, role: str | None):
    from pyspark.sql import Window

    w = plays(t).where("receiver_id IS NOT NULL").groupBy("season", "week", "posteam", "receiver_id").agg(F.count(F.lit(1)).alias("tg"))
    w = w.withColumn("share", F.col("tg") / F.sum("tg").over(Window.partitionBy("season", "week", "posteam"))).withColumn("role", F.col("receiver_id") % 3)
    got = H.vacated(w, ["season", "week", "posteam"], "share", F.col("receiver_id") % 7 == 0, role)
    return got.select("season", "week", "posteam", "receiver_id", F.round("vacated", 8).alias("vacated"), F.round("pickup", 8).alias("pickup"))


@query("h23_targets_per_route", """
WITH r AS (SELECT season, posteam, receiver_id, count(*) FILTER (WHERE qb_dropback = 1) AS routes, count(*) FILTER (WHERE pass_attempt = 1 AND sack = 0) AS targets FROM plays WHERE receiver_id IS NOT NULL GROUP BY ALL)
SELECT a.season, a.posteam, a.receiver_id, round((b.targets + 20 * 0.2::DOUBLE) / (b.routes + 20), 8) AS prior FROM r a LEFT JOIN r b ON b.season + 1 = a.season AND b.posteam = a.posteam AND b.receiver_id = a.receiver_id""")
def h23(t: Tables):
    """Targets per route of the season before, drawn to 0.2 with the weight of 20 routes."""
    r = plays(t).where("receiver_id IS NOT NULL").groupBy("season", "posteam", "receiver_id").agg(F.count_if(Y.f("qb_dropback")).alias("routes"), F.count_if(Y.is_target()).alias("targets"))
    prior = r.select((F.col("season") + 1).alias("season"), "posteam", "receiver_id", S.eb_shrink(F.col("targets"), F.col("routes"), 0.2, 20).alias("prior"))
    return r.select("season", "posteam", "receiver_id").join(prior, ["season", "posteam", "receiver_id"], "left").withColumn("prior", F.round("prior", 8))


@query("h25_charted_rates", """
WITH c AS (SELECT season, week, posteam, count(*) FILTER (WHERE air_yards < 0) AS screens, sum(ydstogo)::BIGINT AS box, count(*) AS n, max(qb_spike) = 1 AS charted FROM plays GROUP BY ALL),
o AS (SELECT *, CASE WHEN charted THEN screens END AS seen FROM c)
SELECT season, week, posteam, (sum(seen) OVER w)::BIGINT AS screens_std, (sum(box) OVER w)::DOUBLE / sum(n) OVER w AS box_mean FROM o WINDOW w AS (PARTITION BY posteam, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def h25(t: Tables):
    """Screens (0 only where charted) and box counts to date."""
    p = plays(t)
    own = p.groupBy("season", "week", "posteam").agg(F.count_if(F.col("air_yards") < 0).alias("screens"), F.sum("ydstogo").alias("box"), F.count(F.lit(1)).alias("n"))
    seen = D.charted(own, p.where("qb_spike = 1"), ["season", "week", "posteam"], "screens")
    return P.as_of_sums(seen, ["posteam", "season"], "week", ["screens", "box", "n"]).select("season", "week", "posteam", "screens_std", S.safe_ratio(F.col("box_std"), F.col("n_std")).alias("box_mean"))


@query("d18_charted", "SELECT season, week, posteam, CASE WHEN max(qb_spike) = 1 THEN count(*) FILTER (WHERE air_yards < 0) END AS screens FROM plays GROUP BY ALL")
def d18(t: Tables):
    p = plays(t)
    own = p.groupBy("season", "week", "posteam").agg(F.count_if(F.col("air_yards") < 0).alias("screens"))
    return D.charted(own, p.where("qb_spike = 1"), ["season", "week", "posteam"], "screens")


@query("d16_games_of_two_sources", """
WITH b AS (SELECT DISTINCT receiver_id AS entity, game_id FROM plays WHERE receiver_id IS NOT NULL), s AS (SELECT DISTINCT rusher_id AS entity, game_id FROM plays)
SELECT coalesce(b.entity, s.entity) AS entity, count(*) AS games, count(b.entity) AS in_box, count(s.entity) AS in_snaps FROM b FULL JOIN s ON b.entity = s.entity AND b.game_id = s.game_id GROUP BY ALL""")
def d16(t: Tables):
    p = plays(t)
    got = Y.games_from_two(p.where("receiver_id IS NOT NULL").select(F.col("receiver_id").alias("entity"), "game_id"), p.select(F.col("rusher_id").alias("entity"), "game_id"), ["entity", "game_id"])
    return got.groupBy("entity").agg(F.count(F.lit(1)).alias("games"), F.sum("in_box").cast("long").alias("in_box"), F.sum("in_snaps").cast("long").alias("in_snaps"))


@query("h6_kicker_features", """
WITH g AS (SELECT season, week, posteam AS team, passer_id AS kicker, (count(*) FILTER (WHERE yards < 30) * 3)::BIGINT AS points, count(*) FILTER (WHERE yards > 10) AS tries FROM plays GROUP BY ALL),
o AS (SELECT *, (sum(points) OVER w)::DOUBLE / count(*) OVER w AS own_ppg FROM g WINDOW w AS (PARTITION BY kicker, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT team, season, week, (sum(x) OVER w)::DOUBLE / count(*) OVER w AS team_tries FROM (SELECT team, season, week, sum(tries) AS x FROM g GROUP BY ALL) WINDOW w AS (PARTITION BY team, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT season, week, kicker, team, round(own_ppg, 8) AS own_ppg, round(team_tries, 8) AS team_tries FROM o JOIN m USING (team, season, week)""")
def h6(t: Tables):
    g = plays(t).groupBy("season", "week", F.col("posteam").alias("team"), F.col("passer_id").alias("kicker")).agg((F.count_if(F.col("yards") < 30) * 3).alias("points"), F.count_if(F.col("yards") > 10).alias("tries"))
    return Y.kicker_features(g, "season", "week").select("season", "week", "kicker", "team", F.round("own_ppg", 8).alias("own_ppg"), F.round("team_tries", 8).alias("team_tries"))


@query("h19_regulars_out", """
WITH r AS (SELECT DISTINCT posteam, season * 12 + week AS t, receiver_id FROM plays WHERE receiver_id IS NOT NULL)
SELECT posteam, t, count(*) FILTER (WHERE (receiver_id + t) % 9 = 0) AS regulars_out, count(*) FILTER (WHERE (receiver_id + t) % 9 = 1) AS regulars_questionable FROM r GROUP BY ALL""")
def h19(t: Tables):
    r = plays(t).where("receiver_id IS NOT NULL").select("posteam", (F.col("season") * 12 + F.col("week")).alias("t"), "receiver_id").distinct()
    k = (F.col("receiver_id") + F.col("t")) % 9
    state = r.select("t", "receiver_id", F.when(k == 0, "out").when(k == 1, "questionable").alias("availability")).where("availability IS NOT NULL").distinct()
    return Y.regulars_out(r, state, "posteam", "t", "receiver_id")


def _rates_sql(made: str, chances: str) -> str:
    return f"""
WITH g AS (SELECT posteam, season, week, {made} AS made, {chances} AS chances FROM plays GROUP BY ALL),
o AS (SELECT *, (sum(made) OVER w)::BIGINT AS m, (sum(chances) OVER w)::BIGINT AS c FROM g WINDOW w AS (PARTITION BY posteam, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT season, week, (sum(x) OVER w)::DOUBLE / sum(y) OVER w AS r FROM (SELECT season, week, sum(made) AS x, sum(chances) AS y FROM g GROUP BY ALL) WINDOW w AS (PARTITION BY season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT posteam, season, week, round((m - c * r) / (c + 20), 8) AS over FROM o JOIN l USING (season, week)"""


@query("h29_red_zone_over_expected", _rates_sql("count(*) FILTER (WHERE yards > 45)", "count(*) FILTER (WHERE yardline_100 <= 60)"))
def h29(t: Tables):
    return _rates(t, F.col("yards") > 45, F.col("yardline_100") <= 60)


@query("h33_returns_over_expected", _rates_sql("count(*) FILTER (WHERE air_yards > 25)", "count(*) FILTER (WHERE air_yards IS NOT NULL)"))
def h33(t: Tables):
    return _rates(t, F.col("air_yards") > 25, F.col("air_yards").isNotNull())


def _rates(t: Tables, made, chances):
    g = plays(t).groupBy("posteam", "season", "week").agg(F.count_if(made).alias("made"), F.count_if(chances).alias("chances"))
    return B.rate_over_expectation(g, ["posteam"], "season", "week", "made", "chances", 20).select("posteam", "season", "week", F.round("over", 8).alias("over"))


@query("h32_luck", """
WITH g AS (SELECT posteam, season, week, count(*) FILTER (WHERE ydstogo >= 6) AS worthy, count(*) FILTER (WHERE ydstogo = 8) AS actual, count(*) AS n FROM plays GROUP BY ALL),
o AS (SELECT *, sum(worthy) OVER w AS x, sum(actual) OVER w AS y, sum(n) OVER w AS c FROM g WINDOW w AS (PARTITION BY posteam, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT season, week, sum(x) OVER w AS lx, sum(y) OVER w AS ly, sum(c) OVER w AS lc FROM (SELECT season, week, sum(worthy) AS x, sum(actual) AS y, sum(n) AS c FROM g GROUP BY ALL) WINDOW w AS (PARTITION BY season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT posteam, season, week, round((x - c * lx::DOUBLE / lc) / (c + 30), 8) AS worthy_over, round((x - c * lx::DOUBLE / lc) / (c + 30) - (y - c * ly::DOUBLE / lc) / (c + 30), 8) AS luck FROM o JOIN l USING (season, week)""")
def h32(t: Tables):
    g = plays(t).groupBy("posteam", "season", "week").agg(F.count_if(F.col("ydstogo") >= 6).alias("worthy"), F.count_if(F.col("ydstogo") == 8).alias("actual"), F.count(F.lit(1)).alias("n"))
    return Y.luck(g, ["posteam"], "season", "week", "worthy", "actual", "n", 30).select("posteam", "season", "week", F.round("worthy_over", 8).alias("worthy_over"), F.round("luck", 8).alias("luck"))
