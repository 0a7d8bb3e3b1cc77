"""Queries over decisions, gradings, changes and quality checks derived from the panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyard.functions import scalars as S
from panelyard.operators import allocation as L
from panelyard.operators import blocks as B
from panelyard.operators import changes as C
from panelyard.operators import context as X
from panelyard.operators import evaluation as E
from panelyard.operators import exchange as XC
from panelyard.operators import fitting as M
from panelyard.operators import market as K
from panelyard.operators import probability as V
from panelyard.operators import quality as Q
from panelyard.operators import reports as R
from panelyard.operators.scratch import settled
from panelyard.plans.model_queries import FLEX, PROJ, SLOTS, cdf_sql, projections
from panelyard.plans.record_queries import LINE, OFFENSE_SQL, facts_sql, quotes, stat_lines
from panelyard.plans.registry import Tables, query

#: Seasons as rosters: every group's entities of a season with their sums, and the lineup of each.
SEASON_LINEUP = """
WITH s AS (SELECT grp, season, cat, entity, sum(pts)::BIGINT AS pts, count(*)::DOUBLE AS sd FROM facts GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY grp, season, cat ORDER BY pts DESC, entity) AS k, CASE cat WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 2 ELSE 0 END AS need FROM s),
x AS (SELECT *, k <= need AS own, k > need AND cat IN ('MACHINERY', 'HOUSEHOLD', 'FURNITURE') AS can FROM r), y AS (SELECT *, row_number() OVER (PARTITION BY grp, season, can ORDER BY pts DESC, entity) AS j FROM x),
lu AS (SELECT grp, season, cat, entity, pts, sd, CASE WHEN own THEN cat WHEN can AND j <= 2 THEN 'FLEX' END AS slot FROM y)"""


def season_lineup(t: Tables):
    s = t.facts.groupBy("grp", "season", "cat", "entity").agg(F.sum("pts").alias("pts"), F.count(F.lit(1)).cast("double").alias("sd"))
    return L.best_lineup(s, ["grp", "season"], "cat", "pts", "entity", SLOTS, FLEX, 2)


@query("l2_retained_slots", SEASON_LINEUP + " SELECT grp, season, slot, count(*) AS n FROM lu WHERE slot IS NOT NULL GROUP BY ALL")
def l2(t: Tables):
    """Starters keep the slot that they hold now; every slot is filled as often as before."""
    lu = season_lineup(t)
    can = F.when(F.col("cat").isin(*FLEX), F.array(F.col("cat"), F.lit("FLEX"))).otherwise(F.array("cat"))
    now = lu.where("slot IS NOT NULL").select("grp", "season", "entity", F.when(F.col("cat").isin(*FLEX), "FLEX").otherwise(F.col("slot")).alias("slot"))
    return R.retained(lu.withColumn("can", can), now, ["grp", "season"], "entity").groupBy("grp", "season", "slot").agg(F.count(F.lit(1)).alias("n"))


@query("l4_add_drop_board", SEASON_LINEUP + """,
p AS (SELECT cat, entity, pts FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY pts DESC, entity) AS k FROM (SELECT cat, entity, sum(pts)::BIGINT AS pts FROM facts GROUP BY ALL)) WHERE k <= 12),
w AS (SELECT grp, season, slot, min(pts) AS v, min_by(entity, (pts, entity)) AS e FROM lu WHERE slot IS NOT NULL GROUP BY ALL), f AS (SELECT entity AS a, pts, cat AS slot FROM p UNION ALL SELECT entity, pts, 'FLEX' FROM p WHERE cat IN ('MACHINERY', 'HOUSEHOLD', 'FURNITURE')),
j AS (SELECT grp, season, a, pts - v AS gain, slot, e FROM w JOIN f USING (slot) QUALIFY row_number() OVER (PARTITION BY grp, season, a ORDER BY pts - v DESC, slot DESC, e DESC) = 1), d AS (SELECT grp, season, min_by(entity, (pts, entity)) AS dr FROM lu WHERE slot IS NULL GROUP BY ALL)
SELECT grp, season, a AS "add", dr AS "drop", gain::BIGINT AS gain, slot, e AS sits, CASE WHEN gain > 0 THEN 'starts' ELSE 'depth' END AS verdict FROM j LEFT JOIN d USING (grp, season)""")
def l4(t: Tables):
    pool = t.facts.groupBy("cat", "entity").agg(F.sum("pts").alias("pts"))
    return L.add_drop_board(pool, season_lineup(t), ["grp", "season"], "cat", "pts", "entity", FLEX)


#: Season rosters with a current lineup (by months played), fixed rows and rows without a value.
HELD = """
WITH s AS (SELECT grp, season, cat, entity, CASE WHEN entity % 31 <> 0 THEN sum(pts)::BIGINT END AS pts, count(*) AS months, entity % 5 <> 0 AS movable FROM facts GROUP BY grp, season, cat, entity),
n0 AS (SELECT *, row_number() OVER (PARTITION BY grp, season, cat ORDER BY months DESC, entity) <= CASE cat WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 2 ELSE 0 END AS own FROM s),
n1 AS (SELECT *, NOT own AND cat IN ('MACHINERY', 'HOUSEHOLD', 'FURNITURE') AS can FROM n0),
h AS (SELECT * EXCLUDE (own, can), CASE WHEN own THEN cat WHEN can AND row_number() OVER (PARTITION BY grp, season, can ORDER BY months DESC, entity) <= 2 THEN 'FLEX' END AS now FROM n1)"""


def _locked_sql(rows: str, key: str, out: str) -> str:
    return f"""
{out}0 AS (SELECT *, coalesce(now IS NOT NULL AND NOT (movable AND pts IS NOT NULL), false) AS fixed FROM {rows}),
{out}1 AS (SELECT *, movable AND pts IS NOT NULL AND NOT fixed AS inn, CASE cat WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 2 ELSE 0 END - count(*) FILTER (WHERE fixed AND now = cat) OVER (PARTITION BY {key}, cat) AS need, 2 - count(*) FILTER (WHERE fixed AND now = 'FLEX') OVER (PARTITION BY {key}) AS places FROM {out}0),
{out}2 AS (SELECT *, inn AND row_number() OVER (PARTITION BY {key}, cat, inn ORDER BY pts DESC NULLS LAST, entity) <= need AS own FROM {out}1),
{out}3 AS (SELECT *, inn AND NOT own AND cat IN ('MACHINERY', 'HOUSEHOLD', 'FURNITURE') AS can FROM {out}2),
{out} AS (SELECT *, CASE WHEN fixed THEN now WHEN own THEN cat WHEN can AND row_number() OVER (PARTITION BY {key}, can ORDER BY pts DESC NULLS LAST, entity) <= places THEN 'FLEX' END AS slot FROM {out}3)"""


def held_lineups(t: Tables):
    s = t.facts.groupBy("grp", "season", "cat", "entity").agg(F.sum("pts").alias("pts"), F.count(F.lit(1)).alias("months"))
    s = s.withColumn("pts", F.when(F.col("entity") % 31 != 0, F.col("pts"))).withColumn("movable", F.col("entity") % 5 != 0)
    return L.best_lineup(s, ["grp", "season"], "cat", "months", "entity", SLOTS, FLEX, 2).withColumnRenamed("slot", "now")


LOCKED = ("cat", "pts", "entity", SLOTS, FLEX, 2, "now", "movable")


@query("l1_locked_lineup", HELD + "," + _locked_sql("h", "grp, season", "lk") + " SELECT grp, season, entity, now, slot, fixed FROM lk WHERE slot IS NOT NULL OR now IS NOT NULL")
def l1_locked(t: Tables):
    return XC.locked_lineup(held_lineups(t), ["grp", "season"], *LOCKED).where("slot IS NOT NULL OR now IS NOT NULL").select("grp", "season", "entity", "now", "slot", "fixed")


#: By filling every lineup anew for each addition and drop; of the bench the cheapest stands for all, as any of them changes nothing.
@query("l4_exchange_board", HELD + ", r AS (SELECT * FROM h WHERE grp < 20)," + _locked_sql("r", "grp, season", "lk") + """,
b AS (SELECT grp, season, coalesce(sum(pts) FILTER (WHERE slot IS NOT NULL), 0) AS base FROM lk GROUP BY ALL),
d AS (SELECT grp, season, entity AS dr, pts AS dv FROM lk WHERE inn AND slot IS NOT NULL UNION ALL SELECT grp, season, entity, pts FROM lk WHERE inn AND slot IS NULL QUALIFY row_number() OVER (PARTITION BY grp, season ORDER BY pts, entity) = 1),
f AS (SELECT season, cat, entity, pts FROM h WHERE grp >= 20 AND pts IS NOT NULL),
v AS (SELECT r.grp, r.season, dr, f.entity AS ad, r.cat, r.entity, r.pts, r.now, r.movable FROM r JOIN d USING (grp, season) JOIN f ON f.season = r.season WHERE r.entity <> dr
  UNION ALL SELECT d.grp, d.season, dr, f.entity, f.cat, f.entity, f.pts, NULL, true FROM d JOIN f USING (season)),""" + _locked_sql("v", "grp, season, dr, ad", "x") + """,
g AS (SELECT grp, season, dr, ad, coalesce(sum(pts) FILTER (WHERE slot IS NOT NULL), 0) AS now_points FROM x GROUP BY grp, season, dr, ad),
k AS (SELECT g.grp, g.season, ad, dr, now_points - base AS gain FROM g JOIN b USING (grp, season) JOIN d USING (grp, season, dr) QUALIFY row_number() OVER (PARTITION BY g.grp, g.season, ad ORDER BY now_points DESC, dv, dr) = 1),
c AS (SELECT grp, season, cat, min(pts) AS cv FROM lk WHERE inn GROUP BY ALL)
SELECT m.grp, m.season, f.entity AS "add", CASE WHEN gain IS NOT NULL THEN dr END AS "drop", gain::BIGINT AS gain, CASE WHEN gain > 0 THEN 'LINEUP' WHEN cv IS NULL THEN 'COVERAGE' WHEN f.pts > cv THEN 'RESEARCH' ELSE 'BELOW' END AS verdict
FROM (SELECT DISTINCT grp, season FROM r) m JOIN f USING (season) LEFT JOIN k ON k.grp = m.grp AND k.season = m.season AND k.ad = f.entity LEFT JOIN c ON c.grp = m.grp AND c.season = m.season AND c.cat = f.cat
WHERE f.cat IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE')""")
def l4_board(t: Tables):
    rows, key = settled(held_lineups(t), "held"), ["grp", "season"]
    own, droppable = rows.where("grp < 20"), F.col("movable") & F.col("pts").isNotNull()
    ways = XC.exchanges(own, key, *LOCKED, droppable=droppable, cheapest_bench=True)
    board = XC.add_drop_gains(rows.where("grp >= 20"), ways, key, ["season"], "cat", "pts", "entity")
    versus = F.broadcast(XC.cheapest_of_category(own, key, "cat", "pts", "entity", droppable))  # a row for each of 20 groups, a season and category
    return XC.verdicts(board, versus, key, "cat").select(*key, "add", "drop", "gain", "verdict")


@query("l7_pool_coverage", SEASON_LINEUP + " SELECT cat, count(*) FILTER (WHERE slot IS NOT NULL) AS starts, count(*) FILTER (WHERE slot IS NULL) AS depth FROM lu GROUP BY cat")
def l7(t: Tables):
    return R.coverage_of_pool(season_lineup(t).withColumn("verdict", F.when(F.col("slot").isNotNull(), "starts").otherwise("depth")), "cat", ["starts", "depth"])


LOCK_SQL = """CASE WHEN g > 1 THEN 'several games in the period' WHEN k IS NOT NULL AND k <= TIMESTAMP '1998-06-01' THEN 'started' WHEN k IS NOT NULL THEN 'not started' WHEN g = 1 THEN 'unreadable kickoff' WHEN off THEN 'off period proven' ELSE 'no game found, and none ruled out' END"""
LOCKS = f"""WITH a AS (SELECT c_custkey AS entity, c_nationkey AS team, count(o_orderkey) AS g, max(o_orderdate) FILTER (WHERE o_orderpriority <> '5-LOW') AS k, c_acctbal < 0 AS off FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-05-01' GROUP BY ALL),
lk AS (SELECT *, {LOCK_SQL} AS lock_reason FROM a), ls AS (SELECT *, CASE WHEN lock_reason = 'started' THEN 'LOCKED' WHEN lock_reason IN ('not started', 'off period proven') THEN 'OPEN' ELSE 'UNKNOWN' END AS lock FROM lk)"""


def locks(t: Tables):
    o = t.orders.where("o_orderdate >= TIMESTAMP '1998-05-01'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("g"), F.max(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))).alias("k"))
    rows = t.customer.join(o, "c_custkey", "left").fillna(0, ["g"]).select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("team"), "g", "k", (F.col("c_acctbal") < 0).alias("off"))
    return L.lock_state(rows, "k", "g", F.to_timestamp(F.lit("1998-06-01")), "off")


@query("l8_lock_states", LOCKS + " SELECT entity, lock, lock_reason FROM ls")
def l8(t: Tables):
    return locks(t).select("entity", "lock", "lock_reason")


@query("l31_decision_windows", LOCKS + " SELECT team, bool_or(lock = 'OPEN') AS open, count(*) FILTER (WHERE lock = 'UNKNOWN') AS waiting, CASE WHEN bool_or(lock = 'OPEN') THEN 7 ELSE 8 END AS decide_week FROM ls GROUP BY team")
def l31(t: Tables):
    return R.decision_window(locks(t), ["team"], 7)


@query("l9_game_of_team", "SELECT team, week, CASE WHEN g THEN 'game' WHEN week > 11 THEN 'no schedule' WHEN week = team % 12 THEN 'bye' ELSE 'no row' END AS state FROM (SELECT n_nationkey AS team, w AS week FROM nation, range(1, 13) r(w)) LEFT JOIN (SELECT DISTINCT c_nationkey AS team, month(o_orderdate) AS week, true AS g FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 400000) USING (team, week)")
def l9(t: Tables):
    teams = t.nation.select(F.col("n_nationkey").alias("team"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("week"))
    games = t.orders.where("o_totalprice > 400000").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select(F.col("c_nationkey").alias("team"), F.month("o_orderdate").alias("week")).distinct()
    proofs = t.nation.select(F.col("n_nationkey").alias("team"), F.array(F.col("n_nationkey") % 12).alias("off_periods"))
    return X.game_of_team(teams, games, proofs, F.col("week") <= 11).select("team", "week", "state")


@query("l11_next_in_line", """
WITH v AS (SELECT entity AS away, grp AS team, cat AS category FROM facts GROUP BY ALL HAVING sum(returns) > 12), ch AS (SELECT DISTINCT entity, grp AS team, cat AS category, (entity % 4)::INT AS depth FROM facts), wk AS (SELECT entity, sum(lines)::BIGINT AS work FROM facts GROUP BY entity)
SELECT team, category, away, entity FROM v JOIN ch USING (team, category) LEFT JOIN wk USING (entity) WHERE entity <> away QUALIFY row_number() OVER (PARTITION BY team, category, away ORDER BY depth, work DESC NULLS LAST, entity) <= 2""")
def l11(t: Tables):
    f = t.facts
    v = f.groupBy("entity", F.col("grp").alias("team"), F.col("cat").alias("category")).agg(F.sum("returns").alias("r")).where("r > 12").drop("r")
    ch = f.select("entity", F.col("grp").alias("team"), F.col("cat").alias("category"), (F.col("entity") % 4).alias("depth")).distinct()
    return R.behind(v, ch, f.groupBy("entity").agg(F.sum("lines").alias("work"))).select("team", "category", "away", "entity")


@query("l14_notable_free", """
WITH s AS (SELECT entity, any_value(cat) AS category, count(*) AS games, sum(pts)::DOUBLE / count(*) AS ppg FROM facts GROUP BY entity), rk AS (SELECT *, CASE WHEN games >= 4 THEN rank() OVER (PARTITION BY category, games >= 4 ORDER BY ppg DESC) END AS rank FROM s),
j AS (SELECT *, list_filter([CASE WHEN rank <= CASE category WHEN 'BUILDING' THEN 10 WHEN 'MACHINERY' THEN 20 ELSE 0 END THEN 'starter' END, CASE WHEN dropped_at >= TIMESTAMP '1998-05-22' THEN 'dropped' END], lambda x: x IS NOT NULL) AS why FROM rk LEFT JOIN (SELECT o_custkey AS entity, max(o_orderdate) AS dropped_at FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) USING (entity) WHERE entity NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000))
SELECT entity, rank, why FROM j WHERE len(why) > 0""")
def l14(t: Tables):
    s = t.facts.groupBy("entity").agg(F.min("cat").alias("category"), F.count(F.lit(1)).alias("games"), (F.sum("pts") / F.count(F.lit(1))).alias("ppg"))
    drops = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("entity")).agg(F.max("o_orderdate").alias("dropped_at"))
    held = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("entity"))
    return R.notable_free(s, drops, held, F.to_timestamp(F.lit("1998-06-01")), {"BUILDING": 10, "MACHINERY": 20}).select("entity", "rank", "why")


@query("l15_latest_drops", "SELECT o_custkey AS entity, max(o_orderdate) AS dropped_at, count(DISTINCT o_orderdate) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def l15(t: Tables):
    x = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("roster_id"), F.when(F.col("o_orderstatus") == "F", "drop").otherwise("add").alias("action"))
    n = x.where("action = 'drop'").groupBy("entity").agg(F.countDistinct("at").alias("n"))
    return L.latest_drop(x, "entity", "at").join(n, "entity").select("entity", "dropped_at", "n")


@query("l17_reserve_traps", "SELECT c_custkey AS entity FROM customer WHERE c_acctbal < 2000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def l17(t: Tables):
    ro = t.customer.select(F.col("c_custkey").alias("entity"), (F.col("c_acctbal") < 2000).alias("on_reserve"))
    return R.reserve_traps(ro, t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("tag")), ["1-URGENT", "2-HIGH"]).select("entity")


@query("l19_gated_actions", """
WITH src AS (SELECT event_type AS source, max(ts) AS as_of, CASE WHEN max(event_id) % 2 = 0 THEN 'FRESH' ELSE 'STALE' END AS state, max(ts) + INTERVAL 6 HOUR AS expires FROM events GROUP BY 1), need AS (SELECT DISTINCT user_id AS action, event_type AS source FROM events)
SELECT action, bool_and(coalesce(state = 'FRESH', false)) AS allowed, coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE state <> 'FRESH'), '') AS blocked_by, min(expires) AS first_expiry FROM need LEFT JOIN src USING (source) GROUP BY action""")
def l19(t: Tables):
    e = t.events
    src = e.groupBy(F.col("event_type").alias("source")).agg(F.when(F.max("event_id") % 2 == 0, "FRESH").otherwise("STALE").alias("state"), (F.max("ts") + F.expr("INTERVAL 6 HOURS")).alias("expires"))
    need = e.select(F.col("user_id").alias("action"), F.col("event_type").alias("source")).distinct()
    return L.gate(need.select("action").distinct(), need, src)


@query("l21_absent_reasons", "SELECT c_custkey AS entity, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN NULL WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'absent from a complete feed' ELSE 'feed incomplete' END AS abstain FROM customer")
def l21(t: Tables):
    rows = t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("category"))
    complete = rows.select("category").distinct().withColumn("is_complete", F.col("category").isin("BUILDING", "MACHINERY"))
    return R.absent_reason(rows, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("entity")), complete).select("entity", "abstain")


@query("l23_newest_statements", "SELECT user_id, event_type, max(ts) AS built_at FROM events GROUP BY ALL")
def l23(t: Tables):
    return R.newest_statement(t.events.select("user_id", "event_type", F.col("ts").alias("built_at")), ["user_id", "event_type"])


STATUS = """WITH st AS (SELECT c_custkey AS entity, CASE WHEN c_acctbal < 3000 THEN 'LOCKED' WHEN c_acctbal < 9000 THEN 'OPEN' END AS lock, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'out' END AS availability FROM customer)"""


def status(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("entity"), F.when(F.col("c_acctbal") < 3000, "LOCKED").when(F.col("c_acctbal") < 9000, "OPEN").alias("lock"), F.when(F.col("c_mktsegment") == "FURNITURE", "out").alias("availability"))


@query("l25_judged_again", STATUS + ", a AS (SELECT o_orderkey, o_custkey AS i, (o_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS o FROM orders) SELECT o_orderkey, CASE WHEN x.availability = 'out' THEN 'withdrawn: not playing' WHEN x.lock = 'LOCKED' OR y.lock = 'LOCKED' THEN 'too late' WHEN x.lock IS NULL OR y.lock IS NULL THEN 'unknown' ELSE 'stands' END AS now FROM a LEFT JOIN st x ON x.entity = a.i LEFT JOIN st y ON y.entity = a.o")
def l25(t: Tables):
    n = t.customer.count()
    a = t.orders.select("o_orderkey", F.col("o_custkey").alias("into"), ((F.col("o_custkey") * 7 + 3) % n).alias("out"))
    return R.judged_again(a, status(t)).select("o_orderkey", "now")


TREND = """, tr AS (SELECT entity, CASE WHEN n < 3 OR earlier = 0 THEN 'UNKNOWN' WHEN recent / earlier >= 1.25 THEN 'RISING' WHEN recent / earlier <= 0.75 THEN 'FALLING' ELSE 'STEADY' END AS trend FROM (SELECT entity, count(*) AS n, sum(lines) FILTER (k <= 2)::DOUBLE / 2 AS recent, coalesce(sum(lines) FILTER (k > 2)::DOUBLE / nullif(count(*) FILTER (k > 2), 0), 0) AS earlier FROM (SELECT entity, lines, row_number() OVER (PARTITION BY entity ORDER BY t DESC) AS k FROM facts) WHERE k <= 4 GROUP BY entity) WHERE n >= 3)"""


@query("l27_against_trend", SEASON_LINEUP + TREND + """, b AS (SELECT grp, season, entity AS i, pts, cat AS slot FROM lu WHERE slot IS NULL UNION ALL SELECT grp, season, entity, pts, 'FLEX' FROM lu WHERE slot IS NULL AND cat IN ('MACHINERY', 'HOUSEHOLD', 'FURNITURE')),
sw AS (SELECT b.grp, b.season, b.i, o.entity AS o FROM b JOIN lu o ON o.grp = b.grp AND o.season = b.season AND o.slot = b.slot QUALIFY row_number() OVER (PARTITION BY b.grp, b.season, b.i ORDER BY b.pts - o.pts DESC, o.entity) = 1),
v AS (SELECT entity, trend, CASE trend WHEN 'FALLING' THEN 0 WHEN 'STEADY' THEN 1 WHEN 'RISING' THEN 2 END AS n FROM tr)
SELECT grp, season, i AS "into", o AS "out", x.trend AS into_trend, y.trend AS out_trend FROM sw JOIN v x ON x.entity = i JOIN v y ON y.entity = o WHERE x.n < y.n""")
def l27(t: Tables):
    sw = L.swaps(season_lineup(t), ["grp", "season"], "cat", "pts", "sd", "entity", FLEX)
    return R.against_trend(sw, L.usage_trend(t.facts, "entity", "t", "lines")).select("grp", "season", "into", "out", "into_trend", "out_trend")


@query("l28_optimiser_rows", STATUS + " SELECT c_custkey AS platform_id, s_nationkey AS entity, n AS projection, r_name AS lock FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN (SELECT l_suppkey % 25 AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = s_nationkey LEFT JOIN region ON r_regionkey = c_nationkey")
def l28(t: Tables):
    pool = t.customer.select(F.col("c_custkey").alias("platform_id"), F.col("c_nationkey").alias("team"))
    cw = t.supplier.select(F.col("s_suppkey").alias("platform_id"), F.col("s_nationkey").alias("entity"))
    proj = t.lineitem.groupBy((F.col("l_suppkey") % 25).cast("int").alias("entity")).agg(F.count(F.lit(1)).alias("projection"))
    return B.optimiser_rows(pool, cw, proj, t.region.select(F.col("r_regionkey").alias("team"), F.col("r_name").alias("lock"))).select("platform_id", "entity", "projection", "lock")


ACTIONS = """, sw AS (SELECT b.grp, b.season, 'swap' AS kind, b.i, o.entity AS o, b.slot, b.pts - o.pts AS gain FROM (SELECT grp, season, entity AS i, pts, cat AS slot FROM lu WHERE slot IS NULL UNION ALL SELECT grp, season, entity, pts, 'FLEX' FROM lu WHERE slot IS NULL AND cat IN ('MACHINERY', 'HOUSEHOLD', 'FURNITURE')) b JOIN lu o ON o.grp = b.grp AND o.season = b.season AND o.slot = b.slot
  QUALIFY row_number() OVER (PARTITION BY b.grp, b.season, b.i ORDER BY b.pts - o.pts DESC, o.entity) = 1), ac AS (SELECT grp * 10000 + season AS team, kind, i, o, slot, gain FROM sw), ko AS (SELECT o_custkey AS e, max(o_orderdate) AS k FROM orders GROUP BY 1)"""


def actions(t: Tables):
    sw = L.swaps(season_lineup(t), ["grp", "season"], "cat", "pts", "sd", "entity", FLEX).withColumn("team", F.col("grp") * 10000 + F.col("season"))
    none = t.spark.createDataFrame([], "team int, add long, sits long, slot string, gain long")
    return B.action_table(sw, none, t.orders.groupBy(F.col("o_custkey").alias("entity")).agg(F.max("o_orderdate").alias("kickoff")), "team")


@query("l30_action_table", SEASON_LINEUP + ACTIONS + """ SELECT team, i AS "into", o AS "out", slot, gain::BIGINT AS gain, least(a.k, b.k) AS deadline, lead(i) OVER (PARTITION BY team, slot ORDER BY gain DESC, i) AS fallback, row_number() OVER (PARTITION BY team ORDER BY least(a.k, b.k) NULLS FIRST, gain DESC, i) AS place FROM ac LEFT JOIN ko a ON a.e = i LEFT JOIN ko b ON b.e = o""")
def l30(t: Tables):
    return actions(t).select("team", "into", "out", "slot", "gain", "deadline", "fallback", "place")


@query("l33_game_day", SEASON_LINEUP + """, ev AS (SELECT DISTINCT o_custkey AS entity, year(o_orderdate)::INT AS season FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT grp, season, cat, entity, pts, slot FROM lu), lw AS (SELECT grp, season, cat, min(pts) AS low FROM b WHERE slot IS NOT NULL GROUP BY ALL)
SELECT grp, season, count(*) FILTER (WHERE slot IS NOT NULL) AS starters, sum(pts) FILTER (WHERE slot IS NOT NULL AND ev.entity IS NOT NULL)::BIGINT AS final_points, count(*) FILTER (WHERE slot IS NOT NULL AND ev.entity IS NULL) AS to_come, count(*) FILTER (WHERE slot IS NULL AND pts > low) AS outscored FROM b LEFT JOIN ev USING (entity, season) LEFT JOIN lw USING (grp, season, cat) GROUP BY ALL""")
def l33(t: Tables):
    """Each side's starters by game state, with the facts of the bench."""
    lu = season_lineup(t)
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("season")).distinct().withColumn("state", F.lit("final"))
    return B.game_day(lu.withColumnRenamed("pts", "points"), done, ["grp", "season"], "cat")


@query("l32_candidate_records", SEASON_LINEUP + " SELECT grp, season, entity, cat, slot, pts, 'v1' AS built_with, 64 AS digest_length FROM lu")
def l32(t: Tables):
    got = B.candidate_record(season_lineup(t), {"built_with": F.lit("v1")})
    return got.select("grp", "season", "entity", "cat", "slot", "pts", "built_with", F.length("digest").alias("digest_length"))


@query("l34_free_and_better", """
WITH o AS (SELECT entity, any_value(cat) AS category, any_value(grp) AS owner, sum(pts)::BIGINT AS total FROM facts GROUP BY entity), h AS (SELECT entity, owner FROM o WHERE owner < 20), m AS (SELECT category, min(total) AS my_least FROM o WHERE owner = 7 GROUP BY category)
SELECT entity, category, total, my_least FROM o JOIN m USING (category) WHERE total > my_least AND entity NOT IN (SELECT entity FROM h)""")
def l34(t: Tables):
    o = t.facts.groupBy("entity").agg(F.min("cat").alias("category"), F.min("grp").alias("owner"), F.sum("pts").alias("total"))
    usage = L.usage_trend(t.facts, "entity", "t", "lines")
    return B.review(usage, o.where("owner < 20").select("entity", "owner"), 7, o.select("entity", "category", "total"))["free_better"].select("entity", "category", "total", "my_least")


@query("l35_slots_of", "SELECT league_id, place, entity, list_extract(['A', 'B', 'C'], place + 1) AS slot FROM (SELECT o_orderkey AS league_id, entity, (row_number() OVER (PARTITION BY o_orderkey ORDER BY entity) - 1)::INT AS place FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey AS entity FROM lineitem))")
def l35(t: Tables):
    ro = t.lineitem.groupBy(F.col("l_orderkey").alias("league_id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("starters"))
    return L.slots_of(ro, ["league_id"], "starters", ["A", "B", "C"])


# ---------------------------------------------------------------- changes and quality


@query("c2_comparable", "SELECT (SELECT count(DISTINCT c_mktsegment) FROM customer) = 1 AS comparable, ['segment', 'size'] AS differs")
def c2(t: Tables):
    a = t.customer.select(F.col("c_mktsegment").alias("segment"), F.lit("x").alias("version"), F.lit(1).alias("size"))
    return C.comparable(a, a.withColumn("size", F.lit(2)), ["segment", "version", "size"])


@query("c3_source_stamps", """
WITH a AS (SELECT user_id AS source, max(ts) AS a FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id AS source, max(ts) AS b FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT source, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'new' WHEN b > a THEN 'refreshed' WHEN b < a THEN 'older' ELSE 'unchanged' END AS state FROM a FULL JOIN b USING (source)""")
def c3(t: Tables):
    s = lambda kind: t.events.where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("source")).agg(F.max("ts").alias("as_of"))
    return C.source_stamps(s("click"), s("error"))


YEARS = "WITH a AS (SELECT entity, sum(qty)::BIGINT AS qty, count(*) AS games FROM facts WHERE season = 1995 GROUP BY 1), b AS (SELECT entity, sum(qty)::BIGINT AS qty, count(*) AS games FROM facts WHERE season = 1996 GROUP BY 1), la AS (SELECT entity, 'qty' AS field, qty::VARCHAR AS v FROM a UNION ALL SELECT entity, 'games', games::VARCHAR FROM a), lb AS (SELECT entity, 'qty' AS field, qty::VARCHAR AS v FROM b UNION ALL SELECT entity, 'games', games::VARCHAR FROM b)"


def year(t: Tables, season: int):
    return t.facts.where(F.col("season") == season).groupBy("entity").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("games"))


@query("c4_transitions", YEARS + ' SELECT entity, field, la.v AS old, lb.v AS "new" FROM la FULL JOIN lb USING (entity, field) WHERE la.v IS DISTINCT FROM lb.v')
def c4(t: Tables):
    return B.transitions(year(t, 1995), year(t, 1996), ["entity"], ["qty", "games"])


@query("c5_settings_diff", YEARS + """ SELECT entity, field AS setting, la.v AS old, lb.v AS "new", CASE WHEN la.v IS NULL THEN 'set' WHEN lb.v IS NULL THEN 'unset' ELSE 'changed' END AS change FROM la FULL JOIN lb USING (entity, field) WHERE la.v IS DISTINCT FROM lb.v""")
def c5(t: Tables):
    m = lambda df: df.select("entity", F.create_map(F.lit("qty"), F.col("qty").cast("string"), F.lit("games"), F.col("games").cast("string")).alias("settings"))
    return C.settings_diff(m(year(t, 1995)), m(year(t, 1996)), "entity", "settings")


@query("c6_visible_events", """
WITH e AS (SELECT user_id, ts, max(event_type) AS event_type FROM events GROUP BY ALL), g AS (SELECT *, lag(event_type) OVER w AS was, lag(ts) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, ts, event_type FROM g WHERE before IS NOT NULL AND event_type IS DISTINCT FROM was AND ts > TIMESTAMP '2024-01-03 00:00:00'""")
def c6(t: Tables):
    e = t.events.groupBy("user_id", "ts").agg(F.max("event_type").alias("event_type"))
    return C.visible_events(e, ["user_id"], "ts", "event_type", F.to_timestamp(F.lit("2024-01-05 00:00:00")))


@query("q6_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q6(t: Tables):
    return Q.repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("q7_filed", "SELECT g.grp, g.season, EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = g.grp AND year(o_orderdate) = g.season AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000) AS filed FROM (SELECT DISTINCT grp, season FROM facts) g")
def q7(t: Tables):
    rep = t.orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("grp")), "o_custkey").select("grp", F.year("o_orderdate").alias("season"))
    return Q.filed(t.facts.select("grp", "season").distinct(), rep, ["season"], "grp").select("grp", "season", "filed")


@query("q12_degradations", """
WITH s AS (SELECT user_id AS source, CASE WHEN max(ts) < TIMESTAMP '2024-01-28' THEN 'STALE' ELSE 'FRESH' END AS state FROM events GROUP BY 1), g AS (SELECT user_id AS source, CASE WHEN count(DISTINCT event_type) < 5 THEN count(DISTINCT event_type)::VARCHAR ELSE '' END AS missing FROM events GROUP BY 1)
SELECT source, state AS fault, 'too old' AS reason FROM s WHERE state <> 'FRESH' UNION ALL SELECT source, 'GAPPED', 'periods ' || missing FROM g WHERE missing <> ''""")
def q12(t: Tables):
    e = t.events.groupBy(F.col("user_id").alias("source"))
    s = e.agg(F.when(F.max("ts") < F.to_timestamp(F.lit("2024-01-28")), "STALE").otherwise("FRESH").alias("state")).withColumn("reason", F.lit("too old"))
    n = F.countDistinct("event_type")
    return R.degradations(s, e.agg(F.when(n < 5, n.cast("string")).otherwise("").alias("missing")))


@query("q13_pull_check", "SELECT event_type AS source, count(*) AS n, CASE WHEN event_type = 'click' THEN 2 ELSE 0 END AS terms_missing FROM events GROUP BY 1")
def q13(t: Tables):
    m = t.events.groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    gaps = m.where("source = 'click'").select("source", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("term"))
    return B.pull_check(m, gaps)


@query("q14_held_out_coverage", "SELECT season, 'returns' AS column_name, count(*) FILTER (WHERE returns > 0)::DOUBLE / count(*) AS coverage FROM facts WHERE season >= 1997 GROUP BY season UNION ALL SELECT season, 'lines', count(*) FILTER (WHERE lines > 2)::DOUBLE / count(*) FROM facts WHERE season >= 1997 GROUP BY season")
def q14(t: Tables):
    rows = t.facts.select("season", F.when(F.col("returns") > 0, F.col("returns")).alias("returns"), F.when(F.col("lines") > 2, F.col("lines")).alias("lines"))
    return B.held_out_coverage(rows, "season", ["returns", "lines"], F.col("season") >= 1997)


# ---------------------------------------------------------------- evaluation


@query("e8_better_in_every_fold", PROJ + """, c AS (SELECT season, actual, sys_mean, sys_eb FROM pj WHERE sys_mean IS NOT NULL AND sys_eb IS NOT NULL), f AS (SELECT season, avg(abs(sys_mean - actual)) AS a, avg(abs(sys_eb - actual)) AS b FROM c GROUP BY season)
SELECT count(*) AS folds, count(*) FILTER (WHERE b < a) AS better FROM f""")
def e8(t: Tables):
    p = projections(t).where("sys_mean IS NOT NULL AND sys_eb IS NOT NULL")
    err = E.errors(p, ["sys_mean", "sys_eb"], "actual", ["season"]).where("season IS NOT NULL")
    f = err.groupBy("season").pivot("system", ["sys_mean", "sys_eb"]).agg(F.max("mae"))
    return f.agg(F.count(F.lit(1)).alias("folds"), F.count_if(F.col("sys_eb") < F.col("sys_mean")).alias("better"))


@query("e10_z_statistics", PROJ + """, z AS (SELECT actual, sys_mean, (actual - sys_mean) / 150 AS z FROM pj WHERE sys_mean IS NOT NULL), m AS (SELECT median(z) AS med FROM z)
SELECT count(*) AS n, round(stddev_samp(z), 6) AS sd, round(median(abs(z - med)) * 1.4826, 6) AS robust_sd, round(regr_slope(actual, sys_mean), 6) AS slope, round(corr(sys_mean, actual), 6) AS r FROM z, m""")
def e10(t: Tables):
    p = projections(t).where("sys_mean IS NOT NULL")
    got = R.z_statistics(p, (F.col("actual") - F.col("sys_mean")) / 150, "sys_mean", "actual")
    return got.select("n", *[F.round(c, 6).alias(c) for c in ("sd", "robust_sd", "slope", "r")])


@query("e14_distribution_folds", PROJ + """, f AS (SELECT season, count(*) AS n, avg(abs(sys_mean - actual)) AS a, avg(abs(sys_eb - actual)) AS b FROM pj WHERE sys_mean IS NOT NULL AND sys_eb IS NOT NULL GROUP BY season) SELECT season, n, round(a, 6) AS plain, round(b, 6) AS shrunk, bool_and(b < a) OVER () AS shrunk_better FROM f""")
def e14(t: Tables):
    p = projections(t).where("sys_mean IS NOT NULL AND sys_eb IS NOT NULL")
    got = B.distribution_folds(p, "season", {"plain": F.abs(F.col("sys_mean") - F.col("actual")), "shrunk": F.abs(F.col("sys_eb") - F.col("actual"))})
    return got.select("season", "n", F.round("plain", 6).alias("plain"), F.round("shrunk", 6).alias("shrunk"), "shrunk_better")


@query("e16_availability_scores", "WITH s AS (SELECT p_partkey AS entity, k AS pick, 1.0 / (1 + k / (p_size + 1.0)) AS p, CASE WHEN p_size < 40 THEN p_size END AS taken FROM part, (VALUES (5), (20), (45)) v(k)) SELECT count(*) AS n, round(avg((p - CASE WHEN taken IS NULL OR taken >= pick THEN 1 ELSE 0 END) ** 2), 8) AS brier FROM s")
def e16(t: Tables):
    s = t.part.select(F.col("p_partkey").alias("entity"), "p_size", F.explode(F.array(F.lit(5), F.lit(20), F.lit(45))).alias("pick")).withColumn("p", 1.0 / (1 + F.col("pick") / (F.col("p_size") + 1.0)))
    return R.availability_scores(s.select("entity", "pick", "p"), t.part.where("p_size < 40").select(F.col("p_partkey").alias("entity"), F.col("p_size").alias("pick_taken"))).withColumn("brier", F.round("brier", 8))


@query("e19_adjustments", PROJ + """, d AS (SELECT cat, sys_eb - sys_mean AS d, actual - sys_mean AS m FROM pj WHERE sys_mean IS NOT NULL AND sys_eb IS NOT NULL) SELECT cat, count(*) AS n, round(avg(abs(d)), 6) AS mean_size, round(corr(d, m), 6) AS r, round(regr_slope(m, d), 6) AS slope, round(count(*) FILTER (WHERE sign(d) = sign(m))::DOUBLE / nullif(count(*) FILTER (WHERE d <> 0), 0), 6) AS right_way FROM d GROUP BY cat""")
def e19(t: Tables):
    p = projections(t).where("sys_mean IS NOT NULL AND sys_eb IS NOT NULL")
    return R.adjustments(p, "sys_mean", "sys_eb", "actual", ["cat"]).select("cat", "n", *[F.round(c, 6).alias(c) for c in ("mean_size", "r", "slope", "right_way")])


GRADED = PROJ + """, g AS (SELECT season, period AS week, count(*) AS rows, avg(abs(sys_mean - actual)) AS m, avg(abs(sys_eb - actual)) AS e, avg((sys_mean > 400)::INT) AS mp, avg((sys_eb > 400)::INT) AS ep FROM pj WHERE sys_mean IS NOT NULL AND sys_eb IS NOT NULL GROUP BY ALL)"""


def graded(t: Tables):
    p = projections(t).where("sys_mean IS NOT NULL AND sys_eb IS NOT NULL")
    hit = lambda s: F.avg((F.col(s) > 400).cast("int"))
    mae = lambda s: F.avg(F.abs(F.col(s) - F.col("actual")))
    return p.groupBy("season", F.col("period").alias("week")).agg(F.count(F.lit(1)).alias("rows"), mae("sys_mean").alias("mean_mae"), mae("sys_eb").alias("eb_mae"), hit("sys_mean").alias("mean_pairwise"), hit("sys_eb").alias("eb_pairwise"))


@query("e21_season_card", GRADED + " SELECT season, count(*) AS weeks, (sum(rows) * 2)::BIGINT AS pairs, round(sum(mp * rows) / sum(rows), 6) AS mean_pairwise, round(sum(m * rows) / sum(rows), 6) AS mean_mae, round(sum(e * rows) / sum(rows), 6) AS eb_mae FROM g GROUP BY season")
def e21(t: Tables):
    g = graded(t).withColumn("pairs", F.col("rows") * 2)
    twice = g.withColumn("graded_at", F.lit(2)).unionByName(g.withColumn("graded_at", F.lit(1)).withColumn("mean_mae", F.lit(0.0)))
    return R.card(twice, ["mean", "eb"]).select("season", "weeks", "pairs", *[F.round(c, 6).alias(c) for c in ("mean_pairwise", "mean_mae", "eb_mae")])


@query("e29_ledger_rows", GRADED + " SELECT season, week, round(mp, 6) AS mean_pairwise, round(m, 6) AS mean_mae, round(ep, 6) AS eb_pairwise, round(e, 6) AS eb_mae FROM g")
def e29(t: Tables):
    g = graded(t)
    long = g.select("season", "week", F.inline(F.array(*[F.struct(F.lit(s).alias("system"), F.col(f"{s}_pairwise").alias("pairwise"), F.col(f"{s}_mae").alias("mae")) for s in ("mean", "eb")])))
    return R.ledger_row(long, ["mean", "eb"]).select("season", "week", *[F.round(c, 6).alias(c) for c in ("mean_pairwise", "mean_mae", "eb_pairwise", "eb_mae")])


@query("e24_roll_up", GRADED + " SELECT season AS name, count(*) AS folds, count(*) FILTER (WHERE ep > mp AND e < m) AS better, round(avg(ep - mp), 6) AS pairwise_gain, round(avg(e - m), 6) AS mae_change, bool_and(ep > mp AND e < m) AS accepted FROM g GROUP BY 1")
def e24(t: Tables):
    folds = graded(t).groupBy(F.col("season").alias("name")).agg(F.collect_list(F.struct(F.col("eb_pairwise").alias("pairwise"), F.col("mean_pairwise").alias("base_pairwise"), F.col("eb_mae").alias("mae"), F.col("mean_mae").alias("base_mae"))).alias("folds"))
    return R.roll_up(folds).select("name", "folds", "better", F.round("pairwise_gain", 6).alias("pairwise_gain"), F.round("mae_change", 6).alias("mae_change"), "accepted")


@query("e23_theory_scores", PROJ + """, x AS (SELECT cat, actual AS y, sys_mean - 150 AS lo, sys_mean AS mid, sys_mean + 150 AS hi FROM pj WHERE sys_mean IS NOT NULL)
SELECT cat, count(*) AS n, round(avg(CASE WHEN y >= mid THEN 0.5 * (y - mid) ELSE 0.5 * (mid - y) END), 6) AS pinball_mid, round(avg((y >= lo AND y <= hi)::INT), 6) AS covered, round(avg(hi - lo), 6) AS width FROM x GROUP BY cat""")
def e23(t: Tables):
    p = projections(t).where("sys_mean IS NOT NULL").withColumn("lo", F.col("sys_mean") - 150).withColumn("hi", F.col("sys_mean") + 150)
    return R.theory_scores(p, "actual", "lo", "sys_mean", "hi", ["cat"]).select("cat", "n", *[F.round(c, 6).alias(c) for c in ("pinball_mid", "covered", "width")])


@query("e25_subset_metrics", PROJ + """, c AS (SELECT *, 'high' AS s FROM pj WHERE sys_mean IS NOT NULL AND sys_mean > 400 UNION ALL SELECT *, 'all' FROM pj WHERE sys_mean IS NOT NULL) SELECT s AS subset, count(*) AS n, round(avg(abs(sys_mean - actual)), 6) AS mae FROM c GROUP BY s""")
def e25(t: Tables):
    p = projections(t).where("sys_mean IS NOT NULL")
    got = B.subset_metrics(p, ["sys_mean"], "actual", {"high": F.col("sys_mean") > 400, "all": F.lit(True)}, ["cat", "t"])
    return got.select("subset", "n", F.round("mae", 6).alias("mae"))


@query("e30_eligible_pool", "SELECT o_orderkey FROM orders JOIN (SELECT o_custkey AS team, month(o_orderdate) AS week, max(o_orderdate) AS k FROM orders GROUP BY ALL) ON team = o_custkey AND week = month(o_orderdate) WHERE k > o_orderdate")
def e30(t: Tables):
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("team"), F.month("o_orderdate").alias("week"), F.col("o_orderdate").alias("built_at"))
    return R.eligible_pool(o, o.groupBy("team", "week").agg(F.max("built_at").alias("kickoff")), "built_at").select("o_orderkey")


# ---------------------------------------------------------------- probability


@query("p15_survival", f"""
WITH a AS (SELECT p_partkey, p_retailprice / 40 AS adp FROM part), z AS (SELECT p_partkey, (4 - 0.5 - adp) / greatest(1.0::DOUBLE, 0.57 + 0.11 * adp) AS z0, (20 - 0.5 - adp) / greatest(1.0::DOUBLE, 0.57 + 0.11 * adp) AS z1 FROM a), b AS (SELECT p_partkey, {cdf_sql('-z0')} AS now, {cdf_sql('-z1')} AS later FROM z)
SELECT p_partkey, round(CASE WHEN now > 1e-12 THEN least(later / now, 1) END, 7) AS p20 FROM b""")
def p15(t: Tables):
    return t.part.select("p_partkey", F.round(F.when(S.availability(F.lit(4), F.col("p_retailprice") / 40) > 1e-12, S.survival(F.lit(20), F.lit(4), F.col("p_retailprice") / 40)), 7).alias("p20"))


@query("p16_exchange", "SELECT entity, t, round(qty * exp(-(((qty - 30) / sqrt(2.0::DOUBLE * 400)) ** 2) / 2) * 0.3989422804014327 / sqrt(2.0::DOUBLE * 400), 9) AS worth FROM facts")
def p16(t: Tables):
    return t.facts.select("entity", "t", F.round(B.exchange(F.col("qty"), S.leverage(F.col("qty"), F.lit(20.0), F.lit(30), F.lit(20.0))), 9).alias("worth"))


MATCHUPS = PROJ + """, sd AS (SELECT season, t, (grp // 2)::INT AS game, (grp % 2)::INT AS side, sum(sys_mean) AS mean, sqrt(count(*) * 900.0) AS sd, sum(actual) AS actual, count(*) FILTER (WHERE sys_mean IS NULL) AS gaps FROM pj GROUP BY ALL),
mu AS (SELECT a.season, a.t, a.game, a.mean, a.sd, a.actual, b.mean AS mean_b, b.sd AS sd_b, b.actual AS actual_b, a.gaps + b.gaps AS gaps FROM sd a JOIN sd b ON a.t = b.t AND a.game = b.game AND a.side = 0 AND b.side = 1)"""


def history(t: Tables):
    s = projections(t).select("season", "t", F.floor(F.col("grp") / 2).cast("int").alias("game"), (F.col("grp") % 2).alias("side"), F.col("sys_mean").alias("projection"), F.lit(30.0).alias("spread"), "actual")
    return B.historical_matchups(s, ["season", "t", "game"])[0]


@query("p17_historical_matchups", MATCHUPS + " SELECT season, t, game, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean_b, 6) AS mean_b, CASE WHEN actual > actual_b THEN 1.0 WHEN actual < actual_b THEN 0.0 ELSE 0.5 END::DOUBLE AS won FROM mu WHERE gaps = 0")
def p17(t: Tables):
    return history(t).select("season", "t", "game", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("mean_b", 6).alias("mean_b"), "won")


@query("p18_calibration_study")
def p18(t: Tables):
    return B.calibration_study(history(t), "season", [0.5, 1.0, 2.0]).select("season", "n", "factor", F.round("log_loss", 6).alias("log_loss"))


@query("p19_checkpoint_clock", "SELECT season, week, k AS checkpoint, f + to_minutes(m::BIGINT) AS at_time FROM (SELECT year(o_orderdate)::INT AS season, month(o_orderdate)::INT AS week, min(o_orderdate) AS f FROM orders GROUP BY ALL), (VALUES (0, 0), (1, 90), (2, 600)) v(k, m)")
def p19(t: Tables):
    g = t.orders.select(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), F.col("o_orderdate").alias("k"))
    return B.checkpoint_clock(g, ["season", "week"], "k", [0, 1.5, 10]).withColumnRenamed("at", "at_time")


@query("h8_quarterback_change", """
WITH c AS (SELECT o_custkey AS entity, l_suppkey % 5 AS passer, year(o_orderdate)::INT AS season, month(o_orderdate)::INT AS week, c_nationkey AS team, count(*) AS own, 20 AS team_n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
s AS (SELECT team, season, week, min(passer) AS passer FROM c GROUP BY ALL), ch AS (SELECT *, lag(passer) OVER (PARTITION BY team, season ORDER BY week) <> passer AS changed FROM s)
SELECT c.entity, c.season, c.week, any_value(ch.passer) AS passer, any_value(ch.changed) AS changed FROM c JOIN ch USING (team, season, week) GROUP BY ALL""")
def h8(t: Tables):
    who = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team"))
    l = t.lineitem.join(t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").join(who, "o_custkey")
    c = l.groupBy(F.col("o_custkey").alias("entity"), (F.col("l_suppkey") % 5).alias("passer"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), "team").agg(F.count(F.lit(1)).alias("own")).withColumn("team_n", F.lit(20))
    s = c.groupBy("team", "season", "week").agg(F.min("passer").alias("passer"))
    return B.quarterback_change(s, c, "season", "week").select("entity", "season", "week", "passer", "changed")


@query("d21_weather", """
WITH g AS (SELECT o_orderkey AS game_id, (o_custkey % 100) AS stadium_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'dome' ELSE 'outdoors' END AS roof, TIMESTAMP '2024-01-01' + to_hours((o_orderkey % 700)::BIGINT) AS k FROM orders), h AS (SELECT user_id AS stadium_id, date_trunc('hour', ts) AS h, avg(value) AS wind, max(value) / 50 AS rain FROM events GROUP BY ALL),
w AS (SELECT game_id, any_value(roof) AS roof, count(wind) AS n, avg(wind) AS w, sum(rain) AS r FROM g CROSS JOIN (VALUES (0), (1), (2)) v(i) LEFT JOIN h ON h.stadium_id = g.stadium_id AND h.h = date_trunc('hour', g.k) + to_hours(i) GROUP BY game_id)
SELECT game_id, round(CASE WHEN roof = 'dome' THEN 0 WHEN n = 3 THEN greatest(w - 10, 0) END, 6) AS wind10, round(CASE WHEN roof = 'dome' THEN 0 WHEN n = 3 THEN least(r, 10) END, 6) AS rain, CASE WHEN roof = 'dome' THEN 'roof' WHEN n = 3 THEN 'observed' ELSE 'unknown' END AS weather_source FROM w""")
def d21(t: Tables):
    g = t.orders.select(F.col("o_orderkey").alias("game_id"), (F.col("o_custkey") % 100).alias("stadium_id"), F.when(F.col("o_orderpriority") == "5-LOW", "dome").otherwise("outdoors").alias("roof"), F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + (F.col("o_orderkey") % 700) * 3600).alias("kickoff"))
    h = t.events.groupBy(F.col("user_id").alias("stadium_id"), F.date_trunc("hour", "ts").alias("time")).agg(F.avg("value").alias("wind"), (F.max("value") / 50).alias("rain"))
    return X.weather(g, h).select("game_id", F.round("wind10", 6).alias("wind10"), F.round("rain", 6).alias("rain"), "weather_source")


@query("d27_availability_note", """
WITH r AS (SELECT o_custkey AS player_id, o_orderdate AS d, CASE o_orderstatus WHEN 'F' THEN 'Out' WHEN 'O' THEN 'Questionable' END AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1), g AS (SELECT user_id AS player_id, max(ts) AS d, max_by(event_type, ts) AS tag FROM events GROUP BY 1)
SELECT c_custkey AS player_id, CASE WHEN r.d >= TIMESTAMP '1999-01-01' - INTERVAL 2000 HOUR AND status IS NOT NULL THEN status WHEN g.d >= TIMESTAMP '1999-01-01' - INTERVAL 2000 HOUR THEN tag END AS designation FROM customer LEFT JOIN r ON r.player_id = c_custkey LEFT JOIN g ON g.player_id = c_custkey""")
def d27(t: Tables):
    rep = t.orders.withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).where("n = 1").select(F.col("o_custkey").alias("player_id"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", "Out").when(F.col("o_orderstatus") == "O", "Questionable").alias("report_status"), F.lit("Full").alias("practice_status"), F.lit("Knee").alias("injury"))
    tags = t.events.select(F.col("user_id").alias("player_id"), F.col("ts").alias("at"), F.col("event_type").alias("tag"))
    return X.availability_note(t.customer.select(F.col("c_custkey").alias("player_id")), rep, tags, F.to_timestamp(F.lit("1999-01-01")), 2000).select("player_id", "designation")


@query("a20_projection_feed", facts_sql(f"SELECT entity, t, round({OFFENSE_SQL}, 6) AS points, week < 6 AS in_time FROM (SELECT *, {OFFENSE_SQL} AS p FROM st)"))
def a20(t: Tables):
    s = stat_lines(t).withColumnRenamed("passing_yards", "pyd").withColumn("as_of", F.col("week"))
    kick = t.facts.select(F.col("grp").alias("team"), F.col("period").alias("week")).distinct().withColumn("kickoff", F.lit(6))
    return B.projection_feed(s.drop("fg_made_40_49"), {"pyd": "passing_yards"}, kick).select("entity", "t", F.round("points", 6).alias("points"), "in_time")


K14_SQL = """
WITH q AS (SELECT l_orderkey AS event_id, (l_suppkey % 7)::INT AS book, 1 AS market, (l_partkey % 3)::INT AS player, l_returnflag = 'R' AS u, floor(l_quantity / 10)::INT AS point, CASE WHEN l_linestatus = 'O' THEN 100 ELSE -100 END * (1.0 + l_discount * 10) AS price FROM lineitem),
i AS (SELECT *, CASE WHEN price >= 100 THEN 100 / (price + 100) WHEN price <= -100 THEN -price / (-price + 100) END AS p FROM q), pr AS (SELECT event_id, book, market, player, point, count(*) AS n, count(*) FILTER (WHERE u) AS nu, max(p) FILTER (WHERE NOT u) AS qo, max(p) FILTER (WHERE u) AS qu FROM i GROUP BY ALL),
m AS (SELECT *, qo / (qo + qu) AS po FROM pr WHERE n = 2 AND nu = 1 QUALIFY row_number() OVER (PARTITION BY event_id, book, market, player ORDER BY abs(qo / (qo + qu) - 0.5), point) = 1)
SELECT event_id, player, median(point)::DOUBLE AS line, round(median(po), 8) AS p_over, count(DISTINCT book) AS books FROM m GROUP BY ALL"""


@query("k14_market_view", K14_SQL)
def k14(t: Tables):
    c = F.col
    q = t.lineitem.select(c("l_orderkey").alias("event_id"), (c("l_suppkey") % 7).cast("int").alias("book"), F.lit(1).alias("market"), (c("l_partkey") % 3).cast("int").alias("player"), F.when(c("l_returnflag") == "R", "Under").otherwise("Over").alias("side"), F.floor(c("l_quantity") / 10).cast("int").alias("point"), (F.when(c("l_linestatus") == "O", 100).otherwise(-100) * (1.0 + c("l_discount") * 10)).alias("price"))
    view, _ = B.market_view(q)
    return view.select("event_id", "player", c("line").cast("double").alias("line"), F.round("p_over", 8).alias("p_over"), "books")


@query("m15_matchup_slopes", """
WITH r AS (SELECT cat, qty::DOUBLE AS x, lead(pts) OVER (PARTITION BY entity ORDER BY t)::DOUBLE AS y FROM facts), s AS (SELECT cat, count(*) AS n, avg(x) AS m, avg(y) AS my, sum(x * x) - count(*) * avg(x) ** 2 AS sxx, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy FROM r WHERE y IS NOT NULL GROUP BY cat)
SELECT cat, round(sxy / (sxx + 5 * sxx / (n - 1)), 6) AS slope FROM s""")
def m15(t: Tables):
    from panelyard.operators.estimators import ridge_fit

    rows = t.facts.withColumn("y", F.lead("pts").over(Window.partitionBy("entity").orderBy("t"))).where("y IS NOT NULL")
    return M.matchup_slopes(ridge_fit(rows, ["cat"], ["qty"], "y"), "qty").select("cat", F.round("slope", 6).alias("slope"))


@query("m21_log_rank_residuals", """
WITH f AS (SELECT cat, season, entity, t, pts::DOUBLE AS y, ln(entity % 40 + 1) AS x FROM facts), s AS (SELECT cat, season, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(x * y) AS xy FROM f GROUP BY ALL),
r AS (SELECT cat, season, sum(n) OVER w - n AS n, sum(sx) OVER w - sx AS sx, sum(sy) OVER w - sy AS sy, sum(xx) OVER w - xx AS xx, sum(xy) OVER w - xy AS xy FROM s WINDOW w AS (PARTITION BY cat)), l AS (SELECT cat, season, (n * xy - sx * sy) / (n * xx - sx * sx) AS b, n, sx, sy FROM r)
SELECT entity, t, round(y - (sy - b * sx) / n - b * x, 5) AS residual FROM f JOIN l USING (cat, season)""")
def m21(t: Tables):
    f = t.facts.select("cat", "season", "entity", "t", F.col("pts").cast("double").alias("y"), (F.col("entity") % 40 + 1).alias("rank"))
    return M.log_rank_residuals(f, "cat", "rank", "y", "season").select("entity", "t", F.round("residual", 5).alias("residual"))


@query("m31_composed_models", "SELECT entity, t, round(10 + 0.5::DOUBLE * (3 + 2 * qty + 7 * lines), 6) AS value FROM facts")
def m31(t: Tables):
    w = M.composed({"(1)": 3.0, "qty": 2.0, "lines": 7.0}, 10.0, 0.5)
    return t.facts.select("entity", "t", F.round(sum((F.lit(v) * F.col(k) for k, v in w.items() if k != "(1)"), F.lit(w["(1)"])), 6).alias("value"))


@query("p3_live_checkpoints", PROJ + f""", r AS (SELECT t, (grp // 2)::INT AS game, (grp % 2)::INT AS side, sum(qty * f + (1 - f) * sys_mean) AS m, sum(greatest(sqrt(1 - f) * (3 + 0.3::DOUBLE * sys_mean), 1e-6) ** 2) AS v, f FROM (SELECT pj.*, facts.qty FROM pj JOIN facts USING (entity, t)), (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) c(f) WHERE sys_mean IS NOT NULL GROUP BY ALL),
z AS (SELECT a.t, a.game, a.f, (a.m - b.m) / sqrt(a.v + b.v) AS z FROM r a JOIN r b ON a.t = b.t AND a.game = b.game AND a.f = b.f AND a.side = 0 AND b.side = 1)
SELECT t * 100 + game AS matchup, f AS done, round({cdf_sql("z")}, 7) AS p_a FROM z""")
def p3(t: Tables):
    p = projections(t).where("sys_mean IS NOT NULL").join(t.facts.select("entity", "t", "qty"), ["entity", "t"]).withColumn("done", F.explode(F.array(F.lit(0.25), F.lit(0.75))))
    rows = p.select((F.col("t") * 100 + F.floor(F.col("grp") / 2)).alias("matchup"), (F.col("grp") % 2).alias("side"), "done", (F.col("qty") * F.col("done")).alias("now"), F.col("sys_mean").alias("proj"), (1 - F.col("done")).alias("f"), F.lit(3.0).alias("a"), F.lit(0.3).alias("b"), F.lit(1.0).alias("g"))
    return V.live_win_probability(rows, "matchup", "side", "done").select("matchup", "done", F.round("p_a", 7).alias("p_a"))


@query("p20_completion", "SELECT grp, season, a, b, greatest(12 - a, 0) + greatest(9 - b, 0) AS missing, greatest(12 - a, 0) + greatest(9 - b, 0) <= picks AS feasible FROM (SELECT grp, season, count(DISTINCT entity) FILTER (WHERE cat = 'BUILDING') AS a, count(DISTINCT entity) FILTER (WHERE cat = 'MACHINERY') AS b, (grp % 6)::INT AS picks FROM facts GROUP BY ALL)")
def p20(t: Tables):
    c = t.facts.groupBy("grp", "season").agg(F.countDistinct(F.when(F.col("cat") == "BUILDING", F.col("entity"))).alias("a"), F.countDistinct(F.when(F.col("cat") == "MACHINERY", F.col("entity"))).alias("b")).withColumn("picks", (F.col("grp") % 6).cast("int"))
    return V.completion(c, {"a": 12, "b": 9}, "picks").drop("picks")


@query("e7_planted_leak", "SELECT entity, t FROM (SELECT entity, t, max(pts) OVER (PARTITION BY entity) AS a, max(CASE WHEN t <= 23955 THEN pts END) OVER (PARTITION BY entity) AS b FROM facts) WHERE t <= 23955 AND a <> b")
def e7(t: Tables):
    """A builder that looks ahead is found, with every row that it spoils."""
    from panelyard.operators.features import leak_rows

    build = lambda f: f.withColumn("best", F.max("pts").over(Window.partitionBy("entity"))).select("entity", "t", "best")
    return leak_rows(build, t.facts.select("entity", "t", "pts"), "t", 23955, ["entity", "t"])


@query("e27_found_differences", "SELECT (SELECT count(*) FROM facts) AS rows_compared, (SELECT count(*) FROM facts WHERE returns > 3) AS on_one_side, 7 * (SELECT max(lines) FROM facts WHERE returns <= 3)::DOUBLE AS largest_gap, false AS same")
def e27(t: Tables):
    """A stored table that lacks rows and differs in the rest is told apart."""
    f = t.facts.select("entity", "t", "returns", F.col("pts").cast("double").alias("pts"), "lines")
    return R.reproduced(f.where("returns <= 3").select("entity", "t", (F.col("pts") + 7 * F.col("lines")).alias("pts")), f.select("entity", "t", "pts"), ["entity", "t"], "pts", 0.5)


def by_size(t: Tables, worked):
    """Every part beside what is ``worked`` out once for its size, which alone makes its distribution."""
    part = t.part.select("p_partkey", F.col("p_size").alias("__size"))
    return part.join(worked, F.col("__size").eqNullSafe(F.col("p_size"))).drop("__size")


@query("p7_count_lattices", """
WITH m AS (SELECT p_partkey, p_size / 20.0::DOUBLE AS m FROM part), c AS (SELECT p_partkey, k, exp(-m + k * ln(m) - lgamma(k + 1)) AS p FROM m, range(9) r(k)), d AS (SELECT p_partkey, k, p + CASE WHEN k = 8 THEN greatest(1 - sum(p) OVER (PARTITION BY p_partkey), 0) ELSE 0 END AS p FROM c),
t AS (SELECT p_partkey, d.k * 6 + r.i AS x, sum(d.p * r.q) AS p FROM d, (VALUES (0, 0.5::DOUBLE), (1, 0.3), (2, 0.2)) r(i, q) GROUP BY ALL)
SELECT p_partkey, round(sum(p * x), 6) AS mean, round(sum(p) FILTER (WHERE x >= 12), 8) AS twelve_or_more FROM t GROUP BY p_partkey""")
def p7_counts(t: Tables):
    """Six points for each of a Poisson count, and a rest of 0 to 2."""
    pmf = V.compound_lattice(V.poisson_lattice(F.col("p_size") / 20.0, 8), 6, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)))
    worked = t.part.select("p_size").distinct().select("p_size", pmf.alias("pmf"))
    sums = worked.select("p_size", F.round(V.total(F.transform("pmf", lambda p, k: p * k)), 6).alias("mean"), F.round(V.at_least(F.col("pmf"), 12), 8).alias("twelve_or_more"))
    return by_size(t, sums).drop("p_size")


@query("p7_tier_lattices", f"""
WITH z AS (SELECT p_partkey, k, (k + 0.5 - p_size) / 9.0::DOUBLE AS z FROM part, range(61) r(k)), f AS (SELECT p_partkey, k, CASE WHEN k = 60 THEN 1 ELSE {cdf_sql("z")} END AS f FROM z), g AS (SELECT p_partkey, k, f - coalesce(lag(f) OVER (PARTITION BY p_partkey ORDER BY k), 0) AS p FROM f)
SELECT p_partkey, CASE WHEN k <= 0 THEN 10 WHEN k <= 6 THEN 7 WHEN k <= 13 THEN 4 WHEN k <= 20 THEN 1 WHEN k <= 27 THEN 0 WHEN k <= 34 THEN -1 ELSE -4 END::DOUBLE AS points, round(sum(p), 7) + 0 AS p FROM g GROUP BY ALL""")
def p7_tiers(t: Tables):
    """Points allowed about the size, and the tier points that follow."""
    from panelyard.operators.scored import ALLOWED_REST, ALLOWED_TIERS

    pmf = V.discretised_normal(F.col("p_size").cast("double"), F.lit(9.0), 0, 60)
    worked = t.part.select("p_size").distinct().select("p_size", V.tier_lattice(pmf, ALLOWED_TIERS, ALLOWED_REST).alias("cells"))
    rounded = worked.select("p_size", F.transform("cells", lambda c: F.struct(c["points"].alias("points"), (F.round(c["p"], 7) + 0).alias("p"))).alias("cells"))
    return by_size(t, rounded).select("p_partkey", F.inline_outer("cells"))  # the plain one would work the cells out for every part, to tell whether there are any


@query("p7_regridded", """
WITH d AS (SELECT p_partkey, p_size % 7 / 2.0::DOUBLE AS mv, k, CASE WHEN k IN (10, 11) THEN 0.25 WHEN k = 12 THEN 0.5 ELSE 0 END::DOUBLE AS p FROM part, range(25) r(k)), s AS (SELECT p_partkey, k + floor(mv) AS i, p * (1 - (mv - floor(mv))) AS p FROM d UNION ALL SELECT p_partkey, k + floor(mv) + 1, p * (mv - floor(mv)) FROM d)
SELECT p_partkey, i::INT AS cell, round(sum(p), 8) AS p FROM s WHERE p > 0 GROUP BY ALL""")
def p7_regridded(t: Tables):
    """A distribution of mean 11.25 moved by the size modulo 7, halved."""
    pmf = F.array(*[F.lit({10: 0.25, 11: 0.25, 12: 0.5}.get(k, 0.0)) for k in range(25)])
    worked = t.part.select("p_size").distinct().select("p_size", V.regridded(pmf, F.lit(11.25) + F.col("p_size") % 7 / 2.0).alias("pmf"))
    held = F.filter(F.transform("pmf", lambda p, k: F.struct(k.alias("cell"), p.alias("p"))), lambda c: c["p"] > 0)
    rounded = worked.select("p_size", F.transform(held, lambda c: F.struct(c["cell"].alias("cell"), F.round(c["p"], 8).alias("p"))).alias("cells"))
    return by_size(t, rounded).select("p_partkey", F.inline_outer("cells")).where("cell IS NOT NULL")  # the plain one would work the cells out for every part, to tell whether there are any
