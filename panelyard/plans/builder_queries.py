"""Queries over table functions, the builders' registry, line effects, searches and pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyard.operators import blocks, builders, evaluation, market
from panelyard.operators import reports as R
from panelyard.operators.probability import normal_crps
from panelyard.plans.model_queries import PROJ, projections
from panelyard.plans.registry import Tables, query
from panelyard.sources import tables


@query("f22_pick_grid", "SELECT s_nationkey AS league, r AS round, CASE WHEN s_nationkey % 2 = 0 AND r % 2 = 0 THEN n + 1 - k ELSE k END AS slot, (r - 1) * n + k AS pick FROM (SELECT s_nationkey, n, unnest(range(1, n + 1))::INT AS k FROM (SELECT s_nationkey, count(*)::INT AS n FROM supplier GROUP BY 1)), (SELECT unnest(range(1, 5))::INT AS r)")
def f22_grid(t: Tables):
    """A draft for every nation: its suppliers are the slots, four rounds, every second one as a snake."""
    builders.table_functions(t.spark)
    leagues = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return leagues.lateralJoin(builders.PickGrid(F.col("n").outer(), F.lit(4), F.col("s_nationkey").outer() % 2 == 0)).select(F.col("s_nationkey").alias("league"), "round", "slot", "pick")


@query("w17_calendar", "SELECT entity, g.at AS t, f.entity IS NOT NULL AS played FROM (SELECT entity, unnest(range(min(t), max(t) + 1))::INT AS at FROM facts GROUP BY entity) g LEFT JOIN (SELECT DISTINCT entity AS e, t, entity FROM facts) f ON f.e = g.entity AND f.t = g.at".replace("SELECT entity, g.at", "SELECT g.entity, g.at"))
def w17_calendar(t: Tables):
    """Every period of each entity between its first and last, by a table argument partitioned by entity."""
    rows = t.facts.select(F.col("entity").cast("string").alias("member"), F.col("t").alias("at"))
    return builders.Calendar(rows.asTable().partitionBy("member")).select(F.col("member").cast("long").alias("entity"), F.col("at").alias("t"), "played")


def honest_builders() -> builders.Builders:
    """Two builders that look back, as examples of the registry; each check takes later facts away and builds anew."""
    held = builders.Builders(["entity", "t"], "t", [23_950, 23_965])

    @held.add("before", ["pts_before", "games_before"])
    def before(facts):
        w = Window.partitionBy("entity").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
        return facts.select("entity", "t", F.sum("pts").over(w).alias("pts_before"), F.count("pts").over(w).alias("games_before"))

    @held.add("gap", ["gap"])
    def gap(facts):
        return facts.select("entity", "t", (F.col("t") - F.lag("t").over(Window.partitionBy("entity").orderBy("t"))).alias("gap"))

    return held


@query("e7_registry", "SELECT entity, t, sum(pts) OVER w::BIGINT AS pts_before, count(pts) OVER w AS games_before, (t - lag(t) OVER (PARTITION BY entity ORDER BY t))::INT AS gap FROM facts WINDOW w AS (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)".replace("sum(pts) OVER w::BIGINT", "(sum(pts) OVER w)::BIGINT"))
def e7_registry(t: Tables):
    return honest_builders().table(t.facts.select("entity", "t", "pts"))


@query("f9_line_effects", "SELECT o_orderkey, round(-1.928 + 1.1119 * i, 6) AS points, round(-0.9448 + 0.15054 * i, 6) AS offensive_tds, round(-0.5106 + 0.08921 * i, 6) AS pass_tds, round(-0.4303 + 0.06101 * i, 6) AS rush_tds, round(1.3965 + 0.0139 * i, 6) AS field_goals, round(24.7 + 0.068 * s + 0.184 * g, 6) AS pass_attempts, round(29.68 - 0.25 * s - 0.081 * g, 6) AS rush_attempts, round(0.954 * (24.7 + 0.068 * s + 0.184 * g), 6) AS targets FROM (SELECT o_orderkey, (o_custkey % 21 - 10)::DOUBLE AS s, (35 + o_orderkey % 25)::DOUBLE AS g, (35 + o_orderkey % 25)::DOUBLE / 2 - (o_custkey % 21 - 10)::DOUBLE / 2 AS i FROM orders)".replace("-1.928 ", "-1.928::DOUBLE ").replace("1.1119 ", "1.1119::DOUBLE "))
def f9_effects(t: Tables):
    lines = t.orders.select("o_orderkey", (F.col("o_custkey") % 21 - 10).cast("double").alias("spread"), (35 + F.col("o_orderkey") % 25).cast("double").alias("total"))
    got = builders.line_effects(lines.withColumn("implied", F.col("total") / 2 - F.col("spread") / 2), "implied", "spread", "total")
    return got.select("o_orderkey", *[F.round(f"line_{c}", 6).alias(c) for c in (*builders.LINE_EFFECTS, "targets")])


@query("m32_simplex")  # the test searches the same loss over a fine grid
def m32_simplex(t: Tables):
    """Centre and spread of outcomes around the mean system with the least mean CRPS."""
    p = projections(t).where("sys_mean IS NOT NULL").select("actual", "sys_mean").persist()  # read once for all passes
    loss = lambda x: normal_crps(F.col("actual"), x[0] + F.col("sys_mean"), F.lit(x[1]) * F.sqrt(F.greatest("sys_mean", F.lit(1.0))))
    (shift, scale), value, _ = builders.simplex_search(p, loss, [0.0, 10.0], [50.0, 5.0], [-500.0, 0.1], [500.0, 100.0], tolerance=1e-6)
    return t.spark.createDataFrame([(p.count(), shift, scale, value)], "n long, shift double, scale double, crps double")


PAIRED = PROJ + """, r AS (SELECT * FROM pj WHERE sys_mean IS NOT NULL AND sys_eb IS NOT NULL),
q AS (SELECT a.season, a.period AS week, count(*) AS pairs, count(*) FILTER (sign(a.sys_mean - b.sys_mean) = sign(a.actual - b.actual)) AS rm, count(*) FILTER (sign(a.sys_eb - b.sys_eb) = sign(a.actual - b.actual)) AS re FROM r a JOIN r b ON a.season = b.season AND a.period = b.period AND a.entity < b.entity AND a.actual <> b.actual GROUP BY ALL),
e AS (SELECT season, period AS week, count(*) AS rows, avg(abs(sys_mean - actual)) AS m, avg(abs(sys_eb - actual)) AS e FROM r GROUP BY ALL),
g AS (SELECT e.season, e.week, rows, coalesce(pairs, 0) AS pairs, rm::DOUBLE / pairs AS mp, re::DOUBLE / pairs AS ep, m, e.e FROM e LEFT JOIN q USING (season, week))"""


def paired(t: Tables):
    """Errors and rightly ordered pairs of both systems in every week; pairs are counted, never formed."""
    p = projections(t).where("sys_mean IS NOT NULL AND sys_eb IS NOT NULL").withColumnRenamed("period", "week")
    pairs = evaluation.pairs_over(p, ["sys_mean", "sys_eb"], "actual", ["season", "week"])
    of = lambda s, c: F.max(F.when(F.col("system") == s, F.col(c)))
    wide = pairs.groupBy("season", "week").agg(F.max("pairs").alias("pairs"), *[of(f"sys_{s}", "right").alias(f"{s}_right") for s in ("mean", "eb")])
    mae = lambda s: F.avg(F.abs(F.col(f"sys_{s}") - F.col("actual"))).alias(f"{s}_mae")
    rows = p.groupBy("season", "week").agg(F.count(F.lit(1)).alias("rows"), mae("mean"), mae("eb"))
    return rows.join(wide, ["season", "week"]).withColumns({f"{s}_pairwise": F.try_divide(f"{s}_right", "pairs") for s in ("mean", "eb")}).drop("mean_right", "eb_right")


@query("e21_card_of_pairs", PAIRED + " SELECT season, count(*) AS weeks, sum(pairs)::BIGINT AS pairs, round(sum(mp * pairs) / sum(pairs) FILTER (WHERE mp IS NOT NULL), 6) AS mean_pairwise, round(sum(ep * pairs) / sum(pairs) FILTER (WHERE ep IS NOT NULL), 6) AS eb_pairwise, round(sum(m * rows) / sum(rows), 6) AS mean_mae, round(sum(e * rows) / sum(rows), 6) AS eb_mae FROM g GROUP BY season")
def e21_pairs(t: Tables):
    card = R.card(paired(t).withColumn("graded_at", F.lit(1)), ["mean", "eb"])
    return card.select("season", "weeks", "pairs", *[F.round(c, 6).alias(c) for c in ("mean_pairwise", "eb_pairwise", "mean_mae", "eb_mae")])


@query("e29_ledger_of_pairs", PAIRED + " SELECT season, week, pairs, round(mp, 6) AS mean_pairwise, round(m, 6) AS mean_mae, round(ep, 6) AS eb_pairwise, round(e, 6) AS eb_mae FROM g")
def e29_pairs(t: Tables):
    g = paired(t)
    long = g.select("season", "week", F.inline(F.array(*[F.struct(F.lit(s).alias("system"), F.col(f"{s}_pairwise").alias("pairwise"), F.col(f"{s}_mae").alias("mae")) for s in ("mean", "eb")])))
    row = R.ledger_row(long, ["mean", "eb"]).join(g.select("season", "week", "pairs"), ["season", "week"])
    return row.select("season", "week", "pairs", *[F.round(c, 6).alias(c) for c in ("mean_pairwise", "mean_mae", "eb_pairwise", "eb_mae")])


@query("e24_roll_up_of_pairs", PAIRED + " SELECT season AS name, count(*) AS folds, count(*) FILTER (WHERE ep > mp AND e < m) AS better, round(avg(ep - mp), 6) AS pairwise_gain, round(avg(e - m), 6) AS mae_change, bool_and(ep > mp AND e < m) AS accepted FROM g WHERE pairs > 0 GROUP BY 1")
def e24_pairs(t: Tables):
    g = paired(t).where("pairs > 0")
    folds = g.groupBy(F.col("season").alias("name")).agg(F.collect_list(F.struct(F.col("eb_pairwise").alias("pairwise"), F.col("mean_pairwise").alias("base_pairwise"), F.col("eb_mae").alias("mae"), F.col("mean_mae").alias("base_mae"))).alias("folds"))  # at most twelve weeks a season
    return R.roll_up(folds).select("name", "folds", "better", F.round("pairwise_gain", 6).alias("pairwise_gain"), F.round("mae_change", 6).alias("mae_change"), "accepted")


@query("j15_pairs_within", "SELECT a.l_orderkey, count(*) AS pairs, sum(abs(a.l_quantity - b.l_quantity))::BIGINT AS apart, count(*) FILTER (WHERE a.l_suppkey = b.l_suppkey) AS same_supplier FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY 1")
def j15(t: Tables):
    """All pairs of the lines of an order (seven at most), summed by order."""
    pairs = builders.pairs_within(t.lineitem, ["l_orderkey"], "l_linenumber", ["l_quantity", "l_suppkey"])
    return pairs.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.abs(F.col("a.l_quantity") - F.col("b.l_quantity"))).cast("long").alias("apart"), F.count_if(F.col("a.l_suppkey") == F.col("b.l_suppkey")).alias("same_supplier"))


# ---- forms of earlier queries on inputs that give them rows


KINDS = "concat(p_type, ' ', p_size, ' ', p_partkey % 7)"


@query("k5_ids_by_kind", f"WITH k AS (SELECT p_partkey, {KINDS} AS name, p_brand FROM part), n AS (SELECT name FROM k GROUP BY 1 HAVING count(DISTINCT p_brand) = 1) SELECT p_partkey FROM k JOIN n USING (name)")
def k5_kinds(t: Tables):
    return market.unambiguous(t.part.select("p_partkey", F.expr(KINDS).alias("name"), "p_brand"), "name", "p_brand")[0].select("p_partkey")


@query("a26_rederived_by_kind", f"WITH k AS (SELECT p_partkey, {KINDS} AS name, p_brand FROM part), u AS (SELECT name, min(p_brand) AS entity FROM k WHERE p_partkey % 3 = 0 GROUP BY 1 HAVING count(DISTINCT p_brand) = 1) SELECT p_partkey, name, entity FROM k JOIN u USING (name)")
def a26_kinds(t: Tables):
    named = t.part.select("p_partkey", F.expr(KINDS).alias("name"), "p_brand")
    return blocks.rederived(named.drop("p_brand"), named.where("p_partkey % 3 = 0").select("name", F.col("p_brand").alias("entity")), "name", "entity")


@query("a17_stamps_of_orders", "SELECT (o_orderkey % 40)::VARCHAR AS stamp, count(*) AS n FROM orders GROUP BY 1")
def a17_orders(t: Tables):
    named = t.orders.withColumn("source_file", F.concat(F.lit("scan-"), F.col("o_orderkey") % 40, F.lit(".json")))
    return tables.record_files(named, r"-(\d+)\.json").groupBy("stamp").agg(F.count(F.lit(1)).alias("n"))


@query("q12_degraded_users", """
WITH s AS (SELECT user_id AS source FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30'), g AS (SELECT user_id AS source, count(DISTINCT date_part('day', ts)) AS n FROM events GROUP BY 1)
SELECT source, 'STALE' AS fault, 'too old' AS reason FROM s UNION ALL SELECT source, 'GAPPED', 'periods ' || n FROM g WHERE n < 28""")
def q12_users(t: Tables):
    e = t.events.groupBy(F.col("user_id").alias("source"))
    s = e.agg(F.when(F.max("ts") < F.to_timestamp(F.lit("2024-01-30")), "STALE").otherwise("FRESH").alias("state")).withColumn("reason", F.lit("too old"))
    n = F.countDistinct(F.dayofmonth("ts"))
    return R.degradations(s, e.agg(F.when(n < 28, n.cast("string")).otherwise("").alias("missing")))
