"""More queries on the panel: context, blocks, fitting and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyard.operators import context as X
from panelyard.operators import estimators as M
from panelyard.operators import evaluation as E
from panelyard.operators import fitting as Z
from panelyard.operators import panels as P
from panelyard.operators import plays as Y
from panelyard.operators import reports as R
from panelyard.operators.scratch import settled
from panelyard.plans.model_queries import LINEUP, PROJ, cdf_sql, lineup, lineups, projections
from panelyard.plans.registry import Tables, query


@query("b9_pool_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def b9(t: Tables):
    people = t.customer.select("c_custkey", "c_acctbal", F.when(F.col("c_mktsegment") != "FURNITURE", "Active").alias("status"), F.col("c_nationkey").alias("team"))
    return Y.pool(people, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", F.col("c_acctbal") > 0).select("c_custkey")


@query("b10_floors_per_stat", "SELECT entity, t FROM facts WHERE (cat = 'BUILDING' AND lines >= 4) OR (cat = 'MACHINERY' AND lines >= 6)")
def b10(t: Tables):
    rules = t.spark.createDataFrame([("pts", "BUILDING", 4), ("pts", "MACHINERY", 6)], "stat string, cat string, floor int")
    return Y.above_floors(t.facts.withColumn("stat", F.lit("pts")), F.broadcast(rules), "stat", "cat", "lines").select("entity", "t")  # two rules


@query("b13_mean_fill", "WITH m AS (SELECT cat, avg(lines) AS m FROM facts WHERE season < 1997 AND returns > 0 GROUP BY cat) SELECT entity, t, round(coalesce(CASE WHEN returns > 0 THEN lines::DOUBLE END, m), 7) AS x FROM facts LEFT JOIN m USING (cat)")
def b13(t: Tables):
    f = t.facts.select("entity", "t", "cat", "season", F.when(F.col("returns") > 0, F.col("lines")).alias("x"))
    return Y.mean_fill(f, f.where("season < 1997"), ["cat"], ["x"]).select("entity", "t", F.round("x", 7).alias("x"))


@query("b14_clip", "SELECT o_orderkey, least(greatest(o_totalprice / 1000, 20.0), 200.0) AS x FROM orders")
def b14(t: Tables):
    return t.orders.select("o_orderkey", Y.clipped(F.col("o_totalprice") / 1000, 20.0, 200.0).alias("x"))


@query("g8_events_on_grid", "WITH g AS (SELECT DISTINCT grp, t FROM facts), c AS (SELECT grp, t, count(*) AS n FROM facts WHERE returns > 1 GROUP BY ALL) SELECT grp, t, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (grp, t)")
def g8(t: Tables):
    counts = t.facts.where("returns > 1").groupBy("grp", "t").agg(F.count(F.lit(1)).alias("n"))
    return Y.on_grid(t.facts.select("grp", "t").distinct(), counts, ["grp", "t"], ["n"])


@query("g22_totals_spread", "WITH t AS (SELECT grp, t, sum(pts)::BIGINT AS total FROM facts GROUP BY ALL) SELECT count(*) AS n, sum(total)::DOUBLE / count(*) AS mean, median(total) AS median, quantile_cont(total, 0.9) AS p90 FROM t")
def g22(t: Tables):
    none = t.spark.createDataFrame([], "grp_a int, grp_b int, t int")
    return R.totals_and_margins(t.facts, ["grp"], "t", "pts", none, 10.0)[0].select("n", "mean", "median", "p90")


@query("o5_worst_rows", "SELECT entity, t, pts - 4 * qty AS gap FROM facts ORDER BY abs(pts - 4 * qty) DESC, entity * 100000 + t LIMIT 25")
def o5(t: Tables):
    f = t.facts.select("entity", "t", "pts", "qty", (F.col("entity") * 100000 + F.col("t")).alias("k"))
    return R.worst(f, F.col("pts") - 4 * F.col("qty"), 25, "k").select("entity", "t", "gap")


@query("u6_merge_ledgers", "WITH a AS (SELECT entity, sum(pts)::BIGINT AS pts FROM facts WHERE season = 1995 GROUP BY 1), b AS (SELECT entity, sum(pts)::BIGINT AS pts FROM facts WHERE season = 1996 GROUP BY 1) SELECT * FROM b UNION ALL SELECT * FROM a WHERE entity NOT IN (SELECT entity FROM b)")
def u6(t: Tables):
    from panelyard.sources.tables import upsert

    s = lambda y: t.facts.where(f"season = {y}").groupBy("entity").agg(F.sum("pts").alias("pts"))
    return upsert(s(1995), s(1996), ["entity"])


@query("w14_interpolated_curve", """
WITH p AS (SELECT cat, entity, sum(pts)::BIGINT AS pts FROM facts GROUP BY ALL), r AS (SELECT cat, entity, pts, row_number() OVER (PARTITION BY cat ORDER BY pts DESC, entity) AS rnk FROM p), k AS (SELECT cat, rnk, pts, lead(rnk) OVER (PARTITION BY cat ORDER BY rnk) AS r1, lead(pts) OVER (PARTITION BY cat ORDER BY rnk) AS p1 FROM r WHERE rnk % 5 = 1)
SELECT r.entity, round(CASE WHEN k.r1 IS NULL THEN k.pts::DOUBLE ELSE k.pts + (r.rnk - k.rnk)::DOUBLE * (k.p1 - k.pts) / (k.r1 - k.rnk) END, 6) AS value FROM r ASOF JOIN k ON r.cat = k.cat AND r.rnk >= k.rnk""")
def w14(t: Tables):
    p = t.facts.groupBy("cat", "entity").agg(F.sum("pts").alias("pts"))
    r = p.withColumn("rnk", F.row_number().over(Window.partitionBy("cat").orderBy(F.desc("pts"), "entity")))
    got = P.interpolate(r.select("cat", "entity", "rnk"), r.where("rnk % 5 = 1").select("cat", F.col("rnk").alias("knot"), "pts"), ["cat"], "knot", "pts", "rnk")
    return got.select("entity", F.round("interpolated", 6).alias("value"))


@query("w16_career_sums", "WITH y AS (SELECT entity, season, sum(pts)::BIGINT AS d, sum(lines)::BIGINT AS n FROM facts GROUP BY ALL) SELECT entity, season, (sum(d) OVER w)::BIGINT AS career_dev, (sum(n) OVER w)::BIGINT AS career_n FROM y WINDOW w AS (PARTITION BY entity ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w16(t: Tables):
    return Y.career_deviation(t.facts, "entity", "season", "pts", "lines")


@query("w17_runs_around", "SELECT event_id, date_trunc('day', ts - INTERVAL 8 HOUR) - INTERVAL ((dayofweek(ts - INTERVAL 8 HOUR) + 4) % 7) DAY + INTERVAL 8 HOUR AS last_run FROM events WHERE ts >= TIMESTAMP '2024-01-04'")
def w17(t: Tables):
    days = t.events.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).select(F.explode(F.sequence(F.date_sub("a", 14), F.date_add("b", 14))).alias("day"))
    runs = X.waiver_runs(days, 4, "08:00:00", "UTC")
    return X.around(t.events.where("ts >= TIMESTAMP '2024-01-04 00:00:00'").select("event_id", "ts"), runs, "ts").select("event_id", "last_run")


@query("w21_validity_intervals", """
WITH m AS (SELECT cat, t, entity AS top FROM facts QUALIFY row_number() OVER (PARTITION BY cat, t ORDER BY pts DESC, entity) = 1), r AS (SELECT *, CASE WHEN top IS DISTINCT FROM lag(top) OVER (PARTITION BY cat ORDER BY t) THEN 1 ELSE 0 END AS turn FROM m), i AS (SELECT *, sum(turn) OVER (PARTITION BY cat ORDER BY t) AS run FROM r),
v AS (SELECT cat, run, top, min(t) AS period_from, max(t) AS seen FROM i GROUP BY ALL) SELECT cat, top, period_from, coalesce(lead(period_from) OVER (PARTITION BY cat ORDER BY run) - 1, seen) AS period_to FROM v""")
def w21(t: Tables):
    top = P.latest_by_key(t.facts.select("cat", "t", "pts", F.col("entity").alias("top")), ["cat", "t"], [F.desc("pts"), F.col("top")])
    return P.validity_intervals(top, ["cat"], "t", "top").select("cat", "top", "period_from", "period_to")


@query("w22_period_numbers", "SELECT grp, t, row_number() OVER (PARTITION BY grp ORDER BY t) AS number FROM (SELECT DISTINCT grp, t FROM facts)")
def w22(t: Tables):
    return P.periods_between(t.facts, "grp", "t")


@query("w24_last_group_game", """
WITH c AS (SELECT grp, t, lag(t) OVER (PARTITION BY grp ORDER BY t) AS b FROM (SELECT DISTINCT grp, t FROM facts)) SELECT f.entity, f.t, CASE WHEN c.b IS NOT NULL THEN coalesce(g.lines, 0) END::BIGINT AS last_game FROM facts f JOIN c ON f.grp = c.grp AND f.t = c.t LEFT JOIN facts g ON g.entity = f.entity AND g.grp = f.grp AND g.t = c.b""")
def w24(t: Tables):
    return Y.last_group_game(t.facts, "entity", "grp", "t", "lines").select("entity", "t", "last_game")


@query("w25_share_of_group_to_date", """
WITH o AS (SELECT entity, grp, season, period, sum(lines) OVER (PARTITION BY entity, grp, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM facts), p AS (SELECT grp, season, period, sum(lines) AS n FROM facts GROUP BY ALL), q AS (SELECT grp, season, period, sum(n) OVER (PARTITION BY grp, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS team FROM p)
SELECT entity, season, period, CASE WHEN team > 0 THEN coalesce(own, 0)::DOUBLE / team END AS share FROM o JOIN q USING (grp, season, period)""")
def w25(t: Tables):
    return Y.group_share_to_date(t.facts, "entity", "grp", "season", "period", "lines").select("entity", "season", "period", "share")


@query("d25_roster_changes", "WITH a AS (SELECT DISTINCT grp, entity FROM facts WHERE season = 1996 AND period = 3), b AS (SELECT DISTINCT grp, entity FROM facts WHERE season = 1996 AND period = 4) SELECT grp AS team, entity AS player_id, 'left' AS move FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT grp, entity, 'arrived' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def d25(t: Tables):
    s = lambda p: t.facts.where(f"season = 1996 AND period = {p}").select(F.col("grp").alias("team"), F.col("entity").alias("player_id"))
    charts = t.facts.select(F.col("grp").alias("team"), F.col("cat").alias("position"), F.col("lines").alias("depth"))
    return X.roster_changes(s(3), s(4), charts)[0]


@query("d32_declared_out", "SELECT entity, t, CASE WHEN returns > 2 THEN 'report' ELSE 'tag' END AS by FROM facts WHERE returns > 2 OR lines > 9")
def d32(t: Tables):
    f = t.facts
    return X.declared_out(f.where("returns > 2").select("entity", "t", F.lit("Out").alias("report_status")), f.where("lines > 9").select("entity", "t", F.lit("IR").alias("tag")), ["entity", "t"])


@query("h20_starter_experience", """
WITH s AS (SELECT grp, season, period, entity FROM facts QUALIFY row_number() OVER (PARTITION BY grp, season, period ORDER BY pts DESC, entity) = 1)
SELECT grp, season, period, least(row_number() OVER (PARTITION BY entity ORDER BY season * 100 + period) - 1, 48)::INT AS starts_before, lag(entity) OVER (PARTITION BY grp ORDER BY season * 100 + period) <> entity AS changed FROM s""")
def h20(t: Tables):
    s = P.latest_by_key(t.facts, ["grp", "season", "period"], [F.desc("pts"), F.col("entity")])
    return Y.starter_experience(s, "grp", "entity", "season", "period").select("grp", "season", "period", "starts_before", "changed")


@query("h21_prior_and_to_date", """
WITH p AS (SELECT grp, season, period, sum(returns)::BIGINT AS x, sum(lines)::BIGINT AS n FROM facts GROUP BY ALL), s AS (SELECT *, sum(x) OVER w AS xs, sum(n) OVER w AS ns FROM p WINDOW w AS (PARTITION BY grp, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT season, period, sum(x)::BIGINT AS x, sum(n)::BIGINT AS n FROM p GROUP BY ALL), l AS (SELECT season, period, sum(x) OVER w AS xl, sum(n) OVER w AS nl FROM q WINDOW w AS (PARTITION BY season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT grp, season, sum(x) AS x, sum(n) AS n FROM p GROUP BY ALL), m AS (SELECT season, sum(x)::DOUBLE / sum(n) AS m FROM p GROUP BY season)
SELECT s.grp, s.season, s.period, round((xs - ns * CASE WHEN nl > 0 THEN xl::DOUBLE / nl END) / (ns + 50.0::DOUBLE), 8) AS to_date, round((y.x - y.n * m.m) / (y.n + 50.0::DOUBLE), 8) AS prior FROM s JOIN l USING (season, period) LEFT JOIN y ON y.grp = s.grp AND y.season + 1 = s.season LEFT JOIN m ON m.season = y.season""")
def h21(t: Tables):
    p = t.facts.groupBy("grp", "season", "period").agg(F.sum("returns").alias("x"), F.sum("lines").alias("n"))
    return Y.prior_and_to_date(p, ["grp"], "season", "period", "x", "n", 50.0).select("grp", "season", "period", F.round("to_date", 8).alias("to_date"), F.round("prior", 8).alias("prior"))


@query("h22_split_means", """
WITH p AS (SELECT grp, (period % 2)::INT AS side, sum(pts) AS x, count(*) AS n FROM facts GROUP BY ALL), m AS (SELECT *, sum(x) OVER (PARTITION BY side)::DOUBLE / sum(n) OVER (PARTITION BY side) AS m FROM p), v AS (SELECT grp, side, (x + 30.0::DOUBLE * m) / (n + 30.0::DOUBLE) AS v FROM m)
SELECT grp, round(max(v) FILTER (side = 1), 6) AS "with", round(max(v) FILTER (side = 0), 6) AS without, round(max(v) FILTER (side = 1) - max(v) FILTER (side = 0), 6) AS split FROM v GROUP BY grp""")
def h22(t: Tables):
    s = Y.split_means(t.facts.withColumn("side", F.col("period") % 2), ["grp"], "side", "pts", 30.0)
    return s.select("grp", *[F.round(c, 6).alias(c) for c in ("with", "without", "split")])


@query("h24_weighted_as_of_mean", "SELECT entity, t, round(CASE WHEN sum(lines) OVER w > 0 THEN (sum(pts * lines) OVER w)::DOUBLE / sum(lines) OVER w END, 7) AS v FROM facts WINDOW w AS (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def h24(t: Tables):
    return t.facts.select("entity", "t", F.round(Y.weighted_as_of(t.facts, ["entity"], "t", "pts", "lines"), 7).alias("v"))


@query("h31_per_game_rates", """
WITH s AS (SELECT entity, season, period, count(*) OVER w AS g, sum(returns) OVER w AS r, sum(returns) OVER (PARTITION BY entity, season ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS r3 FROM facts WINDOW w AS (PARTITION BY entity, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT entity, season, sum(returns)::DOUBLE / count(*) AS prior FROM facts GROUP BY ALL) SELECT s.entity, s.season, s.period, CASE WHEN g > 0 THEN r::DOUBLE / g END AS rate, CASE WHEN g > 0 THEN r3::DOUBLE / least(g, 3) END AS rate_l3, y.prior FROM s LEFT JOIN y ON y.entity = s.entity AND y.season + 1 = s.season""")
def h31(t: Tables):
    r = Y.per_game_rates(t.facts, ["entity"], "season", "period", ["returns"])
    return r.select("entity", "season", "period", F.col("returns_rate").alias("rate"), F.col("returns_rate_l3").alias("rate_l3"), F.col("returns_prior").alias("prior"))


@query("m10_held_out_lines", """
WITH s AS (SELECT cat, season, count(*)::DOUBLE AS n, sum(lines)::DOUBLE AS sx, sum(pts)::DOUBLE AS sy, sum(lines * lines)::DOUBLE AS xx, sum(lines * pts)::DOUBLE AS xy FROM facts GROUP BY ALL), r AS (SELECT cat, season, n, sum(n) OVER w - n AS rn, sum(sx) OVER w - sx AS rx, sum(sy) OVER w - sy AS ry, sum(xx) OVER w - xx AS rxx, sum(xy) OVER w - xy AS rxy FROM s WINDOW w AS (PARTITION BY cat))
SELECT cat, season, n::BIGINT AS n, round((rn * rxy - rx * ry) / (rn * rxx - rx * rx), 6) AS slope FROM r""")
def m10(t: Tables):
    return Z.held_out_line(t.facts, ["cat"], "season", "lines", "pts").select("cat", "season", "n", F.round("slope", 6).alias("slope"))


@query("m18_blend_sweep", PROJ + """, g AS (SELECT cat, v AS value, sum(abs(actual - v * sys_mean - (1.0::DOUBLE - v) * sys_eb)) / count(*) AS loss, count(*) AS n FROM pj, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) x(v) WHERE sys_mean IS NOT NULL AND sys_eb IS NOT NULL GROUP BY cat, v)
SELECT cat, min_by(value, (loss, value)) AS value, round(min(loss), 5) AS loss FROM g GROUP BY cat""")
def m18(t: Tables):
    return Z.blend_sweep(projections(t), ["cat"], "sys_mean", "sys_eb", "actual", [0.0, 0.25, 0.5, 0.75, 1.0]).select("cat", "value", F.round("loss", 5).alias("loss"))


@query("m19_boosted_trees")
def m19(t: Tables):
    rows = t.facts.withColumn("y", F.lead("pts").over(Window.partitionBy("entity").orderBy("t")).cast("double")).where("y IS NOT NULL")
    return Z.boosted(rows.where("season <= 1997"), rows.where("season > 1997"), ["qty", "lines", "returns"], "y", trees=5).select("entity", "t", "boosted")


@query("m22_gamma_shapes", "WITH s AS (SELECT cat, count(*) AS n, avg(pts) AS mean, avg(ln(pts)) AS lm FROM facts WHERE pts > 0 GROUP BY cat), d AS (SELECT *, ln(mean) - lm AS d FROM s) SELECT cat, n, round((3 - d + sqrt((d - 3) * (d - 3) + 24 * d)) / (12 * d), 5) AS shape FROM d")
def m22(t: Tables):
    return Z.gamma_shapes(t.facts, "cat", "pts").select("cat", "n", F.round("shape", 5).alias("shape"))


@query("m22_negative_binomial_size", "WITH s AS (SELECT cat, avg(lines) AS mean, var_samp(lines) AS var FROM facts GROUP BY cat) SELECT cat, round(CASE WHEN var > mean THEN mean * mean / (var - mean) END, 5) AS size FROM s")
def m22b(t: Tables):
    return Z.nb_size(t.facts, "cat", "lines").select("cat", F.round("size", 5).alias("size"))


@query("m24_listed_discount", "WITH p AS (SELECT entity, season, avg(pts) FILTER (returns > 0) AS x, avg(pts) FILTER (returns = 0) AS y FROM facts GROUP BY ALL HAVING count(*) FILTER (returns > 0) >= 2 AND count(*) FILTER (returns = 0) >= 2) SELECT count(*) AS entities, round(avg(x), 5) AS listed, round(avg(y), 5) AS others, round(sum(x) / sum(y), 6) AS ratio FROM p")
def m24(t: Tables):
    return Z.designation_discount(t.facts, "entity", "season", F.col("returns") > 0, "pts").select("entities", F.round("listed", 5).alias("listed"), F.round("others", 5).alias("others"), F.round("ratio", 6).alias("ratio"))


@query("m28_ablation")
def m28(t: Tables):
    rows = t.facts.withColumn("y", F.lead("pts").over(Window.partitionBy("entity").orderBy("t")))
    return Z.ablation(rows, ["cat"], "season", {"one": ["qty"], "two": ["qty", "lines"], "all": ["qty", "lines", "returns"]}, "y").withColumn("mse", F.round("mse", 4))


@query("m29_penalty_sweep")
def m29(t: Tables):
    rows = t.facts.withColumn("y", F.lead("pts").over(Window.partitionBy("entity").orderBy("t")))
    return Z.sweep(rows, ["cat"], "season", ["qty", "lines", "returns"], "y", [0.5, 5.0, 50.0]).withColumn("mse", F.round("mse", 4))


@query("m34_band_calibration", PROJ + """, p AS (SELECT CASE WHEN sys_mean < 400 THEN 'low' ELSE 'high' END AS band, season, sum(sys_mean) AS p, sum(actual) AS a, count(*) AS n FROM pj WHERE sys_mean IS NOT NULL GROUP BY ALL)
SELECT band, season, (sum(n) OVER w)::BIGINT AS n, round(sum(a) OVER w / sum(p) OVER w, 7) AS factor FROM p WINDOW w AS (PARTITION BY band ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def m34(t: Tables):
    b = F.when(F.col("sys_mean") < 400, "low").otherwise("high")
    return Z.band_calibration(projections(t), b, "sys_mean", "actual", "season").withColumn("factor", F.round("factor", 7))


@query("p5_spread_fit", PROJ + f""", s AS (SELECT a, b, actual > 350 AS won, (sys_mean - 350) / greatest(sqrt(0.5::DOUBLE) * (a + b * sys_mean / 100), 1e-6) AS z FROM pj, (VALUES (50.0::DOUBLE), (150.0), (300.0)) x(a), (VALUES (0.0::DOUBLE), (20.0), (60.0)) y(b) WHERE sys_mean IS NOT NULL),
g AS (SELECT a, b, count(*) AS n, avg(-ln(CASE WHEN won THEN p ELSE 1 - p END)) AS nll FROM (SELECT a, b, won, least(greatest({cdf_sql("z")}, 1e-6), 1 - 1e-6) AS p FROM s) GROUP BY a, b) SELECT n, a, b, round(nll, 7) AS nll FROM g ORDER BY g.nll, a, b LIMIT 1""")
def p5(t: Tables):
    s = projections(t).where("sys_mean IS NOT NULL").select((F.col("sys_mean") - 350).alias("d"), F.lit(0.5).alias("f"), (F.col("sys_mean") / 100).alias("proj"), (F.col("actual") > 350).cast("int").alias("won"))
    return Z.spread_fit(s, [50.0, 150.0, 300.0], [0.0, 20.0, 60.0]).withColumn("nll", F.round("nll", 7))


@query("e3_pairs_by_attribute", PROJ + """, c AS (SELECT * FROM pj WHERE sys_mean IS NOT NULL AND sys_eb IS NOT NULL AND season = 1996), p AS (SELECT abs(a.actual - b.actual) > 200 AS attribute, sign(a.sys_mean - b.sys_mean) = sign(a.actual - b.actual) AS m, sign(a.sys_eb - b.sys_eb) = sign(a.actual - b.actual) AS e FROM c a JOIN c b ON a.cat = b.cat AND a.t = b.t AND a.entity < b.entity WHERE a.actual <> b.actual)
SELECT attribute, count(*) AS pairs, count(*) FILTER (m)::DOUBLE / count(*) AS sys_mean, count(*) FILTER (e)::DOUBLE / count(*) AS sys_eb FROM p GROUP BY attribute""")
def e3(t: Tables):
    p = projections(t).where("sys_mean IS NOT NULL AND sys_eb IS NOT NULL AND season = 1996")
    return R.pairs_by(p, "sys_mean", "sys_eb", "actual", ["cat", "t"], "entity", F.abs(F.col("x.actual") - F.col("y.actual")) > 200).select("attribute", "pairs", "sys_mean", "sys_eb")


@query("e3_pairs_all_seasons")  # pairs in SQL are too slow over the whole table
def e3_all(t: Tables):
    return pairs_by_gap(projections(t), ["sys_mean", "sys_eb"], 200)


def pairs_by_gap(rows, systems, gap):
    """Pairs over the gap and those up to it (all pairs less those over), with each system's share of right ones."""
    rows = settled(E.common_rows(rows, systems, "actual").select("cat", "t", *systems, "actual"), "gaps")
    part = lambda over, sign: F.struct(F.lit(over).alias("attribute"), (sign * F.col("pairs")).alias("n"), (sign * F.col("right")).alias("good"))
    of = lambda g, *parts: E.pairs_over(rows, systems, "actual", ["cat", "t"], g).select("system", F.inline(F.array(*parts)))
    p = of(gap, part(True, 1), part(False, -1)).union(of(0, part(False, 1))).withColumnsRenamed({"n": "pairs", "good": "right"})
    sums = [F.sum(F.when(F.col("system") == s, F.col(c))).alias(f"{c}_{s}") for s in systems for c in ("pairs", "right")]
    return p.groupBy("attribute").agg(*sums).where(F.col(f"pairs_{systems[0]}") > 0).select("attribute", F.col(f"pairs_{systems[0]}").alias("pairs"), *[(F.col(f"right_{s}") / F.col(f"pairs_{s}")).alias(s) for s in systems])


@query("e5_walk_forward", "WITH p AS (SELECT t, pts, (sum(pts) OVER w)::DOUBLE / count(*) OVER w AS p FROM facts WINDOW w AS (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT t, count(*) AS n, round(sum(abs(p - pts)) / count(*), 6) AS mae, round(sum(p - pts) / count(*), 6) AS bias FROM p WHERE p IS NOT NULL GROUP BY t")
def e5(t: Tables):
    return R.walk_forward(t.facts, "entity", "t", "pts").select("t", "n", F.round("mae", 6).alias("mae"), F.round("bias", 6).alias("bias"))


@query("e12_shoot_out", PROJ + """, c AS (SELECT * FROM pj WHERE season >= 1996 AND sys_mean IS NOT NULL AND sys_recent IS NOT NULL), p AS (SELECT sign(a.actual - b.actual) AS w, sign(a.sys_mean - b.sys_mean) AS m, sign(a.sys_recent - b.sys_recent) AS r FROM c a JOIN c b ON a.cat = b.cat AND a.t = b.t AND a.entity < b.entity WHERE a.actual <> b.actual)
SELECT 'sys_mean' AS system, (SELECT count(*) FROM c) AS n, (SELECT round(avg(abs(sys_mean - actual)), 6) FROM c) AS mae, count(*)::BIGINT AS pairs, round(count(*) FILTER (WHERE m = w)::DOUBLE / count(*), 9) AS pairwise FROM p UNION ALL SELECT 'sys_recent', (SELECT count(*) FROM c), (SELECT round(avg(abs(sys_recent - actual)), 6) FROM c), count(*)::BIGINT, round(count(*) FILTER (WHERE r = w)::DOUBLE / count(*), 9) FROM p""")
def e12(t: Tables):
    return R.shoot_out(projections(t), ["sys_mean", "sys_recent"], "actual", F.col("season") >= 1996, "cat", "t").select("system", "n", F.round("mae", 6).alias("mae"), "pairs", F.round("pairwise", 9).alias("pairwise"))


@query("e15_lines_check", PROJ + "SELECT o AS \"offset\", count(*) AS n, avg((actual > sys_mean + o * 180.0::DOUBLE)::INT) AS observed FROM pj, (VALUES (-0.5::DOUBLE), (0.0::DOUBLE), (0.5::DOUBLE)) v(o) WHERE sys_mean IS NOT NULL GROUP BY o")
def e15(t: Tables):
    return R.lines_check(projections(t).withColumn("sd", F.lit(180.0)), "sys_mean", "sd", "actual", [-0.5, 0.0, 0.5]).select("offset", "n", "observed")


@query("e18_union_of_tops", PROJ + """, s AS (SELECT cat, entity, sum(sys_mean) AS a, sum(sys_eb) AS b FROM pj GROUP BY ALL), x AS (SELECT cat, entity FROM s WHERE a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cat ORDER BY a DESC, entity) <= 10), y AS (SELECT cat, entity FROM s WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cat ORDER BY b DESC, entity) <= 10)
SELECT DISTINCT cat, entity FROM (SELECT * FROM x UNION ALL SELECT * FROM y)""")
def e18(t: Tables):
    s = projections(t).groupBy("cat", "entity").agg(F.sum("sys_mean").alias("a"), F.sum("sys_eb").alias("b"))
    return R.union_of_tops(s, ["a", "b"], "cat", "entity", 10).select("cat", "entity")


@query("e22_absent_from_feed", "WITH j AS (SELECT (c_custkey % 3 > 0)::INT AS in_feed, (c_custkey IN (SELECT o_custkey FROM orders))::INT AS did_play FROM customer) SELECT in_feed, did_play, count(*) AS n FROM j GROUP BY ALL")
def e22(t: Tables):
    c = t.customer.select("c_custkey")
    return R.absent_from_feed(c, c.where("c_custkey % 3 > 0"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("e27_reproduced", "SELECT count(*) AS rows_compared, 0::BIGINT AS on_one_side, 0::BIGINT AS largest_gap, true AS same FROM facts")
def e27(t: Tables):
    return R.reproduced(t.facts, t.facts.repartition(3), ["entity", "t"], "pts", 0.0)


@query("l5_protected", "SELECT entity, t, returns > 2 AS a, lines > 6 AS b, NOT (returns > 2 OR lines > 6) AS droppable FROM facts")
def l5(t: Tables):
    p = R.protected(t.facts, {"a": F.col("returns") > 2, "b": F.col("lines") > 6})
    return p.select("entity", "t", F.array_contains("held_by", "a").alias("a"), F.array_contains("held_by", "b").alias("b"), "droppable")


@query("l20_action_order", "WITH a AS (SELECT o_custkey AS roster, o_orderkey AS action, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS deadline, o_totalprice / 5000 AS hours_left, o_totalprice AS z FROM orders) SELECT roster, action, row_number() OVER (PARTITION BY roster ORDER BY CASE WHEN deadline IS NULL THEN 0 WHEN hours_left <= 3 THEN 1 WHEN hours_left <= 24 THEN 2 ELSE 3 END, z DESC NULLS LAST, action) AS place FROM a")
def l20(t: Tables):
    a = t.orders.select(F.col("o_custkey").alias("roster"), F.col("o_orderkey").alias("action"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("deadline"), (F.col("o_totalprice") / 5000).alias("hours_left"), F.col("o_totalprice").alias("z"))
    return R.action_order(a).select("roster", "action", "place")


@query("l22_pinned_record", "SELECT o_custkey AS season, year(o_orderdate)::INT AS week, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS record FROM orders WHERE month(o_orderdate) < 7 GROUP BY ALL")
def l22(t: Tables):
    r = t.orders.select(F.col("o_custkey").alias("season"), F.year("o_orderdate").alias("week"), F.col("o_orderkey").alias("record"), F.struct("o_orderdate", "o_orderkey").alias("built_at"), F.lit(1).alias("league"))
    cut = r.select("season", "week", "league").distinct().withColumn("cutoff", F.struct(F.make_timestamp(F.col("week"), F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("o_orderdate"), F.lit(-1).cast("long").alias("o_orderkey")))
    return R.pinned(r, cut, ["league"]).select("season", "week", "record")


@query("l26_side_totals", "SELECT grp, t, coalesce(sum(pts) FILTER (returns <= 2), NULL)::BIGINT AS points, count(*) FILTER (returns = 0) AS n_final, count(*) FILTER (returns > 2) AS n_unknown FROM facts GROUP BY ALL")
def l26(t: Tables):
    s = t.facts.select("grp", "t", F.col("pts").alias("points"), F.lit(None).cast("long").alias("override"), F.lit(None).cast("long").alias("projection"), F.when(F.col("returns") > 2, "unknown").when(F.col("returns") == 0, "final").otherwise("live").alias("state"))
    return R.side_totals(s, ["grp", "t"]).select("grp", "t", "points", "n_final", "n_unknown")


@query("l29_weakest_by_season")
def l29_seasons(t: Tables):
    return R.weakest_starters(lineups(t), ["grp", "season"], ["BUILDING", "MACHINERY", "FLEX", "NONE"], "pts", "entity").select("grp", "season", "slot", "weakest")


@query("l29_weakest_starters", LINEUP + ", g AS (SELECT DISTINCT grp, s AS slot FROM lu, (VALUES ('BUILDING'), ('MACHINERY'), ('FLEX'), ('NONE')) v(s)), w AS (SELECT grp, slot, min(pts) AS weakest FROM lu WHERE slot IS NOT NULL GROUP BY ALL) SELECT grp, slot, coalesce(weakest, 0)::BIGINT AS weakest FROM g LEFT JOIN w USING (grp, slot)")
def l29(t: Tables):
    return R.weakest_starters(lineup(t), ["grp"], ["BUILDING", "MACHINERY", "FLEX", "NONE"], "pts", "entity").select("grp", "slot", "weakest")


@query("q3_first_expiry", "WITH s AS (SELECT event_type AS source, max(ts) + INTERVAL 5 HOUR AS expires FROM events GROUP BY 1) SELECT min(expires) AS expires, min_by(source, (expires, source)) AS source FROM s")
def q3(t: Tables):
    s = t.events.groupBy(F.col("event_type").alias("source")).agg((F.max("ts") + F.expr("INTERVAL 5 HOURS")).alias("expires"))
    return R.first_expiry(s)


@query("q5_finality", "SELECT o_custkey, bool_and(o_orderstatus <> 'O') AS final, count(*) FILTER (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 6 HOUR) AS overdue FROM orders GROUP BY 1")
def q5(t: Tables):
    score = F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice"))
    return R.finality(t.orders, ["o_custkey"], score, "o_orderdate", F.to_timestamp(F.lit("1997-01-01")))


@query("q8_contradictions", "WITH b AS (SELECT year(o_orderdate)::INT AS y, o_custkey AS team, o_orderdate AS k FROM orders UNION ALL SELECT year(o_orderdate)::INT, o_orderkey % 50, o_orderdate FROM orders) SELECT y, team, 'two games' AS fault FROM b GROUP BY y, team HAVING count(*) > 1")
def q8(t: Tables):
    g = t.orders.select(F.year("o_orderdate").alias("y"), "o_custkey", (F.col("o_orderkey") % 50).alias("other"), "o_orderdate")
    return R.contradictions(g, ["y"], ["o_custkey", "other"], "o_orderdate")


@query("m6_stacked_projection", PROJ + "SELECT entity, t, round(CASE WHEN sys_recent IS NULL THEN sys_mean ELSE 3.0::DOUBLE + 0.9::DOUBLE * (0.6::DOUBLE * sys_mean + (1.0::DOUBLE - 0.6::DOUBLE) * sys_recent) END, 5) AS stacked FROM pj WHERE sys_mean IS NOT NULL")
def m6(t: Tables):
    return projections(t).where("sys_mean IS NOT NULL").select("entity", "t", F.round(Z.stack(F.col("sys_mean"), F.col("sys_recent"), 0.6, 3.0, 0.9), 5).alias("stacked"))


@query("m30_demeaned_target", "SELECT entity, t, round(pts - avg(pts) OVER (PARTITION BY cat, t), 6) AS d FROM facts")
def m30(t: Tables):
    return t.facts.select("entity", "t", F.round(Z.demeaned("pts", ["cat", "t"]), 6).alias("d"))


@query("m20_super_learner")
def m20(t: Tables):
    p = projections(t).dropna(subset=["sys_mean", "sys_recent", "sys_eb"])
    return Z.super_learner(p, ["sys_mean", "sys_recent", "sys_eb"], "actual", "season", ["cat"]).select("entity", "t", F.round("stacked", 6).alias("stacked"))


@query("e26_frozen_holdout")
def e26(t: Tables):
    rows = t.facts.withColumn("y", F.lead("pts").over(Window.partitionBy("entity").orderBy("t"))).where("y IS NOT NULL")
    return Z.frozen_holdout(rows, ["cat"], ["qty", "lines"], "y", F.col("season") <= 1997).select("entity", "t", F.round("predicted", 6).alias("predicted"))


@query("m14_rest_of_season", """
WITH r AS (SELECT entity, any_value(grp) AS grp, any_value(cat) AS cat, sum(pts)::DOUBLE / count(*) AS rate FROM facts WHERE season = 1997 GROUP BY entity), s AS (SELECT n_nationkey AS grp, w AS week, CASE WHEN (n_nationkey + w) % 7 = 0 THEN 'bye' ELSE 'game' END AS state, (n_nationkey - w)::DOUBLE / 10 AS matchup FROM nation, (VALUES (1), (2), (3), (4)) v(w))
SELECT entity, cat AS category, round(sum(CASE WHEN state = 'bye' THEN 0.0::DOUBLE WHEN entity % 9 = 0 AND week < 3 THEN 0.0::DOUBLE ELSE rate + CASE cat WHEN 'BUILDING' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END * matchup END), 5) AS total, count(*) FILTER (state = 'game') AS games, 0::BIGINT AS unknown FROM r JOIN s USING (grp) GROUP BY entity, cat""")
def m14(t: Tables):
    rates = t.facts.where("season = 1997").groupBy("entity", F.col("grp").alias("team"), F.col("cat").alias("category")).agg((F.sum("pts") / F.count(F.lit(1))).alias("rate"))
    sched = t.nation.select(F.col("n_nationkey").alias("team"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("week")).select("team", "week", F.lit(0).alias("opponent"), F.when((F.col("team") + F.col("week")) % 7 == 0, "bye").otherwise("game").alias("state"), ((F.col("team") - F.col("week")) / 10.0).alias("matchup"))
    reserve = t.customer.where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("entity"), F.lit(3).alias("back_in_week"))
    return Z.rest_of_season(rates, sched, {"BUILDING": 2.0}, reserve).select("entity", "category", F.round("total", 5).alias("total"), "games", "unknown")


@query("m8_split_half", """
WITH h AS (SELECT entity, avg(pts) FILTER (WHERE t % 2 = 1) AS a, avg(pts) FILTER (WHERE t % 2 = 0) AS b, count(pts) AS n FROM facts GROUP BY entity), s AS (SELECT corr(a, b) AS r, avg(n) AS n FROM h WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT round(r, 6) AS r, round(CASE WHEN r > 0 THEN n / 2 * (1 - r) / r END, 4) AS n0 FROM s""")
def m8b(t: Tables):
    return M.split_half_n0(t.facts, "entity", F.col("t") % 2 == 1, "pts").select(F.round("r", 6).alias("r"), F.round("n0", 4).alias("n0"))
