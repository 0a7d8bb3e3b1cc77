"""Joins, windows, aggregates, sorts and set operations on the panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyard.operators import panels as P
from panelyard.plans.registry import Tables, query

KEY = ["entity", "season"]


@query("a2_column_selection", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def a2(t: Tables):
    return t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")


@query("a15_upsert_by_key", """
WITH base AS (SELECT entity, max(t) AS t FROM facts WHERE season <= 1996 GROUP BY entity), fresh AS (SELECT entity, max(t) AS t FROM facts WHERE season = 1997 GROUP BY entity)
SELECT entity, t FROM fresh UNION ALL SELECT entity, t FROM base WHERE entity NOT IN (SELECT entity FROM fresh)""")
def a15(t: Tables):
    f = t.facts
    from panelyard.sources.tables import upsert

    base = f.where("season <= 1996").groupBy("entity").agg(F.max("t").alias("t"))
    return upsert(base, f.where("season = 1997").groupBy("entity").agg(F.max("t").alias("t")), ["entity"])


@query("a16_one_per_period", "SELECT o_custkey, o_orderkey, year(o_orderdate)::INT AS season FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def a16(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("season"), "o_orderdate")
    return P.latest_by_key(rows, ["o_custkey", "season"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("j1_left_join", "SELECT c.c_custkey, o.n FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey")
def j1(t: Tables):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left")


@query("j2_inner_join", "SELECT s_nationkey, l_returnflag, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def j2(t: Tables):
    return t.lineitem.select("l_suppkey", "l_returnflag").join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("j3_full_join", """
WITH a AS (SELECT entity, sum(pts) AS x FROM facts WHERE season = 1995 GROUP BY 1), b AS (SELECT entity, sum(pts) AS y FROM facts WHERE season = 1996 GROUP BY 1)
SELECT coalesce(a.entity, b.entity) AS entity, x::BIGINT AS x, y::BIGINT AS y FROM a FULL JOIN b ON a.entity = b.entity""")
def j3(t: Tables):
    a = t.facts.where("season = 1995").groupBy("entity").agg(F.sum("pts").alias("x"))
    return a.join(t.facts.where("season = 1996").groupBy("entity").agg(F.sum("pts").alias("y")), "entity", "full")


@query("j4_anti_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j4(t: Tables):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_mktsegment").join(urgent, "c_custkey", "left_anti")


@query("j5_semi_join", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def j5(t: Tables):
    hit = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey", "p_brand").join(hit, "p_partkey", "left_semi")


@query("j6_complete_grid", """
WITH g AS (SELECT DISTINCT grp FROM facts), p AS (SELECT DISTINCT t FROM facts), x AS (SELECT grp, t, sum(lines) AS n FROM facts WHERE cat = 'BUILDING' GROUP BY ALL)
SELECT g.grp, p.t, coalesce(x.n, 0)::BIGINT AS n FROM g CROSS JOIN p LEFT JOIN x ON g.grp = x.grp AND p.t = x.t""")
def j6(t: Tables):
    f = t.facts
    span = f.groupBy("t").agg(F.lit(1).alias("one")).agg(F.array_sort(F.collect_list("t")).alias("ts"))  # periods: a calendar
    grid = f.select("grp").distinct().join(F.broadcast(span)).select("grp", F.explode("ts").alias("t"))
    return grid.join(f.where("cat = 'BUILDING'").groupBy("grp", "t").agg(F.sum("lines").alias("n")), ["grp", "t"], "left").fillna(0, ["n"])


@query("j7_asof_strict", """
WITH h AS (SELECT entity, t, sum(pts) OVER (PARTITION BY entity ORDER BY t) AS run FROM facts)
SELECT o.o_orderkey, (SELECT max_by(h.run, h.t) FROM h WHERE h.entity = o.o_custkey AND h.t < year(o.o_orderdate) * 12 + month(o.o_orderdate))::BIGINT AS run_before FROM orders o""")
def j7(t: Tables):
    run = t.facts.select("entity", "t", F.sum("pts").over(Window.partitionBy("entity").orderBy("t")).alias("run_before"))
    target = t.orders.select("o_orderkey", F.col("o_custkey").alias("entity"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("t"))
    return P.asof_join(target, run, ["entity"], "t", ["run_before"]).select("o_orderkey", "run_before")


@query("j8_asof_with_ties", """
SELECT o.o_orderkey, (SELECT max_by(f.pts, f.t) FROM facts f WHERE f.entity = o.o_custkey AND f.t <= year(o.o_orderdate) * 12 + month(o.o_orderdate))::BIGINT AS pts FROM orders o""")
def j8(t: Tables):
    target = t.orders.select("o_orderkey", F.col("o_custkey").alias("entity"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("t"))
    return P.asof_join(target, t.facts, ["entity"], "t", ["pts"], strict=False).select("o_orderkey", "pts")


@query("j9_snapshot_at_instant", """
WITH d AS (SELECT DISTINCT user_id, date_trunc('day', ts) + INTERVAL 12 HOUR AS at FROM events)
SELECT d.user_id, d.at, (SELECT max_by(e.event_id, (e.ts, e.event_id)) FROM events e WHERE e.user_id = d.user_id AND e.ts <= d.at) AS event_id FROM d""")
def j9(t: Tables):
    e = t.events.select("user_id", "ts", "event_id")
    days = e.select("user_id", (F.date_trunc("day", "ts") + F.expr("INTERVAL 12 HOURS")).alias("at")).distinct()
    return P.asof_join(days, e.select("user_id", F.col("ts").alias("at"), "event_id"), ["user_id"], "at", ["event_id"], strict=False)


@query("j11_time_window_join", """
WITH h AS (SELECT user_id % 10 AS venue, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT DISTINCT user_id % 10 AS venue, date_trunc('day', ts) AS day FROM events)
SELECT k.venue, k.day, CASE WHEN count(h.n) = 3 THEN sum(h.n)::BIGINT END AS n FROM k LEFT JOIN h ON h.venue = k.venue AND h.hour >= k.day + INTERVAL 12 HOUR AND h.hour < k.day + INTERVAL 15 HOUR GROUP BY k.venue, k.day""")
def j11(t: Tables):
    e = t.events.select((F.col("user_id") % 10).alias("venue"), "ts")
    hours = e.groupBy("venue", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    want = e.select("venue", F.date_trunc("day", "ts").alias("day")).distinct().select("venue", "day", F.explode(F.expr("sequence(day + INTERVAL 12 HOURS, day + INTERVAL 14 HOURS, INTERVAL 1 HOUR)")).alias("hour"))
    return want.join(hours, ["venue", "hour"], "left").groupBy("venue", "day").agg(F.when(F.count("n") == 3, F.sum("n")).alias("n"))


@query("j12_prior_season_join", """
WITH s AS (SELECT entity, season, sum(pts)::BIGINT AS pts FROM facts GROUP BY ALL) SELECT a.entity, a.season, a.pts, b.pts AS prior FROM s a LEFT JOIN s b ON a.entity = b.entity AND a.season = b.season + 1""")
def j12(t: Tables):
    s = t.facts.groupBy("entity", "season").agg(F.sum("pts").alias("pts"))
    return s.join(s.select("entity", (F.col("season") + 1).alias("season"), F.col("pts").alias("prior")), ["entity", "season"], "left")


@query("j13_validity_interval_join", """
WITH m AS (SELECT grp, t, entity AS top FROM facts QUALIFY row_number() OVER (PARTITION BY grp, t ORDER BY pts DESC, entity) = 1),
r AS (SELECT *, CASE WHEN top IS DISTINCT FROM lag(top) OVER (PARTITION BY grp ORDER BY t) THEN 1 ELSE 0 END AS turn FROM m), i AS (SELECT *, sum(turn) OVER (PARTITION BY grp ORDER BY t) AS run FROM r),
v AS (SELECT grp, run, top, min(t) AS period_from, max(t) AS seen FROM i GROUP BY ALL), w AS (SELECT *, coalesce(lead(period_from) OVER (PARTITION BY grp ORDER BY run) - 1, seen) AS period_to FROM v)
SELECT f.entity, f.t, w.top AS holder FROM facts f JOIN w ON f.grp = w.grp AND f.t BETWEEN w.period_from AND w.period_to""")
def j13(t: Tables):
    f = t.facts
    top = P.latest_by_key(f.select("grp", "t", "pts", F.col("entity").alias("holder")), ["grp", "t"], [F.desc("pts"), F.col("holder")])
    spans = P.validity_intervals(top, ["grp"], "t", "holder").select("grp", "holder", F.explode(F.sequence("period_from", "period_to")).alias("t"))
    return f.select("entity", "grp", "t").join(spans, ["grp", "t"]).select("entity", "t", "holder")


@query("j14_earlier_rows_alike", """
WITH n AS (SELECT grp, cat, lines, t, count(*) AS n FROM facts GROUP BY ALL), b AS (SELECT grp, cat, lines, t, coalesce(sum(n) OVER (PARTITION BY grp, cat, lines ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS alike_before FROM n)
SELECT f.entity, f.t, b.alike_before FROM facts f JOIN b ON f.t = b.t AND f.lines = b.lines AND f.grp IS NOT DISTINCT FROM b.grp AND f.cat IS NOT DISTINCT FROM b.cat""")  # counted by period first: a frame of RANGE 1 PRECEDING miscounts large groups in DuckDB
def j14(t: Tables):
    return t.facts.select("entity", "t", F.count(F.lit(1)).over(Window.partitionBy("grp", "cat", "lines").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)).alias("alike_before"))


@query("j16_crosswalk_overlay", """
SELECT l_orderkey, l_linenumber, CASE WHEN s_suppkey % 7 <> 0 THEN s_nationkey WHEN p_partkey % 3 = 0 THEN p_size END AS code FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""")
def j16(t: Tables):
    first = t.supplier.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    second = t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("b"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").join(first, "l_suppkey", "left").join(second, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("a", "b").alias("code"))


@query("j18_exact_or_abstain", """
WITH k AS (SELECT p_name, count(DISTINCT p_brand) AS n, min(p_brand) AS brand FROM part GROUP BY p_name)
SELECT p.p_partkey, CASE WHEN k.n = 1 THEN k.brand END AS brand, CASE WHEN k.n = 1 THEN 'exact' ELSE 'ambiguous' END AS basis FROM part p JOIN k USING (p_name)""")
def j18(t: Tables):
    from panelyard.operators.identity import resolve_exact

    return resolve_exact(t.part.select("p_partkey", "p_name"), t.part.select("p_name", "p_brand"), "p_name", "p_brand").select("p_partkey", F.col("resolved").alias("brand"), "basis")


@query("g1_season_to_date", """
SELECT entity, count(DISTINCT t) AS periods, max_by(cat, t) AS cat, sum(pts)::BIGINT AS pts_sum, sum(pts)::DOUBLE / count(DISTINCT t) AS pts_rate FROM facts WHERE t <= 23960 GROUP BY entity""")
def g1(t: Tables):
    return P.season_to_date(t.facts, ["entity"], "t", F.lit(23960), ["pts"], ["cat"])


@query("g3_group_totals_on_rows", "SELECT entity, t, pts, sum(pts) OVER (PARTITION BY grp, t)::BIGINT AS grp_pts, CASE WHEN sum(pts) OVER (PARTITION BY grp, t) > 0 THEN pts::DOUBLE / sum(pts) OVER (PARTITION BY grp, t) END AS share FROM facts")
def g3(t: Tables):
    return t.facts.select("entity", "t", "pts", F.sum("pts").over(Window.partitionBy("grp", "t")).alias("grp_pts"), P.share_of_group(["grp", "t"], "pts").alias("share"))


@query("g4_allowed_to_category", """
WITH per AS (SELECT grp, cat, t, sum(pts) AS x FROM facts GROUP BY ALL), own AS (SELECT grp, cat, sum(x) AS s, count(x) AS n FROM per GROUP BY ALL)
SELECT grp, cat, s::DOUBLE / n AS allowed, s::DOUBLE / n - (sum(s) OVER (PARTITION BY cat))::DOUBLE / (sum(n) OVER (PARTITION BY cat)) AS relative FROM own""")
def g4(t: Tables):
    return P.allowed_to_category(t.facts, "grp", "cat", "t", "pts")


@query("g5_grouping_sets", "SELECT coalesce(cat, 'ALL') AS cat, count(*) AS n, sum(pts)::BIGINT AS pts, sum(pts)::DOUBLE / count(*) AS mean FROM facts GROUP BY ROLLUP (cat)")
def g5(t: Tables):
    return t.facts.rollup("cat").agg(F.count(F.lit(1)).alias("n"), F.sum("pts").alias("pts"), (F.sum("pts") / F.count(F.lit(1))).alias("mean")).withColumn("cat", F.coalesce("cat", F.lit("ALL")))


@query("g6_proof_by_count", """
WITH g AS (SELECT entity, count(*) AS n, count(DISTINCT period) AS d, list(DISTINCT period) AS seen FROM facts WHERE season = 1996 GROUP BY entity)
SELECT entity, n = 4 AND d = 4 AS proven, CASE WHEN n = 4 AND d = 4 THEN array_to_string(list_sort(list_filter(range(1, 13), lambda x: NOT list_contains(seen, x))), ',') END AS off_periods FROM g""")
def g6(t: Tables):
    return P.proven_off_periods(t.facts.where("season = 1996"), "entity", "period", 4, 12).withColumn("off_periods", F.array_join("off_periods", ","))


@query("g6_proof_by_season")
def g6_seasons(t: Tables):
    f = t.facts.withColumn("key", F.struct("entity", "season"))
    return P.proven_off_periods(f, "key", "period", 4, 12).select("key.*", "proven", F.array_join("off_periods", ",").alias("off_periods"))


@query("g7_first_by_minimum", "SELECT l_orderkey, min(l_quantity) AS least, min_by(l_returnflag, l_linenumber) AS first_flag FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) = 1) GROUP BY l_orderkey")
def g7(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    clean = rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.first("l_quantity").alias("l_quantity"), F.first("l_returnflag").alias("l_returnflag")).where("n = 1")
    return clean.groupBy("l_orderkey").agg(F.min("l_quantity").alias("least"), F.min_by("l_returnflag", "l_linenumber").alias("first_flag"))


@query("g11_median_and_mad", """
WITH m AS (SELECT cat, median(pts) AS med FROM facts GROUP BY cat) SELECT f.cat, any_value(m.med) AS med, median(abs(f.pts - m.med)) AS mad FROM facts f JOIN m USING (cat) GROUP BY f.cat""")
def g11(t: Tables):
    med = t.facts.groupBy("cat").agg(F.median("pts").alias("med"))
    return t.facts.join(med, "cat").groupBy("cat").agg(F.first("med").alias("med"), F.median(F.abs(F.col("pts") - F.col("med"))).alias("mad"))


@query("g12_quantiles", "SELECT cat, quantile_cont(pts, 0.1) AS p10, quantile_cont(pts, 0.5) AS p50, quantile_cont(pts, 0.75) AS p75 FROM facts GROUP BY cat")
def g12(t: Tables):
    return t.facts.groupBy("cat").agg(F.percentile("pts", F.lit(0.1)).alias("p10"), F.percentile("pts", F.lit(0.5)).alias("p50"), F.percentile("pts", F.lit(0.75)).alias("p75"))


@query("g13_pooled_mean", """
WITH w AS (SELECT grp, t, sum(pts)::BIGINT AS v, count(*) AS n FROM facts GROUP BY ALL) SELECT grp, sum(v * n)::DOUBLE / sum(n) AS v_pooled, sum(n)::BIGINT AS weight FROM w GROUP BY grp""")
def g13(t: Tables):
    return P.pooled_mean(t.facts.groupBy("grp", "t").agg(F.sum("pts").alias("v"), F.count(F.lit(1)).alias("n")), ["grp"], "v", "n")


@query("g14_coverage", """
WITH r AS (SELECT season, CASE WHEN returns > 0 THEN returns END AS a, CASE WHEN qty > 100 THEN qty END AS b FROM facts), w AS (SELECT season, count(a)::DOUBLE / count(*) AS a, count(b)::DOUBLE / count(*) AS b FROM r GROUP BY season)
SELECT season, 'a' AS column_name, a AS coverage FROM w UNION ALL SELECT season, 'b', b FROM w""")
def g14(t: Tables):
    rows = t.facts.select("season", F.when(F.col("returns") > 0, F.col("returns")).alias("a"), F.when(F.col("qty") > 100, F.col("qty")).alias("b"))
    return P.coverage(rows, ["season"], ["a", "b"])


@query("g15_correlation_by_group", """
WITH s AS (SELECT grp, count(*)::DOUBLE AS n, sum(qty)::DOUBLE AS sx, sum(pts)::DOUBLE AS sy, sum(qty * qty)::DOUBLE AS sxx, sum(pts * pts)::DOUBLE AS syy, sum(qty * pts)::DOUBLE AS sxy FROM facts GROUP BY grp)
SELECT grp, round((n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)), 9) AS r, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 9) AS slope FROM s""")
def g15(t: Tables):
    from panelyard.operators.estimators import simple_fit

    return simple_fit(t.facts, ["grp"], "qty", "pts").select("grp", F.round("r", 9).alias("r"), F.round("slope", 9).alias("slope"))


@query("g17_top_share", """
WITH p AS (SELECT grp, t, entity, sum(lines) AS x FROM facts GROUP BY ALL) SELECT grp, t, max(x)::BIGINT AS top, sum(x)::BIGINT AS total, max(x)::DOUBLE / sum(x) AS top_share FROM p GROUP BY grp, t HAVING sum(x) >= 20""")
def g17(t: Tables):
    return P.top_share(t.facts, ["grp", "t"], "entity", "lines", 20)


@query("g18_who_had_most", "SELECT grp, season, entity, sum(pts)::BIGINT AS most FROM facts GROUP BY grp, season, entity QUALIFY row_number() OVER (PARTITION BY grp, season ORDER BY sum(pts) DESC, entity) = 1")
def g18(t: Tables):
    return P.who_had_most(t.facts, ["grp", "season"], "entity", "pts")


@query("g19_activity_pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def g19(t: Tables):
    return t.events.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "error", "purchase")])


@query("g20_share_and_lift", """
WITH a AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, n::DOUBLE / sum(n) OVER (PARTITION BY c_nationkey) AS share, (n::DOUBLE / sum(n) OVER (PARTITION BY c_nationkey)) / ((sum(n) OVER (PARTITION BY c_mktsegment))::DOUBLE / sum(n) OVER ()) AS lift FROM a""")
def g20(t: Tables):
    own, cat, every = Window.partitionBy("c_nationkey"), Window.partitionBy("c_mktsegment"), Window.partitionBy()
    a = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(own)
    return a.select("c_nationkey", "c_mktsegment", share.alias("share"), (share / (F.sum("n").over(cat) / F.sum("n").over(every))).alias("lift"))


@query("g21_price_summary", "SELECT o_orderpriority, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) AS mean, median(round(o_totalprice * 100)::BIGINT) AS med, max(round(o_totalprice * 100)::BIGINT) AS most, count(*) FILTER (o_totalprice < 5000) AS small FROM orders GROUP BY 1")
def g21(t: Tables):
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), (F.sum(c) / F.count(F.lit(1))).alias("mean"), F.median(c).alias("med"), F.max(c).alias("most"), F.count_if(F.col("o_totalprice") < 5000).alias("small"))


@query("w1_as_of_sums", """
SELECT entity, season, period, count(*) OVER (PARTITION BY entity, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS games,
 (sum(pts) OVER (PARTITION BY entity, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS pts_std, (sum(pts) OVER (PARTITION BY entity, season ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))::BIGINT AS pts_l3 FROM facts""")
def w1(t: Tables):
    return P.as_of_sums(t.facts.select(*KEY, "period", "pts"), KEY, "period", ["pts"]).drop("pts")


@query("w2_last_n_mean", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t DESC) AS k FROM facts) SELECT entity, count(*) AS rows_used, sum(pts)::DOUBLE / count(pts) AS pts_mean, sum(lines)::DOUBLE / count(lines) AS lines_mean FROM r WHERE k <= 3 GROUP BY entity""")
def w2(t: Tables):
    return P.last_n_mean(t.facts, ["entity"], "t", ["pts", "lines"])


@query("w3_trailing_window", "SELECT entity, t, (sum(pts) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))::BIGINT AS pts4 FROM facts")
def w3(t: Tables):
    return t.facts.select("entity", "t", P.trailing_sum(t.facts, ["entity"], "t", "pts", 4).alias("pts4"))


@query("w4_exponential_mean", """
WITH k AS (SELECT entity, pts, count(*) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM facts)
SELECT entity, round(sum(pts * pow(0.5, later)) / sum(pow(0.5, later)), 6) AS pts_ewm FROM k GROUP BY entity""")
def w4(t: Tables):
    return P.ewm_mean(t.facts, ["entity"], "t", "pts").withColumn("pts_ewm", F.round("pts_ewm", 6))


@query("w5_lag", "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events")
def w5(t: Tables):
    return t.events.select("event_id", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap_us"))


@query("w6_jump", "SELECT entity, t, pts - (sum(pts) OVER w)::DOUBLE / count(pts) OVER w AS jump FROM facts WINDOW w AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def w6(t: Tables):
    return t.facts.select("entity", "t", P.jump(["entity"], "t", "pts").alias("jump"))


@query("w7_share_in_latest_period", """
WITH m AS (SELECT *, max(t) OVER (PARTITION BY grp) AS last FROM facts) SELECT grp, cat, entity, CASE WHEN sum(lines) OVER (PARTITION BY grp, cat) > 0 THEN lines::DOUBLE / sum(lines) OVER (PARTITION BY grp, cat) END AS share FROM m WHERE t = last""")
def w7(t: Tables):
    return P.latest_period(t.facts, ["grp"], "t").select("grp", "cat", "entity", P.share_of_group(["grp", "cat"], "lines").alias("share"))


@query("w8_role_labels", """
WITH s AS (SELECT entity, grp, cat, sum(lines) AS n FROM facts WHERE season = 1996 GROUP BY ALL) SELECT entity, cat || row_number() OVER (PARTITION BY grp, cat ORDER BY n DESC, entity) AS role FROM s""")
def w8(t: Tables):
    s = t.facts.where("season = 1996").groupBy("entity", "grp", "cat").agg(F.sum("lines").alias("n"))
    return s.select("entity", P.role_label(["grp", "cat"], "n", "entity", "cat").alias("role"))


@query("w9_rank_among_qualified", """
WITH s AS (SELECT entity, cat, sum(pts) AS pts, count(*) AS games FROM facts WHERE season = 1996 GROUP BY ALL) SELECT entity, CASE WHEN games >= 3 THEN rank() OVER (PARTITION BY cat, games >= 3 ORDER BY pts DESC) END AS rnk FROM s""")
def w9(t: Tables):
    s = t.facts.where("season = 1996").groupBy("entity", "cat").agg(F.sum("pts").alias("pts"), F.count(F.lit(1)).alias("games"))
    return s.select("entity", P.qualified_rank(["cat"], "pts", "games", 3).alias("rnk"))


@query("w8_role_by_season")
def w8_seasons(t: Tables):
    s = t.facts.groupBy("season", "entity", "grp", "cat").agg(F.sum("lines").alias("n"))
    return s.select("season", "entity", P.role_label(["season", "grp", "cat"], "n", "entity", "cat").alias("role"))


@query("w9_rank_by_season")
def w9_seasons(t: Tables):
    s = t.facts.groupBy("season", "entity", "cat").agg(F.sum("pts").alias("pts"), F.count(F.lit(1)).alias("games"))
    return s.select("season", "entity", P.qualified_rank(["season", "cat"], "pts", "games", 3).alias("rnk"))


@query("w10_islands", """
WITH r AS (SELECT DISTINCT entity, t FROM facts), k AS (SELECT *, t - row_number() OVER (PARTITION BY entity ORDER BY t) AS run FROM r) SELECT entity, min(t) AS first_period, max(t) AS last_period, count(*) AS length FROM k GROUP BY entity, run""")
def w10(t: Tables):
    return P.islands(t.facts, ["entity"], "t")


@query("w11_league_to_date", "WITH p AS (SELECT t, sum(pts) AS pts FROM facts GROUP BY t) SELECT t, (sum(pts) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS pts_lg FROM p")
def w11(t: Tables):
    return P.league_to_date(t.facts, "t", ["pts"])


@query("w12_running_median", """
WITH p AS (SELECT grp, t, sum(pts)::BIGINT AS pts FROM facts GROUP BY ALL) SELECT grp, t, CASE WHEN count(*) OVER w >= 5 THEN quantile_cont(pts, 0.5) OVER w END AS med FROM p WINDOW w AS (PARTITION BY grp ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""")
def w12(t: Tables):
    p = t.facts.groupBy("grp", "t").agg(F.sum("pts").alias("pts"))
    return p.select("grp", "t", P.running_median(["grp"], "t", "pts").alias("med"))


@query("w13_monotone_curve", """
WITH p AS (SELECT cat, entity, sum(pts)::BIGINT AS pts FROM facts GROUP BY ALL), r AS (SELECT cat, pts, row_number() OVER (PARTITION BY cat ORDER BY pts DESC, entity) AS rnk FROM p), s AS (SELECT *, (sum(pts) OVER w)::DOUBLE / count(pts) OVER w AS smooth FROM r WINDOW w AS (PARTITION BY cat ORDER BY rnk ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT cat, rnk, min(smooth) OVER (PARTITION BY cat ORDER BY rnk ROWS UNBOUNDED PRECEDING) AS curve FROM s""")
def w13(t: Tables):
    p = t.facts.groupBy("cat", "entity").agg(F.sum("pts").alias("pts"))
    ranked = p.withColumn("rnk", F.row_number().over(Window.partitionBy("cat").orderBy(F.desc("pts"), "entity")))
    return P.monotone_curve(ranked, ["cat"], "rnk", "pts").select("cat", "rnk", "curve")


@query("w15_open_close", """
WITH c AS (SELECT *, date_trunc('day', ts) + INTERVAL 18 HOUR AS cut, date_trunc('day', ts) AS day FROM events)
SELECT user_id, day, min_by(value, ts) FILTER (ts <= cut) AS open, max_by(value, ts) FILTER (ts <= cut) AS close, count(*) FILTER (ts <= cut) AS quotes, count(*) FILTER (ts > cut) AS after FROM c GROUP BY user_id, day""")
def w15(t: Tables):
    e = t.events.withColumn("day", F.date_trunc("day", "ts")).withColumn("cut", F.col("day") + F.expr("INTERVAL 18 HOURS"))
    return P.open_close(e, ["user_id", "day"], "ts", "value", F.col("cut"))


@query("w18_ever_before", "SELECT entity, t, coalesce(max((returns > 0)::INT) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS had FROM facts")
def w18(t: Tables):
    f = t.facts.withColumn("flag", F.col("returns") > 0)
    return f.select("entity", "t", P.ever_before(["entity"], "t", "flag").alias("had"))


@query("w19_regulars", """
WITH f AS (SELECT entity, grp, t, lines::DOUBLE / sum(lines) OVER (PARTITION BY grp, t) AS share FROM facts), c AS (SELECT grp, t, row_number() OVER (PARTITION BY grp ORDER BY t) AS g FROM (SELECT DISTINCT grp, t FROM facts)),
r AS (SELECT f.entity, f.grp, c.g, f.share FROM f JOIN c USING (grp, t)), m AS (SELECT r.entity, c.grp, c.t, sum(r.share) / 3 AS share_before FROM c JOIN r ON r.grp = c.grp AND r.g BETWEEN c.g - 3 AND c.g - 1 GROUP BY ALL)
SELECT entity, grp, t, round(share_before, 9) AS share_before FROM m WHERE share_before >= 0.1""")
def w19(t: Tables):
    f = t.facts.withColumn("share", F.col("lines") / F.sum("lines").over(Window.partitionBy("grp", "t")))
    return P.regulars(f, "entity", "grp", "t", "share", 3, 0.1).select("entity", "grp", "t", F.round("share_before", 9).alias("share_before"))


@query("w20_first_with_prior", """
WITH f AS (SELECT entity, season, period, pts, row_number() OVER (PARTITION BY entity, season ORDER BY period) AS k FROM facts), s AS (SELECT entity, season, sum(pts)::BIGINT AS prior FROM facts GROUP BY ALL)
SELECT f.entity, f.season, f.period, f.pts, s.prior FROM f JOIN s ON f.entity = s.entity AND f.season = s.season + 1 WHERE k = 1""")
def w20(t: Tables):
    prior = t.facts.groupBy("entity", (F.col("season") + 1).alias("season")).agg(F.sum("pts").alias("prior"))
    return P.first_appearance(t.facts, "entity", "season", "period").join(prior, ["entity", "season"]).select("entity", "season", "period", "pts", "prior")


@query("w23_share_history", """
WITH f AS (SELECT entity, grp, season, period, lines, sum(lines) OVER (PARTITION BY grp, season, period) AS team FROM facts), s AS (SELECT *, sum(lines) OVER w AS own_std, sum(team) OVER w AS team_std FROM f WINDOW w AS (PARTITION BY entity, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT entity, season, period, CASE WHEN team_std > 0 THEN own_std::DOUBLE / team_std END AS share_std FROM s""")
def w23(t: Tables):
    from panelyard.operators.features import share_history

    return share_history(t.facts, "entity", "grp", "season", "period", "lines").select("entity", "season", "period", "share_std")


@query("o1_global_sort", "SELECT entity, sum(pts)::BIGINT AS pts, row_number() OVER (ORDER BY sum(pts) DESC, entity) AS place FROM facts GROUP BY entity ORDER BY pts DESC, entity LIMIT 50")
def o1(t: Tables):
    best = t.facts.groupBy("entity").agg(F.sum("pts").alias("pts")).orderBy(F.desc("pts"), "entity").limit(50)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("pts"), "entity")))  # 50 rows


@query("o1_whole_sort", "SELECT entity, sum(pts)::BIGINT AS pts FROM facts GROUP BY entity")
def o1_whole(t: Tables):
    """Every row, in one order over all partitions."""
    return t.facts.groupBy("entity").agg(F.sum("pts").alias("pts")).orderBy(F.desc("pts"), "entity")


@query("o2_top_k_per_group", "WITH s AS (SELECT grp, entity, sum(pts)::BIGINT AS pts FROM facts GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pts DESC, entity) AS rank FROM s QUALIFY rank <= 5")
def o2(t: Tables):
    return P.top_k(t.facts.groupBy("grp", "entity").agg(F.sum("pts").alias("pts")), ["grp"], [F.desc("pts"), F.col("entity")], 5)


@query("o3_replacement_level", """
WITH s AS (SELECT entity, cat, sum(pts)::BIGINT AS pts FROM facts GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY pts DESC, entity) AS cat_rank, CASE cat WHEN 'BUILDING' THEN 12 WHEN 'MACHINERY' THEN 24 WHEN 'HOUSEHOLD' THEN 30 ELSE 0 END AS need FROM s),
p AS (SELECT cat, entity FROM r WHERE cat_rank > need AND cat_rank <= need + 10 AND cat IN ('MACHINERY', 'HOUSEHOLD') ORDER BY pts DESC, entity LIMIT 10), x AS (SELECT cat, count(*) AS flexed FROM p GROUP BY cat),
l AS (SELECT r.*, cat_rank <= need + coalesce(flexed, 0) AS starts FROM r LEFT JOIN x USING (cat)), v AS (SELECT cat, max(pts) AS replacement FROM l WHERE NOT starts GROUP BY cat)
SELECT entity, cat, pts, cat_rank, starts, replacement, pts - replacement AS over_replacement FROM l LEFT JOIN v USING (cat)""")
def o3(t: Tables):
    s = t.facts.groupBy("entity", "cat").agg(F.sum("pts").alias("pts"))
    return P.replacement_level(s, "cat", "pts", "entity", {"BUILDING": 12, "MACHINERY": 24, "HOUSEHOLD": 30}, ["MACHINERY", "HOUSEHOLD"], 10)


@query("o4_kth_order_statistic", "WITH r AS (SELECT cat, t, pts, row_number() OVER (PARTITION BY cat, t ORDER BY pts DESC, entity) AS k FROM facts) SELECT cat, count(*) AS periods, sum(pts)::DOUBLE / count(*) AS mean FROM r WHERE k = 6 GROUP BY cat")
def o4(t: Tables):
    r = P.top_k(t.facts, ["cat", "t"], [F.desc("pts"), F.col("entity")], 6).where("rank = 6")
    return r.groupBy("cat").agg(F.count(F.lit(1)).alias("periods"), (F.sum("pts") / F.count(F.lit(1))).alias("mean"))


@query("o6_first_eligible", "SELECT grp, min_by(entity, (-pts, entity)) AS entity FROM (SELECT grp, entity, sum(pts)::BIGINT AS pts, sum(returns) AS r FROM facts GROUP BY ALL) WHERE r = 0 GROUP BY grp")
def o6(t: Tables):
    s = t.facts.groupBy("grp", "entity").agg(F.sum("pts").alias("pts"), F.sum("returns").alias("r"))
    return s.where("r = 0").groupBy("grp").agg(F.min_by("entity", F.struct(-F.col("pts"), "entity")).alias("entity"))


@query("u1_union_with_drift", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal, NULL AS seg FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def u1(t: Tables):
    a = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")), allowMissingColumns=True)


@query("u2_first_source_wins", """
WITH a AS (SELECT entity, t, 1 AS src FROM facts WHERE returns > 0), b AS (SELECT entity, t, 2 AS src FROM facts WHERE lines > 4) SELECT entity, t, min(src) AS src FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY entity, t""")
def u2(t: Tables):
    f = t.facts
    return f.where("returns > 0").select("entity", "t", F.lit(1).alias("src")).union(f.where("lines > 4").select("entity", "t", F.lit(2).alias("src"))).groupBy("entity", "t").agg(F.min("src").alias("src"))


@query("u3_arrivals_departures", """
WITH a AS (SELECT DISTINCT grp, entity FROM facts WHERE season = 1995), b AS (SELECT DISTINCT grp, entity FROM facts WHERE season = 1996)
SELECT grp, entity, 'gone' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT grp, entity, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def u3(t: Tables):
    a, b = (t.facts.where(f"season = {y}").select("grp", "entity").distinct() for y in (1995, 1996))
    return a.join(b, ["grp", "entity"], "left_anti").withColumn("change", F.lit("gone")).union(b.join(a, ["grp", "entity"], "left_anti").withColumn("change", F.lit("added")))


@query("u4_intersection", "SELECT entity FROM facts WHERE season = 1995 INTERSECT SELECT entity FROM facts WHERE season = 1996")
def u4(t: Tables):
    return t.facts.where("season = 1995").select("entity").intersect(t.facts.where("season = 1996").select("entity"))


@query("u5_missing_by_season")
def u5_seasons(t: Tables):
    s = t.facts.groupBy("season", "entity").agg(F.collect_set("period").alias("seen"), F.min("period").alias("lo"), F.max("period").alias("hi"))
    return s.select("season", "entity", F.array_join(F.array_sort(F.array_except(F.sequence("lo", "hi"), "seen")), ",").alias("missing"))


@query("u5_missing_periods", """
WITH s AS (SELECT entity, list(DISTINCT period) AS seen, min(period) AS lo, max(period) AS hi FROM facts WHERE season = 1996 GROUP BY entity) SELECT entity, array_to_string(list_sort(list_filter(range(lo, hi + 1), lambda x: NOT list_contains(seen, x))), ',') AS missing FROM s""")
def u5(t: Tables):
    s = t.facts.where("season = 1996").groupBy("entity").agg(F.collect_set("period").alias("seen"), F.min("period").alias("lo"), F.max("period").alias("hi"))
    return s.select("entity", F.array_join(F.array_sort(F.array_except(F.sequence("lo", "hi"), "seen")), ",").alias("missing"))
