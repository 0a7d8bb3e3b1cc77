"""Scores, features, estimators, markets, probabilities, evaluation, allocation, changes and quality on the panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyard.functions import scalars as S
from panelyard.operators import allocation as L
from panelyard.operators import changes as C
from panelyard.operators import estimators as M
from panelyard.operators import evaluation as E
from panelyard.operators import features as H
from panelyard.operators import market as K
from panelyard.operators import panels as P
from panelyard.operators import probability as R
from panelyard.operators import quality as Q
from panelyard.operators import scored as D
from panelyard.operators.scratch import settled
from panelyard.plans.registry import Tables, query
from panelyard.sources import tables as A

def NOW():
    return F.to_timestamp(F.lit("2024-01-15 12:00:00"))

def cdf_sql(z: str) -> str:
    """The normal distribution function in SQL, another way than ``scalars.normal_cdf``: a power series within three deviations, a continued fraction beyond."""
    x = f"abs({z})::DOUBLE"
    density = f"(exp(-{x} * {x} / 2) / sqrt(2 * pi()))"
    series = f"{density} * list_sum(list_transform(range(0, 60), lambda k: pow({x}, 2 * k + 1) * exp(ln(pi()) / 2 - (k + 1) * ln(2.0::DOUBLE) - lgamma(k + 1.5::DOUBLE))))"
    beyond = f"{density} / list_reduce(list_concat([greatest({x}, 3)], list_transform(range(80, 0, -1), lambda k: k::DOUBLE)), lambda a, k: greatest({x}, 3) + k / a)"
    return f"(CASE WHEN {x} < 3 THEN 0.5::DOUBLE + sign({z}) * {series} WHEN {z} > 0 THEN 1 - {beyond} ELSE {beyond} END)"


# ---------------------------------------------------------------- flagship

FLAGSHIP_SQL = """
WITH h AS (SELECT entity, cat, season, period, pts, count(*) OVER w AS games, (sum(pts) OVER w)::BIGINT AS pts_std FROM facts WINDOW w AS (PARTITION BY entity, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lg AS (SELECT season, period, (sum(s) OVER w)::DOUBLE / sum(n) OVER w AS mean FROM (SELECT season, period, sum(pts)::BIGINT AS s, count(*) AS n FROM facts GROUP BY ALL) WINDOW w AS (PARTITION BY season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT h.*, (coalesce(pts_std, 0) + lg.mean * 4.0::DOUBLE) / (games + 4.0::DOUBLE) AS projection FROM h JOIN lg USING (season, period) WHERE lg.mean IS NOT NULL)
SELECT entity, cat, season, period, pts, round(projection, 6) AS projection, rank() OVER (PARTITION BY cat, season, period ORDER BY projection DESC) AS place, round(abs(projection - pts), 6) AS error FROM p"""


@query("flagship", FLAGSHIP_SQL)
def flagship(t: Tables):
    """Score, sums before each period, projection shrunk to the league, rank within the category, error."""
    f = t.facts
    own = P.as_of_sums(f, ["entity", "season"], "period", ["pts"])
    per = f.groupBy("season", "period").agg(F.sum("pts").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("season").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    league = per.select("season", "period", (F.sum("s").over(w) / F.sum("n").over(w)).alias("mean")).where("mean IS NOT NULL")
    p = own.join(league, ["season", "period"]).withColumn("projection", S.eb_shrink(F.coalesce("pts_std", F.lit(0)), F.col("games"), F.col("mean"), 4.0))
    p = P.ranks(p, ["cat", "season", "period"], -F.col("projection"), "place")
    return p.select("entity", "cat", "season", "period", "pts", F.round("projection", 6).alias("projection"), "place", F.round(F.abs(F.col("projection") - F.col("pts")), 6).alias("error"))


def projections(t: Tables):
    """Outcomes beside three systems: the mean before, the last three, and the shrunk mean; early periods have nulls."""
    f = H.core(t.facts, "entity", "season", "period", ["pts"])
    return f.select("entity", "grp", "cat", "season", "period", "t", F.col("pts").cast("double").alias("actual"), F.round("pts_mean", 6).alias("sys_mean"), F.round("pts_recent", 6).alias("sys_recent"), F.round((F.coalesce(F.col("pts_mean") * F.col("games"), F.lit(0.0)) + 400.0 * 2) / (F.col("games") + 2), 6).alias("sys_eb"))


PROJ = """
WITH pj AS (SELECT entity, grp, cat, season, period, t, pts::DOUBLE AS actual, round((sum(pts) OVER w)::DOUBLE / count(pts) OVER w, 6) AS sys_mean, round((sum(pts) OVER r)::DOUBLE / count(pts) OVER r, 6) AS sys_recent,
  round((coalesce(((sum(pts) OVER w)::DOUBLE / count(pts) OVER w) * count(*) OVER w, 0.0::DOUBLE) + 400.0::DOUBLE * 2) / (count(*) OVER w + 2), 6) AS sys_eb
  FROM facts WINDOW w AS (PARTITION BY entity, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r AS (PARTITION BY entity, season ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
"""

# ------------------------------------------------------- A, B, D: sources, predicates, scores


@query("a7_unpivot_games", "SELECT l_orderkey, l_linenumber, l_suppkey AS side, l_partkey AS opponent, 1 AS is_home, l_quantity AS margin FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0, -l_quantity FROM lineitem")
def a7(t: Tables):
    return A.unpivot_games(t.lineitem, "l_suppkey", "l_partkey", "l_quantity", ["l_orderkey", "l_linenumber"])


@query("a18_run_manifest", "SELECT 'orders' AS source, count(*) AS n, min(year(o_orderdate))::INT AS first_period, max(year(o_orderdate))::INT AS last_period FROM orders UNION ALL SELECT 'lineitem', count(*), min(year(l_shipdate))::INT, max(year(l_shipdate))::INT FROM lineitem")
def a18(t: Tables):
    m = A.run_manifest({"orders": t.orders.select(F.year("o_orderdate").alias("p")), "lineitem": t.lineitem.select(F.year("l_shipdate").alias("p"))}, NOW(), "p")
    return m.select("source", "n", "first_period", "last_period")


@query("a19_ambiguous_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a19(t: Tables):
    return A.ambiguous_keys(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])[1]


@query("a21_by_system", "SELECT c_nationkey, max(c_custkey) FILTER (c_mktsegment = 'BUILDING') AS BUILDING, max(c_custkey) FILTER (c_mktsegment = 'MACHINERY') AS MACHINERY FROM customer GROUP BY 1")
def a21(t: Tables):
    return A.by_system(t.customer.select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey"], "c_mktsegment", "c_custkey", ["BUILDING", "MACHINERY"])


@query("b3_flags_and_classifiers", "SELECT event_id, coalesce((value > 20)::INT, 0) = 1 AS big, event_type IN ('click', 'view') AS browse, CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 20 AND 80 AS neutral FROM events")
def b3(t: Tables):
    return t.events.select("event_id", S.coalesce_flag(F.col("value") > 20).alias("big"), F.col("event_type").isin("click", "view").alias("browse"), S.json_field(F.col("props"), "$.k", "int").between(20, 80).alias("neutral"))


@query("b11_bands", "SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 THEN 10.0 WHEN o_totalprice <= 150000 THEN 4.0 WHEN o_totalprice <= 300000 THEN 1.0 ELSE -4.0 END::DOUBLE AS tier FROM orders")
def b11(t: Tables):
    return t.orders.select("o_orderkey", D.tier(F.col("o_totalprice"), [(50000, 10.0), (150000, 4.0), (300000, 1.0)], -4.0).alias("tier"))


@query("b12_known_flags", "SELECT entity, t, coalesce(a, 0)::BIGINT AS a, (a IS NOT NULL)::INT AS a__known, b FROM (SELECT entity, t, CASE WHEN returns > 0 THEN returns END AS a, qty AS b FROM facts)")
def b12(t: Tables):
    return H.known_flags(t.facts.select("entity", "t", F.when(F.col("returns") > 0, F.col("returns")).alias("a"), F.col("qty").alias("b")), ["a", "b"])


@query("d1_weighted_score", "SELECT l_orderkey, l_linenumber, 2.0::DOUBLE * (l_quantity + l_discount) + -3.0::DOUBLE * l_tax AS score FROM lineitem")
def d1(t: Tables):
    rules = {"x": (2.0, ["l_quantity", "l_discount"], ["old"]), "y": (-3.0, ["not_there"], ["l_tax"])}
    score = D.weighted_score(t.lineitem.columns, rules)
    return t.lineitem.select("l_orderkey", "l_linenumber", (score - 0.0).alias("score"))


@query("d13_most_severe", "SELECT o_custkey, year(o_orderdate)::INT AS y, max_by(o_orderstatus, (CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 WHEN 'O' THEN 1 ELSE 0 END, o_orderstatus)) AS o_orderstatus FROM orders GROUP BY ALL")
def d13(t: Tables):
    rows = t.orders.select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderstatus")
    return D.most_severe(rows, ["o_custkey", "y"], "o_orderstatus", {"F": 3, "P": 2, "O": 1}).drop("severity")


@query("d23_draft_ledger", """
WITH p AS (SELECT grp AS draft, entity, sum(pts)::BIGINT AS value FROM facts GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY draft ORDER BY md5(entity::VARCHAR)) AS pick FROM p)
SELECT draft, entity, value, pick, (max(value) OVER (PARTITION BY draft ORDER BY pick ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))::BIGINT AS best_left, greatest((max(value) OVER (PARTITION BY draft ORDER BY pick ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) - value, 0)::BIGINT AS given_up FROM k""")
def d23(t: Tables):
    p = t.facts.groupBy(F.col("grp").alias("draft"), "entity").agg(F.sum("pts").alias("value"))
    return D.draft_ledger(p.withColumn("pick", F.row_number().over(Window.partitionBy("draft").orderBy(F.md5(F.col("entity").cast("string"))))))


@query("d29_zero_outcomes", "WITH b AS (SELECT DISTINCT o_custkey, o_orderkey, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, o_orderkey, v FROM b UNION ALL SELECT o_custkey, o_orderkey, 0.0 FROM orders WHERE o_orderstatus <> 'F'")
def d29(t: Tables):
    box = t.orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("v")).distinct()
    return D.snap_only_zeros(box, t.orders, ["o_custkey", "o_orderkey"], "v")


# ---------------------------------------------------------------- F: scalar functions


@query("f1_f2_keys", r"SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_custkey::VARCHAR END AS norm, regexp_replace(regexp_replace(lower(c_name), '\s+(jr|sr|ii|iii|iv|v)\.?\s*$', ''), '[^a-z]', '', 'g') AS key FROM customer")
def f1(t: Tables):
    raw = F.when(F.col("c_custkey") % 5 == 0, " NaN ").when(F.col("c_custkey") % 5 == 1, F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).otherwise(F.col("c_custkey").cast("string"))
    return t.customer.select("c_custkey", S.normalize_id(raw).alias("norm"), S.name_key(F.col("c_name")).alias("key"))


@query("f7_implied_probability", "WITH q AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) * 7 - 300 AS price FROM events) SELECT event_id, CASE WHEN price >= 100 THEN 100.0::DOUBLE / (price + 100.0::DOUBLE) WHEN price <= -100 THEN -price / (-price + 100.0::DOUBLE) END AS p FROM q")
def f7(t: Tables):
    return t.events.select("event_id", S.implied_probability(S.json_field(F.col("props"), "$.k", "int") * 7 - 300).alias("p"))


@query("f8_f10_line_effects", "SELECT o_orderkey, round((o_totalprice / 1000 + 5) / 2.0::DOUBLE, 9) AS home, round((o_totalprice / 1000 - 5) / 2.0::DOUBLE, 9) AS away, round((0.791::DOUBLE + 0.042::DOUBLE * ((o_totalprice / 1000 + 5) / 2.0::DOUBLE)) / 1.715::DOUBLE, 9) AS multiplier FROM orders")
def f8(t: Tables):
    home, away = S.implied_totals(F.col("o_totalprice") / 1000, F.lit(5))
    return t.orders.select("o_orderkey", F.round(home, 9).alias("home"), F.round(away, 9).alias("away"), F.round(S.line_multiplier(home, 0.791, 0.042, 22.0), 9).alias("multiplier"))


@query("f11_shrinkage", "SELECT entity, round((sum(returns) + 0.33::DOUBLE * 20.0::DOUBLE) / (sum(lines) + 20.0::DOUBLE), 9) AS rate, round(sum(lines)::DOUBLE / (sum(lines) + 20.0::DOUBLE), 9) AS weight, round((sum(returns) - sum(lines) * 0.33::DOUBLE) / (sum(lines) + 20.0::DOUBLE), 9) AS above FROM facts GROUP BY entity")
def f11(t: Tables):
    s = t.facts.groupBy("entity").agg(F.sum("returns").alias("x"), F.sum("lines").alias("n"))
    return s.select("entity", F.round(S.eb_shrink(F.col("x"), F.col("n"), 0.33, 20.0), 9).alias("rate"), F.round(S.shrink_weight(F.col("n"), 20.0), 9).alias("weight"), F.round(S.over_league(F.col("x"), F.col("n"), F.lit(0.33), 20.0), 9).alias("above"))


@query("f13_normal_probabilities", f"SELECT o_orderkey, round({cdf_sql('(o_totalprice - 150000) / 80000')}, 9) AS p FROM orders")
def f13(t: Tables):
    return t.orders.select("o_orderkey", F.round(S.normal_cdf((F.col("o_totalprice") - 150000) / 80000), 9).alias("p"))


@query("f14_poisson_tail", "SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE list_sum(list_transform(range(0, (event_id % 5)::BIGINT + 1), lambda i: exp(-(value / 10)) * pow(value / 10, i) / [1, 1, 2, 6, 24, 120][i + 1])) END, 9) AS cdf FROM events")
def f14(t: Tables):
    return t.events.select("event_id", F.round(S.poisson_cdf(F.col("event_id") % 5, F.col("value") / 10), 9).alias("cdf"))


@query("f15_f16_clocks", "SELECT event_id, round(abs(ln(1 - 0.5::DOUBLE * (event_id % 2))), 9) AS rate, CASE WHEN event_id % 3 = 0 THEN (year(ts) - (month(ts) < 3)::INT)::INT END AS season, epoch_us(ts) // 1000000 // 3600 AS hours FROM events")
def f15(t: Tables):
    return t.events.select("event_id", F.round(S.anytime_rate(0.5 * (F.col("event_id") % 2)), 9).alias("rate"), F.when(F.col("event_id") % 3 == 0, S.season_of(F.col("ts"))).alias("season"), F.floor(F.unix_seconds("ts") / 3600).alias("hours"))


@query("f22_snake_picks", "SELECT c_custkey, ((c_custkey // 12) * 12 + CASE WHEN (c_custkey // 12 + 1) % 2 = 1 THEN c_custkey % 12 + 1 ELSE 13 - (c_custkey % 12 + 1) END)::BIGINT AS pick FROM customer")
def f22(t: Tables):
    return t.customer.select("c_custkey", S.snake_pick(F.col("c_custkey") % 12 + 1, F.floor(F.col("c_custkey") / 12) + 1, 12).alias("pick"))


@query("f23_availability", "WITH r AS (SELECT p_partkey, p_size + 1 AS pick, p_retailprice / 40 AS adp FROM part), z AS (SELECT p_partkey, (pick - 0.5::DOUBLE - adp) / greatest(1.0::DOUBLE, 0.57::DOUBLE + 0.11::DOUBLE * adp) AS z FROM r) SELECT p_partkey, round(1.0::DOUBLE - " + cdf_sql("z") + ", 9) AS there FROM z")
def f23(t: Tables):
    return t.part.select("p_partkey", F.round(S.availability(F.col("p_size") + 1, F.col("p_retailprice") / 40), 9).alias("there"))


@query("f24_digest", "SELECT s_suppkey, sha256('{\"s_suppkey\":' || s_suppkey || ',\"s_nationkey\":' || s_nationkey || '}') AS digest FROM supplier")
def f24(t: Tables):
    return t.supplier.select("s_suppkey", S.digest("s_suppkey", "s_nationkey").alias("digest"))


@query("f25_reasons", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END], lambda x: x IS NOT NULL), '; ') AS why FROM orders")
def f25(t: Tables):
    return t.orders.select("o_orderkey", F.array_join(S.reasons((F.col("o_totalprice") > 300000, "large"), (F.col("o_orderstatus") == "O", "open")), "; ").alias("why"))


# ---------------------------------------------------------------- H: features


@query("h1_core_features", PROJ.replace("WITH pj", "WITH x", 1).replace("sys_", "m_") + "SELECT entity, season, period, m_mean, m_recent FROM x")
def h1(t: Tables):
    f = H.core(t.facts, "entity", "season", "period", ["pts"])
    return f.select("entity", "season", "period", F.round("pts_mean", 6).alias("m_mean"), F.round("pts_recent", 6).alias("m_recent"))


@query("h2_vacated_pickup", """
WITH f AS (SELECT entity, grp, t, lines::DOUBLE / sum(lines) OVER (PARTITION BY grp, t) AS share, returns > 1 AS away FROM facts),
s AS (SELECT *, coalesce(sum(share) FILTER (away) OVER w, 0) AS v, coalesce(sum(share) FILTER (NOT away) OVER w, 0) AS a FROM f WINDOW w AS (PARTITION BY grp, t))
SELECT entity, t, round(v, 9) AS vacated, round(CASE WHEN v = 0 OR away THEN 0.0::DOUBLE WHEN a > 0 THEN v * share / a END, 9) AS pickup FROM s""")
def h2(t: Tables):
    f = t.facts.select("entity", "grp", "t", P.share_of_group(["grp", "t"], "lines").alias("share"), (F.col("returns") > 1).alias("away"))
    return H.vacated(f, ["grp", "t"], "share", F.col("away")).select("entity", "t", F.round("vacated", 9).alias("vacated"), F.round("pickup", 9).alias("pickup"))


@query("h3_role_change", """
SELECT entity, t, lag(lines) OVER w AS last, lag(lines) OVER w - (sum(lines) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING))::DOUBLE / count(lines) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING) AS jump FROM facts WINDOW w AS (PARTITION BY entity ORDER BY t)""")
def h3(t: Tables):
    return H.role_change(t.facts, "entity", "grp", "t", "lines").select("entity", "t", "last", "jump")


@query("h9_expected_starter", """
WITH c AS (SELECT grp, t, entity, row_number() OVER (PARTITION BY grp, t ORDER BY lines DESC, entity) AS depth FROM facts), o AS (SELECT grp, t, entity FROM facts WHERE returns > 2)
SELECT grp, t, min_by(entity, (depth, entity)) AS entity FROM c WHERE (grp, t, entity) NOT IN (SELECT (grp, t, entity) FROM o) GROUP BY grp, t""")
def h9(t: Tables):
    f = t.facts
    charts = f.select("grp", "t", "entity", F.row_number().over(Window.partitionBy("grp", "t").orderBy(F.desc("lines"), "entity")).alias("depth"))
    return H.expected_starter(charts, f.where("returns > 2"), ["grp", "t"], "entity", "depth").select("grp", "t", "entity")


@query("h10_tendency", """
WITH o AS (SELECT entity AS person, grp, season, period, cat AS bucket, lines AS value FROM facts), m AS (SELECT season, bucket, sum(value)::DOUBLE / count(*) AS m FROM o GROUP BY ALL), d AS (SELECT o.*, o.value - m.m AS d FROM o JOIN m USING (season, bucket)),
p AS (SELECT person, grp, season, period, sum(d) AS d, count(d) AS n FROM d GROUP BY ALL), s AS (SELECT *, sum(d) OVER w AS sd, sum(n) OVER w AS sn FROM p WINDOW w AS (PARTITION BY person, grp, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT person, season, sum(d) AS d, sum(n) AS n FROM p GROUP BY ALL), c AS (SELECT person, season, sum(d) OVER w AS cd, sum(n) OVER w AS cn FROM y WINDOW w AS (PARTITION BY person ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT s.person, s.season, s.period, round(CASE WHEN coalesce(cn, 0) + coalesce(sn, 0) > 0 THEN (coalesce(cd, 0) + coalesce(sd, 0)) / (coalesce(cn, 0) + coalesce(sn, 0) + 10.0::DOUBLE) END, 7) AS pooled FROM s JOIN c USING (person, season)""")
def h10(t: Tables):
    o = t.facts.select(F.col("entity").alias("person"), "grp", "season", "period", F.col("cat").alias("bucket"), F.col("lines").alias("value"))
    return H.tendency(o, "person", "grp", "season", "period", "value", "bucket", 10.0).select("person", "season", "period", F.round("pooled", 7).alias("pooled"))


@query("h14_conditional_shares", """
WITH e AS (SELECT l_suppkey, s_nationkey, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_quantity > 40) AS big FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT l_suppkey, s_nationkey, r, big, CASE WHEN sum(r) OVER w > 0 THEN r::DOUBLE / sum(r) OVER w END AS r_share, CASE WHEN sum(big) OVER w > 0 THEN big::DOUBLE / sum(big) OVER w END AS big_share FROM e WINDOW w AS (PARTITION BY s_nationkey)""")
def h14(t: Tables):
    e = t.lineitem.select("l_suppkey", "l_returnflag", "l_quantity").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return H.conditional_shares(e, "l_suppkey", "s_nationkey", [], {"r": F.col("l_returnflag") == "R", "big": F.col("l_quantity") > 40})


@query("h16_absence_ramp", """
WITH c AS (SELECT grp, t, row_number() OVER (PARTITION BY grp ORDER BY t) AS g FROM (SELECT DISTINCT grp, t FROM facts)), r AS (SELECT f.entity, f.grp, f.t, c.g, c.g - lag(c.g) OVER (PARTITION BY f.entity, f.grp ORDER BY c.g) - 1 AS missed FROM facts f JOIN c USING (grp, t)),
k AS (SELECT *, sum((coalesce(missed, 0) >= 2)::INT) OVER (PARTITION BY entity, grp ORDER BY g) AS run FROM r) SELECT entity, t, missed, CASE WHEN run > 0 THEN row_number() OVER (PARTITION BY entity, grp, run ORDER BY g) END AS since_return FROM k""")
def h16(t: Tables):
    return H.absence_ramp(t.facts, "entity", "grp", "t").select("entity", "t", "missed", "since_return")


@query("h18_newcomers", """
WITH c AS (SELECT grp, t, row_number() OVER (PARTITION BY grp ORDER BY t) AS g FROM (SELECT DISTINCT grp, t FROM facts)), r AS (SELECT f.entity, f.grp, f.t, c.g FROM facts f JOIN c USING (grp, t))
SELECT entity, t, CASE WHEN g > 1 THEN NOT coalesce(lag(g) OVER w = g - 1, false) END AS newcomer, row_number() OVER w - 1 AS tenure FROM r WINDOW w AS (PARTITION BY entity, grp ORDER BY g)""")
def h18(t: Tables):
    return H.newcomers(t.facts, "entity", "grp", "t").select("entity", "t", "newcomer", "tenure")


@query("h30_bucket_expectation", """
WITH p AS (SELECT year(l_shipdate)::INT AS season, (floor(least(l_quantity, 60) / 5) * 5)::INT AS bucket, sum((l_returnflag = 'A')::INT) AS m, count(*) AS n FROM lineitem GROUP BY ALL), l AS (SELECT bucket, m, n, season + k AS season FROM p, (VALUES (1), (2), (3)) v(k))
SELECT season::INT AS season, bucket, sum(m)::DOUBLE / sum(n) AS expected FROM l GROUP BY season, bucket""")
def h30(t: Tables):
    tries = t.lineitem.select(F.year("l_shipdate").alias("season"), S.distance_bucket(F.col("l_quantity")).alias("bucket"), (F.col("l_returnflag") == "A").cast("int").alias("made"))
    return H.bucket_expectation(tries, "season", "bucket", "made")


@query("h34_opponent_relative", """
WITH p AS (SELECT grp, season, period, sum(pts)::BIGINT AS a, sum(lines)::BIGINT AS b FROM facts GROUP BY ALL), o AS (SELECT grp, season, period, sum(a) OVER w AS a, sum(b) OVER w AS b FROM p WINDOW w AS (PARTITION BY grp, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT season, period, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM p GROUP BY ALL), l AS (SELECT season, period, sum(a) OVER w AS la, sum(b) OVER w AS lb FROM q WINDOW w AS (PARTITION BY season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT grp, season, period, (CASE WHEN b > 0 THEN a::DOUBLE / b END) - (CASE WHEN lb > 0 THEN la::DOUBLE / lb END) AS relative FROM o JOIN l USING (season, period)""")
def h34(t: Tables):
    return H.opponent_relative(t.facts, "grp", "season", "period", "pts", "lines").select("grp", "season", "period", "relative")


# ---------------------------------------------------------------- M: estimators


@query("m2_baseline_projection", """
WITH s AS (SELECT entity, grp, cat, season, sum(lines) AS own, count(*) AS n FROM facts GROUP BY ALL), g AS (SELECT grp, season, sum(lines) AS team FROM facts GROUP BY ALL),
r AS (SELECT s.*, own::DOUBLE / team AS share, CASE cat WHEN 'BUILDING' THEN 0.02::DOUBLE WHEN 'MACHINERY' THEN 0.01::DOUBLE END AS prior, team::DOUBLE / 12 AS volume FROM s JOIN g USING (grp, season))
SELECT entity, season, CASE WHEN prior IS NULL THEN 'no role prior' END AS reason, round(CASE WHEN prior IS NOT NULL THEN (share * n + prior * 5) / (n + 5) * volume * 1.5::DOUBLE * 1.0::DOUBLE END, 9) AS projection,
 round(CASE WHEN prior IS NOT NULL THEN greatest((share * n + prior * 5) / (n + 5) * volume * 1.5::DOUBLE * 1.0::DOUBLE * 0.55::DOUBLE, 1.5::DOUBLE) END, 9) AS spread FROM r""")
def m2(t: Tables):
    s = t.facts.groupBy("entity", "grp", "cat", "season").agg(F.sum("lines").alias("own"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("team", F.sum("own").over(Window.partitionBy("grp", "season")))
    r = s.withColumn("share", F.col("own") / F.col("team")).withColumn("prior", F.when(F.col("cat") == "BUILDING", 0.02).when(F.col("cat") == "MACHINERY", 0.01)).withColumn("volume", F.col("team") / 12).withColumn("eff", F.lit(1.5))
    p = M.baseline_projection(r, "share", "n", "prior", 5, "volume", "eff", F.lit(1.0), F.lit(0.55))
    return p.select("entity", "season", "reason", F.round("projection", 9).alias("projection"), F.round("spread", 9).alias("spread"))


@query("m4_m5_ridge_by_group")
def m4(t: Tables):
    rows = t.facts.withColumn("y", F.lead("pts").over(Window.partitionBy("entity").orderBy("t")))
    params = M.ridge_fit(rows.where("y IS NOT NULL"), ["cat"], ["qty", "lines", "returns"], "y")
    return M.ridge_predict(rows, params, ["cat"], ["qty", "lines", "returns"]).select("entity", "t", F.round("predicted", 6).alias("predicted"))


@query("m7_median_line")
def m7(t: Tables):
    p = settled(projections(t).dropna().select("entity", "t", "sys_mean", "actual"), "median")  # read once a round
    a, b = M.median_line(p, "sys_mean", "actual")
    return p.select("entity", "t", F.round(F.lit(a) + F.lit(b) * F.col("sys_mean"), 4).alias("calibrated"))


@query("m8_moments_prior", """
WITH s AS (SELECT entity, sum(returns) AS x, sum(lines) AS n FROM facts GROUP BY entity), m AS (SELECT sum(x)::DOUBLE / sum(n) AS mean, var_samp(x::DOUBLE / n) AS var, avg(n) AS size FROM s)
SELECT round(mean, 9) AS mean, round(CASE WHEN var - mean * (1 - mean) / size > 0 THEN mean * (1 - mean) / (var - mean * (1 - mean) / size) END, 4) AS n0 FROM m""")
def m8(t: Tables):
    s = t.facts.groupBy("entity").agg(F.sum("returns").alias("x"), F.sum("lines").alias("n"))
    return M.moments_n0(s, "x", "n").select(F.round("mean", 9).alias("mean"), F.round("n0", 4).alias("n0"))


@query("m9_first_k_vs_rest", """
WITH r AS (SELECT entity, pts, row_number() OVER (PARTITION BY entity ORDER BY t) AS k FROM facts), p AS (SELECT entity, kk AS k, sum(pts) FILTER (r.k <= kk)::DOUBLE / kk AS a, sum(pts) FILTER (r.k > kk)::DOUBLE / (count(*) - kk) AS b FROM r, (VALUES (1), (2), (4)) v(kk) GROUP BY entity, kk HAVING count(*) > kk)
SELECT k, count(*) AS n, round(corr(a, b), 7) AS r FROM p GROUP BY k""")
def m9(t: Tables):
    return M.first_k_vs_rest(t.facts, "entity", "t", "pts", [1, 2, 4]).withColumn("r", F.round("r", 7))


@query("m11_grid_search", PROJ + """, g AS (SELECT cat, v AS value, sum(abs(actual - v * sys_mean)) / count(*) AS loss, count(*) AS n FROM pj, (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE), (1.1::DOUBLE)) x(v) WHERE sys_mean IS NOT NULL GROUP BY cat, v)
SELECT cat, min_by(n, (loss, value)) AS n, min_by(value, (loss, value)) AS value, round(min(loss), 6) AS loss FROM g GROUP BY cat""")
def m11(t: Tables):
    p = projections(t).where("sys_mean IS NOT NULL")
    return M.grid_search(p, ["cat"], [0.8, 0.9, 1.0, 1.1], lambda g: F.abs(F.col("actual") - g * F.col("sys_mean"))).withColumn("loss", F.round("loss", 6))


@query("m12_strength", """
WITH g AS (SELECT grp, t, sum(pts)::BIGINT AS s, sum(cents)::BIGINT AS a FROM facts GROUP BY ALL), p AS (SELECT grp, count(*) AS n, sum(s) AS s, sum(a) AS a FROM g GROUP BY grp), m AS (SELECT sum(s)::DOUBLE / sum(n) AS m FROM p)
SELECT grp, n, round((s - n * m) / (n + 4.0::DOUBLE), 5) AS offense, round((a - n * m) / (n + 4.0::DOUBLE), 3) AS defense FROM p, m""")
def m12(t: Tables):
    g = t.facts.groupBy("grp", "t").agg(F.sum("pts").alias("s"), F.sum("cents").alias("a"))
    return M.strength(g, "grp", "s", "a").select("grp", "n", F.round("offense", 5).alias("offense"), F.round("defense", 3).alias("defense"))


@query("m16_hold_or_stream", """
WITH p AS (SELECT cat, t, max(pts) FILTER (entity % 10 = 0) AS m, max(pts) FILTER (entity % 10 <> 0) AS f, -max((pts, -entity)) FILTER (entity % 10 <> 0)[2] AS e FROM (SELECT * FROM facts) GROUP BY cat, t),
q AS (SELECT *, CASE WHEN e <> lag(e) OVER (PARTITION BY cat ORDER BY t) THEN 1 ELSE 0 END AS turn FROM (SELECT cat, t, m, f, (SELECT min(entity) FROM facts x WHERE x.cat = p.cat AND x.t = p.t AND x.pts = p.f AND x.entity % 10 <> 0) AS e FROM (SELECT cat, t, m, f FROM p) p))
SELECT cat, count(*) AS periods, sum(m)::BIGINT AS hold, sum(f)::BIGINT AS stream, sum(turn)::BIGINT AS changes FROM q GROUP BY cat""".replace(", -max((pts, -entity)) FILTER (entity % 10 <> 0)[2] AS e", ""))
def m16(t: Tables):
    return L.hold_or_stream(t.facts, "cat", "t", F.col("entity") % 10 == 0, "pts", "entity")


@query("m23_break_effect", """
WITH r AS (SELECT entity, t, pts, sum((coalesce(brk, false))::INT) OVER (PARTITION BY entity ORDER BY t) AS run FROM (SELECT *, t - lag(t) OVER (PARTITION BY entity ORDER BY t) > 3 AS brk FROM facts)), m AS (SELECT entity, run, sum(pts)::DOUBLE / count(*) AS m FROM r GROUP BY ALL),
d AS (SELECT m - lag(m) OVER (PARTITION BY entity ORDER BY run) AS d FROM m) SELECT count(d) AS breaks, round(avg(d), 6) AS effect, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t FROM d WHERE d IS NOT NULL""")
def m23(t: Tables):
    return M.before_after(t.facts, "entity", "t", "pts", 3).select("breaks", F.round("effect", 6).alias("effect"), F.round("t", 6).alias("t"))


# ---------------------------------------------------------------- K: market


def quotes(t: Tables):
    """Events as quotes: book, market and player from the user, sides and prices from the properties."""
    k = S.json_field(F.col("props"), "$.k", "int")
    return t.events.select((F.col("event_id") % 997).alias("event_id"), (F.col("user_id") % 5).alias("book"), F.col("event_type").alias("market"), (F.col("user_id") % 40).alias("player"), F.when(F.col("event_id") % 2 == 0, "Over").otherwise("Under").alias("side"), (F.floor(F.col("value") / 40) + 0.5).alias("point"), F.when(k % 2 == 0, 100 + k).otherwise(-100 - k).alias("price"), "ts")


QUOTES = """
WITH q AS (SELECT event_id % 997 AS event_id, user_id % 5 AS book, event_type AS market, user_id % 40 AS player, CASE WHEN event_id % 2 = 0 THEN 'Over' ELSE 'Under' END AS side, floor(value / 40) + 0.5::DOUBLE AS point, CASE WHEN k % 2 = 0 THEN 100 + k ELSE -100 - k END AS price, ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
i AS (SELECT *, CASE WHEN price >= 100 THEN 100.0::DOUBLE / (price + 100.0::DOUBLE) ELSE -price / (-price + 100.0::DOUBLE) END AS p FROM q),
g AS (SELECT event_id % 7 AS event_id, book, market, player, point, count(*) AS n, count(*) FILTER (side = 'Over') AS no, count(*) FILTER (side = 'Under') AS nu, max(p) FILTER (side = 'Over') AS qo, max(p) FILTER (side = 'Under') AS qu FROM i GROUP BY ALL),
two AS (SELECT *, qo / (qo + qu) AS p_over, qo + qu - 1.0::DOUBLE AS overround FROM g WHERE n = 2 AND no = 1 AND nu = 1),
main AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY event_id, book, market, player ORDER BY abs(p_over - 0.5), point) = 1)
"""


@query("k1_devig", QUOTES + "SELECT event_id, book, market, player, point, round(p_over, 9) AS p_over, round(overround, 9) AS overround FROM main")
def k1(t: Tables):
    main, _ = K.devig(quotes(t).withColumn("event_id", F.col("event_id") % 7))
    return main.select("event_id", "book", "market", "player", "point", F.round("p_over", 9).alias("p_over"), F.round("overround", 9).alias("overround"))


@query("k1_set_aside", QUOTES + "SELECT 'not one clean pair' AS reason, count(*) AS n FROM g WHERE NOT (n = 2 AND no = 1 AND nu = 1) UNION ALL SELECT 'alternate line', (SELECT count(*) FROM two) - (SELECT count(*) FROM main) WHERE (SELECT count(*) FROM two) > (SELECT count(*) FROM main)")
def k1b(t: Tables):
    return K.devig(quotes(t).withColumn("event_id", F.col("event_id") % 7))[1]


@query("k3_consensus", QUOTES + "SELECT event_id, market, player, median(point) AS line, round(median(p_over), 9) AS p_over, count(DISTINCT book) AS books FROM main GROUP BY ALL")
def k3(t: Tables):
    main, _ = K.devig(quotes(t).withColumn("event_id", F.col("event_id") % 7))
    return K.consensus(main).select("event_id", "market", "player", "line", F.round("p_over", 9).alias("p_over"), "books")


@query("k4_expected_poisson")
def k4(t: Tables):
    main, _ = K.devig(quotes(t).withColumn("event_id", F.col("event_id") % 7))
    return main.select("event_id", "book", "market", "player", F.round(K.expected_poisson(F.col("point"), F.col("p_over")), 6).alias("expected"))


@query("k5_unambiguous_ids", "WITH n AS (SELECT p_name, count(DISTINCT p_brand) AS names FROM part GROUP BY 1) SELECT p_partkey FROM part WHERE p_name IN (SELECT p_name FROM n WHERE names = 1)")
def k5(t: Tables):
    return K.unambiguous(t.part.select("p_partkey", "p_name", "p_brand"), "p_name", "p_brand")[0].select("p_partkey")


@query("k6_week_table", "WITH e AS (SELECT event_id, user_id, event_type, ts, count(*) OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts)) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00') SELECT event_id FROM e WHERE n = 1")
def k6(t: Tables):
    e = t.events.withColumn("kickoff", NOW()).withColumn("hour", F.date_trunc("hour", "ts"))
    return K.week_table(e, "ts", "kickoff", ["user_id", "event_type", "hour"]).select("event_id")


@query("k9_book_grades", QUOTES + """, o AS (SELECT event_id % 7 AS event_id, market, player, max(price)::DOUBLE / 40 AS actual FROM q WHERE player < 30 GROUP BY ALL), j AS (SELECT m.*, o.actual, least(greatest(p_over, 1e-6::DOUBLE), (1 - 1e-6)::DOUBLE) AS p, CASE WHEN o.actual <> m.point THEN (o.actual > m.point)::INT::DOUBLE END AS hit FROM main m LEFT JOIN o USING (event_id, market, player))
SELECT market, book, count(actual) AS settled, count(*) FILTER (actual IS NULL) AS void, round(avg(abs(actual - point)), 6) AS mae, round(avg(point - actual), 6) AS bias, round(avg((p - hit) * (p - hit)), 6) AS brier, round(avg(-(hit * ln(p) + (1 - hit) * ln(1 - p))), 6) AS log_loss FROM j GROUP BY market, book""")
def k9(t: Tables):
    q = quotes(t).withColumn("event_id", F.col("event_id") % 7)
    main, _ = K.devig(q)
    actual = q.where("player < 30").groupBy("event_id", "market", "player").agg((F.max("price").cast("double") / 40).alias("actual"))
    g = K.book_grades(main, actual, ["event_id", "market", "player"])
    return g.select("market", "book", "settled", "void", *[F.round(c, 6).alias(c) for c in ("mae", "bias", "brier", "log_loss")])


@query("k11_prefix_teams", "WITH t AS (SELECT DISTINCT p_brand AS prefix FROM part), c AS (SELECT p_partkey, p_brand || '-' || p_type AS code FROM part), m AS (SELECT c.code, count(DISTINCT prefix) AS n, min(prefix) AS team FROM (SELECT DISTINCT code FROM c) c JOIN t ON starts_with(c.code, t.prefix) GROUP BY c.code) SELECT c.p_partkey, CASE WHEN m.n = 1 THEN m.team END AS team FROM c LEFT JOIN m USING (code)")
def k11(t: Tables):
    codes = t.part.select("p_partkey", F.concat_ws("-", "p_brand", "p_type").alias("code"))
    return K.by_prefix(codes, "code", t.part.select(F.col("p_brand").alias("prefix")).distinct(), "prefix").select("p_partkey", "team")


# ---------------------------------------------------------------- P: probability


def sides(t: Tables):
    """Groups of a period paired in order, starters from the panel."""
    f = projections(t).select((F.col("t") * 100 + F.floor(F.col("grp") / 2)).cast("long").alias("matchup"), (F.col("grp") % 2).alias("side"), F.col("sys_mean").alias("mean"), F.lit(150.0).alias("sd"))
    return f


@query("p1_matchup_probability", PROJ + """, s AS (SELECT (t * 100 + floor(grp / 2))::BIGINT AS matchup, grp % 2 AS side, sum(sys_mean) AS m, sqrt(sum(150.0::DOUBLE * 150.0::DOUBLE)) AS s, count(*) FILTER (sys_mean IS NULL) AS missing FROM pj GROUP BY ALL),
w AS (SELECT a.matchup, a.m AS ma, a.s AS sa, b.m AS mb, b.s AS sb, a.missing + b.missing AS gap FROM s a JOIN s b ON a.matchup = b.matchup AND a.side = 0 AND b.side = 1)
SELECT matchup, round(CASE WHEN gap = 0 THEN """ + cdf_sql("(ma - mb) / sqrt(sa * sa + sb * sb)") + """ END, 7) AS p_a, CASE WHEN gap > 0 THEN gap || ' starters without a projection' END AS reason FROM w""")
def p1(t: Tables):
    return R.matchups(sides(t), "matchup", "side", "mean", "sd").select("matchup", F.round("p_a", 7).alias("p_a"), "reason")


@query("p2_season_wins", """
WITH r AS (SELECT entity, (qty % 100) / 100.0::DOUBLE AS p FROM facts), e AS (SELECT entity, count(*) AS n, sum(ln(1 - p)) AS l, sum(p / (1 - p)) AS a, sum((p / (1 - p)) ** 2) AS b FROM r GROUP BY entity)
SELECT entity, (n + 1)::INT AS cells, round(CASE WHEN n < 3 THEN 0 ELSE 1 - exp(l) * (1 + a + (a * a - b) / 2) END, 9)::DOUBLE AS three_or_more FROM e""")
def p2(t: Tables):
    p = t.facts.groupBy("entity").agg(F.array_sort(F.collect_list((F.col("qty") % 100) / 100.0)).alias("ps"))
    pmf = p.select("entity", R.poisson_binomial(F.col("ps")).alias("pmf"))
    return pmf.select("entity", F.size("pmf").alias("cells"), F.round(R.at_least(F.col("pmf"), 3), 9).alias("three_or_more"))


@query("p2_playoff_probability")
def p2_playoffs(t: Tables):
    """Each entity's last period as this week's game, its others as the rest; six wins are needed."""
    g = t.facts.withColumn("p", (F.col("qty") % 100) / 100.0).withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("t"))))
    e = g.groupBy("entity").agg(F.max(F.when(F.col("k") == 1, F.col("p"))).alias("p"), F.array_sort(F.collect_list(F.when(F.col("k") > 1, F.col("p")))).alias("ps"))
    pmf = e.select("entity", "p", R.poisson_binomial(F.col("ps")).alias("pmf"))
    return pmf.select("entity", F.round(R.playoff_probability(F.col("pmf"), F.col("p"), F.lit(6)), 9).alias("playoffs"), F.round(R.playoff_leverage(F.col("pmf"), F.lit(6)), 9).alias("leverage"))


@query("p4_points_at_checkpoints", "SELECT user_id, c AS checkpoint, coalesce(sum(event_id) FILTER (hour(ts) <= c), 0)::BIGINT AS so_far FROM events, (VALUES (6), (12), (18)) v(c) GROUP BY user_id, c")
def p4(t: Tables):
    e = t.events.select("user_id", F.hour("ts").alias("h"), "event_id")
    return R.points_at(e, "user_id", "h", "event_id", [6, 12, 18])


@query("p6_distribution_scores", PROJ + """, z AS (SELECT entity, t, actual, sys_mean, (actual - sys_mean) / 150.0::DOUBLE AS z FROM pj WHERE sys_mean IS NOT NULL)
SELECT entity, t, round(150.0::DOUBLE * (z * (2 * """ + cdf_sql("z") + """ - 1) + 2 * (exp(-z * z / 2.0::DOUBLE) * 0.3989422804014327::DOUBLE) - 0.5641895835477563::DOUBLE), 6) AS crps, round(CASE WHEN actual >= sys_mean THEN 0.75::DOUBLE * (actual - sys_mean) ELSE 0.25::DOUBLE * (sys_mean - actual) END, 6) AS pinball FROM z""")
def p6(t: Tables):
    p = projections(t).where("sys_mean IS NOT NULL")
    return p.select("entity", "t", F.round(R.normal_crps(F.col("actual"), F.col("sys_mean"), F.lit(150.0)), 6).alias("crps"), F.round(R.pinball(F.col("actual"), F.col("sys_mean"), 0.75), 6).alias("pinball"))


@query("p7_p8_lattice", f"""
WITH z AS (SELECT p_partkey, p_size, k, (k + 0.5 - p_size) / 6.0::DOUBLE AS z FROM part, range(61) r(k)), c AS (SELECT p_partkey, p_size, least(greatest(p_size + 3.0::DOUBLE - k, 0), 1) AS b, CASE WHEN k = 60 THEN 1 ELSE {cdf_sql("z")} END AS f FROM z)
SELECT p_partkey, round(sum(b * f * f + (1 - b) * (1 - f) * (1 - f)) + greatest(p_size + 3.0::DOUBLE - 61, 0), 6) AS crps, least(count(*) FILTER (WHERE f < 0.9 - 1e-12), 60)::INT AS q90 FROM c GROUP BY p_partkey, p_size""")
def p7(t: Tables):
    pmf = R.discretised_normal(F.col("p_size").cast("double"), F.lit(6.0), 0, 60)
    worked = t.part.select("p_size").distinct().select("p_size", pmf.alias("pmf"))
    scores = worked.select("p_size", F.round(R.lattice_crps(F.col("pmf"), F.lit(0), 1, F.col("p_size") + 3.0), 6).alias("crps"), R.lattice_quantile(F.col("pmf"), F.lit(0), 1, 0.9).alias("q90"))
    part = t.part.select("p_partkey", F.col("p_size").alias("__size"))
    return part.join(scores, F.col("__size").eqNullSafe(F.col("p_size"))).select("p_partkey", "crps", "q90")  # a size makes its distribution and score


@query("p9_convolved_sides")
def p9(t: Tables):
    """The starters of each group and season against those of its neighbour."""
    work = t.facts.groupBy("season", "entity").agg(F.sum("lines").alias("lines"))
    starters = lineups(t).where("slot IS NOT NULL").join(work, ["season", "entity"])
    third = (F.col("lines") % 3) / 4.0
    f = starters.select((F.col("season") * 100 + F.floor(F.col("grp") / 2)).cast("long").alias("matchup"), (F.col("grp") % 2).alias("side"), F.array(third, F.lit(0.5), 0.5 - third).alias("pmf"))
    return R.beats(R.convolved(f, "matchup", "side", "pmf"), "matchup", "side").withColumn("p_a", F.round("p_a", 9))


@query("p10_random_deals")
def p10(t: Tables):
    s = t.facts.groupBy("cat", "entity").agg(F.sum("pts").alias("pts"))
    ranked = s.withColumn("rank", F.row_number().over(Window.partitionBy("cat").orderBy(F.desc("pts"), "entity")))
    return R.dealt(ranked, 20, 7, "cat", "rank", 12).groupBy("rep", "dealt_to").agg(F.sum("pts").alias("pts"))


@query("p11_best_still_there", "WITH s AS (SELECT cat, entity, sum(pts)::BIGINT AS v, (entity % 90 + 5) / 100.0::DOUBLE AS q FROM facts GROUP BY ALL), g AS (SELECT *, coalesce(exp(sum(ln(greatest(1 - q, 1e-300::DOUBLE))) OVER (PARTITION BY cat ORDER BY v DESC, entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS gone FROM s) SELECT cat, round(sum(v * q * gone), 5) AS expected_best FROM g GROUP BY cat")
def p11(t: Tables):
    s = t.facts.groupBy("cat", "entity").agg(F.sum("pts").alias("v")).withColumn("q", (F.col("entity") % 90 + 5) / 100.0)
    return R.best_still_there(s, "cat", "v", "q").withColumn("expected_best", F.round("expected_best", 5))


# ---------------------------------------------------------------- E: evaluation


@query("e1_errors", PROJ + """, c AS (SELECT * FROM pj WHERE sys_mean IS NOT NULL AND sys_recent IS NOT NULL), l AS (SELECT cat, 'sys_mean' AS system, sys_mean - actual AS d FROM c UNION ALL SELECT cat, 'sys_recent', sys_recent - actual FROM c)
SELECT system, cat, count(*) AS n, round(sum(abs(d)) / count(*), 6) AS mae, round(sqrt(sum(d * d) / count(*)), 6) AS rmse, round(sum(d) / count(*), 6) AS bias FROM l GROUP BY GROUPING SETS ((system, cat), (system))""")
def e1(t: Tables):
    e = E.errors(projections(t), ["sys_mean", "sys_recent"], "actual", ["cat"])
    return e.select("system", "cat", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias")])


@query("e2_pairwise_exact", PROJ + """, c AS (SELECT * FROM pj WHERE sys_mean IS NOT NULL AND sys_eb IS NOT NULL AND season = 1996), p AS (SELECT sign(a.actual - b.actual) AS w, sign(a.sys_mean - b.sys_mean) = sign(a.actual - b.actual) AS m, sign(a.sys_eb - b.sys_eb) = sign(a.actual - b.actual) AS e FROM c a JOIN c b ON a.cat = b.cat AND a.t = b.t AND a.entity < b.entity WHERE a.actual <> b.actual)
SELECT count(*) AS pairs, count(*) FILTER (m)::DOUBLE / count(*) AS sys_mean, count(*) FILTER (e)::DOUBLE / count(*) AS sys_eb FROM p""")
def e2(t: Tables):
    p = projections(t).where("sys_mean IS NOT NULL AND sys_eb IS NOT NULL AND season = 1996")
    return E.pairwise_exact(p, ["sys_mean", "sys_eb"], "actual", ["cat", "t"], "entity")


@query("e2_pairwise_all_seasons")  # pairs in SQL are too slow over the whole table
def e2_all(t: Tables):
    p = E.pairs_over(projections(t), ["sys_mean", "sys_eb"], "actual", ["cat", "t"])
    share = lambda s: (F.sum(F.when(F.col("system") == s, F.col("right"))) / F.sum(F.when(F.col("system") == s, F.col("pairs")))).alias(s)
    return p.agg(F.sum(F.when(F.col("system") == "sys_mean", F.col("pairs"))).alias("pairs"), share("sys_mean"), share("sys_eb"))


@query("e2_pairwise_at_scale", PROJ + """, c AS (SELECT * FROM pj WHERE sys_mean IS NOT NULL), k AS (SELECT cat, season, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT a.cat, a.season, count(*) FILTER (a.actual <> b.actual) AS pairs, count(*) FILTER (a.actual <> b.actual AND sign(a.sys_mean - b.sys_mean) = sign(a.actual - b.actual)) AS good FROM c a JOIN c b ON a.cat = b.cat AND a.season = b.season AND (a.entity, a.t) < (b.entity, b.t) GROUP BY ALL)
SELECT k.cat, k.season, coalesce(pairs, 0)::BIGINT AS pairs, coalesce(good, 0)::BIGINT AS "right" FROM k LEFT JOIN p USING (cat, season)""")
def e2b(t: Tables):
    return E.pairwise(projections(t), "sys_mean", "actual", ["cat", "season"]).select("cat", "season", "pairs", "right")


@query("e4_spearman", PROJ + """, c AS (SELECT cat, season, sys_mean AS x, actual AS y FROM pj WHERE sys_mean IS NOT NULL), r AS (SELECT cat, season, rank() OVER (PARTITION BY cat, season ORDER BY x) * 2 + count(*) OVER (PARTITION BY cat, season, x) - 1 AS a, rank() OVER (PARTITION BY cat, season ORDER BY y) * 2 + count(*) OVER (PARTITION BY cat, season, y) - 1 AS b FROM c)
SELECT cat, season, count(*) AS n, round(corr(a, b), 7) AS rho FROM r GROUP BY cat, season HAVING count(*) > 2""")
def e4(t: Tables):
    return E.spearman(projections(t), "sys_mean", "actual", ["cat", "season"]).where("n > 2").withColumn("rho", F.round("rho", 7))


@query("e6_season_folds")
def e6(t: Tables):
    rows = t.facts.withColumn("y", F.lead("pts").over(Window.partitionBy("entity").orderBy("t"))).where("y IS NOT NULL")
    p = M.season_folds(rows, ["cat"], "season", ["qty", "lines", "returns"], "y")
    return p.select("entity", "t", F.round("predicted", 6).alias("predicted"))


@query("e7_leak_check", "SELECT entity, t FROM facts WHERE false")
def e7(t: Tables):
    build = lambda f: H.core(f, "entity", "season", "period", ["pts"]).select("entity", "t", "games", "pts_mean", "pts_recent")
    return H.leak_rows(build, t.facts.select("entity", "season", "period", "t", "pts"), "t", 23955, ["entity", "t"])


WON = "won AS (SELECT entity, t, (entity % 97 + 1) / 100.0::DOUBLE AS p, (pts > 400)::INT AS won FROM facts)"


def won(t: Tables):
    return t.facts.select("entity", "t", "cat", ((F.col("entity") % 97 + 1) / 100.0).alias("p"), (F.col("pts") > 400).cast("int").alias("won"))


@query("e9_probability_scores", f"WITH {WON}, q AS (SELECT least(greatest(p, 1e-6::DOUBLE), (1 - 1e-6)::DOUBLE) AS q, won::DOUBLE AS y FROM won JOIN (SELECT entity, t FROM facts) USING (entity, t)) SELECT count(*) AS n, round(sum((q - y) * (q - y)) / count(*), 7) AS brier, round(sum(-(y * ln(q) + (1 - y) * ln(1 - q))) / count(*), 7) AS log_loss, round(sum(greatest(q, 1 - q)) / count(*), 7) AS favourite_stated, round(sum(CASE WHEN q >= 0.5 THEN y ELSE 1 - y END) / count(*), 7) AS favourite_won FROM q")
def e9(t: Tables):
    return E.probability_scores(won(t), "p", "won").select("n", *[F.round(c, 7).alias(c) for c in ("brier", "log_loss", "favourite_stated", "favourite_won")])


@query("e9_reliability", f"WITH {WON}, f AS (SELECT * FROM facts LIMIT 0) SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(sum(p) / count(*), 7) AS stated, round(sum(won)::DOUBLE / count(*), 7) AS observed FROM won GROUP BY 1")
def e9b(t: Tables):
    return E.reliability(won(t), "p", "won").select("bin", "n", F.round("stated", 7).alias("stated"), F.round("observed", 7).alias("observed"))


@query("e11_bootstrap")
def e11(t: Tables):
    return E.bootstrap(projections(t).where("sys_mean IS NOT NULL"), ["season", "period"], F.abs(F.col("sys_mean") - F.col("actual")))


@query("e13_decisions", """
WITH c AS (SELECT a.t, a.entity AS preferred, b.entity AS other FROM facts a JOIN facts b ON a.entity + 1 = b.entity AND a.t = b.t WHERE a.cat = b.cat), n AS (SELECT t + 1 AS t, preferred, other FROM c)
SELECT n.t, n.preferred, n.other, (a.pts - b.pts)::BIGINT AS realised_edge, CASE WHEN a.pts IS NULL OR b.pts IS NULL THEN 'ungraded: no outcome' WHEN a.pts > b.pts THEN 'right' WHEN a.pts < b.pts THEN 'wrong' ELSE 'even' END AS verdict FROM n LEFT JOIN facts a ON a.t = n.t AND a.entity = n.preferred LEFT JOIN facts b ON b.t = n.t AND b.entity = n.other""")
def e13(t: Tables):
    f = t.facts
    b = f.select("t", (F.col("entity") - 1).alias("entity"), F.col("entity").alias("other"), F.col("cat").alias("c2"))
    pairs = f.select("t", "entity", "cat").join(b, ["t", "entity"]).where("cat = c2").select((F.col("t") + 1).alias("t"), F.col("entity").alias("preferred"), "other")
    return E.decisions(pairs, f, ["t"], "entity", "pts")


@query("e17_ranked_above", """
WITH s AS (SELECT cat, entity, sum(pts)::BIGINT AS pts FROM facts GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY cat ORDER BY pts DESC) AS rnk FROM s)
SELECT a.cat, a.entity, a.rnk, (SELECT count(*) FROM r b WHERE b.cat = a.cat AND b.entity % 10 <> 0 AND b.rnk < a.rnk) AS above FROM r a WHERE a.entity % 10 = 0""")
def e17(t: Tables):
    s = t.facts.groupBy("cat", "entity").agg(F.sum("pts").alias("pts"))
    r = P.ranks(s, ["cat"], -F.col("pts"), "rnk")
    return E.ranked_above(r.where("entity % 10 = 0"), r.where("entity % 10 <> 0"), "cat", "rnk", "entity")


@query("e20_reconcile", "WITH d AS (SELECT pts - (4 * qty + 50 * lines) AS d FROM facts) SELECT count(*) AS n, count(*) FILTER (d = 0)::DOUBLE / count(*) AS exact, count(*) FILTER (abs(d) <= 200)::DOUBLE / count(*) AS near, sum(abs(d))::DOUBLE / count(*) AS mae, sum(d)::DOUBLE / count(*) AS bias FROM d")
def e20(t: Tables):
    f = t.facts
    return E.reconcile(f.select("entity", "t", "pts"), f.select("entity", "t", (4 * F.col("qty") + 50 * F.col("lines")).alias("other")), ["entity", "t"], "pts", "other", 200)


@query("e28_band_table", PROJ + "SELECT CASE WHEN sys_mean < 300 THEN 'low' WHEN sys_mean < 500 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, round(sum(sys_mean - actual) / count(*), 5) AS sys_mean_bias, round(sum(sys_eb - actual) / count(*), 5) AS sys_eb_bias FROM pj WHERE sys_mean IS NOT NULL AND sys_eb IS NOT NULL GROUP BY 1")
def e28(t: Tables):
    b = F.when(F.col("sys_mean") < 300, "low").when(F.col("sys_mean") < 500, "middle").otherwise("high")
    e = E.band_table(projections(t), b, ["sys_mean", "sys_eb"], "actual")
    return e.select("band", "n", F.round("sys_mean_bias", 5).alias("sys_mean_bias"), F.round("sys_eb_bias", 5).alias("sys_eb_bias"))


# ---------------------------------------------------------------- L: allocation

SLOTS, FLEX = {"BUILDING": 1, "MACHINERY": 2, "HOUSEHOLD": 2}, ["MACHINERY", "HOUSEHOLD", "FURNITURE"]
LINEUP = """
WITH s AS (SELECT grp, cat, entity, sum(pts)::BIGINT AS pts, count(*)::DOUBLE AS sd FROM facts WHERE season = 1996 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY grp, cat ORDER BY pts DESC, entity) AS k, CASE cat WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 2 ELSE 0 END AS need FROM s),
x AS (SELECT *, k <= need AS own, k > need AND cat IN ('MACHINERY', 'HOUSEHOLD', 'FURNITURE') AS can FROM r), y AS (SELECT *, row_number() OVER (PARTITION BY grp, can ORDER BY pts DESC, entity) AS j FROM x),
lu AS (SELECT grp, cat, entity, pts, sd, CASE WHEN own THEN cat WHEN can AND j <= 2 THEN 'FLEX' END AS slot FROM y)
"""


def lineup(t: Tables):
    s = t.facts.where("season = 1996").groupBy("grp", "cat", "entity").agg(F.sum("pts").alias("pts"), F.count(F.lit(1)).cast("double").alias("sd"))
    return L.best_lineup(s, ["grp"], "cat", "pts", "entity", SLOTS, FLEX, 2)


def lineups(t: Tables):
    """The lineup of each group in each season."""
    s = t.facts.groupBy("grp", "season", "cat", "entity").agg(F.sum("pts").alias("pts"), F.count(F.lit(1)).cast("double").alias("sd"))
    return L.best_lineup(s, ["grp", "season"], "cat", "pts", "entity", SLOTS, FLEX, 2)


@query("l1_lineup_by_season")
def l1_seasons(t: Tables):
    return lineups(t)


@query("l3_swaps_by_season")
def l3_seasons(t: Tables):
    return L.swaps(lineups(t), ["grp", "season"], "cat", "pts", "sd", "entity", FLEX).withColumn("z", F.round("z", 7))


@query("l1_best_lineup", LINEUP + "SELECT grp, cat, entity, pts, sd, slot FROM lu")
def l1(t: Tables):
    return lineup(t)


@query("l3_swaps", LINEUP + """, b AS (SELECT grp, entity AS i, pts, sd, cat AS slot FROM lu WHERE slot IS NULL UNION ALL SELECT grp, entity, pts, sd, 'FLEX' FROM lu WHERE slot IS NULL AND cat IN ('MACHINERY', 'HOUSEHOLD', 'FURNITURE')),
p AS (SELECT b.grp, b.i, o.entity AS o, b.slot, b.pts - o.pts AS gain, (b.pts - o.pts) / sqrt(b.sd * b.sd + o.sd * o.sd) AS z FROM b JOIN lu o ON o.grp = b.grp AND o.slot = b.slot) SELECT grp, i AS "into", o AS "out", slot, gain::BIGINT AS gain, round(z, 7) AS z FROM p QUALIFY row_number() OVER (PARTITION BY grp, i ORDER BY gain DESC, o) = 1""")
def l3(t: Tables):
    return L.swaps(lineup(t), ["grp"], "cat", "pts", "sd", "entity", FLEX).withColumn("z", F.round("z", 7))


@query("l6_capacity", "SELECT grp, count(DISTINCT entity) AS held, 60 AS places, CASE WHEN count(DISTINCT entity) <= 60 THEN 60 - count(DISTINCT entity) END AS open FROM facts GROUP BY grp")
def l6(t: Tables):
    return L.capacity(t.facts.select("grp", "entity").distinct(), ["grp"], F.lit(60))


@query("l10_vacancies", "WITH r AS (SELECT entity, grp, cat, sum(lines)::DOUBLE / 2 AS work FROM facts WHERE t > 23958 AND t <= 23960 GROUP BY ALL) SELECT entity, grp, cat, work FROM r WHERE entity % 3 = 0 AND work >= CASE cat WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 3 ELSE 1000000 END")
def l10(t: Tables):
    return L.vacancies(t.facts, "entity", "grp", "t", "lines", 23960, {"BUILDING": 2, "MACHINERY": 3}, "cat", F.col("entity") % 3 == 0)


@query("l12_volume_alert", "WITH r AS (SELECT entity, cat, t, lines, row_number() OVER (PARTITION BY entity ORDER BY t DESC) AS k FROM facts) SELECT entity, cat, max(t) AS last FROM r WHERE k <= 3 GROUP BY entity, cat HAVING count(*) = 3 AND bool_and(lines >= CASE cat WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 4 END) AND max(t) - min(t) < 12")
def l12(t: Tables):
    return L.volume_alert(t.facts, "entity", "cat", "t", {"lines": {"BUILDING": 2, "MACHINERY": 4}}, 3, 12)


@query("l13_usage_trend", """
WITH r AS (SELECT entity, lines, row_number() OVER (PARTITION BY entity ORDER BY t DESC) AS k FROM facts), p AS (SELECT entity, count(*) AS n, sum(lines) FILTER (k <= 2)::DOUBLE / 2 AS recent, sum(lines) FILTER (k > 2)::DOUBLE / count(*) FILTER (k > 2) AS earlier FROM r WHERE k <= 4 GROUP BY entity HAVING count(*) >= 3)
SELECT entity, n, recent, earlier, recent / earlier AS ratio, CASE WHEN recent / earlier >= 1.25 THEN 'RISING' WHEN recent / earlier <= 0.75 THEN 'FALLING' ELSE 'STEADY' END AS trend FROM p""")
def l13(t: Tables):
    return L.usage_trend(t.facts, "entity", "t", "lines")


@query("l16_waiver_phase", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'UNSURE' WHEN o_orderdate + INTERVAL 60 DAY <= TIMESTAMP '1997-06-01' THEN 'LOCKED' WHEN o_orderstatus = 'F' AND TIMESTAMP '1997-06-01' < o_orderdate + INTERVAL 480 HOUR THEN 'WAIVERS' ELSE 'FREE' END AS phase FROM orders")
def l16(t: Tables):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("dropped"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("kickoff"))
    return L.waiver_phase(rows, "dropped", "kickoff", F.to_timestamp(F.lit("1997-06-01")), 480).select("o_orderkey", "phase")


@query("l18_needs_met", "WITH p AS (SELECT grp, t, count(*) FILTER (cat = 'BUILDING') AS b, count(*) FILTER (cat = 'MACHINERY') AS m FROM facts GROUP BY ALL) SELECT grp, t, b AS BUILDING, m AS MACHINERY, (greatest(1 - b, 0) + greatest(2 - m, 0))::BIGINT AS short, greatest(1 - greatest(m - 2, 0), 0)::BIGINT AS flex_short, b >= 1 AND m >= 3 AS legal FROM p")
def l18(t: Tables):
    return L.needs_met(t.facts, ["grp", "t"], "cat", {"BUILDING": 1, "MACHINERY": 2}, ["MACHINERY"], 1)


@query("l24_main_cutoff", "WITH d AS (SELECT date_trunc('month', ts) AS month, date_trunc('day', ts) AS day, count(*) AS n, min(ts) AS first FROM events GROUP BY ALL) SELECT month, min_by(first, (-n, day)) AS cutoff FROM d GROUP BY month")
def l24(t: Tables):
    return L.main_cutoff(t.events.select("ts", F.date_trunc("month", "ts").alias("month")), ["month"], "ts")


# ---------------------------------------------------------------- C, Q: changes and quality


def snapshot(t: Tables, season: int):
    return t.facts.where(f"season = {season}").groupBy("entity").agg(F.sum("pts").alias("pts"), F.max("grp").alias("grp_label"))


@query("c1_snapshot_diff", """
WITH a AS (SELECT entity, sum(pts)::BIGINT AS v0, count(*) % 2 AS l0 FROM facts WHERE season = 1995 GROUP BY 1), b AS (SELECT entity, sum(pts)::BIGINT AS v1, count(*) % 2 AS l1 FROM facts WHERE season = 1996 GROUP BY 1), j AS (SELECT coalesce(a.entity, b.entity) AS entity, v0, v1, l0, l1, a.entity IS NOT NULL AS i0, b.entity IS NOT NULL AS i1 FROM a FULL JOIN b ON a.entity = b.entity)
SELECT entity, v0, v1, 'added' AS change FROM j WHERE NOT i0 UNION ALL SELECT entity, v0, v1, 'gone' FROM j WHERE NOT i1 UNION ALL SELECT entity, v0, v1, 'moved' FROM j WHERE i0 AND i1 AND abs(v1 - v0) >= 300 UNION ALL SELECT entity, v0, v1, 'relabelled' FROM j WHERE i0 AND i1 AND l0 <> l1""")
def c1(t: Tables):
    snap = lambda y: t.facts.where(f"season = {y}").groupBy("entity").agg(F.sum("pts").alias("v"), (F.count(F.lit(1)) % 2).alias("l"))
    return C.snapshot_diff(snap(1995), snap(1996), ["entity"], "v", "l", 300).select("entity", "v0", "v1", "change")


@query("c7_change_feed", """
WITH s AS (SELECT grp, entity, season, sum(pts)::BIGINT AS v FROM facts GROUP BY ALL), n AS (SELECT season, row_number() OVER (ORDER BY season) AS n FROM (SELECT DISTINCT season FROM s)), r AS (SELECT s.*, n.n FROM s JOIN n USING (season))
SELECT a.entity, a.season, 'added' AS change, NULL::DOUBLE AS old, a.v::DOUBLE AS new FROM r a LEFT JOIN r b ON a.entity = b.entity AND b.n = a.n - 1 WHERE b.entity IS NULL AND a.n > 1
UNION ALL SELECT a.entity, a.season, 'moved', b.v, a.v FROM r a JOIN r b ON a.entity = b.entity AND b.n = a.n - 1 WHERE abs(a.v - b.v) >= 500
UNION ALL SELECT a.entity, m.season, 'gone', a.v, NULL FROM r a JOIN n m ON m.n = a.n + 1 LEFT JOIN r b ON a.entity = b.entity AND b.n = a.n + 1 WHERE b.entity IS NULL""")
def c7(t: Tables):
    s = t.facts.groupBy("entity", "season").agg(F.sum("pts").alias("v"))
    return C.change_feed(s, ["entity"], "season", "v", 500)


@query("q1_validation", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice <= 1000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders WHERE o_totalprice <= 1000 OR o_orderstatus = 'P'")
def q1(t: Tables):
    _, bad = Q.validate(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus") != "P"})
    return bad.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


@query("q2_freshness", """
WITH s AS (SELECT event_type AS source, max(ts) AS as_of, count(DISTINCT user_id) AS last_period, 3 AS needed_period FROM events GROUP BY 1), l AS (SELECT *, CASE source WHEN 'click' THEN 1.0 WHEN 'error' THEN 2.0 WHEN 'view' THEN 100000.0 END::DOUBLE AS lim, (epoch_us(TIMESTAMP '2024-02-15 12:00:00') - epoch_us(as_of)) / 3.6e9::DOUBLE AS age FROM s)
SELECT source, CASE WHEN lim IS NULL THEN 'STALE' WHEN age > lim THEN 'STALE' WHEN last_period < needed_period THEN 'STALE' ELSE 'FRESH' END AS state, CASE WHEN lim IS NULL THEN 'no limit set' WHEN age > lim THEN 'too old' WHEN last_period < needed_period THEN 'period not covered' END AS reason FROM l""")
def q2(t: Tables):
    s = t.events.groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("as_of"), F.countDistinct("user_id").alias("last_period"), F.lit(3).alias("needed_period"))
    return Q.freshness(s, F.to_timestamp(F.lit("2024-02-15 12:00:00")), {"click": 1.0, "error": 2.0, "view": 100000.0}).select("source", "state", "reason")


@query("q4_week_phase", "SELECT user_id, CASE WHEN bool_and(event_type <> 'error') THEN 'COMPLETE' WHEN min(ts) > TIMESTAMP '2024-01-15 12:00:00' THEN 'PREGAME' ELSE 'IN_PROGRESS' END AS phase, count(*) FILTER (event_type = 'error' AND ts < TIMESTAMP '2024-01-15 06:00:00') AS overdue FROM events GROUP BY user_id")
def q4(t: Tables):
    return Q.week_phase(t.events, ["user_id"], "ts", F.col("event_type") != "error", NOW()).select("user_id", "phase", "overdue")


@query("q9_forbidden_tokens", "SELECT 'p_name' AS column_name, count(*) FILTER (p_name LIKE '%ring%' OR p_name LIKE '%widget%') AS rows_found FROM part UNION ALL SELECT 'p_type', count(*) FILTER (p_type LIKE '%ring%' OR p_type LIKE '%widget%') FROM part")
def q9(t: Tables):
    return Q.forbidden(t.part, ["p_name", "p_type"], ["ring", "widget"])


@query("q10_same_rows", "SELECT c_custkey, 'a' AS only_in, 1::BIGINT AS n FROM customer WHERE c_custkey % 50 = 0")
def q10(t: Tables):
    return Q.same_rows(t.customer.select("c_custkey"), t.customer.where("c_custkey % 50 <> 0").select("c_custkey"))


@query("q11_interval_faults", "WITH s AS (SELECT o_custkey, o_orderkey, dayofyear(o_orderdate)::INT AS lo, (dayofyear(o_orderdate) + (o_orderkey % 40) - 2)::INT AS hi FROM orders), w AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo AS o FROM s WHERE (o_custkey, lo, hi) IN (SELECT (o_custkey, lo, hi) FROM s GROUP BY o_custkey, lo, hi HAVING count(*) = 1)) SELECT o_orderkey, array_to_string(list_filter([CASE WHEN hi < lo THEN 'reversed' END, CASE WHEN o THEN 'overlaps' END], lambda x: x IS NOT NULL), ',') AS reasons FROM w WHERE hi < lo OR o")
def q11(t: Tables):
    s = t.orders.select("o_custkey", "o_orderkey", F.dayofyear("o_orderdate").alias("lo"), (F.dayofyear("o_orderdate") + F.col("o_orderkey") % 40 - 2).cast("int").alias("hi"))
    one = s.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "lo", "hi"))).where("n = 1")
    return Q.interval_faults(one, ["o_custkey"], "lo", "hi", F.lit(True)).select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))
