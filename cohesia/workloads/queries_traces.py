"""Trace verdicts over hourly event frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fields import r4
from ..operators import traces as tr
from ..plans.lineage import cut
from . import sqlkit as k
from . import views
from .registry import query

R = "run_id"
T, P = k.TRACES, k.PHASES
TH, LAST = 150.0, 10
ACT = f"""
act AS MATERIALIZED (SELECT run_id, frame, count(*) FILTER (v > {TH}) AS active, count(*) FILTER (v > {TH}) / count(*)::DOUBLE AS share FROM traces WHERE frame > {LAST} GROUP BY ALL),
isl AS (SELECT *, frame - 0 AS f, row_number() OVER (PARTITION BY run_id ORDER BY frame) - row_number() OVER (PARTITION BY run_id, active > 0 ORDER BY frame) AS g FROM act),
lon AS (SELECT run_id, max(c) AS longest FROM (SELECT run_id, g, count(*) AS c FROM isl WHERE active > 0 GROUP BY ALL) GROUP BY run_id)"""


@query("r1_activity", k.q(T, body=f"SELECT run_id, frame, count(*) FILTER (v > {TH}) AS active, {k.r4(f'count(*) FILTER (v > {TH}) / count(*)', 6)} AS share FROM traces GROUP BY ALL"))
def r1(spark, d):
    return tr.activity(views.traces(spark, d), TH).withColumn("share", r4("share", 6))


@query("r2_sustained", k.q(T, ACT, body=f"SELECT a.run_id, count(*) AS \"window\", {k.r4('coalesce(any_value(longest), 0) * 1.0')} AS sustained FROM act a LEFT JOIN lon USING (run_id) GROUP BY a.run_id"))
def r2(spark, d):
    return tr.sustained(cut(views.traces(spark, d)), TH, LAST, 1.0).withColumn("sustained", r4("sustained"))


UP = f"up AS (SELECT run_id, node_id, frame, coalesce(lag(v) OVER (PARTITION BY run_id, node_id ORDER BY frame) <= {TH} AND v > {TH}, false) AS up FROM traces {{w}})"


@query("r3_upcrossings", k.q(T, UP.format(w=""), body="SELECT run_id, node_id, count(*) FILTER (up) AS crossings, coalesce(min(frame) FILTER (up), -1) AS first, coalesce(max(frame) FILTER (up), -1) AS last FROM up GROUP BY ALL"))
def r3(spark, d):
    return tr.upcrossings(views.traces(spark, d), TH).na.fill(-1, ["first", "last"])


@query("r4_reentry_verdict", k.q(T, ACT, UP.format(w=f"WHERE frame > {LAST}"), """
cr AS (SELECT run_id, avg(CASE WHEN c >= 2 THEN 1.0 ELSE 0.0 END) AS re FROM (SELECT run_id, node_id, count(*) FILTER (up) AS c FROM up GROUP BY ALL) GROUP BY run_id),
ms AS (SELECT run_id, min(share) AS ms FROM act GROUP BY run_id)""", body=f"""
SELECT run_id, {k.r4('longest')} AS sustained, {k.r4('ms', 6)} AS min_share, {k.r4('re', 6)} AS reactivating, longest >= 3 AND ms < 0.8 AND re >= 0.1 AS verdict FROM ms JOIN cr USING (run_id) JOIN lon USING (run_id)"""))
def r4q(spark, d):
    t = tr.reentry_verdict(cut(views.traces(spark, d)), TH, LAST, 1.0, 3.0, 0.8, 0.1)
    return t.select(R, r4("sustained").alias("sustained"), r4("min_share", 6).alias("min_share"), r4("reactivating", 6).alias("reactivating"), "verdict")


@query("r5_sustained_until_quiet", k.q(T, f"""
ac AS MATERIALIZED (SELECT run_id, frame, count(*) FILTER (v > {TH}) > 0 AS on_ FROM traces WHERE frame >= 20 GROUP BY ALL),
isq AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame) - row_number() OVER (PARTITION BY run_id, on_ ORDER BY frame) AS g FROM ac),
qt AS (SELECT run_id, min(s) AS stop FROM (SELECT run_id, g, min(frame) AS s, count(*) AS c FROM isq WHERE NOT on_ GROUP BY ALL) WHERE c >= 3 GROUP BY run_id),
ls AS (SELECT a.run_id, max(frame) FILTER (on_) AS l FROM ac a LEFT JOIN qt USING (run_id) WHERE stop IS NULL OR frame < stop GROUP BY a.run_id)""", body=f"""
SELECT r.run_id, {k.r4('coalesce(l - 20 + 1, 0) * 1.0')} AS sustained FROM (SELECT DISTINCT run_id FROM ac) r LEFT JOIN ls USING (run_id)"""))
def r5(spark, d):
    return tr.sustained_until_quiet(cut(views.traces(spark, d)), TH, 20, 3, 1.0).withColumn("sustained", r4("sustained"))


@query("r6_origins", k.q(T, f"a AS (SELECT run_id, node_id, count(*) AS c, min(frame) AS f, max(frame) AS l FROM traces WHERE frame > {LAST} AND v > {TH} GROUP BY ALL)", body="""
SELECT run_id, arg_max(node_id, (c, -node_id)) AS longest_active, arg_min(node_id, (f, node_id)) AS first_activation, arg_min(node_id, (l, node_id)) AS earliest_last FROM a GROUP BY run_id"""))
def r6(spark, d):
    return tr.origins(views.traces(spark, d), TH, LAST)


ORD = "op AS (SELECT run_id, avg(r) AS r FROM (SELECT run_id, frame, sqrt(avg(cos(theta))**2 + avg(sin(theta))**2) AS r FROM phases WHERE frame >= 24 GROUP BY ALL) GROUP BY run_id)"


@query("r7_order_parameter", k.q(P, ORD, body=f"SELECT run_id, {k.r4('r', 6)} AS order_parameter FROM op"))
def r7(spark, d):
    return tr.order_parameter(views.phases(spark, d), 24).withColumn("order_parameter", r4("order_parameter", 6))


@query("r8_detuning", k.q(P, ORD, """
df AS (SELECT run_id, node_id, theta - lag(theta) OVER (PARTITION BY run_id, node_id ORDER BY frame) AS d FROM phases),
fr AS (SELECT run_id, node_id, sum(d - 2 * pi() * ceil((d - pi()) / (2 * pi()))) / count(d) AS f FROM df WHERE d IS NOT NULL GROUP BY ALL),
dv AS (SELECT run_id, node_id, abs(f - median(f) OVER (PARTITION BY run_id)) AS dev FROM fr),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dev DESC, node_id) AS k FROM dv)""", body=f"""
SELECT run_id, {k.r4('max(dev)', 6)} AS max_dev, {k.r4('avg(CASE WHEN dev > 0.5 THEN 1.0 ELSE 0.0 END)', 6)} AS slip_share, max(node_id) FILTER (k = 1) AS top1, max(node_id) FILTER (k = 2) AS top2, any_value(r) < 0.9 AND max(dev) > 0.5 AS desync FROM rk JOIN op USING (run_id) GROUP BY run_id"""))
def r8(spark, d):
    t = tr.detuning(cut(views.phases(spark, d)), 1.0, 0.5, 0.9, 24)
    return t.select(R, r4("max_dev", 6).alias("max_dev"), r4("slip_share", 6).alias("slip_share"), "top1", "top2", "desync")


@query("r9_battery", k.q(T, "a AS (SELECT run_id, node_id, frame AS attempt, v > 200 AS ind, v AS sus, frame % 7 AS origin FROM traces)", body=f"""
SELECT run_id, node_id, bool_or(ind) AS inducible, {k.r4('max(sus)')} AS sustained, coalesce(arg_min(origin, attempt) FILTER (ind), -1) AS origin FROM a GROUP BY ALL"""))
def r9(spark, d):
    """Each hourly frame of a user is one attempt."""
    a = views.traces(spark, d).select(R, "node_id", F.col("frame").alias("attempt"), (F.col("v") > 200).alias("inducible"), F.col("v").alias("sustained"), (F.col("frame") % 7).alias("origin"))
    return tr.battery(a, [R, "node_id"]).na.fill(-1, ["origin"]).withColumn("sustained", r4("sustained"))
