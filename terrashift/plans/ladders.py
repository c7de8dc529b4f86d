"""Threshold ladders and keyword classifiers over analogues of the domain's measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from .registry import Tables, query

@query("SELECT l_orderkey, l_linenumber, CASE WHEN d >= 0.66 THEN 'high_severity' WHEN d >= 0.44 THEN 'moderate_high_severity' WHEN d >= 0.27 THEN 'moderate_low_severity' WHEN d >= 0.1 THEN 'low_severity' ELSE 'unburned' END AS severity FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 48 THEN l_discount * 8 END AS d FROM lineitem)")
def cas01_severity(t: Tables) -> DataFrame:
    dnbr = F.when(F.col("l_quantity") < 48, F.col("l_discount") * 8)
    return t.lineitem.select("l_orderkey", "l_linenumber", C.burn_severity(dnbr).alias("severity"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN d > -2 THEN 'minimal_change' WHEN d BETWEEN -4 AND -2 THEN 'moderate_loss' WHEN d < -4 THEN 'severe_loss' ELSE 'unknown' END AS change FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 48 THEN 0 - l_tax * 100 END AS d FROM lineitem)")
def cas02_sar_change(t: Tables) -> DataFrame:
    db = F.when(F.col("l_quantity") < 48, 0 - F.col("l_tax") * 100)
    return t.lineitem.select("l_orderkey", "l_linenumber", C.sar_change(db).alias("change"))


@query("SELECT l_orderkey, CASE WHEN n >= 6 THEN 'high' WHEN n >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def cas03_pixel_confidence(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(C.pixel_confidence(F.count("*")).alias("confidence"))


_DESCRIBED = (
    "CASE l_partkey % 11 WHEN 0 THEN 'Demo of garage' WHEN 1 THEN 'TEAR DOWN, debris removal' WHEN 2 THEN 'Footing and slab' WHEN 3 THEN 'Rough framing' WHEN 4 THEN 'Structural steel' WHEN 5 THEN 'C of O issued'"
    " WHEN 6 THEN 'Final inspection of foundation' WHEN 7 THEN 'New SFR' WHEN 8 THEN 'Rebuild, new residence' WHEN 9 THEN 'Fence' END"
)


@query(
    "SELECT l_orderkey, l_linenumber, stage, CASE WHEN stage = 'rebuild_complete' OR stage = 'structure_substantial' THEN 'high' WHEN stage = 'foundation_framing' OR stage = 'cleared_lot' THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT l_orderkey, l_linenumber, CASE WHEN d IS NULL THEN 'unknown'"
    " WHEN d LIKE '%demolition%' OR d LIKE '%demo%' OR d LIKE '%tear down%' THEN 'cleared_lot' WHEN d LIKE '%foundation%' OR d LIKE '%footing%' OR d LIKE '%slab%' THEN 'foundation_framing'"
    " WHEN d LIKE '%framing%' OR d LIKE '%structural%' OR d LIKE '%rough%' THEN 'structure_substantial' WHEN d LIKE '%certificate of occupancy%' OR d LIKE '%coo%' OR d LIKE '%final%' OR d LIKE '%c of o%' THEN 'rebuild_complete'"
    " WHEN d LIKE '%new dwelling%' OR d LIKE '%new sfr%' OR d LIKE '%new single%' OR d LIKE '%new residence%' OR d LIKE '%rebuild%' THEN 'rebuild_start' ELSE 'other' END AS stage"
    f" FROM (SELECT l_orderkey, l_linenumber, lower({_DESCRIBED}) AS d FROM lineitem))"
)
def cas04_permit_stage(t: Tables) -> DataFrame:
    staged = t.lineitem.select("l_orderkey", "l_linenumber", C.permit_stage(F.expr(_DESCRIBED)).alias("stage"))
    return staged.withColumn("confidence", C.stage_confidence(F.col("stage")))


@query("SELECT o_orderkey, CASE WHEN m IS NULL THEN 'Never' WHEN m < 18 THEN 'Early' ELSE 'Late' END AS status FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) / 30.44 END AS m FROM orders)")
def cas06_status(t: Tables) -> DataFrame:
    months = F.when(F.col("o_orderstatus") != "P", F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) / 30.44)
    return t.orders.select("o_orderkey", C.recovery_status(months).alias("status"))


@query(
    "SELECT l_orderkey, l_linenumber, damage, CASE WHEN damage = 'survived_no_fire' OR (damage = 'total_loss' AND v <= -4 AND s >= 0.30) THEN 'high' WHEN damage = 'partial_damage' THEN 'low' ELSE 'medium' END AS confidence FROM (SELECT *, CASE WHEN s < 0.15 AND b < 0.10 THEN 'survived_no_fire'"
    " WHEN v > -2 THEN 'survived_fire_exposed' WHEN v <= -4 THEN 'total_loss' WHEN k >= 1.5 AND s >= 0.25 THEN 'total_loss' ELSE 'partial_damage' END AS damage"
    " FROM (SELECT l_orderkey, l_linenumber, l_quantity / 100 AS s, l_discount * 2 AS b, 0 - l_tax * 100 AS v, l_extendedprice / 20000 AS k FROM lineitem))"
)
def cas07_tree(t: Tables) -> DataFrame:
    q = F.col
    signals = t.lineitem.select("l_orderkey", "l_linenumber", (q("l_quantity") / 100).alias("s"), (q("l_discount") * 2).alias("b"), (0 - q("l_tax") * 100).alias("v"), (q("l_extendedprice") / 20000).alias("k"))
    damage = C.damage_tree(q("s"), q("b"), q("v"), q("k"))
    return signals.select("l_orderkey", "l_linenumber", damage.alias("damage"), C.damage_confidence(q("s"), damage, q("v")).alias("confidence"))


@query(
    "WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN d < -8 THEN 'cleared_lot' WHEN d < -6 THEN 'destroyed' WHEN d < -4 THEN 'foundation_framing' WHEN d <= -1.5 THEN 'structure_substantial' WHEN d > -1.5 THEN 'rebuild_complete' END AS stage FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 5 - 10 AS d FROM lineitem)), p AS (SELECT *, lag(stage) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM s)"
    " SELECT l_orderkey, l_linenumber, stage, before IS NULL OR (before, stage) IN (('destroyed', 'cleared_lot'), ('destroyed', 'foundation_framing'), ('cleared_lot', 'cleared_lot'), ('cleared_lot', 'foundation_framing'), ('foundation_framing', 'foundation_framing'), ('foundation_framing', 'structure_substantial'),"
    " ('structure_substantial', 'structure_substantial'), ('structure_substantial', 'rebuild_complete'), ('rebuild_complete', 'rebuild_complete')) AS allowed FROM p"
)
def cas08_stage(t: Tables) -> DataFrame:
    """Stage by thresholds, and whether the step from the stage before is an allowed one."""
    from pyspark.sql import Window

    staged = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.rebuild_stage(F.col("l_quantity") / 5 - 10).alias("stage"))
    before = F.lag("stage").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return staged.withColumn("before", before).select("l_orderkey", "l_linenumber", "stage", C.valid_step(F.col("before"), F.col("stage")).alias("allowed"))


@query("SELECT c_custkey, CASE c WHEN 'Destroyed' THEN 0 WHEN 'Damaged' THEN 1 WHEN 'Unaffected' THEN 2 END AS severity, CASE WHEN lower(b) = 'true' THEN true END AS flag FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Destroyed' WHEN 1 THEN 'Damaged' WHEN 2 THEN 'Unaffected' ELSE 'Other' END AS c, CASE c_custkey % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'no' END AS b FROM customer)")
def cas09_rank_and_flag(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    condition = F.when(k % 4 == 0, "Destroyed").when(k % 4 == 1, "Damaged").when(k % 4 == 2, "Unaffected").otherwise("Other")
    flag = F.when(k % 3 == 0, "True").when(k % 3 == 1, "no")
    return t.customer.select("c_custkey", C.severity_rank(condition).alias("severity"), C.as_boolean(flag).alias("flag"))


@query("SELECT o_custkey, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'high' WHEN c IS NOT NULL OR d IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 1.0 WHEN c IS NOT NULL OR d IS NOT NULL THEN 0.6 ELSE 0.3 END AS weight FROM (SELECT o_custkey, min(CASE WHEN o_totalprice > 300000 THEN o_orderdate END) AS a, min(CASE WHEN o_totalprice > 280000 AND o_orderstatus = 'F' THEN o_orderdate END) AS b, min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END) AS c, min(CASE WHEN o_orderstatus = 'P' THEN o_orderdate END) AS d FROM orders GROUP BY 1)")
def cas11_milestones(t: Tables) -> DataFrame:
    first = lambda c: F.min(F.when(c, F.col("o_orderdate")))
    p = F.col("o_totalprice")
    dates = t.orders.groupBy("o_custkey").agg(first(p > 300000).alias("a"), first((p > 280000) & (F.col("o_orderstatus") == "F")).alias("b"), first(F.col("o_orderpriority") == "1-URGENT").alias("c"), first(F.col("o_orderstatus") == "P").alias("d"))
    level = C.milestone_confidence(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return dates.select("o_custkey", level.alias("confidence"), C.stage_weight(level).cast("decimal(2,1)").alias("weight"))
