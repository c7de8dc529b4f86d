"""Series queries: a key's daily mean of event values is its series, with missing days as nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import series as S
from .registry import Tables, query

EVENT_DAY = 8
DAYS = 30

#: Dense daily series: user_id, d, x.
SERIES = (
    "e AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, avg(value) AS x FROM events GROUP BY 1, 2), s AS (SELECT u.user_id, CAST(g.d AS INTEGER) AS d, e.x FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(0, 30)) AS d) g LEFT JOIN e ON e.user_id = u.user_id AND e.d = g.d)"
)
_W = "OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"


def interpolate_sql(name: str, source: str, x: str, y: str) -> str:
    """Common table expressions that add ``y``, ``x`` interpolated by row, to ``source``."""
    return (
        f"{name}0 AS (SELECT *, last_value({x} IGNORE NULLS) OVER p AS x0, last_value(CASE WHEN {x} IS NOT NULL THEN d END IGNORE NULLS) OVER p AS i0, first_value({x} IGNORE NULLS) OVER f AS x1, first_value(CASE WHEN {x} IS NOT NULL THEN d END IGNORE NULLS) OVER f AS i1 FROM {source}"
        f" WINDOW p AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),"
        f" {name} AS (SELECT * EXCLUDE (x0, i0, x1, i1), CASE WHEN {x} IS NOT NULL THEN {x} WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (d - i0) / (i1 - i0) END AS {y} FROM {name}0)"
    )


def wiener_sql(name: str, source: str, x: str, y: str) -> str:
    return (
        f"{name}0 AS (SELECT *, sum({x}) {_W} / 11 AS m, sum({x} * {x}) {_W} / 11 - (sum({x}) {_W} / 11) * (sum({x}) {_W} / 11) AS v FROM {source}), {name}1 AS (SELECT *, avg(v) OVER (PARTITION BY user_id) AS noise FROM {name}0),"
        f" {name} AS (SELECT * EXCLUDE (m, v, noise), CASE WHEN v < noise THEN m ELSE m + ({x} - m) * (1 - noise / nullif(v, 0)) END AS {y} FROM {name}1)"
    )


SMOOTH = (
    f"{SERIES}, a1 AS (SELECT *, abs(x - median(x) OVER (PARTITION BY user_id)) AS dev, count(x) OVER (PARTITION BY user_id) AS n FROM s), a2 AS (SELECT *, median(dev) OVER (PARTITION BY user_id) AS mad FROM a1), a3 AS (SELECT user_id, d, x, CASE WHEN NOT coalesce(n >= 5 AND dev > 3 * 1.4826 * mad, false) THEN x END AS clean, coalesce(n >= 5 AND dev > 3 * 1.4826 * mad, false) AS gone FROM a2),"
    f" a4 AS (SELECT *, sum(clean) {_W} / nullif(sum(CASE WHEN clean IS NOT NULL THEN 1.0 ELSE 0.0 END) {_W}, 0) AS roll FROM a3), {interpolate_sql('a5', 'a4', 'roll', 'fill')}, {wiener_sql('a6', 'a5', 'fill', 'wien')},"
    f" sm AS (SELECT user_id, d, x, CASE WHEN count(clean) {_W} >= 5 THEN wien END AS smoothed, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS INTEGER) AS n_outliers FROM a6)"
)


def daily(t: Tables) -> DataFrame:
    """user_id, d, x: a row for every user and day."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    means = S.ordered_means(t.events, {"user_id": F.col("user_id"), "d": day}, {"x": F.col("value")})
    return S.dense_grid(means, "user_id", "d", 0, DAYS - 1, t.events.select("user_id"))


def smoothed(t: Tables) -> DataFrame:
    return S.smooth(daily(t), "x", "user_id", "d", "smoothed")


def _r(*names: str, places: int = 6):
    return [F.round(n, places).alias(n) for n in names]


@query(f"WITH {SERIES} SELECT user_id, d, round(sum(x) {_W}, 6) AS total FROM s")
def win02_roll_sum(t: Tables) -> DataFrame:
    return daily(t).select("user_id", "d", F.round(S.rolling_sum(F.col("x"), "user_id", "d"), 6).alias("total"))


@query(f"WITH {SERIES} SELECT user_id, d, CASE WHEN count(x) {_W} >= 5 THEN round(x, 6) END AS masked FROM s")
def win03_roll_mask(t: Tables) -> DataFrame:
    few = S.rolling_count(F.col("x"), "user_id", "d") < 5
    return daily(t).select("user_id", "d", F.when(~few, F.round("x", 6)).alias("masked"))


@query(f"WITH {SERIES}, w AS (SELECT *, CASE WHEN x IS NULL THEN 0.0 ELSE 50 * g * g / (1 - g * g) END AS wt FROM (SELECT *, least(greatest(x / 100, 0.01), 0.999) AS g FROM s)) SELECT user_id, d, round(sum(coalesce(x * wt, 0)) {_W} / nullif(sum(wt) {_W}, 0), 6) AS mean FROM w")
def win04_weighted(t: Tables) -> DataFrame:
    weight = N.touzi_weight(F.col("x") / 100)
    return daily(t).select("user_id", "d", F.round(S.weighted_mean(F.col("x"), weight, "user_id", "d"), 6).alias("mean"))


@query(f"WITH {SERIES}, {interpolate_sql('q', 's', 'x', 'filled')} SELECT user_id, d, round(filled, 6) AS filled FROM q")
def win05_interpolate(t: Tables) -> DataFrame:
    return S.interpolate(daily(t), "x", "user_id", "d", "filled").select("user_id", "d", *_r("filled"))


@query(f"WITH {SERIES}, {interpolate_sql('q', 's', 'x', 'filled')}, {wiener_sql('k', 'q', 'filled', 'display')} SELECT user_id, d, round(display, 6) AS display FROM k")
def win06_wiener(t: Tables) -> DataFrame:
    """The display's smoothing: interpolation and Wiener filter."""
    return S.display_smooth(daily(t), "x", "user_id", "d", "display").select("user_id", "d", *_r("display"))


@query(f"WITH {SMOOTH} SELECT user_id, d, round(smoothed, 6) AS smoothed, n_outliers FROM sm")
def win07_smooth(t: Tables) -> DataFrame:
    return smoothed(t).select("user_id", "d", *_r("smoothed"), "n_outliers")


@query("WITH a AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ts2 FROM events) SELECT user_id, ts AS date1, ts2 AS date2, make_timestamp(epoch_us(ts) + (epoch_us(ts2) - epoch_us(ts)) // 2) AS mid, round(floor((epoch_us(ts) + (epoch_us(ts2) - epoch_us(ts)) // 2 - epoch_us(TIMESTAMP '2024-01-09')) / 86400000000.0) / 30.44, 2) AS months FROM a WHERE ts2 IS NOT NULL")
def jn13_pairs(t: Tables) -> DataFrame:
    """Consecutive acquisitions, the middle of each pair, and months from the event to it."""
    from ..functions import dates as D

    ahead = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = t.events.select("user_id", F.col("ts").alias("date1"), ahead.alias("date2")).filter("date2 is not null")
    mid = D.midpoint(F.col("date1"), F.col("date2")).cast("timestamp_ntz")
    placed = pairs.withColumn("mid", mid)
    return placed.withColumn("months", D.months_between(F.lit("2024-01-09").cast("timestamp_ntz"), F.col("mid")))


@query(f"WITH {SERIES}, r AS (SELECT d, x AS ref FROM s WHERE user_id = (SELECT min(user_id) FROM events)) SELECT s.user_id, s.d, CASE WHEN ref > 0.01 THEN round(s.x / ref, 6) END AS norm FROM s LEFT JOIN r ON r.d = s.d")
def jn14_reference_norm(t: Tables) -> DataFrame:
    rows = daily(t)
    first = t.events.agg(F.min("user_id").alias("__first"))
    marked = rows.join(F.broadcast(first))
    return S.normalize_by_reference(marked, "x", "d", F.col("user_id") == F.col("__first"), "norm").select("user_id", "d", *_r("norm"))


@query(f"WITH {SMOOTH}, r AS (SELECT user_id, d, sum(CASE WHEN smoothed >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS run FROM sm) SELECT user_id, min(CASE WHEN run = 5 AND d >= 8 THEN d END) AS crossing FROM r GROUP BY 1")
def win11_crossing(t: Tables) -> DataFrame:
    return S.sustained_crossing(smoothed(t), "smoothed", F.lit(50.0), "user_id", "d", F.lit(EVENT_DAY))


@query(f"WITH {SERIES} SELECT user_id, count(CASE WHEN d < 8 THEN x END) AS n_pre, count(CASE WHEN d >= 8 THEN x END) AS n_post, round(avg(CASE WHEN d < 8 THEN x END) + 1e-7, 4) AS pre, round(avg(CASE WHEN d >= 8 THEN x END) + 1e-7, 4) AS post FROM s GROUP BY 1")
def win12_split(t: Tables) -> DataFrame:
    """Counts and means before and after; rounded off the edge, where sums in another order would part."""
    before = F.col("d") < EVENT_DAY
    pre, post = F.when(before, F.col("x")), F.when(~before, F.col("x"))
    return daily(t).groupBy("user_id").agg(F.count(pre).alias("n_pre"), F.count(post).alias("n_post"), F.round(F.avg(pre) + 1e-7, 4).alias("pre"), F.round(F.avg(post) + 1e-7, 4).alias("post"))


@query(f"WITH {SERIES} SELECT user_id, CAST(sum(CASE WHEN (d - 8) / 30.44 < 0.25 THEN 1 ELSE 0 END) AS BIGINT) AS pos FROM s GROUP BY 1")
def win13_searchsorted(t: Tables) -> DataFrame:
    """Left insertion point of a month in each series."""
    return daily(t).groupBy("user_id").agg(F.count_if((F.col("d") - EVENT_DAY) / 30.44 < 0.25).alias("pos"))


@query(f"WITH {SERIES} SELECT user_id, d, round(x - coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY d), x), 6) AS delta FROM s")
def win14_diff(t: Tables) -> DataFrame:
    return daily(t).select("user_id", "d", F.round(S.difference(F.col("x"), "user_id", "d"), 6).alias("delta"))


@query(f"WITH {SERIES}, l AS (SELECT user_id, x < lag(x) OVER (PARTITION BY user_id ORDER BY d) AS fell FROM s) SELECT user_id, bool_or(coalesce(fell, false)) AS regressed FROM l GROUP BY 1")
def win15_regression(t: Tables) -> DataFrame:
    return S.regression_flag(daily(t), "x", "user_id", "d")


@query()
def win15_regression_whole(t: Tables) -> DataFrame:
    """Over every day of the series."""
    return S.regression_flag(daily(t), "x", "user_id", "d")


@query(f"WITH {SERIES} SELECT user_id, round(x, 6) AS latest FROM s WHERE d = 29")
def win16_latest(t: Tables) -> DataFrame:
    """The last of the series, null if that is missing."""
    last = daily(t).groupBy("user_id").agg(F.max(F.struct("d", "x")).alias("l"))
    return last.select("user_id", F.round("l.x", 6).alias("latest"))


@query(f"WITH {SERIES} SELECT user_id, d, round(x - median(CASE WHEN d < 8 THEN x END) OVER (PARTITION BY user_id), 6) AS rel FROM s")
def win17_baseline_rel(t: Tables) -> DataFrame:
    base = F.median(F.when(F.col("d") < EVENT_DAY, F.col("x"))).over(Window.partitionBy("user_id"))
    return daily(t).select("user_id", "d", F.round(F.col("x") - base, 6).alias("rel"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN CASE WHEN y < m THEN 1 ELSE 2 END WHEN 'MACHINERY' THEN CASE WHEN y < m THEN 3 ELSE 4 END ELSE 5 END AS fold FROM (SELECT c_custkey, c_mktsegment, c_acctbal AS y, median(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m FROM customer)")
def win18_folds(t: Tables) -> DataFrame:
    """Folds by place: below or above the median of the group, two groups by name, all others in one fold."""
    # The median is one row a group, joined back: a window would hold a whole group's rows in one task.
    middle = t.customer.groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("m"))
    low = F.col("c_acctbal") < F.col("m")
    fold = F.when(F.col("c_mktsegment") == "BUILDING", F.when(low, 1).otherwise(2)).when(F.col("c_mktsegment") == "MACHINERY", F.when(low, 3).otherwise(4)).otherwise(5)
    return t.customer.join(middle, "c_mktsegment").select("c_custkey", fold.alias("fold"))


@query("SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 45 AS BIGINT) AS batch FROM customer")
def win19_batches(t: Tables) -> DataFrame:
    from ..operators.batches import numbered

    return numbered(t.customer.select("c_custkey"), ["c_custkey"], "n").select("c_custkey", F.floor(F.col("n") / 45).alias("batch"))
