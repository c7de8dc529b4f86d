"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant.

DataFrame functions only. Each language and source has its own centre and scatter. Two deterministic starts (medians with
median absolute deviations, without correlations and with those of bounded scores) each take concentration steps: the
``share`` of rows nearest by Mahalanobis distance gives the next mean and covariance, which never raises the determinant,
until it no longer falls; the start that ends at the lesser determinant counts. Quantiles are mergeable sketches and
means are sums, so a group that holds a third of all rows needs no more memory than a small one.

Defined results: a null or empty text has no words and fails the base rules; a null lang or source is a group of its
own kind; a group under ``MIN_GROUP`` rows is judged by the estimate over all rows of its language, and where that is
as small by the one over the whole corpus, so every row has a verdict; equal rows get equal verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, release, stage, with_row

WORDS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
SHARE = 0.75
#: Concentration steps at most, and the fall of a log determinant that counts as none.
STEPS, SETTLED = 8, 1e-3
MIN_GROUP = 100
TAIL = 1e-7
SMALL_SET = 48
FEATURES = ("f_length", "f_symbols", "f_lines", "f_repeats")
#: Least spread of each feature: most are constant over clean text, where a covariance alone would be singular. Every
#: feature can leave the limit behind by itself: at half the lines repeated, or a share of repeated words of 0.47.
FLOOR = (0.13, 0.3, 0.1, 0.45)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a lambda's variable isn't inlined again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more: hash windows, keep hashes that sort next to an equal one, then
    measure the union of the windows' spans."""

    def counted(starts: Column) -> Column:
        # Starts ascend, so the union grows by what lies beyond the last end.
        step = lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"]

    def few(windows: Column, twice: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.array_contains(twice, F.get(windows, i)))

    def many(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        near = lambda s: F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(let(pairs, near), lambda x: x["i"]))

    def with_windows(windows: Column) -> Column:
        twice = let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i - 1), F.lit(False)))))
        choose = lambda t: F.when(F.size(t) == 0, F.lit(0)).when(F.size(t) <= SMALL_SET, counted(few(windows, t))).otherwise(counted(many(windows)))
        return let(twice, choose)

    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(hashed(w), with_windows)))


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, lang, source, the columns ``more`` and the counts of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, WORDS, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeats"), F.aggregate(w, F.lit(0), lambda a, x: a + F.char_length(x)).alias("chars"))

    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    counted = docs.select("doc_id", "lang", "source", *more, let(words, of_words).alias("w"), of_lines.alias("l"), F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).alias("symbols"))
    counts = {"n_words": "w.n", "word_chars": "w.chars", "n_symbols": "symbols", "n_dup_lines": "l.dup", "n_repeat_words": "w.repeats", "n_lines": "l.n"}
    return counted.select("doc_id", "lang", "source", *more, *(F.col(v).cast("long").alias(k) for k, v in counts.items()))


def features() -> list[Column]:
    """Logs of ratios, and of what is left beside the repeats: a few of them count for little, and a text that is mostly
    lines said before, or comes near the base rule's half of its words, lies far out."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    made = (F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars), -F.log(1 - F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), -F.log(F.greatest(1 - 2 * F.col("n_repeat_words") / words, F.lit(1e-3))))
    return [m.alias(n) for m, n in zip(made, FEATURES, strict=True)]


# --- minimum covariance determinant ---------------------------------------------------------------------------------


def _chi2(x: float, df: int) -> float:
    """Distribution function of chi-square for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def _chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, df) < p else (low, mid)
    return low


def consistency(share: float, df: int) -> float:
    """What the covariance of the nearest ``share`` must be scaled by to be that of a normal population."""
    return share / _chi2(_chi2_quantile(share, df), df + 2)


def with_precision(moments: DataFrame, group: list[str], p: int) -> DataFrame:
    """Covariances ``c0_0…`` replaced by the entries ``q0_0…`` of their inverse, by sweeping each pivot in turn, and by
    ``logdet``: the determinant is the product of the pivots."""
    at = lambda i, j: F.col(f"c{max(i, j)}_{min(i, j)}")
    entries = [(i, j) for i in range(p) for j in range(i + 1)]
    keep = [*group, *(f"m{i}" for i in range(p)), "logdet"]
    moments = moments.withColumn("logdet", F.lit(0.0))
    for k in range(p):
        swept = {(i, j): -1 / at(k, k) if i == j == k else at(i, j) / at(k, k) if k in (i, j) else at(i, j) - at(i, k) * at(j, k) / at(k, k) for i, j in entries}
        moments = moments.select(*keep[:-1], (F.col("logdet") + F.log(at(k, k))).alias("logdet"), *(v.alias(f"c{i}_{j}") for (i, j), v in swept.items()))
    return moments.select(*keep, *((-at(i, j)).alias(f"q{i}_{j}") for i, j in entries))


def _moments(x: list[str]) -> list[Column]:
    out = [F.avg(n).alias(f"m{i}") for i, n in enumerate(x)]
    return out + [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(len(x)) for j in range(i + 1)]


def _granted(variance: Column, floor: float) -> Column:
    """At least the square of ``floor``. A fourth of it is added to any variance, so that no direction is left without
    scatter where features depend on each other."""
    return F.greatest(variance + floor**2 / 4, F.lit(floor**2))


def _same(group: list[str]) -> Column:
    on = F.col(f"a.{group[0]}").eqNullSafe(F.col(f"b.{group[0]}"))
    for g in group[1:]:
        on = on & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return on


def _starts(rows: DataFrame, group: list[str], names: list[str], floor: tuple[float, ...]) -> tuple[DataFrame, DataFrame]:
    """``start`` 0 and 1 of each group, with means and covariances, and the staged table that this reads."""
    p = len(names)
    med = rows.groupBy(*group).agg(*(F.percentile_approx(n, 0.5, 1000).alias(f"m{i}") for i, n in enumerate(names)))
    off = rows.alias("a").join(med.alias("b"), _same(group)).select(*(F.col(f"a.{g}") for g in group), *(F.col(f"b.m{i}") for i in range(p)), *((F.col(f"a.{n}") - F.col(f"b.m{i}")).alias(n) for i, n in enumerate(names)))
    # A spread of nothing makes every score of its feature nothing or the bound: the least spread is a tiny one.
    scale = stage(off.groupBy(*group).agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(p)), *(F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(n)), 0.5, 1000), F.lit(max(floor[i], 1e-6))).alias(f"s{i}") for i, n in enumerate(names))), "mcd-scale")
    scored = off.select(*group, *names).alias("a").join(scale.alias("b"), _same(group)).select(*(F.col(f"a.{g}") for g in group), *(F.tanh(F.col(f"a.{n}") / F.col(f"b.s{i}")).alias(n) for i, n in enumerate(names)))
    pairs = [(i, j) for i in range(p) for j in range(i)]
    # A feature without spread is related to none.
    related = scored.groupBy(*group).agg(*(F.coalesce(F.try_divide(F.covar_pop(names[i], names[j]), F.stddev_pop(names[i]) * F.stddev_pop(names[j])), F.lit(0.0)).alias(f"r{i}_{j}") for i, j in pairs))
    both = scale.alias("a").join(related.alias("b"), _same(group)).select("a.*", *(F.col(f"b.r{i}_{j}") for i, j in pairs), F.explode(F.array(F.lit(0), F.lit(1))).alias("start"))
    # Correlations are drawn in a little, so that the scatter has an inverse.
    cov = {(i, j): F.pow(f"s{i}", F.lit(2.0)) + floor[i] ** 2 if i == j else 0.95 * F.col("start") * F.col(f"r{i}_{j}") * F.col(f"s{i}") * F.col(f"s{j}") for i in range(p) for j in range(i + 1)}
    return both.select(*group, "start", *(f"m{i}" for i in range(p)), *(v.alias(f"c{i}_{j}") for (i, j), v in cov.items())), scale


def robust_estimates(rows: DataFrame, group: list[str], x: tuple[str, ...] = FEATURES, floor: tuple[float, ...] = FLOOR, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """One row per group: means ``m0…``, inverse covariances ``q0_0…`` (scaled to be consistent, with the least spreads), ``logdet``."""
    p, names = len(x), list(x)
    each, scale = [*group, "start"], consistency(share, p)
    begun, scale_table = _starts(rows, group, names, floor)
    now = stage(with_precision(begun, each, p), "mcd-start")
    release(scale_table)
    for step in range(steps):
        near = with_distance(rows, now, group, x)
        cut = near.groupBy(*each).agg(F.percentile_approx("d2", share, 1000).alias("cut"))
        got = near.alias("a").join(cut.alias("b"), _same(each)).filter("a.d2 <= b.cut").select("a.*").groupBy(*each).agg(*_moments(names))
        cov = {f"c{i}_{j}": _granted(F.col(f"c{i}_{i}") * scale, floor[i]) if i == j else F.col(f"c{i}_{j}") * scale for i in range(p) for j in range(i + 1)}
        new = stage(with_precision(got.select(*each, *(f"m{i}" for i in range(p)), *(v.alias(k) for k, v in cov.items())), each, p), "mcd-step")
        fall = new.alias("a").join(now.alias("b"), _same(each)).agg(F.max(F.col("b.logdet") - F.col("a.logdet"))).first()[0]
        release(now)
        now = new
        # The first step comes from another kind of scatter.
        if step and (fall is None or fall < SETTLED):
            break
    values = [c for c in now.columns if c not in each]
    return now.groupBy(*group).agg(F.min_by(F.struct(*values), F.struct("logdet", "start")).alias("b")).select(*group, "b.*")


def with_distance(rows: DataFrame, estimates: DataFrame, group: list[str], x: tuple[str, ...] = FEATURES) -> DataFrame:
    """``rows`` with ``d2``, for each estimate of their group; null where there is none."""
    p = len(x)
    more = ["b.start"] if "start" in estimates.columns else []
    off = [F.col(f"a.{n}") - F.col(f"b.m{i}") for i, n in enumerate(x)]
    d2 = F.lit(0.0)
    for i in range(p):
        for j in range(i + 1):
            d2 = d2 + off[i] * off[j] * F.col(f"b.q{i}_{j}") * (1 if i == j else 2)
    return rows.alias("a").join(estimates.alias("b"), _same(group), "left").select("a.*", *more, d2.alias("d2"))


def _levels(passed: DataFrame) -> DataFrame:
    """lang, source, ``grp`` (whose estimate judges the group's rows) and ``fit`` (the estimates they take part in)."""
    sizes = passed.groupBy("lang", "source").agg(F.count("*").alias("n"))
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.min("n").alias("least"))
    small = langs.agg(F.coalesce(F.min("lang_n"), F.lit(0)) < MIN_GROUP).first()[0]
    own, lang, every = (F.to_json(F.struct(*c)) for c in ((F.lit("source").alias("level"), "lang", "source"), (F.lit("lang").alias("level"), "lang"), (F.lit("all").alias("level"),)))
    own_ok, lang_ok = F.col("n") >= MIN_GROUP, F.col("lang_n") >= MIN_GROUP
    both = sizes.alias("a").join(langs.alias("b"), _same(["lang"])).select("a.*", "b.lang_n", "b.least")
    fit = F.array(F.when(own_ok, own), F.when(lang_ok & (F.col("least") < MIN_GROUP), lang), every if small else F.lit(None).cast("string"))
    return both.select("lang", "source", F.when(own_ok, own).when(lang_ok, lang).otherwise(every).alias("grp"), F.array_compact(fit).alias("fit"))


def judge(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, lang, source, the columns ``more``, the counts, base_failed and kept for every row of ``docs``. Rows are
    written once with their counts; estimates are a row a group, so no row is shuffled for its verdict."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = stage(statistics(docs, *more).withColumn("base_failed", base), "quality-counts")
    passed = counted.filter(~F.col("base_failed")).select("*", *features())
    levels = stage(_levels(counted.filter(~F.col("base_failed"))), "quality-levels")
    keyed = passed.alias("a").join(levels.alias("b"), _same(["lang", "source"])).select("a.*", "b.grp", "b.fit")
    fit = stage(keyed.select(F.explode("fit").alias("grp"), *FEATURES), "quality-fit")
    estimates = robust_estimates(fit, ["grp"])
    release(fit)
    judged = with_distance(keyed, estimates, ["grp"])
    limit = _chi2_quantile(1 - TAIL, len(FEATURES))
    verdict = F.col("d2") <= limit
    names = ["doc_id", "lang", "source", *more, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*names, verdict.alias("kept")).unionByName(counted.filter("base_failed").select(*names, F.lit(False).alias("kept")))


def op8_quality(spark, sf_dir) -> DataFrame:
    """Counts and verdict of every document."""
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage_quality(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Documents that pass; their columns."""
    rows = with_row(docs, **{c: F.col(c) for c in ("doc_id", "text", "lang", "source")})
    return judge(rows, "row").filter("kept").select("row.*")
