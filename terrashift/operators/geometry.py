"""Repair of rings that cross themselves, and simplification that keeps shared borders shared."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..staging import deleted, written
from .batches import spread

RINGS = "array<array<struct<x:double,y:double>>>"


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _span(low: Column, high: Column, start: Column, cell: Column) -> Column:
    return F.sequence(F.floor((low - start) / cell), F.floor((high - start) / cell))


def _sides(df: DataFrame, key: str, rings: str, digits: int) -> DataFrame:
    """k, id, x1, y1, x2, y2 of all sides that have a length, and the polygon's grid: start (gx, gy) and cell, so that
    about as many cells as sides cover it."""
    tidy = F.array_distinct(F.transform(rings, lambda r: G.once(F.transform(r, lambda p: _point(F.round(p["x"], digits), F.round(p["y"], digits))))))
    listed = df.select(F.col(key).alias("k"), F.posexplode(tidy).alias("ring", "points")).select("k", "ring", F.posexplode(G._edges(F.col("points"))).alias("i", "e"))
    sides = listed.select("k", (F.shiftleft(F.col("ring").cast("long"), 32) + F.col("i")).alias("id"), "e.*").filter("x1 <> x2 or y1 <> y2")
    own = Window.partitionBy("k")
    low, high = lambda c: F.min(F.least(f"{c}1", f"{c}2")).over(own), lambda c: F.max(F.greatest(f"{c}1", f"{c}2")).over(own)
    size = F.greatest(high("x") - low("x"), high("y") - low("y"))
    return sides.withColumns({"gx": low("x"), "gy": low("y"), "cell": size / F.ceil(F.sqrt(F.count(F.lit(1)).over(own).cast("double")))})


def _cuts(sides: DataFrame) -> DataFrame:
    """k, id, p: points at which a side meets another of its polygon."""
    x, y = _span(F.least("x1", "x2"), F.greatest("x1", "x2"), F.col("gx"), F.col("cell")), _span(F.least("y1", "y2"), F.greatest("y1", "y2"), F.col("gy"), F.col("cell"))
    placed = sides.select("*", F.explode(x).alias("cx")).select("*", F.explode(y).alias("cy"))
    a, b = placed.alias("a"), placed.select("k", "cx", "cy", "id", "x1", "y1", "x2", "y2").alias("b")
    c = F.col
    low = lambda n: F.greatest(F.least(c(f"a.{n}1"), c(f"a.{n}2")), F.least(c(f"b.{n}1"), c(f"b.{n}2")))
    high = lambda n: F.least(F.greatest(c(f"a.{n}1"), c(f"a.{n}2")), F.greatest(c(f"b.{n}1"), c(f"b.{n}2")))
    # A pair is taken in the cell of the lower left corner of what both boxes share.
    here = (F.floor((low("x") - c("a.gx")) / c("a.cell")) == c("a.cx")) & (F.floor((low("y") - c("a.gy")) / c("a.cell")) == c("a.cy"))
    meet = (c("a.k") == c("b.k")) & (c("a.cx") == c("b.cx")) & (c("a.cy") == c("b.cy")) & (c("a.id") < c("b.id"))
    pairs = a.join(b.hint("merge"), meet).filter((low("x") <= high("x")) & (low("y") <= high("y")) & here)
    dx, dy, sx, sy = c("a.x2") - c("a.x1"), c("a.y2") - c("a.y1"), c("b.x2") - c("b.x1"), c("b.y2") - c("b.y1")
    ex, ey = c("b.x1") - c("a.x1"), c("b.y1") - c("a.y1")
    den, long = dx * sy - dy * sx, F.sqrt((dx * dx + dy * dy) * (sx * sx + sy * sy))
    level = F.abs(den) <= 1e-12 * long
    t, u = F.try_divide(ex * sy - ey * sx, den), F.try_divide(ex * dy - ey * dx, den)
    crossing = ~level & t.between(-1e-12, 1 + 1e-12) & u.between(-1e-12, 1 + 1e-12)
    at = _point(F.round(c("a.x1") + t * dx, 9), F.round(c("a.y1") + t * dy, 9))
    ends = {s: (_point(c(f"{s}.x1"), c(f"{s}.y1")), _point(c(f"{s}.x2"), c(f"{s}.y2"))) for s in "ab"}
    # An end stays what it is, however the division came out.
    near = lambda p: (F.abs(p["x"] - at["x"]) <= 2e-9) & (F.abs(p["y"] - at["y"]) <= 2e-9)
    exact = F.coalesce(*(F.when(near(p), p) for s in "ab" for p in ends[s]), at)
    inside = lambda s, p: p["x"].between(F.least(c(f"{s}.x1"), c(f"{s}.x2")), F.greatest(c(f"{s}.x1"), c(f"{s}.x2"))) & p["y"].between(F.least(c(f"{s}.y1"), c(f"{s}.y2")), F.greatest(c(f"{s}.y1"), c(f"{s}.y2")))
    same_line = level & (F.abs(ex * dy - ey * dx) <= 1e-9 * F.sqrt(dx * dx + dy * dy))
    cut = lambda s, p, when: F.when(when, F.struct(c(f"{s}.id").alias("id"), p.alias("p")))
    found = F.array(cut("a", exact, crossing), cut("b", exact, crossing), *(cut(s, p, same_line & inside(s, p)) for s, o in ("ab", "ba") for p in ends[o]))
    return pairs.select(c("a.k").alias("k"), F.explode(found).alias("f")).filter("f is not null").select("k", "f.id", "f.p").distinct()


def _pieces(sides: DataFrame, cuts: DataFrame) -> DataFrame:
    """k, lo, hi of the pieces of sides between cuts that an odd number of sides run over, lesser point first."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = lambda p: F.struct(((p["x"] - F.col("x1")) * dx + (p["y"] - F.col("y1")) * dy).alias("t"), p.alias("p"))
    points = F.concat(F.array(_point(F.col("x1"), F.col("y1")), _point(F.col("x2"), F.col("y2"))), F.coalesce("cuts", F.expr("cast(array() as array<struct<x:double,y:double>>)")))
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(points), along)), lambda s: s["p"])
    full = sides.join(cuts.groupBy("k", "id").agg(F.collect_list("p").alias("cuts")).hint("merge"), ["k", "id"], "left").select("k", "gx", "gy", "cell", ordered.alias("o"))
    between = F.zip_with(F.slice("o", F.lit(1), F.size("o") - 1), F.slice("o", F.lit(2), F.size("o") - 1), lambda p, q: F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")))
    each = full.select("k", "gx", "gy", "cell", F.inline(between)).filter("lo <> hi")
    return each.groupBy("k", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.first("gx").alias("gx"), F.first("gy").alias("gy"), F.first("cell").alias("cell")).filter("n % 2 = 1").drop("n")


def _directed(pieces: DataFrame) -> DataFrame:
    """k, p, q: each piece with the inside, by even-odd, on its left.

    Above an upright piece's left side, or a level one's upper side, the crossings that a ray meets are counted; only pieces
    in the ray's strip of the grid are looked at."""
    out = None
    for along, across, upright in (("x", "y", False), ("y", "x", True)):
        kind = (F.col("lo.x") == F.col("hi.x")) if upright else (F.col("lo.x") != F.col("hi.x"))
        start = F.col(f"g{along}")
        own = pieces.filter(kind).withColumns({"m": (F.col(f"lo.{along}") + F.col(f"hi.{along}")) / 2, "h": (F.col(f"lo.{across}") + F.col(f"hi.{across}")) / 2})
        own = own.withColumn("strip", F.floor((F.col("m") - start) / F.col("cell"))).select("k", "lo", "hi", "m", "h", "strip")
        span = _span(F.least(f"lo.{along}", f"hi.{along}"), F.greatest(f"lo.{along}", f"hi.{along}"), start, F.col("cell"))
        every = pieces.select("k", F.col("lo").alias("a"), F.col("hi").alias("b"), F.explode(span).alias("strip"))
        a, b = F.col(f"a.{along}"), F.col(f"b.{along}")
        place = F.col(f"a.{across}") + F.try_divide((F.col("m") - a) * (F.col(f"b.{across}") - F.col(f"a.{across}")), b - a)
        beyond = (place < F.col("h")) if upright else (place > F.col("h"))
        hit = ((a > F.col("m")) != (b > F.col("m"))) & beyond & ((F.col("a") != F.col("lo")) | (F.col("b") != F.col("hi")))
        counted = own.join(every.hint("merge"), ["k", "strip"]).groupBy("k", "lo", "hi").agg(F.count(F.when(hit, 1)).alias("n"))
        some = counted.select("k", F.when(F.col("n") % 2 == 1, F.struct(F.col("lo").alias("p"), F.col("hi").alias("q"))).otherwise(F.struct(F.col("hi").alias("p"), F.col("lo").alias("q"))).alias("s")).select("k", "s.*")
        out = some if out is None else out.union(some)
    return out


def stitch(pieces: list[tuple[tuple[float, float], tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Rings of directed pieces with the inside on their left: at a point the next piece is the first clockwise from the
    way back. Points on a straight stretch are left out."""
    after = defaultdict(list)
    for p, q in sorted(pieces):
        after[p].append(q)
    rings, unused = [], {(p, q) for p, q in pieces}
    for first in sorted(pieces):
        if first not in unused:
            continue
        ring, (p, q) = [], first
        while (p, q) in unused:
            unused.discard((p, q))
            ring.append(p)
            back = math.atan2(p[1] - q[1], p[0] - q[0])
            turn = lambda r: (back - math.atan2(r[1] - q[1], r[0] - q[0])) % (2 * math.pi) or 2 * math.pi  # noqa: B023, E731
            open_ends = [r for r in after[q] if (q, r) in unused]
            if not open_ends:
                break
            p, q = q, min(open_ends, key=turn)
        n = len(ring)
        cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
        bends = [ring[i] for i in range(n) if abs(cross(ring[i - 1], ring[i], ring[(i + 1) % n])) > 1e-12]
        if len(bends) > 2:
            rings.append(bends)
    return rings


def repair(df: DataFrame, key: str, rings: str, digits: int = 9) -> DataFrame:
    """key, ``rings`` and ``area`` of what the rings of each row hold by even-odd, as rings that don't cross: outer ones
    run counter-clockwise, holes clockwise. Spikes vanish; rings that run twice over the same points count once.

    Sides that cross are found by cells of a grid over each polygon and cut there; of pieces run over twice nothing
    remains; the inside is put on the left; pieces make rings. Coordinates are rounded to ``digits`` places. Null and empty
    rings give no ring and area 0; ``key`` has one row a value. Joins are merged: what is written here compresses so well
    that its size on disk would have it broadcast, whole, through the driver."""
    sides = written(_sides(spread(df, key), key, rings, digits), "repair-sides")
    pieces = written(_pieces(sides, _cuts(sides)), "repair-pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for b in batches:
            made = [[[{"x": x, "y": y} for x, y in ring] for ring in stitch([((s["p"]["x"], s["p"]["y"]), (s["q"]["x"], s["q"]["y"])) for s in row])] for row in b.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(made, kind)], ["k", "rings"])

    gathered = _directed(pieces).groupBy("k").agg(F.collect_list(F.struct("p", "q")).alias("s"))
    made = written(gathered.mapInArrow(run, f"k {df.schema[key].dataType.simpleString()}, rings {RINGS}"), "repair-rings")
    deleted(sides, pieces)
    whole = df.select(F.col(key).alias("k")).join(made.hint("merge"), "k", "left").withColumn("rings", F.coalesce("rings", F.expr(f"cast(array() as {RINGS})")))
    return whole.select(F.col("k").alias(key), "rings", F.aggregate("rings", F.lit(0.0), lambda s, r: s + G.signed_area(r)).alias("area"))


def thin(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Places kept of a line's points (Douglas and Peucker): both ends, and of a closed line two more at least."""
    n, keep = len(points), {0, len(points) - 1}

    def far(a: int, b: int) -> tuple[int, float]:
        d, e = points[b] - points[a], points[a + 1 : b] - points[a]
        size = math.hypot(*d)
        away = np.abs(d[0] * e[:, 1] - d[1] * e[:, 0]) / size if size else np.hypot(e[:, 0], e[:, 1])
        k = int(away.argmax())
        return a + 1 + k, float(away[k])

    todo = [(0, n - 1)]
    if n > 3 and (points[0] == points[-1]).all():
        k = far(0, n - 1)[0]
        todo = [(0, k), (k, n - 1)]
        keep.add(k)
        keep.add(max((far(a, b) for a, b in todo if b - a > 1), key=lambda x: x[1])[0])
        ends = sorted(keep)
        todo = list(zip(ends, ends[1:], strict=False))
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            k, away = far(a, b)
            if away > tolerance:
                keep.add(k)
                todo += [(a, k), (k, b)]
    return np.array(sorted(keep))


def _thinned(arc: str, tolerance: str) -> Column:
    def lines(arcs: pd.Series, tolerances: pd.Series) -> pd.Series:
        return pd.Series([[a[i] for i in thin(np.array([(p["x"], p["y"]) for p in a]), t)] for a, t in zip(arcs, tolerances, strict=True)])

    return F.pandas_udf(lines, "array<struct<x:double,y:double>>")(arc, tolerance)


def arcs_of(df: DataFrame, key: str, ring: str) -> DataFrame:
    """k, j, id, ``forward``, ``arc``: each ring as arcs between nodes, points where three or more sides come together.

    An arc that two rings share has the same points for both, lesser direction first; ``id``, its first side, names it, as
    a side is on one arc only. A ring without nodes is one arc from its least point."""
    n = F.size(ring)
    turned = lambda by: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(F.col(ring), (i + by + n) % n + 1))
    rings = df.select(F.col(key).alias("k"), ring).filter(n >= 3)
    points = rings.select("k", F.posexplode(F.arrays_zip(F.col(ring).alias("p"), turned(-1).alias("b"), turned(1).alias("a"))).alias("i", "s")).select("k", "i", "s.*")
    near = points.select("p", F.explode(F.array("b", "a")).alias("q"))
    nodes = near.groupBy("p").agg(F.count_distinct("q").alias("d")).filter("d > 2").select("p", F.lit(True).alias("node"))
    marked = points.join(nodes, "p", "left").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "p", F.coalesce("node", F.lit(False)).alias("node")))).alias("r"))
    at = F.filter(F.transform("r", lambda x: F.when(x["node"], x["i"])), lambda i: i.isNotNull())
    least = F.array_min(F.transform("r", lambda x: F.struct(x["p"], x["i"])))["i"]
    begun = marked.withColumn("at", F.when(F.size(at) > 0, at).otherwise(F.array(least))).withColumn("n", F.size("r"))
    upto = F.concat(F.slice("at", F.lit(2), F.size("at") - 1), F.array(F.col("at")[0] + F.col("n")))
    cut = F.zip_with("at", upto, lambda a, b: F.transform(F.sequence(a, b), lambda i: F.element_at(F.col("r"), i % F.col("n") + 1)["p"]))
    arcs = begun.select("k", F.posexplode(cut).alias("j", "arc"))
    lesser = F.least(F.col("arc"), F.reverse("arc"))
    return arcs.select("k", "j", (F.col("arc") == lesser).alias("forward"), lesser.alias("arc")).withColumn("id", F.struct(F.col("arc")[0].alias("p"), F.col("arc")[1].alias("q")))


def _conflicts(lines: DataFrame, cell: float) -> DataFrame:
    """id of lines that cross or touch another's side, other than at common ends, or lie on one."""
    sides = F.zip_with(F.slice("line", F.lit(1), F.size("line") - 1), F.slice("line", F.lit(2), F.size("line") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    s = lines.select("id", F.posexplode(sides).alias("i", "s")).select("id", "i", "s.*")
    x, y = (F.sequence(F.floor(F.least(f"p.{c}", f"q.{c}") / cell), F.floor(F.greatest(f"p.{c}", f"q.{c}") / cell)) for c in "xy")
    placed = s.select("*", F.explode(x).alias("cx")).select("*", F.explode(y).alias("cy"))
    c = F.col
    a, b = placed.alias("a"), placed.alias("b")
    pairs = a.join(b, (c("a.cx") == c("b.cx")) & (c("a.cy") == c("b.cy")) & (F.struct("a.id", "a.i") < F.struct("b.id", "b.i")))
    of = lambda n: F.struct(c(f"{n}.p.x").alias("x1"), c(f"{n}.p.y").alias("y1"), c(f"{n}.q.x").alias("x2"), c(f"{n}.q.y").alias("y2"))
    common = (c("a.p") == c("b.p")) | (c("a.p") == c("b.q")) | (c("a.q") == c("b.p")) | (c("a.q") == c("b.q"))
    same = ((c("a.p") == c("b.p")) & (c("a.q") == c("b.q"))) | ((c("a.p") == c("b.q")) & (c("a.q") == c("b.p")))
    bad = pairs.filter(F.when(common, same).otherwise(G.segments_meet(of("a"), of("b"))))
    return bad.select(F.explode(F.array("a.id", "b.id")).alias("id")).distinct()


def simplify_shared(df: DataFrame, key: str, ring: str, tolerance: float, cell: float, out: str = "thin") -> DataFrame:
    """key and ``out``: rings thinned so that neighbours still share their borders: each arc is thinned once, for all.

    Arcs whose thinned lines cross, touch or cover one another are thinned less (a quarter of the tolerance, then not at
    all) until none do. ``cell`` should be near the length of a thinned side. Rings of under three points come out as they
    are; ``key`` has one row a value."""
    parts = written(arcs_of(df, key, ring), "simplify-arcs")
    arcs = parts.groupBy("id").agg(F.first("arc").alias("arc"))
    lines = written(arcs.select("id", "arc", F.lit(float(tolerance)).alias("t")).withColumn("line", _thinned("arc", "t")), "simplify-lines")
    while True:
        bad = written(_conflicts(lines, cell).join(lines.filter("t > 0").select("id"), "id", "left_semi").withColumn("bad", F.lit(True)), "simplify-bad")
        if bad.isEmpty():
            break
        less = F.when(F.col("bad") & (F.col("t") == tolerance), F.lit(tolerance / 4)).when(F.col("bad"), F.lit(0.0)).otherwise(F.col("t"))
        again = lines.join(bad, "id", "left").withColumn("u", less)
        again = again.select("id", "arc", F.col("u").alias("t"), F.when(F.col("bad") & (F.col("u") == 0), F.col("arc")).when(F.col("bad"), _thinned("arc", "u")).otherwise(F.col("line")).alias("line"))
        again = written(again, "simplify-lines")
        deleted(lines, bad)
        lines = again
    deleted(bad)
    # The last point of an arc is the first of the next.
    way = F.when(F.col("forward"), F.col("line")).otherwise(F.reverse("line"))
    open_way = F.slice(way, F.lit(1), F.size(way) - 1)
    made = parts.join(lines.select("id", "line"), "id").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("j", open_way.alias("w")))).alias("ways"))
    rings = made.select("k", F.flatten(F.transform("ways", lambda s: s["w"])).alias(out))
    return df.select(F.col(key).alias("k"), F.col(ring).alias("__r")).join(rings, "k", "left").select(F.col("k").alias(key), F.coalesce(out, "__r").alias(out))
