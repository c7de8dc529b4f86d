"""Raster files, edges, components and held stages against plain Python."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThanOrEqual

from terrashift.functions import classify
from terrashift.operators import edges, graph, stages
from terrashift.sources import geotiff as G
from terrashift.sources import readers

PROFILE = "scene string, width int, height int, x0 double, y0 double, dx double, dy double, epsg int"


def image(h, w, seed):
    values = np.random.default_rng(seed).normal(0, 100, (h, w)).astype(np.float32)
    values[::7, ::5] = np.nan
    return values


def rows_of(scene, values):
    return [(scene, r, c, float(v)) for (r, c), v in np.ndenumerate(values)]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("rasters"))
    images = {"a": image(100, 130, 1), "b": image(33, 40, 2), "empty": np.full((20, 20), np.nan, np.float32)}
    pixels = spark.createDataFrame([x for s, v in images.items() for x in rows_of(s, v)], "scene string, row int, col int, value double")
    profile = spark.createDataFrame([("a", 130, 100, 500.0, 4400.0, 30.0, -30.0, 32613), ("b", 40, 33, -105.0, 40.0, 0.5, -0.25, 4326), ("empty", 20, 20, 0.0, 0.0, 1.0, 1.0, None)], PROFILE)
    found = {r.scene: r for r in G.write(pixels, profile, f"file://{folder}", tile=32).collect()}
    return folder, images, pixels, profile, found


def test_round_trip(spark, files):
    folder, images, _, _, found = files
    assert set(found) == {"a", "b", "empty"}
    for scene, values in images.items():
        got = np.full(values.shape, np.inf, np.float32)
        rows = G.read(spark, f"{folder}/{scene}.tif").collect()
        assert len(rows) == values.size
        for r in rows:
            got[r.row, r.col] = np.nan if r.value is None else r.value
        assert np.array_equal(got, values, equal_nan=True)
    r = G.read(spark, f"{folder}/a.tif").filter("row = 2 and col = 3").first()
    assert (r.x, r.y, r.band, r.scene) == (500 + 3.5 * 30, 4400 - 2.5 * 30, 1, "a")


def test_profiles(spark, files):
    rows = {r.scene: r for r in G.profiles(spark, files[0]).collect()}
    assert (rows["a"].width, rows["a"].height, rows["a"].dtype, rows["a"].epsg, rows["a"].tile_height) == (130, 100, "float32", 32613, 32)
    assert (rows["b"].x0, rows["b"].y0, rows["b"].dx, rows["b"].dy, rows["b"].epsg) == (-105.0, 40.0, 0.5, -0.25, 4326)
    assert rows["empty"].dy == 1.0 and rows["empty"].epsg is None and math.isnan(rows["a"].nodata)


def test_files_that_are_there_stay(spark, files):
    folder, _, pixels, profile, found = files
    assert G.write(pixels.withColumn("value", F.lit(1.0)), profile, folder, tile=32).count() == 0
    assert found["empty"].n_bytes < 1000
    more = spark.createDataFrame([("c", 2, 2, 0.0, 0.0, 1.0, -1.0, None)], PROFILE)
    twice = spark.createDataFrame([("c", 0, 0, 1.0), ("c", 0, 0, 3.0), ("c", 1, 1, float("nan"))], "scene string, row int, col int, value double")
    assert G.write(twice, profile.union(more), folder, tile=16).select("scene").collect() == [("c",)]
    assert sorted((r.row, r.col, r.value) for r in G.read(spark, f"{folder}/c.tif").filter("value is not null").collect()) == [(0, 0, 3.0)]


@pytest.mark.parametrize("row", [("d", 5, 0, 1.0), ("unknown", 0, 0, 1.0)])
def test_pixels_without_a_place_are_errors(spark, tmp_path, row):
    profile = spark.createDataFrame([("d", 2, 5, 0.0, 0.0, 1.0, -1.0, None)], PROFILE)
    with pytest.raises(Exception, match="beyond|no profile"):
        G.write(spark.createDataFrame([(row[0], row[1] + 40, row[2], row[3])], "scene string, row int, col int, value double"), profile, str(tmp_path), tile=16)
    assert not list(tmp_path.glob("*.tif"))


def bytes_for(folder, *filters):
    reader = G.GeoTiffReader({"path": f"{folder}/a.tif", "partitionBytes": "4096"})
    assert list(reader.pushFilters(list(filters))) == list(filters)
    parts = reader.partitions()
    n = sum(b.num_rows for p in parts for b in reader.read(p))
    return reader.fetched, len(parts), n


def test_bytes_fall_with_the_window(files):
    folder = files[0]
    everything, parts, n = bytes_for(folder)
    assert (parts, n) == (4 * 5, 100 * 130)
    some, parts, n = bytes_for(folder, GreaterThanOrEqual(("row",), 40), LessThanOrEqual(("row",), 50), EqualTo(("col",), 70))
    assert (parts, n) == (1, 11) and some < everything / 8
    by_map, parts, n = bytes_for(folder, GreaterThanOrEqual(("x",), 500 + 70 * 30), LessThanOrEqual(("x",), 500 + 72 * 30), GreaterThanOrEqual(("y",), 4400 - 50 * 30), LessThanOrEqual(("y",), 4400 - 40 * 30))
    assert parts == 1 and by_map == some and n <= 14 * 6
    assert bytes_for(folder, In(("row",), (3, 99)))[1] == 20 and bytes_for(folder, GreaterThanOrEqual(("row",), 100))[1:] == (0, 0)
    assert bytes_for(folder, EqualTo(("scene",), "other"))[:2] == (0, 0)


def test_window_counts_from_each_scene(spark, files):
    pixels = G.read(spark, f"{files[0]}/a.tif,{files[0]}/b.tif")
    assert "Python" in pixels.filter("row < 5")._jdf.queryExecution().executedPlan().toString()
    for scene, west, south, east, north in (("a", 620.0, 3000.0, 1000.0, 3500.0), ("b", -100.0, 35.0, -95.0, 38.0)):
        inside = [(r.row, r.col) for r in pixels.filter(f"scene = '{scene}'").collect() if west <= r.x <= east and south <= r.y <= north]
        got = G.window(pixels, west, south, east, north).filter(f"scene = '{scene}'").select("row", "col").collect()
        top, left = min(r for r, _ in inside), min(c for _, c in inside)
        assert sorted(map(tuple, got)) == sorted((r - top, c - left) for r, c in inside)
    one = readers.pixel_window(spark.createDataFrame([(0, 5, 5, 1.0, 1.0), (1, 9, 7, 1.0, 1.0)], "scene int, row int, col int, x double, y double"), 0, 0, 2, 2)
    assert sorted((r.row, r.col) for r in one.collect()) == [(0, 0), (4, 2)]


@pytest.mark.parametrize("predictor", [1, 3])
def test_tiles_unpack_to_what_was_packed(predictor):
    values = image(16, 32, 9)
    layout = G.Layout(32, 16, 1, "<f4", 16, 32, 1, G.DEFLATE, predictor)
    assert np.array_equal(G.decode_tile(G.encode_tile(values, predictor), layout)[:, :, 0], values, equal_nan=True)


def foreign(order, values, planar=1, predictor=1, compression=8, rows_per_strip=3):
    """A striped file of 16-bit integers in either byte order, put together here field by field."""
    h, w, bands = values.shape
    planes = [values] if planar == 1 else [values[:, :, b : b + 1] for b in range(bands)]
    strips = []
    for plane in planes:
        for r in range(0, h, rows_per_strip):
            part = plane[r : r + rows_per_strip].astype(np.int16)
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            data = part.astype(f"{order}i2").tobytes()
            strips.append(zlib.compress(data) if compression == 8 else data)
    entries = [(256, 3, [w]), (257, 3, [h]), (258, 3, [16] * bands), (259, 3, [compression]), (273, 4, None), (277, 3, [bands]), (278, 3, [rows_per_strip]), (279, 4, [len(s) for s in strips]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [2] * bands), (42113, 2, b"-9999\0")]
    body, at = b"", 8 + 2 + 12 * len(entries) + 4
    offsets, place = [], at
    for s in strips:
        offsets.append(place)
        place += len(s)
    out, extra = [], place
    for tag, kind, v in entries:
        v = offsets if v is None else v
        data = v if kind == 2 else struct.pack(f"{order}{len(v)}{'H' if kind == 3 else 'I'}", *v)
        if len(data) <= 4:
            out.append(struct.pack(f"{order}HHI", tag, kind, len(v)) + data.ljust(4, b"\0"))
        else:
            out.append(struct.pack(f"{order}HHII", tag, kind, len(v), extra + len(body)))
            body += data
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8) + struct.pack(f"{order}H", len(out)) + b"".join(out) + bytes(4)
    return head + b"".join(strips) + body


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("planar", [1, 2])
@pytest.mark.parametrize(("predictor", "compression"), [(1, 1), (1, 8), (2, 8)])
def test_files_of_others(spark, tmp_path, order, planar, predictor, compression):
    values = np.random.default_rng(3).integers(-3000, 3000, (10, 7, 2))
    values[4, 5, 1] = -9999
    (tmp_path / "x.tif").write_bytes(foreign(order, values, planar, predictor, compression))
    rows = G.read(spark, str(tmp_path / "x.tif"), bands=(2,)).collect()
    assert {(r.row, r.col): r.value for r in rows} == {(r, c): None if v == -9999 else float(v) for (r, c), v in np.ndenumerate(values[:, :, 1])}
    assert G.read(spark, str(tmp_path / "x.tif")).count() == 140


def test_large_files_have_long_offsets():
    sizes = np.full(70_000, 65_000)
    sizes[5] = 0
    head = G.header(64_000, 71_680, 256, sizes)
    layout = G.read_layout(lambda at, n: head[at : at + n])
    assert head[2] == 43 and layout.counts == tuple(sizes) and layout.offsets[5] == 0 and layout.offsets[-1] + 65_000 == len(head) + sizes.sum()


def test_bad_files_are_named(spark, tmp_path):
    (tmp_path / "bad.tif").write_bytes(b"not a raster")
    with pytest.raises(Exception, match="bad.tif"):
        G.read(spark, str(tmp_path)).count()


def test_a_tile_unpacks_to_its_size_at_most():
    layout = G.Layout(8, 8, 1, "<f4", 8, 8, 1, G.DEFLATE, 1)
    assert G.decode_tile(zlib.compress(bytes(50_000_000)), layout).shape == (8, 8, 1)


def plain_canny(v, low, high):
    h, w = v.shape
    at = lambda r, c: v[min(max(r, 0), h - 1), min(max(c, 0), w - 1)]
    gx = np.array([[sum(at(r + a, c + b) * b * (2 - abs(a)) for a in (-1, 0, 1) for b in (-1, 0, 1)) for c in range(w)] for r in range(h)])
    gy = np.array([[sum(at(r + a, c + b) * a * (2 - abs(b)) for a in (-1, 0, 1) for b in (-1, 0, 1)) for c in range(w)] for r in range(h)])
    m = np.pad(abs(gx) + abs(gy), 1)
    weak, todo = set(), []
    for r in range(h):
        for c in range(w):
            here, x, y = m[r + 1, c + 1], abs(gx[r, c]), abs(gy[r, c])
            near = lambda a, b: m[r + 1 + a, c + 1 + b]  # noqa: B023, E731
            if here <= low:
                continue
            angle = math.degrees(math.atan2(y, x))
            if angle < 22.5:
                top = here > near(0, -1) and here >= near(0, 1)
            elif angle > 67.5:
                top = here > near(-1, 0) and here >= near(1, 0)
            elif (gx[r, c] < 0) != (gy[r, c] < 0):
                top = here > near(-1, 1) and here > near(1, -1)
            else:
                top = here > near(-1, -1) and here > near(1, 1)
            if top:
                weak.add((r, c))
                if here > high:
                    todo.append((r, c))
    found = set(todo)
    while todo:
        r, c = todo.pop()
        new = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & weak - found
        found |= new
        todo += new
    return found


def test_edges(spark):
    r = np.random.default_rng(4)
    smooth = r.integers(0, 60, (30, 40)).astype(float)
    smooth[8:20, 10:30] += 120
    # A faint spiral that only its strong beginning makes an edge.
    spiral = np.zeros((81, 81))
    y = x = 40
    for step in range(1, 19):
        for dy, dx in ((0, 1), (1, 0)) if step % 2 else ((0, -1), (-1, 0)):
            for _ in range(4 * step):
                spiral[max(0, min(80, y)), max(0, min(80, x))] = 18
                y, x = y + dy, x + dx
    spiral[40, 40:43] = 200
    images = {1: smooth, 2: spiral, 3: np.full((5, 6), 9.0), 4: np.array([[0.0, 255.0, 0.0]]), 5: np.array([[3.0]])}
    pixels = spark.createDataFrame([(k, int(i), int(j), float(x)) for k, v in images.items() for (i, j), x in np.ndenumerate(v)], "scene int, row int, col int, value double")
    got = {}
    for p in edges.canny(pixels.repartition(4), "scene", 50, 150).collect():
        got.setdefault(p.scene, set()).add((p.row, p.col))
    for k, v in images.items():
        assert got.get(k, set()) == plain_canny(v, 50, 150), k
    assert len(got[2]) > 100


def test_components(spark):
    r = random.Random(6)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(120)] + [(700, i) for i in range(701, 790)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def plain_hold(rows):
    may, state, out = dict(classify.VALID_TRANSITIONS), None, []
    for n, stage in rows:
        bad = False
        if stage is not None:
            if stage not in may:
                bad = True
            elif state is None or stage in may[state]:
                state = stage
            else:
                bad = stage != state
        out.append((n, stage, state, bad))
    return out


@pytest.mark.parametrize("segment", [1, 3, 1024])
def test_held_stages(spark, segment):
    r = random.Random(segment)
    names = [a for a, _ in classify.VALID_TRANSITIONS] + [None, "unheard of"]
    series = {k: [(n, r.choice(names)) for n in range(r.choice((1, 2, 7, 40)))] for k in (1, 2, 3, 4, None)}
    rows = [(k, n, s, "x") for k, v in series.items() for n, s in v]
    r.shuffle(rows)
    df = stages.hold_monotone(spark.createDataFrame(rows, "k int, n int, stage string, rows string"), "k", ["n"], "stage", classify.VALID_TRANSITIONS, segment=segment)
    assert df.columns == ["k", "n", "stage", "rows", "held", "uncertain"]
    got = sorted(((x.k, x.n, x.stage, x.held, x.uncertain) for x in df.collect()), key=lambda x: (x[0] is None, x[0], x[1]))
    assert got == [(k, *x) for k in (1, 2, 3, 4, None) for x in plain_hold(series[k])]
