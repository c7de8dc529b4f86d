"""GeoTIFF rasters: a data source that fetches only the tiles a query needs, and a tiled writer.

``read`` gives a row per pixel. Bounds on row, col, x, y, band or path reach the source, so tiles outside are never
fetched; tiles are dealt to partitions by their decoded size, and a partition holds a tile at a time. Headers cost two or
three small range requests a file. ``write`` encodes tiles where Spark has grouped them and streams each scene's file,
header first, so no scene is ever held in memory.

Paths are URIs of any store that ``pyarrow.fs`` knows, or local ones where there is one machine.
"""

from __future__ import annotations

import fnmatch
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..staging import written

# Fixed values of the format: sizes and struct codes of field types, numbers of tags.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, TRANSFORMATION, GEO_KEYS, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
NONE, DEFLATE, OLD_DEFLATE = 1, 8, 32946
FORMATS = {1: "u", 2: "i", 3: "f"}

SCHEMA = "path string, scene string, band int, row int, col int, x double, y double, value float"
PROFILE = "path string, scene string, width int, height int, bands int, dtype string, x0 double, y0 double, dx double, dy double, epsg int, nodata double, tile_height int, tile_width int"
#: Decoded bytes that a partition gets before the next begins.
PARTITION_BYTES = 8 << 20


class Ranges:
    """Byte ranges of a file in any store; counts what it fetched."""

    def __init__(self, path: str):
        fs, at = _store(path)
        self.file, self.fetched = fs.open_input_file(at), 0

    def __call__(self, offset: int, size: int) -> bytes:
        data = self.file.read_at(size, offset)
        self.fetched += len(data)
        if len(data) < size:
            raise ValueError(f"the file ends within a range of {size} bytes at {offset}")
        return data


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """Files that ``path`` stands for: itself, the rasters of a folder, or the names that match its last part."""
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    fs, at = _store(path)
    folder, name = os.path.split(at)
    if any(c in name for c in "*?["):
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, name)]
    elif fs.get_file_info(at).type == pafs.FileType.Directory:
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.type == pafs.FileType.File and f.extension.lower() in ("tif", "tiff") and not f.base_name.startswith(("_", "."))]
    else:
        return [path]
    return [scheme + f for f in sorted(found)]


def scene_of(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


@dataclass
class Layout:
    """What a header says of the first image."""

    width: int
    height: int
    bands: int
    dtype: str
    tile_height: int
    tile_width: int
    planar: int
    compression: int
    predictor: int
    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = 1.0
    upright: bool = True
    epsg: int | None = None
    nodata: float | None = None
    offsets: tuple[int, ...] = field(default=(), repr=False)
    counts: tuple[int, ...] = field(default=(), repr=False)

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.height // self.tile_height), -(-self.width // self.tile_width)

    def tile_of(self, band: int, row: int, col: int) -> int:
        """Number of the tile at a place of the grid."""
        rows, cols = self.grid
        return (band * rows * cols if self.planar == 2 else 0) + row * cols + col


def read_layout(fetch) -> Layout:
    """``fetch(offset, size)`` gives the bytes of a range."""
    head = fetch(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(order + "Q", fetch(8, 8))[0] if big else struct.unpack(order + "I", head[4:])[0]
    size, entry, word = (8, 20, "Q") if big else (2, 12, "I")
    n = struct.unpack(order + ("Q" if big else "H"), fetch(at, size))[0]
    entries, inline = fetch(at + size, n * entry), struct.calcsize(word)
    tags: dict[int, tuple] = {}
    for i in range(n):
        raw = entries[i * entry : (i + 1) * entry]
        tag, kind = struct.unpack(order + "HH", raw[:4])
        count = struct.unpack(order + word, raw[4 : 4 + inline])[0]
        code = TYPES.get(kind)
        if code is None:
            continue
        total = struct.calcsize(code) * count
        value = raw[4 + inline :][:total] if total <= inline else fetch(struct.unpack(order + word, raw[4 + inline :])[0], total)
        tags[tag] = (value.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{count}{code}", value)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, bands, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), tags.get(BITS, (1,))
    if len(set(bits)) > 1 or bits[0] not in (8, 16, 32, 64) or one(COMPRESSION, 1) not in (NONE, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"samples of {bits} bits with compression {one(COMPRESSION, 1)} are not read here")
    tiled = TILE_OFFSETS in tags
    layout = Layout(
        width, height, bands, order + FORMATS.get(one(SAMPLE_FORMAT, 1), "u") + str(bits[0] // 8), one(TILE_HEIGHT) if tiled else min(one(ROWS_PER_STRIP, height), height), one(TILE_WIDTH) if tiled else width, one(PLANAR, 1), one(COMPRESSION, 1), one(PREDICTOR, 1),
        offsets=tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], counts=tags[TILE_COUNTS if tiled else STRIP_COUNTS],
    )
    if TRANSFORMATION in tags:
        m = tags[TRANSFORMATION]
        layout = replace(layout, x0=m[3], y0=m[7], dx=m[0], dy=m[5], upright=not m[1] and not m[4])
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[PIXEL_SCALE], tags[TIE_POINT]
        layout = replace(layout, x0=x - i * sx, y0=y + j * sy, dx=sx, dy=-sy)
    keys = tags.get(GEO_KEYS, ())
    known = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    try:
        nodata = float(one(NO_DATA)) if NO_DATA in tags else None
    except ValueError:
        nodata = None
    return replace(layout, epsg=known.get(3072, known.get(2048)), nodata=nodata)


def decode_tile(raw: bytes, layout: Layout) -> np.ndarray:
    """Samples of a tile, rows by columns by bands. What a tile unpacks to is bounded by its size in the header."""
    kind, samples = np.dtype(layout.dtype), layout.bands if layout.planar == 1 else 1
    h, w = layout.tile_height, layout.tile_width
    size = h * w * samples * kind.itemsize
    if layout.compression != NONE:
        raw = zlib.decompressobj().decompress(raw, size)
    if len(raw) < size:  # the last strip of an image may be shorter
        h = len(raw) // (w * samples * kind.itemsize)
        size = h * w * samples * kind.itemsize
    data = np.frombuffer(raw, np.uint8, size)
    if layout.predictor == 3:
        summed = np.cumsum(data.reshape(h, w * kind.itemsize, samples), axis=1, dtype=np.uint8)
        planes = summed.reshape(h, kind.itemsize, w * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(kind.newbyteorder(">")).reshape(h, w, samples)
    values = data.view(kind).reshape(h, w, samples)
    return np.cumsum(values, axis=1, dtype=kind.newbyteorder("=")) if layout.predictor == 2 else values


def encode_tile(values: np.ndarray, predictor: int = 3) -> bytes:
    """A tile of one band of little-endian 32-bit floats, deflated."""
    h, w = values.shape
    if predictor == 3:
        planes = values.astype(">f4").view(np.uint8).reshape(h, w, 4).transpose(0, 2, 1).reshape(h, 4 * w)
        data = planes.copy()
        data[:, 1:] -= planes[:, :-1]
    else:
        data = values.astype("<f4")
    return zlib.compress(data.tobytes(), 6)


def header(width: int, height: int, tile: int, sizes: np.ndarray, transform: tuple[float, float, float, float] = (0.0, 0.0, 1.0, -1.0), epsg: int | None = None, predictor: int = 3, nodata: float = math.nan) -> bytes:
    """Header of a file of 32-bit floats whose tiles, of ``sizes`` bytes, follow in order; 0 bytes: no tile. Files that
    may pass 4 GB get 64-bit offsets."""
    x0, y0, dx, dy = transform
    big = int(sizes.sum()) + 40 * len(sizes) + 4096 >= 1 << 32
    long = "Q" if big else "I"
    text = b"nan\0" if math.isnan(nodata) else repr(nodata).encode() + b"\0"
    fields: dict[int, tuple[int, int, bytes]] = {}

    def put(tag: int, kind: int, *values) -> None:
        fields[tag] = (kind, len(values), struct.pack(f"<{len(values)}{TYPES[kind]}", *values))

    for tag, value in ((WIDTH, width), (HEIGHT, height), (BITS, 32), (COMPRESSION, DEFLATE), (PHOTOMETRIC, 1), (SAMPLES, 1), (PLANAR, 1), (PREDICTOR, predictor), (TILE_WIDTH, tile), (TILE_HEIGHT, tile), (SAMPLE_FORMAT, 3)):
        put(tag, 4 if tag in (WIDTH, HEIGHT, TILE_WIDTH, TILE_HEIGHT) else 3, value)
    if dy < 0 < dx:
        put(PIXEL_SCALE, 12, dx, -dy, 0.0)
        put(TIE_POINT, 12, 0.0, 0.0, 0.0, x0, y0, 0.0)
    else:
        put(TRANSFORMATION, 12, dx, 0.0, 0.0, x0, 0.0, dy, 0.0, y0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    if epsg is not None:
        # Degrees for the geographic codes, metres on a plane for the others.
        degrees = 4000 <= epsg < 5000
        put(GEO_KEYS, 3, 1, 1, 0, 3, 1024, 0, 1, 2 if degrees else 1, 1025, 0, 1, 1, 2048 if degrees else 3072, 0, 1, epsg)
    fields[NO_DATA] = (2, len(text), text)
    offsets_kind, count_size = (16, 8) if big else (4, 4)
    fields[TILE_OFFSETS] = fields[TILE_COUNTS] = (offsets_kind, len(sizes), bytes(len(sizes) * count_size))
    start, entry = (16, 20) if big else (8, 12)
    extra = start + (8 if big else 2) + len(fields) * entry + count_size
    places = {}
    for tag in sorted(fields):
        if len(fields[tag][2]) > count_size:
            places[tag] = extra
            extra += len(fields[tag][2]) + len(fields[tag][2]) % 2
    ends = extra + np.cumsum(sizes)
    fields[TILE_COUNTS] = (offsets_kind, len(sizes), sizes.astype(f"<u{count_size}").tobytes())
    fields[TILE_OFFSETS] = (offsets_kind, len(sizes), np.where(sizes > 0, ends - sizes, 0).astype(f"<u{count_size}").tobytes())
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8))
    out += struct.pack("<Q" if big else "<H", len(fields))
    for tag in sorted(fields):
        kind, count, data = fields[tag]
        out += struct.pack("<HH" + long, tag, kind, count) + (struct.pack("<" + long, places[tag]) if tag in places else data.ljust(count_size, b"\0"))
    out += bytes(count_size)
    for tag in sorted(places):
        out += fields[tag][2] + bytes(len(fields[tag][2]) % 2)
    return bytes(out)


@dataclass
class Tiles(InputPartition):
    """Tiles of one band of one file: (first row, first column, offset, bytes) each."""

    path: str
    band: int
    layout: Layout
    tiles: list[tuple[int, int, int, int]]
    window: tuple[int, int, int, int]


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for given in options["path"].split(",") for p in listed(given)]
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}
        self.chosen: dict[str, set] = {}
        self.fetched = 0

    def pushFilters(self, filters):  # noqa: N802
        """Takes note of bounds; Spark still applies every filter to the rows."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("row", "col", "x", "y", "band"):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low.get(name, -math.inf), f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high.get(name, math.inf), f.value)
                if isinstance(f, In) and f.value:
                    self.low[name] = max(self.low.get(name, -math.inf), min(f.value))
                    self.high[name] = min(self.high.get(name, math.inf), max(f.value))
            elif name in ("path", "scene") and isinstance(f, (EqualTo, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.chosen[name] = self.chosen.get(name, values) & values
            yield f

    def window(self, layout: Layout) -> tuple[int, int, int, int]:
        """First and last row and column that the bounds leave."""
        row, col = [self.low.get("row", 0), self.high.get("row", layout.height - 1)], [self.low.get("col", 0), self.high.get("col", layout.width - 1)]
        if layout.upright:
            for name, at, step, span in (("y", layout.y0, layout.dy, row), ("x", layout.x0, layout.dx, col)):
                ends = sorted((v - at) / step - 0.5 for v in (self.low.get(name, -math.inf), self.high.get(name, math.inf)))
                # A centre on the bound counts, so a pixel more on either side.
                span[0], span[1] = max(span[0], ends[0] - 1), min(span[1], ends[1] + 1)
        first = lambda v: max(0, math.ceil(v)) if v > -math.inf else 0
        last = lambda v, n: min(n - 1, math.floor(v)) if v < math.inf else n - 1
        return first(row[0]), last(row[1], layout.height), first(col[0]), last(col[1], layout.width)

    def partitions(self) -> list[Tiles]:
        paths = [p for p in self.paths if p in self.chosen.get("path", (p,)) and scene_of(p) in self.chosen.get("scene", (scene_of(p),))]

        def layout_of(path: str) -> Layout:
            fetch = Ranges(path)
            try:
                return read_layout(fetch)
            except (ValueError, struct.error, KeyError) as e:
                raise ValueError(f"{path}: {e}") from e
            finally:
                self.fetched += fetch.fetched

        with ThreadPoolExecutor(16) as pool:
            layouts = list(pool.map(layout_of, paths))
        out: list[Tiles] = []
        for path, layout in zip(paths, layouts, strict=True):
            bands = [b for b in self.bands or range(1, layout.bands + 1) if 1 <= b <= layout.bands and self.low.get("band", b) <= b <= self.high.get("band", b)]
            window = top, bottom, left, right = self.window(layout)
            if top > bottom or left > right:
                continue
            h, w, small = layout.tile_height, layout.tile_width, replace(layout, offsets=(), counts=())
            most = max(1, self.partition_bytes // (h * w * np.dtype(layout.dtype).itemsize))
            for band in bands:
                tiles = []
                for r in range(top // h, bottom // h + 1):
                    for c in range(left // w, right // w + 1):
                        i = layout.tile_of(band - 1, r, c)
                        tiles.append((r * h, c * w, layout.offsets[i], layout.counts[i]))
                out += [Tiles(path, band, small, tiles[k : k + most], window) for k in range(0, len(tiles), most)]
        return out

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        layout, (top, bottom, left, right) = partition.layout, partition.window
        fetch, names = Ranges(partition.path), [c.split()[0] for c in SCHEMA.split(", ")]
        for row0, col0, offset, count in partition.tiles:
            r0, r1 = max(row0, top), min(row0 + layout.tile_height - 1, bottom)
            c0, c1 = max(col0, left), min(col0 + layout.tile_width - 1, right)
            if count:
                tile = decode_tile(fetch(offset, count), layout)[:, :, partition.band - 1 if layout.planar == 1 else 0]
                values = tile[r0 - row0 : r1 + 1 - row0, c0 - col0 : c1 + 1 - col0].astype(np.float32)
                missing = np.isnan(values) if layout.nodata is None or math.isnan(layout.nodata) else np.isnan(values) | (values == np.float32(layout.nodata))
            else:  # left out of the file
                values = np.zeros((r1 + 1 - r0, c1 + 1 - c0), np.float32)
                missing = np.ones(values.shape, bool)
            rows, cols = (g.ravel() for g in np.mgrid[r0 : r0 + values.shape[0], c0 : c0 + values.shape[1]])
            n, text = len(rows), lambda s: pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([s])).cast(pa.string())  # noqa: B023
            columns = [
                text(partition.path), text(scene_of(partition.path)), pa.array(np.full(n, partition.band, np.int32)), pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)),
                pa.array(layout.x0 + (cols + 0.5) * layout.dx), pa.array(layout.y0 + (rows + 0.5) * layout.dy), pa.array(values.ravel(), mask=missing.ravel()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
        self.fetched += fetch.fetched


class GeoTiffSource(DataSource):
    """Format ``geotiff``. Options: path (files, folders or patterns, with commas between), bands, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options)


def read(spark: SparkSession, path: str, bands: tuple[int, ...] = ()) -> DataFrame:
    """A row for each pixel of the rasters at ``path``; x and y are its centre, missing values are null."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)
    reader = spark.read.format("geotiff")
    return (reader.option("bands", ",".join(map(str, bands))) if bands else reader).load(path)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Sizes, type, place and tiling of the rasters at ``path``; headers are read in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in b.column("path").to_pylist():
                x = read_layout(Ranges(p))
                rows.append((p, scene_of(p), x.width, x.height, x.bands, np.dtype(x.dtype).name, x.x0, x.y0, x.dx, x.dy, x.epsg, x.nodata, x.tile_height, x.tile_width))
            names, kinds = zip(*(c.split() for c in PROFILE.split(", ")), strict=True)
            arrow = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    paths = listed(path)
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // 100))
    return files.mapInArrow(run, PROFILE)


def window(pixels: DataFrame, west: float, south: float, east: float, north: float, scene: str = "scene") -> DataFrame:
    """Pixels whose centres lie within inclusive bounds, rows and columns counted anew from each scene's own corner."""
    from .readers import pixel_window

    return pixel_window(pixels, west, south, east, north, (scene,))


def tiles(pixels: DataFrame, scene: str, tile: int, predictor: int = 3) -> DataFrame:
    """scene, ``tile_row``, ``tile_col``, ``data`` of pixel rows (scene, row, col, value): a tile's bytes where it has a
    value. Of repeated pixels the largest value counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = []
            for cells in b.column("cells"):
                values = np.full(tile * tile, np.nan, np.float32)
                values[cells.values.field("at").to_numpy()] = cells.values.field("value").to_numpy()
                data.append(encode_tile(values.reshape(tile, tile), predictor))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("scene", "tile_row", "tile_col")), pa.array(data, pa.binary())], ["scene", "tile_row", "tile_col", "data"])

    cut = lambda c: F.floor(F.col(c) / tile).cast("int")
    at = ((F.col("row") % tile) * tile + F.col("col") % tile).cast("int")
    placed = pixels.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(F.col(scene).cast("string").alias("scene"), cut("row").alias("tile_row"), cut("col").alias("tile_col"), at.alias("at"), F.col("value").cast("float").alias("value"))
    once = placed.groupBy("scene", "tile_row", "tile_col", "at").agg(F.max("value").alias("value"))
    grouped = once.groupBy("scene", "tile_row", "tile_col").agg(F.collect_list(F.struct("at", "value")).alias("cells"))
    return grouped.mapInArrow(run, "scene string, tile_row int, tile_col int, data binary")


def write(pixels: DataFrame, profile: DataFrame, folder: str, scene: str = "scene", tile: int = 256, predictor: int = 3) -> DataFrame:
    """Writes ``folder``/scene.tif for each scene of ``profile`` (scene, width, height, x0, y0, dx, dy, epsg) that isn't
    there yet: 32-bit floats, deflated, tiled, geo tags. Pixels outside the size are an error, missing ones are nodata,
    and tiles without a value take no room. Returns (scene, path, n_bytes) of what was written.

    A file is streamed by one task from tiles in order and gets its name when it is whole, so an attempt that fails or
    runs twice leaves nothing half done."""
    if tile % 16:
        raise ValueError("tiles have multiples of 16 rows and columns")
    fs, at = _store(folder)
    fs.create_dir(at, recursive=True)
    there = [scene_of(p) for p in listed(folder)]
    spark = pixels.sparkSession
    todo = profile.select(F.col(scene).cast("string").alias("scene"), "width", "height", "x0", "y0", "dx", "dy", "epsg")
    if there:
        todo = todo.join(spark.createDataFrame([(s,) for s in there], "scene string"), "scene", "left_anti")
        pixels = pixels.join(todo.select(F.col("scene").alias("__s")), F.col(scene).cast("string") == F.col("__s"), "left_semi")
    encoded = written(tiles(pixels, scene, tile, predictor), "geotiff-tiles")
    numbers = encoded.select("scene", F.struct("tile_row", "tile_col", F.length("data").alias("size")).alias("t")).groupBy("scene").agg(F.collect_list("t").alias("sizes"))
    heads = todo.join(numbers, "scene", "left").withColumn("tile_row", F.lit(-1)).withColumn("tile_col", F.lit(-1))
    kinds = {"scene": "string", "tile_row": "int", "tile_col": "int", "data": "binary", "width": "int", "height": "int", "x0": "double", "y0": "double", "dx": "double", "dy": "double", "epsg": "int", "sizes": "array<struct<tile_row:int,tile_col:int,size:int>>"}
    shaped = lambda df: df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))
    ordered = shaped(heads).unionByName(shaped(encoded)).repartition("scene").sortWithinPartitions("scene", "tile_row", "tile_col")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _store(folder)
        now, out, part, size = None, None, "", 0

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                fs.move(part, f"{at}/{now}.tif")
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([f"{folder}/{now}.tif"]), pa.array([size], pa.int64())], ["scene", "path", "n_bytes"])

        for b in batches:
            for row in b.to_pylist():
                if row["tile_row"] == -1:
                    yield from close()
                    now, part = row["scene"], f"{at}/_{row['scene']}.{uuid.uuid4().hex}"
                    down, across = -(-row["height"] // tile), -(-row["width"] // tile)
                    sizes = np.zeros(down * across, np.int64)
                    for t in row["sizes"] or ():
                        if not (0 <= t["tile_row"] < down and 0 <= t["tile_col"] < across):
                            raise ValueError(f"{now} has pixels beyond {row['height']} x {row['width']}")
                        sizes[t["tile_row"] * across + t["tile_col"]] = t["size"]
                    first = header(row["width"], row["height"], tile, sizes, (row["x0"], row["y0"], row["dx"], row["dy"]), row["epsg"], predictor)
                    out, size = fs.open_output_stream(part), len(first)
                    out.write(first)
                elif row["scene"] == now:
                    out.write(row["data"])
                    size += len(row["data"])
                else:
                    raise ValueError(f"{row['scene']} has pixels and no profile")
        yield from close()

    return written(ordered.mapInArrow(run, "scene string, path string, n_bytes long"), "geotiff-files")
