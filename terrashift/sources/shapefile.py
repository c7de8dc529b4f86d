"""Shapefile scan: polygons of a .shp with the attributes of the .dbf beside it.

A Python data source. Both files are read whole by one task: the format has no index that Spark could split by, and a
county's parcels are tens of megabytes. Convert to Parquet once for anything larger.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

POINTS = "array<array<struct<x: double, y: double>>>"


def shapes(data: bytes) -> Iterator[list[list[tuple[float, float]]] | None]:
    """Rings of each record; None for a record without a polygon."""
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        body = data[at + 8 : at + 8 + size]
        at += 8 + size
        if struct.unpack("<i", body[:4])[0] not in (5, 15, 25):
            yield None
            continue
        parts, points = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        flat = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
        yield [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]


def attributes(data: bytes) -> tuple[list[str], list[list[str | None]]]:
    """Field names and rows, all as trimmed strings; blank is None."""
    rows, head, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 13:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    out = []
    for k in range(rows):
        p, row = head + k * width + 1, []
        for _, size in fields:
            row.append(data[p : p + size].decode("latin-1").strip() or None)
            p += size
        out.append(row)
    return [f for f, _ in fields], out


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def read(self, partition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            rings = list(shapes(f.read()))
        with open(self.path[:-4] + ".dbf", "rb") as f:
            fields, rows = attributes(f.read())
        at = {f.lower(): i for i, f in enumerate(fields)}
        for row, ring in zip(rows, rings, strict=False):
            yield (*(row[at[n.lower()]] if n.lower() in at else None for n in self.names), ring)


class ShapefileSource(DataSource):
    """``spark.dataSource.register(ShapefileSource)``, then ``format("shapefile").option("columns", "A,B").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return ", ".join([*(f"`{n}` string" for n in self._names()), f"geometry {POINTS}"])

    def _names(self) -> list[str]:
        return [n for n in self.options.get("columns", "").split(",") if n]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._names())
