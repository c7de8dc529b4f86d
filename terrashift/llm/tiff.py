"""Media columns: TIFF files in a binary column, one row per page.

``read_tiff`` walks the chain of image directories, decodes stored, PackBits, LZW and deflate strips or tiles,
undoes the horizontal (8, 16 and 32 bit) and floating-point predictors and yields a row for each page. Samples of 1, 2
and 4 bits come out as a byte each; a reversed order of bits (fill order 2) is undone.
``write_tiff`` stores bytes as an 8-bit grey file of several pages.

Defined results: null or empty media give no page; a broken file gives the pages before the fault and then one row
whose ``error`` says what is wrong, never an exception; a directory chain that loops is an error of that kind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches, with_row

STORED, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
# Fixed values of the format: bytes of a field by its type.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I"}

PAGE = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("samples", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("compression", T.IntegerType()),
        T.StructField("predictor", T.IntegerType()),
        T.StructField("tiled", T.BooleanType()),
        T.StructField("pixels", T.BinaryType()),
        T.StructField("histogram", T.ArrayType(T.LongType())),
        T.StructField("error", T.StringType()),
    ]
)


# --- codecs ---------------------------------------------------------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, everything between them as literals of at most 128."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    lengths = np.diff(np.append(starts, len(a)))
    out, done = bytearray(), 0

    def literal(to: int) -> None:
        nonlocal done
        while done < to:
            n = min(128, to - done)
            out.append(n - 1)
            out.extend(data[done : done + n])
            done += n

    for k in np.flatnonzero(lengths >= 3).tolist():
        literal(int(starts[k]))
        left, value = int(lengths[k]), data[done]
        while left:
            n = min(128, left)
            out += bytes((257 - n, value)) if n > 1 else bytes((0, value))
            left -= n
        done = int(starts[k]) + int(lengths[k])
    literal(len(a))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i, end = [], 0, len(data)
    have = 0
    while i < end and have < size:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
            have += n + 1
        elif n > 128:
            if i + 1 >= end:
                break
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
            have += 257 - n
        else:
            i += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first; the code width grows one code early, and the table restarts at 4094 codes."""
    out, acc, held, width, size = bytearray(), 256, 9, 9, 258
    table: dict[int, int] = {}
    code = -1
    for b in data:
        if code < 0:
            code = b
            continue
        key = code << 8 | b
        known = table.get(key)
        if known is not None:
            code = known
            continue
        acc, held = acc << width | code, held + width
        if held >= 32:
            held -= 32
            out += (acc >> held).to_bytes(4, "big")
            acc &= (1 << held) - 1
        table[key] = size
        size += 1
        if size == 4094:
            acc, held, width, size = acc << width | 256, held + width, 9, 258
            table.clear()
        elif size == 1 << width:
            width += 1
        code = b
    if code >= 0:
        acc, held = acc << width | code, held + width
        size += 1
        if size == 1 << width and width < 12:
            width += 1
    acc, held = acc << width | 257, held + width
    spare = -held % 8
    return bytes(out) + (acc << spare).to_bytes((held + spare) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, have = first[:], [], 0
    acc = held = at = 0
    width, last, end = 9, None, len(data)
    while have < size:
        while held < width:
            if at >= end:
                return b"".join(out)
            acc, held, at = (acc << 32 | int.from_bytes(data[at : at + 4].ljust(4, b"\0"), "big")), held + 32, at + 4
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 256:
            table, width, last = first[:], 9, None
            continue
        if code == 257:
            break
        n = len(table)
        if last is None:
            entry = table[code]
        elif code < n:
            entry = table[code]
            table.append(last + entry[:1])
        elif code == n:
            entry = last + last[:1]
            table.append(entry)
        else:
            raise ValueError(f"LZW code {code} before it is defined")
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
        out.append(entry)
        have += len(entry)
        last = entry
    return b"".join(out)


def decompress(data: bytes, compression: int, size: int) -> bytes:
    if compression == STORED:
        out = data
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        # No more than the page needs, however much the stream would unfold to.
        out = zlib.decompressobj().decompress(data, size) if size else b""
    else:
        raise ValueError(f"compression {compression}")
    if len(out) < size:
        raise ValueError(f"{len(out)} bytes decoded of {size}")
    return out[:size]


_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def unpack_samples(a: np.ndarray, bits: int, samples: int) -> np.ndarray:
    """Rows of bytes with several samples each, the first in the highest bits, as rows of a byte a sample."""
    shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
    return ((a[:, :, None] >> shifts) & np.uint8((1 << bits) - 1)).reshape(len(a), -1)[:, :samples]


def undo_predictor(a: np.ndarray, predictor: int, samples: int, bits: int, order: str) -> np.ndarray:
    """``a``: rows of bytes as stored. Returns rows of bytes, samples in the file's byte order."""
    if predictor == 1:
        return a
    if predictor == 2 and bits in (8, 16, 32):
        kind = np.dtype(f"{order}u{bits // 8}")
        v = np.ascontiguousarray(a).view(kind).astype(kind.newbyteorder("="))
        v = v.reshape(len(a), -1, samples)
        v = np.add.accumulate(v, axis=1, dtype=v.dtype)
        return v.reshape(len(a), -1).astype(kind).view(np.uint8)
    if predictor == 3 and bits in (16, 32, 64):
        size = bits // 8
        v = np.add.accumulate(a.reshape(len(a), -1, samples), axis=1, dtype=np.uint8).reshape(len(a), size, -1)
        v = v.transpose(0, 2, 1)  # most significant byte first
        return np.ascontiguousarray(v if order == ">" else v[:, :, ::-1]).reshape(len(a), -1)
    raise ValueError(f"predictor {predictor} with {bits} bits")


# --- reading --------------------------------------------------------------------------------------------------------


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    """Byte order and fields of each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("the directory chain loops")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = TYPE_BYTES.get(kind, 0) * count
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if kind in TYPE_CODE:
                fields[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", data, where))
        yield order, fields
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def decode_page(data: bytes, order: str, f: dict[int, list]) -> dict:
    one = lambda tag, default: f.get(tag, [default])[0]
    width, height = one(256, 0), one(257, 0)
    samples, bits = one(277, 1), one(258, 1)
    compression, predictor, planar = one(259, 1), one(317, 1), one(284, 1)
    small = bits in (1, 2, 4)
    if (bits % 8 or not bits) and not small or not width or not height:
        raise ValueError(f"{width} x {height} with {bits} bits a sample")
    size, planes = max(bits // 8, 1), samples if planar == 2 else 1
    inner = samples // planes
    tiled = 322 in f
    if tiled:
        tw, th, offsets, counts = one(322, 0), one(323, 0), f[324], f[325]
    else:
        tw, th = width, min(one(278, height), height)
        offsets, counts = f[273], f[279]
    across, down = -(-width // tw), -(-height // th)
    if len(offsets) < across * down * planes:
        raise ValueError("strips or tiles are missing")
    out = np.zeros((planes, height, width * inner * size), np.uint8)
    for k in range(across * down * planes):
        plane, j = divmod(k, across * down)
        y, x = j // across * th, j % across * tw
        rows = th if tiled else min(th, height - y)
        raw = data[offsets[k] : offsets[k] + counts[k]]
        if one(266, 1) == 2:
            raw = raw.translate(_REVERSED)
        a = np.frombuffer(decompress(raw, compression, rows * (-(-tw * inner * bits // 8))), np.uint8).reshape(rows, -1)
        a = undo_predictor(a, predictor, inner, bits, order)
        if small:
            a = unpack_samples(a, bits, tw * inner)
        h, w = min(rows, height - y), min(tw, width - x) * inner * size
        out[plane, y : y + h, x * inner * size : x * inner * size + w] = a[:h, :w]
    if planes > 1:
        out = out.reshape(planes, height, width, size).transpose(1, 2, 0, 3)
    pixels = np.ascontiguousarray(out).reshape(-1)
    return {
        "width": width, "height": height, "samples": samples, "bits": bits, "compression": compression, "predictor": predictor, "tiled": tiled,
        "pixels": pixels.tobytes(), "histogram": np.bincount(pixels >> 4, minlength=16).tolist(), "error": None,
    }


def read_pages(data: bytes | None) -> list[dict]:
    pages: list[dict] = []
    if not data:
        return pages
    try:
        for order, fields in directories(data):
            pages.append({"page": len(pages)} | decode_page(data, order, fields))
    except (ValueError, KeyError, IndexError, struct.error, zlib.error, MemoryError) as e:
        pages.append({"page": len(pages)} | {k: None for k in PAGE.names if k != "page"} | {"error": f"{type(e).__name__}: {e}"[:200]})
    return pages


# --- writing --------------------------------------------------------------------------------------------------------

WIDTH = 64
SCHEMES = ((PACKBITS, 1, False), (LZW, 1, False), (DEFLATE, 2, True), (DEFLATE, 1, False))


def write_tiff(payload: bytes, rows_per_page: int = 256, rows_per_strip: int = 64) -> bytes:
    """``payload`` (a positive multiple of 64 bytes) as grey pages of 64 columns.

    Pages take PackBits strips, LZW strips, deflate tiles under a predictor and deflate strips by turns; which comes first,
    and the byte order, follow from the length alone, so equal payloads give equal files. Long payloads take higher
    pages, 64 at most.
    """
    rows = len(payload) // WIDTH
    high = max(rows_per_page, -(-rows // 64))
    order = "<" if rows % 2 else ">"
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for p, top in enumerate(range(0, rows, high)):
        a = np.frombuffer(payload[top * WIDTH : (top + high) * WIDTH], np.uint8).reshape(-1, WIDTH)
        compression, predictor, tiled = SCHEMES[(p + rows) % len(SCHEMES)]
        offsets, counts = [], []
        for y in range(0, len(a), rows_per_strip):
            block = a[y : y + rows_per_strip]
            if tiled and len(block) < rows_per_strip:
                block = np.vstack([block, np.zeros((rows_per_strip - len(block), WIDTH), np.uint8)])
            if predictor == 2:
                block = np.hstack([block[:, :1], np.diff(block, axis=1)])
            raw = block.tobytes()
            coded = packbits_encode(raw) if compression == PACKBITS else lzw_encode(raw) if compression == LZW else zlib.compress(raw, 1)
            offsets.append(len(out))
            counts.append(len(coded))
            out += coded
        n = len(offsets)
        fields = [(256, 4, [WIDTH]), (257, 4, [len(a)]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
        fields += [(322, 4, [WIDTH]), (323, 4, [rows_per_strip]), (324, 4, offsets), (325, 4, counts)] if tiled else [(273, 4, offsets), (278, 4, [rows_per_strip]), (279, 4, counts)]
        where = {}
        for tag in (273, 279, 324, 325):
            if n > 1 and any(t == tag for t, _, _ in fields):
                out += b"\0" * (len(out) % 2)
                where[tag] = len(out)
                out += struct.pack(f"{order}{n}I", *next(v for t, _, v in fields if t == tag))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields))
        for tag, kind, values in sorted(fields):
            out += struct.pack(order + "HHI", tag, kind, len(values))
            out += struct.pack(order + "I", where[tag]) if tag in where else struct.pack(order + ("I" if kind == 4 else "HH"), *values, *[0] * (kind == 3))
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


# --- DataFrames -----------------------------------------------------------------------------------------------------


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def with_pages(df: DataFrame, media: str = "media", out: str = "pages") -> DataFrame:
    """Adds ``out``, the array of the pages of the TIFF file in ``media``; other columns stay."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(PAGE))])
    names = [f.name for f in schema.fields[:-1]]
    kind = _arrow(T.ArrayType(PAGE))

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                column = pa.array([read_pages(m) for m in part.column(media).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), column], [*names, out])

    return df.mapInArrow(pages, schema)


def read_tiff(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of the files in ``media``: the other columns, then those of ``PAGE`` (a clashing name is replaced)."""
    taken = {media.lower(), *(n.lower() for n in PAGE.names)}
    keep = [c for c in df.columns if c.lower() not in taken]
    paged = with_pages(with_row(df, media=F.col(f"`{media}`")))
    return paged.select(*(F.col(f"row.`{c}`") for c in keep), F.inline("pages"))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: the text's UTF-8 bytes, padded with zeros, as a TIFF file. A null text is empty."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, media = [], []
            for text in b.column("text").to_pylist():
                raw = text or b""
                sizes.append(len(raw))
                media.append(write_tiff(raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


def op1_tiff(spark, sf_dir) -> DataFrame:
    """Every text stored as TIFF pages and read back; digests of what came back."""
    small_batches(spark)
    read = with_pages(store_texts(documents(spark, sf_dir)))
    payload = F.expr("aggregate(pages, cast('' as binary), (a, p) -> concat(a, p.pixels))")
    sums = F.expr("aggregate(pages, array_repeat(0L, 16), (a, p) -> zip_with(a, p.histogram, (x, y) -> x + y))")
    return read.select(
        "doc_id", "n_bytes", payload.alias("payload"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(",", F.transform(sums, lambda x: x.cast("string"))).alias("feature"), F.size("pages").cast("long").alias("n_pages"),
    ).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "n_pages",
    )
