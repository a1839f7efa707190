"""Windowed reads of tiled GeoTIFF and BigTIFF files as pixel rows.

``read_tiles`` works in two phases: one task a file reads its header with a few ranged reads and
names the tiles that meet the window; then each tile is a row of its own, dealt over all tasks,
which read that tile's bytes and no others.  ``read_window`` serves stores that only Spark opens:
each file is one row (``binaryFile``, 2 GB at most).

Read are single-band tiled files of 8-bit or 16-bit samples, in either byte order, with deflate
or no compression, with or without horizontal differences (predictor 2).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Tags of the format.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "predictor": 317, "tile_width": 322, "tile_height": 323, "offsets": 324, "counts": 325, "scale": 33550, "tie": 33922}
SIZES = {1: "B", 3: "H", 4: "I", 12: "d", 16: "Q"}
#: Bytes that a header is read by.
CHUNK = 16_384
TILE = "path string, i long, j long, first long, size long, width long, height long, tile_width long, tile_height long, bits int, compression int, predictor int, order string, r0 long, r1 long, c0 long, c1 long, header_bytes long"
PIXELS = "path string, r long, c long, value int"


@dataclass
class Header:
    width: int
    height: int
    bits: int
    compression: int
    tile_width: int
    tile_height: int
    offsets: tuple
    counts: tuple
    affine: tuple[float, ...]
    predictor: int = 1
    order: str = "<"

    def window(self, box: tuple[float, float, float, float], buffer: int = 1) -> tuple[int, int, int, int]:
        """Rows and columns (first, one past the last) of a box in the file's coordinates, with ``buffer`` pixels around."""
        a, _, c, _, e, f = self.affine
        cols, rows = sorted(((box[0] - c) / a, (box[2] - c) / a)), sorted(((box[1] - f) / e, (box[3] - f) / e))
        low = lambda x: int(np.floor(round(x, 6))) - buffer
        high = lambda x: int(np.ceil(round(x, 6))) + buffer
        return max(0, low(rows[0])), min(self.height, high(rows[1])), max(0, low(cols[0])), min(self.width, high(cols[1]))


def parsed_header(read: Callable[[int, int], bytes]) -> Header:
    """The first directory of a file of which ``read(offset, bytes)`` gives parts."""
    start = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    kind = struct.unpack(f"{order}H", start[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    word, entry, head = ("Q", 20, 8) if big else ("I", 12, 2)
    inner = 8 if big else 4
    at = struct.unpack(f"{order}{word}", start[8:16] if big else start[4:8])[0]
    (n,) = struct.unpack(f"{order}{'Q' if big else 'H'}", read(at, head))
    body, found = read(at + head, n * entry), {}
    for k in range(n):
        tag, type_, count = struct.unpack_from(f"{order}HH{word}", body, k * entry)
        if type_ in SIZES:
            form = f"{order}{count}{SIZES[type_]}"
            size, place = struct.calcsize(form), k * entry + 4 + inner
            raw = body[place : place + size] if size <= inner else read(struct.unpack_from(f"{order}{word}", body, place)[0], size)
            found[tag] = struct.unpack(form, raw)
    one = lambda name, default=None: found.get(TAGS[name], (default,))[0]
    if one("tile_width") is None:
        raise ValueError("not a tiled file")
    scale, tie = found.get(TAGS["scale"], (1.0, 1.0, 0.0)), found.get(TAGS["tie"], (0.0,) * 6)
    affine = (scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1])
    return Header(one("width"), one("height"), one("bits", 16), one("compression", 1), one("tile_width"), one("tile_height"), found[TAGS["offsets"]], found[TAGS["counts"]], affine, one("predictor", 1), order)


def header(raw: bytes) -> Header:
    return parsed_header(lambda at, n: raw[at : at + n])


def unpacked(data: bytes, height: int, width: int, bits: int, compression: int, predictor: int, order: str) -> np.ndarray:
    """The samples of a tile's bytes."""
    if compression in (8, 32946):
        data = zlib.decompress(data)
    elif compression != 1:
        raise ValueError(f"compression {compression}")
    if bits not in (8, 16):
        raise ValueError(f"{bits} bits")
    out = np.frombuffer(data, f"{order}u2" if bits == 16 else "u1").reshape(height, width)
    if predictor == 2:
        out = np.cumsum(out, axis=1, dtype=np.uint16 if bits == 16 else np.uint8)
    elif predictor != 1:
        raise ValueError(f"predictor {predictor}")
    return out


def tile(raw: bytes, h: Header, k: int) -> np.ndarray:
    return unpacked(raw[h.offsets[k] : h.offsets[k] + h.counts[k]], h.tile_height, h.tile_width, h.bits, h.compression, h.predictor, h.order)


class Ranged:
    """A file read in parts: the chunks of its beginning once, anything else as asked."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        self.file, self.taken, self.start = store.open_input_file(at), 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        if at + n <= CHUNK:
            if not self.start:
                self.start = self.file.read_at(CHUNK, 0)
                self.taken += len(self.start)
            return self.start[at : at + n]
        self.taken += n
        return self.file.read_at(n, at)


def tiles_of(files: DataFrame, box: tuple[float, float, float, float] | None = None, buffer: int = 1) -> DataFrame:
    """The first phase: a row for each tile of each file (``path``) that meets the box, with where its bytes lie and the rows and columns wanted of the file."""
    names = [c.split()[0] for c in TILE.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                read = Ranged(path)
                h = parsed_header(read)
                r0, r1, c0, c1 = h.window(box, buffer) if box else (0, h.height, 0, h.width)
                across = -(-h.width // h.tile_width)
                for i in range(r0 // h.tile_height, -(-r1 // h.tile_height) if r1 > r0 and c1 > c0 else 0):
                    for j in range(c0 // h.tile_width, -(-c1 // h.tile_width)):
                        k = i * across + j
                        out.append((path, i, j, h.offsets[k], h.counts[k], h.width, h.height, h.tile_width, h.tile_height, h.bits, h.compression, h.predictor, h.order, r0, r1, c0, c1, read.taken))
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=schema)

    schema = to_arrow_schema(StructType.fromDDL(TILE))
    return files.select("path").mapInArrow(run, TILE)


def read_tiles(tiles: DataFrame) -> DataFrame:
    """The second phase: path, r, c, value of the tiles' pixels in the window; each task reads the bytes of its tiles alone.  A tile of no bytes has none."""

    def run(batches):
        for batch in batches:
            for t in batch.to_pylist():
                if not t["size"]:
                    continue
                read = Ranged(t["path"])
                y, x = t["i"] * t["tile_height"], t["j"] * t["tile_width"]
                values = unpacked(read.file.read_at(t["size"], t["first"]), t["tile_height"], t["tile_width"], t["bits"], t["compression"], t["predictor"], t["order"])
                part = values[max(t["r0"] - y, 0) : t["r1"] - y, max(t["c0"] - x, 0) : t["c1"] - x]
                rows, cols = np.mgrid[max(t["r0"], y) : max(t["r0"], y) + part.shape[0], max(t["c0"], x) : max(t["c0"], x) + part.shape[1]]
                yield pa.RecordBatch.from_pydict({"path": pa.array([t["path"]] * part.size), "r": pa.array(rows.ravel(), pa.int64()), "c": pa.array(cols.ravel(), pa.int64()), "value": pa.array(part.ravel().astype(np.int32))})

    dealt = tiles.repartition("path", "i", "j")
    return dealt.mapInArrow(run, PIXELS)


def pixels(raw: bytes, box: tuple[float, float, float, float] | None, buffer: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, values) of each tile in the window."""
    h = header(raw)
    r0, r1, c0, c1 = h.window(box, buffer) if box else (0, h.height, 0, h.width)
    across = -(-h.width // h.tile_width)
    for i in range(r0 // h.tile_height, -(-r1 // h.tile_height)):
        for j in range(c0 // h.tile_width, -(-c1 // h.tile_width)):
            y, x = i * h.tile_height, j * h.tile_width
            part = tile(raw, h, i * across + j)[max(r0 - y, 0) : r1 - y, max(c0 - x, 0) : c1 - x]
            rows, cols = np.mgrid[max(r0, y) : max(r0, y) + part.shape[0], max(c0, x) : max(c0, x) + part.shape[1]]
            yield rows.ravel(), cols.ravel(), part.ravel()


def read_window(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, buffer: int = 1) -> DataFrame:
    """path, r, c, value of the files' pixels in the box."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for r, c, v in pixels(raw.as_py(), box, buffer):
                    yield pa.RecordBatch.from_pydict({"path": pa.array([name] * len(r)), "r": pa.array(r, pa.int64()), "c": pa.array(c, pa.int64()), "value": pa.array(v, pa.int32())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PIXELS)


def write_tiff(values: np.ndarray, size: int = 16, affine: tuple[float, ...] = (10.0, 0.0, 0.0, 0.0, -10.0, 0.0), deflate: bool = True, big: bool = False, predictor: int = 1, order: str = "<") -> bytes:
    """A tiled file of a (height, width) array of 16-bit or 8-bit samples."""
    height, width = values.shape
    tiles = []
    for y in range(0, height, size):
        for x in range(0, width, size):
            t = np.zeros((size, size), values.dtype)
            part = values[y : y + size, x : x + size]
            t[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                t[:, 1:] = t[:, 1:] - t[:, :-1]
            raw = t.astype(t.dtype.newbyteorder(order)).tobytes()
            tiles.append(zlib.compress(raw) if deflate else raw)
    word, long_, inner, head = ("Q", 16, 8, 16) if big else ("I", 4, 4, 8)
    geo = {"scale": (affine[0], -affine[4], 0.0), "tie": (0.0, 0.0, 0.0, affine[2], affine[5], 0.0)}
    short = {"width": (4, width), "height": (4, height), "bits": (3, values.dtype.itemsize * 8), "compression": (3, 8 if deflate else 1), "predictor": (3, predictor), "tile_width": (4, size), "tile_height": (4, size)}
    fields = {TAGS[k]: (kind, (v,)) for k, (kind, v) in short.items()} | {TAGS["offsets"]: (long_, (0,) * len(tiles)), TAGS["counts"]: (long_, tuple(map(len, tiles)))} | {TAGS[k]: (12, v) for k, v in geo.items()}
    at = head + (8 if big else 2) + len(fields) * (20 if big else 12) + inner
    spare, places = b"", {}
    for tag, (kind, v) in sorted(fields.items()):
        form = f"{order}{len(v)}{SIZES[kind]}"
        if struct.calcsize(form) > inner:
            places[tag] = at + len(spare)
            spare += bytes(struct.calcsize(form))
    starts = at + len(spare) + np.cumsum([0, *map(len, tiles)][:-1])
    fields[TAGS["offsets"]] = (long_, tuple(starts.tolist()))
    body, rest = b"", bytearray(spare)
    for tag, (kind, v) in sorted(fields.items()):
        raw = struct.pack(f"{order}{len(v)}{SIZES[kind]}", *v)
        if tag in places:
            rest[places[tag] - at : places[tag] - at + len(raw)] = raw
            raw = struct.pack(f"{order}{word}", places[tag])
        body += struct.pack(f"{order}HH{word}", tag, kind, len(v)) + raw.ljust(inner, b"\0")
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, 16) if big else struct.pack(f"{order}HI", 42, 8))
    return start + struct.pack(f"{order}{'Q' if big else 'H'}", len(fields)) + body + bytes(inner) + bytes(rest) + b"".join(tiles)


def harmonised(fine: DataFrame, coarse: DataFrame, key: str = "path", factor: int = 2) -> DataFrame:
    """A coarser scene mask on a finer grid, nearest; ``key`` names the scene of a pixel in both."""
    names = {"_r": F.floor(F.col("r") / factor), "_c": F.floor(F.col("c") / factor)}
    return fine.withColumns(names).join(coarse.select(key, F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("value").alias("scl")), [key, "_r", "_c"]).drop("_r", "_c")
