"""Writing surfaces: sparse Parquet rasters with metadata, calibration documents, GeoTIFF."""

from __future__ import annotations

import json
import math
import struct
import zlib
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.shipping import ship
from gridloom.spec import NODATA


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def plain(value):
    """Numbers that JSON lacks become null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """One small JSON file, through the file system that Spark uses."""
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(plain(document), indent=2).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.sparkContext.wholeTextFiles(path, 1).values().first())


def write_raster(raster: DataFrame, path: str, metadata: dict, codec: str = "zstd", tile: int = 512) -> str:
    """Parquet of (row, col, bands), the pixels of a square tile together, written aside and then renamed, with ``<path>.json``.

    A failed write leaves what was there before untouched.  The old raster is renamed to
    ``<path>.old`` and goes only when the new one is in place; if that fails it comes back.
    """
    down, across = F.expr(f"row div {tile}"), F.expr(f"col div {tile}")
    return _replace(raster.repartition(down, across).sortWithinPartitions(down, across, "row", "col"), path, metadata, codec)


def _replace(rows: DataFrame, path: str, metadata: dict, codec: str) -> str:
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("compression", codec.lower()).parquet(f"{path}.tmp")
    fs, p = _path(spark, path)
    (_, tmp), (_, old) = _path(spark, f"{path}.tmp"), _path(spark, f"{path}.old")
    before = fs.exists(p)
    if before:
        fs.delete(old, True)
        if not fs.rename(p, old):
            raise OSError(f"cannot move {path} aside")
    if not fs.rename(tmp, p):
        if before and not fs.rename(old, p):
            raise OSError(f"cannot put the new raster in place; the old one is {path}.old")
        raise OSError(f"cannot move {path}.tmp to {path}")
    write_json(spark, metadata, f"{path}.json")
    fs.delete(old, True)
    return path


#: Fixed values of TIFF: sizes and letters of the field types text, short, long, double and long8.
TEXT, SHORT, LONG, DOUBLE, LONG8 = 2, 3, 4, 12, 16
KINDS = {SHORT: "H", LONG: "I", DOUBLE: "d", LONG8: "Q"}


def _directory(entries: list[tuple[int, int, list | bytes]], at: int, big: bool) -> bytes:
    """An image file directory that begins at byte ``at``, with its longer values behind it."""
    head, size, word = ("<Q", 20, 8) if big else ("<H", 12, 4)
    behind = at + struct.calcsize(head) + size * len(entries) + word
    table, values = b"", b""
    for tag, kind, value in entries:
        raw = value if kind == TEXT else struct.pack(f"<{len(value)}{KINDS[kind]}", *value)
        if len(raw) > word:
            place, raw = behind + len(values), raw + b"\0" * (-len(raw) % 8)
            values += raw
            raw = struct.pack("<Q" if big else "<I", place)
        table += struct.pack("<HHQ" if big else "<HHI", tag, kind, len(value)) + raw.ljust(word, b"\0")
    return struct.pack(head, len(entries)) + table + b"\0" * word + values


def write_geotiff(raster: DataFrame, band: str, rows: int, cols: int, left: float, top: float, pixel: float, epsg: int, path: str, tags: dict[str, str] | None = None, scale: float | None = None, tile: int = 512, big: bool | None = None) -> str:
    """One band as a GeoTIFF; see write_geotiffs."""
    return write_geotiffs(raster, {band: (path, tags or {}, scale)}, rows, cols, left, top, pixel, epsg, tile, big)[0]


def packed_tiles(raster: DataFrame, bands: list[str], cols: int, tile: int) -> DataFrame:
    """(number, d0, d1, ...): the compressed pixels of each tile with data, band by band."""
    number = (F.expr(f"row div {tile}") * -(-cols // tile) + F.expr(f"col div {tile}")).cast("long").alias("number")
    pixels = raster.select("row", "col", *(F.col(b).cast("short").alias(f"b{k}") for k, b in enumerate(bands)), number)

    def pack(table: pa.Table) -> pa.Table:
        at = table["row"].to_numpy() % tile, table["col"].to_numpy() % tile
        out = {"number": table["number"][:1]}
        for k in range(len(bands)):
            grid = np.full((tile, tile), NODATA, "<i2")
            grid[at] = pc.fill_null(table[f"b{k}"], NODATA).to_numpy()
            out[f"d{k}"] = pa.array([zlib.compress(grid.tobytes(), 6)], pa.binary())
        return pa.table(out)

    spark = raster.sparkSession
    ship(spark)
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return pixels.repartition(most, "number").groupBy("number").applyInArrow(pack, "number long, " + ", ".join(f"d{k} binary" for k in range(len(bands))))


def unpacked_tiles(tiles: DataFrame, bands: list[str], cols: int, tile: int) -> DataFrame:
    """(row, col, bands) of the pixels that have data in any band; a band without is null."""
    across = -(-cols // tile)
    schema = pa.schema([("row", pa.int32()), ("col", pa.int32()), *((b, pa.int16()) for b in bands)])

    def unpack(batches):
        for batch in batches:
            for k, number in enumerate(batch.column(0).to_pylist()):
                grids = [np.frombuffer(zlib.decompress(batch.column(j + 1)[k].as_py()), "<i2") for j in range(len(bands))]
                at = np.flatnonzero(np.any([g != NODATA for g in grids], axis=0))
                row, col = (number // across) * tile + at // tile, (number % across) * tile + at % tile
                values = [pa.array(g[at], pa.int16(), mask=g[at] == NODATA) for g in grids]
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(col, pa.int32()), *values], schema=schema)

    ship(tiles.sparkSession)
    return tiles.mapInArrow(unpack, "row int, col int, " + ", ".join(f"`{b}` short" for b in bands))


def write_tiled(raster: DataFrame, path: str, metadata: dict, codec: str, files: dict[str, tuple[str, dict, float | None]], rows: int, cols: int, left: float, top: float, pixel: float, epsg: int, tile: int = 512) -> str:
    """A raster as write_raster leaves it and GeoTIFFs of some bands; pixels are shuffled once, for both."""
    spark = raster.sparkSession
    bands = [c for c in raster.columns if c not in ("row", "col")]
    fs, aside = _path(spark, f"{path}.tiles")
    packed = packed_tiles(raster, bands, cols, tile)
    packed.write.mode("overwrite").parquet(f"{path}.tiles")
    try:
        tiles = spark.read.schema(packed.schema).parquet(f"{path}.tiles")
        _replace(unpacked_tiles(tiles, bands, cols, tile), path, metadata, codec)
        for b, (name, tags, scale) in files.items():
            _write_tiles(spark, tiles.select("number", F.col(f"d{bands.index(b)}").alias("data")), name, rows, cols, left, top, pixel, epsg, tags, scale, tile, None)
    finally:
        fs.delete(aside, True)
    return path


def write_geotiffs(raster: DataFrame, files: dict[str, tuple[str, dict, float | None]], rows: int, cols: int, left: float, top: float, pixel: float, epsg: int, tile: int = 512, big: bool | None = None) -> list[str]:
    """Tiled, deflated int16 GeoTIFFs of some bands, through the file system that Spark uses.

    ``files``: path, tags and scale by band; a scale becomes the band's factor.  Executors
    fill and compress the tiles of all bands in one pass over the pixels; the driver knows
    their sizes and passes them on one at a time, in order.  Tiles without data share one
    empty tile.  Files of 4 GB or more are written as BigTIFF (``big`` forces either).
    """
    spark = raster.sparkSession
    bands = list(files)
    first = files[bands[0]][0]
    fs, aside = _path(spark, f"{first}.tiles")
    packed = packed_tiles(raster, bands, cols, tile)
    packed.write.mode("overwrite").parquet(f"{first}.tiles")
    try:
        tiles = spark.read.schema(packed.schema).parquet(f"{first}.tiles")
        for k, b in enumerate(bands):
            path, tags, scale = files[b]
            _write_tiles(spark, tiles.select("number", F.col(f"d{k}").alias("data")), path, rows, cols, left, top, pixel, epsg, tags, scale, tile, big)
    finally:
        fs.delete(aside, True)
    return [f[0] for f in files.values()]


def _write_tiles(spark: SparkSession, tiles: DataFrame, path: str, rows: int, cols: int, left: float, top: float, pixel: float, epsg: int, tags: dict, scale: float | None, tile: int, big: bool | None) -> None:
    n = -(-cols // tile) * -(-rows // tile)
    empty = zlib.compress(np.full((tile, tile), NODATA, "<i2").tobytes(), 6)
    sizes = {r[0]: r[1] for r in tiles.select("number", F.octet_length("data")).collect()}  # 12 bytes for a quarter of a million pixels
    if big is None:
        big = sum(sizes.values()) + len(empty) + 32 * n > 4_000_000_000
    items = "".join(f'<Item name="{k}">{escape(str(v))}</Item>' for k, v in tags.items())
    items += f'<Item name="SCALE" sample="0" role="scale">{1 / scale!r}</Item>' if scale else ""
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if epsg == 4326 else 1, 1025, 0, 1, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg]
    head = 16 if big else 8

    def directory(begin: int) -> bytes:
        offsets, counts, at = [], [], begin + len(empty)
        for k in range(n):
            offsets.append(at if k in sizes else begin)
            counts.append(sizes.get(k, len(empty)))
            at += sizes.get(k, 0)
        return _directory([
            (256, LONG, [cols]), (257, LONG, [rows]), (258, SHORT, [16]), (259, SHORT, [8]), (262, SHORT, [1]), (270, TEXT, json.dumps(tags).encode() + b"\0"), (277, SHORT, [1]), (322, LONG, [tile]), (323, LONG, [tile]),
            (324, LONG8 if big else LONG, offsets), (325, LONG, counts), (339, SHORT, [2]), (33550, DOUBLE, [pixel, pixel, 0.0]), (33922, DOUBLE, [0.0, 0.0, 0.0, left, top, 0.0]), (34735, SHORT, keys),
            (42112, TEXT, f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0"), (42113, TEXT, str(NODATA).encode() + b"\0"),
        ], head, big)

    table = directory(head + len(directory(0)))
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, head) if big else struct.pack("<2sHI", b"II", 42, head)))
        out.write(bytearray(table + empty))
        for r in tiles.orderBy("number").toLocalIterator():
            out.write(r["data"])
    finally:
        out.close()


def read_geotiff(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """All pixels (row, col, dn) of a file that write_geotiff wrote, and its size and place.

    For checks: the driver holds the file.
    """
    raw = spark.sparkContext.binaryFiles(path, 1).values().first()
    big = struct.unpack_from("<H", raw, 2)[0] == 43
    head, size, word = ("<Q", 20, 8) if big else ("<H", 12, 4)
    at = struct.unpack_from("<Q" if big else "<I", raw, 8 if big else 4)[0]
    tags = {}
    for k in range(struct.unpack_from(head, raw, at)[0]):
        entry = at + struct.calcsize(head) + size * k
        tag, kind, count = struct.unpack_from("<HHQ" if big else "<HHI", raw, entry)
        length = count * {TEXT: 1, SHORT: 2, LONG: 4, DOUBLE: 8, LONG8: 8}[kind]
        place = entry + size - word if length <= word else struct.unpack_from("<Q" if big else "<I", raw, entry + size - word)[0]
        tags[tag] = raw[place : place + count - 1].decode() if kind == TEXT else list(struct.unpack_from(f"<{count}{KINDS[kind]}", raw, place))
    cols, rows, tile = tags[256][0], tags[257][0], tags[322][0]
    grid = np.concatenate([np.concatenate([np.frombuffer(zlib.decompress(raw[o : o + n]), "<i2").reshape(tile, tile) for o, n in line], axis=1) for line in _lines(tags, -(-cols // tile))])[:rows, :cols]
    row, col = np.indices(grid.shape)
    pixels = spark.createDataFrame(pa.table({"row": row.ravel().astype(np.int32), "col": col.ravel().astype(np.int32), "dn": grid.ravel().astype(np.int16)}))
    return pixels, {"rows": rows, "cols": cols, "left": tags[33922][3], "top": tags[33922][4], "pixel": tags[33550][0], "epsg": tags[34735][-1], "note": json.loads(tags[270])}


def _lines(tags: dict, across: int) -> list[list[tuple[int, int]]]:
    pairs = list(zip(tags[324], tags[325], strict=True))
    return [pairs[k : k + across] for k in range(0, len(pairs), across)]
