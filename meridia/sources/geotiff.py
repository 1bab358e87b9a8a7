"""Height rasters kept as GeoTIFF: cells, and where they lie.

A file is read whole by one task, which decodes it strip by strip (or tile by tile); a large area is
many files. Known are single bands of whole or floating numbers, without compression or deflated,
with or without differencing along rows; anything else is an error that says so.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags by number (fixed values of the format).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, KIND, SCALE, TIEPOINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
#: Sizes and codes of field types (fixed values of the format).
FIELDS = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d")}
NONE, DEFLATE, OLD_DEFLATE = 1, 8, 32946


class Raster(NamedTuple):
    order: str
    tags: dict[int, tuple]

    @classmethod
    def of(cls, data: bytes) -> Raster:
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None or struct.unpack(f"{order}H", data[2:4])[0] != 42:
            raise ValueError("not a TIFF file")
        at = struct.unpack(f"{order}I", data[4:8])[0]
        tags = {}
        for k in range(struct.unpack(f"{order}H", data[at : at + 2])[0]):
            tag, kind, n, _ = struct.unpack(f"{order}HHII", data[(i := at + 2 + 12 * k) : i + 12])
            if kind not in FIELDS:
                continue
            size, code = FIELDS[kind]
            where = i + 8 if size * n <= 4 else struct.unpack(f"{order}I", data[i + 8 : i + 12])[0]
            raw = data[where : where + size * n]
            tags[tag] = (raw.rstrip(b"\0").decode("ascii", "replace"),) if kind == 2 else struct.unpack(f"{order}{n}{code}", raw)
        return cls(order, tags)

    def one(self, tag: int, default: int | None = None) -> int:
        if tag not in self.tags and default is None:
            raise ValueError(f"the TIFF file lacks tag {tag}")
        return self.tags.get(tag, (default,))[0]

    def dtype(self) -> np.dtype:
        bits, kind = self.one(BITS, 1), {1: "u", 2: "i", 3: "f"}.get(self.one(KIND, 1))
        if self.one(SAMPLES, 1) != 1 or kind is None or bits not in (8, 16, 32, 64):
            raise ValueError("only single bands of whole or floating numbers are read")
        return np.dtype(f"{self.order}{kind}{bits // 8}")

    def nodata(self) -> float | None:
        return float(self.tags[NODATA][0]) if NODATA in self.tags else None

    def transform(self) -> tuple[float, float, float, float]:
        """x and y of the upper left corner, and a cell's width and height."""
        if SCALE not in self.tags or TIEPOINT not in self.tags:
            raise ValueError("the TIFF file has no place")
        (dx, dy, *_), (i, j, _, x, y, *_) = self.tags[SCALE], self.tags[TIEPOINT]
        return x - i * dx, y + j * dy, dx, dy

    def blocks(self, data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
        """First row, first column and values of each strip or tile."""
        width, height, kind = self.one(WIDTH), self.one(HEIGHT), self.dtype()
        tiled = TILES in self.tags
        across, down = (self.one(TILE_WIDTH), self.one(TILE_HEIGHT)) if tiled else (width, min(height, self.one(ROWS_PER_STRIP, height)))
        compression, predictor = self.one(COMPRESSION, NONE), self.one(PREDICTOR, 1)
        if compression not in (NONE, DEFLATE, OLD_DEFLATE) or predictor not in (1, 2) or (predictor == 2 and kind.kind == "f"):
            raise ValueError(f"compression {compression} with predictor {predictor} is not read")
        per_row = -(-width // across)
        for k, (at, n) in enumerate(zip(self.tags[TILES if tiled else STRIPS], self.tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True)):
            row, col = k // per_row * down, k % per_row * across
            raw = data[at : at + n] if compression == NONE else zlib.decompress(data[at : at + n])
            rows = down if tiled else min(down, height - row)
            values = np.frombuffer(raw, kind, rows * across).reshape(rows, across)
            if predictor == 2:
                values = np.cumsum(values, axis=1, dtype=kind.newbyteorder("="))
            yield row, col, values[: height - row, : width - col]


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function: the cells of each file that have data."""
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            raster = Raster.of(data)
            nothing = raster.nodata()
            for row, col, values in raster.blocks(data):
                heights = values.astype(np.float64)
                keep = ~np.isnan(heights) if nothing is None else ~np.isnan(heights) & (heights != nothing)
                r, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(r), pa.string()), pa.array((r + row).astype(np.int32)), pa.array((c + col).astype(np.int32)), pa.array(heights[keep])],
                    names=["path", "row", "col", "height"],
                )


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function: where each file lies."""
    for batch in batches:
        found = [Raster.of(data).transform() for data in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([t[k] for t in found], pa.float64()) for k in range(4))], names=["path", "x0", "y0", "dx", "dy"])


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def cells(spark: SparkSession, path: str) -> DataFrame:
    """A row for each cell that has data: path (of its file), row, col, height."""
    return files(spark, path).mapInArrow(decoded, "path string, row int, col int, height double")


def places(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: path, its upper left corner x0, y0, and the cells' dx, dy."""
    return files(spark, path).mapInArrow(placed, "path string, x0 double, y0 double, dx double, dy double")


def cell_of(x: Column, y: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Row and column of the cell that a place lies in."""
    return F.floor((y0 - y) / dy).cast("int"), F.floor((x - x0) / dx).cast("int")
