"""Elevation grids as a Python data source that reads blocks of rows: a tile larger than a task's memory is cut in parts.

``spark.read.format("elevation")`` lists ``.npy`` files and reads the header of each once. A partition is a block of rows
of patches, for which only its own rows of the grid (and those that overlap needs) are read, by their offset in the file.
Filters on ``tile_id`` and ``row`` are pushed down, so one patch reads the rows that it lies in and nothing else.

Files are opened through pyarrow's file systems (local, s3, gs, hdfs). GeoTIFF goes through ``dem.patches`` whole.
"""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import dem

#: Bytes of grid that a partition reads, about; a block has at least one row of patches.
BLOCK_BYTES = 32_000_000
#: Bytes of a file's start that hold its header (headers of such files end at a multiple of 64, mostly at 128).
_HEADER = 4096
BLOCKS = "tile_id string, row int, col int, nth int, y_start int, x_start int, h int, w int, valid_fraction double, data array<double>, tile_h int, tile_w int"
COUNTS = "tile_id string, row int, tile_h int, tile_w int, n_cells long, n_missing long, n_patches long"
_ORDER = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path, with or without a scheme, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def tile_of(path: str) -> str:
    """The file's name up to ``_dem`` or the dot."""
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0].removesuffix("_dem")


@dataclass(frozen=True)
class Grid:
    """What a file's header says: where its cells begin and how they lie."""

    path: str
    tile_id: str
    height: int
    width: int
    dtype: str
    start: int
    by_column: bool

    @classmethod
    def of(cls, files: fs.FileSystem, path: str) -> Grid:
        with files.open_input_file(path) as file:
            head = io.BytesIO(file.read_at(_HEADER, 0))
        version = np.lib.format.read_magic(head)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, dtype = read(head)
        if len(shape) != 2:
            raise ValueError(f"{path}: an elevation grid has two axes, not {len(shape)}")
        if dtype.hasobject:
            raise ValueError(f"{path}: an elevation grid holds numbers")
        return cls(path, tile_of(path), *shape, dtype.str, head.tell(), by_column and min(shape) > 1)

    def rows(self, files: fs.FileSystem, first: int, stop: int) -> np.ndarray:
        """Rows ``first`` to ``stop``: one range of the file, or one per column where the grid lies by columns."""
        dtype, n = np.dtype(self.dtype), stop - first
        with files.open_input_file(self.path) as file:
            if self.by_column:
                columns = [np.frombuffer(file.read_at(n * dtype.itemsize, self.start + (c * self.height + first) * dtype.itemsize), dtype) for c in range(self.width)]
                return np.stack(columns, axis=1).astype(float)
            data = file.read_at(n * self.width * dtype.itemsize, self.start + first * self.width * dtype.itemsize)
        return np.frombuffer(data, dtype).reshape(n, self.width).astype(float)


@dataclass
class Block(InputPartition):
    """A partition: some rows of patches of one grid."""

    grid: Grid
    rows: tuple[int, ...]

    def __init__(self, grid: Grid, rows: tuple[int, ...]) -> None:
        super().__init__(None)
        self.grid, self.rows = grid, rows


class ElevationReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*_dem.npy")
        self.size, self.overlap = int(options.get("patch_size", 64)), int(options.get("overlap", 0))
        self.min_valid, self.pad = float(options.get("min_valid", 0.8)), options.get("pad_partial", "true").lower() == "true"
        self.counts, self.bytes = options.get("counts", "false").lower() == "true", int(options.get("block_bytes", BLOCK_BYTES))
        self.tiles: list[set[str]] = []
        self.bounds: list[tuple[str, int]] = []
        self.among: list[set[int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the tile and the row of patches are met here; all others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("tile_id",):
                self.tiles.append({f.value})
            elif isinstance(f, In) and f.attribute == ("tile_id",):
                self.tiles.append(set(f.value))
            elif isinstance(f, In) and f.attribute == ("row",):
                self.among.append({int(v) for v in f.value if v is not None})
            elif type(f) in _ORDER and f.attribute == ("row",) and isinstance(f.value, int):
                self.bounds.append((_ORDER[type(f)], f.value))
            else:
                yield f

    def _wanted(self, row: int) -> bool:
        return all(getattr(row, op)(value) for op, value in self.bounds) and all(row in own for own in self.among)

    def partitions(self) -> list[Block]:
        files, path = opened(self.path)
        found = files.get_file_info(fs.FileSelector(path, recursive=True)) if files.get_file_info(path).type == fs.FileType.Directory else files.get_file_info([path])
        names = sorted(f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.path.rsplit("/", 1)[-1], self.pattern))
        out = []
        for name in names:
            if not all(tile_of(name) in own for own in self.tiles):
                continue
            grid = Grid.of(files, name)
            rows = [r for r in range(dem.grid_count(grid.height, self.size, self.overlap, self.pad)) if self._wanted(r)]
            row_bytes = max(1, (self.size - self.overlap) * grid.width * 8)
            per = max(1, self.bytes // row_bytes)
            out += [Block(grid, tuple(rows[lo : lo + per])) for lo in range(0, len(rows), per)]
        return out

    def read(self, block: Block | None) -> Iterator[pa.RecordBatch]:
        if block is None:  # no files, or none that the filters leave
            return
        grid, stride = block.grid, self.size - self.overlap
        files, _ = opened(self.path)
        last = dem.grid_count(grid.height, self.size, self.overlap, self.pad) - 1
        for run in _runs(block.rows):
            top = run[0] * stride
            stop = min(grid.height, run[-1] * stride + self.size)
            if self.counts and run[-1] == last:
                stop = grid.height  # cells that no patch holds count as well
            strip = grid.rows(files, top, stop)
            for row in run:
                found = list(dem.cut_row(strip, top, row, self.size, self.overlap, self.min_valid, self.pad))
                if self.counts:
                    own = strip[row * stride - top : grid.height - top if row == last else (row + 1) * stride - top]
                    columns = [[grid.tile_id], [row], [grid.height], [grid.width], [own.size], [int(np.isnan(own).sum())], [len(found)]]
                    types = [pa.string(), *[pa.int32()] * 3, *[pa.int64()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in COUNTS.split(", ")])
                elif found:
                    yield self._patches(grid, found)

    def _patches(self, grid: Grid, found: list[dict]) -> pa.RecordBatch:
        n = len(found)
        whole = {c: pa.array([f[c] for f in found], pa.int32()) for c in ("row", "col", "y_start", "x_start", "h", "w")}
        data = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.size**2), pa.array(np.concatenate([f["data"] for f in found])))
        columns = {
            "tile_id": pa.array([grid.tile_id] * n), **whole, "nth": pa.array(np.arange(n, dtype=np.int32)), "valid_fraction": pa.array([f["valid_fraction"] for f in found], pa.float64()),
            "data": data, "tile_h": pa.array([grid.height] * n, pa.int32()), "tile_w": pa.array([grid.width] * n, pa.int32()),
        }
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def _runs(rows: tuple[int, ...]) -> Iterator[list[int]]:
    """Rows that follow one another, together."""
    run: list[int] = []
    for row in rows:
        if run and row != run[-1] + 1:
            yield run
            run = []
        run.append(row)
    if run:
        yield run


class ElevationSource(DataSource):
    """Options: ``path``, ``pattern``, ``patch_size``, ``overlap``, ``min_valid``, ``pad_partial``, ``block_bytes``, and
    ``counts``: a row per row of patches with its cells, gaps and patches instead of the patches themselves."""

    @classmethod
    def name(cls) -> str:
        return "elevation"

    def schema(self) -> str:
        return COUNTS if self.options.get("counts", "false").lower() == "true" else BLOCKS

    def reader(self, schema) -> ElevationReader:
        return ElevationReader(dict(self.options))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The source's rows; filters on ``tile_id`` and ``row`` that follow reach the reader."""
    spark.dataSource.register(ElevationSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("elevation").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def patches(spark: SparkSession, path: str, where=None, max_missing: float = 0.95, **options) -> DataFrame:
    """The patches of ``dem.patches`` (with ``local_id``), read in blocks; ``where`` is a condition on ``tile_id`` or ``row``.

    The grids are read twice: once for the gaps and the patches of each row of patches, from which the ids of its first
    patches follow, and once for the cells. The counts are one row per row of patches, and no patch is shuffled as long
    as they are few enough to be broadcast. With a condition on ``row`` ids still count from the tile's start.
    """
    counted, cut = read(spark, path, counts="true", **options), read(spark, path, **options)
    if where is not None:
        cut = cut.where(where)
    tile = Window.partitionBy("tile_id")
    missing = F.sum("n_missing").over(tile) / F.sum("n_cells").over(tile)
    start = F.sum("n_patches").over(tile.orderBy("row")) - F.col("n_patches")
    starts = counted.select("tile_id", "row", missing.alias("missing"), start.alias("start")).where(F.col("missing") <= max_missing).drop("missing")
    placed = cut.join(starts, ["tile_id", "row"]).withColumn("local_id", (F.col("start") + F.col("nth")).cast("long"))
    return placed.select(*[c.split()[0] for c in dem.PATCHES.split(", ")])


def listed(spark: SparkSession, path: str, pattern: str = "*_dem.npy") -> DataFrame:
    """``tile_id, path`` of the files, from their names alone."""
    return dem.files(spark, path, pattern).select(F.regexp_extract("path", r"([^/]+?)(_dem)?\.[^./]+$", 1).alias("tile_id"), "path")


def patch(spark: SparkSession, path: str, tile_id: str, row: int, col: int, **options) -> DataFrame:
    """One patch by its place in the grid of patches: a partition that reads the rows of that row of patches."""
    found = read(spark, path, **options)
    return found.where((F.col("tile_id") == tile_id) & (F.col("row") == row) & (F.col("col") == col)).drop("nth")


def make_folder(path: str) -> None:
    files, name = opened(path)
    files.create_dir(name, recursive=True)


def write_grid(path: str, grid: np.ndarray) -> None:
    """A ``.npy`` file through the same file systems."""
    files, name = opened(path)
    held = io.BytesIO()
    np.save(held, grid)
    with files.open_output_stream(name) as out:
        out.write(held.getvalue())
