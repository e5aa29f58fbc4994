"""Geometry files: Parquet with ``geo`` metadata, rows laid out along a space-filling curve, small row groups with boxes.

Neighbours on the curve are neighbours in the plane, so a row group covers a small area, its statistics of the four box
columns say which, and a filter on those columns skips the row groups elsewhere. Tasks write their ranges of the curve
as files of their own; a write shows only when it is committed.
"""

from __future__ import annotations

import contextlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from sitewise.durable import forget, qualified, written
from sitewise.sources.staged import StagedFiles, Written

#: Rows of a row group.
GROUP = 10_000
#: Bits of each coordinate on the curve.
BITS = 16
BOX = ("x0", "y0", "x1", "y1")


def _geo(geographic: bool) -> bytes:
    """Metadata of the one geometry column, by the public specification of such files."""
    column: dict[str, object] = {"encoding": "WKB", "geometry_types": ["Polygon"], "edges": "planar"}
    if not geographic:
        column["crs"] = None
    return json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}}).encode()


class GeoFileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.files = StagedFiles(options["path"], ".parquet", overwrite)
        self.group = int(options.get("rows_per_group", GROUP))
        self.kind = to_arrow_schema(schema).with_metadata({b"geo": _geo(options.get("geographic", "true") == "true")})

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A file of the task's rows in their order; a task without rows writes none."""
        name, rows, held, waiting = None, 0, [], 0
        with contextlib.ExitStack() as stack:
            writer = None

            def flush() -> None:
                nonlocal writer, name, waiting
                if writer is None:
                    name, out = self.files.create()
                    writer = stack.enter_context(pq.ParquetWriter(stack.enter_context(out), self.kind))
                writer.write_table(pa.Table.from_batches(held, self.kind), row_group_size=self.group)
                held.clear()
                waiting = 0

            for batch in iterator:
                at = 0
                while at < len(batch):
                    part = batch.slice(at, self.group - waiting)
                    held.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, self.kind, strict=True)], schema=self.kind))
                    at += len(part)
                    waiting += len(part)
                    rows += len(part)
                    if waiting == self.group:
                        flush()
            if waiting:
                flush()
        return Written([name] if name else [], rows)

    def commit(self, messages: list[Written | None]) -> None:
        self.files.commit(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.files.abort()


class GeoFileDataSource(DataSource):
    """Format ``geofile``, to write: options path, rows_per_group, geographic (whether coordinates are degrees). The files are plain Parquet to readers."""

    @classmethod
    def name(cls) -> str:
        return "geofile"

    def writer(self, schema: StructType, overwrite: bool) -> GeoFileWriter:
        return GeoFileWriter(dict(self.options), schema, overwrite)


def on_curve(x: Column, y: Column) -> Column:
    """Place on the curve of two whole numbers of BITS bits: their bits in turn."""

    def spread(v: Column) -> Column:
        v = v.cast("bigint")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def write_geometries(df: DataFrame, path: str, *, rows_per_group: int = GROUP, geographic: bool = True) -> None:
    """x0, y0, x1, y1, geometry (well-known binary) and any other columns along the curve, in place of what the folder had. Rows without a box come first."""
    spark = df.sparkSession
    spark.dataSource.register(GeoFileDataSource)
    table = written(df, "geometries")  # the bounds, the sampling of ranges and the writing each read it
    low_x, high_x, low_y, high_y = table.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    most = (1 << BITS) - 1

    def cell(a: str, b: str, low: float | None, high: float | None) -> Column:
        middle = (F.col(a) + F.col(b)) / 2
        return F.floor((middle - low) * (most / ((high - low) or 1.0))) if low is not None else F.lit(0)

    place = on_curve(cell("x0", "x1", low_x, high_x), cell("y0", "y1", low_y, high_y))
    laid = table.withColumn("_place", place).repartitionByRange("_place").sortWithinPartitions("_place").drop("_place")
    laid.write.format("geofile").mode("overwrite").options(path=qualified(spark, path), rows_per_group=rows_per_group, geographic=str(geographic).lower()).save()
    forget(table)


def in_box(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The rows whose box meets another one; the comparisons reach the row groups' statistics."""
    return df.where((F.col("x1") >= x0) & (F.col("x0") <= x1) & (F.col("y1") >= y0) & (F.col("y0") <= y1))


def read_geometries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in BOX]))
def edges_of(geometry: pd.Series) -> pd.DataFrame:
    """The box of polygons of one ring in well-known binary, of either byte order; nulls for null."""

    def read(blob: bytes | None) -> tuple:
        if blob is None:
            return (None,) * 4
        order = "<" if blob[0] else ">"
        kind, rings, n = struct.unpack_from(order + "III", blob, 1)
        if kind != 3 or rings != 1:
            raise ValueError("a polygon of one ring is needed")
        corners = np.frombuffer(blob, order + "f8", 2 * n, 13).reshape(-1, 2)
        return (*corners.min(axis=0), *corners.max(axis=0))

    return pd.DataFrame([read(b) for b in geometry], columns=list(BOX), dtype=float)
