"""Grids of windows over time and list dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import REFERENCE, align_ceil, align_floor, at_offset, micros


def window_starts(start: datetime, stop: datetime, size: timedelta, stride: timedelta, mode: str, ref: datetime = REFERENCE) -> tuple[datetime, datetime]:
    """First start on the grid, and the time by which windows must end."""
    if mode == "fit":
        return align_floor(start, stride, ref), stop
    if mode == "overlap":
        return align_ceil(start - size // stride * stride, stride, ref), stop + size
    raise ValueError(f"unknown mode {mode!r}")


def time_segments(spark: SparkSession, start: datetime, stop: datetime, size: timedelta, stride: timedelta | None = None, mode: str = "fit", ref: datetime = REFERENCE, at_least: int = 0) -> DataFrame:
    """(start, stop) of windows on the grid of ``stride`` (default ``size``) anchored at ``ref``.

    ``fit`` keeps windows that end by ``stop``; ``overlap`` those that overlap or touch the range. ``at_least``
    windows are kept whatever their end.
    """
    stride = stride or size
    first, end = window_starts(start, stop, size, stride, mode, ref)
    n = max((end - size - first) // stride + 1, at_least, 0)
    at = F.col("id") * micros(stride)
    return spark.range(n).select(at_offset(at, first).alias("start"), at_offset(at + micros(size), first).alias("stop"))


def list_segments(items: Sequence[Any], size: int, stride: int | None = None) -> list[list[Any]]:
    """Complete slices of ``size`` items."""
    return [list(items[i : i + size]) for i in range(0, len(items) - size + 1, stride or size)]


def segments(spark: SparkSession, scope: Mapping[str, Any], dims: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """All combinations of the windows of each of ``dims`` that ``scope`` has: time ranges as (dim_start, dim_stop),
    lists as arrays. The grids are small; their product is the result."""
    out = spark.range(1).select()
    for dim, how in dims.items():
        if dim not in scope:
            continue
        at = scope[dim]
        if isinstance(at, Mapping):
            part = time_segments(spark, at["start"], at["stop"], **how).select(F.col("start").alias(f"{dim}_start"), F.col("stop").alias(f"{dim}_stop"))
        else:
            part = spark.createDataFrame([(x,) for x in list_segments(at, **how)], f"{dim} array<string>")
        out = out.crossJoin(part)
    return out
