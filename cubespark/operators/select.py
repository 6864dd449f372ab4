"""Slices of a cube: by range, label, position and nearness."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid_index, offset, ts
from ..request import to_datetime


def _bound(value: Any) -> Column:
    return ts(to_datetime(value)) if isinstance(value, str | datetime) else F.lit(value)


def within(column: str, span: Mapping[str, Any], closed: str = "left") -> Column:
    """``start <= column < stop``; ``closed="both"`` includes the stop. Plain comparisons, which Parquet scans take."""
    out = F.lit(True)
    if span.get("start") is not None:
        out = out & (F.col(column) >= _bound(span["start"]))
    if span.get("stop") is not None:
        stop = _bound(span["stop"])
        out = out & (F.col(column) <= stop if closed == "both" else F.col(column) < stop)
    return out


def select(df: DataFrame, indexers: Mapping[str, Any], closed: str = "left", names: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` at ``indexers``: {start, stop} is a range, a list or scalar is labels. ``names`` maps dimensions to columns."""
    for dim, at in indexers.items():
        column = (names or {}).get(dim, dim)
        if isinstance(at, Mapping):
            df = df.filter(within(column, at, closed))
        else:
            df = df.filter(F.col(column).isin(list(at) if isinstance(at, list | tuple | set) else [at]))
    return df


def positions(df: DataFrame, keys: list[str], order: list[str], start: int, stop: int, cell: timedelta | None = None) -> DataFrame:
    """Rows ``start`` .. ``stop`` - 1 of each series in ``order``.

    With a ``cell`` (the first of ``order`` is a time) rows are counted cell by cell and only cells that hold wanted
    places are sorted: no task holds more of a series than a cell.
    """
    if cell is None:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        return df.withColumn("position", nth.cast("long")).filter((F.col("position") >= start) & (F.col("position") < stop))
    names = [f"_k{i}" for i in range(len(keys))]
    df = df.withColumn("_at", grid_index(order[0], cell))
    counts = df.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("_at").alias("_cell")).agg(F.count(F.lit(1)).alias("_m"))
    earlier = Window.partitionBy(*names).orderBy(F.col("_cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_m").over(earlier), F.lit(0))).filter((F.col("_before") < stop) & (F.col("_before") + F.col("_m") > start))
    same = F.col("_at").eqNullSafe(F.col("_cell"))
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    place = F.row_number().over(Window.partitionBy(*keys, "_at").orderBy(*order)) - 1 + F.col("_before")
    out = df.join(counts, same).withColumn("position", place.cast("long")).drop(*names, "_at", "_cell", "_m", "_before")
    return out.filter((F.col("position") >= start) & (F.col("position") < stop))


def nearest(df: DataFrame, time: str, at: datetime, keys: list[str], method: str = "nearest") -> DataFrame:
    """The row of each series that is nearest ``at``, or the last not after (ffill) or first not before (bfill) it.

    Of two rows as near the earlier one counts. One aggregate, no sort.
    """
    if method != "nearest":
        df = df.filter(F.col(time) <= ts(at) if method == "ffill" else F.col(time) >= ts(at))
    away = F.abs(offset(time, at))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(away, F.col(time))).alias("_row")).select(*keys, "_row.*")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each of ``keys``: the first in ``order``. An aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
