"""Scalar expressions: grids, decibels, areas. All stay in generated code; times are timestamp_ntz."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grids are anchored here.
REFERENCE = datetime(2000, 1, 1)


def micros(width: timedelta) -> int:
    return width // timedelta(microseconds=1)


def ts(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def offset(time: Column | str, ref: datetime = REFERENCE) -> Column:
    """Microseconds since ``ref``; negative before it."""
    return F.timestamp_diff("MICROSECOND", ts(ref), F.col(time) if isinstance(time, str) else time)


def at_offset(us: Column, ref: datetime = REFERENCE) -> Column:
    return F.timestamp_add("MICROSECOND", us, ts(ref))


def grid_index(time: Column | str, width: timedelta, ref: datetime = REFERENCE) -> Column:
    """Number of the grid cell that holds ``time``: floor, also before the reference."""
    us, w = offset(time, ref), F.lit(micros(width))
    return F.call_function("div", us - F.pmod(us, w), w)


def align_floor(value: datetime, width: timedelta, ref: datetime = REFERENCE) -> datetime:
    return ref + (value - ref) // width * width


def align_ceil(value: datetime, width: timedelta, ref: datetime = REFERENCE) -> datetime:
    down = align_floor(value, width, ref)
    return down if down == value else down + width


def decibel(power: Column, reference: float = 1.0, least: float = 1e-20) -> Column:
    floor = lambda x: F.greatest(F.lit(least), x)
    return 10 * F.log10(floor(power)) - 10 * F.log10(floor(F.lit(reference)))


def triangle_area(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.abs(ax * (by - cy) + bx * (cy - ay) + cx * (ay - by)) / 2


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
