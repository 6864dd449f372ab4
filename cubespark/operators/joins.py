"""Joins of intervals and of series."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import at_offset, grid_index, micros, offset

#: So many crowded keys are broadcast at most.
BROADCAST_KEYS = 100_000

#: Whether touching ends count: (annotation's end at a request's start, annotation's start at a request's end).
TOUCH = {"neither": (True, True), "both": (False, False), "left": (True, False), "right": (False, True)}


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column, closed: str = "neither") -> Column:
    end, start = TOUCH[closed]
    return ((a1 >= b0) if end else (a1 > b0)) & ((a0 <= b1) if start else (a0 < b1))


def _levels(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("_level").distinct().collect())  # a dozen numbers at most


def overlap_join(annotations: DataFrame, requests: DataFrame, width: timedelta, closed: str = "neither", on: list[str] | None = None, any_of: list[str] | None = None, most_bins: int = 64, salts: int = 1) -> DataFrame:
    """Pairs of annotations (a_start, a_stop, ..) and requests (r_start, r_stop, ..) that overlap, each once.

    ``width`` is the finest grid. An interval lives at the first level at which it covers ``most_bins`` cells or
    fewer; levels are ``most_bins`` times as wide one by one. Two intervals meet at the coarser of their two levels
    only: an equi join takes annotations at home with requests of that level or finer ones, another one requests at
    home with finer annotations, and no finer interval is copied to a level at which nothing of the other side
    lives. So every candidate shares a cell with an interval about as long as the cell or longer, and candidates
    are about as many as results. A pair counts in the later of its two first cells, so none comes twice.

    Requests whose values of ``on`` no more than ``most_bins`` of them have (without ``on``: if there are no more in all)
    need no grid: they meet the annotations of these values as they are, which forms no more candidates than the
    grid might make copies, and no copies.

    ``on`` are further columns (of both sides, equal names) that must be equal; of each column in ``any_of``, scalars
    or arrays on either side, any element of one must be one of the other's. ``salts`` deals each key's or cell's annotations
    to as many tasks, with a copy of its requests each, for those that hold a large part of all rows. Intervals
    whose start is after their stop, or null, overlap nothing and give no pair.
    """
    on, any_of = on or [], any_of or []
    cells = [micros(width)]
    while cells[-1] * most_bins < 1 << 62:  # wide enough for any interval
        cells.append(cells[-1] * most_bins)
    wide = F.array(*map(F.lit, cells))

    def cell(time: str, level: Column) -> Column:
        size = F.element_at(wide, level + 1)
        return F.call_function("div", offset(time) - F.pmod(offset(time), size), size)

    def levelled(df: DataFrame, start: str, stop: str) -> DataFrame:
        us = F.greatest(offset(stop) - offset(start), F.lit(1)).cast("double")
        level = F.greatest(F.lit(0), F.ceil(F.log(float(most_bins), us / (cells[0] * most_bins)))).cast("int")
        return df.withColumn("_level", F.least(level, F.lit(len(cells) - 1)))

    def dealt(df: DataFrame, start: str, stop: str, at: Column, first: str) -> DataFrame:
        df = df.withColumn("_at", at).withColumn(first, cell(start, F.col("_at")))
        return df.withColumn("_cell", F.explode(F.sequence(F.col(first), cell(stop, F.col("_at"))))).drop("_level")

    def finer(df: DataFrame, levels: list[int], strictly: bool) -> tuple[DataFrame, Column]:
        at = F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))
        return df.withColumn("_up", at).filter((F.col("_up") > F.col("_level")) if strictly else (F.col("_up") >= F.col("_level"))), F.col("_up")

    def salted(df: DataFrame) -> DataFrame:
        return df.withColumn("_salt", F.pmod(F.xxhash64(F.to_json(F.struct(*annotations.columns))), F.lit(salts)).cast("int") if salts > 1 else F.lit(0))

    def copied(df: DataFrame) -> DataFrame:
        return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if salts > 1 else F.lit(0))

    def by_cells(a: DataFrame, b: DataFrame) -> list[DataFrame]:
        a, b = levelled(a, "a_start", "a_stop"), levelled(b, "r_start", "r_stop")
        both = []
        for home_is_a, levels in ((True, _levels(a)), (False, _levels(b))):
            other, at = finer(b if home_is_a else a, levels, strictly=not home_is_a)
            left = dealt(a if home_is_a else other, "a_start", "a_stop", F.col("_level") if home_is_a else at, "_a0").drop("_up")
            right = dealt(other if home_is_a else b, "r_start", "r_stop", at if home_is_a else F.col("_level"), "_b0").drop("_up")
            both.append(_matched(salted(left), copied(right), [*on, "_at", "_cell", "_salt"], any_of).filter(F.col("_cell") == F.greatest("_a0", "_b0")))
        return [x.drop("_at", "_cell", "_a0", "_b0") for x in both]

    a, b = annotations.filter(F.col("a_start") <= F.col("a_stop")), requests.filter(F.col("r_start") <= F.col("r_stop"))
    if on:
        many = b.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most_bins).drop("_n")
        crowded = many.count()
        many = F.broadcast(many) if crowded <= BROADCAST_KEYS else many
        few = [x.join(many, on, "left_anti") if crowded else x for x in (a, b)]
        parts = [_matched(salted(few[0]), copied(few[1]), [*on, "_salt"], any_of)]
        if crowded:
            parts += by_cells(*(x.join(many, on, "left_semi") for x in (a, b)))
    elif b.limit(most_bins + 1).count() <= most_bins:
        parts = [_matched(a, F.broadcast(b), [], any_of)]
    else:
        parts = by_cells(a, b)
    out = reduce(DataFrame.unionByName, parts)
    return out.filter(overlaps(F.col("a_start"), F.col("a_stop"), F.col("r_start"), F.col("r_stop"), closed)).drop("_salt")


def _matched(left: DataFrame, right: DataFrame, on: list[str], any_of: list[str]) -> DataFrame:
    """Rows that agree in ``on`` and share an element in each of ``any_of``, whose columns of the right side are dropped."""
    listed = lambda df, c: F.col(c) if df.schema[c].dataType.typeName() == "array" else F.array(F.col(c))
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in any_of})
    out = left.join(right, on) if on else left.crossJoin(right)
    for c in any_of:
        out = out.filter(F.arrays_overlap(listed(left, c), listed(right, f"_r_{c}")))
    return out.drop(*(f"_r_{c}" for c in any_of))


def rows_within(rows: DataFrame, segments: DataFrame, width: timedelta, time: str = "ts") -> DataFrame:
    """``rows`` with the column ``segment`` of each of ``segments`` (segment, start, stop) whose half-open span holds their time."""
    points = rows.withColumns({"a_start": F.col(time), "a_stop": F.col(time)})
    spans = segments.select("segment", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    return overlap_join(points, spans, width, "left").drop("a_start", "a_stop", "r_start", "r_stop")


def per_request(requests: DataFrame, pairs: DataFrame, request: str, annotation: str) -> DataFrame:
    """``requests`` (id column ``request``) with the sorted annotations of each; an empty array where it has none."""
    found = pairs.groupBy(request).agg(F.sort_array(F.collect_set(annotation)).alias("annotations"))
    kind = pairs.schema[annotation].dataType.simpleString()
    return requests.join(found, request, "left").withColumn("annotations", F.coalesce("annotations", F.array().cast(f"array<{kind}>")))


def regular_grid(df: DataFrame, keys: list[str], start: datetime, stop: datetime, step: timedelta, time: str = "ts") -> DataFrame:
    """Every key at every ``step`` of [start, stop), with the rows of ``df`` that fall on it or nulls."""
    series = df.select(*keys).distinct()
    n = (stop - start) // step
    times = df.sparkSession.range(n).select(at_offset(F.col("id") * micros(step), start).alias(time))
    return series.crossJoin(times).join(df, [*keys, time], "left")  # a grid is wanted whole: keys times steps


def outer_merge(df: DataFrame, index: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One column for each of ``names``, a row for each index that any has; two values at one place are an error."""
    wide = df.groupBy(*index).pivot(name, names)
    lo, hi = F.min(value).alias("lo"), F.max(value).alias("hi")
    out = wide.agg(lo, hi)
    clash = F.raise_error(F.lit("conflicting values"))
    return out.select(*index, *(F.when(F.col(f"{n}_lo") != F.col(f"{n}_hi"), clash.cast("double")).otherwise(F.col(f"{n}_lo")).alias(n) for n in names))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], cell: timedelta = timedelta(days=1)) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before its time; of rows of one time, the largest values.

    A union and a window within each ``cell`` of time; what a cell takes over from earlier ones comes from a window over
    one row a cell. So no task holds more of a series than a cell. Rows of ``left`` with a null key stay, without values.
    """
    right = right.select(*keys, time, F.struct(*values).alias("_v")).dropna(subset=[*keys, time])
    rows = right.withColumn("_side", F.lit(0)).unionByName(left.withColumn("_side", F.lit(1)), allowMissingColumns=True).withColumn("_cell", grid_index(time, cell))
    last = right.groupBy(*keys, grid_index(time, cell).alias("_cell")).agg(F.max_by("_v", F.struct(time, "_v")).alias("_last"))
    held = rows.select(*keys, "_cell").distinct().join(last, [*keys, "_cell"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*keys, "_cell", F.last("_last", ignorenulls=True).over(earlier).alias("_old"))
    before = Window.partitionBy(*keys, "_cell").orderBy(time, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in left.columns if c not in (*keys, time)]
    out = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(before)).filter("_side = 1").join(held, [*keys, "_cell"], "left").withColumn("_v", F.coalesce("_v", "_old"))
    return out.select(*keys, time, *rest, *(F.col(f"_v.{v}").alias(v) for v in values))


def index_join(streams: list[DataFrame], index: str = "index", invalid: DataFrame | None = None) -> DataFrame:
    """Rows whose ``index`` all streams have, less the ``invalid`` ones."""
    out = streams[0]
    for other in streams[1:]:
        out = out.join(other, index)
    return out.join(invalid, index, "left_anti") if invalid is not None else out

