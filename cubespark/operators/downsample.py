"""Downsampling: tumbling minimum and maximum by time or count, and largest triangles."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import at_offset, grid_index, micros, triangle_area


def max_by_time(df: DataFrame, keys: list[str], width: timedelta, time: str = "ts", value: str = "value") -> DataFrame:
    """(keys, ts, value, n): the maximum in each cell of the grid, labelled at its start. Partial aggregates shuffle."""
    cell = grid_index(time, width)
    out = df.groupBy(*keys, cell.alias("_cell")).agg(F.max(value).alias("value"), F.count(value).alias("n"))
    return out.select(*keys, at_offset(F.col("_cell") * micros(width)).alias("ts"), "value", "n")


def minmax_by_time(df: DataFrame, keys: list[str], width: timedelta, time: str = "ts", value: str = "value") -> DataFrame:
    """(keys, ts, value): each cell's minimum at its start and its maximum half a cell later."""
    cell, w = grid_index(time, width), micros(width)
    both = df.groupBy(*keys, cell.alias("_cell")).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    start = F.col("_cell") * w
    pair = F.array(F.struct(at_offset(start).alias("ts"), F.col("low").alias("value")), F.struct(at_offset(start + w // 2).alias("ts"), F.col("high").alias("value")))
    return both.select(*keys, F.explode(pair).alias("_p")).select(*keys, "_p.*")


def numbered(df: DataFrame, keys: list[str], time: str = "ts", value: str = "value", cell: timedelta = timedelta(days=1)) -> DataFrame:
    """``df`` with the place ``_i`` of each sample in its series by (time, value), the series' length ``_n`` and the values
    ``_y0`` and ``_y1`` of its first and last sample.

    Samples are counted within each ``cell`` of time; what stands before a cell comes from a window over one row a
    cell. So no task holds more of a series than a cell.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    df = df.withColumn("_at", grid_index(time, cell))
    sample = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    cells = df.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("_at").alias("_cell_at")).agg(F.count(F.lit(1)).alias("_m"), F.min(sample).alias("_f"), F.max(sample).alias("_l"))
    series = Window.partitionBy(*names)
    before = F.coalesce(F.sum("_m").over(series.orderBy("_cell_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(*names, "_cell_at", before.alias("_before"), F.sum("_m").over(series).alias("_n"), F.min("_f").over(series)["v"].alias("_y0"), F.max("_l").over(series)["v"].alias("_y1"))
    same = F.col("_at").eqNullSafe(F.col("_cell_at"))
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    place = F.row_number().over(Window.partitionBy(*keys, "_at").orderBy(time, value)) - 1
    return df.withColumn("_i", place).join(cells, same).withColumn("_i", F.col("_i") + F.col("_before")).drop(*names, "_at", "_cell_at", "_before")


def by_count(df: DataFrame, keys: list[str], size: int, time: str = "ts", value: str = "value", low: bool = True, cell: timedelta = timedelta(days=1)) -> DataFrame:
    """(keys, ts, low, high) of each ``size`` samples of a series in time order; a short rest is dropped.

    Regularly sampled series should be cut by time, which needs no order within a series.
    """
    cells = numbered(df, keys, time, value, cell).groupBy(*keys, F.floor(F.col("_i") / size).alias("_cell"))
    out = cells.agg(F.min(time).alias("ts"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == size)
    return out.select(*keys, "ts", *(["low"] if low else []), "high")


def rolling(df: DataFrame, keys: list[str], size: int, stride: int | None = None, phase: str = "start", time: str = "ts", value: str = "value", cell: timedelta = timedelta(days=1)) -> DataFrame:
    """(keys, ts, window): arrays of ``size`` samples in time order, every ``stride`` (default ``size``) samples.

    ``start``: a window begins at every stride-th sample and has its time. ``trailing``: a window ends there and has
    that time. Windows that reach beyond the series are dropped.
    """
    if phase not in ("start", "trailing"):
        raise ValueError(f"unknown phase {phase!r}")
    stride, i = stride or size, F.col("_i")
    ahead = 0 if phase == "start" else size - 1  # a window k covers k * stride - ahead and on
    first = F.greatest(F.ceil((i + ahead - size + 1) / stride), F.lit(0))
    last = F.floor((i + ahead) / stride)
    rows = numbered(df, keys, time, value, cell).withColumn("_w", F.explode(F.when(first <= last, F.sequence(first, last))))
    held = rows.groupBy(*keys, "_w").agg(F.sort_array(F.collect_list(F.struct(F.col("_i").alias("i"), F.col(time).alias("t"), F.col(value).alias("v")))).alias("_s")).filter(F.size("_s") == size)
    return held.select(*keys, F.element_at("_s", 1 if phase == "start" else -1)["t"].alias("ts"), F.col("_s.v").alias("window"))


def lttb_anchored(df: DataFrame, keys: list[str], factor: int, time: str = "ts", value: str = "value", cell: timedelta = timedelta(days=1)) -> DataFrame:
    """(keys, cell, value) of the sample with the largest triangle to the series' first sample and the next cell's mean.

    Cells of ceil(n / (n / factor - 2)) samples follow the first; the last sample stands for the cell after the last.
    Anchored at the first sample, cells don't depend on each other; ties go to the earlier sample.
    """
    n_out = F.floor(F.col("_n") / factor) - 2
    rows = numbered(df, keys, time, value, cell).filter(n_out > 0).withColumn("_size", F.ceil(F.col("_n") / n_out))
    rows = rows.filter(F.col("_i") < F.col("_n") - 1).withColumn("_cell", F.when(F.col("_i") == 0, 0).otherwise(F.floor((F.col("_i") - 1) / F.col("_size")) + 1))
    rows = rows.withColumn("_held", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_cell"))).filter((F.col("_cell") == 0) | (F.col("_held") == F.col("_size")))
    means = rows.groupBy(*keys, "_cell").agg(F.avg("_i").alias("mx"), F.avg(value).alias("my"))
    ahead = Window.partitionBy(*keys).orderBy("_cell")  # one row a cell
    means = means.select(*keys, "_cell", F.lead("mx").over(ahead).alias("nx"), F.lead("my").over(ahead).alias("ny"))
    nx, ny = F.coalesce("nx", F.col("_n").cast("double") - 1), F.coalesce("ny", "_y1")
    area = triangle_area(F.lit(0.0), F.col("_y0"), F.col("_i").cast("double"), F.col(value), nx, ny)
    best = rows.join(means, [*keys, "_cell"]).groupBy(*keys, "_cell").agg(F.max_by(value, F.struct(area, -F.col("_i"))).alias("value"))
    return best.select(*keys, F.col("_cell").cast("long").alias("cell"), "value")


def lttb(df: DataFrame, keys: list[str], n_out: int, time: str = "ts", value: str = "value") -> DataFrame:
    """(keys, ts, value): the published sequential algorithm; a series is one group, at most ``n_out`` rows come out."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(time)
        n, y = len(frame), frame[value].to_numpy(float)
        if n <= n_out or n_out < 3:
            return frame[[*keys, time, value]]
        edges = np.linspace(1, n - 1, n_out - 1).astype(int)
        at = [0]
        for i in range(n_out - 2):
            lo, hi = edges[i], edges[i + 1]
            nx, ny = (np.arange(hi, edges[i + 2]).mean(), y[hi : edges[i + 2]].mean()) if i + 2 < len(edges) else (n - 1, y[-1])
            x = np.arange(lo, hi)
            at.append(lo + int(np.abs((at[-1] - nx) * (y[lo:hi] - y[at[-1]]) - (at[-1] - x) * (ny - y[at[-1]])).argmax()))
        return frame.iloc[[*at, n - 1]][[*keys, time, value]]

    return df.select(*keys, time, value).groupBy(*keys).applyInPandas(one, df.select(*keys, time, value).schema)


def chunked(df: DataFrame, keys: list[str], width: timedelta, time: str = "ts", value: str = "value") -> DataFrame:
    """Chunk form (keys, chunk_id, ts array, samples array) of long rows; each group is one chunk."""
    pair = F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))))
    out = df.groupBy(*keys, grid_index(time, width).alias("chunk_id")).agg(pair.alias("_p"))
    return out.select(*keys, "chunk_id", F.col("_p.t").alias("times"), F.col("_p.v").alias("samples"))


def unchunked(df: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows of chunk form."""
    return df.select(*keys, F.explode(F.arrays_zip("times", "samples")).alias("_p")).select(*keys, F.col("_p.times").alias("ts"), F.col("_p.samples").alias("value"))

