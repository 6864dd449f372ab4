"""Readers of sensor files: sensor tables, image trees, event folders, ADC blocks, request files."""

from __future__ import annotations

import html
import itertools
from collections.abc import Callable
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import align_floor, micros, offset, ts
from ..operators.select import nearest, select, within
from ..request import to_datetime


def requests_from_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a line; columns that are null everywhere are left out."""
    found = spark.read.json(path)
    held = found.agg(*(F.count(c).alias(c) for c in found.columns)).first() if found.columns else {}
    return found.select(*(c for c in found.columns if held[c]))


def requests_to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """A CSV with a header; types are strings unless a ``schema`` names them."""
    read = spark.read.options(header=True, **options)
    return (read.schema(schema) if schema else read).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; times are written so that reading gives them back."""
    df.write.mode("overwrite").options(header=True, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def column_names(spark: SparkSession, path: str, title: str = "title", name: str = "name", unit: str = "unit", most: int = 10_000) -> dict[str, str]:
    """Names for the columns of a sensor table from a CSV of titles, names and units, as ``name [unit]``; entities of
    HTML are replaced. Over ``most`` titles are an error."""
    rows = read_csv(spark, path).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} titles")
    return {r[title]: html.unescape(f"{r[name]} [{r[unit]}]" if r[unit] else r[name]) for r in rows}


def sensor_table(spark: SparkSession, path: str, time: str, names: dict[str, str] | None = None, position: int | None = None, span: dict | None = None, fields: list[str] | None = None) -> DataFrame:
    """(ts, name, unit, value) of a wide CSV whose headers may end in ``[unit]``. Columns without any value give no rows.

    ``names`` renames columns (see ``column_names``), ``fields`` keeps those of the given titles only, ``position`` the
    rows of one position, ``span`` a closed range of time.
    """
    wide = read_csv(spark, path)
    if position is not None:
        wide = wide.filter(F.col("position").cast("int") == position)
    rest = [c for c in wide.columns if c not in (time, "position") and (fields is None or c in fields)]
    plain = wide.select(F.to_timestamp_ntz(F.col(f"`{time}`")).alias("ts"), *(F.col(f"`{c}`").cast("double").alias((names or {}).get(c, c)) for c in rest))
    return long_table(plain, ["ts"], [(names or {}).get(c, c) for c in rest], span)


def long_table(wide: DataFrame, keys: list[str], columns: list[str], span: dict | None = None) -> DataFrame:
    """(keys, name, unit, value) of a wide table; units stand in brackets at the end of names."""
    safe = wide.select(*keys, *(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    long = safe.unpivot(keys, [f"c{i}" for i in range(len(columns))], "_c", "value").filter("value is not null")
    titles = F.create_map(*(F.lit(x) for i, c in enumerate(columns) for x in (f"c{i}", c)))
    long = long.withColumn("_t", titles[F.col("_c")])
    unit = F.nullif(F.regexp_extract("_t", r"\[(.*)\]", 1), F.lit(""))
    long = long.select(*keys, F.trim(F.regexp_replace("_t", r"\[.*\]", "")).alias("name"), unit.alias("unit"), "value")
    return long.filter(within(keys[0], span, closed="both")) if span else long


#: How times stand in the names of images, the usual way and an older one (fixed values of the file trees).
IMAGE_TIMES = ((r"(\d{8}_\d{6})", "yyyyMMdd_HHmmss"), (r"(\d{4}-\d{2}-\d{2}_\d{6})", "yyyy-MM-dd_HHmmss"))


def _image_time(path: Column) -> Column:
    """The time in a file's name; null where it has none."""
    found = [F.try_to_timestamp(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), F.lit(form)).cast("timestamp_ntz") for pattern, form in IMAGE_TIMES]
    return F.coalesce(*found)


def image_listing(spark: SparkSession, path: str, extension: str = "JPG", around: timedelta = timedelta(0)) -> DataFrame:
    """(filename, start_time, end_time) by the time in names like 20170105_123000.JPG, one row a start; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(path).select("path")
    at, us = _image_time(F.col("path")), micros(around)
    listed = files.select(F.col("path").alias("filename"), F.timestamp_add("MICROSECOND", F.lit(-us), at).alias("start_time"), F.timestamp_add("MICROSECOND", F.lit(us), at).alias("end_time"))
    return listed.filter("start_time is not null").groupBy("start_time").agg(F.min("filename").alias("filename"), F.min("end_time").alias("end_time")).select("filename", "start_time", "end_time")


def images_within(listing: DataFrame, span: dict | None, method: str | None = None) -> DataFrame:
    """The images of a closed range, or with a ``method`` (see ``select.nearest``) the one nearest to its start."""
    if not span:
        return listing
    if method is None:
        return listing.filter(within("start_time", span, closed="both"))
    return nearest(listing, "start_time", span["start"], [], method).filter("filename is not null")


def image_at(listing: DataFrame, at: datetime) -> DataFrame:
    """The image of exactly this time, under either way of naming."""
    return listing.filter(F.col("start_time") == ts(at))


def images(spark: SparkSession, path: str, span: dict | None = None, extension: str = "JPG", most_files: int = 10_000, decode: Callable[[bytes], np.ndarray] | None = None, method: str | None = None) -> DataFrame:
    """(ts, filename, base64) of the files in a range, both ends included, or of the one that ``method`` picks.

    Names are listed first and only the wanted files are read; over ``most_files`` of them the tree is read whole and
    filtered, so that no long list of names goes through the driver. With ``decode`` (bytes to an array) the last columns
    are (shape array<int>, pixels array<float>). A range without images gives an empty table.
    """
    wanted = images_within(image_listing(spark, path, extension), span, method).select("filename", F.col("start_time").alias("ts"))
    names = [r[0] for r in wanted.select("filename").limit(most_files + 1).collect()] if span else [None] * (most_files + 1)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}")
    if not names:
        files = spark.createDataFrame([], "path string, content binary")
    else:
        files = (read.load(names) if len(names) <= most_files else read.load(path)).select("path", "content")
    found = files.join(wanted, F.col("path") == F.col("filename")).select("ts", "filename", "content")
    if decode is None:
        return found.select("ts", "filename", F.base64("content").alias("base64"))

    def pixels(blobs: pd.Series) -> pd.DataFrame:
        each = [np.asarray(decode(b)) for b in blobs]
        return pd.DataFrame({"shape": [list(x.shape) for x in each], "pixels": [x.astype("float32").ravel() for x in each]})

    both = F.pandas_udf(pixels, "shape array<int>, pixels array<float>")("content")
    return found.select("ts", "filename", both.alias("_x")).select("ts", "filename", "_x.*")


def event_files(spark: SparkSession, path: str, start: datetime, stop: datetime, back: timedelta = timedelta(hours=1)) -> DataFrame:
    """Events (start, end, day, ..) of a Parquet tree by day that overlap the closed range; days before it are pruned."""
    days = F.col("day").between(F.lit((start - back).date()), F.lit(stop.date()))
    return spark.read.parquet(path).filter(days).filter((F.col("end") >= ts(start)) & (F.col("start") <= ts(stop)))


def event_metadata(df: DataFrame) -> DataFrame:
    """Channels, samples a channel and the end of events (first_us, channels "Z;E;N", samples, rate)."""
    channels = F.transform(F.split("channels", ";"), lambda c: F.concat(F.lit("EH"), c))
    each = F.call_function("div", F.col("samples"), F.size("channels").cast("long"))
    first = F.timestamp_add("MICROSECOND", F.col("first_us"), ts(datetime(1970, 1, 1)))
    out = df.withColumn("channels", channels).withColumn("samples", each).withColumn("start", first)
    return out.withColumn("end", F.timestamp_add("MICROSECOND", F.round((F.col("samples") - 1) / F.col("rate") * 1_000_000).cast("long"), F.col("start")))


def decode_adc(raw: Column, width: int) -> Column:
    """Big-endian unsigned ``width``-byte integers less 2^(8 width - 1), as doubles."""

    def decoded(blocks: pd.Series) -> pd.Series:
        def one(block: bytes | None) -> np.ndarray | None:
            if block is None:
                return None
            digits = np.frombuffer(block[: len(block) // width * width], np.uint8).reshape(-1, width).astype(np.int64)
            return (digits @ (256 ** np.arange(width - 1, -1, -1)) - (1 << 8 * width - 1)).astype(float)

        return blocks.map(one)

    return F.pandas_udf(decoded, "array<double>")(raw)


def series_blocks(spark: SparkSession, path: str, indexers: dict, block: timedelta = timedelta(days=1), column: str = "block_date") -> DataFrame:
    """Long rows of a Parquet tree partitioned by the start of each block (``column``: a date, or a time for shorter blocks).

    Only blocks that hold a part of the range are read, and one before it, as samples may reach over a border. Blocks
    that aren't there are passed over; if none is there at all that is an error.
    """
    span = indexers.get("ts", {})
    found = spark.read.option("ignoreMissingFiles", True).parquet(path)
    at = F.col(column).cast("timestamp_ntz")
    if span.get("start") is not None:
        found = found.filter(at >= ts(align_floor(to_datetime(span["start"]), block) - block))
    if span.get("stop") is not None:
        found = found.filter(at < ts(to_datetime(span["stop"])))
    if not found.limit(1).count():
        raise FileNotFoundError(f"{path} has no block of {span}")
    return select(found, indexers).drop(column)


def block_paths(template: str, keys: dict[str, list[str]], start: datetime, stop: datetime, block: timedelta = timedelta(hours=1), lead: int = 1) -> list[str]:
    """The paths of the blocks that cover a range, and ``lead`` blocks before it: ``template`` with each combination of
    ``keys`` and the block's start, as {start:%Y%m%d_%H}."""
    first = align_floor(start, block) - lead * block
    starts = [first + i * block for i in range(max(0, -((first - stop) // block)))]
    combined = [dict(zip(keys, x, strict=True)) for x in itertools.product(*keys.values())]
    return [template.format(start=at, **k) for k in combined for at in starts]


def read_blocks(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Parquet files of ``paths``, those that exist; if none does that is an error."""
    there = [p for p in paths if _exists(spark, p)]
    if not there:
        raise FileNotFoundError(f"none of {len(paths)} blocks, as {paths[:1]}")
    return spark.read.schema(schema).parquet(*there)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def unescaped(text: Column) -> Column:
    """``text`` with its HTML entities replaced."""
    return F.pandas_udf(lambda x: x.map(html.unescape, na_action="ignore"), "string")(text)


def floor_to_sample(df: DataFrame, rate: float, time: str = "ts") -> DataFrame:
    """Times floored to the sample period, in whole microseconds."""
    period = F.lit(round(1_000_000 / rate))
    us = offset(time)
    return df.withColumn(time, F.timestamp_add("MICROSECOND", -F.pmod(us, period), F.col(time)))


def one_rate(df: DataFrame, keys: list[str], rate: str = "sampling_rate") -> DataFrame:
    """(keys, sampling_rate) of series; an error for series of mixed rates."""
    found = df.groupBy(*keys).agg(F.count_distinct(rate).alias("_n"), F.min(rate).alias(rate))
    return found.select(*keys, F.when(F.col("_n") > 1, F.raise_error(F.lit("mixed sampling rates")).cast("double")).otherwise(F.col(rate)).alias(rate))
