"""Cubes that compute only what they miss, and caches of results by request."""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import datetime, timedelta
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.utils import AnalysisException

from ..functions import at_offset, grid_index, micros, offset
from ..operators import select
from ..request import Request, to_datetime


def group_name(keys: Mapping[str, object]) -> str:
    """The values of sorted keys; lists joined by ``/``."""
    parts = []
    for name in sorted(keys):
        value = keys[name]
        values = list(value) if isinstance(value, list | tuple) else [value]
        if not all(isinstance(x, str) for x in values):
            raise TypeError(f"{name} must be a string or strings")
        parts.append("/".join(values))
    return "/".join(parts)


def _appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _parts(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Parquet whose partition columns ``names`` are strings, whatever their values look like."""
    schema = spark.read.parquet(path).schema
    for f in schema.fields:
        f.dataType = StringType() if f.name in names else f.dataType
    return spark.read.schema(schema).parquet(path)


class Persister:
    """A cube of chunks of time, by groups of series, of which only missing chunks are computed.

    Chunks are Parquet partitions (grp, chunk_id, version) with a manifest (grp, chunk_id, status, version, error)
    beside them. Data are written before the manifest, both by appending; a chunk whose status is known is never
    computed again. Two writers of one chunk each add a version, and readers take the first of the manifest.

    ``compute`` is asked for the ``prototype`` with the request laid over it, the values of the ``group_keys`` (columns
    of its result, as strings) that lack chunks, and a span of whole chunks. Groups that lack the same run of chunks
    are computed together, by one request with lists. Where that fails, the run is halved, then the groups, and what
    fails alone is marked -1 with its error; the others are kept.

    ``bypass`` passes every request through to ``compute``; ``bypass_storage`` computes whole chunks but neither reads
    nor writes any. A request may set both in its config.
    """

    MANIFEST = "grp string, chunk_id long, status tinyint, version string, error string"

    def __init__(
        self, spark: SparkSession, path: str, scope: tuple[datetime, datetime | None], chunk: timedelta, compute: Callable[[Request], DataFrame] | None = None,
        prototype: Mapping | Request = Request(), group_keys: Sequence[str] = (), time: str = "ts", step: timedelta | None = None, bypass: bool = False, bypass_storage: bool = False,
    ):
        self.spark, self.path, self.start, self.stop, self.chunk, self.compute, self.time = spark, path.rstrip("/"), scope[0], scope[1], chunk, compute, time
        self.prototype, self.group_keys, self._step = Request.of(prototype), sorted(group_keys), step
        self.bypass, self.bypass_storage = bypass, bypass_storage

    # ---- what there is ----

    def manifest(self) -> DataFrame:
        found = _appended(self.spark, f"{self.path}/manifest", self.MANIFEST)
        first = F.min_by(F.struct("status", "version", "error"), F.struct(-F.abs("status"), "version")).alias("_x")
        return found.groupBy("grp", "chunk_id").agg(first).select("grp", "chunk_id", "_x.*")

    def chunk_range(self, start: datetime, stop: datetime) -> range:
        """Chunks that hold a part of [start, stop), within the cube's scope."""
        stop = min(stop, self.stop) if self.stop else stop
        return range(max(0, (start - self.start) // self.chunk), max(0, -((self.start - stop) // self.chunk)))

    def span(self, request: Request) -> tuple[datetime, datetime]:
        at = request.indexers.get(self.time) or {}
        start, stop = at.get("start", self.start), at.get("stop", self.stop)
        if stop is None:
            raise ValueError("neither the request nor the cube has a stop")
        return to_datetime(start), to_datetime(stop)

    def groups(self, request: Request) -> list[dict[str, str]]:
        """Each combination of the values that a request has of the group keys."""
        lacking = [k for k in self.group_keys if k not in request.indexers]
        if lacking:
            raise ValueError(f"the request names no {lacking}")
        lists = [v if isinstance(v, list | tuple) else [v] for v in (request.indexers[k] for k in self.group_keys)]
        return [dict(zip(self.group_keys, x, strict=True)) for x in itertools.product(*lists)]

    def _name(self, group: Mapping[str, str]) -> str:
        return "g" + group_name(group)

    def _wanted(self, request: Request) -> DataFrame:
        ids = self.chunk_range(*self.span(request))
        names = self.spark.createDataFrame([(self._name(g),) for g in self.groups(request)], "grp string")
        return self.spark.range(ids.start, max(ids.start, ids.stop)).withColumnRenamed("id", "chunk_id").crossJoin(names)  # what is asked for, whole

    def available(self, request: Mapping | Request) -> DataFrame:
        """(grp, chunk_id, chunk_start, status) of what a request needs, with 0 for chunks not computed yet."""
        found = self._wanted(Request.of(request)).join(self.manifest(), ["grp", "chunk_id"], "left")
        return found.select("grp", "chunk_id", at_offset(F.col("chunk_id") * micros(self.chunk), self.start).alias("chunk_start"), F.coalesce("status", F.lit(0)).cast("tinyint").alias("status"))

    def is_available(self, request: Mapping | Request) -> bool:
        return not self.available(request).filter("status = 0").limit(1).count()

    def is_finalized(self) -> bool:
        return bool(_appended(self.spark, f"{self.path}/meta", "kind string, body string").filter("kind = 'finalized'").limit(1).count())

    # ---- attributes ----

    def initialize(self) -> dict:
        """The cube's attributes; the first time they are inferred from the prototype's first chunk and kept.

        step: the commonest distance of two times of a group; columns, sampling_rate, samples (a chunk has).
        """
        held = _appended(self.spark, f"{self.path}/meta", "kind string, body string").filter("kind = 'attributes'").orderBy("body").first()
        if held is not None:
            return json.loads(held["body"])
        stop = min(self.start + self.chunk, self.stop or self.start + self.chunk)
        rows = self._ask(Request(), {}, self.start, stop)
        before = F.lag(self.time).over(Window.partitionBy(*self.group_keys).orderBy(self.time))
        step = self._step or timedelta(microseconds=rows.select((offset(self.time) - offset(before)).alias("d")).filter("d > 0").agg(F.mode("d", True)).first()[0] or 0)
        us = micros(step)
        out = {"columns": {f.name: f.dataType.simpleString() for f in rows.schema}, "step_us": us, "sampling_rate": 1e6 / us if us else None, "samples": micros(self.chunk) // us if us else None, "start": self.start.isoformat(), "chunk_us": micros(self.chunk)}
        self._mark("attributes", out)
        return out

    def _mark(self, kind: str, body: Mapping) -> None:
        self.spark.createDataFrame([(kind, json.dumps(body, sort_keys=True))], "kind string, body string").coalesce(1).write.mode("append").parquet(f"{self.path}/meta")

    def step(self) -> timedelta:
        us = micros(self._step) if self._step else self.initialize()["step_us"]
        if not us:
            raise ValueError("the cube's samples have no step")
        return timedelta(microseconds=us)

    # ---- computing ----

    def _ask(self, request: Request, groups: Mapping[str, Any], start: datetime, stop: datetime) -> DataFrame:
        indexers = {**self.prototype.indexers, **request.indexers, **groups, self.time: {"start": start, "stop": stop}}
        config = {k: v for k, v in {**self.prototype.config, **request.config}.items() if k not in ("bypass", "bypass_storage")}
        return self.compute(Request(indexers, config))

    def _name_column(self) -> Column:
        return F.concat(F.lit("g"), F.concat_ws("/", *(F.col(k).cast("string") for k in self.group_keys)))

    def missing(self, request: Mapping | Request) -> DataFrame:
        """(grp, chunk_id) of what a request needs and the manifest doesn't know."""
        return self._wanted(Request.of(request)).join(self.manifest(), ["grp", "chunk_id"], "left_anti")

    def fill(self, request: Mapping | Request) -> int:
        """Computes what a request lacks; the number of chunks that were tried."""
        request = Request.of(request)
        if self.is_finalized():
            return 0
        near = F.col("chunk_id") - F.row_number().over(Window.partitionBy("grp").orderBy("chunk_id"))
        runs = self.missing(request).withColumn("_run", near).groupBy("grp", "_run").agg(F.min("chunk_id").alias("lo"), F.max("chunk_id").alias("hi"))
        found = runs.groupBy("lo", "hi").agg(F.sort_array(F.collect_list("grp")).alias("grps")).orderBy("lo", "hi").collect()  # runs, not chunks
        by_name = {self._name(g): g for g in self.groups(request)}
        for r in found:
            self._fill_run(request, r["lo"], r["hi"] + 1, [by_name[x] for x in r["grps"]])
        return sum((r["hi"] + 1 - r["lo"]) * len(r["grps"]) for r in found)

    def _fill_run(self, request: Request, lo: int, hi: int, groups: list[dict[str, str]]) -> None:
        version, names = "v" + uuid.uuid4().hex, [self._name(g) for g in groups]
        status, error = 1, None
        try:
            lists = {k: sorted({g[k] for g in groups}) if len(groups) > 1 else groups[0][k] for k in self.group_keys}
            rows = self._ask(request, lists, self.start + lo * self.chunk, self.start + hi * self.chunk)
            rows = rows.withColumns({"grp": self._name_column(), "chunk_id": grid_index(self.time, self.chunk, self.start), "version": F.lit(version)})
            rows = rows.filter(F.col("chunk_id").between(lo, hi - 1) & F.col("grp").isin(names))
            rows.write.mode("append").partitionBy("grp", "chunk_id", "version").parquet(f"{self.path}/data")
        except Exception as e:  # failures are data here
            if hi - lo > 1:
                middle = (lo + hi) // 2
                self._fill_run(request, lo, middle, groups)
                self._fill_run(request, middle, hi, groups)
                return
            if len(groups) > 1:
                middle = len(groups) // 2
                self._fill_run(request, lo, hi, groups[:middle])
                self._fill_run(request, lo, hi, groups[middle:])
                return
            status, error = -1, str(e)[:500]
        held = self.spark.createDataFrame([(x,) for x in names], "grp string")
        marks = self.spark.range(lo, hi).crossJoin(held).select("grp", F.col("id").alias("chunk_id"), F.lit(status).cast("tinyint").alias("status"), F.lit(version).alias("version"), F.lit(error).cast("string").alias("error"))
        marks.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    # ---- reading ----

    def _data(self) -> DataFrame | None:
        try:
            return _parts(self.spark, f"{self.path}/data", ("grp", "version"))
        except AnalysisException:
            return None

    def read(self, request: Mapping | Request) -> DataFrame:
        """Rows of a request; missing chunks are computed first. All chunks failed: an error; some: none of their rows."""
        request = Request.of(request)
        start, stop = self.span(request)
        within = select.within(self.time, {"start": start, "stop": stop})
        if self.bypass or request.config.get("bypass"):
            return self.compute(request)
        if self.bypass_storage or request.config.get("bypass_storage"):
            ids = self.chunk_range(start, stop)
            return self._ask(request, {}, self.start + ids.start * self.chunk, self.start + ids.stop * self.chunk).filter(within)
        self.fill(request)
        marks = self._wanted(request).join(self.manifest(), ["grp", "chunk_id"])
        states = {r[0]: r[1] for r in marks.groupBy("status").agg(F.first("error")).collect()}
        if set(states) == {-1}:
            raise RuntimeError("all chunks failed: " + str(states[-1]))
        data, ids = self._data(), self.chunk_range(start, stop)
        if data is None:
            return self._ask(request, {}, start, start).limit(0)
        part = data.filter(F.col("chunk_id").between(ids.start, ids.stop - 1)).filter(within)
        rest = {k: v for k, v in request.indexers.items() if k != self.time and k in data.columns}
        part = part.join(marks.filter("status = 1").select("grp", "chunk_id", "version"), ["grp", "chunk_id", "version"], "left_semi").drop("grp", "chunk_id", "version")
        return select.select(part, rest)

    def region(self, request: Mapping | Request, value: str = "value") -> DataFrame:
        """Every group at every step of a request's span within the cube's scope, with ``value`` or null (failed chunks,
        missing samples)."""
        request = Request.of(request)
        start, stop = self.span(request)
        start, stop, step = max(start, self.start), min(stop, self.stop or stop), self.step()
        first = -((self.start - start) // step)
        n = max(0, (stop - self.start + step - timedelta(microseconds=1)) // step - first)
        times = self.spark.range(n).select(at_offset((F.col("id") + first) * micros(step), self.start).alias(self.time))
        groups = self.spark.createDataFrame([tuple(g.values()) for g in self.groups(request)], ", ".join(f"{k} string" for k in self.group_keys)) if self.group_keys else self.spark.range(1).select()
        rows = self.read(request).withColumns({k: F.col(k).cast("string") for k in self.group_keys})
        rows = rows.groupBy(*self.group_keys, self.time).agg(F.min(value).alias(value))
        return groups.crossJoin(times).join(rows, [*self.group_keys, self.time], "left")  # a grid is wanted whole

    def raw(self, request: Mapping | Request, value: str = "value", most: int = 50_000_000) -> np.ndarray:
        """The region as an array (groups x steps), missing samples NaN. Arrays of over ``most`` numbers are an error."""
        request = Request.of(request)
        rows = self.region(request, value)
        n = rows.count()
        if n > most:
            raise ValueError(f"{n} numbers are more than {most}")
        found = rows.orderBy(*self.group_keys, self.time).select(F.col(value).cast("double").alias("v")).toArrow().column("v").to_numpy()
        return found.astype(float).reshape(max(1, len(self.groups(request))), -1)

    # ---- rewriting ----

    def compact(self, files: int = 1) -> None:
        """Rewrites the sound chunks in fewer files beside the old ones and points the manifest at them."""
        marks, data = self.manifest(), self._data()
        if data is None:
            return
        sound = data.join(marks.filter("status = 1").select("grp", "chunk_id", "version"), ["grp", "chunk_id", "version"], "left_semi")
        before = marks.filter(F.col("version").startswith("v" + "0" * 8)).agg(F.min("version")).first()[0]
        version = f"v{'0' * 8}{int(before[9:]) - 1 if before else 10**8 - 1:08d}"  # sorts before all others
        sound.withColumn("version", F.lit(version)).repartition(files, "grp", "chunk_id").write.mode("append").partitionBy("grp", "chunk_id", "version").parquet(f"{self.path}/data")
        marks.filter("status = 1").withColumn("version", F.lit(version)).select("grp", "chunk_id", "status", "version", "error").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def finalize(self, files: int = 1) -> None:
        """Compacts and closes the cube: nothing is computed any more, unknown chunks have no rows."""
        self.compact(files)
        self._mark("finalized", {})


class MaterializedCube(Persister):
    """A cube without groups, asked by its range alone; ``compute`` takes (start, stop)."""

    def __init__(self, spark: SparkSession, path: str, start: datetime, chunk: timedelta, compute: Callable[[datetime, datetime], DataFrame], time: str = "ts"):
        super().__init__(spark, path, (start, None), chunk, None, time=time)
        self.compute = compute

    def _at(self, start: datetime, stop: datetime) -> Request:
        return Request({self.time: {"start": start, "stop": stop}})

    def _ask(self, request: Request, groups: Mapping[str, Any], start: datetime, stop: datetime) -> DataFrame:
        return self.compute(start, stop)

    def missing(self, start: datetime | Request, stop: datetime | None = None) -> DataFrame:
        return super().missing(start if stop is None else self._at(start, stop))

    def fill(self, start: datetime | Request, stop: datetime | None = None) -> int:
        return super().fill(start if stop is None else self._at(start, stop))

    def read(self, start: datetime | Request, stop: datetime | None = None) -> DataFrame:
        return super().read(start if stop is None else self._at(start, stop))

    def available(self, start: datetime | Request, stop: datetime | None = None) -> DataFrame:
        """(chunk_id, chunk_start, status) with 0 for chunks not computed yet."""
        return super().available(start if stop is None else self._at(start, stop)).drop("grp")


class CachedFailure(RuntimeError):
    """A request that failed, now or before."""


class RequestCache:
    """Results by the hash of their request; failures are kept as well until an update is forced."""

    def __init__(self, spark: SparkSession, path: str, compute: Callable[[Request], DataFrame] | None = None):
        self.spark, self.path, self.compute = spark, path.rstrip("/"), compute

    def state(self, request: Request) -> bool | None:
        """True for a kept result, False for a kept failure, None for neither."""
        for folder, state in (("ok", True), ("fail", False)):
            try:
                self.spark.read.parquet(f"{self.path}/{folder}/key={request.digest()}")
                return state
            except AnalysisException:
                continue
        return None

    def get(self, request: Request, force: bool = False, bypass: bool = False, made: DataFrame | None = None) -> DataFrame:
        """The result of a request; what isn't kept is computed, or taken from ``made`` where a plan made it already."""
        if bypass:
            return made if made is not None else self.compute(request)
        key, state = request.digest(), None if force else self.state(request)
        if state is False:
            raise CachedFailure(self.spark.read.parquet(f"{self.path}/fail/key={key}").first()[0])
        if state is None:
            try:
                (made if made is not None else self.compute(request)).write.mode("overwrite").parquet(f"{self.path}/ok/key={key}")
            except Exception as e:  # whatever a request fails by is kept
                self.spark.createDataFrame([(str(e)[:500],)], "error string").write.mode("overwrite").parquet(f"{self.path}/fail/key={key}")
                raise CachedFailure(str(e)[:500]) from e
        return self.spark.read.parquet(f"{self.path}/ok/key={key}")

    def get_all(self, requests: Iterable[Request]) -> DataFrame | None:
        """The results of all requests that don't fail, together; None if none has one."""
        out = None
        for request in requests:
            try:
                found = self.get(request)
            except CachedFailure:
                continue
            out = found if out is None else out.unionByName(found)
        return out


class SegmentCache:
    """Results segment by segment: a request is cut into the segments of a grid, each kept by its own hash.

    ``compute`` takes a request whose ``time`` is a ``Segments`` table and gives rows with their ``segment``, as graphs
    do; all missing segments are computed by one such request. Where it fails they are halved until what fails alone
    is kept as failed. Results of sound segments are read together, rows of overlapping ones once, and cut to the request.
    """

    MARKS = "key string, status tinyint, version string, error string"

    def __init__(self, spark: SparkSession, path: str, compute: Callable[[Request], DataFrame], size: timedelta, stride: timedelta | None = None, mode: str = "overlap", time: str = "ts"):
        self.spark, self.path, self.compute, self.time = spark, path.rstrip("/"), compute, time
        self.size, self.stride, self.mode = size, stride or size, mode

    def segments(self, request: Request) -> list[tuple[str, dict]]:
        """(key, span) of each segment that a request needs."""
        from ..operators.segments import window_starts

        at = request.indexers[self.time]
        start, stop = to_datetime(at["start"]), to_datetime(at["stop"])
        first, end = window_starts(start, stop, self.size, self.stride, self.mode)
        spans = ({"start": first + i * self.stride, "stop": first + i * self.stride + self.size} for i in range(max(0, (end - self.size - first) // self.stride + 1)))
        spans = [s for s in spans if s["start"] < stop and s["stop"] > start]
        return [(self._key(request.with_indexers(**{self.time: s})), s) for s in spans]

    def states(self, keys: Sequence[str]) -> dict[str, tuple[int, str, str]]:
        wanted = self.spark.createDataFrame([(k,) for k in keys], "key string")
        first = F.min_by(F.struct("status", "version", "error"), F.struct(-F.abs("status"), "version"))
        found = _appended(self.spark, f"{self.path}/marks", self.MARKS).join(wanted, "key").groupBy("key").agg(first.alias("x"))
        return {r["key"]: tuple(r["x"]) for r in found.collect()}

    def get(self, request: Mapping | Request) -> DataFrame:
        request = Request.of(request)
        rows = self._kept(request, self.segments(request)).drop("key")
        return (rows.distinct() if self.stride < self.size else rows).filter(select.within(self.time, request.indexers[self.time]))

    def items(self, requests: Sequence[Request]) -> DataFrame:
        """The results of ``requests`` (equal but for their spans) as they are, each with its number in ``segment``."""
        asked = [(self._key(r), dict(r.indexers[self.time])) for r in requests]
        numbers = self.spark.createDataFrame([(k, i) for i, (k, _) in enumerate(asked)], "key string, segment long")
        return self._kept(requests[0], list(dict(asked).items())).join(numbers, "key").drop("key")

    def _key(self, request: Request) -> str:
        return "k" + request.digest()

    def _kept(self, request: Request, asked: list[tuple[str, dict]]) -> DataFrame:
        """Rows of the sound ones of ``asked``, with their key; what is missing is computed first."""
        known = self.states([k for k, _ in asked])
        left = [x for x in asked if x[0] not in known]
        if left:
            self._fill(request, left)
            known = self.states([k for k, _ in asked])
        sound = [(k, known[k][1]) for k, _ in asked if known[k][0] == 1]
        if not sound:
            raise CachedFailure("all segments failed: " + "; ".join(sorted({str(x[2]) for x in known.values()})))
        rows = _parts(self.spark, f"{self.path}/data", ("key", "version"))
        marks = self.spark.createDataFrame(sound, "key string, version string")
        return rows.filter(F.col("key").isin([k for k, _ in sound])).join(marks, ["key", "version"], "left_semi").drop("version")

    def _fill(self, request: Request, segments: list[tuple[str, dict]]) -> None:
        from .graph import Segments

        version, marks = "v" + uuid.uuid4().hex, None
        try:
            spans = Segments.of(self.spark, [s for _, s in segments])
            keys = self.spark.createDataFrame([(i, k) for i, (k, _) in enumerate(segments)], "segment long, key string")
            rows = self.compute(request.with_indexers(**{self.time: spans})).join(keys, "segment").drop("segment").withColumn("version", F.lit(version))
            rows.write.mode("append").partitionBy("key", "version").parquet(f"{self.path}/data")
            marks = [(k, 1, version, None) for k, _ in segments]
        except Exception as e:  # failures are data here
            if len(segments) > 1:
                middle = len(segments) // 2
                self._fill(request, segments[:middle])
                self._fill(request, segments[middle:])
                return
            marks = [(segments[0][0], -1, version, str(e)[:500])]
        self.spark.createDataFrame(marks, self.MARKS).coalesce(1).write.mode("append").parquet(f"{self.path}/marks")


class Immutable:
    """Parquet by group, each written once and never changed; slices are read once a group is whole."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def written(self) -> DataFrame:
        return _appended(self.spark, f"{self.path}/written", ", ".join(f"{k} string" for k in self.keys)).distinct()

    def write(self, df: DataFrame) -> None:
        df = df.withColumns({k: F.col(k).cast("string") for k in self.keys})
        groups = df.select(*self.keys).distinct()
        if groups.join(self.written(), self.keys, "left_semi").limit(1).count():
            raise FileExistsError(f"{self.path} holds a group of these already")
        df.write.mode("append").partitionBy(*self.keys).parquet(f"{self.path}/data")
        groups.write.mode("append").parquet(f"{self.path}/written")

    def read(self, indexers: Mapping[str, Any]) -> DataFrame:
        """Rows at ``indexers``; an error if a group that they name wasn't written."""
        at = {k: v if isinstance(v, list | tuple) else [v] for k, v in indexers.items() if k in self.keys}
        for k, values in at.items():
            held = {r[0] for r in self.written().filter(F.col(k).isin(values)).select(k).distinct().collect()}
            if lacking := sorted(set(map(str, values)) - held):
                raise KeyError(f"{k} {lacking} not written")
        rows = _parts(self.spark, f"{self.path}/data", self.keys)
        return select.select(rows.join(self.written(), self.keys, "left_semi"), indexers)


def write_once(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet that is written once and never changed; an error if it is there."""
    df.write.mode("errorifexists").partitionBy(*keys).parquet(path)

