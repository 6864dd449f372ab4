"""Task graphs: requests are planned from the result back to the sources, DataFrames are built the other way."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import align_ceil, align_floor, at_offset, grid_index, micros, offset
from ..operators import downsample, joins, select, spectral
from ..request import Request, to_datetime
from ..settings import current
from .failsafe import MODES


class Segments:
    """Many spans of time asked at once: a table (segment, start, stop).

    As an indexer it fans a graph out in rows, not in copies of the plan: sources deliver the rows of each segment
    with its number in ``segment``, and the steps after them take that as one more key.
    """

    def __init__(self, table: DataFrame, mark: str | None = None):
        self.table, self.mark = table.select("segment", "start", "stop"), mark or uuid.uuid4().hex

    @classmethod
    def of(cls, spark: SparkSession, spans: Iterable[Mapping[str, Any]]) -> Segments:
        rows = [(i, to_datetime(x["start"]), to_datetime(x["stop"])) for i, x in enumerate(spans)]
        return cls(spark.createDataFrame(rows, "segment long, start timestamp_ntz, stop timestamp_ntz"))

    def widened(self, width: timedelta, halo: timedelta) -> Segments:
        """Each span with ``halo`` on either side, on whole cells of ``width``."""
        w, more = micros(width), F.lit(micros(halo))
        start = at_offset(grid_index(F.timestamp_add("MICROSECOND", -more, "start"), width) * w)
        end = F.timestamp_add("MICROSECOND", more + F.lit(w - 1), "stop")
        return Segments(self.table.select("segment", start.alias("start"), at_offset(grid_index(end, width) * w).alias("stop")), f"{self.mark}+{width}+{halo}")

    def cover(self) -> tuple[dict, timedelta]:
        """The span that holds all of them, and their mean length."""
        length = offset("stop") - offset("start")
        r = self.table.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.avg(length).alias("mean")).first()
        return {"start": r["start"] or datetime(1970, 1, 1), "stop": r["stop"] or datetime(1970, 1, 1)}, timedelta(microseconds=int(r["mean"] or 1))

    def tag(self, rows: DataFrame, mean: timedelta) -> DataFrame:
        return joins.rows_within(rows, self.table, max(mean / 8, timedelta(milliseconds=1)))

    def slice(self, tagged: DataFrame) -> DataFrame:
        """Rows that lie in their segment."""
        spans = self.table.select("segment", F.col("start").alias("_from"), F.col("stop").alias("_to"))
        return tagged.join(spans, "segment").filter((F.col("ts") >= F.col("_from")) & (F.col("ts") < F.col("_to"))).drop("_from", "_to")


@dataclass(frozen=True)
class Splice:
    """In a plan: a new node, made from the input, is asked instead of the input."""

    make: Callable[[Node], Node]
    request: Request


class Node:
    """A step with a name. ``plan`` says what its inputs must deliver for a request; ``transform`` builds its result.

    A plan has an entry for each input: a request; a list of requests (``transform`` gets a list of frames); None for
    an input that isn't needed (``transform`` gets None, the branch isn't built); or a ``Splice``. ``fail_mode`` tells
    what becomes of an error while the step is planned or built: ``fail`` raises it, ``warning`` and ``ignore`` put
    None in the place of the result, with or without a warning; a step all of whose wanted inputs are None by
    failure has no result either; without one the settings' mode holds. Errors of rows are data, see ``failsafe``.
    """

    def __init__(self, *inputs: Node, name: str | None = None, fail_mode: str | None = None, **config: Any):
        self.inputs, self.config, self.fail_mode = inputs, config, fail_mode or current().fail_mode
        self.name = name or type(self).__name__
        if "+" in self.name:
            raise ValueError(f"no + in names: {self.name}")
        if self.fail_mode not in MODES:
            raise ValueError(f"unknown mode {fail_mode!r}")

    def settings(self, request: Request) -> dict:
        return request.config_for(self.name, type(self).__name__, self.config)

    def plan(self, request: Request) -> Sequence[Request | Sequence[Request] | Splice | None]:
        return [request] * len(self.inputs)

    def transform(self, spark: SparkSession, frames: list, request: Request) -> DataFrame:
        raise NotImplementedError


class Source(Node):
    """A Parquet table of series; the request's indexers become predicates of its scan.

    An indexer without a column is an error unless ``ignore`` names it.
    """

    def transform(self, spark: SparkSession, frames: list, request: Request) -> DataFrame:
        table = spark.read.parquet(self.settings(request)["path"])
        names = self.config.get("columns", {})
        unknown = {k for k in request.indexers if names.get(k, k) not in table.columns} - set(self.config.get("ignore", ()))
        if unknown:
            raise ValueError(f"{self.name} has no column for {sorted(unknown)}")
        known = {k: v for k, v in request.indexers.items() if names.get(k, k) in table.columns}
        many = known.get("ts") if isinstance(known.get("ts"), Segments) else None
        if many is not None:
            known["ts"], mean = many.cover()
        found = select.select(table, known, self.config.get("closed", "left"), names)
        found = found.select(*(F.col(names.get(c, c)).alias(c) for c in self.config["keep"])) if "keep" in self.config else found
        return many.tag(found, mean) if many is not None else found


class Apply(Node):
    """Any function from frames (and settings, if it takes them) to a frame."""

    def __init__(self, function: Callable[..., DataFrame], *inputs: Node, name: str | None = None, **config: Any):
        super().__init__(*inputs, name=name or function.__name__, **config)
        self.function = function

    def transform(self, spark: SparkSession, frames: list, request: Request) -> DataFrame:
        return self.function(*frames, **self.config)


class Windowed(Node):
    """A step over a grid of windows: inputs deliver whole windows and a halo, results are sliced to the request."""

    def width(self, settings: Mapping[str, Any]) -> timedelta:
        return settings["width"]

    def halo(self, settings: Mapping[str, Any]) -> timedelta:
        return timedelta(0)

    def keys(self, request: Request) -> list[str]:
        return [*self.settings(request)["keys"], *(["segment"] if isinstance(request.indexers.get("ts"), Segments) else [])]

    def plan(self, request: Request) -> Sequence[Request | Sequence[Request] | Splice | None]:
        span, settings = request.indexers.get("ts"), self.settings(request)
        w, halo = self.width(settings), self.halo(settings)
        if isinstance(span, Segments):
            return [request.with_indexers(ts=span.widened(w, halo))] * len(self.inputs)
        if not isinstance(span, Mapping):
            return super().plan(request)
        wide = dict(span)
        if span.get("start") is not None:
            wide["start"] = align_floor(to_datetime(span["start"]) - halo, w)
        if span.get("stop") is not None:
            wide["stop"] = align_ceil(to_datetime(span["stop"]) + halo, w)
        return [request.with_indexers(ts=wide)] * len(self.inputs)

    def sliced(self, df: DataFrame, request: Request) -> DataFrame:
        span = request.indexers.get("ts")
        if isinstance(span, Segments):
            return span.slice(df)
        return df.filter(select.within("ts", span)) if isinstance(span, Mapping) else df


class MaxDownsample(Windowed):
    def transform(self, spark: SparkSession, frames: list, request: Request) -> DataFrame:
        s = self.settings(request)
        return self.sliced(downsample.max_by_time(frames[0], self.keys(request), s["width"]), request)


class MinMaxDownsample(Windowed):
    def transform(self, spark: SparkSession, frames: list, request: Request) -> DataFrame:
        s = self.settings(request)
        return self.sliced(downsample.minmax_by_time(frames[0], self.keys(request), s["width"]), request)


class Lttb(Node):
    """Settings: keys, factor. Cells are counted from the first sample that the request holds."""

    def transform(self, spark: SparkSession, frames: list, request: Request) -> DataFrame:
        s = self.settings(request)
        keys = [*s["keys"], *(["segment"] if isinstance(request.indexers.get("ts"), Segments) else [])]
        return downsample.lttb_anchored(frames[0], keys, s["factor"])


class Cached(Node):
    """Its input's result by request, kept in a ``RequestCache``; what is kept prunes the input."""

    def __init__(self, input: Node, cache: Any, **config: Any):
        super().__init__(input, **config)
        self.cache = cache

    def plan(self, request: Request) -> Sequence[Request | Sequence[Request] | Splice | None]:
        return [None if self.cache.state(request) is not None else request]

    def transform(self, spark: SparkSession, frames: list, request: Request) -> DataFrame:
        return self.cache.get(request, made=frames[0])


class Stored(Node):
    """Its input's result in a cube of chunks (``materialize.Persister``): only missing chunks ask the input."""

    def __init__(self, input: Node, cube: Any, **config: Any):
        super().__init__(input, **config)
        self.cube = cube

    def plan(self, request: Request) -> Sequence[Request | Sequence[Request] | Splice | None]:
        return [None]

    def transform(self, spark: SparkSession, frames: list, request: Request) -> DataFrame:
        self.cube.compute = lambda r: compute(spark, self.inputs[0], r)
        return self.cube.read(request)


class Spectrogram(Windowed):
    """Settings: keys, nfft, stride, rate (samples a second) and those of ``spectral.stft``."""

    def width(self, settings: Mapping[str, Any]) -> timedelta:
        return timedelta(seconds=settings["stride"] / settings["rate"])

    def halo(self, settings: Mapping[str, Any]) -> timedelta:
        return timedelta(seconds=settings["nfft"] / settings["rate"])

    def transform(self, spark: SparkSession, frames: list, request: Request) -> DataFrame:
        s, keys = self.settings(request), self.keys(request)
        step = micros(timedelta(seconds=1 / s["rate"]))
        base = F.call_function("div", offset("ts"), F.lit(step))
        # frames are numbered from a grid line far before all samples, so that indices are never negative
        shift = 1 << 40
        rows = frames[0].withColumn("i", base + shift // s["stride"] * s["stride"])
        how = {k: s[k] for k in ("window", "detrend", "scaling", "mode") if k in s}
        out = spectral.stft(rows, keys, s["nfft"], s["stride"], s["rate"], **how)
        first = F.col("frame") * s["stride"] - shift // s["stride"] * s["stride"]
        return self.sliced(out.select(*keys, at_offset((first + s["nfft"] // 2) * step).alias("ts"), "spectrum"), request)


def nodes_of(*ends: Node) -> list[Node]:
    """All nodes, sources first, each once."""
    out: list[Node] = []

    def visit(node: Node) -> None:
        if node not in out:
            for x in node.inputs:
                visit(x)
            if node not in out:
                out.append(node)

    for end in ends:
        visit(end)
    return out


def edges_of(*ends: Node) -> list[tuple[str, str]]:
    return [(x.name, node.name) for node in nodes_of(*ends) for x in node.inputs]


def find(end: Node, name: str) -> Node:
    """The node of a name, or whose name before ``+`` it is."""
    for node in nodes_of(end):
        if name in (node.name, node.name.split("+")[0]):
            return node
    raise KeyError(name)


def compute(spark: SparkSession, end: Node | Sequence[Node], request: Mapping | Request | Sequence[Mapping | Request], only: Sequence[str] = (), merge: bool = False) -> Any:
    """The lazy result of ``end`` for ``request``, or of the nodes named in ``only``.

    Several ends (with one request, or one each) give a list of results of one plan: equal requests to a node share
    what it builds. With ``merge`` a source that is asked for several ranges is scanned once, for a range that covers
    them, and each taker gets its slice.
    """
    ends = list(end) if isinstance(end, Sequence) else [end]
    asked = [Request.of(r) for r in request] if isinstance(request, Sequence) else [Request.of(request)] * len(ends)
    if len(asked) != len(ends):
        raise ValueError(f"{len(ends)} ends and {len(asked)} requests")
    done: dict[tuple[int, str], DataFrame | None] = {}
    seen: dict[str, DataFrame | None] = {}
    spliced: dict[tuple[int, int, str], Node] = {}
    covers = _covers(ends, asked) if merge else {}

    def deliver(node: Node, entry: Any, taker: Node) -> Any:
        if entry is None or isinstance(entry, Request):
            return None if entry is None else build(node, entry)
        if isinstance(entry, Splice):
            new = spliced.setdefault((id(node), id(taker), entry.request.canonical()), entry.make(node))
            return build(new, entry.request)
        return [build(node, r) for r in entry]

    def build(node: Node, at: Request) -> DataFrame | None:
        mark = (id(node), at.canonical())
        if mark not in done:
            if (wide := covers.get(id(node))) is not None and wide.canonical() != at.canonical():
                names = node.config.get("columns", {}) if "keep" not in node.config else {}
                done[mark] = select.select(build(node, wide), {k: v for k, v in at.indexers.items() if isinstance(v, Mapping)}, node.config.get("closed", "left"), names)
            else:
                done[mark] = _guarded(node, at, deliver, spark)
            seen[node.name] = done[mark]
        return done[mark]

    out = [build(x, r) for x, r in zip(ends, asked, strict=True)]
    if only:
        return {find(ends[0], n).name: seen[find(ends[0], n).name] for n in only}
    return out if isinstance(end, Sequence) else out[0]


def _guarded(node: Node, at: Request, deliver: Callable, spark: SparkSession) -> DataFrame | None:
    """The result of a node under its fail mode."""
    try:
        plan = node.plan(at)
        frames = [deliver(x, entry, node) for x, entry in zip(node.inputs, plan, strict=True)]
        wanted = [f for f, entry in zip(frames, plan, strict=True) if entry is not None]
        if wanted and all(f is None for f in wanted):
            return None
        return node.transform(spark, frames, at)
    except Exception as e:  # an error of one step is a value for the others, unless it shall stop them
        if node.fail_mode == "fail":
            raise
        if node.fail_mode == "warning":
            warnings.warn(f"{node.name}: {e}", stacklevel=2)
        return None


def _covers(ends: Sequence[Node], asked: Sequence[Request]) -> dict[int, Request]:
    """For each source that is asked for several ranges, one request that covers them; none where they differ in more."""
    found: dict[int, list[Request]] = {}

    def visit(node: Node, at: Request) -> None:
        if not node.inputs:
            found.setdefault(id(node), []).append(at)
        for x, entry in zip(node.inputs, node.plan(at), strict=True):
            for r in [entry] if isinstance(entry, Request) else entry if isinstance(entry, Sequence) else []:
                visit(x, r)

    for end, at in zip(ends, asked, strict=True):
        visit(end, at)
    out = {}
    for key, requests in found.items():
        try:
            wide = requests[0]
            for r in requests[1:]:
                wide = wide.covering(r)
            out[key] = wide
        except ValueError:
            continue
    return out


def eager(node: Node, spark: SparkSession, frames: list[DataFrame], request: Mapping | Request) -> DataFrame:
    """One node by itself: no planning, no halo."""
    return node.transform(spark, frames, Request.of(request))


def probe(spark: SparkSession, end: Node, request: Mapping | Request, name: str | None = None, n: int | None = None) -> dict:
    """For a look at a step: the first ``n`` rows of the node ``name`` (default ``end``) under ``request``, its columns
    and its plan."""
    found = compute(spark, end, request, only=[name or end.name])
    (df,) = found.values()
    return {"columns": df.columns, "rows": df.limit(n or current().probe_rows).collect(), "plan": df._jdf.queryExecution().toString()}


def span(start: datetime | str, stop: datetime | str) -> dict:
    return {"start": to_datetime(start), "stop": to_datetime(stop)}
