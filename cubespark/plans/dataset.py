"""Datasets: requests by index, and models over their items."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import index_join
from ..request import Request, to_datetime
from .graph import Node, Segments, compute


class Recorder(Node):
    """Notes the requests that reach it while a graph is planned, and passes them on."""

    def __init__(self, *inputs: Node, **config: Any):
        super().__init__(*inputs, **config)
        self.requests: list[Request] = []

    def plan(self, request: Request) -> list[Request]:
        self.requests.append(request)
        return [request] * len(self.inputs)

    def transform(self, spark: SparkSession, frames: list, request: Request) -> DataFrame:
        return frames[0]


class RequestDataset:
    """Items 0 .. n-1 of one or more streams (frames with the column ``index``), some of them invalid.

    ``transforms`` are applied to the joined rows, in order.
    """

    def __init__(self, requests: Sequence[Request], *streams: DataFrame, invalid: DataFrame | None = None, transforms: Sequence[Callable[[DataFrame], DataFrame]] = ()):
        self.requests, self.streams, self.invalid, self.transforms = list(requests), list(streams), invalid, list(transforms)

    @classmethod
    def from_components(cls, spark: SparkSession, requests: Sequence[Mapping | Request], *ends: Node, cache: Any = None, time: str = "ts") -> RequestDataset:
        """Streams of the results of ``ends`` for ``requests``, which differ in their spans of ``time`` only.

        All items of a stream are one plan: the spans are a table, results carry their number as ``index``. With a
        ``cache``, a function from an end to a ``materialize.SegmentCache``, each item's rows are kept and computed once.
        """
        asked = [Request.of(r) for r in requests]
        rest = {Request({k: v for k, v in r.indexers.items() if k != time}, r.config).canonical() for r in asked}
        if len(rest) > 1:
            raise ValueError(f"requests differ in more than {time}")
        if not asked:
            raise ValueError("no requests")
        spans = Segments.of(spark, [r.indexers[time] for r in asked])
        whole = asked[0].with_indexers(**{time: spans})
        streams = []
        for end in ends:
            rows = compute(spark, end, whole) if cache is None else cache(end).items(asked)
            streams.append(rows.withColumnRenamed("segment", "index"))
        return cls(asked, *streams)

    @classmethod
    def load(cls, spark: SparkSession, path: str, *streams: DataFrame, **how: Any) -> RequestDataset:
        """The requests of a folder that ``save`` wrote, in their order."""
        rows = spark.read.json(path, schema="index long, request string").orderBy("index").collect()

        def back(value: Any) -> Any:
            if isinstance(value, dict):
                return {k: to_datetime(v) if k in ("start", "stop") and isinstance(v, str) else back(v) for k, v in value.items()}
            return value

        found = [json.loads(r["request"]) for r in rows]
        return cls([Request(back(x["indexers"]), back(x["config"])) for x in found], *streams, **how)

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON line a request."""
        self.requests_frame(spark).write.mode("overwrite").json(path)

    def __len__(self) -> int:
        return len(self.requests)

    def __getitem__(self, index: int) -> DataFrame:
        """One item's rows; an index out of range or invalid is an error."""
        if not 0 <= index < len(self) and self.requests:
            raise IndexError(index)
        if self.invalid is not None and self.invalid.filter(F.col("index") == index).limit(1).count():
            raise ValueError(f"item {index} is invalid")
        return self._applied(index_join([s.filter(F.col("index") == index) for s in self.streams], "index"))

    def _applied(self, rows: DataFrame) -> DataFrame:
        for f in self.transforms:
            rows = f(rows)
        return rows

    def _with(self, *streams: DataFrame, **how: Any) -> RequestDataset:
        return RequestDataset(self.requests, *(streams or self.streams), **{"invalid": self.invalid, "transforms": self.transforms} | how)

    def rows(self) -> DataFrame:
        return self._applied(index_join(self.streams, "index", self.invalid))

    def transformed(self, *functions: Callable[[DataFrame], DataFrame]) -> RequestDataset:
        return self._with(transforms=[*self.transforms, *functions])

    def mask_invalid(self, invalid: DataFrame) -> RequestDataset:
        invalid = invalid.select("index")
        return self._with(invalid=self.invalid.union(invalid) if self.invalid is not None else invalid)

    def check_validity(self, sound: Column) -> RequestDataset:
        """Without the items that have a row which isn't ``sound``, and without requests that a stream has no row of.

        Rows are first made one an item where they lie, so no task holds an item's rows.
        """
        rows = index_join(self.streams, "index", self.invalid)
        found = rows.select("index", F.coalesce(sound, F.lit(False)).alias("_sound")).groupBy("index").agg(F.min("_sound").alias("_sound"))
        if self.requests:
            found = found.join(rows.sparkSession.range(len(self)).select(F.col("id").alias("index")), "index", "full")
        return self.mask_invalid(found.filter(~F.coalesce("_sound", F.lit(False))))

    def preload(self, path: str) -> RequestDataset:
        """Its streams written to ``path`` once, by index, and read from there."""
        spark, out = self.streams[0].sparkSession, []
        for i, s in enumerate(self.streams):
            s.write.mode("overwrite").parquet(f"{path.rstrip('/')}/stream={i}")
            out.append(spark.read.schema(s.schema).parquet(f"{path.rstrip('/')}/stream={i}"))
        return self._with(*out)

    def join(self, other: RequestDataset) -> RequestDataset:
        both = self.mask_invalid(other.invalid) if other.invalid is not None else self
        return both._with(*self.streams, *other.streams, transforms=[*self.transforms, *other.transforms])

    def requests_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, r.canonical()) for i, r in enumerate(self.requests)], "index long, request string")


def infer(items: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, batch: int = 256, skip_failed: bool = False) -> DataFrame:
    """The rows of a model's answers to batches of ``items``; ``load`` makes the model once a task. Last batches are short.

    With ``skip_failed`` a batch that fails is asked again item by item, and items that fail alone have no answer.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch]
                try:
                    yield model(some)
                except Exception:
                    if not skip_failed:
                        raise
                    yield from _one_by_one(model, some)

    return items.mapInPandas(run, schema)


def _one_by_one(model: Callable[[pd.DataFrame], pd.DataFrame], frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for i in range(len(frame)):
        try:
            yield model(frame.iloc[i : i + 1])
        except Exception:  # asked for by skip_failed
            continue


def infer_segments(
    spark: SparkSession, end: Node, request: Mapping | Request, segments: Segments, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str,
    keys: Sequence[str] = (), value: str = "value", batch: int = 256, length: int | None = None,
) -> DataFrame:
    """A model's answers to the results of ``end`` on each of ``segments``.

    An item is a segment (and ``keys``) with the array ``item`` of its values in time order; items of another length
    than ``length`` are left out, as are those that the model fails on. All segments are one plan.
    """
    rows = compute(spark, end, Request.of(request).with_indexers(ts=segments))
    items = rows.groupBy("segment", *keys).agg(F.sort_array(F.collect_list(F.struct("ts", value))).alias("_p")).select("segment", *keys, F.col(f"_p.{value}").alias("item"))
    return infer(items.filter(F.size("item") == length) if length is not None else items, load, schema, batch, skip_failed=True)


def targets(df: DataFrame, scores: str, classes: Sequence[str], least: float = 0.5, out: str = "targets") -> DataFrame:
    """``df`` with ``out``: a map from each class to whether its score reaches ``least``."""
    flags = [x for i, c in enumerate(classes) for x in (F.lit(c), F.coalesce(F.get(scores, i) >= least, F.lit(False)))]
    return df.withColumn(out, F.create_map(*flags))

