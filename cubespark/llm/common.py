"""What the operators share: shared-folder checkpoints, size-checked broadcasts, text bytes, safe cuts."""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import folder

#: A table of at most so many narrow rows is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000

#: White space of the word contracts; what stands between is a word.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir, so that lost executors cost no recomputation.

    Meant for narrow tables: rows are written as they are. With spark.cleaner.referenceTracking.cleanCheckpoints the
    session deletes them once nothing refers to them any more.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read again: columns that aren't asked for aren't read."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Deletes a folder, now or when the session ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_exit:
        files.mkdirs(at)
        files.deleteOnExit(at)
    else:
        files.delete(at, True)


_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by a Python worker for its next batches. Workers live on from stage to stage, so what another
    operator has left there goes."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt anew over all cores if it is read in fewer parts than there are cores, as small files are; else as it
    is, and also if a shuffle deals it out already."""
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` changed so that no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` allow; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(texts: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text, null as empty, one at a time. Arrow gives what the last batch held back to the system."""
    pa.default_memory_pool().release_unused()
    for x in texts.cast(pa.large_binary()):
        yield x.as_py() or b""


#: A letter or digit before an ASCII blank or a mark: no token of the public patterns reaches over it, nor does
#: a special string.
SAFE = re.compile(r"[A-Za-z0-9぀-ヿ一-鿿](?=[ \n.,;:!?()、。，])")


def safe_pieces(text: str, limit: int) -> Iterator[str]:
    """``text`` in pieces of about ``limit`` characters, cut only where tokens never join; without such a place
    the rest stays whole."""
    start = 0
    while len(text) - start > limit:
        found = SAFE.search(text, start + limit)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text
