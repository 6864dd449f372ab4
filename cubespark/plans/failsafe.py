"""Failures as data: status 0 missing, 1 sound, -1 failed, and an error text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("fail", "warning", "ignore")


def guarded(df: DataFrame, value: Column, out: str, failed: Column, error: Column | str, mode: str = "warning") -> DataFrame:
    """``df`` with ``out``, status and error. ``fail`` stops at the first failed row, ``warning`` keeps failed rows
    with a null value, ``ignore`` drops them. A null value that hasn't failed is missing."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    bad, text = F.coalesce(failed, F.lit(False)), F.lit(error) if isinstance(error, str) else error
    if mode == "fail":
        return df.withColumn(out, F.when(bad, F.raise_error(text).cast("string").cast(df.select(value.alias("v")).schema["v"].dataType)).otherwise(value)).withColumns({"status": F.lit(1).cast("tinyint"), "error": F.lit(None).cast("string")})
    found = df.withColumn(out, F.when(~bad, value)).withColumn("status", F.when(bad, -1).when(F.col(out).isNull(), 0).otherwise(1).cast("tinyint")).withColumn("error", F.when(bad, text))
    return found.filter("status <> -1") if mode == "ignore" else found


def sound_arrays(array: str, length: int) -> Column:
    """Whether an array has this length, no null and no NaN."""
    return (F.size(array) == length) & F.forall(array, lambda x: x.isNotNull() & ~F.isnan(x))


def flags(df: DataFrame, keys: list[str], value: Column, **rules: tuple[str, Column]) -> DataFrame:
    """(keys, n, flags): how many values are there, and for each rule whether ``all`` or ``any`` of them hold it."""
    fold = {"all": F.bool_and, "any": F.bool_or}
    return df.groupBy(*keys).agg(F.count(value).alias("n"), *(fold[how](rule).alias(name) for name, (how, rule) in rules.items()))
