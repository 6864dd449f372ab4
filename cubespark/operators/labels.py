"""Labels of dataset items: multi-hot vectors, statistics, caps, splits and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multi_hot(df: DataFrame, index: str, label: str, classes: list[str], misc: str | None = None) -> DataFrame:
    """A 0/1 column for each class over the labels of each index; ``misc`` is 0 where another class is 1."""
    flags = df.groupBy(index).agg(*(F.coalesce(F.max((F.col(label) == c).cast("int")), F.lit(0)).alias(c) for c in classes))
    if misc is None:
        return flags
    other = F.greatest(*(F.col(c) for c in classes if c != misc), F.lit(0))
    return flags.withColumn(misc, F.when(other == 1, 0).otherwise(F.col(misc)))


def label_counts(flags: DataFrame, classes: list[str]) -> DataFrame:
    """(label, n) of each class and of ``none``."""
    total = flags.agg(*(F.sum(c).alias(c) for c in classes), F.count_if(F.greatest(*classes, F.lit(0)) == 0).alias("none"))
    names = [*classes, "none"]
    return total.select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n")) for c in names))).alias("_x")).select("_x.*")


def labels_per_item(flags: DataFrame, classes: list[str]) -> DataFrame:
    """(n_labels, n): how many items have so many labels."""
    many = sum((F.col(c) for c in classes), F.lit(0)).cast("long")
    return flags.groupBy(many.alias("n_labels")).agg(F.count(F.lit(1)).alias("n"))


def cap_per_tag(df: DataFrame, tag: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each tag; Spark keeps that many a task before it shuffles."""
    nth = F.row_number().over(Window.partitionBy(tag).orderBy(order))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")


def split_at(df: DataFrame, index: str, n: int, train: tuple[int, int] = (3, 4)) -> DataFrame:
    """``df`` with part ``train`` for the first 3/4 of ``n`` indices, ``test`` for the others."""
    return df.withColumn("part", F.when(F.col(index) < n * train[0] // train[1], "train").otherwise("test"))


def confusion(df: DataFrame, label: str, predicted: str, classes: list[int]) -> DataFrame:
    """(label, p_0, p_1, ..): counts of predictions by label."""
    wide = df.groupBy(F.col(label).alias("label")).pivot(predicted, classes).agg(F.count(F.lit(1)))
    return wide.select("label", *(F.coalesce(F.col(str(c)), F.lit(0)).cast("long").alias(f"p_{c}") for c in classes))


def accuracy(df: DataFrame, label: Column | str, predicted: Column | str) -> DataFrame:
    """(accuracy): the share of rows whose prediction is their label; null without rows."""
    same = (F.col(label) if isinstance(label, str) else label).eqNullSafe(F.col(predicted) if isinstance(predicted, str) else predicted)
    return df.agg(F.avg(same.cast("double")).alias("accuracy"))
