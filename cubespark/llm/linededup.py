"""Line dedup: overlapping windows of three lines, found globally by hash; later occurrences go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Lines in a window.
LINES = 3


def _windows(lines: Column) -> Column:
    """(pos, h1, h2) of each window of ``lines`` that has a word. Two 64-bit hashes stand for its text."""
    at = lambda i, k: F.get(lines, i + k)
    has_word = lambda i: F.concat(at(i, 0), at(i, 1), at(i, 2)).rlike(r"[^\x20\x09-\x0D]")
    positions = F.when(F.size(lines) >= LINES, F.sequence(F.lit(0), F.size(lines) - LINES)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.struct(i.alias("pos"), F.xxhash64(at(i, 0), at(i, 1), at(i, 2)).alias("h1"), F.xxhash64(F.lit(1), at(i, 2), at(i, 1), at(i, 0)).alias("h2"))
    return F.transform(F.filter(positions, has_word), window)


def repeated_positions(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, gone): the positions of lines that later occurrences of repeated windows cover."""
    seen = (
        docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
        .filter(F.size("lines") >= LINES)
        .select("doc_id", "text_hash", F.explode(_windows(F.col("lines"))).alias("w"))
        .select("doc_id", "text_hash", "w.*")
    )
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "pos")
    firsts = seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("end")).filter("first <> end").select("h1", "h2", "first")
    later = seen.join(firsts, ["h1", "h2"]).filter(place != F.col("first"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + LINES - 1))))
    return later.groupBy("doc_id", "text_hash").agg(covered.alias("gone"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", names: tuple[str, str, str] = ("n_lines", "n_removed", "kept_text")) -> DataFrame:
    """``docs`` with n_lines, n_removed and kept_text (``names``): each text without the later occurrences of windows of
    three lines.

    Lines end at ``\\n`` and are compared exactly. Occurrences are ordered by (doc_id, hash of the text, position),
    null ids last; all lines that later ones cover go, and every line that goes has its like at an earlier place. Where
    a later occurrence overlaps the first, the lines that they share go too: of ``a a a a b`` stay ``a b``. Windows without a word are left alone, so blank lines never count as a
    passage. Texts of fewer than three lines have no window and stay whole. Null text: n_lines 0, kept_text null;
    the empty text is one empty line. Rows equal in id and text are one document and get the same result. An empty
    table gives an empty table; columns named like the new ones are replaced.
    """
    gone = repeated_positions(docs, text, key)
    of_id, of_hash, covered = fresh(docs, "_id", "_hash", "_gone")
    gone = gone.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("gone").alias(covered))
    same = F.col(key).eqNullSafe(F.col(of_id)) & (F.xxhash64(F.col(text)) == F.col(of_hash))
    lines = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    kept = F.when(F.col(covered).isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    made = (F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"), F.coalesce(F.size(covered), F.lit(0)).cast("long"), kept)
    return docs.join(gone, same, "left").withColumns(dict(zip(names, made, strict=True))).drop(of_id, of_hash, covered)
