"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, maybe_broadcast, word_count

#: Levels of the search for each source's last slot, and bits a level: rows whose ranks agree to 36 bits share a slot.
LEVELS, BITS = 3, 12


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``df`` with ``nth``, the place of each row in ``order`` from 1 on, and each of ``sums`` over the rows before it.

    Rows are dealt by ranges of ``order``, which tells all rows apart; what stands before a range comes from a window
    over one row a range. So no task holds all rows.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = parts.groupBy("_range").agg(F.count(F.lit(1)).alias("_nth"), *(F.sum(x).alias(f"_{k}") for k, x in sums.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_range").alias("_of"), *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in ("nth", *sums)))
    inside = Window.partitionBy("_range").orderBy(*order)
    rows = parts.withColumn("nth", F.row_number().over(inside).cast("long"))
    rows = rows.withColumns({k: F.coalesce(F.sum(x).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for k, x in sums.items()})
    rows = rows.join(F.broadcast(totals), F.col("_range") == F.col("_of"))  # a row a range
    return rows.withColumns({k: F.col(k) + F.col(f"_{k}") for k in ("nth", *sums)}).drop("_range", "_of", *(f"_{k}" for k in ("nth", *sums)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Targets for ``sizes`` (source, source_size): ``share`` of all sizes, dealt by the repeating ``weights``.

    Sources count by code point, null last. A target stops at ``most`` times its source's size and the excess is
    dealt again by weight: the sources in order of size over weight fill up first, and one water level holds for
    the others. Sources may be as many as rows.
    """
    up, down = share
    name = F.col("source").asc_nulls_last()
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    named = running(sizes, [name]).withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * most).drop("nth")
    words, all_weights = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    filled = running(named, [(F.col("source_size") / F.col("weight")).asc(), name], before=F.col("cap"), passed=F.col("weight"))
    left = cut(
        filled.withColumn("words_left", F.lit(words * up) - F.col("before") * down)
        .withColumn("weights_left", F.lit(all_weights) - F.col("passed"))
        .withColumn("full", F.col("weight") * F.col("words_left") >= F.col("cap") * F.col("weights_left") * down)
    )
    level = left.filter(~F.col("full")).agg(F.min(F.struct("nth", "words_left", "weights_left")).alias("x")).first()["x"]
    flows = (F.col("weight") * F.lit(level["words_left"])).cast("double") / F.lit(float(level["weights_left"] * down)) if level else F.lit(None).cast("double")
    return left.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(flows).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts: reruns and other engines agree."""
    text = F.concat_ws("|", *(F.coalesce(x.cast("string"), F.lit("~")) for x in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def length_weight(text: Column) -> Column:
    """The bits of a text's number of words: a document twice as long weighs one more. Whole numbers sum up exactly."""
    return F.length(F.bin(word_count(text))).cast("double")


def _step(weigh: int):
    """A walk over sorted slots that ends in the one that passes the need (1) or whose middle passes it (2)."""

    def step(a: Column, x: Column) -> Column:
        passed = weigh * a["taken"] + x["words"] > weigh * F.col("need")
        here = F.struct(a["taken"].alias("taken"), x["at"].alias("prefix"), F.lit(True).alias("done"))
        on = F.struct((a["taken"] + x["words"]).alias("taken"), (x["at"] + 1).alias("prefix"), F.lit(False).alias("done"))
        return F.when(a["done"], a).when(passed, here).otherwise(on)

    return step


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", doc_weight: Column | None = None, most: int = 2, **targets
) -> DataFrame:
    """Copies of each row of ``docs`` (key, size, source, source_size, target, copies) that bring each source near its target.

    A source's target over its size is the expected number e of copies of its words: floor(e) whole copies of each
    row are certain. The rest of e, times the row's ``doc_weight`` (default 1) over its source's mean by words, is
    the row's inclusion probability p, 1 at most: rows are ranked by (u / (1 - u)) / (p / (1 - p)), u a fixed random
    number of the row, and the lowest ranks take one copy more until the words taken are as near the target as whole
    rows allow. That is Pareto's order sampling of a fixed size, the size counted in words. The last rank taken is
    found by histograms of 4,096 slots a level, so no task ever holds the rows of a source.

    Null or empty texts have size 0; they take their copies like others and add no words; a null weight counts as 0. Rows with null keys or
    sources, and repeated rows, are rows like others; rows of equal key and size share their random number and
    are taken together. An empty table gives an empty table. Other columns of ``docs`` are not looked at.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), (doc_weight if doc_weight is not None else F.lit(1.0)).cast("double").alias("tilt"))
    rows = cut(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.coalesce("tilt", F.lit(0.0))).alias("tilted"))
    sizes = cut(sizes)
    per = source_targets(sizes.select("source", "source_size"), most=most, **targets)
    per = cut(per.join(sizes.select(F.col("source").alias("of"), "tilted"), F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    n = per.count()
    per = per.withColumnsRenamed({"source": "of"})

    ratio = lambda up, down: F.when(F.col(down) > 0, F.col(up) / F.col(down)).otherwise(0.0)
    part = (F.col("expected") - F.col("whole")) * F.coalesce(F.col("tilt") * ratio("source_size", "tilted"), F.lit(0.0))
    u = _uniform(F.col("doc_id"), F.col("size"))
    p = F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))
    rank = u * (1 - F.col("p")) / (u * (1 - F.col("p")) + (1 - u) * F.col("p"))  # odds / (1 + odds): the same order, within 0 and 1
    dealt = (
        rows.join(maybe_broadcast(per, n), F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("expected", ratio("target", "source_size"))
        .withColumn("whole", F.floor("expected"))
        .withColumn("p", p)
        .withColumn("slot", F.least(F.floor(rank * F.lit(float(1 << LEVELS * BITS))), F.lit((1 << LEVELS * BITS) - 1)).cast("long"))
        .withColumn("extra", (F.col("whole") < most).cast("long") * F.col("size"))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "slot", "extra")
    )
    dealt = cut(dealt)

    # of: source; need: words wanted beyond the whole copies; all slots below prefix are taken and hold ``taken`` words
    zero = F.lit(0).cast("long")
    last = dealt.groupBy(F.col("source").alias("of")).agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("need"))
    last = cut(last.withColumns({"taken": zero, "prefix": zero}))
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * BITS
        inside = F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("slot", shift + BITS) == F.col("prefix"))
        counted = (
            dealt.join(maybe_broadcast(last, n), inside)
            .groupBy("of", F.shiftright("slot", shift).alias("at"))
            .agg(F.sum("extra").alias("words"))
            .groupBy(F.col("of").alias("with"))
            .agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("slots"))  # 4,096 at most
        )
        walk = F.aggregate(
            F.coalesce("slots", F.array().cast("array<struct<at:bigint,words:bigint>>")),
            F.struct(F.col("taken").alias("taken"), F.shiftleft("prefix", BITS).alias("prefix"), F.lit(False).alias("done")),
            _step(2 if level == LEVELS - 1 else 1),
        )
        joined = last.join(maybe_broadcast(counted, n), F.col("of").eqNullSafe(F.col("with")), "left").withColumn("end", walk)
        last = cut(joined.select("of", "need", F.col("end.taken").alias("taken"), F.col("end.prefix").alias("prefix")))
    more = (F.col("slot") < F.col("prefix")) & (F.col("whole") < most)
    return (
        dealt.join(maybe_broadcast(last, n), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", F.col("whole") + more.cast("long"))
        .select("doc_id", "size", "source", "source_size", "target", "copies")
    )


def repeat_rows(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, rows without a copy left out."""
    mixed = mix(docs, text, source, key, **how)
    of_id, of_size, of_source, times, nth = fresh(docs, "_id", "_size", "_source", "_copies", "_copy")
    taken = mixed.filter("copies > 0").select(F.col("doc_id").alias(of_id), F.col("size").alias(of_size), F.col("source").alias(of_source), F.col("copies").alias(times)).distinct()
    same = F.col(key).eqNullSafe(F.col(of_id)) & F.col(source).eqNullSafe(F.col(of_source)) & (word_count(F.col(text)) == F.col(of_size))
    return docs.join(taken, same).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
