"""One query for each operator over the driver's tables, and its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import decibel, nan_to_null
from .operators import downsample, joins, labels, segments, select, spectral
from .plans import dataset, failsafe, graph, materialize
from .plans.scratch import folder
from .request import Request
from .sources import files

Query = Callable[[SparkSession, str], DataFrame]
START, STOP = datetime(2024, 1, 5), datetime(2024, 1, 20)
HOURS6 = timedelta(hours=6)
KINDS = ["click", "login", "purchase", "signup", "view"]
CLASSES = ["quality", "toxic", "misc"]
ORIGIN = "timestamp '2000-01-01'"
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def waves(sf: str) -> graph.Source:
    """The events as samples: users are stations, event types channels."""
    return graph.Source(name="waves", path=f"{sf}/events.parquet", columns={"station": "user_id", "channel": "event_type"}, keep=["station", "channel", "ts", "value"])


CELL = f"(floor(date_diff('microsecond', {ORIGIN}, ts) / 21600000000.0))::bigint"
AT_CELL = f"{ORIGIN} + to_microseconds(({CELL}) * 21600000000)"


@query("select event_id, ts, value from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'")
def slice_half_open(spark, sf):
    return select.select(table(spark, sf, "events"), {"ts": {"start": START, "stop": STOP}}).select("event_id", "ts", "value")


@query("select event_id, ts, value from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20'")
def slice_closed(spark, sf):
    return select.select(table(spark, sf, "events"), {"ts": {"start": START, "stop": STOP}}, closed="both").select("event_id", "ts", "value")


@query("select event_id, event_type, user_id from events where event_type in ('click', 'view') and user_id = 7")
def slice_label_list(spark, sf):
    return select.select(table(spark, sf, "events"), {"event_type": ["click", "view"], "user_id": 7}).select("event_id", "event_type", "user_id")


@query("""select event_type, event_id, position from (select event_type, event_id, row_number() over (partition by event_type order by ts, event_id) - 1 as position from events)
    where position >= 10 and position < 30""")
def slice_positions(spark, sf):
    return select.positions(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], 10, 30, cell=timedelta(days=1)).select("event_type", "event_id", "position")


@query(f"""select event_type as channel, {AT_CELL} as ts, max(value) as value, count(*)::bigint as n from events
    where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' group by all""")
def downsample_max_time(spark, sf):
    """Planned from a graph: the request's range reaches the scan, on whole cells."""
    end = graph.MaxDownsample(waves(sf), keys=["channel"], width=HOURS6)
    return graph.compute(spark, end, {"indexers": {"ts": graph.span(START, STOP)}})


@query("""with n as (select event_type, ts, value, (row_number() over (partition by event_type order by ts, event_id) - 1) // 16 as c from events)
    select event_type as channel, min(ts) as ts, max(value) as high from n group by event_type, c having count(*) = 16""")
def downsample_max_count(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("channel"), "ts", "value")
    return downsample.by_count(rows, ["channel"], 16, low=False)


@query("""with n as (select event_type, ts, value, (row_number() over (partition by event_type order by ts, event_id) - 1) // 16 as c from events)
    select event_type as channel, min(ts) as ts, min(value) as low, max(value) as high from n group by event_type, c having count(*) = 16""")
def downsample_minmax_count(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("channel"), "ts", "value")
    return downsample.by_count(rows, ["channel"], 16)


@query(f"""with b as (select event_type as channel, {CELL} as c, min(value) as lo, max(value) as hi from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' group by all)
    select channel, {ORIGIN} + to_microseconds(c * 21600000000) as ts, lo as value from b
    union all select channel, {ORIGIN} + to_microseconds(c * 21600000000 + 10800000000), hi from b""")
def downsample_minmax_interleaved(spark, sf):
    end = graph.MinMaxDownsample(waves(sf), keys=["channel"], width=HOURS6)
    return graph.compute(spark, end, {"indexers": {"ts": graph.span(START, STOP)}})


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by ts, event_id) - 1 as i, count(*) over (partition by event_type) as n from events),
    s as (select *, ceil(n / (floor(n / 20) - 2))::bigint as size, first_value(value) over w as fy, last_value(value) over w as ly from r where floor(n / 20) > 2
        window w as (partition by event_type order by i rows between unbounded preceding and unbounded following)),
    c as (select *, case when i = 0 then 0 else (i - 1) // size + 1 end as cell from s where i < n - 1),
    h as (select *, count(*) over (partition by event_type, cell) as held from c),
    k as (select * from h where cell = 0 or held = size),
    m as (select event_type, cell, lead(avg(i)) over o as nx, lead(avg(value)) over o as ny from k group by event_type, cell window o as (partition by event_type order by cell)),
    a as (select k.*, abs(0 * (value - coalesce(ny, ly)) + i * (coalesce(ny, ly) - fy) + coalesce(nx, n - 1) * (fy - value)) / 2 as area from k join m using (event_type, cell)),
    b as (select *, row_number() over (partition by event_type, cell order by area desc, i) as best from a)
    select event_type as channel, cell::bigint as cell, value from b where best = 1""")
def lttb_anchored(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("channel"), "ts", "value")
    return downsample.lttb_anchored(rows, ["channel"], 20)


@query()
def lttb_classic(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("channel"), "ts", "value")
    return downsample.lttb(rows, ["channel"], 100)


@query("select event_id, round(10 * log10(greatest(1e-3, value)) - 10 * log10(2.0), 6) as db from events where value is not null")
def to_db(spark, sf):
    return table(spark, sf, "events").filter("value is not null").select("event_id", F.round(decibel(F.col("value"), 2.0, 1e-3), 6).alias("db"))


def _samples(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "value")).withColumn("value", F.col("value").cast("double"))


DFT = """with s as (select vec_id, i, embedding[i + 1]::double as v from embeddings, (select unnest(range(64)) as i)),
    f as (select vec_id, k, i - k * {stride} as j, v from s, (select unnest(range({frames})) as k) where i >= k * {stride} and i < k * {stride} + {nfft}),
    c as (select *, v - avg(v) over (partition by vec_id, k) as x, {window} as w from f),
    d as (select vec_id, k, b, sum(x * w * cos(2 * pi() * b * j / {nfft})) as re, sum(x * w * sin(2 * pi() * b * j / {nfft})) as im, sum(w * w) as ww
        from c, (select unnest(range({nfft} // 2 + 1)) as b) group by all)
    select vec_id, k::bigint as frame, b::bigint as bin, round((re * re + im * im) / (1.0 * ww) * case when b = 0 or b = {nfft} // 2 then 1 else 2 end, 9) as power from d"""
TUKEY = "case when j / 16.0 < 0.125 then 0.5 * (1 + cos(pi() * (j / 16.0 / 0.125 - 1))) when j / 16.0 > 0.875 then 0.5 * (1 + cos(pi() * ((1 - j / 16.0) / 0.125 - 1))) else 1.0 end"


def _bins(df):
    return df.select("vec_id", "frame", F.posexplode("spectrum").alias("bin", "power")).select("vec_id", "frame", F.col("bin").cast("long").alias("bin"), F.round(F.col("power") + 0.0, 9).alias("power"))


@query(DFT.format(stride=64, frames=1, nfft=64, window="1.0"))
def spectrum_dft(spark, sf):
    return _bins(spectral.stft(_samples(spark, sf), ["vec_id"], 64, 64, taper=0))


@query(DFT.format(stride=8, frames=7, nfft=16, window=TUKEY))
def stft_psd(spark, sf):
    return _bins(spectral.stft(_samples(spark, sf), ["vec_id"], 16, 8, chunk=32))


FIT = "select s as start, s + interval {size} as stop from (select unnest(generate_series(timestamp '{first}', timestamp '{last}', interval {stride})) as s) where s + interval {size} <= timestamp '{end}'"


@query(FIT.format(size="'2 days'", stride="'1 day'", first="2024-01-05", last="2024-01-20", end="2024-01-20"))
def segments_fit(spark, sf):
    return segments.time_segments(spark, START, STOP, timedelta(days=2), timedelta(days=1), "fit")


@query(FIT.format(size="'2 days'", stride="'1 day'", first="2024-01-03", last="2024-01-22", end="2024-01-22"))
def segments_overlap(spark, sf):
    return segments.time_segments(spark, START, STOP, timedelta(days=2), timedelta(days=1), "overlap")


@query("select s as time_start, s + interval '5 days' as time_stop, channel from (select unnest(generate_series(timestamp '2024-01-05', timestamp '2024-01-15', interval '5 days')) as s), (select unnest([['click', 'login'], ['purchase', 'signup']]) as channel)")
def segments_cross_dims(spark, sf):
    dims = {"time": {"size": timedelta(days=5), "mode": "fit", "ref": START}, "channel": {"size": 2}, "station": {"size": 1}}
    out = segments.segments(spark, {"time": {"start": START, "stop": STOP}, "channel": KINDS}, dims)
    return out


def _intervals(spark, sf):
    """Every lineitem row as an annotation, from the earlier to the later date of its order and its own, and every order
    as a request for three days; both have their customer, as sensors have their station."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("customer"), "o_orderpriority")
    a = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    start, stop = F.least("l_shipdate", "o_orderdate"), F.greatest("l_shipdate", "o_orderdate")
    a = a.select(F.col("l_orderkey").alias("ann_id"), "l_linenumber", "customer", F.col("o_orderpriority").alias("kind"), start.alias("a_start"), stop.alias("a_stop"))
    r = orders.select(F.col("o_orderkey").alias("req_id"), "customer", F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("r_start"), F.timestamp_add("DAY", F.lit(3), "o_orderdate").alias("r_stop"))
    return a, r


IV = """with a as (select l_orderkey as ann_id, l_linenumber, o_custkey as customer, o_orderpriority as kind, least(l_shipdate, o_orderdate) as a_start, greatest(l_shipdate, o_orderdate) as a_stop from lineitem join orders on l_orderkey = o_orderkey),
    r as (select o_orderkey as req_id, o_custkey as customer, o_orderpriority as kind, o_orderdate as r_start, o_orderdate + interval '3 days' as r_stop from orders)
    select ann_id, l_linenumber, req_id from a join r on a.customer = r.customer and {}"""
PAIR = ["ann_id", "l_linenumber", "req_id"]


def _overlap(closed: str, end: str, start: str) -> None:
    def one(spark, sf):
        a, r = _intervals(spark, sf)
        return joins.overlap_join(a.drop("kind"), r.drop("kind"), timedelta(days=8), closed, on=["customer"]).select(*PAIR)

    one.__name__ = f"overlap_{closed}"
    query(IV.format(f"a_stop {end} r_start and a_start {start} r_stop"))(one)


for _closed, _end, _start in (("neither", ">=", "<="), ("both", ">", "<"), ("left", ">=", "<"), ("right", ">", "<=")):
    _overlap(_closed, _end, _start)


@query(IV.format("a_stop >= r_start and a_start <= r_stop and a.kind = r.kind"))
def overlap_with_membership(spark, sf):
    a, r = _intervals(spark, sf)
    return joins.overlap_join(a, r, timedelta(days=8), on=["customer", "kind"]).select(*PAIR)


NEXT = "case {0} when '1-URGENT' then '2-HIGH' when '2-HIGH' then '3-MEDIUM' else '5-LOW' end"


@query(IV.format(f"a_stop >= r_start and a_start <= r_stop and list_has_any([a.kind, {NEXT.format('a.kind')}], [r.kind])"))
def overlap_any_of(spark, sf):
    """Annotations of two kinds each against requests of one: any element of the one list is in the other."""
    a, r = _intervals(spark, sf)
    follows = F.when(F.col("kind") == "1-URGENT", "2-HIGH").when(F.col("kind") == "2-HIGH", "3-MEDIUM").otherwise("5-LOW")
    return joins.overlap_join(a.withColumn("kind", F.array("kind", follows)), r, timedelta(days=8), on=["customer"], any_of=["kind"]).select(*PAIR)


@query("with p as (" + IV.format("a_stop >= r_start and a_start <= r_stop and a.kind = r.kind and ann_id <> req_id") + """)
    select o_orderkey as req_id, coalesce(string_agg(distinct ann_id::varchar, ',' order by ann_id::varchar), '') as annotations from orders left join p on o_orderkey = req_id group by o_orderkey""")
def annotations_per_request(spark, sf):
    a, r = _intervals(spark, sf)
    pairs = joins.overlap_join(a, r, timedelta(days=8), on=["customer", "kind"]).filter("ann_id <> req_id").withColumn("ann_id", F.col("ann_id").cast("string"))
    return joins.per_request(r.select("req_id"), pairs, "req_id", "ann_id").withColumn("annotations", F.array_join("annotations", ","))


MONTH = graph.span("2024-01-01", "2024-02-01")  # all events
HOURLY = "(select event_type as channel, date_trunc('hour', ts) as ts, avg(value) as value from events group by all)"


def _hourly(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("channel"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("value"))


@query(f"""select g.channel, g.ts, round(h.value, 9) as value from (select channel, unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31 23:00:00', interval '1 hour')) as ts from (select distinct channel from {HOURLY})) g
    left join {HOURLY} h on g.channel = h.channel and g.ts = h.ts""")
def regular_grid_left(spark, sf):
    out = joins.regular_grid(_hourly(spark, sf), ["channel"], MONTH["start"], MONTH["stop"], timedelta(hours=1))
    return out.select("channel", "ts", F.round("value", 9).alias("value"))


@query("select ts, " + ", ".join(f"round(max(value) filter (where channel = '{c}'), 9) as {c}" for c in KINDS) + f" from {HOURLY} group by ts")
def series_outer_merge(spark, sf):
    return joins.outer_merge(_hourly(spark, sf), ["ts"], "channel", "value", KINDS).select("ts", *(F.round(c, 9).alias(c) for c in KINDS))


def _nearest(method, where, order):
    def one(spark, sf):
        rows = table(spark, sf, "events").select("event_type", "event_id", "ts")
        return select.nearest(rows, "ts", datetime(2024, 1, 10, 12), ["event_type"], method)

    one.__name__ = f"nearest_{method}"
    query(f"select event_type, event_id, ts from events where {where} qualify row_number() over (partition by event_type order by {order}) = 1")(one)


_nearest("nearest", "true", "abs(date_diff('microsecond', timestamp '2024-01-10 12:00:00', ts)), ts")
_nearest("ffill", "ts <= timestamp '2024-01-10 12:00:00'", "ts desc")
_nearest("bfill", "ts >= timestamp '2024-01-10 12:00:00'", "ts")


@query("""select p.event_id, p.user_id, p.ts, l.event_id as login_id from (select * from events where event_type = 'purchase') p
    asof left join (select * from events where event_type = 'login') l on p.user_id = l.user_id and p.ts >= l.ts""")
def asof_backward(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "user_id", "ts")
    left, right = (events.filter(F.col("event_type") == k).drop("event_type") for k in ("purchase", "login"))
    return joins.asof_backward(left, right.withColumnRenamed("event_id", "login_id"), ["user_id"], "ts", ["login_id"]).select("event_id", "user_id", "ts", "login_id")


def _own(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _cube(spark, sf):
    """A cube of daily chunks of which three are there and one has failed, in a folder of the run's own."""
    rows = table(spark, sf, "events").select("event_id", "ts", "value")
    made = lambda a, b: rows.filter(select.within("ts", {"start": a, "stop": b}))
    cube = materialize.MaterializedCube(spark, _own(spark, "cube"), datetime(2024, 1, 1), timedelta(days=1), made)
    cube.fill(datetime(2024, 1, 6), datetime(2024, 1, 9))

    def fails(a, b):
        raise ValueError("no source")

    cube.compute = fails
    cube.fill(datetime(2024, 1, 10), datetime(2024, 1, 11))
    cube.compute = made
    return cube


@query("""select c::bigint as chunk_id, timestamp '2024-01-01' + to_days(c::int) as chunk_start, (case when c in (5, 6, 7) then 1 when c = 9 then -1 else 0 end)::tinyint as status from (select unnest(range(4, 11)) as c)""")
def missing_chunks(spark, sf):
    return _cube(spark, sf).available(START, datetime(2024, 1, 11, 5))


@query("select event_id, ts, value from events where ts >= timestamp '2024-01-05 07:00:00' and ts < timestamp '2024-01-09 12:00:00'")
def materialized_read(spark, sf):
    return _cube(spark, sf).read(datetime(2024, 1, 5, 7), datetime(2024, 1, 9, 12))


@query("select event_id, ts, value from events where ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-10'")
def request_cache(spark, sf):
    make = lambda r: select.select(table(spark, sf, "events"), r.indexers).select("event_id", "ts", "value")
    cache = materialize.RequestCache(spark, _own(spark, "cache"), make)
    return cache.get_all([Request({"ts": graph.span(f"2024-01-0{d}", f"2024-01-{d + 1:02d}")}) for d in (8, 9)])


def _items(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("index"), "lang", "n_chars")
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("index"), "quality", "toxic")
    return dataset.RequestDataset([], docs, marks)


@query("select doc_id as index, lang, n_chars, quality, toxic from documents join labels using (doc_id)")
def dataset_join_index(spark, sf):
    return _items(spark, sf).rows()


@query("select doc_id as index, lang, n_chars, quality, toxic from documents join labels using (doc_id) where n_chars >= 500")
def dataset_mask_invalid(spark, sf):
    bad = table(spark, sf, "documents").filter("n_chars < 500").select(F.col("doc_id").alias("index"))
    return _items(spark, sf).mask_invalid(bad).rows()


@query("select vec_id, case when vec_id < (select count(*) from embeddings) * 3 // 4 then 'train' else 'test' end as part from embeddings")
def dataset_split(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id")
    return labels.split_at(vectors, "vec_id", vectors.count())


def _flags(spark, sf):
    marks = table(spark, sf, "labels")
    named = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("toxic")), F.when(F.col("doc_id") % 2 == 0, F.lit("misc"))))
    return labels.multi_hot(marks.select("doc_id", F.explode_outer(named).alias("label")), "doc_id", "label", CLASSES, "misc")


FLAGS = "(select doc_id, quality, toxic, case when quality = 1 or toxic = 1 then 0 when doc_id % 2 = 0 then 1 else 0 end as misc from labels)"


@query(f"select doc_id, quality::int as quality, toxic::int as toxic, misc::int as misc from {FLAGS}")
def multi_hot_labels(spark, sf):
    return _flags(spark, sf)


@query(f"""select unnest(['quality', 'toxic', 'misc', 'none']) as label, unnest([sum(quality), sum(toxic), sum(misc), count(*) filter (where quality + toxic + misc = 0)])::bigint as n from {FLAGS}""")
def label_stats(spark, sf):
    return labels.label_counts(_flags(spark, sf), CLASSES)


@query(f"select (quality + toxic + misc)::bigint as n_labels, count(*)::bigint as n from {FLAGS} group by 1")
def labels_per_item(spark, sf):
    return labels.labels_per_item(_flags(spark, sf), CLASSES)


@query("select source, doc_id from documents qualify row_number() over (partition by source order by doc_id) <= 5")
def cap_per_tag(spark, sf):
    return labels.cap_per_tag(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 5)


def _predicted(spark, sf):
    def load():
        import numpy as np

        weights = np.arange(1, 65) % 5 - 2

        def model(frame: pd.DataFrame) -> pd.DataFrame:
            x = np.stack([np.asarray(v, float) for v in frame["embedding"]])
            return pd.DataFrame({"vec_id": frame["vec_id"], "label": frame["label"], "score": x @ weights})

        return model

    return dataset.infer(table(spark, sf, "embeddings"), load, "vec_id long, label int, score double")


SCORE = "(select vec_id, label, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * (i % 5 - 2))) as score from embeddings)"


@query(f"select vec_id, round(score, 6) as score from {SCORE}")
def batch_inference(spark, sf):
    return _predicted(spark, sf).select("vec_id", F.round("score", 6).alias("score"))


@query(f"select label, count(*) filter (where score < 0)::bigint as p_0, count(*) filter (where score >= 0)::bigint as p_1 from {SCORE} group by label")
def confusion_counts(spark, sf):
    return labels.confusion(_predicted(spark, sf).withColumn("p", (F.col("score") >= 0).cast("int")), "label", "p", [0, 1])


@query(f"select round(avg(case when (label >= 5) = (score >= 0) then 1.0 else 0.0 end), 9) as accuracy from (select label, score from {SCORE})")
def accuracy(spark, sf):
    return labels.accuracy(_predicted(spark, sf), F.col("label") >= 5, F.col("score") >= 0).select(F.round("accuracy", 9).alias("accuracy"))


@query("""select p_partkey, 'size' as name, 'mm' as unit, p_size::double as value from part union all select p_partkey, 'price', 'CHF', p_retailprice::double from part""")
def unpivot_sensor_table(spark, sf):
    wide = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("size [mm]"), F.col("p_retailprice").alias("price [CHF]"), F.lit(None).cast("double").alias("empty [K]"))
    return files.long_table(wide, ["p_partkey"], ["size [mm]", "price [CHF]", "empty [K]"])


@query("""select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, (case when v is null then 0 when try_cast(v as bigint) is null then -1 else 1 end)::tinyint as status,
    case when v is not null and try_cast(v as bigint) is null then 'not a number' end as error from (select *, json_extract_string(props, '$.k') as v from events)""")
def failsafe_status(spark, sf):
    v = F.get_json_object("props", "$.k")
    rows = table(spark, sf, "events").withColumn("v", v)
    out = failsafe.guarded(rows, F.expr("try_cast(v as bigint)"), "k", F.col("v").isNotNull() & F.expr("try_cast(v as bigint)").isNull(), "not a number")
    return out.select("event_id", "k", "status", "error")


@query("select vec_id, len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 as sound from embeddings")
def valid_tensors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", failsafe.sound_arrays("embedding", 64).alias("sound"))


@query("select event_type as channel, ts, value from events")
def chunk_round_trip(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("channel"), "ts", "value")
    return downsample.unchunked(downsample.chunked(rows, ["channel"], timedelta(days=1)), ["channel"])


@query("select user_id, min(ts) as ts, min(event_id) as event_id from (select user_id, date_trunc('day', ts) as ts, event_id from events) group by user_id, ts")
def dedupe_on_start(spark, sf):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return select.first_of(table(spark, sf, "events").select("user_id", day.alias("ts"), "event_id"), ["user_id", "ts"], ["event_id"])


@query("select event_id, date_trunc('second', ts) as ts from events")
def floor_to_sample(spark, sf):
    return files.floor_to_sample(table(spark, sf, "events").select("event_id", "ts"), 1.0)


@query("select user_id, 50.0::double * (1 + user_id % 3) as sampling_rate from events group by 1")
def one_sampling_rate(spark, sf):
    """Three kinds of stations, each with a rate of its own."""
    return files.one_rate(table(spark, sf, "events").withColumn("sampling_rate", 50.0 * (1 + F.col("user_id") % 3)), ["user_id"])


@query("select event_type, count(value)::bigint as n, bool_and(value >= 0) as all_sound, bool_or(value > 400) as any_large from events group by event_type")
def availability_flags(spark, sf):
    v = nan_to_null(F.col("value"))
    return failsafe.flags(table(spark, sf, "events"), ["event_type"], v, all_sound=("all", v >= 0), any_large=("any", v > 400))


DAYS = "(select row_number() over (order by s) - 1 as segment, s as start, s + interval '3 days' as stop from (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-29', interval '1 day')) as s))"


def _days(spark):
    """Windows of three days, every day of the month."""
    table = segments.time_segments(spark, MONTH["start"], MONTH["stop"], timedelta(days=3), timedelta(days=1))
    return graph.Segments(table.withColumn("segment", F.date_diff("start", F.lit(MONTH["start"].date())).cast("long")))


@query(f"""select segment, event_type as channel, {AT_CELL} as ts, max(value) as value, count(*)::bigint as n from events join {DAYS} on ts >= start and ts < stop group by all""")
def fan_out_segments(spark, sf):
    """One plan for all segments: they are rows."""
    end = graph.MaxDownsample(waves(sf), keys=["channel"], width=HOURS6)
    return graph.compute(spark, end, {"indexers": {"ts": _days(spark)}}).select("segment", "channel", "ts", "value", "n")


MAXIMA = f"select event_type as channel, {AT_CELL} as ts, max(value) as value, count(*)::bigint as n from events where ts >= timestamp '{{}}' and ts < timestamp '{{}}' group by all"


@query(MAXIMA.format("2024-01-05", "2024-01-20"))
def pruned_cached_read(spark, sf):
    """What the first request keeps prunes the graph above it for the second: its source isn't there any more."""
    cache = materialize.RequestCache(spark, _own(spark, "kept"))
    source = waves(sf)
    end = graph.Cached(graph.MaxDownsample(source, keys=["channel"], width=HOURS6), cache)
    asked = {"indexers": {"ts": graph.span(START, STOP)}}
    graph.compute(spark, end, asked)
    source.config = {**source.config, "path": f"{sf}/nothing.parquet"}
    return graph.compute(spark, end, asked)


@query(f"select 'max' as output, * from ({MAXIMA.format('2024-01-05', '2024-01-12')}) union all select 'later', * from ({MAXIMA.format('2024-01-10', '2024-01-20')})")
def multi_output(spark, sf):
    """Two ends, a request each, over one scan of a range that covers both."""
    source = waves(sf)
    ends = [graph.MaxDownsample(source, keys=["channel"], width=HOURS6, name=n) for n in ("max", "later")]
    asked = [{"indexers": {"ts": graph.span(a, b)}} for a, b in (("2024-01-05", "2024-01-12"), ("2024-01-10", "2024-01-20"))]
    one, two = graph.compute(spark, ends, asked, merge=True)
    return one.select(F.lit("max").alias("output"), "*").unionByName(two.select(F.lit("later").alias("output"), "*"))


@query("""select c::bigint as chunk_id, (case when c = 2 then -1 else 1 end)::tinyint as status, (case when c = 2 then 0 else (select count(*) from events where ts >= timestamp '2024-01-05' + to_days(c::int) and ts < timestamp '2024-01-06' + to_days(c::int)) end)::bigint as n from (select unnest(range(4)) as c)""")
def cube_partial_failure(spark, sf):
    """Four missing chunks, one with a bad row: only that one is marked as failed."""
    bad = (F.col("ts") >= F.lit(datetime(2024, 1, 7))) & (F.col("ts") < F.lit(datetime(2024, 1, 8)))
    rows = table(spark, sf, "events").select("event_id", "ts", F.when(bad, F.raise_error(F.lit("bad sample")).cast("double")).otherwise(F.col("value")).alias("value"))
    cube = materialize.MaterializedCube(spark, _own(spark, "cube"), START, timedelta(days=1), lambda a, b: rows.filter(select.within("ts", {"start": a, "stop": b})))
    stop = START + timedelta(days=4)
    held = cube.read(START, stop).groupBy(F.date_diff("ts", F.lit(START.date())).cast("long").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"))
    return cube.available(START, stop).join(held, "chunk_id", "left").select("chunk_id", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _groups(spark, sf, **how):
    """Hourly means by channel, daily chunks."""
    hourly = _hourly(spark, sf)
    made = lambda r: select.select(hourly, r.indexers)
    return materialize.Persister(spark, _own(spark, "groups"), (MONTH["start"], MONTH["stop"]), timedelta(days=1), made, group_keys=["channel"], **how)


@query(f"""select c as channel, t as ts, round(h.value, 9) as value from (select unnest(['click', 'view']) as c)
    cross join (select unnest(generate_series(timestamp '2024-01-05 08:00:00', timestamp '2024-01-09 06:00:00', interval '1 hour')) as t) left join {HOURLY} h on c = h.channel and t = h.ts""")
def persister_region(spark, sf):
    """A region that overlaps what is there and what isn't, on the grid of the inferred step."""
    cube = _groups(spark, sf)
    cube.fill({"indexers": {"channel": ["click", "login"], "ts": graph.span("2024-01-06", "2024-01-08")}})
    asked = {"indexers": {"channel": ["click", "view"], "ts": graph.span("2024-01-05 07:10:00", "2024-01-09 06:30:00")}}
    return cube.region(asked).select("channel", "ts", F.round("value", 9).alias("value"))


@query("""select 'g' || c as grp, d::bigint as chunk_id, (case when c = 'click' and d in (5, 6) or c = 'login' and d in (5, 6) or c = 'view' and d = 8 then 1 else 0 end)::tinyint as status
    from (select unnest(['click', 'login', 'view']) as c), (select unnest(range(4, 10)) as d)""")
def persister_groups(spark, sf):
    cube = _groups(spark, sf)
    cube.fill({"indexers": {"channel": ["click", "login"], "ts": graph.span("2024-01-06", "2024-01-08")}})
    cube.fill({"indexers": {"channel": "view", "ts": graph.span("2024-01-09 05:00:00", "2024-01-09 07:00:00")}})
    return cube.available({"indexers": {"channel": ["click", "login", "view"], "ts": graph.span("2024-01-05", "2024-01-11")}}).select("grp", "chunk_id", "status")


@query(f"select channel, ts, round(value, 9) as value from {HOURLY} where channel in ('click', 'view') and ts >= timestamp '2024-01-05 07:00:00' and ts < timestamp '2024-01-09 06:00:00'")
def persister_bypass_storage(spark, sf):
    asked = {"indexers": {"channel": ["click", "view"], "ts": graph.span("2024-01-05 07:00:00", "2024-01-09 06:00:00")}}
    return _groups(spark, sf, bypass_storage=True).read(asked).select("channel", "ts", F.round("value", 9).alias("value"))


@query(MAXIMA.format("2024-01-05 06:00:00", "2024-01-13 12:00:00"))
def segment_cache(spark, sf):
    """Segments of two days, some kept by an earlier request; results are cut to the request."""
    end = graph.MaxDownsample(waves(sf), keys=["channel"], width=HOURS6)
    cache = materialize.SegmentCache(spark, _own(spark, "segments"), lambda r: graph.compute(spark, end, r), timedelta(days=2))
    cache.get({"indexers": {"ts": graph.span("2024-01-06", "2024-01-09")}})
    return cache.get({"indexers": {"ts": graph.span("2024-01-05 06:00:00", "2024-01-13 12:00:00")}})


@query("""with n as (select event_type as channel, ts, value, row_number() over (partition by event_type order by ts, value) - 1 as i from events)
    select a.channel, a.ts, round(sum(b.value), 6) as total from n a join n b on a.channel = b.channel and b.i between a.i - 7 and a.i where a.i % 4 = 0 group by all having count(*) = 8""")
def rolling_trailing(spark, sf):
    """Windows of 8 samples as arrays, every 4 samples, each with the time of its last one."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("channel"), "ts", "value")
    out = downsample.rolling(rows, ["channel"], 8, 4, "trailing")
    return out.select("channel", "ts", F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"select segment, event_type as channel, count(*)::bigint as n, round(max(value) - min(value), 6) as score from events join {DAYS} on ts >= start and ts < stop group by all having count(*) % 7 <> 0")
def model_over_segments(spark, sf):
    """A model asked for each segment of each channel; it fails on every item whose length 7 divides."""

    def load():
        def model(frame: pd.DataFrame) -> pd.DataFrame:
            if any(len(x) % 7 == 0 for x in frame["item"]):
                raise ValueError("no answer")
            return pd.DataFrame({"segment": frame["segment"], "channel": frame["channel"], "n": frame["item"].map(len), "score": frame["item"].map(lambda x: max(x) - min(x))})

        return model

    found = dataset.infer_segments(spark, waves(sf), {}, _days(spark), load, "segment long, channel string, n long, score double", ["channel"])
    return found.withColumn("score", F.round("score", 6))


@query(f"select segment as index, event_type as channel, count(*)::bigint as n, round(avg(value), 6) as mean from events join {DAYS} on ts >= start and ts < stop where segment % 2 = 0 group by all")
def dataset_from_components(spark, sf):
    """A dataset of requests for three days each; items of odd index are invalid, a transform takes means."""
    starts = [MONTH["start"] + timedelta(days=i) for i in range(29)]
    asked = [Request({"ts": {"start": a, "stop": a + timedelta(days=3)}}) for a in starts]
    mean = lambda df: df.groupBy("index", "channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    data = dataset.RequestDataset.from_components(spark, asked, waves(sf)).transformed(mean)
    return data.check_validity(F.col("index") % 2 == 0).rows()


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
