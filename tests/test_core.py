"""Planning, intervals, materialised cubes, readers and failures, without the training-data operators."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubespark.functions import align_ceil, align_floor, grid_index, ts
from cubespark.operators import downsample, joins, segments, select, spectral
from cubespark.plans import failsafe, graph, materialize
from cubespark.plans.dataset import RequestDataset
from cubespark.request import Request, controls_to_request, deep_merge, flatten, is_datetime, to_datetime, unflatten
from cubespark.sources import files
from cubespark.streaming.ingest import ingest, windowed_max

SF = "/root/testdata/sf0.001"


def day(n, hour=0):
    return datetime(2016, 1, n, hour)


def test_request_layers_and_hash():
    r = Request({"station": "A"}, {"nfft": 1, "global": {"nfft": 2, "x": 1}, "types": {"T": {"nfft": 3, "d": {"a": 1}}}, "keys": {"k": {"nfft": 4, "d": {"b": 2}}}})
    assert r.config_for("k", "T", {"nfft": 0, "own": 1}) == {"nfft": 4, "own": 1, "station": "A", "x": 1, "d": {"a": 1, "b": 2}}
    assert r.config_for("z", "Z")["nfft"] == 2
    same = Request({"b": datetime(2020, 1, 1), "a": 1}), Request({"a": 1, "b": datetime(2020, 1, 1)}, {"self": 5})
    assert same[0].digest() == same[1].digest() != Request({"a": 2}).digest()
    assert unflatten(flatten({"a": {"b": 1, "c": {"d": 2}}, "e": 3})) == {"a": {"b": 1, "c": {"d": 2}}, "e": 3}
    base = {"a": {"b": 1}}
    assert deep_merge(base, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}} and base == {"a": {"b": 1}}
    assert to_datetime("2020-01-01T02:00:00+02:00") == datetime(2020, 1, 1) and not is_datetime("EHE") and is_datetime("2020-01-01")
    assert controls_to_request({"start": "2020-01-01", "stop": None, "station": "A", "x.y": 1}) == Request({"ts": {"start": datetime(2020, 1, 1)}, "station": "A"}, {"x": {"y": 1}})


def test_grid_before_and_on_the_reference(spark):
    w = timedelta(hours=6)
    times = [datetime(1999, 12, 31, 23), datetime(2000, 1, 1), datetime(1999, 12, 31, 18), datetime(2000, 1, 1, 7)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz").select("ts", grid_index("ts", w).alias("c"))
    assert [r["c"] for r in df.collect()] == [-1, 0, -1, 1]
    assert align_floor(times[0], w) == times[2] and align_ceil(times[0], w) == times[1] == align_ceil(times[1], w)


CASES = [(1, 2, set()), (30, 31, set()), (1, 31, {0, 1, 2, 3}), (1, 15, {0, 1, 3}), (15, 31, {0, 1, 2}), (15, 16, {0, 1})]


def test_annotation_cases(spark):
    ann = spark.createDataFrame([(0, day(14), day(17)), (1, day(15), day(16)), (2, day(18), day(19)), (3, day(12), day(13))], "ann long, a_start timestamp_ntz, a_stop timestamp_ntz")
    req = spark.createDataFrame([(i, day(a), day(b)) for i, (a, b, _) in enumerate(CASES)], "req long, r_start timestamp_ntz, r_stop timestamp_ntz")
    got = joins.per_request(req, joins.overlap_join(ann, req, timedelta(days=1)), "req", "ann").collect()
    assert {r["req"]: set(r["annotations"]) for r in got} == {i: x for i, (*_, x) in enumerate(CASES)}


@pytest.mark.parametrize("closed", ["neither", "both", "left", "right"])
def test_binned_join_is_the_nested_loop(spark, closed):
    rng = np.random.default_rng(4)
    def some(n):
        start = rng.integers(0, 400, n)
        length = rng.choice([0, 1, 3, 10, 300, 6000], n)
        return [(i, datetime(1999, 12, 1) + timedelta(hours=int(s)), datetime(1999, 12, 1) + timedelta(hours=int(s + x))) for i, (s, x) in enumerate(zip(start, length))]
    a, r = some(120), some(90)
    ann, req = spark.createDataFrame(a, "ann long, a_start timestamp_ntz, a_stop timestamp_ntz"), spark.createDataFrame(r, "req long, r_start timestamp_ntz, r_stop timestamp_ntz")
    got = [tuple(x) for x in joins.overlap_join(ann, req, timedelta(hours=4), closed, most_bins=8).select("ann", "req").collect()]
    end, start = joins.TOUCH[closed]
    want = {(i, j) for i, s, e in a for j, s2, e2 in r if (e >= s2 if end else e > s2) and (s <= e2 if start else s < e2)}
    assert len(got) == len(set(got)) and set(got) == want


def test_minmax_ramp(spark):
    rows = [(datetime(2000, 1, 1 + i), c, float(2 * i + k)) for i in range(9) for k, c in enumerate(("EHE", "EHZ"))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, channel string, value double")
    got = {(r["ts"], r["channel"]): (r["low"], r["high"]) for r in downsample.by_count(df, ["channel"], 4).collect()}
    assert got == {(datetime(2000, 1, 1), "EHE"): (0, 6), (datetime(2000, 1, 5), "EHE"): (8, 14), (datetime(2000, 1, 1), "EHZ"): (1, 7), (datetime(2000, 1, 5), "EHZ"): (9, 15)}


def test_halo_plan_is_full_compute_then_slice_and_reaches_the_scan(spark):
    from cubespark.queries import waves

    start, stop = datetime(2024, 1, 5, 1, 30), datetime(2024, 1, 9, 7)
    for kind in (graph.MaxDownsample, graph.MinMaxDownsample):
        end = kind(waves(SF), keys=["channel"], width=timedelta(hours=6))
        part = graph.compute(spark, end, {"indexers": {"ts": graph.span(start, stop)}})
        full = graph.compute(spark, end, {"indexers": {}}).filter((F.col("ts") >= ts(start)) & (F.col("ts") < ts(stop)))
        assert sorted(map(str, part.collect())) == sorted(map(str, full.collect())) != []
        plan = part._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan and "LessThan(ts,2024-01-09T12:00)" in plan
    assert graph.edges_of(end) == [("waves", "MinMaxDownsample")] and graph.find(end, "waves").name == "waves"
    both = graph.compute(spark, end, {"indexers": {"channel": ["click"]}}, only=["waves", "MinMaxDownsample"])
    assert set(both) == {"waves", "MinMaxDownsample"} and both["waves"].select("channel").distinct().count() == 1


def test_spectrogram_slices_agree(spark, tmp_path):
    start = datetime(1999, 12, 31, 23, 59)
    rows = [("A", start + timedelta(milliseconds=10 * i), float(np.sin(i / 3) + (i % 7))) for i in range(3000) if i != 1500]
    spark.createDataFrame(rows, "station string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/w")
    end = graph.Spectrogram(graph.Source(path=f"{tmp_path}/w"), keys=["station"], nfft=64, stride=16, rate=100.0)
    lo, hi = start + timedelta(seconds=5), start + timedelta(seconds=20)
    part = graph.compute(spark, end, {"indexers": {"ts": graph.span(lo, hi)}}).collect()
    full = graph.compute(spark, end, {}).filter((F.col("ts") >= ts(lo)) & (F.col("ts") < ts(hi))).collect()
    assert {r["ts"]: np.round(r["spectrum"], 9).tolist() for r in part} == {r["ts"]: np.round(r["spectrum"], 9).tolist() for r in full} != {}
    assert 80 < len(part) < 95


def test_stft_over_chunks_is_the_whole_signal(spark):
    x = np.random.default_rng(1).normal(size=1000)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, i long, value double")
    got = {r["frame"]: r["spectrum"] for r in spectral.stft(df, ["k"], 64, 16, 1.0, chunk=128).collect()}
    frames = np.lib.stride_tricks.sliding_window_view(x, 64)[::16]
    want = spectral.psd(frames, 1.0, spectral.tukey(64))
    assert sorted(got) == list(range(len(frames))) and np.allclose([got[k] for k in sorted(got)], want)


def test_lttb_keeps_ends_and_peaks(spark):
    y = [0.0] * 500
    y[321] = 50.0
    df = spark.createDataFrame([("a", datetime(2020, 1, 1) + timedelta(seconds=i), v) for i, v in enumerate(y)], "k string, ts timestamp_ntz, value double")
    got = downsample.lttb(df, ["k"], 20).orderBy("ts").collect()
    assert len(got) == 20 and got[0]["ts"] == datetime(2020, 1, 1) and max(r["value"] for r in got) == 50 and got[-1]["ts"] == datetime(2020, 1, 1, 0, 8, 19)


def test_segments(spark):
    got = segments.time_segments(spark, datetime(2020, 1, 1, 5), datetime(2020, 1, 3), timedelta(days=1), mode="fit").collect()
    assert [r["start"].day for r in got] == [1, 2]
    assert segments.time_segments(spark, datetime(2020, 1, 1), datetime(2020, 1, 1, 1), timedelta(days=1), at_least=2).count() == 2
    with pytest.raises(ValueError):
        segments.time_segments(spark, datetime(2020, 1, 1), datetime(2020, 1, 2), timedelta(days=1), mode="other")
    assert segments.list_segments("abcde", 2) == [["a", "b"], ["c", "d"]]


def test_cube_computes_only_what_it_misses(spark, tmp_path):
    calls = []
    rows = spark.createDataFrame([(datetime(2020, 1, 1) + timedelta(hours=h), float(h)) for h in range(24 * 9)], "ts timestamp_ntz, value double")

    def make(a, b):
        calls.append((a, b))
        if a == datetime(2020, 1, 8):
            raise ValueError("broken")
        return rows.filter(select.within("ts", {"start": a, "stop": b}))

    cube = materialize.MaterializedCube(spark, f"{tmp_path}/c", datetime(2020, 1, 1), timedelta(days=1), make)
    span = datetime(2020, 1, 2, 5), datetime(2020, 1, 4, 7)
    direct = lambda a, b: sorted(map(tuple, rows.filter(select.within("ts", {"start": a, "stop": b})).collect()))
    assert sorted(map(tuple, cube.read(*span).collect())) == direct(*span) and len(calls) == 1
    assert cube.fill(*span) == 0
    wide = datetime(2020, 1, 1), datetime(2020, 1, 6)
    assert sorted(map(tuple, cube.read(*wide).collect())) == direct(*wide) and len(calls) == 3
    for _ in range(2):
        cube.compact()
        assert sorted(map(tuple, cube.read(*wide).collect())) == direct(*wide) and len(calls) == 3
    with pytest.raises(RuntimeError, match="broken"):
        cube.read(datetime(2020, 1, 8), datetime(2020, 1, 9))
    states = {r["chunk_id"]: r["status"] for r in cube.available(datetime(2020, 1, 7), datetime(2020, 1, 10)).collect()}
    assert states == {6: 0, 7: -1, 8: 0}


def test_request_cache(spark, tmp_path):
    n = []

    def make(request):
        n.append(1)
        if request.indexers["x"] < 0:
            raise ValueError("negative")
        return spark.range(request.indexers["x"])

    cache = materialize.RequestCache(spark, f"{tmp_path}/r", make)
    assert cache.state(Request({"x": 3})) is None and cache.get(Request({"x": 3})).count() == cache.get(Request({"x": 3})).count() == 3 and len(n) == 1
    for _ in range(2):
        with pytest.raises((ValueError, RuntimeError), match="negative"):
            cache.get(Request({"x": -1}))
    assert len(n) == 2 and cache.state(Request({"x": -1})) is False
    assert cache.get_all([Request({"x": 2}), Request({"x": -1}), Request({"x": 3})]).count() == 5
    assert cache.get(Request({"x": 4}), bypass=True).count() == 4 and cache.state(Request({"x": 4})) is None
    assert materialize.group_name({"station": ["A", "B"], "channel": "E"}) == "E/A/B"
    with pytest.raises(TypeError):
        materialize.group_name({"station": 1})


def test_outer_merge_refuses_conflicts(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (2, "b", 3.0)], "i int, n string, v double")
    with pytest.raises(Exception, match="conflicting"):
        joins.outer_merge(df, ["i"], "n", "v", ["a", "b"]).collect()
    got = joins.outer_merge(df.filter("v <> 2"), ["i"], "n", "v", ["a", "b"]).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, 1.0, None), (2, None, 3.0)]


def test_failsafe_modes(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    value, bad = F.expr("try_cast(v as int)"), F.col("v").isNotNull() & F.expr("try_cast(v as int)").isNull()
    kept = failsafe.guarded(df, value, "n", bad, "no number").collect()
    assert [(r["n"], r["status"], r["error"]) for r in kept] == [(1, 1, None), (None, -1, "no number"), (None, 0, None)]
    assert failsafe.guarded(df, value, "n", bad, "no number", "ignore").count() == 2
    with pytest.raises(Exception, match="no number"):
        failsafe.guarded(df, value, "n", bad, "no number", "fail").collect()


def test_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("time,position,temp [C],none [V]\n2020-01-01 00:00:00,1,3.5,\n2020-01-02 00:00:00,2,4.5,\n")
    got = files.sensor_table(spark, str(tmp_path / "s.csv"), "time", position=2).collect()
    assert [(r["name"], r["unit"], r["value"]) for r in got] == [("temp", "C", 4.5)]
    for name in ("2017-01-05/20170105_123000.JPG", "2017-01-06/20170106_010000.JPG", "x/20170105_123000.JPG"):
        (tmp_path / "im" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "im" / name).write_bytes(b"abc")
    assert files.image_listing(spark, str(tmp_path / "im")).count() == 2
    one = files.images(spark, str(tmp_path / "im"), {"start": datetime(2017, 1, 6, 1), "stop": datetime(2017, 1, 6, 1)}).collect()
    assert [r["base64"] for r in one] == ["YWJj"] and files.images(spark, str(tmp_path / "im"), {"start": datetime(2018, 1, 1)}).count() == 0
    raw = spark.createDataFrame([(bytes([0x80, 0, 1, 0x7F, 0xFF, 0xFF]),), (None,)], "b binary")
    assert [r[0] for r in raw.select(files.decode_adc(F.col("b"), 3)).collect()] == [[1.0, -1.0], None]
    meta = files.event_metadata(spark.createDataFrame([(1_500_000_000_000_000, "Z;E;N", 300, 100.0)], "first_us long, channels string, samples long, rate double")).first()
    assert meta["channels"] == ["EHZ", "EHE", "EHN"] and meta["samples"] == 100 and meta["end"] - meta["start"] == timedelta(milliseconds=990)
    requests = spark.createDataFrame([("A", None, 1), (None, None, 2)], "station string, gone string, n int")
    files.requests_to_json(requests, str(tmp_path / "r"))
    assert set(files.requests_from_json(spark, str(tmp_path / "r")).columns) == {"station", "n"}
    events = spark.createDataFrame([(day(5, 1), day(5, 2)), (day(5, 23), day(6, 1)), (day(7), day(7, 1))], "start timestamp_ntz, end timestamp_ntz")
    events.withColumn("day", F.to_date("start")).write.partitionBy("day").parquet(str(tmp_path / "e"))
    assert files.event_files(spark, str(tmp_path / "e"), day(6, 0), day(6, 5)).count() == 1
    with pytest.raises(Exception, match="mixed"):
        files.one_rate(spark.createDataFrame([(1, 100.0), (1, 50.0)], "k int, sampling_rate double"), ["k"]).collect()


def test_dataset(spark):
    a, b = (spark.createDataFrame([(i, i * k) for i in range(5 + k)], f"index long, v{k} long") for k in (1, 2))
    data = RequestDataset([Request({"i": i}) for i in range(6)], a).join(RequestDataset([], b)).mask_invalid(a.filter("index = 2"))
    assert len(data) == 6 and {r["index"] for r in data.rows().collect()} == {0, 1, 3, 4, 5} and data[3].first()["v2"] == 6
    assert data.requests_frame(spark).count() == 6


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2020, 1, 1, h), float(h)) for h in range(24)], "k string, ts timestamp_ntz, value double")
    rows.filter("value < 12").write.mode("append").parquet(f"{tmp_path}/in")
    for n in (12, 24, 24):
        if n == 24 and not (tmp_path / "second").exists():
            rows.filter("value >= 12").write.mode("append").parquet(f"{tmp_path}/in")
            (tmp_path / "second").touch()
        ingest(spark, f"{tmp_path}/in", "k string, ts timestamp_ntz, value double", f"{tmp_path}/out", f"{tmp_path}/ck", timedelta(hours=6)).awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == n
    stream = spark.readStream.schema("k string, ts timestamp_ntz, value double").parquet(f"{tmp_path}/in")
    q = windowed_max(stream, ["k"], "6 hours", "1 hour").writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["value"] for r in spark.table("w").collect()} >= {5.0, 11.0}


def entry_by_itself(path, before=""):
    import subprocess
    import sys

    code = before + "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q) and not any(x.startswith('op') for x in q)"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_imports_without_the_subpackage(tmp_path):
    import shutil
    from pathlib import Path

    here = Path(__file__).resolve().parents[1]
    shutil.copytree(here / "cubespark", tmp_path / "cubespark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    entry_by_itself(tmp_path)


def test_imports_without_a_library_of_the_subpackage():
    from pathlib import Path

    entry_by_itself(Path(__file__).resolve().parents[1], "import sys; sys.modules['ahocorasick'] = None; ")


def test_overlap_join_makes_no_more_candidates_than_it_must(spark, monkeypatch):
    """Long intervals meet short ones at their own level only; what shares a cell there mostly overlaps."""
    rng = np.random.default_rng(3)
    at = lambda s: datetime(2000, 1, 1) + timedelta(minutes=int(s))
    def some(n, lengths):
        return [(i, at(s), at(s + rng.choice(lengths))) for i, s in enumerate(rng.integers(0, 500_000, n))]
    ann = spark.createDataFrame(some(1500, [5, 60, 200_000]), "ann long, a_start timestamp_ntz, a_stop timestamp_ntz")
    req = spark.createDataFrame(some(800, [10, 90]), "req long, r_start timestamp_ntz, r_stop timestamp_ntz")
    formed, matched = [], joins._matched
    def counted(*args):
        out = matched(*args)
        formed.append(out.count())
        return out
    monkeypatch.setattr(joins, "_matched", counted)
    for salts in (1, 3):
        formed.clear()
        pairs = joins.overlap_join(ann, req, timedelta(hours=2), salts=salts).count()
        assert 0 < pairs <= sum(formed) < 3 * pairs and pairs == ann.join(req, joins.overlaps(F.col("a_start"), F.col("a_stop"), F.col("r_start"), F.col("r_stop"))).count()
        short = ann.filter("a_stop < a_start + interval 2 hours")
        formed.clear()
        joins.overlap_join(short, req, timedelta(hours=2), salts=salts)
        assert sum(formed) < 10 * short.count()  # of 800,000 pairs


def test_overlap_join_with_lists(spark):
    """Any element of the one list, or scalar, is in the other."""
    ann = spark.createDataFrame([(0, ["A", "B"], day(1), day(3)), (1, ["C"], day(1), day(3)), (2, None, day(1), day(3)), (3, ["A"], day(9), day(8))], "ann long, station array<string>, a_start timestamp_ntz, a_stop timestamp_ntz")
    req = spark.createDataFrame([(0, "B", day(2), day(4)), (1, "C", day(2), day(4)), (2, "A", day(5), day(9))], "req long, station string, r_start timestamp_ntz, r_stop timestamp_ntz")
    pairs = lambda a, r: {(x["ann"], x["req"]) for x in joins.overlap_join(a, r, timedelta(days=1), any_of=["station"]).collect()}
    assert pairs(ann, req) == {(0, 0), (1, 1)}
    lists = req.withColumn("station", F.array("station", F.lit("C")))
    assert pairs(ann, lists) == {(0, 0), (1, 0), (1, 1)} and joins.overlap_join(ann, lists, timedelta(days=1), any_of=["station"]).columns.count("station") == 1


def test_asof_join_cell_by_cell(spark):
    rng = np.random.default_rng(2)
    rows = lambda n: [(int(k), datetime(1999, 12, 30) + timedelta(hours=int(h)), int(v)) for k, h, v in zip(rng.integers(0, 4, n), rng.integers(0, 300, n), rng.integers(0, 9, n))]
    a, b = rows(200) + [(None, datetime(2000, 1, 1), 5)], rows(60) + [(None, datetime(2000, 1, 1), 5)]
    left, right = spark.createDataFrame(a, "k long, ts timestamp_ntz, x long"), spark.createDataFrame(b, "k long, ts timestamp_ntz, y long")
    got = [tuple(r) for r in joins.asof_backward(left, right, ["k"], "ts", ["y"]).collect()]
    want = [(k, t, x, max(((u, y) for j, u, y in b if j == k is not None and u <= t), default=(None, None))[1]) for k, t, x in a]
    assert sorted(got, key=str) == sorted(want, key=str) and any(y is None for *_, y in got)


def test_interval_queries_cover_whole_tables(spark, tmp_path):
    """Every order is a request and every line an unclipped annotation of its customer, whatever its id, line number or length."""
    from cubespark.queries import queries

    rng = np.random.default_rng(6)
    orders = [(i, i % 3, datetime(2000, 1, 1) + timedelta(days=int(rng.integers(0, 400))), ["1-URGENT", "2-HIGH", "3-MEDIUM"][i % 2]) for i in range(1, 41)]
    lines = [(k, n, at + timedelta(days=int(rng.choice([-300, -61, -60, -3, 0, 3, 60, 61, 300])))) for k, _, at, _ in orders for n in (1, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    of = {k: (c, at, kind) for k, c, at, kind in orders}
    spans = [(k, n, min(of[k][1], ship), max(of[k][1], ship)) for k, n, ship in lines]
    whole = [(a, n, r, a0, a1, at, at + timedelta(days=3)) for a, n, a0, a1 in spans for r, c, at, _ in orders if c == of[a][0]]
    follows = {"1-URGENT": "2-HIGH", "2-HIGH": "3-MEDIUM"}
    tests = {
        "overlap_neither": lambda a, n, r, a0, a1, b0, b1: a1 >= b0 and a0 <= b1,
        "overlap_both": lambda a, n, r, a0, a1, b0, b1: a1 > b0 and a0 < b1,
        "overlap_left": lambda a, n, r, a0, a1, b0, b1: a1 >= b0 and a0 < b1,
        "overlap_right": lambda a, n, r, a0, a1, b0, b1: a1 > b0 and a0 <= b1,
        "overlap_with_membership": lambda a, n, r, a0, a1, b0, b1: a1 >= b0 and a0 <= b1 and of[a][2] == of[r][2],
        "overlap_any_of": lambda a, n, r, a0, a1, b0, b1: a1 >= b0 and a0 <= b1 and of[r][2] in (of[a][2], follows[of[a][2]]),
    }
    for name, holds in tests.items():
        got = [tuple(x) for x in queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(x[:3] for x in whole if holds(*x)) != [], name
    near = {(x[0], x[2]) for x in whole if tests["overlap_with_membership"](*x) and x[0] != x[2]}
    got = {r["req_id"]: r["annotations"] for r in queries()["annotations_per_request"](spark, str(tmp_path)).collect()}
    assert got == {k: ",".join(sorted({str(a) for a, r in near if r == k})) for k in of}


KEYED = ["overlap_neither", "overlap_left", "overlap_right", "overlap_both", "overlap_any_of", "overlap_with_membership", "annotations_per_request"]


@pytest.mark.parametrize("name", KEYED)
def test_keyed_overlap_makes_no_copies(spark, monkeypatch, name):
    """A customer has few orders, so each line and each order goes to the join once, whatever its length."""
    from cubespark.queries import queries

    given, matched = [], joins._matched
    monkeypatch.setattr(joins, "_matched", lambda left, right, *rest: given.append(left.count() + right.count()) or matched(left, right, *rest))
    queries()[name](spark, SF)
    assert sum(given) == sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("lineitem", "orders"))


@pytest.mark.parametrize("salts", [1, 3])
def test_crowded_keys_alone_go_by_cells(spark, monkeypatch, salts):
    """Keys of more requests than an interval may have cells are joined by cells, the others as they are; each pair comes once."""
    rng = np.random.default_rng(8)
    at = lambda s: datetime(2000, 1, 1) + timedelta(hours=int(s))
    def some(n, keys):
        return [(i, keys[i % len(keys)], at(s), at(s + rng.choice([-1, 0, 2, 30, 3000]))) for i, s in enumerate(rng.integers(0, 900, n))]
    a, r = some(150, ["crowded", "few", "lonely", None]), some(60, ["crowded", "crowded", "crowded", "few", None, "other"])
    ann, req = spark.createDataFrame(a, "ann long, k string, a_start timestamp_ntz, a_stop timestamp_ntz"), spark.createDataFrame(r, "req long, k string, r_start timestamp_ntz, r_stop timestamp_ntz")
    keys, matched = [], joins._matched
    monkeypatch.setattr(joins, "_matched", lambda left, right, on, any_of: keys.append(("_cell" in on, {x["k"] for x in right.collect()})) or matched(left, right, on, any_of))
    out = joins.overlap_join(ann, req, timedelta(hours=4), "left", on=["k"], most_bins=16, salts=salts)
    got = [(x["ann"], x["req"]) for x in out.collect()]
    want = [(i, j) for i, k, s, e in a for j, m, s2, e2 in r if k == m is not None and s <= e and s2 <= e2 and e >= s2 and s < e2]
    assert sorted(got) == sorted(want) != [] and out.columns == ["k", "ann", "a_start", "a_stop", "req", "r_start", "r_stop"]
    assert keys[0] == (False, {"few", None, "other"}) and all(by and found <= {"crowded"} for by, found in keys[1:]) and len(keys) == 3
