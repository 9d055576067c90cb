import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtempo.operators import gates, timegrid
from gridtempo.sources import readers
from gridtempo.streaming import resample


def test_price_files_become_utc_half_hours(spark, tmp_path):
    (tmp_path / "p.csv").write_text("REGION,SETTLEMENTDATE,TOTALDEMAND,RRP,PERIODTYPE\nNSW1,2025/06/02 00:05:00,100,1,TRADE\nNSW1,2025/06/02 00:30:00,300,1,TRADE\nVIC1,2025/06/02 00:05:00,5,1,TRADE\nNSW1,2025/06/02 00:00:00,7,1,TRADE\n")
    got = readers.price_and_demand(spark, [str(tmp_path / "p.csv")], "NSW1", "2025-06-02", "2025-06-02").collect()
    assert [(r.ts, r.demand_mw) for r in got] == [(dt.datetime(2025, 6, 1, 14, 0), 200.0)]


def test_price_files_of_another_order_are_refused(spark, tmp_path):
    (tmp_path / "q.csv").write_text("SETTLEMENTDATE,REGION,TOTALDEMAND,RRP,PERIODTYPE\n2025/06/02 00:05:00,NSW1,100,1,TRADE\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.price_and_demand(spark, [str(tmp_path / "q.csv")], "NSW1", "2025-06-02", "2025-06-02").collect()


def test_nested_archives_keep_the_latest_revision(spark, tmp_path):
    row = lambda end, mw, changed, region="NSW1": f'D,OPERATIONAL_DEMAND,ACTUAL,3,{region},"{end}",{mw},0,0,"{changed}"'
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.CSV", "\n".join(["C,header", row("2025/06/02 00:30:00", 10, "2025/06/02 00:31:00"), row("2025/06/02 00:30:00", 12, "2025/06/02 00:40:00"), row("2025/06/02 00:30:00", 99, "2025/06/02 00:50:00", "VIC1")]))
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("b.zip", inner.getvalue())
    (tmp_path / "week.zip").write_bytes(outer.getvalue())
    got = readers.operational_demand(spark, str(tmp_path), "NSW1", "2025-06-02", "2025-06-02").collect()
    assert [(r.ts, r.demand_mw) for r in got] == [(dt.datetime(2025, 6, 1, 14, 0), 12.0)]


def test_weather_payloads_become_rows(spark, tmp_path):
    for k, t0 in enumerate((0, 1)):
        (tmp_path / f"{k}.json").write_text(json.dumps({"hourly": {"time": [f"2025-06-01T0{t0 + i}:00" for i in range(2)], "temp_previous_day1": [10.0 + k, None]}}))
    got = readers.hourly_weather(spark, str(tmp_path), ["temp"], 1).orderBy("ts").collect()
    assert [(r.ts.hour, r.temp) for r in got] == [(0, 10.0), (1, None), (2, None)]


def test_file_pruning():
    assert readers.months(dt.date(2024, 12, 5), dt.date(2025, 1, 3)) == ["202411", "202412", "202501", "202502"]
    assert readers.chunks(dt.date(2025, 1, 1), dt.date(2025, 1, 5), 2) == [(dt.date(2025, 1, a), dt.date(2025, 1, b)) for a, b in ((1, 2), (3, 4), (5, 5))]
    assert readers.required_weeks(dt.date(2025, 6, 4), dt.date(2025, 6, 7)) == [dt.date(2025, 6, 1), dt.date(2025, 6, 8)]
    assert readers.archive_weeks("x_ACTUAL_HH_20250608.zip y_ACTUAL_HH_20250601.zip z_ACTUAL_HH_20250608.zip") == ["20250601", "20250608"]


def test_artifacts_round_trip(spark, tmp_path):
    readers.write_artifact({"draws": spark.range(3).toDF("x")}, {"seed": 1}, str(tmp_path / "a"))
    tables, meta = readers.read_artifact(spark, str(tmp_path / "a"), ["draws"])
    assert meta == {"seed": 1} and tables["draws"].count() == 3


def test_streams_give_the_batch_rows(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value").withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    far = spark.createDataFrame([("view", dt.datetime(2030, 1, 1), 0.0)], "event_type string, ts timestamp_ntz, value double")
    events.repartition(1).write.parquet(str(tmp_path / "in/a"))
    far.write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = resample.resample_stream(stream, ["event_type"], "ts", "value")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lambda d: sorted((r.event_type, r.ts, round(r.demand_mw, 9)) for r in d.collect())
    want = timegrid.period_end_resample(events, ["event_type"], "ts", "value")
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(want)


def test_stream_keeps_the_latest_revision(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(1, k, f"v{k}"), (2 + k, k, "x")], "k int, changed int, v string").write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("k int, changed int, v string").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = resample.keep_latest(stream, ["k"], "changed", str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t/v0")).collect()} == {(1, "v1"), (2, "x"), (3, "x")}


def test_stream_versions_expire_and_ties_are_settled(spark, tmp_path):
    def feed(k, *rows):
        spark.createDataFrame(list(rows), "k int, changed int, v string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema("k int, changed int, v string").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        resample.keep_latest(stream, ["k"], "changed", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)

    feed(0, (1, 5, "b"), (1, 5, "a"), (2, 1, "old"))
    feed(1, (1, 5, "aa"), (2, 2, "new"))
    feed(2, (3, 0, "x"), (2, 1, "late"))
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v1", "v2"]
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t/v2")).collect()} == {(1, "b"), (2, "new"), (3, "x")}


def test_stream_keeps_one_record_a_key(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, at, "a"), (1, at, "a"), (2, at, "b")], "k int, ts timestamp, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp, v string").parquet(str(tmp_path / "in"))
    q = resample.first_revisions(stream, ["k"], "ts").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "b")]


def test_panels_load_through_the_gate_and_split(spark, tmp_path):
    day = dt.timedelta(days=1)
    rows = [("a", dt.datetime(2025, 6, 1) + i * day, 5.0 + i) for i in range(6)]
    panel = spark.createDataFrame(rows, "k string, ts timestamp_ntz, demand_mw double")
    readers.write_panel(panel, str(tmp_path / "p"))
    schema = T.StructType([T.StructField("demand_mw", T.DoubleType())])
    loaded = readers.load_panel(spark, str(tmp_path / "p"), schema, ["k"], positive="demand_mw")
    labels = spark.createDataFrame([(r[1], s) for r, s in zip(rows, ["train", "train", "validation", "test", "none"], strict=False)], "ts timestamp_ntz, split string")
    labels.write.parquet(str(tmp_path / "l"))
    parts = readers.load_splits(spark, loaded, str(tmp_path / "l"))
    assert {n: d.count() for n, d in parts.items()} == {"train": 2, "validation": 1, "test": 1}
    labels.withColumn("split", F.when(F.col("split") == "test", "train").otherwise(F.col("split"))).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        readers.load_splits(spark, loaded, str(tmp_path / "bad"))
    readers.write_panel(panel.withColumn("demand_mw", -F.col("demand_mw")), str(tmp_path / "n"))
    with pytest.raises(gates.GateError):
        readers.load_panel(spark, str(tmp_path / "n"), schema, ["k"], positive="demand_mw")
