"""Readers of the raw sources and writers of the tables: declared schemas, pruning by file list, nothing inferred."""

from __future__ import annotations

import datetime as dt
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import gates, splits, timegrid

MARKET = "Australia/Brisbane"
# The columns of price and demand files; the record prefix and columns of operational demand files.
PRICE = "REGION string, SETTLEMENTDATE string, TOTALDEMAND double, RRP double, PERIODTYPE string"
RECORD = "D,OPERATIONAL_DEMAND,ACTUAL"
OPERATIONAL = "row_type string, table string, subtable string, version string, regionid string, interval_datetime string, operational_demand double, operational_demand_adjustment double, wdr_estimate double, lastchanged string"
STAMP = "yyyy/MM/dd HH:mm:ss"


def months(first: dt.date, last: dt.date) -> list[str]:
    """All months from the one before ``first`` to the one after ``last``, as yyyymm: which files to read."""
    at, out = first.year * 12 + first.month - 2, []
    while at <= last.year * 12 + last.month:
        out.append(f"{at // 12}{at % 12 + 1:02d}")
        at += 1
    return out


def chunks(first: dt.date, last: dt.date, days: int = 180) -> list[tuple[dt.date, dt.date]]:
    """Inclusive spans of at most ``days`` days that cover the range."""
    out = []
    while first <= last:
        end = min(last, first + dt.timedelta(days=days - 1))
        out.append((first, end))
        first = end + dt.timedelta(days=1)
    return out


def archive_weeks(listing: str) -> list[str]:
    """The distinct week stamps in a directory listing, in order."""
    return sorted(set(re.findall(r"ACTUAL_HH_(\d{8})\.zip", listing, re.I)) or set(re.findall(r"(\d{8})\.zip", listing, re.I)))


def required_weeks(first: dt.date, last: dt.date) -> list[dt.date]:
    """The Sundays whose week files cover half past midnight of the first day to midnight after the last."""
    sunday = first - dt.timedelta(days=(first.weekday() + 1) % 7)
    out = []
    while sunday <= last + dt.timedelta(days=1):
        out.append(sunday)
        sunday += dt.timedelta(days=7)
    return out


def price_and_demand(spark: SparkSession, paths: list[str], region: str, first: str, last: str) -> DataFrame:
    """Half-hour demand in UTC from five-minute CSV files; a file whose header has other names or another order is an error."""
    raw = spark.read.schema(PRICE).option("header", True).option("enforceSchema", False).csv(paths)
    rows = raw.filter(F.col("REGION") == region).select(F.lit(region).alias("series_id"), F.to_timestamp_ntz("SETTLEMENTDATE", F.lit(STAMP)).alias("t"), "TOTALDEMAND")
    half = timegrid.period_end_resample(rows, ["series_id"], "t", "TOTALDEMAND")
    return within(half, first, last)


def within(half: DataFrame, first: str, last: str, ts: str = "ts") -> DataFrame:
    """Market days from first to last, then market time to UTC."""
    inside = half.filter(F.to_date(ts).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return inside.withColumn(ts, timegrid.to_zone(F.col(ts), MARKET, "UTC"))


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """Record lines of zip files that hold zip files of CSV: one task for each archive, filtered by prefix before parsing."""

    def members(data: bytes) -> Iterator[bytes]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in z.namelist():
                body = z.read(name)
                if name.lower().endswith(".zip"):
                    yield from members(body)
                else:
                    yield body

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prefix = RECORD.encode()
        for batch in batches:
            for content in batch["content"]:
                for body in members(bytes(content)):
                    yield pd.DataFrame({"line": [x.decode("utf-8", "replace") for x in body.splitlines() if x.startswith(prefix)]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content").mapInPandas(run, "line string")


def operational_demand(spark: SparkSession, path: str, region: str, first: str, last: str) -> DataFrame:
    """Half-hour demand in UTC, the latest revision of each period."""
    parsed = archive_lines(spark, path).select(F.from_csv("line", F.lit(OPERATIONAL)).alias("r")).select("r.*").filter(F.col("regionid") == region)
    stamp = lambda c: F.to_timestamp_ntz(F.replace(c, F.lit('"'), F.lit("")), F.lit(STAMP))
    rows = parsed.select(F.col("regionid").alias("series_id"), stamp(F.col("interval_datetime")).alias("end"), stamp(F.col("lastchanged")).alias("changed"), F.col("operational_demand").alias("demand_mw"))
    latest = timegrid.latest_revision(rows, ["series_id", "end"], "changed", "demand_mw")
    half = latest.select("series_id", (F.col("end") - F.expr("INTERVAL 30 MINUTES")).cast("timestamp_ntz").alias("ts"), "demand_mw")
    return within(half, first, last)


def hourly_weather(spark: SparkSession, path: str, variables: list[str], lead_days: int | None = None) -> DataFrame:
    """Hourly rows from column-oriented JSON payloads ({"hourly": {"time": [...], variable: [...]}}); of repeated times one stays."""
    suffix = f"_previous_day{lead_days}" if lead_days else ""
    fields = ", ".join(["time: array<string>", *[f"{v}{suffix}: array<double>" for v in variables]])
    rows = spark.read.option("wholetext", True).text(path).select(F.from_json("value", f"hourly struct<{fields}>").alias("j"), F.input_file_name().alias("file")).select("file", "j.hourly.*")
    each = rows.select("file", F.explode(F.arrays_zip("time", *[f"{v}{suffix}" for v in variables])).alias("h"))
    flat = each.select("file", F.to_timestamp_ntz(F.col("h.time"), F.lit("yyyy-MM-dd'T'HH:mm")).alias("ts"), *[F.col(f"h.{v}{suffix}").alias(v) for v in variables])
    first = flat.groupBy("ts").agg(F.min_by(F.struct(*variables), "file").alias("r"))
    return first.select("ts", "r.*")


def write_panel(panel: DataFrame, path: str, by: str | None = None) -> None:
    writer = panel.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_artifact(tables: dict[str, DataFrame], meta: dict, path: str) -> None:
    """Each table as Parquet beside one JSON row of metadata."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")


def read_artifact(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    meta = json.loads(spark.read.text(f"{path}/_meta").first()[0])
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, meta


def load_panel(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], positive: str | None = None) -> DataFrame:
    """A panel that has passed the schema gate."""
    panel = spark.read.parquet(path)
    gates.check_schema(panel, schema, keys, positive=positive)
    return panel


def load_splits(spark: SparkSession, panel: DataFrame, labels_path: str, ts: str = "ts") -> dict[str, DataFrame]:
    """The panel by split label; a row without a label is in none. Training must come before what is scored."""
    labels = spark.read.parquet(labels_path).select(ts, "split")
    labelled = panel.join(labels, ts, "left").withColumn("split", F.coalesce("split", F.lit("none")))
    splits.check_order(labelled, ts)
    return {name: labelled.filter(F.col("split") == name).drop("split") for name in ("train", "validation", "test")}
