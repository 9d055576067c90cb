"""Long series in time buckets, so that one series is many tasks' work.

Windows of a bounded reach get the rows within their reach copied from the neighbouring buckets (:func:`in_buckets`). What may reach back any distance, such as the last known
value, is found in two levels (:func:`with_neighbours`): within a bucket by its rows, beyond it from a table of one row for each bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .timegrid import HALF_HOUR, order


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000.0


def in_buckets(series: DataFrame, keys: list[str], before: int, after: int, bucket: int, fn: Callable[[DataFrame, list[str]], DataFrame], ts: str = "ts", step: int = HALF_HOUR) -> DataFrame:
    """``fn(rows, keys)`` applied to each bucket of ``bucket`` steps and the rows up to ``before`` steps before and ``after`` steps after it.

    For series on their strict grid of ``step`` seconds (:func:`timegrid.align`), where windows by rows are windows by time: the result is that of ``fn(series, keys)`` as long
    as no row of it depends on rows further away. ``fn`` keeps its rows and their other columns. A row is copied 1 + (before + after) / bucket times on average.
    """
    at = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(step * 1_000_000))
    of = lambda i: F.floor(i / F.lit(bucket)).cast("long")
    rows = series.withColumns({"__own": of(at), "__bucket": F.explode(F.sequence(of(at - after), of(at + before)))})
    return fn(rows, [*keys, "__bucket"]).filter("__own = __bucket").drop("__own", "__bucket")


def _reading(value: str, ts: str) -> Column:
    return F.when(F.col(value).isNotNull(), F.struct(seconds(ts).alias("t"), F.col(value).cast("double").alias("v"), F.col("__row")))


def _within(rows: DataFrame, keys: list[str], columns: list[str], ts: str) -> DataFrame:
    """Adds __row and, for each column, the nearest readings at or before (__a_) and at or after (__b_) each row.

    The one after is the last in descending order: a frame up to unbounded following would be evaluated anew for every row.
    """
    rows = rows.withColumn("__row", F.row_number().over(order(keys, ts)).cast("long"))
    forth, back = order(keys, ts), Window.partitionBy(*keys).orderBy(F.desc(ts))
    known = lambda c, w: F.last(_reading(c, ts), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({f"__a_{c}": known(c, forth) for c in columns}).withColumns({f"__b_{c}": known(c, back) for c in columns})


def with_neighbours(series: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", bucket: int | None = None) -> DataFrame:
    """Adds __row, the row's number in its series, and for each column __a_ and __b_, the nearest readings (t, v, __row) at or before and at or after each row.

    With a ``bucket`` (seconds; the grid need not be strict) a task has one bucket's rows, and what lies beyond comes from a scan over buckets.
    """
    if bucket is None:
        return _within(series, keys, columns, ts)
    named = series.withColumn("__bucket", F.floor(seconds(ts) / bucket).cast("long"))
    inner = [*keys, "__bucket"]
    rows = _within(named, inner, columns, ts)
    ends = rows.groupBy(*inner).agg(F.count(F.lit(1)).alias("__n"), *[f(_reading(c, ts)).alias(f"{n}{c}") for c in columns for n, f in (("__f_", F.min), ("__l_", F.max))])
    forth, back = order(keys, "__bucket"), Window.partitionBy(*keys).orderBy(F.desc("__bucket"))
    ends = ends.withColumn("__start", F.coalesce(F.sum("__n").over(forth.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    moved = lambda c, start: F.when(c.isNotNull(), F.struct(c["t"].alias("t"), c["v"].alias("v"), (c["__row"] + start).alias("__row")))
    ends = ends.withColumns({f"{n}{c}": moved(F.col(f"{n}{c}"), F.col("__start")) for c in columns for n in ("__f_", "__l_")})
    carried = {f"__c{n}{c}": F.last(f"{n}{c}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for c in columns for n, w in (("__f_", back), ("__l_", forth))}
    told = ends.withColumns(carried).select(F.struct(*inner).alias("__key"), "__start", *carried)
    both = rows.withColumn("__key", F.struct(*inner)).join(told, "__key")
    near = {f"__a_{c}": F.coalesce(moved(F.col(f"__a_{c}"), F.col("__start")), F.col(f"__c__l_{c}")) for c in columns} | {f"__b_{c}": F.coalesce(moved(F.col(f"__b_{c}"), F.col("__start")), F.col(f"__c__f_{c}")) for c in columns}
    return both.withColumns(near).withColumn("__row", F.col("__row") + F.col("__start")).drop("__key", "__bucket", "__start", *carried)
