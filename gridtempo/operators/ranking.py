"""Ranks, positions and order statistics of groups of any size, none of which is sorted in one task.

Equal values are counted first, so that a hot value is one row. Distinct values are dealt by sampled ranges over (group, value); each range
adds up its own counts, and what all earlier ranges of the group hold is added from a table of one row for each range and group. Nulls come before all values and
are equal to one another, NaN comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import checkpoint


def frequencies(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows (by, value, __n, __before), checkpointed: how often each distinct value of a group occurs, and how many rows of the group have a smaller one."""
    return cumulated(rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")), by, value, {"__n": "__before"})


def cumulated(counted: DataFrame, by: list[str], value: str, counts: dict[str, str]) -> DataFrame:
    """The rows, one for each distinct (by, value), checkpointed, with the sums of some counts over the group's smaller values. ``counts``: the name of each count's sum."""
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The ranges' bounds come from a sample, so their numbers are fixed once.
    placed = checkpoint(counted.repartitionByRange(parts, *by, value).withColumn("__range", F.spark_partition_id()))
    over = Window.partitionBy("__range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inner = {f"__in_{n}": F.sum(n).over(over) for n in counts}
    totals = placed.groupBy("__range", *by).agg(*[F.sum(n).alias(f"__of_{n}") for n in counts])
    if by:
        earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(F.struct("__range", *by).alias("__at"), *[F.coalesce(F.sum(f"__of_{n}").over(earlier), F.lit(0)).alias(f"__of_{n}") for n in counts])
        summed = placed.withColumns({**inner, "__at": F.struct("__range", *by)}).join(offsets, "__at")
    else:  # a row for each range, as many as partitions
        known, summed = {r["__range"]: r for r in totals.collect()}, placed.withColumns(inner)
        for n in counts:
            offsets = [0]
            for i in range(parts):
                offsets.append(offsets[-1] + (known[i][f"__of_{n}"] if i in known else 0))
            summed = summed.withColumn(f"__of_{n}", F.get(F.lit(offsets), F.col("__range")))
    return checkpoint(summed.select(*counted.columns, *[(F.coalesce(f"__in_{n}", F.lit(0)) + F.col(f"__of_{n}")).cast("long").alias(out) for n, out in counts.items()]))


def placed(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Rows, one for each distinct (by, value), with their place from 0 within the group; they are not joined with their places."""
    return cumulated(rows.withColumn("__one", F.lit(1)), by, value, {"__one": out}).drop("__one")


def with_frequencies(rows: DataFrame, found: DataFrame, by: list[str], value: str) -> DataFrame:
    """The rows with __n and __before of their value. Both sides are plain exchanges, so that adaptive execution splits a hot value."""
    key = F.struct(*by, value)
    return rows.withColumn("__key", key).join(found.select(key.alias("__key"), "__n", "__before"), "__key").drop("__key")


def average_ranks(rows: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks from 1 within a group (of all rows without ``by``), ties sharing their mean."""
    ranked = with_frequencies(rows.drop(out), frequencies(rows, by, value), by, value)
    return ranked.withColumn(out, F.col("__before") + (F.col("__n") + 1) / 2).drop("__n", "__before")


def positions(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Distinct (by, value) with their place from 0 within the group."""
    return frequencies(rows.select(*by, value).distinct(), by, value).select(*by, value, F.col("__before").alias(out))


def rank_counts(rows: DataFrame, chain: str, value: str, bins: int) -> DataFrame:
    """Per chain, how many of its draws fall in each bin of the ranks over all chains."""
    total = rows.count()
    own = rows.groupBy(chain, value).agg(F.count(F.lit(1)).alias("__own"))
    ranked = with_frequencies(own, frequencies(rows, [], value), [], value)
    at = F.least(F.floor((F.col("__before") + F.col("__n") / 2) / F.lit(max(total, 1)) * bins) + 1, F.lit(bins)).cast("int")
    return ranked.groupBy(chain, at.alias("bin")).agg(F.sum("__own").alias("n"))


def at_positions(found: DataFrame, by: list[str], wanted: DataFrame, value: str) -> DataFrame:
    """Rows (by, name, value): the values at places (from 0) of the sorted groups of ``found``; ``wanted``: rows (by, places array<struct<name, place>>)."""
    places = wanted.select(F.struct(*by).alias("__key"), "places")
    inside = F.filter("places", lambda p: (p["place"] >= F.col("__before")) & (p["place"] < F.col("__before") + F.col("__n")))
    return found.withColumn("__key", F.struct(*by)).join(places, "__key").select(*by, F.explode(inside).alias("p"), value).select(*by, "p.name", value)


def interpolated(low: Column, high: Column, part: Column) -> Column:
    """Between two neighbouring order statistics, from the nearer one."""
    return F.when(part < 0.5, low + (high - low) * part).otherwise(high - (high - low) * (1 - part))
