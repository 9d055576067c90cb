"""Sharding by sampled splitters into shards of near-equal bytes. DataFrame operations only.

A sample of text hashes, drawn with chances in proportion to size, gives quantile boundaries; records are range-partitioned by them.
Exact counts of the ranges' bytes and rows then show the overfull ones, which are subdivided: by another hash of the text, or, for a
text with over half a range's share (a large group of copies), by the hash of the row. So no range is much above its share, whatever
the groups. Prefix sums over the ranges (a bounded number) and inside each place every record on one line of bytes, which is cut
into equal shards. Equal texts stand together; a group goes to one shard if it's below ``group_share`` of a shard, else the
line cuts it.

Law: ``bytes``. Sizes are UTF-8 bytes plus 1.

Defined results: a null text has size 1 and checksum 0 and groups with other null texts; null ids, repeated rows and ties
have places of their own (a row's hash orders them); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import checkpoint, row_key

RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 250, 16, 8192
SAMPLE_FOR_RANGE = 8
GROUP_SHARE = 0.02


def records(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    empty = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("id"),
        (F.octet_length(empty) + 1).cast("long").alias("size"),
        F.crc32(empty.cast("binary")).alias("text_crc32"),
        row_key(text).alias("text_key"),
        row_key(doc_id, text).alias("row_key"),
    )


def splitters(rows: DataFrame, ranges: int, total: int) -> DataFrame:
    """One row, one array: sorted boundaries at the quantiles of a size-weighted sample of text keys.

    A record comes before another in the sample if an exponential draw of rate ``size`` is smaller, so that large ones come first. Of records
    whose draw is below some three times the sample's expected end, the first are taken: few leave their tasks, however many there are.
    """
    most = ranges * SAMPLE_FOR_RANGE
    uniform = (F.pmod(F.xxhash64("row_key", F.lit("draw")), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    waiting = rows.select("text_key", (-F.ln(uniform) / F.col("size")).alias("wait"), "row_key")
    drawn = waiting.filter(F.col("wait") < 3.0 * most / max(total, 1)).orderBy("wait", "row_key").limit(most)
    every = drawn.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("text_key"))).filter(F.pmod("at", F.lit(SAMPLE_FOR_RANGE)) == 0)
    return every.agg(F.array_sort(F.array_distinct(F.collect_list("text_key"))).alias("splitters"))


def range_of(key: Column, sorted_splitters: Column, most: int) -> Column:
    """How many splitters are at most ``key``, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in range(most.bit_length() - 1, -1, -1)])

    def step(at: Column, width: Column) -> Column:
        reach = at + width
        return F.when((reach <= F.size(sorted_splitters)) & (F.get(sorted_splitters, reach - 1) <= key), reach).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", group_share: float = GROUP_SHARE) -> DataFrame:
    """One row for each row of ``docs``: id, row_key, size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    rows = checkpoint(records(docs, doc_id, text))
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(LEAST_RANGES, min(MOST_RANGES, -(-count // RANGE_ROWS)))
    bounds = checkpoint(splitters(rows, ranges, total))
    ranged = rows.withColumn("splitters", bounds.scalar()).withColumn("range", range_of(F.col("text_key"), F.col("splitters"), ranges)).drop("splitters")

    filled = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    fill = F.greatest(*[F.col(c) * ranges / F.sum(c).over(Window.partitionBy(F.lit(0))) for c in ("bytes", "rows")])
    parts = filled.select("range", F.when(fill > 2, F.ceil(fill)).otherwise(1).cast("int").alias("parts"))
    plan = checkpoint(parts.agg(F.array_agg(F.when(F.col("parts") > 1, F.struct("range", "parts"))).alias("p")).select(F.map_from_entries("p").alias("plan")))
    # a text with over half a range's share: there are at most four for each range, hence the broadcast
    over = (F.col("rows") * (2 * ranges) > count) | (F.col("bytes") * (2 * ranges) > total)
    large = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).filter(over).select("text_key", F.lit(True).alias("large"))
    cut = ranged.join(F.broadcast(large), "text_key", "left").withColumn("parts", F.coalesce(F.try_element_at(plan.scalar(), F.col("range")), F.lit(1)).cast("long"))
    part = F.pmod(F.when(F.col("large"), F.xxhash64("row_key", F.lit("part"))).otherwise(F.xxhash64("text_key", F.lit("part"))), F.col("parts")).cast("int")
    cells = cut.withColumn("part", part).drop("parts", "large")

    order = Window.partitionBy(F.lit(0)).orderBy("range", "part")
    total = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.groupBy("range", "part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select("range", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(total).alias("total"))
    )
    cell = Window.partitionBy("range", "part").orderBy("text_key", "row_key")
    group = Window.partitionBy("range", "part", "text_key")
    line = (
        cells.withColumns({"end": F.sum("size").over(cell.rowsBetween(Window.unboundedPreceding, 0)), "rank": F.row_number().over(cell)})
        .withColumns({"group_bytes": F.sum("size").over(group), "group_start": F.min(F.col("end") - F.col("size")).over(group)})
        .join(offsets, ["range", "part"])
    )
    whole = F.col("group_bytes") * shards <= F.col("total") * group_share
    middle = F.when(whole, 2 * F.col("group_start") + F.col("group_bytes")).otherwise(2 * F.col("end") - F.col("size")) + 2 * F.col("bytes_before")
    placed = line.select("id", "row_key", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("total")))).cast("int").alias("shard"), (F.col("rows_before") + F.col("rank") - 1).alias("place"))
    placed = checkpoint(placed)
    first = placed.groupBy("shard").agg(F.min("place").alias("first")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "first"))).alias("firsts"))
    return placed.select("id", "row_key", "size", "text_crc32", "shard", (F.col("place") - F.element_at(first.scalar(), F.col("shard"))).cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with their shard and slot (in place of columns of these names); repeated rows share the places of their group in any order."""
    found = shard(docs, shards, doc_id, text)
    nth = F.row_number().over(Window.partitionBy("__row_key").orderBy("shard", "slot"))
    places = found.withColumnRenamed("row_key", "__row_key").select("__row_key", nth.alias("__nth"), "shard", "slot")
    numbered = docs.drop("shard", "slot").withColumn("__row_key", row_key(doc_id, text))
    numbered = numbered.withColumn("__nth", F.row_number().over(Window.partitionBy("__row_key").orderBy("__row_key")))
    return numbered.join(places, ["__row_key", "__nth"]).drop("__row_key", "__nth")
