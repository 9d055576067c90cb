"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame operations only.

Each source is dealt into cells by a seeded hash; in a cell the documents stand end to end in seeded order, and their words are
cut into blocks of equal length (the last may be shorter). The mix is a number of blocks: highest quotients w/(2k+1) first
give each source its quota, then each cell of a source its integer quota; a cell repeats all its blocks as often as its quota
allows and takes the remainder as an evenly spaced selection from a seeded offset. As that selection has closed prefix sums, what
the mix takes of each document follows without a row per block.

Quotas come without a row per seat as well: the divisor method brackets each quota within a few seats of its proportional share,
and only the seats between the brackets compete.

Cells: at most 4096 for each source and about 250 documents in the smaller tables, so that no source, however large, is one task.

Defined results: a null text has size 0 and nothing taken; null sources form one source, ordered last; a null id counts as an
empty one in the seeded order; repeated rows are documents of their own; no words at all give targets of 0; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import WORD, checkpoint, row_key

#: Weights of the sources in order, repeating.
CYCLE = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 16
CELL_ROWS, MOST_CELLS = 250, 4096


def apportion(parts: DataFrame, by: list[str], weight: str, seats: str, order: str, out: str) -> DataFrame:
    """Adds ``out``: Sainte-Lague quotas of ``seats`` (the same in all rows of a group) over the rows of each group ``by``.

    Equal quotients go to the smaller ``order``. ``order`` is unique in a group; weights are not negative.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    share = F.col("__n") * F.col(weight) / F.col("__w")
    spread = F.col("__k") / 2 * F.col(weight) / F.col("__w")
    some = F.col(weight) > 0
    bracket = (
        parts.withColumns({"__w": F.sum(weight).over(group), "__k": F.count(F.when(some, 1)).over(group), "__n": F.col(seats).cast("double")})
        .withColumn("__low", F.when(some, F.greatest(F.lit(0), F.floor(share - spread + 0.5) - 1)).otherwise(0).cast("long"))
        .withColumn("__high", F.when(some, F.ceil(share + spread + 0.5) + 1).otherwise(0).cast("long"))
        .withColumn("__open", F.col(seats) - F.sum("__low").over(group))
    )
    seat = bracket.filter(some).select(*by, order, weight, "__open", F.explode(F.sequence("__low", F.col("__high"))).alias("__s"))
    ranked = seat.withColumn("__rank", F.row_number().over(group.orderBy(F.desc(F.col(weight) / (2 * F.col("__s") + 1)), F.col(order))))
    won = ranked.filter(F.col("__rank") <= F.col("__open")).groupBy(*by, order).agg(F.count("*").alias("__won"))
    return bracket.join(won, [*by, order], "left").withColumn(out, F.col("__low") + F.coalesce("__won", F.lit(0))).drop("__w", "__k", "__n", "__low", "__high", "__open", "__won")


def targets(sources: DataFrame, size: str, weight: str, order: str, most: int = MOST, out: str = "target") -> DataFrame:
    """Adds ``out``: all sizes shared by weight, no share above ``most`` times its size, the excess reshared by weight.

    In order of size over weight the capped sources come first; the first source that its level doesn't cap fixes the level.
    One window over all sources: as many rows as there are sources.
    """
    everything = Window.partitionBy(F.lit(0))
    filling = everything.orderBy(F.col("__cap") / F.col(weight), F.col(weight), F.col(order))
    rows = (
        sources.withColumn("__cap", most * F.col(size))
        .withColumn("__at", F.row_number().over(filling))
        .withColumn("__left", F.sum(size).over(everything) - F.coalesce(F.sum("__cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__share", F.sum(weight).over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__first", F.min(F.when(F.col("__cap") * F.col("__share") >= F.col("__left") * F.col(weight), F.col("__at"))).over(everything))
    )
    level = {n: F.max(F.when(F.col("__at") == F.col("__first"), F.col(c))).over(everything) for n, c in (("__l", "__left"), ("__s", "__share"))}
    free = F.col("__at") >= F.col("__first")
    return rows.withColumns(level).withColumn(out, F.when(free, (F.col("__l") * F.col(weight)).cast("double") / F.col("__s")).otherwise(F.col("__cap").cast("double"))).drop("__cap", "__at", "__left", "__share", "__first", "__l", "__s")


def cycle_weight(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w).cast("long") for w in CYCLE]), (F.pmod(rank - 1, F.lit(len(CYCLE))) + 1).cast("int"))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_number(digest: Column, at: int, digits: int = 8) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document: id, row_key, size, source_size, target, taken, and its cell's quota of blocks."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    key = F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    rows = docs.select(F.col(doc_id).alias("id"), key.alias("src"), row_key(doc_id, source, text).alias("row_key"), word_count(text).alias("size"), digest.alias("digest"))
    rows = checkpoint(rows)
    cells = max(1, min(MOST_CELLS, -(-rows.count() // CELL_ROWS)))
    rows = rows.withColumn("cell", F.pmod(hash_number(F.col("digest"), 1), F.lit(cells)))

    whole = rows.groupBy("src", "cell").agg(F.sum("size").alias("words")).withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long"))
    sources = whole.groupBy("src").agg(F.sum("words").alias("source_size"), F.sum("blocks").alias("source_blocks"))
    sources = sources.withColumn("weight", cycle_weight(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("src"))))
    sources = targets(sources, "source_size", "weight", "src")
    sources = sources.withColumn("claim", F.when(F.col("source_size") > 0, F.col("target") * F.col("source_blocks") / F.col("source_size")).otherwise(F.lit(0.0)))
    sources = sources.withColumn("seats", F.round(F.sum("claim").over(Window.partitionBy(F.lit(0)))).cast("long"))
    sources = apportion(sources, [], "claim", "seats", "src", "source_quota")
    quotas = apportion(whole.join(sources, "src"), ["src"], "blocks", "source_quota", "cell", "quota")
    quotas = quotas.select("src", "cell", "words", "blocks", "source_size", "target", F.least("quota", MOST * F.col("blocks")).alias("quota"))

    line = Window.partitionBy("src", "cell").orderBy("digest", "size", "row_key")
    placed = rows.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).join(quotas, ["src", "cell"])
    n = F.greatest("blocks", F.lit(1))
    offset = F.pmod(hash_number(F.md5(F.concat_ws(":", F.lit(seed), F.col("src"), F.col("cell").cast("string")).cast("binary")), 1), n)
    placed = placed.withColumns({"n": n, "passes": F.floor(F.col("quota") / n).cast("long"), "rest": F.pmod(F.col("quota"), n), "offset": offset})

    def selected(block: Column) -> Column:
        """Selected blocks among the first ``block`` ones: rest of n, evenly spaced from the offset."""
        up_to = lambda x: ((x * F.col("rest") - F.pmod(x * F.col("rest"), F.col("n"))) / F.col("n")).cast("long")
        return up_to(block + F.col("offset")) - up_to(F.col("offset"))

    def extra(at: Column) -> Column:
        """Words of the selected blocks among the first ``at`` words of the cell."""
        block = F.floor(at / block_words).cast("long")
        return selected(block) * block_words + (selected(block + 1) - selected(block)) * (at - block * block_words)

    taken = F.col("passes") * F.col("size") + extra(F.col("end")) - extra(F.col("end") - F.col("size"))
    return placed.withColumn("taken", taken).select("id", "row_key", "size", "source_size", "target", "taken", "cell", "quota")


def remix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its taken words make its size, a seeded draw rounding up or down.

    Repeated rows share their copies evenly, rounded.
    """
    found = mix(docs, doc_id, source, text, **how)
    passes = F.col("taken") / F.greatest("size", F.lit(1))
    draw = F.pmod(F.xxhash64("row_key", F.lit("round")), F.lit(1 << 30)) / float(1 << 30)
    copies = found.groupBy(F.col("row_key").alias("__row_key")).agg(F.round(F.avg(F.floor(passes) + F.when(draw < passes - F.floor(passes), 1).otherwise(0))).cast("int").alias("__copies"))
    kept = docs.withColumn("__row_key", row_key(doc_id, source, text)).join(copies.filter("__copies > 0"), "__row_key")
    return kept.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copy", "__copies", "__row_key")
