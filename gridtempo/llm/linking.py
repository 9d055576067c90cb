"""Links between sets that share a bucket, checked on the full sets, with rows in proportion to the buckets and not to their pairs.

Input: rows (k, fp) that put distinct sets into buckets, and rows (fp, shingles) with the sets themselves. Two rounds:

1. Each bucket's members are compared with its centre, the member that shares most buckets with others (edits give a set buckets of its own, so it is
   the least edited one). What that links is contracted; a large group of near copies is one component after this.
2. Members of buckets that still hold several components are searched where their sets meet: pairs of different components are compared and a link is
   written only where it joins two, so that m members write less than m rows, however many pairs are compared. Buckets that share members form
   clusters. A cluster is cut by hash into blocks of at most ``TILE`` shingles and ``MEMBERS`` members, and each pair of blocks is a task's work of its own, so that a set is
   sent once for each block and not once for each bucket. A cluster of more than ``MOST_BLOCKS`` blocks is taken apart again into its buckets, cut in the same way.

No bucket is held whole, no candidate pair is written in the second round, and no pair that shares a bucket is left out unless a link found
before already joins it. Joins on hot keys have plain exchanges on both sides (aggregates are parted by checkpoints), which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import checkpoint, narrow, partitions
from .simhash import components

#: Shingles and members of a block; a task holds two such blocks. Blocks of a cluster that is searched as a whole.
TILE, MEMBERS = 2_000_000, 1024
MOST_BLOCKS = 12


def similar(shared, total, per_cent: int):
    """Whether sets of ``total`` elements together share enough; whole numbers, so that the threshold itself counts."""
    return 100 * shared >= per_cent * (total - shared)


def centred(buckets: DataFrame) -> DataFrame:
    """Rows (k, fp, many, centre) of the buckets with several members; ``buckets``: distinct rows (k, fp)."""
    sized = checkpoint(buckets.groupBy("k").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"))
    met = checkpoint(buckets.join(sized, "k"))
    shared = checkpoint(met.groupBy("fp").agg(F.count(F.lit(1)).alias("shared")))
    first = checkpoint(met.join(shared, "fp").groupBy("k").agg(F.min(F.struct((-F.col("shared")).alias("s"), F.col("fp").alias("centre"))).alias("w")).select("k", "w.centre"))
    return met.join(first, "k")


def checked(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough."""
    of = lambda x: sets.select(F.col("fp").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return checkpoint(both.filter(similar(shared, total, per_cent)).select("a", "b"))


def roots_of(edges: DataFrame) -> DataFrame:
    """Rows (fp, root) for all ends of the edges."""
    found = components(edges)
    return checkpoint(narrow(found.select(F.col("node").alias("fp"), "root").unionByName(found.select(F.col("root").alias("fp"), "root").distinct()), 2 * found.count()))


def runs(batches, columns: int) -> Iterator[list]:
    """The columns of each run of equal first columns, from batches sorted by it; the last column is a list."""
    held: list[pa.RecordBatch] = []

    def whole() -> list:
        table = pa.Table.from_batches(held)
        lists = table.column(columns - 1).combine_chunks()
        values = lists.flatten().to_numpy(zero_copy_only=False)
        return [*[table.column(i).to_numpy() for i in range(columns - 1)], values, np.diff(lists.offsets.to_numpy())]

    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != k[lo]:
                yield whole()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield whole()


def joining_links(fp: np.ndarray, root: np.ndarray, side: np.ndarray, values: np.ndarray, counts: np.ndarray, per_cent: int) -> tuple[list[int], list[int]]:
    """Links that join the components (``root``) of the members as far as all links between them would. side: 0 for a block met with itself, else 1 and 2, and only pairs of 1 and 2 count."""
    _, label = np.unique(root, return_inverse=True)
    if not label.any():
        return [], []
    ids = np.unique(values, return_inverse=True)[1]
    ends = np.cumsum(counts)
    starts = ends - counts
    marked = np.zeros(int(ids.max(initial=-1)) + 1, dtype=np.int32)
    a, b = [], []
    main = int(np.bincount(label).argmax())
    source = label != main
    place = np.arange(len(fp))
    for x in np.flatnonzero(source).tolist():
        # A source is compared with the largest component at the start, and with the sources after it.
        other = (label != label[x]) & (~source | (place > x)) & (100 * np.minimum(counts, counts[x]) >= per_cent * np.maximum(counts, counts[x]))
        if side[x]:
            other &= side != side[x]
        near = np.flatnonzero(other)
        if not len(near):
            continue
        own = ids[starts[x] : ends[x]]
        marked[own] = 1
        if len(near) * 2 > len(fp):
            shared = np.add.reduceat(marked[ids], starts)[near]
        else:
            size = counts[near]
            at = np.repeat(starts[near] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            shared = np.add.reduceat(marked[ids[at]], np.cumsum(size) - size)
        marked[own] = 0
        for y in near[similar(shared, counts[x] + counts[near], per_cent)].tolist():
            if label[y] != label[x]:
                a.append(int(min(fp[x], fp[y])))
                b.append(int(max(fp[x], fp[y])))
                label[label == label[y]] = label[x]
    return a, b


def _blocks(tile: int, members: int) -> Column:
    """How many blocks the rows of a group with a column ``size`` need."""
    return F.greatest(F.ceil(F.sum("size") / F.lit(tile)), F.ceil(F.count(F.lit(1)) / F.lit(members)), F.lit(1).cast("long")).alias("blocks")


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows (tile, fp, root, side) from rows (k, fp, root, blocks): each member in a tile for each block of its group."""
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = rows.withColumn("own", own).select("k", "fp", "root", "own", F.explode(pair).alias("t"))
    # Equal hashes of two tiles would only add comparisons.
    return dealt.select(F.xxhash64("k", "t.i", "t.j").alias("tile"), "fp", "root", F.when(F.col("t.i") == F.col("t.j"), 0).when(F.col("own") == F.col("t.i"), 1).otherwise(2).alias("side"))


def within(rest: DataFrame, sets: DataFrame, per_cent: int, tile: int = TILE, members: int = MEMBERS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Rows (a, b): links between members of a bucket that join different components; ``rest``: rows (k, fp, root)."""
    n, rows = partitions(rest), rest.count()
    size = sets.select("fp", F.size("shingles").alias("size"))
    hubs = checkpoint(narrow(rest.groupBy("k").agg(F.min("fp").alias("b")), rows))
    clusters = roots_of(rest.join(hubs, "k").select(F.col("fp").alias("a"), "b").filter("a != b")).withColumnRenamed("root", "cluster")
    named = checkpoint(narrow(checkpoint(narrow(rest.select("fp", "root").distinct(), rows)).join(size, "fp").join(clusters, "fp"), rows))
    sized = checkpoint(narrow(named.groupBy("cluster").agg(_blocks(tile, members)), rows))
    placed = named.join(sized, "cluster")
    tiles = checkpoint(narrow(_tiles(placed.filter(F.col("blocks") <= most_blocks).withColumnRenamed("cluster", "k")), rows * most_blocks))
    large = checkpoint(narrow(placed.filter(F.col("blocks") > most_blocks).select("fp", "size"), rows))
    if not large.isEmpty():
        crowd = checkpoint(rest.join(large, "fp"))
        tiles = checkpoint(tiles.unionByName(_tiles(crowd.join(checkpoint(crowd.groupBy("k").agg(_blocks(tile, members))), "k"))))

    def run(batches):
        for _, fp, root, side, values, counts in runs(batches, 5):
            a, b = joining_links(fp, root, side, values, counts, per_cent)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    carried = tiles.join(sets, "fp").select("tile", "fp", "root", "side", "shingles")
    return checkpoint(carried.repartition(n, "tile").sortWithinPartitions("tile", "fp").mapInArrow(run, "a long, b long").distinct())


def linked_roots(buckets: DataFrame, sets_of, per_cent: int, more: DataFrame | None = None, **how) -> DataFrame:
    """Rows (fp, root) of all sets that links join. ``sets_of``: a function from rows (fp) to rows (fp, shingles) of at least these; ``more``: candidate pairs (a, b) besides; ``how``: the sizes of :func:`within`."""
    met = checkpoint(centred(buckets))
    stars = met.filter("fp != centre").select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))
    stars = checkpoint((stars if more is None else stars.unionByName(more)).distinct())
    sets = checkpoint(sets_of(stars.select(F.col("a").alias("fp")).union(stars.select("b"))))
    edges = checked(stars, sets, per_cent)
    roots = roots_of(edges)
    # A bucket of two has only its centre's pair.
    open_rows = checkpoint(met.filter("many > 2").select("k", "fp").join(roots, "fp", "left").select("k", "fp", F.coalesce("root", "fp").alias("root")))
    parted = checkpoint(open_rows.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("k"))
    rest = checkpoint(open_rows.join(parted, "k"))
    if rest.isEmpty():
        return roots
    found = within(rest, sets, per_cent, **how)
    return roots if found.isEmpty() else roots_of(edges.unionByName(found))
