"""SimHash near-dedup at a stated similarity: candidates by Golay-code keys and by shared prefixes, then an exact check of the shingle sets.

Links: sets of shingles (five words; a shorter text is one shingle) whose Jaccard similarity is ``SIMILARITY`` or more. One row of each
component stays.

Candidates come from two sides. The 64-bit fingerprints of the sets, keyed by Golay codes as in :mod:`simhash`, propose those at most three
bits apart, equal fingerprints included. Sets of similarity 0.8 lie some ten bits apart, though, which no affordable set of such keys reaches
(README has the recall), so that the rest comes from prefix filtering: under one order of all shingles, two sets of similarity t share one
of the first n - ceil(t n) + 1 of each (n: the set's size), so no link is missed. The order puts shingles that a bounded sample shows to be
common last, and the others by their hash; any order is right, this one keeps common passages out of the keys. Where two sets first meet
bounds what they can share, which drops most pairs unread.

A key's bucket proposes its members against its centre first, the member with the most keys that others share: edits give a set keys of its
own, so the centre is the least edited one. What that links is contracted. Members of different components meet in their bucket with counts of
their shingles in a few hundred bins, whose common part bounds what two sets share; those that may still be alike are compared where their sets meet
(:func:`linking.within`), and only links that join two components are written. So a large group of copies writes rows in proportion to its size, linked
or not. A bucket of more than ``CROWDED`` rows passes through memory in pieces.

Words are told apart by 64-bit hashes, A-Z folded; sets by a 64-bit hash of theirs. Defined results: a null or empty text has the empty set,
all of which are copies of one another; repeated and null ids and empty tables are as in :mod:`simhash`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from ._lookup import Lookup
from ._shared import LEAN_BYTES, checkpoint, map_text, narrow, partitions, row_key
from ._words import Words, grams, mix
from .simhash import keep_first, links, majority

WIDTH, SIMILARITY = 5, 0.8
SAMPLE_ROWS, COMMON = 20_000, 100_000
SMALL = 64
CROWDED, COMPARED, BINS = 65_536, 8_192, 512
SETS = 1_024  # whose shingles or bins are held at a time


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all texts (in order within a text), the text of each, and how many each text has."""
    h, c = words.hashes(fold=True), words.counts
    n = np.where(c > 0, np.maximum(c - width + 1, 1), 0)
    doc = np.repeat(np.arange(len(c)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + words.bounds[:-1][doc]
    size, out = np.minimum(c, width)[doc], np.zeros(len(doc), dtype=np.uint64)
    for k in range(1, width + 1):
        own = size == k
        if own.any():
            out[own] = grams(h, k)[at[own]]
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], doc[new], np.bincount(doc[new], minlength=len(c))


def set_prints(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each text's set; 0 for the empty one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values), dtype=np.uint64)])
    ends = np.cumsum(counts)
    return mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64))


def _least(similarity: float, n: np.ndarray) -> np.ndarray:
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def _may_link(similarity: float, n, at, n2, at2) -> np.ndarray:
    """Whether sets that first meet at these positions can be similar enough."""
    return np.minimum(n - at, n2 - at2) >= _least(similarity / (1 + similarity), n + n2)


def common_shingles(rows: DataFrame, width: int) -> np.ndarray:
    """Shingles in several texts of a bounded sample, the most common last."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows.count()))
    sample = rows.filter(F.pmod(F.xxhash64("row_key", F.lit("jaccard")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, n = np.unique(shingle_sets(Words(batch.column(0)), width)[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["shingle", "n"])

    counts = map_text(sample.select("text"), "text", run, "shingle long, n long", LEAN_BYTES).groupBy("shingle").agg(F.sum("n").alias("n")).filter("n > 2")
    top = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").toArrow()
    return top.column(0).to_numpy().view(np.uint64)[::-1].copy()


def _keyed(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """Rows (k, fp, n, pos): the shingles of each set's prefix, the set's size and the shingle's place."""
    shared = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, width))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, doc, counts = shingle_sets(Words(batch.column(0)), width)
        fp = set_prints(values, counts)
        once = np.zeros(len(fp), dtype=bool)
        once[np.unique(fp, return_index=True)[1]] = True
        order = np.lexsort((values, Lookup(shared.value)(values), doc))
        values, doc = values[order], doc[order]
        pos = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
        use = once[doc] & (pos <= (counts - _least(similarity, counts))[doc])
        doc = doc[use]
        return pa.RecordBatch.from_arrays([pa.array(values[use].view(np.int64)), pa.array(fp[doc].view(np.int64)), pa.array(counts[doc].astype(np.int32)), pa.array(pos[use].astype(np.int32))], ["k", "fp", "n", "pos"])

    return map_text(rows.select("text"), "text", run, "k long, fp long, n int, pos int", LEAN_BYTES)


def _pieces(batches, limit: int):
    """(columns of whole buckets, False) from batches sorted by their first column; a bucket of more than ``limit`` rows comes in pieces (columns, True), none held longer than needed."""
    held, crowded = [], None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if crowded is not None:
            more = int(np.searchsorted(now[0], crowded, "right"))
            if more:
                yield [c[:more] for c in now], True
            now = [c[more:] for c in now]
        if not len(now[0]):
            continue
        crowded = None
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        if held and (cut or held[-1][0][-1] != now[0][0]):
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in now], strict=True)], False
            held = []
        elif cut:
            yield [c[:cut] for c in now], False
        held.append([c[cut:] for c in now])
        if sum(len(h[0]) for h in held) > limit:
            yield [np.concatenate(c) for c in zip(*held, strict=True)], True
            held, crowded = [], now[0][-1]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)], False


def _met(keyed: DataFrame, n: int, similarity: float, limit: int = CROWDED) -> DataFrame:
    """Rows (k, fp, n, pos, many) of buckets of several sets; in small ones, of those that may link to any. Of a bucket of more than ``limit`` rows, ``many`` is the limit."""

    def run(batches):
        last = None
        for (k, fp, size, pos), crowded in _pieces(batches, limit):
            new = np.ones(len(k), dtype=bool)
            new[0] = last != (k[0], fp[0])
            last = (k[-1], fp[-1])
            new[1:] = (k[1:] != k[:-1]) | (fp[1:] != fp[:-1])
            k, fp, size, pos = k[new], fp[new], size[new].astype(np.int64), pos[new].astype(np.int64)
            if crowded:
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp), pa.array(size.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(np.full(len(k), limit, np.int32))], ["k", "fp", "n", "pos", "many"])
                continue
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            many = np.diff(np.append(start, len(k)))
            use = np.repeat(many > SMALL, many)
            two = start[many == 2]
            use[two] = use[two + 1] = _may_link(similarity, size[two], pos[two], size[two + 1], pos[two + 1])
            for s, m in zip(start[(many > 2) & (many <= SMALL)].tolist(), many[(many > 2) & (many <= SMALL)].tolist(), strict=True):
                own = slice(s, s + m)
                near = _may_link(similarity, size[own, None], pos[own, None], size[None, own], pos[None, own])
                use[own] = near.sum(axis=1) > near.diagonal()
            many = np.repeat(many, many)
            yield pa.RecordBatch.from_arrays([pa.array(k[use]), pa.array(fp[use]), pa.array(size[use].astype(np.int32)), pa.array(pos[use].astype(np.int32)), pa.array(many[use].astype(np.int32))], ["k", "fp", "n", "pos", "many"])

    return keyed.repartition(n, "k").sortWithinPartitions("k", "fp").mapInArrow(run, "k long, fp long, n int, pos int, many int")


def _stars(met: DataFrame, n: int, similarity: float, limit: int = CROWDED) -> DataFrame:
    """Rows (a, b): each bucket's centre and those that may link to it. The centre is the member with the most keys that others share, which is the one least edited."""
    shared = checkpoint(met.groupBy("fp").agg(F.count(F.lit(1)).alias("shared")))
    ranked = met.join(shared, "fp").select("k", (-F.col("shared")).alias("rank"), "fp", "n", "pos")

    def run(batches):
        centre = None
        for (k, _, fp, size, pos), crowded in _pieces(batches, limit):
            if crowded and centre and centre[0] == k[0]:  # a bucket's further piece keeps its centre
                k, fp, size, pos = (np.append(c, x) for c, x in zip(centre, (k, fp, size, pos), strict=True))
            size, pos = size.astype(np.int64), pos.astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            first = np.repeat(start, np.diff(np.append(start, len(k))))
            may = _may_link(similarity, size, pos, size[first], pos[first]) & (first != np.arange(len(k)))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp, fp[first])[may]), pa.array(np.maximum(fp, fp[first])[may])], ["a", "b"])
            centre = tuple(c[start[-1] : start[-1] + 1] for c in (k, fp, size, pos))

    return ranked.repartition(n, "k").sortWithinPartitions("k", "rank", "fp").mapInArrow(run, "a long, b long").distinct()


def _open(rest: DataFrame, n: int, similarity: float, limit: int = COMPARED) -> DataFrame:
    """Those of the rows (k, fp, n, pos, root) that may link to one of another component in their bucket. Buckets of more than ``limit`` rows pass whole."""

    def run(batches):
        for (k, fp, size, pos, root), crowded in _pieces(batches, limit):
            use = np.full(len(k), crowded)
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            for s, e in zip(start.tolist(), np.append(start[1:], len(k)).tolist(), strict=True):
                _, label, many = np.unique(root[s:e], return_inverse=True, return_counts=True)
                if crowded or len(many) < 2:
                    continue
                m, p = size[s:e].astype(np.int64), pos[s:e].astype(np.int64)
                for x in np.flatnonzero(label != many.argmax()).tolist():
                    hit = _may_link(similarity, m, p, m[x], p[x]) & (label != label[x])
                    use[s:e] |= hit
                    use[s + x] |= hit.any()
            yield pa.RecordBatch.from_arrays([pa.array(c[use]) for c in (k, fp, size, pos, root)], ["k", "fp", "n", "pos", "root"])

    return rest.repartition(n, "k").sortWithinPartitions("k").mapInArrow(run, "k long, fp long, n int, pos int, root long")


def _near(met: DataFrame, sets: DataFrame, n: int, similarity: float, limit: int = COMPARED) -> DataFrame:
    """Rows (k, fp, root): the members that may still link to another component by their counts of shingles in ``BINS`` bins, which bound what two sets share; ``met``: rows as of :func:`_open`.

    A bucket falls into groups (k) that such pairs hold together. Of a bucket of more than ``limit`` rows all stay in one group.
    """

    def binned(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        at = (lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(BINS)).astype(np.int64)
        counts = np.minimum(np.bincount(owner * BINS + at, minlength=len(lists) * BINS), 255).astype(np.uint8).reshape(len(lists), BINS)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in counts], pa.binary())], ["fp", "bins"])

    def run(batches):
        for (k, fp, size, pos, root, bins), crowded in _pieces(batches, limit):
            group, use = k.copy(), np.full(len(k), crowded)
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            for s, e in [] if crowded else zip(start.tolist(), np.append(start[1:], len(k)).tolist(), strict=True):
                _, label, many = np.unique(root[s:e], return_inverse=True, return_counts=True)
                m, p = size[s:e].astype(np.int64), pos[s:e].astype(np.int64)
                held = np.frombuffer(b"".join(bins[s:e]), np.uint8).reshape(e - s, BINS)
                beyond = m - held.sum(axis=1, dtype=np.int64)  # of bins with more than 255
                source, place, together = label != many.argmax(), np.arange(e - s), np.arange(e - s)
                for x in np.flatnonzero(source).tolist():
                    near = np.flatnonzero(_may_link(similarity, m, p, m[x], p[x]) & (label != label[x]) & (~source | (place > x)))
                    most = np.minimum(held[near], held[x]).sum(axis=1, dtype=np.int64) + np.minimum(beyond[near], beyond[x])
                    near = near[most >= _least(similarity / (1 + similarity), m[near] + m[x])]
                    if len(near):
                        joined = np.append(together[near], together[x])
                        together[np.isin(together, joined)] = joined.min()
                use[s:e] = np.bincount(together, minlength=e - s)[together] > 1
                group[s:e] = mix(k[s:e].view(np.uint64) ^ mix(fp[s:e][together].view(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c[use]) for c in (group, fp, root)], ["k", "fp", "root"])

    held = _among(sets, met.select("fp"), binned, "fp long, bins binary")
    return met.join(held, "fp").select("k", "fp", "n", "pos", "root", "bins").repartition(n, "k").sortWithinPartitions("k").mapInArrow(run, "k long, fp long, root long")


def _held(fps: DataFrame):
    """A test for whether numbers are among the first column of ``fps``, or share their bits in a broadcast filter of 8 MB, which is its size for any input."""
    fp = F.col(fps.columns[0])
    word, bit = F.shiftrightunsigned(fp, 44), F.shiftrightunsigned(fp, 38).bitwiseAND(F.lit(63)).cast("int")
    told = fps.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
    bits = np.zeros(1 << 20, dtype=np.uint64)
    bits[told.column(0).to_numpy()] = told.column(1).to_numpy().view(np.uint64)
    shared = fps.sparkSession.sparkContext.broadcast(bits)
    return lambda x: (shared.value[(x >> np.uint64(44)).astype(np.int64)] >> (x >> np.uint64(38) & np.uint64(63)) & np.uint64(1)) > 0


def _among(sets: DataFrame, fps: DataFrame, fn=None, schema: str = "fp long, shingles array<long>") -> DataFrame:
    """Those of the sets that are wanted, and a few others, before they are sent anywhere; ``fn``: what is made of them in the same pass, since each map of a stage has Python workers of its own."""
    held = _held(fps)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SETS):
                part = batch.slice(at, SETS)
                part = part.filter(pa.array(held(part.column(0).to_numpy().view(np.uint64))))
                if part.num_rows:
                    yield fn(part) if fn else part

    return sets.select("fp", "shingles").mapInArrow(run, schema)


def sets_with(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Rows (fp, shingles) of the wanted sets, and of a few others."""
    held = _held(wanted)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, doc, counts = shingle_sets(Words(batch.column(0)), width)
        fp = set_prints(values, counts)
        use = np.zeros(len(fp), dtype=bool)
        use[np.unique(fp, return_index=True)[1]] = True
        use &= held(fp)
        ends = np.concatenate([[0], np.cumsum(counts[use])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(fp[use].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values[use[doc]].view(np.int64)))], ["fp", "shingles"])

    return map_text(rows.select("text"), "text", run, "fp long, shingles array<long>", LEAN_BYTES).dropDuplicates(["fp"])


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose Jaccard similarity is reached. A join is sent the sets of its own side of the pairs alone."""
    of = lambda x: _among(sets, pairs.select(x)).select(F.col("fp").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return checkpoint(both.filter(shared >= F.lit(similarity) * (total - shared) - F.lit(1e-9)).select("a", "b"))


def _close(prints: DataFrame) -> DataFrame:
    """Rows (a, b): sets whose fingerprints are equal or linked by Golay keys, each against the first set of its own or the linked fingerprint."""
    sets = checkpoint(prints.select("sim", "fp").distinct())
    first = checkpoint(sets.groupBy("sim").agg(F.min("fp").alias("a")))
    equal = sets.join(first, "sim").select("a", F.col("fp").alias("b"))
    of = lambda x: first.select(F.col("sim").alias(x), F.col("a").alias(f"f{x}"))
    near = links(first.select(F.col("sim").alias("fp"))).join(of("a"), "a").join(of("b"), "b").select("fa", "fb")
    return equal.union(near).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, crowded: int = CROWDED, compared: int = COMPARED) -> DataFrame:
    """One row for each row of ``docs``: id, row_key, fp (of the set), sim (its SimHash) and root, which is the same for all rows reachable over links."""
    n = partitions(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), row_key(doc_id, text).alias("row_key"), F.col(text).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, _, counts = shingle_sets(Words(batch.column(2)), width)
        fp, sim = set_prints(values, counts), majority(values, counts)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64)), pa.array(sim.view(np.int64))], ["id", "row_key", "fp", "sim"])

    prints = checkpoint(map_text(rows, "text", run, "id long, row_key long, fp long, sim long", LEAN_BYTES))
    met = checkpoint(_met(_keyed(rows, width, similarity), n, similarity, crowded))
    stars = checkpoint(_stars(met, n, similarity, crowded).union(_close(prints)).distinct())
    sets = checkpoint(sets_with(rows, met.select("fp").union(stars.select("a")).union(stars.select("b")), width))
    edges = _linked(stars, sets, similarity)
    roots = linking.roots_of(edges)
    named = met.filter("many > 2").select("k", "fp", "n", "pos").join(roots, "fp", "left").select("k", "fp", "n", "pos", F.coalesce("root", "fp").alias("root"))
    rest = checkpoint(_open(named, n, similarity, compared))
    rest = checkpoint(narrow(_near(rest, sets, n, similarity, compared), rest.count()))
    if not rest.isEmpty():
        more = linking.within(rest, _among(sets, rest.select("fp")), 100 * similarity - 1e-7)
        roots = roots if more.isEmpty() else linking.roots_of(edges.unionByName(more))
    return prints.join(roots, "fp", "left").select("id", "row_key", "fp", "sim", F.coalesce("root", "fp").alias("root"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row kept of each component: of the smallest id, and among rows of that id the smallest row key."""
    return keep_first(docs, near_duplicates(docs, doc_id, text, **how), doc_id, text)
