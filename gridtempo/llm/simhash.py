"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints: 64-bit majority votes over the XXH64 of word shingles. Links: at most three differing bits.

Candidates. A fingerprint is cut into three segments (22, 21, 21 bits). Three errors leave, by pigeonhole, either one segment
whole and another with at most one error, or one error in each. A segment decodes to its Golay codeword index and, one flip
away, to a few neighbouring ones; words at most one bit apart share such an index. So linked fingerprints share one of the keys
(whole segment, index of another) or (index, index, index), 34 and 36 bits long: about 50 keys for each distinct fingerprint,
against which unrelated fingerprints collide with a chance of some 2e-8 a pair.

Within a key's bucket all links are verified by a search over the members not reached yet, which gives a spanning forest rather
than all pairs. A bucket beyond ``bucket_limit`` isn't held in memory: its members are keyed anew by any five equal bytes of
eight, and should that not part them, by all 2024 ways to blank three of the 24 bits left, where sharing a key is a link.
Nothing is dropped at any size. Components are found by alternating stars over checkpointed tables.

Defined results: a null or empty text has no shingle and fingerprint zero, which links like any other; repeated rows are copies
of one another; a null id has its row, and doesn't count for the smallest id; an empty table gives an empty one. Ids are numbers or
text that reads as such; another id is an error (ANSI cast).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from ._shared import checkpoint, map_text, narrow, partitions, row_key, settled
from ._words import Words

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BUCKET_LIMIT = 4096
_LANES = np.array([sum((b >> k & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of all texts, and how many each text has."""
    body, starts, ends = words.joined(fold=True)
    counts = np.where(words.counts > 0, np.maximum(words.counts - width + 1, 1), 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + words.bounds[:-1][doc]
    last = np.minimum(first + width, words.bounds[1:][doc]) - 1
    text, digest = body.tobytes(), xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)], dtype=np.uint64), counts


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits set in over half of each text's hashes. Eight counters of eight bits share a word, so at most 255 rows are added at once."""
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    size = counts[some]
    start = np.cumsum(size) - size
    runs = (size + 254) // 255
    run_of = np.repeat(np.arange(len(some)), runs)
    run_start = start[run_of] + 255 * (np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs))
    bytes_of = hashes.view(np.uint8).reshape(-1, 8)
    for p in range(8):
        lanes = np.add.reduceat(_LANES[bytes_of[:, p]], run_start).view(np.uint8).reshape(-1, 8)
        votes = np.add.reduceat(lanes.astype(np.int64), np.cumsum(runs) - runs, axis=0)
        for k in range(8):
            out[some] |= (2 * votes[:, k] > size).astype(np.uint64) << np.uint64(8 * p + k)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Rows (id, row_key, fp): one for each row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = majority(*shingle_hashes(Words(batch.column(2)), width))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["id", "row_key", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), row_key(doc_id, text).alias("row_key"), F.col(text).cast("string").alias("text"))
    return map_text(rows, "text", run, "id long, row_key long, fp long")


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of all fingerprints."""
    parts = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [golay.near(x, n) for x, (_, n) in zip(parts, SEGMENTS, strict=True)]
    rows, keys = [], []
    for a in range(3):
        for b in range(3):
            if a != b:
                r, c = np.nonzero(near[b] >= 0)
                rows.append(r)
                keys.append((np.int64(3 * a + b) << 36) | (parts[a][r] << 12) | near[b][r, c])
    both = near[0][:, :, None] << 12 | near[1][:, None, :]
    both[(near[0] < 0)[:, :, None] | (near[1] < 0)[:, None, :]] = -1
    both = both.reshape(len(fp), 36)
    r, c = np.nonzero(both >= 0)
    pair = both[r, c]
    r2, c2 = np.nonzero(near[2][r] >= 0)
    rows.append(r[r2])
    keys.append((np.int64(9) << 36) | (pair[r2] << 12) | near[2][r[r2], c2])
    return np.concatenate(rows), np.concatenate(keys)


def byte_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each choice of five bytes of eight, which three errors can't all miss."""
    by = fp.view(np.uint8).reshape(-1, 8).astype(np.int64)
    keys = []
    for k, five in enumerate(combinations(range(8), 5)):
        key = np.full(len(fp), k, dtype=np.int64)
        for p in five:
            key = key << 8 | by[:, p]
        keys.append(key)
    return np.tile(np.arange(len(fp)), len(keys)), np.concatenate(keys)


def _keyed(fps: DataFrame, keys, schema: str = "k long, fp long") -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                if len(fp):
                    row, key = keys(fp.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["k", "fp"])

    return fps.select("fp").mapInArrow(run, schema)


def spanning_links(fp: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Links that join whatever the bucket's links (at most ``bits`` apart) join: a search over the members not reached yet."""
    left, a, b = np.unique(fp), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = np.bitwise_count(left ^ x) <= bits
            if hit.any():
                reached = left[hit]
                left = left[~hit]
                queue.extend(reached)
                a.extend([x] * len(reached))
                b.extend(reached)
    return a, b


def _verified(keyed: DataFrame, n: int, bits: int, limit: int) -> DataFrame:
    """Rows (hot, a, b): links found in buckets, or (key, fingerprint) of buckets beyond the limit."""

    def run(batches):
        held_k, held_f, hot_key = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def solved(k: np.ndarray, f: np.ndarray):
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(start, len(k)))
            two = start[size == 2]
            near = two[np.bitwise_count(f[two] ^ f[two + 1]) <= bits]
            a, b = [f[near]], [f[near + 1]]
            for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                x, y = spanning_links(f[s : s + m], bits)
                a.append(np.array(x, dtype=np.uint64))
                b.append(np.array(y, dtype=np.uint64))
            return rows(False, np.concatenate(a), np.concatenate(b))

        def rows(hot: bool, a: np.ndarray, b: np.ndarray):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["hot", "a", "b"])

        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(k):
                continue
            if hot_key is not None:
                more = int(np.searchsorted(k, hot_key, "right"))
                yield rows(True, k[:more], f[:more])
                k, f = k[more:], f[more:]
                if not len(k):
                    continue
                hot_key = None
            held_k, held_f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
            cut = int(np.searchsorted(held_k, held_k[-1], "left"))
            if cut:
                yield solved(held_k[:cut], held_f[:cut])
            held_k, held_f = held_k[cut:], held_f[cut:]
            if len(held_k) > limit:
                hot_key = held_k[-1]
                yield rows(True, held_k, held_f)
                held_k, held_f = held_k[:0], held_f[:0]
        if len(held_k):
            yield solved(held_k, held_f)

    return keyed.repartition(n, "k").sortWithinPartitions("k").mapInArrow(run, "hot boolean, a long, b long")


def _blanked(hot: DataFrame, bits: int) -> DataFrame:
    """Links of members that share five bytes: for each choice of ``bits`` of the other 24, equal rest means a link to the smallest.

    Exact at any size, at 2024 rows (for three bits) for each member and choice of bytes that is still crowded.
    """
    fives = [sum(255 << 8 * p for p in five) for five in combinations(range(8), 5)]

    def run(batches):
        for batch in batches:
            for key, fp in zip((batch.column(0).to_numpy() >> 40).tolist(), batch.column(1).to_numpy().view(np.uint64).tolist(), strict=True):
                free = [b for b in range(64) if not fives[key] >> b & 1]
                masks = np.array([sum(1 << b for b in c) for c in combinations(free, bits)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(masks.view(np.int64)), pa.array((np.uint64(fp) & ~masks).view(np.int64)), pa.array(np.full(len(masks), fp, np.uint64).view(np.int64))], ["mask", "rest", "fp"])

    rows = hot.mapInArrow(run, "mask long, rest long, fp long")
    least = rows.groupBy("mask", "rest").agg(F.min("fp").alias("a"))
    return rows.join(least, ["mask", "rest"]).filter("fp != a").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, bits: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Rows (a, b) of distinct fingerprints that span all components of the graph of pairs at most ``bits`` (up to 3) apart."""
    n = partitions(fps)
    found = checkpoint(_verified(_keyed(fps, fuzzy_keys), n, bits, bucket_limit))
    edges = found.filter("not hot").select("a", "b")
    hot = found.filter("hot").select(F.col("b").alias("fp")).distinct()
    if not hot.isEmpty():
        again = checkpoint(_verified(_keyed(hot, byte_keys), n, bits, bucket_limit))
        edges = edges.unionByName(again.filter("not hot").select("a", "b"))
        still = again.filter("hot").select(F.col("a").alias("k"), F.col("b").alias("fp"))
        if not still.isEmpty():
            edges = edges.unionByName(_blanked(still, bits))
    return edges.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for all nodes of ``edges`` (a, b), by large-star and small-star rounds until nothing moves.

    A node may have a third of all edges. Checkpoints part each join from the aggregate on its key, so that both its sides are plain exchanges, whose large
    partitions adaptive execution splits. Rounds grow with the logarithm of the longest chain; beyond ``max_rounds`` an error is raised, nothing is left out.
    """

    def state(df: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(df.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())

    now = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = state(now)
    for _ in range(max_rounds):
        size = 2 * before[0]
        now = narrow(now, size)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(narrow(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), size))
        large = checkpoint(narrow(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), size))
        down = checkpoint(narrow(large.groupBy("u").agg(F.min("v").alias("m")), size))
        small = large.join(down, "u")
        step = settled(narrow(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct(), size))
        now, last, before = step, before, state(step)
        if last == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("the components did not settle")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, bits: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row for each row of ``docs``: id, row_key, fp, component_id (the smallest id reachable over links) and root, a fingerprint that stands for the component."""
    prints = checkpoint(fingerprints(docs, doc_id, text, width))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), bits, bucket_limit))
    linked = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    members = linked.join(distinct, "fp")
    # A component may hold a third of all fingerprints, a fingerprint a third of all rows. Checkpoints part each join from the aggregate on its
    # key, so that both sides are plain exchanges, whose large partitions adaptive execution splits.
    smallest = checkpoint(members.groupBy("root").agg(F.min("least").alias("component_id")))
    named = members.join(smallest, "root").select("fp", "root", "component_id")
    by_fp = checkpoint(distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return prints.join(by_fp, "fp").select("id", "row_key", "fp", "component_id", "root")


def keep_first(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with one row kept of each root in ``found`` (id, row_key, root): of the smallest id, and among those of the smallest row key."""
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row_key"))).alias("w"))
    stay = best.select(F.col("w.row_key").alias("__row_key"))
    kept = docs.withColumn("__row_key", row_key(doc_id, text)).join(stay, "__row_key", "left_semi")
    return kept.dropDuplicates(["__row_key"]).drop("__row_key")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row kept of each component: of the smallest id, and among rows of that id the smallest row key."""
    return keep_first(docs, near_duplicates(docs, doc_id, text, **how), doc_id, text)
