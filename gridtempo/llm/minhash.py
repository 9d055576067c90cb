"""MinHash near-dedup with circulant permutations: banding, then an exact check of the shingle sets.

A set's elements are placed by a first permutation on a ring of ``RING`` positions. One table holds a second permutation of the ring;
coordinate j of a signature is the least table value at the elements' positions shifted circularly by j. So two permutations give all coordinates, and
an element's contribution to all of them is one contiguous stretch of the table.

Signatures are cut into bands; sets that agree in a band share a bucket. Sets of similarity s miss each other with probability
(1 - s**rows)**bands, 5e-8 at 0.8 with 32 bands of 4 and less above. Buckets are searched by :mod:`linking`: links are confirmed on
the full sets in whole numbers, and large groups write rows in proportion to their size.

Words `[^\\x20\\x09-\\x0D]+` and shingles are told apart by 64-bit hashes (A-Z folded), sets by a 64-bit hash of theirs, and only distinct sets are
compared. Defined results. A text of fewer words than a shingle has its whole sequence as one. Texts without words, and nulls, have the empty set, which
is linked with nothing, so that each such row is its own component. Repeated rows are copies of one another; a null id has its row
and doesn't count for the smallest id; a component whose ids are all null has a null component_id. An id that isn't a number is an error (ANSI cast).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import checkpoint, map_text, row_key
from ._words import Words, mix
from .jaccard import set_prints, sets_with, shingle_sets
from .linking import linked_roots
from .simhash import keep_first

WIDTH, PER_CENT = 2, 80
BANDS, ROWS = 32, 4
RING_BITS = 22
#: Elements whose stretches of the table are held at once, and the longest run reduced in one go.
HELD, RUN = 1024, 32
_SEED = 20240521
_tables: dict[int, np.ndarray] = {}


def _table(size: int) -> np.ndarray:
    """The second permutation, continued beyond its end by one signature."""
    if size not in _tables:
        ring = np.random.Generator(np.random.PCG64(_SEED)).permutation(1 << RING_BITS).astype(np.uint32)
        _tables[size] = np.concatenate([ring, ring[:size]])
    return _tables[size]


def signatures(values: np.ndarray, counts: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """A row of ``size`` coordinates for each of the sets (one at least, none empty)."""
    place = (mix(values + np.uint64(_SEED)) >> np.uint64(64 - RING_BITS)).astype(np.int64)
    stretches = np.lib.stride_tricks.sliding_window_view(_table(size), size)
    # Runs of bounded length within sets, so that no set's stretches are held whole.
    pieces = (counts + RUN - 1) // RUN
    first = np.cumsum(pieces) - pieces
    inner = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    start = np.repeat(np.cumsum(counts) - counts, pieces) + RUN * inner
    end = np.append(start[1:], len(values))
    least = np.empty((len(start), size), dtype=np.uint32)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + HELD, "right")))
        least[at:to] = np.minimum.reduceat(stretches[place[start[at] : end[to - 1]]], start[at:to] - start[at], axis=0)
        at = to
    return np.minimum.reduceat(least, first, axis=0)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A key for each set and band."""
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(parts.shape[2]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out


def _once(fp: np.ndarray, counts: np.ndarray) -> np.ndarray:
    use = np.zeros(len(fp), dtype=bool)
    use[np.unique(fp, return_index=True)[1]] = True
    return use & (counts > 0)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, per_cent: int = PER_CENT, bands: int = BANDS, rows: int = ROWS, **how) -> DataFrame:
    """One row for each row of ``docs``: id, row_key, n_shingles, component_id (the smallest id reachable over links), root (a set that stands for the component; of an empty set its row's key). ``how``: the sizes of :func:`linking.within`."""
    told = docs.select(F.col(doc_id).cast("long").alias("id"), row_key(doc_id, text).alias("row_key"), F.col(text).cast("string").alias("text"))

    def prints_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, _, counts = shingle_sets(Words(batch.column(2)), width)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(set_prints(values, counts).view(np.int64)), pa.array(counts)], ["id", "row_key", "fp", "n_shingles"])

    def keys_of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        values, doc, counts = shingle_sets(Words(batch.column(0)), width)
        fp = set_prints(values, counts)
        use = _once(fp, counts)
        if not use.any():
            return None
        keys = band_keys(signatures(values[use[doc]], counts[use], bands * rows), bands)
        return pa.RecordBatch.from_arrays([pa.array(fp[use].view(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1).view(np.int64)), bands).cast(pa.list_(pa.int64()))], ["fp", "keys"])

    prints = checkpoint(map_text(told, "text", prints_of, "id long, row_key long, fp long, n_shingles long"))
    signed = checkpoint(map_text(told.select("text"), "text", keys_of, "fp long, keys array<long>").dropDuplicates(["fp"]))
    roots = linked_roots(signed.select(F.explode("keys").alias("k"), "fp"), lambda wanted: sets_with(told, wanted, width), per_cent, **how)
    # The empty set links nothing: its rows stand alone. A component, or a set, may have a third of all rows; checkpoints part joins from aggregates.
    some = prints.filter("n_shingles > 0")
    least = checkpoint(some.groupBy("fp").agg(F.min("id").alias("least")).join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = checkpoint(least.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = checkpoint(least.select("fp", "root").join(named, "root"))
    full = some.join(by_fp, "fp").select("id", "row_key", "n_shingles", "component_id", "root")
    empty = prints.filter("n_shingles = 0").select("id", "row_key", "n_shingles", F.col("id").alias("component_id"), F.col("row_key").alias("root"))
    return full.unionByName(empty)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row kept of each component, as :func:`simhash.keep_first` has it."""
    return keep_first(docs, near_duplicates(docs, doc_id, text, **how), doc_id, text)
