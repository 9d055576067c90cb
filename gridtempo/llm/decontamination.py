"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters and digits, A-Z folded. An overlap is a window of ``WINDOW`` tokens (the whole item, if shorter) on one diagonal of a
document and an item, of which at least ``AGREE`` are equal. Of such a window's halves one has at most one substituted token in its first
seven, so one of four fixed masks of seven positions, which between them ignore each position, hits: no overlap is missed. Shorter
items (5 tokens at least) are found alike by masks of five positions. Of items of 1 to 4 tokens 80% means all, so that they are found by the hash of the whole
item; as they are common words rather than evidence, :func:`overlaps` reports them and :func:`decontaminate` goes by items of ``least`` tokens or more.

The masked hashes of all benchmark positions make a table; their bits make a filter, which every training position passes before it leaves its
task. It has 16 bits or more for each hash, eight of them set, so that at most some 6 of 10,000 other positions pass, up to ``MOST_BITS`` (128 MB, 67 million hashes);
a table beyond that only lets more positions through to the join.
Positions that pass are joined with the table, and the tokens around each (document, item, diagonal) hit are compared with the item's.

Defined results: null and empty texts and items have no tokens and no hit; ids may be of any type that casts to long; repeated items and rows are reported once for each id and
item id; null ids are reported as null; empty tables give an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import LEAN_BYTES, checkpoint, map_text, row_key
from ._words import NOT_ALNUM, Words, mix

# 1 counts, 0 is ignored.
MASKS = ("0111110", "1011101", "1101011", "1110111")
SHORT_MASKS = ("01111", "10111", "11011", "11101", "11110")
WINDOW, AGREE, SHORT = 15, 0.8, 5
SPAN = 7
MARGIN = WINDOW
LEAST_BITS, MOST_BITS, BITS_EACH, PROBES = 20, 30, 16, 8
SEGMENT = 2048
_Q = np.uint64(0xD6E8FEB86659FD93)


def masked_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the counted positions for each position at which the mask fits in the array."""
    n = len(tokens) - len(mask) + 1
    out = np.full(max(n, 0), int("1" + mask, 2), dtype=np.uint64)
    if n > 0:
        for j, used in enumerate(mask):
            if used == "1":
                out = out * _Q + tokens[j : j + n]
    return mix(out)


def _probe(h: np.ndarray, bits: int, i: int) -> np.ndarray:
    """The i-th bit of each hash: steps of an odd width from its first bits, both read off the hash."""
    step = (h >> np.uint64(4)) | np.uint64(1)
    return (((h >> np.uint64(64 - bits)) + np.uint64(i) * step) & np.uint64((1 << bits) - 1)).astype(np.int64)


class Filter:
    """A bitmap with ``PROBES`` bits for each hash; tells which hashes may be in the table."""

    def __init__(self, words: np.ndarray, bits: int):
        self.bytes, self.bits = words.view(np.uint8), bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be."""
        at = slice(None)
        for i in range(PROBES):
            p = _probe(hashes[at], self.bits, i)
            found = np.flatnonzero(self.bytes[p >> 3] >> (p & 7).astype(np.uint8) & 1)
            at = found if i == 0 else at[found]
        return at


def _fits(words: Words, span: int) -> np.ndarray:
    """Positions from which ``span`` tokens lie in one text."""
    last = np.repeat(words.bounds[1:], words.counts)
    return np.arange(len(words)) + span <= last


def items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Rows (item_key, item_id, tokens): token hashes of each item as bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(2), NOT_ALNUM)
        h = words.hashes(fold=True)
        tokens = [h[a:b].tobytes() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.binary())], ["item_key", "item_id", "tokens"])

    rows = benchmark.select(row_key(item_id, text).alias("item_key"), F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return map_text(rows.dropDuplicates(["item_key"]), "text", run, "item_key long, item_id long, tokens binary")


def _masks(tokens: int) -> tuple[str, ...]:
    return MASKS if tokens >= WINDOW else SHORT_MASKS if tokens >= SHORT else ("1" * tokens,) if tokens else ()


def seeds(table: DataFrame) -> DataFrame:
    """Rows (hash, item_key, at) of all masked hashes of all items."""

    def run(batches):
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.frombuffer(raw, dtype=np.uint64)
                for mask in _masks(len(tokens)):
                    h = masked_hashes(tokens, mask)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), key, dtype=np.int64)), pa.array(np.arange(len(h), dtype=np.int32))], ["hash", "item_key", "at"])

    return table.select("item_key", "tokens").mapInArrow(run, "hash long, item_key long, at int").distinct()


def hash_filter(table: DataFrame) -> Filter:
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * table.count()).bit_length()))

    def run(batches):
        for batch in batches:
            at = np.unique(np.concatenate([_probe(batch.column(0).to_numpy().view(np.uint64), bits, i) for i in range(PROBES)]))
            word, one = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            if len(head):
                yield pa.RecordBatch.from_arrays([pa.array(word[head]), pa.array(np.bitwise_or.reduceat(one, head).view(np.int64))], ["word", "bits"])

    words = table.select("hash").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros((1 << bits) // 64, dtype=np.int64)
    packed[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return Filter(packed, bits)


def short_hits(docs: DataFrame, doc_id: str, text: str, shared, lengths: list[int]) -> DataFrame:
    """Rows (id, row_key, hash): the distinct runs of 1 to 4 tokens of each document that pass the filter, of the lengths that items have."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        words = Words(batch.column(2), NOT_ALNUM)
        h, of = words.hashes(fold=True), words.documents()
        docs, found = [], []
        for k in lengths:
            seed = masked_hashes(h, "1" * k)
            at = shared.value(seed)
            at = at[_fits(words, k)[at]]
            docs.append(of[at])
            found.append(seed[at])
        doc, seed = np.concatenate(docs), np.concatenate(found)
        if not len(doc):
            return None
        order = np.lexsort((seed, doc))
        doc, seed = doc[order], seed[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (seed[1:] != seed[:-1])])
        doc = pa.array(doc[new])
        return pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), pa.array(seed[new].view(np.int64))], ["id", "row_key", "hash"])

    return map_text(_rows(docs, doc_id, text), "text", run, "id long, row_key long, hash long", LEAN_BYTES)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), row_key(doc_id, text).alias("row_key"), F.col(text).cast("string").alias("text"))


def segments(docs: DataFrame, doc_id: str, text: str, shared, short: bool) -> DataFrame:
    """Rows (id, row_key, start, tokens, hits): stretches of documents around positions that pass the filter, at most SEGMENT hits' width long."""
    masks = MASKS + (SHORT_MASKS if short else ())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        may_be = shared.value
        words = Words(batch.column(2), NOT_ALNUM)
        h = words.hashes(fold=True)
        places, found = [], []
        for mask in masks:
            seed = masked_hashes(h, mask)
            at = may_be(seed)
            at = at[_fits(words, len(mask))[at]]
            places.append(at)
            found.append(seed[at])
        at, seed = np.concatenate(places), np.concatenate(found)
        if not len(at):
            return None
        order = np.argsort(at, kind="stable")
        at, seed = at[order], seed[order]
        doc = np.searchsorted(words.bounds, at, "right") - 1
        far = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > SPAN + 2 * MARGIN)])
        head = at[np.maximum.accumulate(np.where(far, np.arange(len(at)), 0))]
        block = (at - head) // SEGMENT
        cut = np.flatnonzero(far | np.concatenate([[True], block[1:] != block[:-1]]))
        end = np.append(cut[1:], len(at))
        d = doc[cut]
        lo = np.maximum(at[cut] - MARGIN, words.bounds[d])
        hi = np.minimum(at[end - 1] + SPAN + MARGIN, words.bounds[d + 1])
        hits = pa.ListArray.from_arrays(pa.array(np.append(cut, len(at)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(seed.view(np.int64)), pa.array((at - words.bounds[doc]).astype(np.int32))], ["hash", "at"]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(d)), batch.column(1).take(pa.array(d)), pa.array((lo - words.bounds[d]).astype(np.int32)), pa.array([h[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()), hits],
            ["id", "row_key", "start", "tokens", "hits"],
        )

    return map_text(_rows(docs, doc_id, text), "text", run, "id long, row_key long, start int, tokens binary, hits array<struct<hash: long, at: int>>", LEAN_BYTES)


def best_window(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """The most equal tokens in any window of the diagonal (item position = document position - shift), and the window's length."""
    width = min(len(item), WINDOW)
    lo, hi = max(0, shift), min(len(doc), shift + len(item))
    if hi - lo < width:
        return 0, width
    sums = np.concatenate([[0], np.cumsum(doc[lo:hi] == item[lo - shift : hi - shift])])
    return int((sums[width:] - sums[:-width]).max()), width


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 1) -> DataFrame:
    """Rows (id, row_key, item_id, matched, width) for every document and item of ``least`` tokens or more that overlap."""
    table = checkpoint(items(benchmark, item_id, item_text).filter(F.octet_length("tokens") >= 8 * least))
    hashes = checkpoint(seeds(table))
    lengths = sorted(r[0] for r in table.select((F.octet_length("tokens") / 8).cast("int").alias("n")).filter(F.col("n").between(1, WINDOW - 1)).distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(hash_filter(hashes))
    parts = checkpoint(segments(docs, doc_id, text, shared, any(n >= SHORT for n in lengths)))
    hits = parts.select("row_key", "start", F.explode("hits").alias("h")).select("row_key", "start", "h.hash", F.col("h.at").alias("place"))
    hits = hits.join(hashes, "hash").select("row_key", "start", "item_key", (F.col("place") - F.col("at") - F.col("start")).alias("shift")).distinct()
    pairs = hits.join(table.withColumnRenamed("tokens", "item_tokens"), "item_key").join(parts.select("id", "row_key", "start", "tokens").dropDuplicates(["row_key", "start"]), ["row_key", "start"])

    def run(batches):
        for batch in batches:
            done = [best_window(np.frombuffer(d, np.uint64), np.frombuffer(i, np.uint64), s) for d, i, s in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.int32())], ["id", "row_key", "item_id", "matched", "width"])

    verified = pairs.select("id", "row_key", "item_id", "tokens", "item_tokens", "shift").mapInArrow(run, "id long, row_key long, item_id long, matched int, width int")
    verified = verified.filter(F.col("matched") >= AGREE * F.col("width"))
    exact = [n for n in lengths if n < SHORT]
    if exact:
        brief = table.select("item_key", "item_id", (F.octet_length("tokens") / 8).cast("int").alias("matched")).filter(F.col("matched") < SHORT).join(hashes, "item_key").select("hash", "item_id", "matched")
        verified = verified.unionByName(short_hits(docs, doc_id, text, shared, exact).join(brief, "hash").select("id", "row_key", "item_id", "matched", F.col("matched").alias("width")))
    return verified.groupBy("id", "row_key", "item_id").agg(F.max("matched").alias("matched"), F.max("width").alias("width"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = SHORT) -> DataFrame:
    """``docs`` without the documents that overlap with an item of ``least`` tokens or more."""
    leaked = overlaps(docs, benchmark, doc_id, text, item_id, item_text, least).select(F.col("row_key").alias("__row_key")).distinct()
    return docs.withColumn("__row_key", row_key(doc_id, text)).join(leaked, "__row_key", "left_anti").drop("__row_key")
