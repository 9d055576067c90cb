"""Language-model scoring by Brown class-based n-grams.

The probability of a token is that of its class after the class before it, times that of the token in its class. Classes come
from exchange clustering of all words that training has twice or more. The ``CORE`` most frequent ones seed it: they move between classes, one at a time, wherever that
raises the likelihood of the class bigrams most, until a sweep moves none, and each other word joins the class that makes its neighbours in the core most likely. Then come rounds over all
words and all bigrams: the core is exchanged again, now with the classes of all other words as neighbours, and every other word moves, as in distributed
exchange, to the class that makes all its neighbours most likely, its own share of the counts left out. Rounds end when one doesn't raise the likelihood, or after ``ROUNDS``.
The end of a text is a class by itself (it also stands before the first word). So are the words seen once, together with those not seen in training:
without its only occurrence such a word is unseen, and tells what follows unseen ones.

Counts cover the whole training part: all words and all bigrams. The texts are read once for the counts of words and once for the neighbours of each word, which are kept by buckets of words, a row for each bucket;
rounds read these rows only. Arrays of fixed size for each task hold the core's bigrams and the classes'. The ``LISTED`` most frequent words have
their classes broadcast (5 MB), which bounds a task's memory, not the clustering: every other word is placed by the same rule, and
its class is sent to its neighbours in each round and to the documents that ask for it. No word is left out, and no neighbour. Words are told apart by 64-bit hashes.

Smoothing: class transitions are discounted by ``DISCOUNT`` and interpolated with class frequencies. A word seen c times has c / T in a class of T tokens; in
the class of rare words, of V words, it has (c - DISCOUNT) / (T + 1), and unseen words together (DISCOUNT * V + 1) / (T + 1). All sum to one.

The base model is the unigram model with one added to each count, unseen words being one more word.

Defined results: a null or empty text is its end token alone; without training rows all probabilities are those of empty counts; repeated
rows count as often as they occur and have rows of their own; null ids belong to the part that crc32 of an empty string gives; of words as frequent as
one another all are listed or none; an empty table gives an empty one. Ids are numbers or
text that reads as such; another id is an error (ANSI cast).
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._lookup import Lookup
from ._shared import checkpoint, row_key, text_slices
from ._words import Words

LISTED, CORE, CLASSES = 1 << 19, 1024, 64
END, RARE = 0, 1
SWEEPS, ROUNDS, DISCOUNT = 12, 2, 0.7
FLUSH, EXACT, SLICE = 1 << 20, 4096, 1 << 21
#: Most tokens and words of a bucket of listed words (a row for each bucket spares Spark one for each word), and how many buckets a small table has.
BUCKET, BUCKET_WORDS, BUCKETS = 1 << 17, 1 << 11, 256
#: Of a neighbour: no class yet; of an unlisted word's neighbour: the end of a text.
NONE, EDGE = -1, -1
#: Before or after an unlisted word: another one.
OPEN = 255


class Tokens:
    """From texts to positions in the list of words (-1: not listed), and to the unit of, and before, each token: each text's words and its end.

    ``unit_of`` has a unit for each listed word, then one for the others and one for the end.
    """

    def __init__(self, lookup: Lookup, unit_of: np.ndarray, texts: pa.Array):
        w = self.words = Words(texts)
        self.hashes = w.hashes(fold=True)
        self.at = lookup(self.hashes)
        self.word_unit = unit_of[np.where(self.at >= 0, self.at, len(unit_of) - 2)]
        n = w.counts + 1
        self.starts = np.cumsum(n) - n
        self.is_word = np.ones(int(n.sum()), dtype=bool)
        self.is_word[self.starts + w.counts] = False
        end = unit_of[-1]
        self.unit = np.full(int(n.sum()), end, dtype=np.int64)
        self.unit[self.is_word] = self.word_unit
        self.before = np.concatenate([[end], self.unit[:-1]]) if len(self.unit) else self.unit


def frequent(training: DataFrame) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Hashes and counts of the most frequent words of all training rows, at most LISTED of those seen twice or more, the most frequent first; and all words' counts."""

    def run(batches):
        words, times, many = [], [], 0

        def summed():
            word, at = np.unique(np.concatenate(words), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(at, np.concatenate(times)).astype(np.int64))], ["word", "n"])

        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                word, n = np.unique(Words(part.column(0)).hashes(fold=True), return_counts=True)
                words.append(word)
                times.append(n)
                many += len(word)
                if many > FLUSH // 2:
                    yield summed()
                    words, times, many = [], [], 0
        if many:
            yield summed()

    counts = checkpoint(training.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # ranks of counts, exact for small ones; a few thousand whatever the corpus, so that no task sorts the vocabulary
    step = F.when(F.col("n") < EXACT, F.col("n")).otherwise(EXACT + F.floor((F.log2("n") - float(np.log2(EXACT))) * 256))
    listed, least = 0, None
    for rank, words in sorted((tuple(r) for r in counts.filter("n > 1").groupBy(step.alias("rank")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True):
        listed += words
        if listed > LISTED:
            break
        least = rank
    top = counts.filter(step >= least if least is not None else F.lit(False)).toArrow()
    word, n = top.column(0).to_numpy(), top.column(1).to_numpy()
    order = np.lexsort((word, -n))
    return word[order].view(np.uint64), n[order], counts


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of the values between each two cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes(column: pa.Array) -> bytes:
    """All bytes of a column of them, one row's after the other's."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return column.buffers()[2][ends[0] : ends[-1]].to_pybytes() if ends[-1] > ends[0] else b""


def _runs(batches):
    """The buckets of sorted rows, with the bytes of each further column in all of a bucket's rows."""
    now, pieces = None, []
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if bucket[lo] != now and pieces:
                yield now, [b"".join(x) for x in zip(*pieces, strict=True)]
                pieces = []
            now = int(bucket[lo])
            pieces.append([_bytes(x.slice(lo, hi - lo)) for x in batch.columns[1:]])
    if pieces:
        yield now, [b"".join(x) for x in zip(*pieces, strict=True)]


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def bucket_size(tokens: int) -> int:
    """Tokens of a bucket, of so many in all."""
    return max(1, min(BUCKET, tokens // BUCKETS))


def buckets(n: np.ndarray, core: int) -> np.ndarray:
    """The first listed word of each bucket of words beyond the core, and the end of the list. A bucket has at most BUCKET_WORDS, and beside its first word at most BUCKET tokens."""
    load = np.cumsum(n[core:] / bucket_size(int(n[core:].sum())) + 1 / BUCKET_WORDS)
    at = np.floor(load - load[:1])
    return core + np.concatenate([np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64), [len(at)]]).astype(np.int64)


def neighbours(training: DataFrame, listed: np.ndarray, core: int, first: np.ndarray, others: int) -> DataFrame:
    """What stands beside what in all training rows, from one pass; a row for each bucket, with these columns of bytes.

    ``bucket`` from 0: listed words beyond the core. ``word`` has how often each occurs, ``before`` and ``after`` the codes of what is beside each occurrence, word by word.
    After these, ``others`` buckets of the words that aren't listed, of those seen twice or more: ``word`` has the hash at each occurrence, in order; of their neighbours that aren't listed the code is the hash, of an end EDGE.
    Below 0: pairs of units (each word of the core, the listed words beyond it, other words, the end): ``before`` has cells of their matrix, ``after`` counts.
    A code is a position in the list, its length for other words, one more for the end.
    """
    shared, units, rest = training.sparkSession.sparkContext.broadcast((listed, first)), core + 3, len(first) - 1
    names, schema = ["bucket", "word", "before", "after"], "bucket int, word binary, before binary, after binary"

    def row(bucket, *columns):
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in columns]], names)

    def run(batches):
        listed, first = shared.value
        lookup, other = Lookup(listed), len(listed)
        unit_of = np.concatenate([np.arange(core), np.full(other - core, core), [core + 1, core + 2]])
        pairs, beside, apart, many = np.zeros(units * units, np.int64), [], [], 0

        def dealt():
            word, before, after = np.concatenate(beside, axis=1)
            order = np.argsort(word)
            word = word[order]
            cuts = np.searchsorted(word, first)
            some = np.flatnonzero(np.diff(cuts))
            cuts = np.append(cuts[some], len(word))
            offset = (word - np.repeat(first[some], np.diff(cuts))).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), _binary(offset, cuts), _binary(before[order], cuts), _binary(after[order], cuts)], names)
            word, before, after = np.concatenate(apart, axis=1)
            bucket = (word.view(np.uint64) % np.uint64(others)).astype(np.int32)
            order = np.argsort(bucket)
            bucket = bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rest + bucket[cuts[:-1]]), *[_binary(x[order], cuts) for x in (word, before, after)]], names)

        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                t = Tokens(lookup, np.arange(other + 2), part.column(0))
                before, unit = unit_of[t.before], unit_of[t.unit]
                pairs += np.bincount(before * units + unit, minlength=units * units)
                mine = np.flatnonzero(unit == core)
                beside.append(np.stack([t.unit[mine], t.before[mine], t.unit[mine + 1]]).astype(np.int32))
                code = np.full(len(unit) + 1, EDGE, dtype=np.int64)
                code[1:][t.is_word] = np.where(t.at >= 0, t.at, t.hashes.view(np.int64))
                mine = np.flatnonzero(t.unit == other)
                apart.append(np.stack([code[mine + 1], code[mine], code[mine + 2]]))
                many += beside[-1].shape[1] + 2 * len(mine)
                if many > FLUSH:
                    yield from dealt()
                    beside, apart, many = [], [], 0
        if many:
            yield from dealt()
        some = np.flatnonzero(pairs)
        part = some >> 14
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(some) else np.zeros(1, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((-1 - part[cuts[:-1]]).astype(np.int32)), _binary(some, np.zeros(len(cuts), np.int64)), _binary(some, cuts), _binary(pairs[some], cuts)], names)

    def merged(batches):
        first = shared.value[1]
        for bucket, (word, before, after) in _runs(batches):
            if bucket < 0:
                cells, at = np.unique(np.frombuffer(before, np.int64), return_inverse=True)
                yield row(bucket, cells[:0], cells, np.bincount(at, np.frombuffer(after, np.int64)).astype(np.int64))
            elif bucket < rest:
                word = np.frombuffer(word, np.uint16)
                order = np.argsort(word, kind="stable")
                yield row(bucket, np.bincount(word, minlength=first[bucket + 1] - first[bucket]).astype(np.int32), np.frombuffer(before, np.int32)[order], np.frombuffer(after, np.int32)[order])
            else:
                word, at, times = np.unique(np.frombuffer(word, np.int64), return_inverse=True, return_counts=True)
                order = np.argsort(at, kind="stable")
                order = order[times[at[order]] > 1]
                yield row(bucket, word[at[order]], np.frombuffer(before, np.int64)[order], np.frombuffer(after, np.int64)[order])

    return checkpoint(_by_bucket(training.select("text").mapInArrow(run, schema)).mapInArrow(merged, schema))


def core_bigrams(near: DataFrame, core: int) -> np.ndarray:
    """The matrix of the units of :func:`neighbours`: each word of the core, the other listed words, words that aren't listed, the end."""
    pairs = np.zeros((core + 3) ** 2, np.int64)
    for part in near.filter("bucket < 0").select("before", "after").toArrow().to_batches():  # at most (CORE + 3) ** 2 cells, whatever the corpus
        cells, n = (np.frombuffer(_bytes(x), np.int64) for x in part.columns)
        pairs[cells] = n
    return pairs.reshape(core + 3, core + 3)


def _matrix(cells: DataFrame, units: int) -> np.ndarray:
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # bounded by the number of units
    pairs = np.zeros(units * units, np.int64)
    pairs[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return pairs.reshape(units, units)


def _nonzero(cells: np.ndarray, n: np.ndarray):
    for a in range(0, len(cells), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(cells[a : a + 50_000]), pa.array(n[a : a + 50_000])], ["cell", "n"])


def listed_bigrams(near: DataFrame, of: np.ndarray, core: int, first: np.ndarray) -> np.ndarray:
    """The bigrams with a listed word beyond the core, units being the core's words and the classes of all others."""
    shared, units, classes = near.sparkSession.sparkContext.broadcast((of.astype(np.int16), first)), core + CLASSES, CLASSES

    def run(batches):
        of, first = shared.value
        unit_of = np.concatenate([np.arange(core), core + of[core:]]).astype(np.int32)
        left, right = np.zeros(units * classes, np.int64), np.zeros(classes * units, np.int64)
        for batch in batches:
            for bucket, (word, before, after) in _runs([batch]):
                own = np.repeat(of[first[bucket] : first[bucket + 1]], np.frombuffer(word, np.int32)).astype(np.int32)
                left += np.bincount(unit_of[np.frombuffer(before, np.int32)] * classes + own, minlength=len(left))
                after = np.frombuffer(after, np.int32)
                ends = (after < core) | (after >= len(of) - 2)  # a pair of two such words is counted at the second one
                right += np.bincount(own[ends] * units + unit_of[after[ends]], minlength=len(right))
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        yield from _nonzero(a // classes * units + core + a % classes, left[a])
        yield from _nonzero(core * units + b, right[b])

    return _matrix(near.mapInArrow(run, "cell long, n long"), units)


def _packed(keys: np.ndarray, values: np.ndarray) -> list[pa.Array]:
    """Distinct keys, in order, and the bytes of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], np.ascontiguousarray(values[order])
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(head, len(keys)) * (values.nbytes // max(1, len(values)))
    return [pa.array(keys[head]), pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])]


def _unpacked(pieces: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The row of each value, and the values, of a column of bytes or of lists of them (null: none)."""
    rows = np.arange(len(pieces))
    if pa.types.is_list(pieces.type):
        rows, pieces = np.repeat(rows, pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)), pieces.flatten()
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int32)
    body = pieces.buffers()[2] if len(pieces) else None
    data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None else np.zeros(0, np.uint8)
    return np.repeat(rows, np.diff(ends) // np.dtype(kind).itemsize), np.frombuffer(data.tobytes(), kind)


def best(n: np.ndarray, here: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class in which the neighbours of each word are most likely, its own share of the class it is in left out; without neighbours that of the rare ones."""
    smooth, k = table + 0.1, len(table)
    # what a class lends to a neighbour of each class before it, and after it
    lent = np.concatenate([np.log(smooth) - np.log(smooth.sum(axis=0, keepdims=True)), (np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))).T])
    gain = n @ lent
    own = np.flatnonzero(here >= 0)
    gain[own, here[own]] = 0
    for x, s in ((n[own, :k], smooth.T), (n[own, k:], smooth)):
        mine = s[here[own]]
        rest = np.log(np.maximum(mine - x, 0.1)) - np.log(np.maximum(mine.sum(axis=1) - x.sum(axis=1), 0.1 * k))[:, None]
        gain[own, here[own]] += (x * rest).sum(axis=1)
    gain[:, [END, RARE]] = -np.inf
    return np.where(n.any(axis=1), gain.argmax(axis=1), RARE)


def _listed_cells(batches, of: np.ndarray, first: np.ndarray, width: int):
    for batch in batches:
        for bucket, (word, before, after) in _runs([batch]):
            times = np.frombuffer(word, np.int32)
            owner, n = np.repeat(np.arange(len(times), dtype=np.int32) * width, times), np.zeros(len(times) * width, np.int64)
            for side, codes in ((0, before), (width // 2, after)):
                found = of[np.frombuffer(codes, np.int32)]
                n += np.bincount((owner + found + side)[found >= 0], minlength=len(n))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.stack([some, n[some]], axis=1).astype(np.int32).tobytes()], pa.binary())], ["bucket", "cells"])


def listed_cells(near: DataFrame, of: np.ndarray, first: np.ndarray) -> DataFrame:
    """Of the listed words of each bucket how often they have a neighbour of which class: ``cells`` has pairs of cell and count. A cell is a class, plus CLASSES where that comes after the word, plus twice CLASSES for each word before
    this one in the bucket. ``of`` ends with the classes of other words and the end; NONE isn't counted."""
    shared, width = near.sparkSession.sparkContext.broadcast((of.astype(np.int16), first)), 2 * CLASSES
    return near.mapInArrow(lambda batches: _listed_cells(batches, *shared.value, width), "bucket int, cells binary")


def _unlisted(batches):
    """Words seen twice or more that aren't listed: word, n, and what comes before and after each occurrence, as position in the list, EDGE or hash."""
    for batch in batches:
        for _, (word, before, after) in _runs([batch]):
            word, seen = np.frombuffer(word, np.int64), np.stack([np.frombuffer(x, np.int64) for x in (before, after)], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]])) if len(word) else np.zeros(1, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cuts)).astype(np.int32)), _binary(seen, cuts * 2))
            yield pa.RecordBatch.from_arrays([pa.array(word[cuts[:-1]]), pa.array(np.diff(cuts)), lists], ["word", "n", "seen"])


class Open:
    """Of a batch of unlisted words the row, the side (0 before, ``classes`` after) and the code of each neighbour; ``known`` marks listed ones and ends."""

    def __init__(self, batch: pa.RecordBatch, listed: int, classes: int):
        row, code = _unpacked(batch.column(batch.schema.get_field_index("seen")), np.int64)
        self.row, self.code = row, code
        self.side = np.tile([0, classes], len(code) // 2)
        self.known = (code >= EDGE) & (code < listed)


def first_classes(apart: DataFrame, of: np.ndarray, table: np.ndarray) -> DataFrame:
    """Unlisted words, from their buckets, with the class that their neighbours in ``of`` give."""
    shared = apart.sparkSession.sparkContext.broadcast((of.astype(np.int16), table))

    def run(batches):
        of, table = shared.value
        for batch in _unlisted(batches):
            o = Open(batch, len(of) - 2, CLASSES)
            near = np.where(o.known, of[np.where(o.known, o.code, 0)], NONE)
            ok = near >= 0
            n = np.bincount(o.row[ok] * 2 * CLASSES + near[ok] + o.side[ok], minlength=batch.num_rows * 2 * CLASSES).reshape(-1, 2 * CLASSES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best(n, np.full(len(n), NONE), table).astype(np.int32))], ["word", "n", "seen", "class"])

    return checkpoint(apart.mapInArrow(run, "word long, n long, seen array<binary>, class int"))


def told(words: DataFrame, listed: int) -> DataFrame:
    """Unlisted words with what those next to them tell: ``cells``, a byte for each neighbour that is one of these words, its class and side."""

    def run(batches):
        for batch in batches:
            o, mine = Open(batch, listed, CLASSES), batch.column(batch.schema.get_field_index("class")).to_numpy()
            to = np.flatnonzero(~o.known)
            if len(to):
                # for a word before this one, this one comes after
                yield pa.RecordBatch.from_arrays(_packed(o.code[to], (mine[o.row[to]] + CLASSES - o.side[to]).astype(np.uint8)), ["word", "cells"])

    sent = words.mapInArrow(run, "word long, cells binary").groupBy("word").agg(F.collect_list("cells").alias("cells"))
    return checkpoint(words.join(sent, "word", "left"))


def open_bigrams(words: DataFrame, unit_of: np.ndarray, core: int) -> np.ndarray:
    """What the unlisted words' classes change in the matrix of unit bigrams, where all of them stood for rare ones."""
    shared, units = words.sparkSession.sparkContext.broadcast(unit_of.astype(np.int16)), core + CLASSES

    def run(batches):
        unit_of, pairs, rare = shared.value.astype(np.int64), np.zeros(units * units, np.int64), core + RARE
        add = lambda a, b, n=1: np.add.at(pairs, a * units + b, n)
        for batch in batches:
            o, mine = Open(batch, len(unit_of) - 2, CLASSES), core + batch.column(batch.schema.get_field_index("class")).to_numpy().astype(np.int64)
            for side in (0, CLASSES):
                at = np.flatnonzero(o.known & (o.side == side))
                near, own = unit_of[o.code[at]], mine[o.row[at]]
                for unit, n in ((own, 1), (np.full(len(own), rare), -1)):
                    add(near if side == 0 else unit, unit if side == 0 else near, n)
            row, cell = _unpacked(batch.column(batch.schema.get_field_index("cells")), np.uint8)
            before = cell < CLASSES  # pairs of two such words are counted at the second one
            add(core + cell[before].astype(np.int64), mine[row[before]])
            once = [np.bincount(o.row[~o.known & (o.side == side)], minlength=len(mine)) - np.bincount(row[before == (side == 0)], minlength=len(mine)) for side in (0, CLASSES)]
            add(np.full(len(mine), rare), mine, once[0])
            add(mine, np.full(len(mine), rare), once[1])
            pairs[rare * units + rare] -= int(before.sum() + once[0].sum() + once[1].sum())
        some = np.flatnonzero(pairs)
        yield from _nonzero(some, pairs[some])

    return _matrix(words.mapInArrow(run, "cell long, n long"), units)


def open_cells(words: DataFrame, listed: int, core: int, first: np.ndarray) -> DataFrame:
    """What the unlisted words' classes change in :func:`listed_cells`, where all of them stood for rare ones."""
    shared, width = words.sparkSession.sparkContext.broadcast(first), 2 * CLASSES

    def run(batches):
        first, keys, times, many = shared.value, [], [], 0

        def dealt():
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(times))
            cuts = np.searchsorted(key, first * width)
            some = np.flatnonzero(np.diff(cuts))
            cuts = np.append(cuts[some], len(key))
            cells = np.stack([key - np.repeat(first[some] * width, np.diff(cuts)), n], axis=1).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), _binary(cells, cuts * 2)], ["bucket", "cells"])

        for batch in batches:
            o, mine = Open(batch, listed, width // 2), batch.column(batch.schema.get_field_index("class")).to_numpy()
            at = np.flatnonzero(o.known & (o.code >= core))
            cell = o.code[at] * width + width // 2 - o.side[at]
            keys += [cell + mine[o.row[at]], cell + RARE]
            times += [np.ones(len(at)), np.full(len(at), -1.0)]
            many += 2 * len(at)
            if many > FLUSH // 2:
                yield dealt()
                keys, times, many = [], [], 0
        if many:
            yield dealt()

    return words.mapInArrow(run, "bucket int, cells binary")


def moved_unlisted(words: DataFrame, of: np.ndarray, table: np.ndarray) -> DataFrame:
    """Unlisted words with the class that all their neighbours give."""
    shared = words.sparkSession.sparkContext.broadcast((of.astype(np.int16), table))

    def run(batches):
        of, table = shared.value
        for batch in batches:
            o, here = Open(batch, len(of) - 2, CLASSES), batch.column(3).to_numpy()
            near = np.where(o.known, of[np.where(o.known, o.code, 0)], RARE)
            n = np.bincount(o.row * 2 * CLASSES + near + o.side, minlength=batch.num_rows * 2 * CLASSES)
            row, cell = _unpacked(batch.column(4), np.uint8)
            n += np.bincount(row * 2 * CLASSES + cell, minlength=len(n)) - np.bincount(row * 2 * CLASSES + RARE + np.where(cell < CLASSES, 0, CLASSES), minlength=len(n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best(n.reshape(-1, 2 * CLASSES), here, table).astype(np.int32))], ["word", "n", "seen", "class"])

    return checkpoint(words.select("word", "n", "seen", "class", "cells").mapInArrow(run, "word long, n long, seen array<binary>, class int"))


def moved_listed(cells: DataFrame, of: np.ndarray, table: np.ndarray, core: int, first: np.ndarray) -> np.ndarray:
    """The class of each listed word: of the core's as given, of the others the one that their neighbours give. ``cells``: all cells of a bucket next to one another, or rows of :func:`neighbours`,
    whose cells are counted in the same Python workers."""
    counted = "cells" in cells.columns
    shared, width = cells.sparkSession.sparkContext.broadcast((of.astype(np.int16), table, first)), 2 * CLASSES

    def run(batches):
        of, table, first = shared.value
        for bucket, (found,) in _runs(batches if counted else _listed_cells(batches, of, first, width)):
            here, found = of[first[bucket] : first[bucket + 1]], np.frombuffer(found, np.int32).reshape(-1, 2)
            n = np.bincount(found[:, 0], found[:, 1], len(here) * width).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([best(n, here, table).astype(np.int16).tobytes()], pa.binary())], ["bucket", "classes"])

    found = cells.mapInArrow(run, "bucket int, classes binary").toArrow()  # at most LISTED words
    out = of.copy()
    out[core:-2] = RARE
    for bucket, classes in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        out[first[bucket] : first[bucket + 1]] = np.frombuffer(classes, np.int16)
    return out


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, alone: int = 1, given: np.ndarray | None = None) -> np.ndarray:
    """The class of each unit; the last units are alone in classes 0 (the very last), 1 and so on.

    The most frequent units start a class each; the others join, by frequency, the class that raises the likelihood most, and then all move
    likewise. Likelihood of the class bigrams: the sum of n log n over pairs of classes, less those of their left and right totals.

    With ``given`` classes the units move from there, and the last units, one for each class, stay.
    """
    units = len(pairs)
    pairs = pairs.astype(np.float64)
    weight = pairs.sum(axis=0)
    order = np.argsort(-weight[: units - (alone if given is None else classes)], kind="stable")
    if given is None:
        of = np.full(units, -1)
        of[units - alone :] = np.arange(alone)[::-1]
        of[order[: classes - alone]] = alone + np.arange(min(classes - alone, units - alone))
    else:
        of = given.copy()
    one = np.zeros((units, classes))
    one[of >= 0, of[of >= 0]] = 1
    table = one.T @ pairs @ one
    xlogx = lambda x: x * np.log(np.maximum(x, 1.0))
    for _ in range(sweeps):
        moved = 0
        for u in order:
            here, self_pair = of[u], pairs[u, u]
            of[u] = -1
            placed = of >= 0
            after = np.bincount(of[placed], pairs[u, placed], classes)
            before = np.bincount(of[placed], pairs[placed, u], classes)
            if here >= 0:
                table[here] -= after
                table[:, here] -= before
                table[here, here] -= self_pair
            base = xlogx(table)
            rows = xlogx(table + after[None, :]) - base
            cols = (xlogx(table + before[:, None]) - base).T
            corner = np.diag(table)
            gain = rows.sum(1) - np.diag(rows) + cols.sum(1) - np.diag(cols) + xlogx(corner + after + before + self_pair) - xlogx(corner)
            for sums, more in ((table.sum(1) + before, after.sum() + self_pair), (table.sum(0) + after, before.sum() + self_pair)):
                gain -= xlogx(sums + more) - xlogx(sums)
            gain[:alone] = -np.inf
            best = int(np.argmax(gain))
            if here >= 0 and gain[best] <= gain[here] + 1e-9:
                best = here
            moved += best != here
            of[u] = best
            table[best] += after
            table[:, best] += before
            table[best, best] += self_pair
        if not moved:
            break
    return of


def likelihood(table: np.ndarray) -> float:
    g = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return float(g(table) - g(table.sum(0)) - g(table.sum(1)))


class Model:
    """Classes of the words, transitions between classes, and what the listed words have in theirs; ``rest`` has the other words: word, n, class."""

    def __init__(self, common: np.ndarray, counts: np.ndarray, common_of: np.ndarray, table: np.ndarray, rest: DataFrame, distinct: int, rare_words: int):
        self.common, self.counts, self.common_of, self.rest = common, counts, common_of, rest
        self.tokens = table.sum(axis=0)
        self.train_tokens, self.ends = int(table.sum()), int(self.tokens[END])
        self.distinct = distinct + (self.ends > 0)
        frequency = (self.tokens + 1) / (self.tokens.sum() + CLASSES)
        left = table.sum(axis=1, keepdims=True)
        spared = DISCOUNT * (table > 0).sum(axis=1, keepdims=True) + 1
        self.step = np.log10((np.maximum(table - DISCOUNT, 0) + spared * frequency[None, :]) / (left + 1))
        self.rare_log = float(np.log10(self.tokens[RARE] + 1))
        self.unseen_log = float(np.log10(DISCOUNT * rare_words + 1)) - self.rare_log
        self.word_log = self.emitted(counts, common_of)

    def emitted(self, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.where(of == RARE, np.log10(np.maximum(n - DISCOUNT, 1 - DISCOUNT)) - self.rare_log, np.log10(np.maximum(n, 1)) - np.log10(np.maximum(self.tokens[of], 1)))

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and classes of all words that have classes of their own, in the driver: for looking at models of small corpora; scores don't need it."""
        rest = self.rest.filter(F.col("class") != RARE).select("word", "class").toArrow()
        return np.concatenate([self.common, rest.column(0).to_numpy().view(np.uint64)]), np.concatenate([self.common_of, rest.column(1).to_numpy()])

    listed = property(lambda self: self.words[0])
    of = property(lambda self: self.words[1])


def fit(training: DataFrame) -> Model:
    listed, n, counts = frequent(training)
    core = min(CORE, len(listed))
    distinct, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    first = buckets(n, core)
    loose = 2 * (tokens - int(n.sum()))  # a token of these takes twice the bytes
    near = neighbours(training, listed, core, first, 1 + loose // bucket_size(loose))
    found = core_bigrams(near, core)
    fold = np.concatenate([np.arange(core), [core, core, core + 1]])
    pairs = np.zeros((core + 2, core + 2), np.int64)
    np.add.at(pairs, np.ix_(fold, fold), found)
    seeds = exchange(pairs, CLASSES, alone=2)
    one = np.zeros((len(pairs), CLASSES))
    one[np.arange(len(pairs)), seeds] = 1
    table = one.T @ pairs @ one
    apart = F.col("bucket") >= len(first) - 1
    words = near.filter(apart & (F.length("word") > 0))
    many = words.limit(1).count()
    near = near.filter((F.col("bucket") >= 0) & ~apart)

    of = np.concatenate([seeds[:core], np.full(len(listed) - core, NONE), [NONE, END]])
    if many:
        words = first_classes(words, of, table)
    of = moved_listed(near, of, table, core, first)
    of[-2] = RARE
    fixed = np.zeros((core + CLASSES, core + CLASSES), np.int64)
    some, at = np.delete(np.arange(core + 3), core), np.concatenate([np.arange(core), [core + RARE, core + END]])
    fixed[np.ix_(at, at)] = found[np.ix_(some, some)]

    kept = None
    for again in range(ROUNDS + 1):
        unit_of = np.concatenate([np.arange(core), core + of[core:]])
        pairs = fixed + listed_bigrams(near, of, core, first)
        if many:
            words = told(words, len(listed))
            pairs += open_bigrams(words, unit_of, core)
        units = exchange(pairs, CLASSES, alone=2, given=np.concatenate([of[:core], np.arange(CLASSES)]))
        of[:core] = units[:core]
        one = np.zeros((len(pairs), CLASSES))
        one[np.arange(len(pairs)), units] = 1
        table = (one.T @ pairs @ one).round()
        value = likelihood(table)
        if again > 1 and value <= kept[0]:  # the seeds leave words without a neighbour in the core unplaced
            break
        kept = value, of.copy(), table, words
        if again < ROUNDS:
            cells = near
            if many:
                cells = _by_bucket(listed_cells(near, of, first).unionByName(open_cells(words, len(listed), core, first)))
                words = moved_unlisted(words, of, table)
            of = moved_listed(cells, of, table, core, first)

    _, of, table, words = kept
    once = counts.filter("n = 1").select("word", "n", F.lit(RARE).alias("class"))
    rest = once.unionByName(words.select("word", "n", "class")) if many else once
    rare_words = rest.filter(F.col("class") == RARE).count() + int((of[:-2] == RARE).sum())
    return Model(listed, n, of[:-2], table, rest, distinct, rare_words)


def _located(rows: DataFrame, model: Model) -> DataFrame:
    """What a text's listed words give, and its other words with the place of each and the classes beside it; steps from and to these are left to :func:`_asked`."""
    shared = rows.sparkSession.sparkContext.broadcast((model.common, model.counts, model.word_log, model.common_of.astype(np.int16), model.step, model.ends))

    def run(batches):
        listed, counts, word_log, of, step, ends = shared.value
        lookup, base_log, class_of = Lookup(listed), np.append(np.log10(counts + 1.0), 0.0), np.concatenate([of, [OPEN, END]]).astype(np.int16)
        word_log = np.append(word_log, 0.0)
        step = np.pad(step, ((0, OPEN + 1 - len(step)),) * 2)  # no step from or to OPEN
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                t = Tokens(lookup, class_of, part.column(3))
                bounds = t.words.bounds
                sums = lambda x, at: np.diff(np.concatenate([[0.0], np.cumsum(x)])[at])
                base = sums(base_log[t.at], bounds) + np.log10(ends + 1.0)  # position -1: the last
                own = sums(word_log[t.at], bounds) + sums(step[t.before, t.unit], np.append(t.starts, len(t.unit)))
                known = sums(t.at >= 0, bounds).astype(np.int64) + (ends > 0)
                rare = np.flatnonzero(t.at < 0)
                place = np.flatnonzero(t.is_word)[rare]
                doc = t.words.documents()[rare]
                near = (place - t.starts[doc]) << 16 | t.before[place] << 8 | t.unit[place + 1]
                h = t.hashes[rare]
                order = np.lexsort((h, doc))
                h, doc, near = h[order], doc[order], near[order]
                head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
                near = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer((np.append(head, len(h)) * 8).astype(np.int32)), pa.py_buffer(near.astype(np.int64))])
                entries = pa.StructArray.from_arrays([pa.array(h[head].view(np.int64)), near], ["word", "near"])
                offsets = np.searchsorted(doc[head], np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array((t.words.counts + 1).astype(np.int64)), pa.array(known), pa.array(base), pa.array(own), pa.ListArray.from_arrays(pa.array(offsets), entries)],
                    ["id", "row_key", "trained", "n_tokens", "known", "base", "own", "rare"],
                )

    return rows.mapInArrow(run, "id long, row_key long, trained boolean, n_tokens long, known long, base double, own double, rare array<struct<word: long, near: binary>>")


def _asked(marked: DataFrame, model: Model) -> DataFrame:
    """What a text's unlisted words give: uid, rare_known, rare_base, rare_score."""
    asked = marked.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.near").join(model.rest, "word", "left")
    texts = asked.groupBy("uid").agg(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(RARE)).alias("class"), "near")).alias("words"))
    shared = marked.sparkSession.sparkContext.broadcast(model.step)
    rare_log, unseen_log, tokens = model.rare_log, model.unseen_log, model.tokens

    def run(batches):
        step = shared.value
        for batch in batches:
            words = batch.column(1)
            text = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
            flat = words.flatten()
            n, of = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            entry, near = _unpacked(flat.field(2), np.int64)
            seen = np.where(of == RARE, np.log10(np.maximum(n - DISCOUNT, 1 - DISCOUNT)) - rare_log, np.log10(np.maximum(n, 1)) - np.log10(np.maximum(tokens[of], 1)))
            score = np.where(n > 0, seen, unseen_log)[entry]
            order = np.lexsort((near >> 16, text[entry]))
            entry, near, score = entry[order], near[order], score[order]
            own, before, after = of[entry].astype(np.int64), near >> 8 & 255, near & 255
            before = np.where(before == OPEN, np.concatenate([[END], own[:-1]])[: len(own)], before)  # the word before is then the entry before
            score = score + step[before, own] + np.where(after == OPEN, 0.0, step[own, np.where(after == OPEN, END, after)])
            total = lambda x: np.bincount(text[entry], x, len(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total(n[entry] > 0).astype(np.int64)), pa.array(total(np.log10(n[entry] + 1.0))), pa.array(total(score))],
                ["uid", "rare_known", "rare_base", "rare_score"],
            )

    return texts.mapInArrow(run, "uid long, rare_known long, rare_base double, rare_score double")


def scored(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, row_key, trained, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), row_key(doc_id, text).alias("row_key"), train.alias("trained"), F.col(text).cast("string").alias("text"))
    model = fit(rows.filter("trained").select("row_key", "text"))
    marked = checkpoint(_located(rows, model).withColumn("uid", F.monotonically_increasing_id()))
    zero = F.lit(0)
    return marked.drop("rare").join(_asked(marked, model), "uid", "left").select(
        "id",
        "row_key",
        "trained",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", zero)).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero) - F.col("n_tokens") * float(np.log10(model.train_tokens + model.distinct + 1))).alias("base_score"),
        (F.col("own") + F.coalesce("rare_score", zero)).alias("score"),
    )
