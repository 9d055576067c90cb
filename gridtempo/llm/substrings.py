"""Substring dedup over prefix-partitioned suffix trees.

A word goes if a window of ``WINDOW`` consecutive words that covers it starts anywhere else as well.

1.  Equal texts are one text with a count; a text of ``WINDOW`` words or more that occurs twice goes as a whole, and one of its copies stands
    for all in what follows.
2.  Suffixes to compare are those at anchors: the anchor of a window is the leftmost of its 8-word grams with the smallest hash, so that equal
    windows have it at equal offsets. A suffix stands for the run of windows around its anchor, as far as they have the same one.
3.  Suffixes are split by variable-length prefixes: 8 words at first, and where a prefix has more than ``group_rows`` places, its suffixes are
    lengthened to 22 and at last ``WINDOW`` words. A prefix longer by k words is shared by k windows fewer, so a run falls into as many
    suffixes (those of the windows that begin earlier start earlier). Prefixes that occur once can't repeat and drop out at each length.
4.  Each group that fits is one subtree: the suffixes of its windows in the order of leaves, with the length that neighbours have in common, which
    is the depth of the internal node above them. Nodes of ``WINDOW`` words or more are the repeats, each leaf's deepest one its longest.
5.  A prefix of ``WINDOW`` words is a deep node as soon as it has two leaves; there is nothing to build below it, and its leaves may be a third of all rows.
    They are dealt out by prefix (128 hash bits) and salt, and compared with their neighbours in a stream. A leaf that is alone under its salt meets one
    witness of each other salt under its prefix. No list of a group is held and none joined back.

A window that repeats within its text is marked at once and only its first occurrence goes on. Windows are judged on the input.

Defined results: a null text has no words and the digest of the empty string; repeated rows are repeats of one another; null ids
have rows like others, ids may be of any type; texts of any length are processed whole; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import checkpoint, map_text, partitions
from ._words import Words, grams, long_grams, mix

WINDOW, GRAM = 35, 8
#: Windows that one suffix stands for, by length of prefix: 8, 22 and 35 words.
RUNS = (28, 14, 1)
GROUP_ROWS = 1000
_SALT = np.uint64(0x9E3779B97F4A7C15)


def minimizers(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start (also beyond text ends, the caller's to mask) the position of its minimizer; the hashes of all grams."""
    value = grams(hashes, gram)
    span = window - gram + 1
    best, at, width = value, np.arange(len(value)), 1

    def joined(shift: int):
        a, b = best[: len(best) - shift], best[shift:]
        later = b < a
        return np.where(later, b, a), np.where(later, at[shift:], at[: len(at) - shift])

    while 2 * width <= span and len(best) > width:
        best, at = joined(width)
        width *= 2
    if len(hashes) < window:
        return np.zeros(0, np.int64), value
    if span > width:
        best, at = joined(span - width)
    return at, value


class Windows:
    """All windows that lie in one text: start (in the batch's words), document, and position of the anchor."""

    def __init__(self, texts: pa.Array, window: int = WINDOW, gram: int = GRAM):
        self.words = Words(texts)
        self.hashes = self.words.hashes()
        at, self.value = minimizers(self.hashes, window, gram)
        counts = np.maximum(self.words.counts - window + 1, 0)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + self.words.bounds[:-1][self.doc]
        self.anchor = at[self.start]

    def prefixes(self, run: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """For each window the start and the hash of the prefix that it shares with the others of its run."""
        part = (self.anchor - self.start) // run
        core = self.anchor - part * run
        length = window + 1 - run
        value = self.value if length == GRAM else long_grams(self.hashes, length)
        return core, (value[core] if len(core) else np.zeros(0, np.uint64)) + part.astype(np.uint64)


def _heads(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches begin and how long they are."""
    head = np.flatnonzero(breaks)
    return head, np.diff(np.append(head, len(breaks)))


def _changes(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=bool)
    if len(out):
        out[0] = True
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def _listed(key: np.ndarray, doc: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Is each key in its document's list?"""
    flat = np.asarray(keys.flatten(), dtype=np.int64).view(np.uint64)
    owner = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
    listed = np.sort(mix(flat ^ mix(owner.astype(np.uint64) + _SALT)))
    asked = mix(key ^ mix(doc.astype(np.uint64) + _SALT))
    if not len(listed):
        return np.zeros(len(asked), dtype=bool)
    return listed[np.minimum(np.searchsorted(listed, asked), len(listed) - 1)] == asked


def prefix_rows(texts: DataFrame, run: int, parent: int | None = None) -> DataFrame:
    """Rows (key, row_key, times): the distinct prefixes of each text, of those alone that lengthen one in the text's ``keys`` where a parent is given."""

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Windows(batch.column(1))
        core, key = w.prefixes(run)
        doc = w.doc
        if parent is not None:
            some = _listed(w.prefixes(parent)[1], doc, batch.column(2))
            core, key, doc = core[some], key[some], doc[some]
        new = _changes(core, doc)
        doc, key = doc[new], key[new]
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        head, times = _heads(_changes(doc, key))
        return pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), batch.column(0).take(pa.array(doc[head])), pa.array(times.astype(np.int32))], ["key", "row_key", "times"])

    columns = ["row_key", "text"] + (["keys"] if parent is not None else [])
    return map_text(texts.select(*columns), "text", solve, "key long, row_key binary, times int")


def _first_in_text(windows: Windows, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over the chosen windows: is it the first of its kind in its text; does it occur there again."""
    whole = long_grams(windows.hashes, WINDOW)[windows.start[chosen]]
    mark = mix(whole ^ mix(windows.doc[chosen].astype(np.uint64) + _SALT))
    order = np.argsort(mark, kind="stable")
    same = mark[order[1:]] == mark[order[:-1]]
    again, first = np.zeros(len(mark), dtype=bool), np.ones(len(mark), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    first[order[1:][same]] = False
    return first, again


def suffix_rows(texts: DataFrame, run: int) -> DataFrame:
    """From (row_key, text, keys) rows (key, row_key, start, windows, body).

    With a body: consecutive windows that share a prefix of the list, their words each with a blank after it. Without: windows already known to repeat.
    """

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = Windows(batch.column(1))
        core, key = w.prefixes(run)
        chosen = np.flatnonzero(_listed(key, w.doc, batch.column(2)))
        if not len(chosen):
            return None
        first, again = _first_in_text(w, chosen)
        keys, docs, starts, counts, bodies = [], [], [], [], []
        body, begin, end = w.words.joined()
        text = body.tobytes()
        for some, with_body in ((chosen[first], True), (chosen[again], False)):
            if not len(some):
                continue
            at, doc = w.start[some], w.doc[some]
            cut = _changes(at - np.arange(len(at)), doc)
            if with_body:
                cut |= _changes(core[some])
            head, size = _heads(cut)
            docs.append(doc[head])
            keys.append(key[some][head] if with_body else mix(at[head].astype(np.uint64)))
            starts.append(at[head] - w.words.bounds[doc[head]])
            counts.append(size)
            last = at[head] + size + WINDOW - 2
            bodies.extend(text[a : b + 1] for a, b in zip(begin[at[head]].tolist(), end[last].tolist(), strict=True)) if with_body else bodies.extend([None] * len(head))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(counts).astype(np.int32)), pa.array(bodies, pa.binary())], ["key", "row_key", "start", "windows", "body"])

    return map_text(texts.select("row_key", "text", "keys"), "text", solve, "key long, row_key binary, start int, windows int, body binary")


def _common(a: bytes, b: bytes) -> int:
    """The bytes that two strings have in common from their start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def maximal_repeats(bodies: list[bytes], counts: list[int], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """One subtree over distinct bodies: for each body the word ranges (from, to) below internal nodes of ``window`` words or more.

    Leaves are the suffixes at the bodies' windows, whole to the body's end; sorted, two neighbours' common words are the depth of the lowest node
    that has both. Ranges that an earlier leaf's covers are left out.
    """
    leaves = []
    for i, (body, count) in enumerate(zip(bodies, counts, strict=True)):
        edge, at = [0], -1
        for _ in range(count + window - 1):
            at = body.index(b" ", at + 1)
            edge.append(at + 1)
        leaves += [(body[edge[j] :], edge[j + window] - edge[j], i, j) for j in range(count)]
    leaves.sort()
    deep: list[dict[int, int]] = [{} for _ in bodies]
    for (a, first, i, j), (b, _, k, m) in zip(leaves, leaves[1:], strict=False):
        if a[:first] == b[:first]:
            depth = a.count(b" ", 0, _common(a, b))
            deep[i][j] = max(depth, deep[i].get(j, 0))
            deep[k][m] = max(depth, deep[k].get(m, 0))
    found = []
    for own in deep:
        ranges, reach = [], -1
        for j in sorted(own):
            if j + own[j] > reach:
                reach = j + own[j]
                ranges.append((j, reach))
        found.append(ranges)
    return found


def subtrees(suffixes: DataFrame, n: int) -> DataFrame:
    """Rows (row_key, start, end) of word ranges that repeat, from rows of whole groups sorted by prefix."""

    def solved(table: pa.Table) -> pa.RecordBatch:
        key, start, count = (table.column(c).to_numpy() for c in ("key", "start", "windows"))
        body = table.column("body").to_pylist()
        alone = np.array([b is None for b in body], dtype=bool)
        at = [np.flatnonzero(alone)]
        lo, hi = [start[alone]], [start[alone] + count[alone] + WINDOW - 1]
        here = np.flatnonzero(~alone)
        head, size = _heads(_changes(key[here]))
        rows, begins, ends = [], [], []
        for a, m in zip(head[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            equal: dict[bytes, list[int]] = {}
            for p in here[a : a + m].tolist():
                equal.setdefault(body[p], []).append(p)
            several = [p for same in equal.values() if len(same) > 1 for p in same]
            rows += several
            begins += start[several].tolist()
            ends += (start[several] + count[several] + WINDOW - 1).tolist()
            if len(equal) > 1:
                for same, ranges in zip(equal.values(), maximal_repeats(list(equal), [int(count[same[0]]) for same in equal.values()]), strict=True):
                    if len(same) == 1:
                        for j, k in ranges:
                            rows.append(same[0])
                            begins.append(start[same[0]] + j)
                            ends.append(start[same[0]] + k)
        at.append(np.array(rows, dtype=np.int64))
        lo.append(np.array(begins, dtype=np.int32))
        hi.append(np.array(ends, dtype=np.int32))
        owners = table.column("row_key").take(pa.array(np.concatenate(at)))
        return pa.RecordBatch.from_arrays([owners.combine_chunks() if isinstance(owners, pa.ChunkedArray) else owners, pa.array(np.concatenate(lo), pa.int32()), pa.array(np.concatenate(hi), pa.int32())], ["row_key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = held.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield solved(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solved(held)

    return suffixes.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "row_key binary, start int, end int")


def whole_windows(texts: DataFrame, parent: int) -> DataFrame:
    """From (row_key, text, keys) rows (a, b, row_key, start, known): the windows that lengthen the listed prefixes, the first of each kind in a text, under 128 hash bits; and those known to repeat there."""

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = Windows(batch.column(1))
        chosen = np.flatnonzero(_listed(w.prefixes(parent)[1], w.doc, batch.column(2)))
        if not len(chosen):
            return None
        first, again = _first_in_text(w, chosen)
        some = np.concatenate([chosen[first], chosen[again]])
        at, doc = w.start[some], w.doc[some]
        a, b = long_grams(w.hashes, WINDOW)[at], grams(mix(w.hashes + _SALT), WINDOW)[at]
        known = np.arange(len(some)) >= int(first.sum())
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column(0).take(pa.array(doc)), pa.array((at - w.words.bounds[doc]).astype(np.int32)), pa.array(known)], ["a", "b", "row_key", "start", "known"])

    return map_text(texts.select("row_key", "text", "keys"), "text", solve, "a long, b long, row_key binary, start int, known boolean")


def neighbours(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows`` with ``twice``, has another row the same keys, and ``first``, is it the first of such rows; a stream over sorted rows that holds one row back."""
    names = rows.columns
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_key = None, None  # the last row, if nothing is known yet that equals it; the last keys
        for batch in batches:
            if not batch.num_rows:
                continue
            before = None if held is not None else open_key
            table = pa.Table.from_batches([batch] if held is None else [held, batch.cast(held.schema)]).combine_chunks()
            columns = [table.column(k).to_numpy() for k in at]
            new = _changes(*columns)
            new[0] = before is None or any(c[0] != k for c, k in zip(columns, before, strict=True))
            follows = np.append(~new[1:], False)
            twice = ~new | follows
            open_key = [c[-1] for c in columns]
            held = None if twice[-1] else table.slice(len(table) - 1).to_batches()[0]
            done = len(table) - (held is not None)
            if done:
                part = table.slice(0, done).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(twice[:done]), pa.array((new & follows)[:done])], [*names, "twice", "first"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([False]), pa.array([False])], [*names, "twice", "first"])

    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, f"{schema}, twice boolean, first boolean")


def deep_prefixes(windows: DataFrame, n: int) -> DataFrame:
    """Rows (row_key, start, end) of the whole windows that occur elsewhere too."""
    salted = windows.filter("not known").select("a", "b", F.pmod(F.xxhash64("row_key"), F.lit(n)).alias("salt"), "row_key", "start")
    near = neighbours(salted, n, "a", "b", "salt")
    # a lone leaf, and one witness of each salt with several
    far = neighbours(near.filter("not twice or first").select("a", "b", "row_key", "start", F.col("twice").alias("marked")), n, "a", "b")
    deep = near.filter("twice").select("row_key", "start").unionByName(far.filter("twice and not marked").select("row_key", "start")).unionByName(windows.filter("known").select("row_key", "start"))
    return deep.select("row_key", "start", (F.col("start") + WINDOW).alias("end"))


def _shared_prefixes(rows: DataFrame, group_rows: int) -> DataFrame:
    """Rows (row_key, large, keys) of the prefixes that occur twice; large: over ``group_rows`` times.

    The checkpoint parts the join from its aggregate: a prefix may be in a third of all texts, and both sides are plain exchanges, which adaptive execution splits.
    """
    shared = checkpoint(rows.groupBy("key").agg(F.sum("times").alias("times")).filter("times > 1").select("key", (F.col("times") > group_rows).alias("large")))
    return rows.select("key", "row_key").join(shared, "key").groupBy("row_key", "large").agg(F.collect_set("key").alias("keys"))


def repeats(rows: DataFrame, texts: DataFrame, n: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (row_key, start, end): ranges of words under windows that occur twice in ``texts`` (row_key, text), the distinct ones of ``rows``.

    The first prefixes are counted where the rows lie, before any shuffle of texts: copies count there, which only keeps more prefixes in play.
    """

    def below(listed: DataFrame) -> DataFrame:
        return texts.join(listed, "row_key").select("row_key", "text", "keys")

    whole, part, _ = RUNS
    listed = checkpoint(_shared_prefixes(prefix_rows(rows, whole), group_rows))
    found = subtrees(suffix_rows(below(listed.filter("not large")), whole), n)
    large = listed.filter("large")
    if large.isEmpty():
        return found
    longer = _shared_prefixes(prefix_rows(below(large), part, whole), group_rows)
    found = found.unionByName(subtrees(suffix_rows(below(longer.filter("not large")), part), n))
    return found.unionByName(deep_prefixes(whole_windows(below(longer.filter("large")), part), n))


def _cleaned(texts: DataFrame, ranges: DataFrame, out: str) -> DataFrame:
    """Rows (row_key, n_words, n_removed, out) of ``texts`` (row_key, text, copies): out is ``kept_text`` or ``kept_sha256``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1))
        starts, ends = (batch.column(k).fill_null(pa.scalar([], batch.column(k).type)) if batch.column(k).null_count else batch.column(k) for k in (3, 4))
        doc = np.repeat(np.arange(len(starts)), np.diff(starts.offsets.to_numpy()))
        step = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(step, words.bounds[doc] + np.asarray(starts.flatten(), dtype=np.int64), 1)
        np.add.at(step, words.bounds[doc] + np.asarray(ends.flatten(), dtype=np.int64), -1)
        copied = (batch.column(2).to_numpy() > 1) & (words.counts >= WINDOW)
        kept = (np.cumsum(step[:-1]) == 0) & ~np.repeat(copied, words.counts)
        body, begin, end = words.joined()
        width = end - begin + 1
        text = body[np.repeat(kept, width)].tobytes()
        sums = np.concatenate([[0], np.cumsum(width * kept)])[words.bounds]
        gone = np.concatenate([[0], np.cumsum(~kept)])[words.bounds]
        texts = (text[a : max(a, b - 1)] for a, b in zip(sums[:-1].tolist(), sums[1:].tolist(), strict=True))
        made = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()) if out == "kept_sha256" else pa.array([t.decode() for t in texts], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.counts.astype(np.int64)), pa.array(np.diff(gone).astype(np.int64)), made], ["row_key", "n_words", "n_removed", out])

    per_text = ranges.groupBy("row_key").agg(F.collect_list(F.struct("start", "end")).alias("r")).select("row_key", F.col("r.start").alias("starts"), F.col("r.end").alias("ends"))
    rows = texts.join(per_text, "row_key", "left").select("row_key", "text", "copies", "starts", "ends")
    return map_text(rows, "text", run, f"row_key binary, n_words long, n_removed long, {out} string")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "kept_text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row for each row of ``docs``: id, row_key (of the text), n_words, n_removed and the kept words (``kept_text``) or their ``kept_sha256``."""
    n = partitions(docs)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.unhex(F.md5(body)).alias("row_key"), F.col(doc_id).alias("id"), body.alias("text"))
    texts = rows.groupBy("row_key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))  # copies meet combined; the joins below reuse that exchange
    cleaned = _cleaned(texts, repeats(rows, texts, n, group_rows), out)
    return rows.select("row_key", "id").join(cleaned, "row_key").select("id", "row_key", "n_words", "n_removed", out)
