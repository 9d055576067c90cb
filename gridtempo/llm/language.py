"""Language identification by word-first backoff.

Each language has the logarithms of the relative frequencies of its words, and of its character 1- to ``LONGEST``-grams (a word's n-grams reach over one
boundary on either side). A known word is scored by its frequency in each language (a language that lacks it gets a fixed penalty). An
unknown word is scored by its longest n-grams, if any is known, by the mean of the known ones' scores; else by shorter ones, down to
single characters. A text's score in a language is the mean over its words; the best language is predicted. ``score`` is that language's share
of the probabilities, tempered by ``TEMPER`` words of evidence, from 0 to 1.

The classifier is fitted on a bounded sample of the labelled rows (about ``FIT_ROWS``, by row hash, shared equally among the languages, so that a rare one keeps
all its rows) and holds every word and n-gram of that sample; so the bound on rows bounds what is broadcast (some 520,000 entries, 15 MB, for 10,000
rows of the given tables). Words and n-grams are held and found by 64-bit hashes of their characters, whole batches at a time.

Words are runs of letters, lower-cased. Defined results: a text without letters or a null one is ``und`` with score 0; without any labelled row
every text is ``und``; letters the model has never seen score alike in all languages, and the smallest language name wins ties; repeated rows
count as often as they occur; an empty table gives an empty one. Ids are numbers or
text that reads as such; another id is an error (ANSI cast).
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._lookup import Lookup
from ._shared import row_key, text_slices
from ._words import _power, mix

FIT_ROWS, LONGEST = 10_000, 5
PENALTY, TEMPER = 7.0, 8.0
SLICE_BYTES = 1 << 20
UNKNOWN = "und"
_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if a mark, which may belong to one, else 0."""
    if not _letter:
        _letter.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], dtype=np.int8))
    return _letter[0]


class Characters:
    """The lower-cased code points of some texts, one boundary around each; words by start and end."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        body = "\n" + "\n".join(lowered) + "\n"
        self.points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(t) + 1 for t in lowered]) if lowered else np.zeros(0, np.int64)
        kinds = letters()[self.points]
        inside = kinds > 0
        step = np.diff(inside.astype(np.int8))
        self.starts, self.ends = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        self.bounds = np.concatenate([[0], np.searchsorted(self.starts, ends)])
        #: how many letters each text has
        self.letters = np.diff(np.concatenate([[0], np.cumsum(kinds == 2)])[np.concatenate([[0], ends])])
        value = np.where(inside, mix(self.points.astype(np.uint64) + np.uint64(1)), np.uint64(7))
        power, self.inverse = _power(len(value))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[: len(value)])])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``which``, hash) of all n-grams of those words; beyond single characters with their boundaries."""
        pad = int(n > 1)
        first, count = self.starts[which] - pad, self.ends[which] - self.starts[which] + 2 * pad - n + 1
        count = np.maximum(count, 0)
        owner = np.repeat(np.arange(len(which)), count)
        at = first[owner] + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return owner, self.hashes(at, at + n)


def counted(sample: DataFrame) -> DataFrame:
    """Rows (kind, entry, lang, n): kind 0 words, kind k k-grams; summed within each task's slices first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 4 * SLICE_BYTES):
                langs = np.array(part.column(1).to_pylist(), dtype=object)
                for lang in sorted(set(langs)):
                    c = Characters(part.column(0).filter(pa.array(langs == lang)).to_pylist())
                    every = np.arange(len(c.starts))
                    for kind in range(LONGEST + 1):
                        found = c.hashes(c.starts, c.ends) if kind == 0 else c.grams(every, kind)[1]
                        entry, n = np.unique(found, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), kind, np.int32)), pa.array(entry.view(np.int64)), pa.array([lang] * len(entry), pa.string()), pa.array(n.astype(np.int64))], ["kind", "entry", "lang", "n"])

    return sample.select("text", "lang").mapInArrow(run, "kind int, entry long, lang string, n long").groupBy("kind", "entry", "lang").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies of entries: for each kind their hashes, and a row for each with a column for each language and a last one of ones."""

    def __init__(self, langs: list[str], entries: list[np.ndarray], tables: list[np.ndarray]):
        self.langs, self.entries, self.tables = langs, entries, tables
        self.find = [Lookup(e) for e in entries]

    def word_scores(self, c: Characters) -> np.ndarray:
        """A row for each word: its scores and whether it has any."""
        out = np.zeros((len(c.starts), len(self.langs) + 1))
        at = self.find[0](c.hashes(c.starts, c.ends))
        out[at >= 0] = self.tables[0][at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            owner, found = c.grams(left, n)
            row = self.find[n](found)
            owner, row = owner[row >= 0], row[row >= 0]
            if len(row):
                head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                size = np.diff(np.append(head, len(owner)))
                out[left[owner[head]]] = np.add.reduceat(self.tables[n][row], head, axis=0) / size[:, None]
                left = np.delete(left, owner[head])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        c = Characters(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums = np.concatenate([np.zeros((1, len(self.langs) + 1)), np.cumsum(self.word_scores(c), axis=0, dtype=np.float64)])
        total = np.diff(sums[c.bounds], axis=0)
        seen = np.maximum(total[:, -1:], 1.0)
        mean = total[:, :-1] / seen
        best = mean.argmax(axis=1)
        share = np.exp((mean - mean.max(axis=1, keepdims=True)) * math.log(10) * np.minimum(seen, TEMPER)).sum(axis=1)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best, c.letters, strict=True)], np.where(c.letters > 0, 1.0 / share, 0.0)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """From rows (text, lang, row_key)."""
    rows_of = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(rows_of)
    if not langs:
        return Model([], [np.zeros(0, np.uint64)] * (LONGEST + 1), [np.zeros((0, 1), np.float32)] * (LONGEST + 1))
    most = F.create_map(*[F.lit(x) for lang in langs for x in (lang, math.ceil(min(1.0, fit_rows / len(langs) / rows_of[lang]) * (1 << 30)))])
    sample = labelled.filter(F.pmod(F.xxhash64("row_key", F.lit("fit")), F.lit(1 << 30)) < F.element_at(most, F.col("lang")))
    by_lang = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    table = counted(sample).groupBy("kind", "entry").agg(*by_lang).toArrow()
    kinds, entries = np.asarray(table.column("kind")), np.asarray(table.column("entry")).view(np.uint64)
    n = np.stack([np.asarray(table.column(f"n{i}")) for i in range(len(langs))], axis=1).astype(np.float64)
    found, tables = [], []
    for kind in range(LONGEST + 1):
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(entries[own], kind="stable")]
        shares = n[own] / np.maximum(n[own].sum(axis=0), 1)
        found.append(entries[own])
        tables.append(np.concatenate([np.maximum(np.log10(np.maximum(shares, 1e-300)), -PENALTY), np.ones((len(own), 1))], axis=1).astype(np.float32))
    return Model(langs, found, tables)


def predict(docs: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **bounds) -> DataFrame:
    """One row for each row of ``docs``: id, row_key, lang_pred, score. ``learn_from``: which rows may be learned from, if labelled."""
    labelled = docs.filter(learn_from & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), row_key(doc_id, text).alias("row_key"))
    model = fit(labelled, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.entries, model.tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Model(*shared.value)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                names, scores = local.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores)], ["id", "row_key", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), row_key(doc_id, text).alias("row_key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, row_key long, lang_pred string, score double")
