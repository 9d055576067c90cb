"""Quality rules judged by an isolation forest on rule statistics.

One pass over whole texts gives each document its rule statistics. Two plain rules reject outright (under 50 words; over half of all
words in repeated three-word windows). The others are judged together: an isolation forest, grown over random splits of random
statistics, measures how few splits set a document apart. Which statistics take part the labelled rows say: those whose distributions over good and
bad rows are ``APART`` or more apart (Kolmogorov's distance over a bounded sample of about ``FIT_ROWS`` labelled rows, by row hash; none, then all),
since a statistic that bad rows share with good ones only sets good rows apart. The forest is fitted on a bounded sample of documents that the plain rules
pass (about ``FIT_ROWS``, by row hash); the threshold on its score comes from all labelled rows: of those on a grid of
1000 steps the one with the best accuracy over labelled bad and good rows, among thresholds that keep ``KEEP_GOOD`` of the good ones.
Everything else covers all documents.

Defined results: a null or empty text has no words and fails the plain rules; without labelled rows of both kinds, or with no
document to fit on, the method rejects nothing; repeated labels count as often as they occur, null labels don't; repeated rows have
rows of their own; an empty table gives an empty one. Ids are numbers or
text that reads as such; another id is an error (ANSI cast).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import LEAN_BYTES, checkpoint, map_text, row_key, text_slices
from ._words import Words, grams, mix

# Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED, OF = 50, 50, 100

FIT_ROWS, TREES, ROWS_A_TREE, SEED = 8192, 200, 256, 11
KEEP_GOOD, APART = 0.995, 0.25
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = ("symbols", "capitals", "exclaimed", "bars", "word_length", "ends", "dup_lines", "repeated")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _ASCII = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123)]))
_CRY, _STOP, _LEAD = _table(b"!?"), _table(b".,;:!?"), np.array([b & 0xC0 != 0x80 for b in range(256)])
_BAR = _table(b"|")


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def repeated_words(words: Words) -> np.ndarray:
    """Per text, the words in three-word windows found twice or more in it."""
    n = len(words)
    covered = np.zeros(n + 2, dtype=bool)
    if n >= 3:
        doc = words.documents()
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        key = mix(grams(words.hashes(), 3)[whole] + doc[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(whole), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[whole[twice] + k] = True
    return _sums(covered[:n], words.bounds)


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The contract's counts and the matrix of rule statistics, a row for each text."""
    words = Words(texts)
    data, at = words.data, words.offsets
    raw = data.tobytes()
    dup, filled = np.zeros(len(texts), dtype=np.int64), np.ones(len(texts), dtype=np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        lines = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        dup[i], filled[i] = len(lines) - len(set(lines)), max(1, len(lines))
    counts = {"n_words": words.counts.astype(np.int64), "word_chars": _sums(words.inside & _LEAD[data], at), "n_symbols": _sums(_SYMBOL[data], at), "n_dup_lines": dup, "n_repeat_words": repeated_words(words)}
    n, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
    stops = np.zeros(len(words), dtype=bool) if not len(words) else _STOP[data[words.ends - 1]]
    columns = [
        counts["n_symbols"] / chars,
        _sums(_UPPER[data], at) / np.maximum(_sums(_ASCII[data], at), 1),
        _sums(_CRY[data], at) / n,
        _sums(_BAR[data], at) / n,
        chars / n,
        _sums(stops, words.bounds) / n,
        dup / filled,
        counts["n_repeat_words"] / n,
    ]
    return counts, np.stack(columns, axis=1)


def plainly_bad(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (OF * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


class IsolationForest:
    """Random trees; a row's score is 2 ** (-mean path / expected path), near 1 for rows set apart by few splits."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = ROWS_A_TREE, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.sample = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.sample)))))
        nodes = 2 ** (self.depth + 1)
        self.column = np.zeros((trees, nodes), dtype=np.int64)
        self.cut = np.full((trees, nodes), np.inf)
        self.path = np.zeros((trees, nodes))
        for t in range(trees):
            self._grow(t, 1, 0, rows[rng.choice(len(rows), self.sample, replace=False)], rng)

    @staticmethod
    def expected(n: int) -> float:
        """The mean path of an unsuccessful search in a binary search tree of n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, rng: np.random.Generator) -> None:
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) < 2 or not len(varied):
            # all rows go left from here on, to a leaf that holds this path
            leaf = node << (self.depth - depth)
            self.path[t, leaf] = depth + self.expected(len(rows))
            return
        c = rng.choice(varied)
        cut = rng.uniform(low[c], high[c])
        self.column[t, node], self.cut[t, node] = c, cut
        left = rows[:, c] <= cut
        if left.all():
            left = rows[:, c] < high[c]
            self.cut[t, node] = np.nextafter(high[c], -np.inf)
        self._grow(t, 2 * node, depth + 1, rows[left], rng)
        self._grow(t, 2 * node + 1, depth + 1, rows[~left], rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for column, cut, path in zip(self.column, self.cut, self.path, strict=True):
            node = np.ones(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + (rows[every, column[node]] > cut[node])
            total += path[node]
        return 2.0 ** (-total / len(self.path) / max(self.expected(self.sample), 1e-9))


class Judge:
    """The fitted forest, the statistics it sees and its threshold; without a forest nothing is judged bad."""

    def __init__(self, forest: IsolationForest | None, columns: np.ndarray, threshold: float):
        self.forest, self.columns, self.threshold = forest, columns, threshold

    def kept(self, rows: np.ndarray) -> np.ndarray:
        return self.forest.score(rows[:, self.columns]) <= self.threshold if self.forest and len(rows) else np.ones(len(rows), dtype=bool)


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Kolmogorov's distance of two samples."""
    at = np.concatenate([a, b])
    return float(np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b)).max())


def telling(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The columns that good and bad rows differ in; all if none is, or if either kind is missing."""
    every = np.arange(len(STATISTICS))
    if not len(good) or not len(bad):
        return every
    found = np.array([k for k in every if distance(good[:, k], bad[:, k]) >= APART], dtype=np.int64)
    return found if len(found) else every


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, row_key, the counts, base_failed, stats) for all rows of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, stats = statistics(batch.column(2))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32)), pa.array(stats.reshape(-1)))
        columns = [batch.column(0), batch.column(1), *[pa.array(counts[c]) for c in COUNTS], pa.array(plainly_bad(counts)), flat]
        return pa.RecordBatch.from_arrays(columns, ["id", "row_key", *COUNTS, "base_failed", "stats"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), row_key(doc_id, text).alias("row_key"), F.col(text).cast("string").alias("text"))
    return map_text(rows, "text", run, "id long, row_key long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, stats array<double>", LEAN_BYTES)


def scored(rows: DataFrame, forest: IsolationForest, columns: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            stats = batch.column(batch.schema.get_field_index("stats"))
            matrix = np.asarray(stats.flatten()).reshape(len(stats), -1) if len(stats) else np.zeros((0, len(STATISTICS)))
            keep = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(forest.score(matrix[:, columns]))], [*names, "score"])

    names = [c for c in rows.columns if c != "stats"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "stats")
    return rows.mapInArrow(run, f"{schema}, score double")


def known(labels: DataFrame, doc_id: str, quality: str) -> DataFrame:
    return labels.filter(F.col(quality).isin(0, 1)).select(F.col(doc_id).cast("long").alias("id"), (F.col(quality) == 1).alias("good"))


def calibrated(judged: DataFrame, known: DataFrame) -> float:
    """The threshold of the best balanced accuracy over all labelled rows that the plain rules pass, keeping ``KEEP_GOOD`` of the good; of equally good ones the smallest."""
    steps = judged.filter("not base_failed").join(known, "id").groupBy(F.ceil(F.col("score") * 1000).cast("int").alias("step")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    rows = sorted(tuple(r) for r in steps.collect())  # at most 1001 of them
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best, threshold, kept_good, kept_bad = -1.0, 1.0, 0, 0
    if not good or not bad:
        return threshold
    for step, g, b in rows:
        kept_good, kept_bad = kept_good + g, kept_bad + b
        value = kept_good / good + 1 - kept_bad / bad
        if kept_good >= KEEP_GOOD * good and value > best:
            best, threshold = value, step / 1000
    return threshold


def _sampled(rows: DataFrame, *columns: str) -> list:
    """About FIT_ROWS rows, by row hash; at most twice as many."""
    share = min(1.0, FIT_ROWS / max(1, rows.count()))
    drawn = rows.filter(F.pmod(F.xxhash64("row_key", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)))
    return drawn.orderBy("row_key").select(*columns).limit(2 * FIT_ROWS).collect()


def fit(rows: DataFrame, labels: DataFrame, label_id: str = "doc_id", quality: str = "quality") -> tuple[Judge, DataFrame | None]:
    passed, told = rows.filter("not base_failed"), known(labels, label_id, quality)
    sample = _sampled(passed, "stats")
    if not sample:
        return Judge(None, np.arange(len(STATISTICS)), 1.0), None
    labelled = _sampled(passed.join(told, "id"), "stats", "good")
    columns = telling(*(np.array([r[0] for r in labelled if r[1] == kind]) for kind in (True, False)))
    forest = IsolationForest(np.array([r[0] for r in sample])[:, columns])
    judged = scored(rows, forest, columns)
    return Judge(forest, columns, calibrated(judged, told)), judged


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: id, row_key, the counts, base_failed, score and kept."""
    rows = checkpoint(measured(docs, doc_id, text))
    found, judged = fit(rows, labels, doc_id, quality)
    if judged is None:
        return rows.select("id", "row_key", *COUNTS, "base_failed", F.lit(0.0).alias("score"), (~F.col("base_failed")).alias("kept"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") <= found.threshold))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """``docs`` without the rows that the rules reject; the second pass judges texts where they lie, so none is shuffled."""
    found, _ = fit(checkpoint(measured(docs, doc_id, text)), labels, doc_id, quality)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text, LEAN_BYTES):
                counts, stats = statistics(part.column(part.schema.get_field_index(text)))
                yield part.filter(pa.array(~plainly_bad(counts) & found.kept(stats)))

    return docs.mapInArrow(run, docs.schema)
