import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridtempo.llm import brown, decontamination, language, quality, queries
from gridtempo.llm._words import NOT_ALNUM, Words, grams, long_grams


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x1c\x85 .漢", max_size=30)), max_size=8), st.integers(0, 3))
def test_words_are_those_of_bytes_split(texts, skip):
    array = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    want = [(t or "").encode().split() for t in array.to_pylist()]
    w = Words(array)
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [v for x in want for v in x]
    assert [bytes(w.data[a:b]) for a, b in zip(w.starts, w.ends, strict=True)] == flat
    h = dict(zip(flat, w.hashes().tolist(), strict=True))
    assert len(set(h.values())) == len(h) and w.hashes().tolist() == [h[v] for v in flat]
    folded = w.hashes(fold=True)
    assert len(set(folded.tolist())) == len({v.lower() for v in flat})
    body, a, b = w.joined(fold=True)
    assert body.tobytes() == b"".join(v.lower() + b" " for v in flat)


def test_grams_depend_on_their_words_only():
    h = np.random.default_rng(0).integers(0, 1 << 63, 50, dtype=np.uint64)
    both = np.concatenate([h, h])
    for f in (grams, long_grams):
        g = f(both, 7)
        assert np.array_equal(g[:44], g[50:94]) and len(set(g.tolist())) == 50


def test_quality_counts_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r.text for r in docs.collect()] + [None, "", "a b a b a b", "x\n x\nx\n\n x\n", "#*$%&|<> #"]
    counts, _ = quality.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        t = t or ""
        words = t.encode().split()
        three = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if three[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(words), sum(len(v.decode()) for v in words), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert tuple(int(counts[c][i]) for c in quality.COUNTS) == want


def test_the_forest_sets_outliers_apart_and_the_threshold_spares_good_rows(spark):
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(size=(2000, 3)), rng.normal(size=(20, 3)) + 8])
    score = quality.IsolationForest(rows).score(rows)
    assert score[2000:].min() > np.quantile(score[:2000], 0.99)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.judge(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id")
    kept = {r.quality: (r.kept, r.failed) for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg(F.col("base_failed").cast("int")).alias("failed")).collect()}
    assert kept[0][0] < 0.15 and kept[1][0] > 0.98 - kept[1][1]


def test_verdicts_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.measured(docs)
    found, judged = quality.fit(rows, labels)
    score = {r.id: r.score for r in judged.collect()}
    failed, stats = ({r.id: r[c] for r in rows.collect()} for c in ("base_failed", "stats"))
    told = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and not failed[r.doc_id]}

    def path(t, row):
        node = 1
        for _ in range(found.forest.depth):
            node = 2 * node + (row[found.columns[found.forest.column[t, node]]] > found.forest.cut[t, node])
        return found.forest.path[t, node]

    for i in sorted(score)[:25]:
        mean = sum(path(t, stats[i]) for t in range(quality.TREES)) / quality.TREES
        assert score[i] == pytest.approx(2 ** (-mean / found.forest.expected(found.forest.sample)))
    good, bad = ([score[i] for i, q in told.items() if q == k] for k in (1, 0))
    best = max((sum(s <= t / 1000 for s in good) / len(good) + sum(s > t / 1000 for s in bad) / len(bad), -t) for t in range(1001) if sum(s <= t / 1000 for s in good) >= quality.KEEP_GOOD * len(good))
    assert found.threshold == -best[1] / 1000
    want = {i: not failed[i] and score[i] <= found.threshold for i in score}
    assert {r.id: r.kept for r in quality.judge(docs, labels).collect()} == want
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {i for i, k in want.items() if k}


def test_labels_say_which_statistics_take_part():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(size=(400, len(quality.STATISTICS))), rng.normal(size=(80, len(quality.STATISTICS)))
    bad[:, [1, 6]] += 2
    assert quality.telling(good, bad).tolist() == [1, 6]
    assert len(quality.telling(good, bad[:0])) == len(quality.STATISTICS) and len(quality.telling(good, good)) == len(quality.STATISTICS)


def test_a_forest_without_spread_or_rows():
    same = quality.IsolationForest(np.ones((50, 2)))
    assert len(set(same.score(np.ones((3, 2))).tolist())) == 1
    assert quality.Judge(None, np.zeros(1, int), 1.0).kept(np.zeros((2, 1))).all()


def test_language_is_right_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op7_word_backoff(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.97 and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)


def test_language_backs_off_from_words_to_shorter_grams(spark):
    rows = [(i, "the thing that was there", "en") for i in range(5)] + [(9 + i, "der die das ding war da", "de") for i in range(5)]
    rows += [(30, "thingthat", None), (31, "dingda", None), (32, "12 !?", None), (33, None, None), (34, "漢", None), (35, "\u0301 ́", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.id: (r.lang_pred, r.score) for r in language.predict(df, F.lit(True)).collect()}
    assert got[30][0] == "en" and got[31][0] == "de" and got[32] == ("und", 0.0) and got[33] == got[35] == ("und", 0.0)
    assert got[34][0] in ("de", "en")


def test_predictions_equal_brute_force(spark):
    rng = random.Random(8)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "aegxy"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 7)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randrange(1, 9))) + rng.choice(["", "!", " 12"]), lang) for i in range(60) for lang in [rng.choice(sorted(letters))]]
    asked = [(100 + i, " ".join(word(rng.choice(sorted(letters))) for _ in range(6)).upper(), None) for i in range(30)] + [(200, "zzz qq", None), (201, "3", None)]

    words_of = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    parts = lambda w, k: [w] if not k else [x[j : j + k] for x in [f"^{w}^" if k > 1 else w] for j in range(len(x) - k + 1)]
    n = {k: {lang: Counter(g for _, t, own in rows if own == lang for w in words_of(t) for g in parts(w, k)) for lang in letters} for k in range(language.LONGEST + 1)}

    def scores(k, g):
        if not any(n[k][lang][g] for lang in letters):
            return None
        return [max(math.log10(n[k][lang][g] / sum(n[k][lang].values())), -language.PENALTY) if n[k][lang][g] else -language.PENALTY for lang in sorted(letters)]

    def of_word(w):
        for k in (0, *range(language.LONGEST, 0, -1)):
            known = [s for g in parts(w, k) for s in [scores(k, g)] if s]
            if known:
                return np.mean(known, axis=0)
        return None

    want = {}
    for i, t, _ in rows + asked:
        known = [s for w in words_of(t) for s in [of_word(w)] if s is not None]
        mean = np.mean(known, axis=0) if known else np.zeros(3)
        share = np.exp((mean - mean.max()) * math.log(10) * min(max(len(known), 1), language.TEMPER)).sum()
        want[i] = (sorted(letters)[int(mean.argmax())], 1 / share) if words_of(t) else ("und", 0.0)
    got = {r.id: (r.lang_pred, r.score) for r in language.predict(spark.createDataFrame(rows + asked, "doc_id long, text string, lang string"), F.lit(True)).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], rel=1e-4) for i in want)


def test_a_rare_language_keeps_its_rows(spark):
    rows = [(i, f"common words of the large one {i}", "en") for i in range(400)] + [(1000 + i, f"seltene worte der kleinen {i}", "de") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.id: r.lang_pred for r in language.predict(df, F.lit(True), fit_rows=20).collect()}
    assert all(got[1000 + i] == "de" for i in range(3)) and got[5] == "en"


def test_base_scores_equal_brute_force_and_classes_beat_them(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    tokens = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(t for i, x in tokens.items() if not held[i] for t in x)
    n, v = sum(c.values()), len(c)
    found = queries.op8_brown_classes(spark, "/root/testdata/sf0.01").collect()
    for r in found:
        x = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(x), sum(c[t] > 0 for t in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in x), rel=1e-9)
    assert sum(r.score for r in found if r.held_out) > 0.9 * sum(r.base_score for r in found if r.held_out)


@pytest.fixture
def small_lists(monkeypatch):
    """So few words in the core and the list that a small corpus has words of all kinds."""
    monkeypatch.setattr(brown, "LISTED", 12)
    monkeypatch.setattr(brown, "CORE", 6)
    monkeypatch.setattr(brown, "CLASSES", 5)


def class_corpus():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(("the", "a")) + " " + rng.choice(("cat", "dog", "bird", "cow")) + " " + rng.choice(("runs", "sleeps", "sings")) + rng.choice(("", " " + rng.choice("uvwxyz"))) for _ in range(6))) for i in range(20)]
    return rows + [(50, None), (51, "")]


def test_scores_equal_brute_force(spark, small_lists):
    rows = class_corpus()
    asked = [(100, "the cat runs"), (101, "Zebra a unseen cat u"), (102, ""), (103, None)]
    df = spark.createDataFrame(rows + asked, "doc_id long, text string")
    got = {r.id: r.score for r in brown.scored(df, F.col("doc_id") < 100).collect()}
    model = brown.fit(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id AS row_key", "text"))
    hash_of = lambda w: int(Words(pa.array([w])).hashes(fold=True)[0])
    classes = dict(zip(model.listed.tolist(), model.of.tolist(), strict=True))
    class_of = lambda w: brown.END if w is None else classes.get(hash_of(w), brown.RARE)
    tokens = lambda t: (t or "").lower().split() + [None]
    count, table, size = Counter(), Counter(), Counter()
    for _, t in rows:
        before = None
        for w in tokens(t):
            count[w] += 1
            table[class_of(before), class_of(w)] += 1
            size[class_of(w)] += 1
            before = w
    n, d, k = sum(size.values()), brown.DISCOUNT, brown.CLASSES
    rare = [w for w in count if class_of(w) == brown.RARE]

    def step(a, b):
        left, kinds = sum(table[a, x] for x in range(k)), sum(table[a, x] > 0 for x in range(k))
        return (max(table[a, b] - d, 0) + (d * kinds + 1) * (size[b] + 1) / (n + k)) / (left + 1)

    def emit(w):
        if w is None:
            return 1.0
        c = class_of(w)
        if c != brown.RARE:
            return count[w] / size[c]
        return ((count[w] - d) if count[w] else d * len(rare) + 1) / (size[c] + 1)

    for i, t in rows + asked:
        want, before = 0.0, None
        for w in tokens(t):
            want += math.log10(step(class_of(before), class_of(w)) * emit(w))
            before = w
        assert got[i] == pytest.approx(want, rel=1e-9)
    for a in range(k):  # after any class the known words, the unseen ones together and the end have probability one
        known = sum(step(a, class_of(w)) * emit(w) for w in count)
        unused = sum(step(a, c) for c in range(k) if not size[c])
        assert known + step(a, brown.RARE) * emit("never seen") + unused == pytest.approx(1, abs=1e-9) or not size[brown.RARE]
    assert len({class_of(w) for w in ("cat", "dog", "bird")}) == 1 and class_of("cat") != class_of("the")


def likelihood(pairs, of, classes):
    one = np.zeros((len(pairs), classes))
    one[np.arange(len(pairs)), of] = 1
    table = one.T @ pairs @ one
    g = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return g(table) - g(table.sum(0)) - g(table.sum(1))


def test_exchange_finds_planted_classes():
    rng = random.Random(0)
    pairs, now = np.zeros((31, 31)), 30
    for _ in range(30000):
        group = now // 10 if now < 30 and rng.random() < 0.9 else rng.randrange(3)
        new = 10 * group + rng.randrange(10) if rng.random() > 0.02 else 30
        pairs[now, new] += 1
        now = new
    of = brown.exchange(pairs, classes=4)
    assert of[30] == 0 and all(len(set(of[10 * k : 10 * k + 10])) == 1 for k in range(3)) and len(set(of)) == 4


def test_no_single_move_raises_the_likelihood():
    pairs = np.random.default_rng(3).poisson(np.random.default_rng(4).gamma(0.3, 6, (25, 25))).astype(float)
    of = brown.exchange(pairs, classes=5, sweeps=50)
    best = likelihood(pairs, of, 5)
    for u in range(24):
        for c in range(1, 5):
            moved = of.copy()
            moved[u] = c
            assert likelihood(pairs, moved, 5) <= best + 1e-6


def overlap_by_brute_force(doc, item):
    words = lambda t: [bytes(w.data[a:b]).lower() for w in [Words(pa.array([t]), NOT_ALNUM)] for a, b in zip(w.starts, w.ends, strict=True)]
    d, i = words(doc), words(item)
    width = min(len(i), decontamination.WINDOW)
    if not width:
        return False
    return any(sum(x == y for x, y in zip(d[p : p + width], i[q : q + width], strict=True)) >= decontamination.AGREE * width for p in range(len(d) - width + 1) for q in range(len(i) - width + 1))


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([40, 30, 20, 15, 12, 9, 5, 3, 4, 1, 2, 0])]
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(10)]
    for i, (_, text) in enumerate(items):
        words = text.split()
        for j, broken in enumerate((0, 1, 2, 3)):
            some = list(words)
            for at in rng.sample(range(len(some)), max(0, min(broken, len(some) - 1))):
                some[at] = word()
            docs.append((100 + 10 * i + j, " ".join(word() for _ in range(9)) + " " + ", ".join(some).upper() + ". " + word()))
    docs.append((900, " ".join(items[0][1].split()[5:20])))
    got = {(r.id, r.item_id) for r in decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i) for d, t in docs for i, x in items if overlap_by_brute_force(t, x)}
    assert got == want
    assert (900, 0) in got and {7, 8, 9, 10} <= {i for _, i in got}


def test_short_items_are_reported_but_cost_no_document(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "and others"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words"), (2, "Some, WORDS"), (3, "words some")], "item_id long, text string")
    assert {(r.id, r.item_id, r.matched, r.width) for r in decontamination.overlaps(docs, items).collect()} == {(1, 1, 1, 1), (1, 2, 2, 2)}
    assert decontamination.decontaminate(docs, items).count() == 3 and decontamination.decontaminate(docs, items, least=1).count() == 2


def test_the_filter_grows_with_the_table(spark):
    hashes = spark.range(100_000).selectExpr("xxhash64(id) AS hash")
    found = decontamination.hash_filter(hashes)
    assert found.bits == 21
    inside = hashes.toArrow().column(0).to_numpy().view(np.uint64)
    assert len(found(inside)) == len(inside)
    others = spark.range(100_000).selectExpr("xxhash64(id + 1000000) AS hash").toArrow().column(0).to_numpy().view(np.uint64)
    assert len(found(others)) < 0.05 * len(others)
