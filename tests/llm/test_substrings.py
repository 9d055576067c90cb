import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridtempo.llm import substrings


def brute(rows, w=substrings.WINDOW):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(x[s : s + w]) for _, x in words for s in range(len(x) - w + 1))
    out = []
    for i, x in words:
        gone = set()
        for s in range(len(x) - w + 1):
            if seen[tuple(x[s : s + w])] > 1:
                gone.update(range(s, s + w))
        kept = b" ".join(v for k, v in enumerate(x) if k not in gone)
        out.append((i, len(x), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(df, out="kept_sha256", **how).collect()), key=str)


@pytest.mark.parametrize("limit", [1, 3, 2000])
def test_equals_brute_force(spark, sf_dir, limit):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows, group_rows=limit) == brute(rows)


def test_overlaps_repeats_inside_a_text_and_odd_rows(spark):
    a = [f"a{i}" for i in range(100)]
    rows = [(1, " ".join(a)), (2, "x " + "\n".join(a[10:60]) + " y"), (3, "same " * 90), (4, " ".join(a[:35])), (5, " ".join(a[:34])), (6, None), (7, ""), (8, " ".join(a)), (8, " ".join(a)), (None, "z " * 40)]
    for limit in (1, 2000):
        assert run(spark, rows, group_rows=limit) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=4, max_size=9), min_size=1, max_size=6, unique_by=tuple))
def test_a_subtree_finds_exactly_the_repeated_windows(texts):
    w = 4
    bodies, counts = [b"".join(x + b" " for x in t) for t in texts], [len(t) - w + 1 for t in texts]
    seen = Counter(tuple(t[s : s + w]) for t in texts for s in range(len(t) - w + 1))
    for t, ranges, n in zip(texts, substrings.maximal_repeats(bodies, counts, w), counts, strict=True):
        windows = {s for lo, hi in ranges for s in range(lo, hi - w + 1)}
        assert windows == {s for s in range(n) if seen[tuple(t[s : s + w])] > 1}
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(ranges, ranges[1:], strict=False))


def test_repeats_are_maximal():
    shared = b"".join(b"s%d " % i for i in range(10))
    assert substrings.maximal_repeats([b"x y " + shared, shared + b"z "], [9, 8], 4) == [[(2, 12)], [(0, 10)]]


def test_many_repeated_rows_are_one_text(spark):
    words = " ".join(f"w{i}" for i in range(120))
    got = run(spark, [(7, words)] * 5000)
    assert got == [(7, 120, 120, hashlib.sha256(b"").hexdigest())] * 5000


@pytest.mark.parametrize("copies", [300, 1200])
def test_near_copies_give_rows_in_proportion(spark, copies):
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}", *passage, f"b{i}"])) for i in range(copies)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.selectExpr("unhex(md5(text)) AS row_key", "text")
    assert substrings.repeats(texts, texts, 4, 100).count() <= 26 * copies
    assert run(spark, rows, group_rows=100) == brute(rows)
