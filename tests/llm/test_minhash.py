"""Circulant MinHash against brute force over all pairs, odd tables, and large groups in small tiles."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtempo.llm import linking, minhash


def sets_of(text, width=2):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width=2, per_cent=80):
    """{position: (size, smallest id reachable)}"""
    sets, group = [sets_of(t, width) for _, t in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= per_cent * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    ids = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            ids[g] = min(i, ids.get(g, i))
    return sorted((str(i), len(s), str(ids.get(g))) for (i, _), s, g in zip(rows, sets, group, strict=True))


def corpus(seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(25)]
    out = ["", None, " \t", "one", "ONE", "One two", "one two", "a b c", "A B C", "a b c", "é 漢字 🙂", " ".join(f"v{i}" for i in range(30_000))]
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 12, 40, 90, 300]))]
        words[2:2] = passage if rng.random() < 0.5 else []
        for _ in range(rng.randrange(14)):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(0, 2 + len(words) // 25)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(3000)}"
    rng.shuffle(out)
    rows = list(enumerate(out))
    return [*rows, (None, out[3]), (None, None), (5, out[5]), rows[9], rows[9]]


def found(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "fp", "k", "root", "keys", "shingles", "centre")})
    return sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in minhash.near_duplicates(docs, **how).collect())


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"tile": 300, "most_blocks": 1}), (3, {"members": 30})])
def test_components_equal_brute_force(spark, seed, how):
    rows = corpus(seed)
    got = found(spark, rows, **how)
    want = brute(rows)
    assert sum(w[0] != w[2] for w in want) > 40 and got == want


def test_the_threshold_itself_links(spark):
    """8 of 10 shingles shared is 80 in 100; 7 of 9 isn't."""
    words = [f"w{i}" for i in range(10)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:9], "x"]))]
    assert found(spark, rows) == [("1", 9, "1"), ("2", 9, "1")] == brute(rows)
    rows = [(1, " ".join(words[:9])), (2, " ".join([*words[:8], "x"]))]
    assert found(spark, rows) == [("1", 8, "1"), ("2", 8, "2")] == brute(rows)


def test_copies_of_many_kinds_write_rows_in_proportion(spark):
    """Copies of one text, a word replaced at one of 18 places: copies of a place are linked, those of different places are just not."""
    words = [f"w{i}" for i in range(40)]

    def rows(n):
        return [(i, " ".join([*words[: 2 * (i % 18)], f"a{i % 18}", f"b{i % 18}", f"c{i}" if i % 2 else "c", *words[2 * (i % 18) + 3 :]])) for i in range(n)]

    told = rows(360)
    assert found(spark, told) == brute(told)


@pytest.mark.parametrize("most_blocks", [1, 1000])
def test_one_bucket_of_many_unlinked_sets_is_cut_into_tiles(spark, most_blocks):
    """A third of all sets in one bucket: no task holds more than two tiles' shingles, and links across tiles are found."""
    rng = np.random.default_rng(5)
    sets = [(int(i), sorted(rng.integers(0, 1 << 40, 20).tolist())) for i in range(600)]
    sets += [(int(i) + 1000, [*s[:-1], 7]) for i, s in sets[::6]]
    table = spark.createDataFrame(sets, "fp long, shingles array<long>")
    rest = table.select(F.lit(1).cast("long").alias("k"), "fp", F.col("fp").alias("root"))
    got = {(r.a, r.b) for r in linking.within(rest, table, 80, 500, 100, most_blocks).collect()}
    assert got == {(i, i + 1000) for i, _ in sets[:600:6]}


def test_signatures_estimate_similarity_and_are_circulant():
    values = np.random.default_rng(1).integers(0, 1 << 62, 4000).astype(np.uint64)
    one, two = minhash.signatures(np.concatenate([values[:3600], values[400:]]), np.array([3600, 3600]), 1024)
    assert abs((one == two).mean() - 3200 / 4000) < 0.06
    place = (minhash.mix(values[:3] + np.uint64(minhash._SEED)) >> np.uint64(64 - minhash.RING_BITS)).astype(np.int64)
    ring = minhash._table(8)[: 1 << minhash.RING_BITS]
    assert (minhash.signatures(values[:3], np.array([3]), 8)[0] == [min(ring[(p + j) % len(ring)] for p in place) for j in range(8)]).all()


def test_no_rows_and_dedup(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 0
    docs = spark.createDataFrame([(3, "a b c"), (2, "a b c"), (None, "a b c"), (4, None), (5, "")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in minhash.dedup(docs).collect()) == ["2", "4", "5"]
