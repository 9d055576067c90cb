from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridtempo.llm import golay, simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(prints):
    """id -> smallest id reachable over pairs at most three bits apart."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in prints}


def test_the_code_is_perfect():
    words = np.arange(1 << 12) << 11 | golay._HIGH
    assert np.array_equal(golay.decode(words), np.arange(1 << 12))
    weights = np.bincount(np.bitwise_count(words[1:].astype(np.uint64)))
    assert weights.nonzero()[0].tolist() == [7, 8, 11, 12, 15, 16, 23]


@pytest.mark.parametrize("width", [21, 22])
def test_words_one_bit_apart_share_an_index(width):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << width, 5000)
    y = x ^ (1 << rng.integers(0, width, 5000))
    for a, b in zip(golay.near(x, width), golay.near(y, width), strict=True):
        assert {v for v in a if v >= 0} & {v for v in b if v >= 0}


def test_every_pair_within_three_bits_shares_a_key():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    sets = []
    for fp in (x, y):
        found = [set() for _ in fp]
        for r, k in zip(*simhash.fuzzy_keys(fp), strict=True):
            found[r].add(int(k))
        sets.append(found)
    assert all(a & b for a, b in zip(*sets, strict=True))


def test_whole_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = simhash.near_duplicates(docs).collect()
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    assert {r.id: r.fp % (1 << 64) for r in got} == prints
    assert {r.id: r.component_id for r in got} == brute_components(prints)


@pytest.mark.parametrize("limit", [1, 5, 10_000])
def test_dense_groups_lose_no_link_whatever_the_bucket_limit(spark, limit):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(25):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    prints = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints.values()], "fp long")
    found = simhash.components(simhash.links(df, bucket_limit=limit)).collect()
    want = brute_components(prints)
    ids = {x: i for i, x in prints.items()}
    groups = {}
    for r in found:
        groups.setdefault(r.root % (1 << 64), set()).update({ids[r.node % (1 << 64)], ids[r.root % (1 << 64)]})
    linked = {frozenset(i for i in want if want[i] == r) for r in set(want.values())}
    assert {frozenset(g) for g in groups.values()} == {g for g in linked if len(g) > 1}


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (9, "quite another text stands here alone"), (None, "a b c d e f g h")]
    out = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.doc_id for r in out] == [2, 9]


def test_long_chains_are_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert simhash.components(edges).agg(F.countDistinct("root"), F.min("root"), F.count("*")).first()[:] == (1, 0, 200)
