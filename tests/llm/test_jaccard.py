import random
from itertools import combinations

import pytest

import corpus_pipeline
from gridtempo.llm import jaccard, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    """Sets of positions that pairs of five-word Jaccard similarity 0.8 or more join."""
    sets, group = [shingles(t) for t in texts], {i: {i} for i in range(len(texts))}
    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            both = group[i] | group[j]
            for x in both:
                group[x] = both
    return {frozenset(g) for g in group.values()}


def corpus(seed, texts=20, copies=12):
    """Texts with a common passage, and copies of copies at all degrees of change."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    out = ["", None, "one", "One", "two words", "a b c d", "a b c d e"]
    for _ in range(texts):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 20, 80, 300]))]
        words[3:3] = passage if rng.random() < 0.5 else []
        for _ in range(rng.randrange(copies)):
            out.append(" ".join(words))
            if rng.random() < 0.7:
                words = list(words)
                for _ in range(rng.randrange(1, 2 + len(words) // 40)):
                    words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    texts = corpus(seed)
    found = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by = {}
    for r in found:
        by.setdefault(r.root, set()).add(r.id)
    want = brute_groups(texts)
    assert any(len(g) > 1 for g in want) and {frozenset(g) for g in by.values()} == want


def test_given_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {min(rows[i].doc_id for i in g) for g in brute_groups([r.text for r in rows])}
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).select("doc_id").collect()}
    assert got == want


def test_the_stage_drops_copies_beyond_three_bits(spark, sf_dir):
    words = [f"w{i}" for i in range(200)]
    changed = [w if i % 60 != 20 else "other" for i, w in enumerate(words)]
    far = [w if i % 20 != 10 else "other" for i, w in enumerate(words)]
    rows = [(5, " ".join(words)), (6, " ".join(changed)), (7, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.dedup(docs).count() == 3
    out = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == [5, 7]


def test_unrelated_texts_under_null_and_equal_ids_stay(spark):
    rows = [(None, "here stands the first of all texts"), (None, "a second one that says something else"), (4, "the third is about quite other things"), (4, "and nothing links the fourth to any"), (None, "")]
    out = jaccard.dedup(spark.createDataFrame(rows + rows[:1], "doc_id long, text string"))
    assert sorted(r.text for r in out.collect()) == sorted(t for _, t in rows)


def test_empty_tables(spark):
    assert jaccard.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
