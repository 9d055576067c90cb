"""Near dedup in groups of texts that are just not alike: rows in proportion to the texts, and the same components however buckets are held."""

import pyarrow as pa
import pytest
from test_jaccard import brute_groups, corpus

from gridtempo.llm import jaccard


def groups(spark, texts, **how):
    by = {}
    for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **how).collect():
        by.setdefault(r.root, set()).add(r.id)
    return {frozenset(g) for g in by.values()}


def places(n):
    """Copies changed at the same one of 18 places are alike, those of different places just not."""
    words = [f"w{i}" for i in range(60)]
    return [" ".join([*words[: 5 + 3 * (i % 18)], f"x{i % 18}y{i}", *words[6 + 3 * (i % 18) :]]) for i in range(n)]


def test_no_step_writes_a_groups_pairs(spark, monkeypatch):
    texts, written, whole = places(240), [], jaccard.checkpoint
    monkeypatch.setattr(jaccard, "checkpoint", lambda df: (kept := whole(df), written.append(kept.count()))[0])
    assert groups(spark, texts) == brute_groups(texts)
    assert max(written) < 12 * len(texts)  # the keys of the sets; candidate pairs of different components alone were some 27,000


@pytest.mark.parametrize("how", [{"crowded": 5, "compared": 5}, {"crowded": 20, "compared": 8192}])
def test_buckets_in_pieces_equal_brute_force(spark, how):
    texts = corpus(3) + places(60)
    assert groups(spark, texts, **how) == brute_groups(texts)


def test_bins_bound_what_long_sets_share(spark, monkeypatch):
    """With two bins nearly all counts pass 255, so that the rest beyond decides."""
    monkeypatch.setattr(jaccard, "BINS", 2)
    words = [f"w{i}" for i in range(1500)]
    texts = []
    for i in range(12):  # even ones take turns among few changed words, odd ones among many
        texts.append(" ".join(f"x{i}y{j}" if j % (60 if i % 2 else 18) == i % 18 else w for j, w in enumerate(words)))
    assert groups(spark, texts) == brute_groups(texts)


def test_pieces_of_crowded_buckets():
    """Every row passes once, in order; whole buckets are unflagged, crowded ones come in pieces that begin with their bucket."""
    k = [1, 1, 2] + [3] * 17 + [4] + [5] * 9
    for step in (1, 4, 40):
        batches = [pa.RecordBatch.from_arrays([pa.array(k[i : i + step]), pa.array(range(i, min(i + step, len(k))))], ["k", "i"]) for i in range(0, len(k), step)]
        seen = list(jaccard._pieces(batches, 5))
        assert [x for (_, i), _ in seen for x in i.tolist()] == list(range(len(k)))
        assert {x for (c, _), crowded in seen if crowded for x in c.tolist()} <= {3, 4, 5} and all(len(c) <= 5 + step for (c, _), crowded in seen if crowded)
        assert all(set(c.tolist()) <= {1, 2, 4} for (c, _), crowded in seen if not crowded) or step == 40
