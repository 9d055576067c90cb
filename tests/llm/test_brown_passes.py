"""What a round needs of the texts is taken from them once, in buckets of words whose bounds change nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brown_lists import corpus

from gridtempo.llm import brown


@pytest.fixture
def small(monkeypatch):
    for name, value in {"CORE": 4, "CLASSES": 5, "LISTED": 9}.items():
        monkeypatch.setattr(brown, name, value)


def test_rounds_do_not_read_the_texts(spark, small):
    """Once for the words' counts, once for their neighbours, once for the scores."""
    rows = corpus()
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    assert brown.scored(df, F.lit(True)).count() == len(rows)
    assert read.value <= 3 * len(rows)


def test_bounds_of_buckets_change_no_score(spark, small, monkeypatch):
    df = spark.createDataFrame([*corpus(), (200, "the fox naps"), (201, "Hen unseen fox fox unseen unseen digs")], "doc_id long, text string").repartition(3)
    scores = lambda: {r.id: (r.n_known, r.base_score, r.score) for r in brown.scored(df, F.col("doc_id") < 200).collect()}
    want = scores()
    for name, value in {"BUCKET": 3, "BUCKET_WORDS": 2, "FLUSH": 8, "SLICE": 64}.items():
        monkeypatch.setattr(brown, name, value)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = scores()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got.keys() == want.keys()
    for i, x in want.items():
        assert got[i] == pytest.approx(x, rel=1e-9)


def test_a_bucket_is_bounded_by_tokens_and_by_words(monkeypatch):
    monkeypatch.setattr(brown, "BUCKET", 10)
    monkeypatch.setattr(brown, "BUCKET_WORDS", 4)
    monkeypatch.setattr(brown, "BUCKETS", 1)
    n = np.array([99, 50, 9, 9, 5, 3, 3, 2, 2, *[1] * 30])
    first = brown.buckets(n, 1)
    assert first[0] == 1 and first[-1] == len(n) and (np.diff(first) > 0).all() and (np.diff(first) <= 4).all()
    assert all(n[a + 1 : b].sum() <= 10 for a, b in zip(first, first[1:], strict=False))
    assert brown.buckets(n[:2], 2).tolist() == [2]
