"""What a Python worker holds in the pipeline's steps depends on the window, not on the batch; a stage has one Python map."""

import tracemalloc

import numpy as np
import pyarrow as pa

from gridtempo.llm import decontamination, jaccard, quality


class Caught:
    """Stands for a DataFrame; keeps the function that a map is given."""

    schema = None

    def select(self, *columns):
        return self

    def mapInArrow(self, fn, schema):
        self.fn = fn
        return self


def texts(mb: int) -> list[str]:
    rng = np.random.default_rng(5)
    return [" ".join(map(str, rng.integers(1_000, 9_999, 800))) for _ in range(mb * 250)]


def peak_mb(fn, batch: pa.RecordBatch) -> float:
    tracemalloc.start()
    try:
        assert sum(part.num_rows for part in fn([batch]))
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_quality_rules_hold_one_small_window(spark, monkeypatch):
    own = texts(10)
    caught = Caught()
    monkeypatch.setattr(quality, "fit", lambda *_: (quality.Judge(None, np.arange(8), 1.0), None))
    monkeypatch.setattr(quality, "checkpoint", lambda df: df)
    quality.measured(caught)
    n = np.arange(len(own))
    assert peak_mb(caught.fn, pa.RecordBatch.from_arrays([pa.array(n), pa.array(n), pa.array(own)], ["id", "row_key", "text"])) < 60
    quality.keep_good(caught, None)
    assert peak_mb(caught.fn, pa.RecordBatch.from_arrays([pa.array(n), pa.array(own)], ["doc_id", "text"])) < 60


def test_decontamination_holds_one_small_window(spark):
    class Every:
        value = staticmethod(lambda seed: np.flatnonzero(seed % np.uint64(50) == 0))

    own = texts(10)
    caught, n = Caught(), np.arange(len(own))
    caught.withColumn = lambda *_: caught
    decontamination.segments(caught, "doc_id", "text", Every, False)
    assert peak_mb(caught.fn, pa.RecordBatch.from_arrays([pa.array(n), pa.array(n), pa.array(own)], ["id", "row_key", "text"])) < 60


def test_bins_are_made_in_the_pass_that_finds_the_sets(spark):
    met = spark.createDataFrame([(1, 1, 3, 0, 1), (1, 2, 3, 0, 2)], "k long, fp long, n int, pos int, root long")
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 3]), (3, [7])], "fp long, shingles array<long>")
    near = jaccard._near(met, sets, 2, 0.8)
    assert near._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert {r.fp for r in near.collect()} == {1, 2}
