from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from gridtempo.llm import decontamination, mixing, quality

from test_jaccard import brute_groups


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    for s in stages[1:5]:
        assert s.columns == stages[0].columns
    assert stages[5].columns == [*stages[0].columns, "shard", "slot"]


def test_rejected_documents_go(spark, sf_dir, stages):
    kept = {r.id for r in quality.judge(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").collect()}
    assert ids(stages[1]) == sorted(kept)


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[1].select("doc_id", "text").collect())
    assert ids(stages[2]) == sorted(min(rows[i].doc_id for i in g) for g in brute_groups([r.text for r in rows]))


def test_leaked_documents_go(spark, sf_dir, stages):
    leaked = {r.id for r in decontamination.overlaps(stages[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert leaked and ids(stages[3]) == sorted(set(ids(stages[2])) - leaked)


def test_copies_follow_the_mix(stages):
    mix = {r.id: r for r in mixing.mix(stages[3]).collect()}
    copies = Counter(ids(stages[4]))
    assert set(copies) <= set(mix)
    words, taken = defaultdict(float), defaultdict(float)
    source = {r.doc_id: r.source for r in stages[3].select("doc_id", "source").collect()}
    for i, r in mix.items():
        assert abs(copies[i] - r.taken / max(r.size, 1)) < 1
        words[source[i]] += copies[i] * r.size
        taken[source[i]] += r.taken
    assert sum(words.values()) == pytest.approx(sum(taken.values()), rel=0.15)


def test_every_row_has_a_place(stages):
    rows = stages[5].select("doc_id", "shard", "slot").collect()
    assert sorted(r.doc_id for r in rows) == ids(stages[4])
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_run_applies_all_stages(spark, sf_dir, stages):
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(stages[5])
