"""The pipeline and its stages on empty and odd tables, and clashing names in the other tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridtempo.llm import decontamination, html_text, language, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the river ran slowly past the old mill and the people of the town walked along its banks every evening in summer"
ROWS = [
    (1, PROSE, "en", "s1", None),
    (1, PROSE, "en", "s1", None),
    (2, None, None, None, None),
    (3, "", "en", "s2", 0),
    (None, PROSE + " again", "en", "s1", None),
    (None, None, None, None, None),
    (4, " ".join(f"w{i % 977}x{i % 13}." for i in range(30_000)), "en", "s2", 5),
]


def tables(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).withColumn("row_key", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("x") for c in ("text", "kept", "row_key")}).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("doc_id", "hash", "tokens", "item_key", "row_key")}).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["none", "documents only", "odd"])
def test_the_pipeline_runs_on_odd_tables(spark, tmp_path, name):
    rows, labels, items = {"none": ([], [], []), "documents only": (ROWS, [], []), "odd": (ROWS, [(1, 1, 0), (None, 0, None), (4, None, 1)], [(1, "zebras graze on the open plain at dawn"), (1, None), (None, "")])}[name]
    at = tables(spark, tmp_path, rows, labels, items)
    out = corpus_pipeline.run(spark, at)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "row_key", "shard", "slot"]
    got = out.collect()
    assert all(r.shard is not None and r.slot is not None for r in got) and {r.text for r in got} <= {r[1] for r in ROWS}
    if not rows:
        assert not got


@pytest.mark.parametrize("i", range(len(corpus_pipeline.STAGES)))
def test_each_stage_takes_an_empty_table(spark, tmp_path, i):
    at = tables(spark, tmp_path, [], [(1, 1, 0)], [(1, PROSE)])
    docs = spark.read.parquet(f"{at}/documents.parquet")
    out = corpus_pipeline.STAGES[i][1](spark, docs, at)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == 0


def test_clashing_names_in_the_benchmark(spark, tmp_path):
    at = tables(spark, tmp_path, ROWS, [], [(7, PROSE)])
    out = decontamination.overlaps(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")).collect()
    assert {(r.id, r.item_id) for r in out} == {(1, 7), (None, 7)}


def test_clashing_names_and_ties_in_the_labels(spark, tmp_path):
    """Rows with the same text get the same verdict, however labelled."""
    good = " ".join(f"word{i % 70}" + ("." if i % 9 == 0 else "") for i in range(70))
    rows = [(i, good, "en", "s", None) for i in range(40)]
    at = tables(spark, tmp_path, rows, [(i, i % 2, 0) for i in range(40)], [])
    out = quality.judge(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")).collect()
    assert len(out) == 40 and len({r.kept for r in out}) == 1


def test_clashing_names_in_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><p>b</p>", "u"), (None, None, None)], "page_id long, html string, url string").withColumns({c: F.lit("x") for c in ("id", "text", "row_key", "doc_id")})
    out = {r["id"]: r for r in html_text.extract(pages, "page_id", "html").collect()}
    assert set(out) == {1, None}


def test_languages_that_tie_are_settled_alike_on_every_run(spark):
    rows = [(i, "same words here", "aa" if i % 2 else "bb") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    runs = [{r.lang_pred for r in language.predict(docs.repartition(n), F.lit(True)).collect()} for n in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 1
