"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from gridtempo.llm import brown, chat, decontamination, html_text, language, mixing, quality, sharding, simhash, substrings

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta", "en", "s1"),
    (1, "alpha beta gamma delta", "en", "s1"),
    (2, None, "en", None),
    (3, "", None, "s2"),
    (None, "alpha beta gamma delta", "en", "s1"),
    (None, None, None, None),
    (4, " \t\n\x0b ", "de", "s2"),
    (5, LONG, "en", "s3"),
    (6, "é ß ñ 漢字 🙂", "fr", "s3"),
]
CLASH = ("row_key", "id", "size", "shard", "key", "words", "fp", "score", "kept", "range", "taken", "uid", "splitters", "nth")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, LONG[:400]), (2, None), (None, "a b c d e f"), (1, LONG[:400])], "item_id long, text string")


OPERATORS = {
    "mixing": lambda d, l, b: mixing.mix(d),
    "simhash": lambda d, l, b: simhash.near_duplicates(d),
    "substrings": lambda d, l, b: substrings.remove_repeats(d),
    "sharding": lambda d, l, b: sharding.shard(d, 3),
    "language": lambda d, l, b: language.predict(d, F.lit(True)),
    "brown": lambda d, l, b: brown.scored(d, F.lit(True)),
    "quality": lambda d, l, b: quality.judge(d, l),
    "html": lambda d, l, b: html_text.extract(d, "doc_id", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_has_its_row(name, docs, labels, benchmark):
    out = OPERATORS[name](docs, labels, benchmark).collect()
    assert sorted(str(r["id"]) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_an_empty_one(name, docs, labels, benchmark):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), benchmark).count() == 0


def test_stages_keep_the_columns(docs, labels, benchmark):
    for out in (quality.keep_good(docs, labels), simhash.dedup(docs), decontamination.decontaminate(docs, benchmark), mixing.remix(docs)):
        assert out.columns == docs.columns
        out.count()
    assert sharding.sharded(docs.drop("shard")).columns[: len(docs.columns) - 1] == docs.drop("shard").columns


def test_chats_with_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, "assistant", None), (1, None, "user", "x"), (None, 0, "user", "y"), (2, 1, "a: b", "### x</turn>\n\\"), (2, 1, "a: b", "### x</turn>\n\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("at", "c", "piece", "same", "formatted")})
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert all(r.exact for r in out.values()) and len(out) == 3
    assert [tuple(t) for t in out[1].turns] == [("user", "x"), ("", ""), ("assistant", "")]
    assert [tuple(t) for t in out[2].turns] == [("a: b", "### x</turn>\n\\")] * 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_decontamination_of_odd_rows(docs, benchmark):
    out = decontamination.overlaps(docs, benchmark).collect()
    assert {(r.id, r.item_id) for r in out} == {(5, 1)}
    assert decontamination.overlaps(docs.limit(0), benchmark).count() == 0
    assert decontamination.overlaps(docs, benchmark.limit(0)).count() == 0


def test_items_below_the_least_length_are_left_out_before_the_search(spark):
    docs = spark.createDataFrame([(i, f"the cat {i} sat on the mat and slept all day") for i in range(5)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "The cat"), (3, "sat on the mat and slept")], "item_id long, text string")
    assert {r.item_id for r in decontamination.overlaps(docs, items).collect()} == {1, 2, 3}
    assert {r.item_id for r in decontamination.overlaps(docs, items, least=5).collect()} == {3}
    assert decontamination.decontaminate(docs, items.filter("item_id < 3")).count() == 5 and decontamination.decontaminate(docs, items).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("mixing", "substrings", "sharding")])
def test_an_id_that_is_no_number_is_an_error(name, spark, labels, benchmark):
    docs = spark.createDataFrame([("seven", "alpha beta gamma delta", "en", "s1")], "doc_id string, text string, lang string, source string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        OPERATORS[name](docs, labels, benchmark).collect()
