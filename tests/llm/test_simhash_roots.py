from gridtempo.llm import simhash

ROWS = [
    (None, "here stands the first of all texts"),
    (None, "a second one that says something else"),
    (None, "number three speaks of rivers and their bends"),
    (4, "the fourth is about quite other things"),
    (4, "and nothing links the fifth to any"),
]


def test_unrelated_texts_under_null_and_equal_ids_stay(spark):
    out = simhash.dedup(spark.createDataFrame(ROWS + ROWS[:1], "doc_id long, text string"))
    assert sorted(r.text for r in out.collect()) == sorted(t for _, t in ROWS)


def test_linked_texts_under_null_ids_leave_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (None, long + " end"), (None, "here stands quite another text alone")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.fp for r in found}) == 3 and len({r.root for r in found}) == 2
    assert len(simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 2
