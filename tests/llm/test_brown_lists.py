"""Neither the list nor the core bounds what is clustered: each word seen twice or more is placed by all its neighbours."""

import random

import pytest
from pyspark.sql import functions as F

from gridtempo.llm import brown


def corpus():
    rng = random.Random(7)
    rare = {"n": ["fox", "hen", "emu", "yak"], "v": ["digs", "hums", "nods", "naps"]}
    pick = lambda common, kind: rng.choice(common if rng.random() < 0.8 else rare[kind])
    rows = [(i, " ".join(f"{rng.choice(('the', 'a'))} {pick(['cat', 'dog', 'cow'], 'n')} {pick(['runs', 'sits', 'eats'], 'v')}" for _ in range(8))) for i in range(40)]
    return rows + [(90, "fox hen once fox yak digs"), (91, None)]


def test_the_list_changes_no_score(spark, monkeypatch):
    """With 9 words listed, what the others' classes are and tell comes by shuffles; with all listed, by arrays."""
    monkeypatch.setattr(brown, "CORE", 4)
    monkeypatch.setattr(brown, "CLASSES", 5)
    df = spark.createDataFrame([*corpus(), (200, "the fox naps"), (201, "Hen unseen fox fox unseen unseen digs")], "doc_id long, text string")
    got = {}
    for listed in (9, 1 << 17):
        monkeypatch.setattr(brown, "LISTED", listed)
        got[listed] = {r.id: (r.n_known, r.base_score, r.score) for r in brown.scored(df, F.col("doc_id") < 200).collect()}
    assert got[9].keys() == got[1 << 17].keys()
    for i, want in got[1 << 17].items():
        assert got[9][i] == pytest.approx(want, rel=1e-9)


def test_a_word_with_neighbours_outside_the_core_only_has_a_class(spark, monkeypatch):
    monkeypatch.setattr(brown, "CORE", 2)
    monkeypatch.setattr(brown, "CLASSES", 4)
    rows = [(i, "the a the a") for i in range(30)] + [(100 + i, "the x p q p q p q y a") for i in range(3)]
    for listed in (3, 1 << 17):
        monkeypatch.setattr(brown, "LISTED", listed)
        model = brown.fit(spark.createDataFrame(rows, "row_key long, text string"))
        assert len(model.listed) == 6 and brown.RARE not in model.of.tolist()
