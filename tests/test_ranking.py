"""Ranks and order statistics spread over tasks, against pandas and NumPy; one value or group in a third of the rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridtempo.operators import ranking


def table(spark, seed, n=3000):
    rng = random.Random(seed)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), 7.5 if i % 3 == 1 else rng.choice([None, rng.gauss(0, 1), float(rng.randrange(5))])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "i int, g string, x double").repartition(5)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_average_ranks_equal_pandas(spark, by):
    rows, df = table(spark, 1)
    want = pd.DataFrame(rows, columns=["i", "g", "x"])
    x = want["x"].fillna(-1e9)
    want["rank"] = x.groupby(want["g"].fillna("none")).rank(method="average") if by else x.rank(method="average")
    got = ranking.average_ranks(df, by, "x").toPandas().set_index("i")["rank"]
    assert got.sort_index().tolist() == want.set_index("i")["rank"].tolist()


def test_no_plan_puts_all_rows_together(spark):
    _, df = table(spark, 2)
    plans = [f(df)._jdf.queryExecution().executedPlan().toString() for f in (lambda d: ranking.average_ranks(d, [], "x"), lambda d: ranking.rank_counts(d, "g", "x", 10))]
    assert not any("SinglePartition" in p for p in plans)


def test_a_hot_value_is_one_row_before_the_ranges(spark):
    rows, df = table(spark, 3)
    found = ranking.frequencies(df, [], "x").collect()
    assert len(found) == len({r[2] for r in rows}) and sum(r["__n"] for r in found) == len(rows)
    running = 0
    for r in sorted(found, key=lambda r: (r.x is not None, r.x)):
        assert r["__before"] == running
        running += r["__n"]


def test_rank_counts(spark):
    rows, df = table(spark, 4)
    df = df.filter("x IS NOT NULL")
    want = pd.DataFrame([r for r in rows if r[2] is not None], columns=["i", "g", "x"])
    want["bin"] = np.minimum(((want["x"].rank() - 0.5) / len(want) * 7).astype(int) + 1, 7)
    want = want.groupby(["g", "bin"], dropna=False).size()
    got = {(r.g, r.bin): r.n for r in ranking.rank_counts(df, "g", "x", 7).collect()}
    assert got == {(None if g != g else g, b): n for (g, b), n in want.items()}


def test_order_statistics(spark):
    rows, df = table(spark, 5)
    df = df.filter("x IS NOT NULL")
    sizes = df.groupBy("g").agg(F.count("*").alias("k"))
    wanted = sizes.select("g", F.array(*[F.struct(F.lit(n).alias("name"), p.cast("long").alias("place")) for n, p in (("least", F.lit(0)), ("middle", F.floor(F.col("k") / 2)), ("most", F.col("k") - 1))]).alias("places"))
    got = {(r.g, r["name"]): r.x for r in ranking.at_positions(ranking.frequencies(df, ["g"], "x"), ["g"], wanted, "x").collect()}
    for g in ("hot", "a", "b", None):
        x = sorted(r[2] for r in rows if r[1] == g and r[2] is not None)
        assert [got[g, n] for n in ("least", "middle", "most")] == [x[0], x[len(x) // 2], x[-1]]


def test_columns_that_clash_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 5, 9.0), (2, 6, 9.0)], "n int, before int, x double")
    assert sorted(tuple(r) for r in ranking.average_ranks(df, [], "x").collect()) == [(1, 5, 9.0, 1.5), (2, 6, 9.0, 1.5)]
    assert ranking.average_ranks(df.limit(0), [], "x").count() == 0 == ranking.rank_counts(df.limit(0), "n", "x", 3).count()
