import datetime as dt
import json
import math
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridtempo import config, timing
from gridtempo.operators import forecasters, models
from gridtempo.sources import http

START = dt.datetime(2025, 6, 1)
N = 48 * 40


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    step = np.arange(N)
    e = np.zeros(N)
    for t in range(2, N):
        e[t] = 0.6 * e[t - 1] + 0.2 * e[t - 2] + rng.normal()
    x = np.sin(2 * np.pi * step / 48)
    df = pd.DataFrame({"k": "a", "ts": pd.date_range(START, periods=N, freq="30min"), "x": x, "y": 10 + 5 * x + e})
    return spark.createDataFrame(df, "k string, ts timestamp_ntz, x double, y double")


@pytest.fixture(scope="module")
def origins(spark):
    return spark.createDataFrame([("a", START + dt.timedelta(days=d)) for d in range(20, 38)], "k string, origin timestamp_ntz")


def test_forecasters_are_calibrated_and_the_better_is_selected(panel, origins):
    train = panel.filter(F.col("ts") < F.lit(START + dt.timedelta(days=20)))
    naive = forecasters.SeasonalNaive(["k"], "y").fit(panel)
    ar = forecasters.ArRegression(["k"], "y", ["x"]).fit(train)
    rows = forecasters.scored(ar.forecast(panel, origins), panel, ["k"], "y")
    assert rows.count() == 18 * 48
    z = rows.agg(F.stddev((F.col("y") - F.col("mean")) / F.col("sd"))).first()[0]
    assert 0.8 < z < 1.25
    best, crps = forecasters.select_model({"naive": naive, "ar": ar}, panel, origins, ["k"], "y", fallback="naive")
    assert best == "ar" and crps["ar"] < crps["naive"]
    bands = forecasters.lead_bands(rows, ["k"]).orderBy("band").collect()
    assert [b.band for b in bands] == [1, 2, 3, 4] and sum(b.share for b in bands) == pytest.approx(1)
    spread = {r.step: r.sd for r in rows.groupBy("step").agg(F.max("sd").alias("sd")).collect()}
    assert all(spread[s] <= spread[s + 1] + 1e-12 for s in range(47)) and spread[0] < spread[47]


def test_forecasts_use_nothing_from_the_horizon(panel, origins):
    ar = forecasters.ArRegression(["k"], "y", ["x"]).fit(panel.filter(F.col("ts") < F.lit(START + dt.timedelta(days=20))))
    one = origins.filter(F.col("origin") == F.lit(START + dt.timedelta(days=25)))
    later = panel.withColumn("y", F.when(F.col("ts") >= F.lit(START + dt.timedelta(days=25)), 99.0).otherwise(F.col("y")))
    rows = lambda p: [tuple(r) for r in ar.forecast(p, one).orderBy("step").collect()]
    assert rows(panel) == rows(later)
    with pytest.raises(RuntimeError):
        forecasters.SeasonalNaive(["k"], "y").forecast(panel, one)


def test_variants_replace_cells_only_where_given(panel, origins):
    ar = forecasters.ArRegression(["k"], "y", ["x"]).fit(panel)
    one = origins.limit(1)
    first = one.first().origin
    cells = panel.filter((F.col("ts") >= F.lit(first)) & (F.col("ts") < F.lit(first + dt.timedelta(hours=1)))).select("k", "ts", (F.col("x") + 1).alias("x"))
    out = forecasters.run_variants(ar, panel, one, {"actual": None, "moved": cells}, ["x"]).groupBy("step").pivot("variant", ["actual", "moved"]).agg(F.first("mean")).orderBy("step").collect()
    beta = ar.fitted.first().beta[1]
    assert [r.moved - r.actual for r in out[:2]] == pytest.approx([beta, beta]) and all(r.moved == r.actual for r in out[2:])


def test_perturbed_cells_and_rolls(spark, panel, origins):
    error = spark.createDataFrame([("a", s, 0.5, 1.0) for s in range(48)], "k string, step int, rho double, sigma double")
    none = forecasters.perturbed(error, origins, panel, ["k"], "x", 0.0, 1)
    assert none.join(panel.withColumnRenamed("x", "was").drop("y"), ["k", "ts"]).filter("x <> was").count() == 0
    some = forecasters.perturbed(error, origins, panel, ["k"], "x", 1.0, 1, nonnegative=True)
    assert some.count() == 18 * 48 and some.filter("x < 0").count() == 0
    naive = forecasters.SeasonalNaive(["k"], "y").fit(panel)
    out = forecasters.rolled(naive, panel, origins.limit(1), 2, lambda p: p)
    assert out.count() == 96 and out.select("ts").distinct().count() == 96


def by_hand(origin, seed, variable, multiplier, rho, schedule, series=()):
    """One path of errors by the recursion, from an origin in market time ten hours ahead of UTC."""
    ns = int(pd.Timestamp(origin).value)
    z = np.random.default_rng([seed, ns % 2**31, variable, round(multiplier * 10), *series]).standard_normal(48)
    local = pd.date_range(origin, periods=48, freq="30min") + pd.Timedelta(hours=10)
    s = np.asarray(schedule)[local.hour * 2 + local.minute // 30] * multiplier
    e = [s[0] * z[0]]
    for i in range(1, 48):
        e.append(rho * e[-1] + s[i] * math.sqrt(1 - rho**2) * z[i])
    return np.array(e)


def test_errors_follow_their_seed_and_the_market_day(spark):
    schedule = [1 + s / 10 for s in range(48)]
    model = spark.createDataFrame([("a", s, 0.7, v) for s, v in enumerate(schedule)], "k string, step int, rho double, sigma double")
    at = [START + dt.timedelta(hours=h) for h in (0, 12, 29)]
    cases = spark.createDataFrame([("a", o, 7, m) for o in at for m in (0.5, 2.0)], "k string, origin timestamp_ntz, seed long, multiplier double")
    got = forecasters.simulated_errors(model, cases, ["k"], 3, "Australia/Brisbane", shared=True).collect()
    assert len(got) == 6
    for r in got:
        assert r.errors == pytest.approx(by_hand(r.origin, 7, 3, r.multiplier, 0.7, schedule))
    own = forecasters.simulated_errors(model, cases, ["k"], 3, "Australia/Brisbane").collect()
    assert own[0].errors != got[0].errors


def test_overlapping_horizons_keep_their_own_weather(spark, panel):
    ar = forecasters.ArRegression(["k"], "y", ["x"]).fit(panel)
    at = spark.createDataFrame([("a", START + dt.timedelta(days=20, hours=h)) for h in (0, 12)], "k string, origin timestamp_ntz")
    error = spark.createDataFrame([("a", s, 0.5, 1.0) for s in range(48)], "k string, step int, rho double, sigma double")
    cells = forecasters.perturbed(error, at, panel, ["k"], "x", 1.0, 1)
    out = forecasters.run_variants(ar, panel, at, {"actual": None, "perturb_1": cells}, ["x"])
    wide = out.groupBy("k", "origin", "ts").pivot("variant", ["actual", "perturb_1"]).agg(F.first("mean"))
    both = wide.join(cells.withColumnRenamed("x", "moved"), ["k", "origin", "ts"]).join(panel, ["k", "ts"])
    beta = ar.fitted.first().beta[1]
    r = both.agg(F.count("*"), F.max(F.abs(F.col("perturb_1") - F.col("actual") - beta * (F.col("moved") - F.col("x"))))).first()
    assert r[0] == 96 and r[1] < 1e-9
    derived = forecasters.ArRegression(["k"], "y", ["x2"], derive=lambda rows: rows.withColumn("x2", F.col("x") * 2)).fit(panel.withColumn("x2", F.col("x") * 2))
    same = derived.forecast(panel.withColumn("x2", F.col("x") * 2), at, cells).join(out.filter("variant = 'perturb_1'").withColumnRenamed("mean", "m"), ["k", "origin", "ts"])
    assert same.agg(F.max(F.abs(F.col("mean") - F.col("m")))).first()[0] < 1e-6


def test_vintages_narrow_towards_the_target(spark, panel):
    ar = forecasters.ArRegression(["k"], "y", ["x"]).fit(panel)
    error = spark.createDataFrame([("a", s, 0.9, 2.0) for s in range(48)], "k string, step int, rho double, sigma double")
    target = spark.createDataFrame([("a", START + dt.timedelta(days=25, hours=8))], "k string, target timestamp_ntz")
    rows = forecasters.issue_vintages(ar, error, panel, target, "x", draws=205)
    at = rows.groupBy("lead").agg(F.count("*").alias("n"), F.countDistinct("draw").alias("d"), F.stddev(F.get("path", F.col("lead") * 2 - 1)).alias("sd")).orderBy("lead").collect()
    assert [r.lead for r in at] == [3, 6, 12, 18, 24] and all(r.n == r.d == 205 for r in at)
    assert at[0].sd < 0.5 * at[-1].sd


def test_prior_draws_have_their_spread(panel):
    r = forecasters.prior_predictive(panel.limit(48), ["k"], ["x"], 200, 3).agg(F.avg("y"), F.stddev("y"), F.count("*")).first()
    assert abs(r[0]) < 0.15 and 1.0 < r[1] < 1.5 and r[2] == 9600


def test_settings_load_and_refuse_unknown_names(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"market": {"horizon": 24}, "features": {"lags": [48]}}))
    c = config.load(p)
    assert c.market.horizon == 24 and c.features.lags == (48,) and c.scoring.resamples == 10_000
    p.write_text(json.dumps({"market": {"horizn": 24}}))
    with pytest.raises(ValueError):
        config.load(p)


def test_fetching_retries_and_keeps(tmp_path):
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            calls.append(self.path)
            self.send_response(500 if len(calls) < 3 else 200)
            self.end_headers()
            if len(calls) >= 3:
                self.wfile.write(b'{"a": 1}')

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, waits = f"http://127.0.0.1:{server.server_port}", []
    assert http.get_json(url, {"q": "x"}, pause=waits.append) == {"a": 1} and waits == [1, 2] and calls[0] == "/?q=x"
    assert http.fetch_all(url, ["f.json"], ["f.json"], tmp_path)[0].read_text() == '{"a": 1}'
    n = len(calls)
    http.fetch(f"{url}/f.json", tmp_path / "f.json")
    assert len(calls) == n
    with pytest.raises(LookupError):
        http.fetch_all(url, ["g"], ["f.json"], tmp_path)
    server.shutdown()


def test_timings(tmp_path):
    with timing.timed("x") as t:
        sum(range(1000))
    timing.save([t], tmp_path / "t.json")
    assert json.loads((tmp_path / "t.json").read_text())[0]["name"] == "x" and t.wall > 0 and not math.isnan(t.cpu)


def test_impulse_responses_agree(spark):
    from gridtempo.operators import innovations

    r = spark.range(1).select(innovations.weights(F.lit(0.5), F.lit(0.2), 6).alias("w"), innovations.carried(F.lit(0.5), F.lit(0.2), F.lit(2.0), F.lit(1.0), 3).alias("c")).first()
    assert r.w == pytest.approx(models.impulse_response(np.array([0.5, 0.2]), 6)) and r.c == pytest.approx(models.carry(np.array([0.5, 0.2]), np.array([2.0, 1.0]), 3))
