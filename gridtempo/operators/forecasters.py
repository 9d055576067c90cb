"""The forecaster contract and its runs over origins and weather variants.

A forecaster is fitted once (what it learns is written, a row for each series or half hour of the week) and forecasts any origins from data before each, plus covariates of the horizon. Forecasts are rows
(keys, origin, step, mean, sd).
"""

from __future__ import annotations

import math
import zlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import mathx
from ..lineage import checkpoint
from . import autoregression, innovations, models, scores, splits
from .features import half_hour_of_day, half_hour_of_week, override
from .timegrid import order, to_zone


class Forecaster(ABC):
    """``panel``: one row for each period of each series, on a strict grid."""

    def __init__(self, keys: list[str], value: str, horizon: int = 48):
        self.keys, self.value, self.horizon = keys, value, horizon
        self.fitted: DataFrame | None = None

    @abstractmethod
    def fit(self, panel: DataFrame) -> Forecaster: ...

    @abstractmethod
    def forecast(self, panel: DataFrame, origins: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
        """``overrides``: rows (keys, origin, ts, covariates) that replace the panel's in the horizon of that origin alone.

        Further columns of ``origins`` (a case of an origin, such as a member) are kept and are keys of ``overrides`` too.
        """

    def cases(self, origins: DataFrame) -> list[str]:
        return [*self.keys, *[c for c in origins.columns if c not in (*self.keys, "origin")]]

    def steps(self, origins: DataFrame) -> DataFrame:
        if self.fitted is None:
            raise RuntimeError("fit the model first")
        return splits.horizon(origins, self.cases(origins), self.horizon)


class SeasonalNaive(Forecaster):
    """Last week's value, with the spread of its errors by half hour of the week over the fit window."""

    season = 336

    def fit(self, panel: DataFrame) -> SeasonalNaive:
        rows = panel.withColumn("__e", F.col(self.value) - F.lag(self.value, self.season).over(order(self.keys)))
        self.fitted = checkpoint(rows.groupBy(*self.keys, half_hour_of_week(F.col("ts")).alias("how")).agg(F.stddev_samp("__e").alias("sd")))
        self.naive_error = rows.groupBy(*self.keys).agg(F.avg(F.abs("__e")).alias("naive_error"))
        return self

    def forecast(self, panel: DataFrame, origins: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
        back = F.make_dt_interval(secs=F.lit(self.season * 1800))
        before = panel.select(*self.keys, (F.col("ts") + back).cast("timestamp_ntz").alias("ts"), F.col(self.value).alias("mean"))
        rows = self.steps(origins).join(before, [*self.keys, "ts"], "left").withColumn("how", half_hour_of_week(F.col("ts")))
        return rows.join(self.fitted, [*self.keys, "how"], "left").select(*self.cases(origins), "origin", "step", "ts", "mean", "sd")


class ArRegression(Forecaster):
    """Regression with AR(p) errors: closed-form means and spreads from the last errors and the impulse response.

    ``derive`` recomputes the features that depend on replaced covariates, row by row.
    """

    def __init__(self, keys: list[str], value: str, features: list[str], p: int = 2, horizon: int = 48, derive: Callable[[DataFrame], DataFrame] | None = None):
        super().__init__(keys, value, horizon)
        self.features, self.p, self.derive = features, p, derive or (lambda rows: rows)

    def fit(self, panel: DataFrame) -> ArRegression:
        self.fitted = checkpoint(autoregression.ar_regression(panel, self.keys, self.value, self.features, self.p))
        return self

    def forecast(self, panel: DataFrame, origins: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
        cases, steps = self.cases(origins), self.steps(origins)
        both = panel.join(self.fitted, self.keys)
        x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in self.features])
        fitted = both.withColumn("__m", innovations.dot(x, F.col("beta"))).withColumn("__e", F.col(self.value) - F.col("__m"))
        w = order(self.keys)
        fitted = fitted.withColumns({f"__l{k}": F.lag("__e", k).over(w) for k in range(1, self.p + 1)})
        last = F.array(*[F.col(f"__l{k}") for k in range(self.p, 0, -1)])
        ends = fitted.select(*self.keys, F.col("ts").alias("origin"), last.alias("last"), "phi", "sigma").join(origins.select(*self.keys, "origin").distinct(), [*self.keys, "origin"])
        impulse = F.array(*[F.lit(float(k == 1)) for k in range(self.p, 0, -1)])
        response = innovations.carried_by(F.col("phi"), impulse, self.p, self.horizon)
        ends = ends.withColumns({"carry": innovations.carried_by(F.col("phi"), F.col("last"), self.p, self.horizon), "psi": F.concat(F.array(F.lit(1.0)), response)})
        if overrides is None:
            ahead = steps.join(fitted.select(*self.keys, "ts", "__m"), [*self.keys, "ts"])
        else:
            columns = [c for c in overrides.columns if c not in (*cases, "origin", "ts")]
            ahead = self.derive(override(steps.join(panel, [*self.keys, "ts"]), overrides, [*cases, "origin", "ts"], columns))
            ahead = ahead.join(self.fitted.select(*self.keys, "beta"), self.keys).withColumn("__m", innovations.dot(x, F.col("beta")))
        rows = ahead.join(ends, [*self.keys, "origin"])
        spread = F.sqrt(F.aggregate(F.slice("psi", F.lit(1), F.col("step") + 1), F.lit(0.0), lambda a, v: a + v * v))
        return rows.select(*cases, "origin", "step", "ts", (F.col("__m") + F.get("carry", F.col("step"))).alias("mean"), (F.col("sigma") * spread).alias("sd"))


def run_variants(model: Forecaster, panel: DataFrame, origins: DataFrame, variants: dict[str, DataFrame | None], columns: list[str], rebuild=None) -> DataFrame:
    """Forecasts of every variant for every origin, with a column ``variant``.

    A variant is a frame (keys, ts, columns) whose cells replace the panel's, or None for the panel itself. ``rebuild`` recomputes what depends on
    the replaced columns (the whole design); without it only the columns themselves change (a patch). A frame with a column ``origin`` replaces
    the covariates of each origin's own horizon, as overlapping horizons need.
    """
    out = None
    for name, cells in variants.items():
        if cells is not None and "origin" in cells.columns:
            rows = model.forecast(panel, origins, cells).withColumn("variant", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
            continue
        frame = panel if cells is None else override(panel, cells, [*model.keys, "ts"], columns)
        rows = model.forecast(rebuild(frame) if rebuild and cells is not None else frame, origins).withColumn("variant", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def simulated_errors(model: DataFrame, cases: DataFrame, keys: list[str], variable: int, market: str, steps: int = 48, shared: bool = False) -> DataFrame:
    """The cases (keys, origin, seed, multiplier, ...) with an array ``errors`` over the horizon, by the AR(1) error model of one weather variable.

    A path's seed is made of the case's seed, its origin, the variable's number and ten times the multiplier, and of its series unless ``shared``.
    The model's spread belongs to the half hour of the market day, so that the schedule begins where the origin lies in it.
    """
    schedule = model.groupBy(*keys).agg(F.first("rho").alias("__rho"), F.transform(F.array_sort(F.collect_list(F.struct("step", "sigma"))), lambda s: s["sigma"]).alias("__sigma"))
    first = half_hour_of_day(to_zone(F.col("origin").cast("timestamp_ntz"), "UTC", market))
    rows = cases.join(schedule, keys).withColumns({"__first": first, "__ns": F.unix_micros(F.col("origin").cast("timestamp")) * 1000})

    def path(case: dict, series: list) -> np.ndarray:
        # What seeds a path, and in which order.
        tokens = [int(case["seed"]), int(case["__ns"]) % 2**31, variable, round(10 * case["multiplier"])]
        z = np.random.default_rng(tokens + [zlib.crc32(str(k).encode()) for k in series]).standard_normal(steps)
        schedule = np.asarray(case["__sigma"], dtype=float)
        sigma, rho = case["multiplier"] * schedule[(case["__first"] + np.arange(steps)) % len(schedule)], case["__rho"]
        e = sigma * z * np.r_[1.0, np.full(steps - 1, math.sqrt(max(0.0, 1 - rho * rho)))]
        for i in range(1, steps):
            e[i] += rho * e[i - 1]
        return e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [path(case, [] if shared else [case[k] for k in keys]) for case in pdf.to_dict("records")]
            yield pdf[kept].assign(errors=found)

    kept = cases.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema)
    return rows.mapInPandas(run, f"{schema}, errors array<double>")


def perturbed(model: DataFrame, origins: DataFrame, panel: DataFrame, keys: list[str], column: str, multiplier: Column | float, seed: Column | int, steps: int = 48, nonnegative: bool = False, variable: int = 0, market: str = "Australia/Brisbane") -> DataFrame:
    """Cells (keys, further columns of ``origins``, origin, ts, column) of the horizons with simulated forecast errors added, a path for each row of ``origins``."""
    column_of = lambda v: v if isinstance(v, Column) else F.lit(v)
    cases = origins.withColumns({"multiplier": column_of(multiplier).cast("double"), "seed": column_of(seed).cast("long")})
    errors = simulated_errors(model, cases, keys, variable, market, steps).drop("multiplier", "seed")
    rest = [c for c in errors.columns if c != "errors"]
    each = errors.select(*rest, F.posexplode("errors").alias("step", "e"))
    each = each.withColumn("ts", (F.col("origin") + F.make_dt_interval(secs=F.col("step") * 1800)).cast("timestamp_ntz"))
    value = F.col(column) + F.col("e")
    return each.join(panel.select(*keys, "ts", column), [*keys, "ts"]).select(*rest, "ts", (F.greatest(value, F.lit(0.0)) if nonnegative else value).alias(column))


def issue_vintages(model: ArRegression, error: DataFrame, panel: DataFrame, targets: DataFrame, column: str, leads: tuple[int, ...] = (24, 18, 12, 6, 3), members: int = 10, draws: int = 200, seed: int = 1, market: str = "Australia/Brisbane") -> DataFrame:
    """Rows (keys, target, lead, draw, path): what is forecast for a target time, issued so many hours before it.

    Weather error grows with the lead (its share of 24 hours) and is drawn for ``members`` members, among which the ``draws`` paths are shared evenly.
    ``targets``: rows (keys, target). A path covers the model's horizon from the issue.
    """
    keys = model.keys
    cases = targets.select(*keys, "target", F.explode(F.array(*[F.lit(h) for h in leads])).alias("lead"))
    cases = cases.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    cases = cases.withColumn("origin", (F.col("target") - F.make_dt_interval(hours=F.col("lead"))).cast("timestamp_ntz"))
    cells = perturbed(error, cases, panel, keys, column, F.col("lead") / 24, seed + F.col("lead") + F.col("member"), model.horizon, market=market)
    by = [*keys, "target", "lead", "member"]
    ahead = model.forecast(panel, cases, cells).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "mean"))), lambda s: s["mean"]).alias("__mean"))
    noise = models.ar_paths(cases.select(*by).join(model.fitted, keys), by, model.horizon, -(-draws // members), seed)
    rows = noise.join(ahead, by).select(*by, (F.col("draw") * members + F.col("member")).alias("draw"), F.zip_with("__mean", "path", lambda m, e: m + e).alias("path"))
    return rows.filter(F.col("draw") < draws).drop("member")


def scored(forecasts: DataFrame, panel: DataFrame, keys: list[str], value: str) -> DataFrame:
    rows = forecasts.join(panel.select(*keys, "ts", F.col(value).alias("y")), [*keys, "ts"]).filter("mean IS NOT NULL AND sd > 0")
    return rows.withColumns({"crps": mathx.col(scores.crps_gaussian("y", "mean", "sd")), "log_score": mathx.col(scores.log_score_gaussian("y", "mean", "sd"))})


def select_model(candidates: dict[str, Forecaster], panel: DataFrame, origins: DataFrame, keys: list[str], value: str, fallback: str | None = None, margin: float = 0.99) -> tuple[str, dict[str, float]]:
    """The candidate of the lowest mean CRPS; where a ``fallback`` is named, others must beat it by the margin."""
    found = {}
    for name, model in candidates.items():
        found[name] = scored(model.forecast(panel, origins), panel, keys, value).agg(F.avg("crps")).first()[0] or math.inf
    best = min(found, key=lambda n: (found[n], n))
    if fallback is not None and best != fallback and found[best] >= margin * found[fallback]:
        best = fallback
    return best, found


def chosen(candidates: DataFrame, name: str, family: str, home: str, score: str = "crps", margin: float = 0.99) -> DataFrame:
    """The candidates with a flag on the one chosen: the best, but one of another family than ``home`` must beat the best of that by the margin."""
    w, at_home = Window.partitionBy(F.lit(0)), F.col(family) == home
    best, at = F.min(score).over(w), F.min(F.when(at_home, F.col(score))).over(w)
    name_of = lambda among: F.min_by(F.when(among, F.col(name)), F.when(among, F.struct(score, name))).over(w)
    pick = F.when(at.isNotNull() & (best >= margin * at), name_of(at_home)).otherwise(name_of(F.lit(True)))
    return candidates.withColumn("chosen", F.col(name) == pick)


def rolled(model: Forecaster, panel: DataFrame, origins: DataFrame, days: int, rebuild, checkpoint=lambda df: df) -> DataFrame:
    """Days ahead beyond the horizon: each day's mean path fills the series for the next day's lags."""
    out, frame, now = None, panel, origins
    for day in range(days):
        rows = checkpoint(model.forecast(frame, now).withColumn("day", F.lit(day)))
        out = rows if out is None else out.unionByName(rows)
        means = rows.groupBy(*model.keys, "ts").agg(F.avg("mean").alias(model.value))
        frame = rebuild(checkpoint(override(frame, means, [*model.keys, "ts"], [model.value])))
        now = now.withColumn("origin", (F.col("origin") + F.make_dt_interval(secs=F.lit(model.horizon * 1800))).cast("timestamp_ntz"))
    return out


def prior_predictive(design: DataFrame, keys: list[str], x: list[str], draws: int, seed: int, scale: float = 1.0) -> DataFrame:
    """Rows (keys, ts, draw, y): days drawn from standard normal coefficients, by hashed uniforms, so that reruns agree."""
    rows = design.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))

    def normal(*content: Column) -> Column:
        u = [(F.pmod(F.xxhash64(*content, F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40) for k in (0, 1)]
        return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * F.pi() * u[1])

    mean = sum((F.col(c) * normal(F.col("draw"), F.lit(c)) for c in x), F.lit(0.0))
    return rows.select(*keys, "ts", "draw", (scale * (mean + normal(F.col("draw"), F.col("ts")))).alias("y"))


def lead_bands(scored_rows: DataFrame, by: list[str], step: str = "step") -> DataFrame:
    """Mean CRPS in quarters of the horizon, and each quarter's share of the whole."""
    rows = scored_rows.groupBy(*by, F.ceil((F.col(step) + 1) / 12).cast("int").alias("band")).agg(F.avg("crps").alias("crps"))
    return rows.withColumn("share", F.col("crps") / F.sum("crps").over(Window.partitionBy(*by)))
