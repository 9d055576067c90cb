"""Calendar, weather and lag features: one ``select`` over a panel, with windows for lags and trailing means."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .timegrid import order, to_zone

# Degree-day bases, hinge knots, trailing windows, lags and harmonics.
HEATING, COOLING = 16.5, 20.5
KNOTS = (10.5, 18.5, 25.65)
THERMAL = (48, 96)
LAGS = (48, 336)
DAILY, WEEKLY, INTERACTIONS, VARIANCE_DAILY = 10, 6, 2, 3
DAILY_RBF, WEEKLY_RBF = 20, 12
# One-off public holidays (the day of mourning of 2022).
ONE_OFF = (dt.date(2022, 9, 22),)


def phases(ts: str, zone: str) -> tuple[Column, Column]:
    """Shares of the local day, and of the local week from Monday."""
    local = to_zone(F.col(ts), "UTC", zone)
    daily = (F.hour(local) + F.minute(local) / 60) / 24
    return daily, (F.weekday(local) + daily) / 7


def fourier(phase: Column, harmonics: int, prefix: str) -> dict[str, Column]:
    out = {}
    for k in range(1, harmonics + 1):
        angle = 2 * F.pi() * k * phase
        out[f"{prefix}_sin{k}"], out[f"{prefix}_cos{k}"] = F.sin(angle), F.cos(angle)
    return out


def periodic_rbf(phase: Column, centres: int, prefix: str) -> dict[str, Column]:
    """Gaussian bumps on the circle, as wide as their distance; the last is left out."""
    out = {}
    for k in range(centres - 1):
        d = F.abs(phase - k / centres)
        out[f"{prefix}_rbf{k}"] = F.exp(-0.5 * F.pow(F.least(d, 1 - d) * centres, F.lit(2.0)))
    return out


def seasonal(ts: str, zone: str, basis: str = "fourier", daily: int | None = None, weekly: int | None = None) -> dict[str, Column]:
    """The seasons of day and week in the named basis: so many harmonics (``fourier``) or centres (``rbf``) of each."""
    day, week = phases(ts, zone)
    if basis == "fourier":
        return fourier(day, daily or DAILY, "day") | fourier(week, weekly or WEEKLY, "week")
    if basis == "rbf":
        return periodic_rbf(day, daily or DAILY_RBF, "day") | periodic_rbf(week, weekly or WEEKLY_RBF, "week")
    raise ValueError(f"no such seasonal basis: {basis!r}")


def above(x: Column, base: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x - base, F.lit(0.0)))


def below(x: Column, base: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(base - x, F.lit(0.0)))


def degree_days(temp: Column, suffix: str = "") -> dict[str, Column]:
    return {f"cooling{suffix}": above(temp, COOLING), f"heating{suffix}": below(temp, HEATING)}


def hinges(temp: Column) -> dict[str, Column]:
    return {f"hinge_{k}": above(temp, knot) for k, knot in enumerate(KNOTS)}


def trailing_mean(x: Column, keys: list[str], width: int, ts: str = "ts") -> Column:
    return F.avg(x).over(order(keys, ts).rowsBetween(-(width - 1), 0))


def easter_sunday(year: int) -> dt.date:
    """By the anonymous Gregorian computus."""
    a, (b, c) = year % 19, divmod(year, 100)
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    last = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * last) // 451
    month, day = divmod(h + last - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


def nsw_holidays(year: int) -> set[dt.date]:
    """Public holidays of New South Wales by the general rules, with weekend substitutes, and the one-off days."""
    easter, day = easter_sunday(year), dt.timedelta(days=1)

    def nth_monday(month: int, n: int) -> dt.date:
        first = dt.date(year, month, 1)
        return first + ((7 - first.weekday()) % 7 + 7 * (n - 1)) * day

    fixed = [dt.date(year, 1, 1), dt.date(year, 1, 26), dt.date(year, 12, 25), dt.date(year, 12, 26)]
    found = {easter - 2 * day, easter - day, easter, easter + day, dt.date(year, 4, 25), nth_monday(6, 2), nth_monday(10, 1), *fixed}
    for d in fixed:
        if d.weekday() >= 5:
            substitute = d + (7 - d.weekday()) * day
            while substitute in found:
                substitute += day
            found.add(substitute)
    return found | {d for d in ONE_OFF if d.year == year}


def holiday_table(spark: SparkSession, first: int, last: int) -> DataFrame:
    days = sorted(d for y in range(first, last + 1) for d in nsw_holidays(y))
    return spark.createDataFrame([(d,) for d in days], "day date")


def holiday_flag(frame: DataFrame, zone: str, first: int, last: int, ts: str = "ts", out: str = "is_holiday") -> DataFrame:
    """The calendar is some twelve rows a year, hence a broadcast."""
    days = holiday_table(frame.sparkSession, first, last).withColumn(out, F.lit(True))
    rows = frame.withColumn("day", F.to_date(to_zone(F.col(ts), "UTC", zone))).join(F.broadcast(days), "day", "left")
    return rows.withColumn(out, F.coalesce(out, F.lit(False))).drop("day")


def day_type(ts: str, zone: str, holiday: str = "is_holiday") -> Column:
    """Holiday first, then weekend, else weekday, of the local day."""
    weekend = F.weekday(to_zone(F.col(ts), "UTC", zone)) >= 5
    return F.when(F.col(holiday), "holiday").when(weekend, "weekend").otherwise("weekday")


def patched(design: DataFrame, overrides: DataFrame, on: list[str], columns: list[str], temp: str = "temp") -> DataFrame:
    """A built design with other weather: the raw columns and the plain degree days follow it, all that else depends on them stays."""
    rows = override(design, overrides, on, columns)
    return rows.withColumns({n: c for n, c in degree_days(F.col(temp)).items() if n in design.columns})


def weather_columns(panel: DataFrame, variables: list[str], source: str) -> DataFrame:
    """The actual or the forecast twins under the actual names."""
    suffix = "_fc" if source == "forecast" else ""
    named = {v: F.col(f"{v}{suffix}").cast("double") for v in variables}
    return panel.withColumns(named)


def override(frame: DataFrame, overrides: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Cells that ``overrides`` has replace the frame's."""
    new = overrides.select(*on, *[F.col(c).alias(f"__{c}") for c in columns])
    return frame.join(new, on, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def build_design(panel: DataFrame, keys: list[str], zone: str, ts: str = "ts", basis: str = "fourier") -> DataFrame:
    """The mean design (65 columns in the Fourier basis), in order: seasons, weather, degree days, thermal memory, lags, calendar, interactions.

    ``panel`` has temp, dew, dni, dhi, wind, apptemp, demand_mw, is_holiday. Lags need a strict grid.
    """
    degrees = degree_days(F.col("temp"))
    columns: dict[str, Column] = seasonal(ts, zone, basis)
    waves = fourier(phases(ts, zone)[0], INTERACTIONS, "day")
    columns |= {v: F.col(v) for v in ("temp", "dew", "dni", "dhi", "wind")}
    columns |= degrees | degree_days(F.col("apptemp"), "_app")
    columns["wind_heating"] = F.col("wind") * degrees["heating"]
    columns |= hinges(F.col("temp"))
    for width in THERMAL:
        for kind in ("cooling", "heating"):
            columns[f"{kind}_mean{width}"] = trailing_mean(degrees[kind], keys, width, ts)
    for k in LAGS:
        columns[f"demand_lag{k}"] = F.lag("demand_mw", k).over(order(keys, ts))
    columns["is_holiday"] = F.col("is_holiday").cast("double")
    weekend = (F.weekday(to_zone(F.col(ts), "UTC", zone)) >= 5).cast("double")
    columns["is_weekend"] = weekend
    for name, x in (("cooling", degrees["cooling"]), ("heating", degrees["heating"]), ("weekend", weekend)):
        for k in range(1, INTERACTIONS + 1):
            columns[f"{name}_sin{k}"], columns[f"{name}_cos{k}"] = x * waves[f"day_sin{k}"], x * waves[f"day_cos{k}"]
    return panel.select(*keys, ts, *[c.alias(n) for n, c in columns.items()])


def variance_design(panel: DataFrame, keys: list[str], zone: str, ts: str = "ts") -> DataFrame:
    daily, _ = phases(ts, zone)
    columns = fourier(daily, VARIANCE_DAILY, "day") | degree_days(F.col("temp"))
    return panel.select(*keys, ts, *[c.alias(n) for n, c in columns.items()])


def recency(origins: DataFrame, series: DataFrame, keys: list[str], value: str, horizon: int = 48, ts: str = "ts") -> DataFrame:
    """Per origin and step: the deviations of the last reading from a day and a week before, its slope and curvature."""
    w = order(keys, ts)
    back = {n: F.lag(value, k).over(w) for n, k in (("y1", 1), ("y2", 2), ("y3", 3), ("day", 49), ("week", 337))}
    at = series.withColumns(back)
    rows = origins.join(at.withColumnRenamed(ts, "origin"), [*keys, "origin"])
    return rows.select(
        *keys,
        "origin",
        F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("horizon_step"),
        (F.col("y1") - F.col("day")).alias("dev_day"),
        (F.col("y1") - F.col("week")).alias("dev_week"),
        (F.col("y1") - F.col("y2")).alias("dev_slope"),
        (F.col("y1") - 2 * F.col("y2") + F.col("y3")).alias("dev_curve"),
    )


def stacked_origin_design(design: DataFrame, origins: DataFrame, keys: list[str], horizon: int = 48, seconds: int = 1800, ts: str = "ts") -> DataFrame:
    """A block of ``horizon`` design rows for each origin."""
    steps = origins.select(*keys, "origin", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("step"))
    steps = steps.withColumn(ts, (F.col("origin") + F.make_dt_interval(secs=F.col("step") * seconds)).cast("timestamp_ntz"))
    return steps.join(design, [*keys, ts])


def anomaly(series: DataFrame, keys: list[str], value: str, step: Column, out: str) -> DataFrame:
    """The value less the mean of its step of the day or week."""
    rows = series.withColumn("__step", step)
    return rows.withColumn(out, F.col(value) - F.avg(value).over(Window.partitionBy(*keys, "__step"))).drop("__step")


def half_hour_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 2 + F.floor(F.minute(ts) / 30)).cast("int")


def half_hour_of_week(ts: Column) -> Column:
    return F.weekday(ts) * 48 + half_hour_of_day(ts)
