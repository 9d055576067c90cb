"""Gap repair, outliers and physical limits, as window expressions over a series on a strict grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .buckets import in_buckets, seconds, with_neighbours
from .features import holiday_flag
from .timegrid import HALF_HOUR, order

# Physical limits of the weather and demand columns.
PHYSICAL_BOUNDS = {"demand_mw": (0.0, 20000.0), "temp": (-15.0, 55.0), "dew": (-30.0, 40.0), "dni": (0.0, 1500.0), "dhi": (0.0, 1500.0), "ghi": (0.0, 1500.0), "apptemp": (-25.0, 65.0), "wind": (0.0, 250.0)}
NORMAL_MAD = 1.4826


def interpolate(series: DataFrame, keys: list[str], value: str, out: str, edge: str = "both", limit: int | None = None, ts: str = "ts", bucket: int | None = None) -> DataFrame:
    """Linear in time between readings.

    After the last reading its value stays; before the first, ``both`` takes the first value and ``forward`` leaves null. With a ``limit`` only
    the first so many rows of each gap are filled, of long gaps too. With a ``bucket`` (seconds) a task has one bucket of a series.
    """
    rows = with_neighbours(series, keys, [value], ts, bucket)
    return rows.withColumn(out, _between(value, edge, limit, ts)).drop("__row", f"__a_{value}", f"__b_{value}")


def interpolate_all(frame: DataFrame, keys: list[str], edges: dict[str, str], limit: int | None = None, ts: str = "ts", bucket: int | None = None) -> DataFrame:
    """:func:`interpolate` of many columns in place, by name and edge: one sort forward and one back for all of them."""
    rows = with_neighbours(frame, keys, list(edges), ts, bucket)
    return rows.withColumns({c: _between(c, edge, limit, ts) for c, edge in edges.items()}).drop("__row", *[f"__{s}_{c}" for s in "ab" for c in edges])


def _between(value: str, edge: str, limit: int | None, ts: str) -> Column:
    a, b, x = F.col(f"__a_{value}"), F.col(f"__b_{value}"), F.col(value).cast("double")
    inside = a["v"] + (b["v"] - a["v"]) * (seconds(ts) - a["t"]) / (b["t"] - a["t"])
    filled = F.coalesce(x, F.when(b.isNotNull(), inside), a["v"], *([b["v"]] if edge == "both" else []))
    return filled if limit is None else F.when(x.isNotNull() | (F.col("__row") - a["__row"] <= limit), filled)


def seasonal_fill(series: DataFrame, keys: list[str], value: str, out: str, lags: tuple[int, ...] = (336, 672), limit: int = 2, ts: str = "ts", bucket: int | None = None, step: int = HALF_HOUR) -> DataFrame:
    """Short interpolation, then the value one and two seasons back, then interpolation both ways; ``{out}_imputed`` marks what was missing.

    With a ``bucket`` (seconds) a task has one bucket of a series, which then lies on its strict grid of ``step`` seconds.
    """

    def lagged(rows: DataFrame, by: list[str]) -> DataFrame:
        for lag in lags:
            rows = rows.withColumn("__f", F.coalesce("__f", F.lag("__f", lag).over(order(by, ts))))
        return rows

    rows = interpolate(series, keys, value, "__f", limit=limit, ts=ts, bucket=bucket)
    rows = lagged(rows, keys) if bucket is None else in_buckets(rows, keys, sum(lags), 0, max(1, bucket // step), lagged, ts, step)
    rows = interpolate(rows, keys, "__f", out, ts=ts, bucket=bucket)
    return rows.withColumn(f"{out}_imputed", F.col(value).isNull()).drop("__f")


def hampel_flags(series: DataFrame, keys: list[str], value: str, window: int = 336, k: float = 8.0, ts: str = "ts", bucket: int | None = None, step: int = HALF_HOUR) -> DataFrame:
    """Adds rolling_median, rolling_mad and is_outlier: each row's deviation from its own centred median against the median of those deviations.

    With a ``bucket`` (seconds) a task has one bucket of a series and a window's rows on both sides; the series then lies on its strict grid of ``step`` seconds.
    """
    if bucket is not None:  # a deviation reaches half a window, the median of deviations another half
        return in_buckets(series, keys, window, window, max(1, bucket // step), lambda rows, by: hampel_flags(rows, by, value, window, k, ts), ts, step)
    half, least = window // 2, window // 4
    w = order(keys, ts).rowsBetween(-half, window - half - 1)

    def rolling(x: str) -> Column:
        return F.when(F.count(x).over(w) >= least, F.percentile(x, F.lit(0.5)).over(w))

    rows = series.withColumn("rolling_median", rolling(value)).withColumn("__d", F.abs(F.col(value) - F.col("rolling_median")))
    rows = rows.withColumn("rolling_mad", rolling("__d"))
    return rows.withColumn("is_outlier", F.coalesce(F.col("__d") > k * NORMAL_MAD * F.col("rolling_mad"), F.lit(False))).drop("__d")


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def bounds_for(column: str) -> tuple[float, float] | None:
    if column in PHYSICAL_BOUNDS:
        return PHYSICAL_BOUNDS[column]
    return PHYSICAL_BOUNDS.get(column.replace("_fc", "").split("_", 1)[0])


def make_physical(frame: DataFrame, elevation: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Clips every bounded column, or those named; with a solar elevation, irradiance is zero at night."""
    out = {}
    for c in frame.columns if columns is None else columns:
        if (limits := bounds_for(c)) is not None:
            x = clip(F.col(c), *limits)
            if elevation is not None and c.split("_")[0] in ("dni", "dhi", "ghi"):
                x = F.when(elevation <= 0, F.lit(0.0)).otherwise(x)
            out[c] = x
    return frame.withColumns(out)


def solar_elevation(ts: str, latitude: float, longitude: float) -> Column:
    """Degrees above the horizon by NOAA's general solar position equations, for a UTC timestamp. Its numbers are fixed values."""
    clock = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    gamma = 2 * F.pi() / 365 * (F.dayofyear(ts) - 1 + (clock - 12) / 24)
    declination = 0.006918 - 0.399912 * F.cos(gamma) + 0.070257 * F.sin(gamma) - 0.006758 * F.cos(2 * gamma) + 0.000907 * F.sin(2 * gamma) - 0.002697 * F.cos(3 * gamma) + 0.00148 * F.sin(3 * gamma)
    equation = 229.18 * (0.000075 + 0.001868 * F.cos(gamma) - 0.032077 * F.sin(gamma) - 0.014615 * F.cos(2 * gamma) - 0.040849 * F.sin(2 * gamma))
    angle = F.radians((clock * 60 + equation + 4 * longitude) / 4 - 180)
    lat = F.radians(F.lit(latitude))
    height = F.sin(lat) * F.sin(declination) + F.cos(lat) * F.cos(declination) * F.cos(angle)
    return F.degrees(F.asin(F.least(F.greatest(height, F.lit(-1.0)), F.lit(1.0))))


def build_panel(demand: DataFrame, actual: DataFrame, forecast: DataFrame, keys: list[str], variables: list[str], latitude: float, longitude: float, zone: str, years: tuple[int, int], ts: str = "ts", bucket: int | None = None) -> DataFrame:
    """The processed panel, with a flag for every repair, which :func:`panel_report` counts.

    ``demand`` (keys, ts, demand_mw) lies on its strict grid and decides the rows. ``actual`` and ``forecast`` (keys, ts, variables) are hourly.
    Demand is filled, screened and filled again. Actual weather is interpolated, with its nearest value at the ends. Forecasts bridge eight hours
    and are interpolated, but not before their first value; what stays missing falls back to the actuals. Both are clipped to physical
    bounds, and irradiance is zero at night. ``is_holiday`` follows the local day, for the years given (both included). With a ``bucket`` (seconds) a
    long series is many tasks' work.
    """
    filled = seasonal_fill(demand, keys, "demand_mw", "__filled", ts=ts, bucket=bucket)
    screened = hampel_flags(filled, keys, "__filled", ts=ts, bucket=bucket).withColumn("__screened", F.when(~F.col("is_outlier"), F.col("__filled")))
    rows = interpolate(screened, keys, "__screened", "__clean", ts=ts, bucket=bucket)
    rows = rows.select(*keys, ts, F.col("__clean").alias("demand_mw"), F.col("demand_mw").isNull().alias("demand_missing"), F.col("is_outlier").alias("demand_outlier"), (F.col("__filled_imputed") | F.col("is_outlier")).alias("demand_imputed"), F.lit(True).alias("__grid"))
    issued = [f"{v}_fc" for v in variables]
    held = forecast.select(*keys, ts, *[F.col(v).alias(f"{v}_fc") for v in variables], *[F.col(v).isNull().alias(f"{v}_fc_gap") for v in variables])
    held = interpolate_all(held, keys, dict.fromkeys(issued, "forward"), limit=8, ts=ts, bucket=bucket)
    both = rows.join(actual.select(*keys, ts, *variables), [*keys, ts], "full").join(held, [*keys, ts], "full")
    both = interpolate_all(both, keys, dict.fromkeys(variables, "both") | dict.fromkeys(issued, "forward"), ts=ts, bucket=bucket)
    gaps = {f"{v}_fc_gaps": F.count_if(f"{v}_fc_gap").over(Window.partitionBy(*keys)) for v in variables}
    panel = both.withColumns(gaps).filter("__grid").drop("__grid", *[f"{v}_fc_gap" for v in variables])
    panel = panel.withColumns({f"{v}_fallback": F.col(f"{v}_fc").isNull() for v in variables}).withColumns({f"{v}_fc": F.coalesce(f"{v}_fc", v) for v in variables})
    panel = make_physical(panel, solar_elevation(ts, latitude, longitude), [*variables, *issued])
    return holiday_flag(panel, zone, *years, ts=ts)


def panel_report(panel: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Repairs of :func:`build_panel` as rows (keys, column, repair, n); ``unfilled`` demand means gaps too long to fill."""
    counts = [("demand_mw", "missing", F.count_if("demand_missing")), ("demand_mw", "outliers", F.count_if("demand_outlier")), ("demand_mw", "imputed", F.count_if("demand_imputed")), ("demand_mw", "unfilled", F.count_if(F.col("demand_mw").isNull()))]
    for v in variables:
        counts += [(f"{v}_fc", "gaps", F.max(f"{v}_fc_gaps")), (f"{v}_fc", "from actuals", F.count_if(f"{v}_fallback"))]
    row = panel.groupBy(*keys).agg(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("repair"), n.cast("long").alias("n")) for c, r, n in counts]).alias("r"))
    return row.select(*keys, F.explode("r").alias("r")).select(*keys, "r.*")


def require_filled(panel: DataFrame, ts: str = "ts") -> None:
    """An error if demand has gaps that no rule could fill."""
    r = panel.filter(F.col("demand_mw").isNull()).agg(F.count("*").alias("n"), F.min(ts).alias("at")).first()
    if r["n"]:
        raise ValueError(f"demand has gaps too long to fill: {r['n']} rows from {r['at']}")


def cleansing_report(demand: DataFrame, keys: list[str], raw: str, flagged: str, imputed: str) -> DataFrame:
    """Counters as rows (keys, counter, n)."""
    counts = demand.groupBy(*keys).agg(F.count_if(F.col(raw).isNull()).alias("missing"), F.count_if(flagged).alias("outliers"), F.count_if(imputed).alias("imputed"), F.count("*").alias("rows"))
    return counts.select(*keys, F.expr("stack(4, 'rows', rows, 'missing', missing, 'outliers', outliers, 'imputed', imputed) AS (counter, n)"))
