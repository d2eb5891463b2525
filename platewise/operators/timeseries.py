"""Daily series: gap filling, weekday features, forecasts, backtests."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from platewise.functions.dates import days_before
from platewise.operators.orders import trailing_window
from platewise.operators.sarimax import ORDERS, Orders, forecasts

VENDOR = ("vendor_id",)
PRODUCT = ("vendor_id", "product_id")

# The default holiday calendar (date, name, region, weight of the effect on orders).
HOLIDAYS = (
    ("2024-12-25", "Christmas Day", "India", 10),
    ("2025-01-01", "New Year's Day", "India", 10),
    ("2025-01-14", "Makar Sankranti / Pongal", "India", 8),
    ("2025-01-26", "Republic Day", "India", 10),
    ("2025-02-26", "Maha Shivaratri", "India", 9),
    ("2025-03-14", "Holi", "India", 9),
    ("2023-03-30", "Ugadi/ Godi Padva", "India", 7),
    ("2023-03-31", "Eid", "India", 5),
)


def holiday_calendar(spark: SparkSession, rows: Sequence[tuple] = HOLIDAYS) -> DataFrame:
    """A listed calendar as a frame of literals, whose size the optimizer sees."""
    days = [
        F.struct(
            F.lit(day).cast("date").alias("date"), F.lit(name).alias("holiday"), F.lit(region).alias("region"),
            F.lit(weight).alias("weightage"),
        )
        for day, name, region, weight in rows
    ]
    return spark.range(1).select(F.inline(F.array(*days)))


def daily_spine(daily: DataFrame, series: Sequence[str] = VENDOR, date: str = "created_date") -> DataFrame:
    """One row per day between the first and last day of each series; missing values are null."""
    spans = daily.groupBy(*series).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    days = spans.select(*series, F.explode(F.sequence("_first", "_last")).alias(date))
    return days.join(daily, [*series, date], "left")


def ffill_daily(
    spine: DataFrame, value: str = "order_count", series: Sequence[str] = VENDOR, date: str = "created_date"
) -> DataFrame:
    past = Window.partitionBy(*series).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return spine.withColumn(value, F.last(value, ignorenulls=True).over(past))


def _monday_zero(date: str) -> Column:
    return F.weekday(F.col(date))


def dow_features(df: DataFrame, date: str = "created_date") -> DataFrame:
    """Weekday indicators dow_1 (Tuesday) … dow_6 (Sunday); Monday is the base."""
    return df.withColumns({f"dow_{k}": (_monday_zero(date) == k).cast("double") for k in range(1, 7)})


def forecast_frame(
    daily: DataFrame, horizon: int = 28, series: Sequence[str] = VENDOR, date: str = "created_date"
) -> DataFrame:
    """The ``horizon`` days after each series' last day, with the same indicators."""
    last = daily.groupBy(*series).agg(F.max(date).alias("_last"))
    future = last.select(*series, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))).alias(date))
    return dow_features(future, date)


def holiday_features(df: DataFrame, holidays: DataFrame, date: str = "created_date") -> DataFrame:
    """Name and weight of the holiday on each date, weight 0 on other days; of several the heaviest."""
    calendar = holidays.groupBy(F.col("date").alias(date)).agg(
        F.max_by("holiday", F.struct("weightage", "holiday")).alias("holiday"), F.max("weightage").alias("weightage")
    )
    return df.join(calendar, date, "left").na.fill(0, ["weightage"])


def schedule_mask(schedules: DataFrame) -> DataFrame:
    """Per vendor with active schedules, the Monday-first weekdays (0–6) it serves."""
    served = F.sort_array(F.collect_set(F.pmod(F.col("day_of_week") + 6, F.lit(7)).cast("int")))
    return schedules.filter("active = 1").groupBy("vendor_id").agg(served.alias("served_days"))


def seasonal_forecast(
    daily: DataFrame,
    as_of: dt.date,
    horizon: int,
    series: Sequence[str] = VENDOR,
    schedules: DataFrame | None = None,
    holidays: DataFrame | None = None,
    window_days: int = 60,
    value: str = "order_count",
    date: str = "created_date",
) -> DataFrame:
    """Day-level forecast from the weekday means of the trailing window.

    base(weekday) · holiday factor · schedule factor, rounded. The holiday
    factor is 1 − (1 − r)·weight/10 with r the weekend mean over the weekday
    mean, clamped to 0…1; the schedule factor is 0 on weekdays a vendor with
    schedules does not serve. One partial aggregation per series holds
    everything the horizon needs.
    """
    weekday = _monday_zero(date)
    history = trailing_window(daily, as_of, window_days, date).filter(F.col(date) <= F.lit(as_of))
    mean = lambda condition: F.avg(F.when(condition, F.col(value)))
    stats = history.groupBy(*series).agg(
        F.avg(value).alias("overall"),
        mean(weekday >= 5).alias("weekend"),
        mean(weekday < 5).alias("weekdays"),
        F.array(*[mean(weekday == k) for k in range(7)]).alias("means"),
    )
    ratio = F.when(F.col("weekdays") > 0, F.col("weekend") / F.col("weekdays"))
    stats = stats.select(
        *series,
        "overall",
        "means",
        F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)), F.lit(0.0)).alias("r"),
    )
    days = F.sequence(days_before(as_of, -1), days_before(as_of, -horizon))
    if schedules is not None:
        stats = stats.join(schedule_mask(schedules), "vendor_id", "left")
        served = F.col("served_days").isNull() | F.array_contains("served_days", _monday_zero("date"))
    else:
        served = F.lit(True)
    future = stats.withColumn("date", F.explode(days))
    if holidays is not None:
        future = holiday_features(future, holidays, "date")
    else:
        future = future.withColumns({"holiday": F.lit(None).cast("string"), "weightage": F.lit(0)})
    base = F.coalesce(F.get("means", _monday_zero("date")), F.col("overall"))
    factor = 1 - (1 - F.col("r")) * F.col("weightage") / 10
    return (
        future.withColumns({"base": base, "holiday_factor": factor, "schedule_factor": served.cast("int")})
        .withColumn(
            value, F.round(F.col("base") * F.col("holiday_factor") * F.col("schedule_factor")).cast("bigint")
        )
        .select(
            *series,
            "date",
            value,
            F.concat(
                F.lit("base "), F.round("base", 2).cast("decimal(18,2)").cast("string"),
                F.lit(", holiday factor "), F.round("holiday_factor", 2).cast("decimal(18,2)").cast("string"),
                F.lit(", schedule factor "), F.col("schedule_factor").cast("string"),
            ).alias("reasoning"),
        )
    )


def product_forecast(
    daily: DataFrame,
    menu_ingredients: DataFrame,
    comments: DataFrame,
    as_of: dt.date,
    horizon: int = 30,
    holidays: DataFrame | None = None,
) -> DataFrame:
    """Forecast per (vendor, product) with the product's ingredients and review summary.

    Only products with ingredients are forecast. ``menu_ingredients`` is unique
    by (vendor, product).
    """
    known = menu_ingredients.select("vendor_id", "product_id", "product_name", "ingredients")
    feedback = comments.groupBy("vendor_id", F.col("order_items").alias("product_name")).agg(
        F.count("*").alias("reviews"),
        F.round(F.avg(F.split_part("rating", F.lit("/"), F.lit(1)).cast("double")), 4).alias("average_rating"),
    )
    described = known.join(feedback, ["vendor_id", "product_name"], "left").na.fill(0, ["reviews"])
    forecast = seasonal_forecast(daily, as_of, horizon, PRODUCT, holidays=holidays)
    return forecast.drop("reasoning").join(described, ["vendor_id", "product_id"])


def item_level_forecast(
    product_counts: DataFrame,
    as_of: dt.date,
    horizon: int = 7,
    schedules: DataFrame | None = None,
    holidays: DataFrame | None = None,
    window_days: int = 90,
) -> DataFrame:
    """Forecast per (vendor, product, name)."""
    return seasonal_forecast(
        product_counts, as_of, horizon, (*PRODUCT, "product_name"), schedules, holidays, window_days
    )


def predicted_vs_actual(forecast: DataFrame, actual: DataFrame, series: Sequence[str] = VENDOR) -> DataFrame:
    """Forecast rows with the orders that came; 0 where none did."""
    came = actual.select(*series, F.col("created_date").alias("date"), F.col("order_count").alias("actual_count"))
    return (
        forecast.select(*series, "date", F.col("order_count").alias("predicted_count"))
        .join(came, [*series, "date"], "left")
        .na.fill(0, ["actual_count"])
    )


def forecast_backtest(compared: DataFrame, series: Sequence[str] = VENDOR) -> DataFrame:
    """Error of each predicted day, with the series' median and absolute error.

    The percentage divides by the prediction and is 0 where that is not
    positive, which flatters low forecasts; judge by the mean absolute error and
    the error relative to the actual orders. A series has one row per day of
    the horizon, which bounds the window.
    """
    each = Window.partitionBy(*series)
    error = F.abs(F.col("predicted_count") - F.col("actual_count"))
    return (
        compared.withColumn("absolute_error", error)
        .withColumn(
            "difference_percentage",
            F.when(F.col("predicted_count") > 0, F.col("absolute_error") / F.col("predicted_count") * 100).otherwise(0.0),
        )
        .withColumn("median_value", F.round(F.median("difference_percentage").over(each), 4))
        .withColumn("mean_absolute_error", F.round(F.avg("absolute_error").over(each), 4))
        .withColumn(
            "error_to_actual",
            F.round(F.sum("absolute_error").over(each) / F.nullif(F.sum("actual_count").over(each), F.lit(0)), 4),
        )
        .withColumn("difference_percentage", F.round("difference_percentage", 4))
    )


# --- seasonal ARIMA ---------------------------------------------------------

# Shorter series, in days after differencing, have too little to fit.
MIN_FITTED = 21
# Days that the weekday means of such series are taken of.
RECENT_DAYS = 60
# Series that are fitted together.
BATCH_SERIES = 128
SARIMAX, WEEKDAY_MEAN = "sarimax", "weekday_mean"


def weekday_means(y: np.ndarray, horizon: int, season: int = ORDERS.season, recent: int = RECENT_DAYS) -> np.ndarray:
    """The mean of each weekday over the last days, or of all of them for a weekday that is not among them."""
    y = y[-recent:]
    phase = (np.arange(len(y)) - len(y)) % season
    means = [y[phase == k].mean() if (phase == k).any() else y.mean() for k in range(season)]
    return np.array([means[h % season] for h in range(horizon)])


def _forecast_batch(batch: list[tuple], horizon: int, orders: Orders) -> Iterator[tuple[tuple, str, np.ndarray]]:
    """Key, method and forecast of each of a batch of (key, values, regressors so far, regressors to come)."""
    lost = len(orders.differences) - 1
    long = [b for b in batch if len(b[1]) - lost >= MIN_FITTED]
    short = [b for b in batch if len(b[1]) - lost < MIN_FITTED]
    if long:
        found = forecasts([b[1] for b in long], [b[2] for b in long], [b[3] for b in long], horizon, orders)
        yield from ((b[0], SARIMAX, values) for b, values in zip(long, found, strict=True))
    yield from ((b[0], WEEKDAY_MEAN, weekday_means(b[1], horizon, orders.season)) for b in short)


def sarimax_forecast(
    filled: DataFrame,
    horizon: int = 28,
    series: Sequence[str] = VENDOR,
    date: str = "created_date",
    regressors: DataFrame | None = None,
    orders: Orders = ORDERS,
    training_days: int | None = None,
) -> DataFrame:
    """Seasonal ARIMA per series on a gap-free daily frame, with weekday indicators and further regressors.

    ``regressors`` has the columns of ``series`` (or none of them, for all series), ``date`` and numbers,
    for the days so far and to come; a missing day counts as 0. Orders are (1,1,1)(1,1,1) with season 7
    by default, where weekday indicators vanish under the seasonal difference. A fit takes all days, or
    the last ``training_days`` of each series. ``method`` says how a forecast was made: by the fit, or by
    weekday means where a series is too short for it. Forecasts are rounded half to even and never below
    0. Days without a count are left out. A task reads its series one after another and fits
    ``BATCH_SERIES`` of them at a time; a series has a row per day.
    """
    keys = list(series)
    counted = filled.filter("order_count IS NOT NULL")
    days = counted.select(*keys, date, F.col("order_count").cast("double").alias("order_count"))
    first = F.min(date) if training_days is None else F.greatest(F.min(date), F.date_sub(F.max(date), training_days - 1))
    spans = days.groupBy(*keys).agg(first.alias("_first"), F.date_add(F.max(date), horizon).alias("_end"))
    spine = spans.select(*keys, F.explode(F.sequence("_first", "_end")).alias(date))
    frame = dow_features(spine.join(days, [*keys, date], "left"), date)
    columns = [c for c in frame.columns if c.startswith("dow_")]
    if regressors is not None:
        shared = [k for k in keys if k in regressors.columns] + [date]
        more = [c for c in regressors.columns if c not in shared]
        frame = frame.join(regressors, shared, "left").fillna(0.0, more)
        columns += more
    frame = frame.select(*keys, date, "order_count", F.array(*(F.col(c).cast("double") for c in columns)).alias("regressors"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: list[tuple]) -> pa.RecordBatch:
            ends = {key: end for key, *_, end in batch}
            out = [(key, method, values) for key, method, values in _forecast_batch([b[:4] for b in batch], horizon, orders)]
            rows = [
                (*key, ends[key] + dt.timedelta(days=h + 1), method, max(int(np.rint(v)), 0))
                for key, method, values in out
                for h, v in enumerate(values)
            ]
            columns = [pa.array(c, kinds[i]) for i, c in enumerate(zip(*rows, strict=True))]
            return pa.RecordBatch.from_arrays(columns, [*keys, "date", "method", "order_count"])

        ready: list[tuple] = []
        for key, rows in groupby(_day_rows(batches, keys, date), key=lambda r: r[0]):
            _, dates, counts, factors = zip(*rows, strict=True)
            known = sum(c is not None for c in counts)
            matrix = np.array(factors, float)
            ready.append((key, np.array(counts[:known], float), matrix[:known], matrix[known:], dates[known - 1]))
            if len(ready) >= BATCH_SERIES:
                yield made(ready)
                ready = []
        if ready:
            yield made(ready)

    kinds = [*(to_arrow_type(filled.schema[k].dataType) for k in keys), pa.date32(), pa.string(), pa.int64()]
    schema = ", ".join(f"{name} {filled.schema[name].dataType.simpleString()}" for name in keys)
    ordered = frame.repartition(*keys).sortWithinPartitions(*keys, date)
    return ordered.mapInArrow(fit, f"{schema}, date date, method string, order_count bigint")


def _day_rows(batches: Iterator[pa.RecordBatch], keys: Sequence[str], date: str) -> Iterator[tuple]:
    for batch in batches:
        names = [*keys, date, "order_count", "regressors"]
        for *key, day, count, factors in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            yield tuple(key), day, count, factors
