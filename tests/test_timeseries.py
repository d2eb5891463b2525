import datetime as dt

import numpy as np
import pytest

from platewise.operators import ingredients, sarimax, timeseries

AS_OF = dt.date(2025, 1, 31)  # a Friday
DAILY = "vendor_id bigint, created_date date, order_count bigint"


def daily(spark, counts, vendor=1, end=AS_OF):
    days = [(vendor, end - dt.timedelta(days=len(counts) - 1 - i), n) for i, n in enumerate(counts)]
    return spark.createDataFrame([x for x in days if x[2] is not None], DAILY)


def test_gaps_are_filled_forward(spark):
    spine = timeseries.daily_spine(daily(spark, [3, None, None, 5]))
    assert [r["order_count"] for r in spine.orderBy("created_date").collect()] == [3, None, None, 5]
    filled = timeseries.ffill_daily(spine).orderBy("created_date").collect()
    assert [r["order_count"] for r in filled] == [3, 3, 3, 5]


def test_weekday_indicators(spark):
    found = timeseries.dow_features(daily(spark, [1] * 7)).orderBy("created_date").collect()
    monday = next(r for r in found if r["created_date"].weekday() == 0)
    assert sum(monday[f"dow_{k}"] for k in range(1, 7)) == 0.0
    for r in found:
        if r["created_date"].weekday():
            assert r[f"dow_{r['created_date'].weekday()}"] == 1.0


def test_forecast_frame(spark):
    found = timeseries.forecast_frame(daily(spark, [1, 2]), 28).orderBy("created_date").collect()
    assert len(found) == 28 and found[0]["created_date"] == dt.date(2025, 2, 1)


def week(weekday, weekend, weeks=5):
    end = AS_OF.weekday()
    return [weekend if (end - i) % 7 >= 5 else weekday for i in range(7 * weeks - 1, -1, -1)]


def test_seasonal_forecast(spark):
    holidays = timeseries.holiday_calendar(spark, [(dt.date(2025, 2, 4), "Feast", "x", 10), (dt.date(2025, 2, 5), "Half", "x", 5)])
    schedules = spark.createDataFrame([(1, k, 1) for k in (0, 1, 2, 3, 4, 6)], "vendor_id bigint, day_of_week int, active int")
    found = timeseries.seasonal_forecast(daily(spark, week(100, 20)), AS_OF, 7, schedules=schedules, holidays=holidays)
    by_day = {r["date"]: r["order_count"] for r in found.collect()}
    assert [by_day[dt.date(2025, 2, k)] for k in range(1, 8)] == [20, 20, 100, 20, 60, 100, 0]


def test_weekday_without_history_takes_the_mean(spark):
    found = timeseries.seasonal_forecast(daily(spark, [10, 30]), AS_OF, 3).orderBy("date").collect()
    assert [r["order_count"] for r in found] == [20, 20, 20]


def test_history_outside_the_window_is_ignored(spark):
    old = daily(spark, [1000] * 20, end=AS_OF - dt.timedelta(days=60)).unionAll(daily(spark, [10] * 7))
    found = timeseries.seasonal_forecast(old, AS_OF, 7).collect()
    assert {r["order_count"] for r in found} == {10}


def test_backtest(spark):
    compared = spark.createDataFrame(
        [(1, dt.date(2025, 2, 1), 0, 5), (1, dt.date(2025, 2, 2), 10, 0), (1, dt.date(2025, 2, 3), 10, 8)],
        "vendor_id bigint, date date, predicted_count bigint, actual_count bigint",
    )
    found = timeseries.forecast_backtest(compared).orderBy("date").collect()
    assert [r["difference_percentage"] for r in found] == [0.0, 100.0, 20.0]
    assert [r["absolute_error"] for r in found] == [5, 10, 2]
    assert found[0]["median_value"] == 20.0
    assert found[0]["mean_absolute_error"] == pytest.approx(5.6667)


def simulated(rng, coefficients, orders, days, variance=1.0):
    """A stationary process with the given coefficients, by its own recursion."""
    values, shocks = (m[0] for m in sarimax._expanded(np.array([coefficients]), orders))
    noise, w = rng.normal(0, variance**0.5, days + 600), np.zeros(days + 600)
    for t in range(20, len(w)):
        w[t] = values @ w[t - len(values) : t][::-1] + shocks @ noise[t - len(shocks) + 1 : t + 1][::-1]
    return w[600:]


def covariances(coefficients, orders, lags):
    """Autocovariances from the weights of past shocks, by their recursion."""
    values, shocks = (m[0] for m in sarimax._expanded(np.array([coefficients]), orders))
    psi = np.zeros(4000)
    for k in range(len(psi)):
        psi[k] = (shocks[k] if k < len(shocks) else 0) + sum(v * psi[k - i - 1] for i, v in enumerate(values) if k > i)
    return np.array([psi[: len(psi) - h] @ psi[h:] for h in range(lags)])


@pytest.mark.parametrize("coefficients", [(0.5, 0.3, 0.4, -0.6), (-0.7, 0.0, 0.0, 0.5), (0.0, 0.0, 0.0, 0.0)])
def test_likelihood_equals_the_normal_density(coefficients):
    """The filter's likelihood is that of the joint normal distribution of all days."""
    orders, rng = sarimax.ORDERS, np.random.default_rng(4)
    w = rng.normal(size=40)
    matrix = covariances(coefficients, orders, 40)[np.abs(np.subtract.outer(np.arange(40), np.arange(40)))]
    variance = w @ np.linalg.solve(matrix, w) / 40
    expected = -0.5 * (40 * np.log(2 * np.pi * variance) + np.linalg.slogdet(matrix)[1] + 40)
    data = np.zeros((2, 55, 1))  # the second entry is shorter and filled up
    data[0, :40, 0], data[1, :25, 0] = w, w[:25]
    found = sarimax.filtered(data, np.array([40, 25]), np.array([coefficients] * 2))
    assert found.loglikelihood[0] == pytest.approx(expected, abs=1e-6)
    assert found.variance[0] == pytest.approx(variance)
    alone = sarimax.filtered(data[1:, :25], np.array([25]), np.array([coefficients]))
    assert found.loglikelihood[1] == pytest.approx(alone.loglikelihood[0])
    assert np.allclose(found.state[1], alone.state[0])


def test_regressor_weights_are_generalised_least_squares():
    orders, rng = sarimax.Orders(seasonal_d=0, d=0), np.random.default_rng(5)
    x, coefficients = rng.normal(size=(60, 2)), (0.6, 0.2, 0.3, 0.1)
    y = x @ [3.0, -2.0] + simulated(rng, coefficients, orders, 60)
    matrix = covariances(coefficients, orders, 60)[np.abs(np.subtract.outer(np.arange(60), np.arange(60)))]
    inverse = np.linalg.inv(matrix)
    expected = np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ y)
    found = sarimax.filtered(np.column_stack([y, x])[None], np.array([60]), np.array([coefficients]), orders)
    assert np.allclose(found.weights[0], expected, atol=1e-6)


def test_known_processes_are_recovered():
    orders, rng = sarimax.ORDERS, np.random.default_rng(6)
    truth = [(0.6, 0.0, 0.0, -0.6), (-0.4, -0.5, 0.3, -0.7), (0.0, -0.6, 0.0, -0.5)]
    data = np.stack([simulated(rng, c, orders, 1200) for c in truth])[:, :, None]
    found = sarimax.fitted(data, np.full(3, 1200))
    for coefficients, estimate, rows in zip(truth, found, data, strict=True):
        best = sarimax.filtered(rows[None], np.array([1200]), estimate[None])
        true = sarimax.filtered(rows[None], np.array([1200]), np.array([coefficients]))
        assert best.loglikelihood[0] >= true.loglikelihood[0] - 0.5
    assert np.abs(found[0] - truth[0]).max() < 0.2 and np.abs(found[1] - truth[1]).max() < 0.25


def test_arima_follows_a_weekly_pattern():
    rng = np.random.default_rng(1)
    pattern = np.array([50, 80, 82, 75, 40, 6, 4])
    y = np.array([pattern[i % 7] + 0.1 * i for i in range(210)]) + rng.normal(0, 1.5, 210)
    nothing = np.zeros((210, 0)), np.zeros((28, 0))
    forecast = sarimax.forecasts([y], [nothing[0]], [nothing[1]], 28)[0]
    expected = np.array([pattern[i % 7] + 0.1 * i for i in range(210, 238)])
    assert np.abs(forecast - expected).mean() < 2.5


def test_weekday_indicators_count_without_a_seasonal_difference(spark):
    rng = np.random.default_rng(2)
    pattern = np.array([50, 80, 82, 75, 40, 6, 14])
    days = daily(spark, [int(v) for v in np.rint(np.tile(pattern, 20) + rng.normal(0, 1, 140))])
    found = timeseries.sarimax_forecast(days, 14, orders=sarimax.Orders(seasonal_p=0, seasonal_d=0, seasonal_q=0)).orderBy("date").collect()
    assert np.abs(np.array([r["order_count"] for r in found]) - np.tile(pattern, 2)).mean() < 2


def test_further_regressors(spark):
    """An offer on known days lifts the forecast of the days it is planned for."""
    rng = np.random.default_rng(3)
    on = np.zeros(140)
    on[rng.choice(120, 25, replace=False)] = 1
    on[[123, 130]] = 1
    counts = 100 + 10 * (np.arange(120) % 7) + 40 * on[:120] + rng.normal(0, 2, 120)
    days = daily(spark, [int(c) for c in np.rint(counts)])
    first = days.agg({"created_date": "min"}).first()[0]
    offers = spark.createDataFrame([(first + dt.timedelta(days=i), float(v)) for i, v in enumerate(on)], "created_date date, offer double")
    plain = {r["date"]: r["order_count"] for r in timeseries.sarimax_forecast(days, 14).collect()}
    lifted = {r["date"]: r["order_count"] for r in timeseries.sarimax_forecast(days, 14, regressors=offers).collect()}
    for i in (123, 130):
        assert 25 < lifted[first + dt.timedelta(days=i)] - plain[first + dt.timedelta(days=i)] < 60


def test_arima_methods(spark):
    falling = daily(spark, [max(0, 300 - 4 * i) for i in range(75)])
    found = timeseries.sarimax_forecast(falling).collect()
    assert len(found) == 28 and min(r["order_count"] for r in found) >= 0
    assert {r["method"] for r in found} == {timeseries.SARIMAX}
    short = timeseries.sarimax_forecast(daily(spark, [5] * 10), 7).collect()
    assert [(r["order_count"], r["method"]) for r in short] == [(5, timeseries.WEEKDAY_MEAN)] * 7
    uncounted = daily(spark, [5] * 10).selectExpr("vendor_id", "created_date", "CAST(NULL AS bigint) AS order_count")
    assert timeseries.sarimax_forecast(uncounted).count() == 0
    jump = timeseries.sarimax_forecast(daily(spark, [100] * 60 + [5] * 60), 7, training_days=50).collect()
    assert [r["order_count"] for r in jump] == [5] * 7
    constant = timeseries.sarimax_forecast(daily(spark, [5] * 60), 7).collect()
    assert [(r["order_count"], r["method"]) for r in constant] == [(5, timeseries.SARIMAX)] * 7


FORECAST = "vendor_id bigint, product_id bigint, product_name string, date date, order_count bigint"
RECIPES = "id bigint, vendor_id bigint, menu_name string, ingredients string"


def test_ration_requirements(spark):
    forecast = spark.createDataFrame(
        [(1, 1, "A", AS_OF, 1), (1, 1, "A", dt.date(2025, 2, 1), 1), (1, 2, "B", AS_OF, 3), (1, 3, "Unknown", AS_OF, 9)], FORECAST
    )
    atta = '[{"ingredient":"Atta","measurement_unit":"%s","measurement_value":%d}]'
    recipes = spark.createDataFrame(
        [(1, 1, "A", atta % ("g", 999)), (2, 1, "A", atta % ("g", 100)), (3, 1, "B", atta % ("ml", 50)), (4, 2, "A", atta % ("g", 1))], RECIPES
    )
    found = ingredients.ration_requirements(forecast, recipes).collect()
    assert [tuple(r) for r in found] == [(1, "Atta", "g", 350.0, "A, B", True)]


def test_append_missing(spark, rows):
    found = spark.createDataFrame([(1, "A", "x"), (1, "B", "y"), (1, "B", "z")], "vendor_id bigint, menu_name string, ingredients string")
    stored = spark.createDataFrame([(1, 1, "A", "[]")], RECIPES)
    assert rows(ingredients.append_missing(found, stored)) == [(1, "B", "y")]
