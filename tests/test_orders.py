import datetime as dt

from pyspark.sql import functions as F

from platewise.operators import incremental, orders, vendors

DAY = dt.date(2025, 2, 1)


def d(text):
    return dt.date.fromisoformat(text)


def test_trailing_window_is_strict(spark):
    df = spark.createDataFrame([(d("2024-12-03"),), (d("2024-12-04"),), (d("2025-03-01"),)], "created_date date")
    kept = [r[0] for r in orders.trailing_window(df, DAY, 60).collect()]
    assert kept == [d("2024-12-04"), d("2025-03-01")]


def test_date_between_is_inclusive(spark):
    df = spark.createDataFrame([(d(x),) for x in ("2024-01-01", "2024-01-02", "2024-01-04")], "created_date date")
    assert orders.date_between(df, "2024-01-01", "2024-01-02").count() == 2


def test_status_filter_drops_null(spark):
    df = spark.createDataFrame([("new",), ("rejected",), (None,)], "status string")
    assert [r[0] for r in orders.status_filter(df, ("rejected",)).collect()] == ["new"]


def test_best_and_worst_break_ties_by_first_seen(spark, rows):
    totals = spark.createDataFrame(
        [
            (1, "a", 5, 10.0, d("2025-01-02"), 1), (1, "b", 5, 11.0, d("2025-01-01"), 2),
            (1, "c", 2, 12.0, d("2025-01-01"), 3), (1, "d", 2, 13.0, d("2025-01-03"), 4),
            (2, "only", 1, 9.0, d("2025-01-03"), 4),
        ],
        "vendor_id bigint, menu_name string, orders bigint, price double, first_date date, first_product_id bigint",
    )
    found = orders.best_worst_selling(totals).select("vendor_id", "position", "menu_name")
    assert rows(found) == [(1, "best", "b"), (1, "worst", "d"), (2, "best", "only"), (2, "worst", "only")]


def test_next_day_change(spark):
    counts = spark.createDataFrame(
        [(1, 7, "x", d("2025-01-01"), 99), (1, 7, "x", d("2025-01-05"), 10), (1, 7, "x", d("2025-01-07"), 20), (1, 8, "y", d("2025-01-07"), 4)],
        "vendor_id bigint, product_id bigint, product_name string, created_date date, order_count bigint",
    )
    found = {r["product_id"]: r for r in orders.next_day_change(counts).collect()}
    assert (found[7]["this_day_prediction"], found[7]["increase_percentage"]) == (15, -25.0)
    assert (found[8]["this_day_prediction"], found[8]["increase_percentage"]) == (4, 0.0)


def test_attach_product_id(spark, rows):
    named = spark.createDataFrame([(1, "a"), (1, "zzz"), (1, "off")], "vendor_id bigint, product_name string")
    menu = spark.createDataFrame(
        [(1, 5, "a", 1), (1, 6, "a", 1), (2, 9, "a", 1), (1, 7, "off", 0)], "vendor_id bigint, id bigint, name string, active int"
    )
    assert rows(orders.attach_product_id(named, menu)) == [(1, "a", 6), (1, "off", -1), (1, "zzz", -1)]


def test_revenue_uses_fixed_divisors(spark):
    daily = spark.createDataFrame(
        [(1, d("2025-01-01"), 30.0, 3), (1, d("2025-02-01"), 60.0, 6)],
        "vendor_id bigint, created_date date, daily_sales double, total_orders bigint",
    )
    assert {r["month"]: r["avg_daily_sales"] for r in orders.monthly_revenue(daily).collect()} == {"2025-01": 1.0, "2025-02": 2.0}
    assert orders.revenue_totals(daily).first()["avg_daily_sales"] == 1.0
    levels = {r["level"] for r in orders.revenue_rollup(daily).collect()}
    assert levels == {"day", "month", "total"}


def test_minimum_history(spark):
    sales = spark.createDataFrame(
        [(1, 1, d("2025-01-01")), (2, 1, d("2025-01-02")), (3, 2, d("2025-01-02"))], "id bigint, vendor_id bigint, created_date date"
    )
    found = {r["vendor_id"]: r["enough_history"] for r in orders.vendor_daily_orders_range(sales, "2025-01-01", "2025-01-31", 2).collect()}
    assert found == {1: True, 2: False}


def test_schedule_days(spark):
    schedules = spark.createDataFrame(
        [(1, 9, 0, "08:00", "10:00", 1), (1, 9, 1, "09:00", "11:00", 1), (1, 9, 2, "09:00", "11:00", 0)],
        "vendor_id bigint, location_id bigint, day_of_week int, start_time string, end_time string, active int",
    )
    found = vendors.schedule_by_day(schedules).orderBy("day_order").collect()
    assert [r["day_of_week"] for r in found] == ["Monday", "Sunday"]


def test_repeat_customers_of_an_idle_vendor(spark, rows):
    sales = spark.createDataFrame(
        [(1, 1, 5, "new", DAY), (2, 1, 5, "new", DAY), (3, 1, 6, "cancelled", DAY), (4, 1, 7, "new", DAY), (5, 1, 8, None, DAY)],
        "id bigint, vendor_id bigint, employee_id bigint, status string, created_date date",
    )
    vendor = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert rows(vendors.repeat_customers(sales, vendor, DAY)) == [(1, 2, 1, 50.0), (2, 0, 0, 0.0)]


def test_vendor_geo_without_places(spark):
    vendor = spark.createDataFrame([(1,)], "id bigint")
    nothing = "vendor_id bigint, location_id bigint, active int"
    place = spark.createDataFrame([], "id bigint, name string, company_id bigint, address_id bigint, active int")
    named = spark.createDataFrame([], "id bigint, name string")
    address = spark.createDataFrame([], "id bigint, state_id bigint, city_id bigint")
    found = vendors.vendor_geo(vendor, spark.createDataFrame([], nothing), place, address, named, named).first()
    assert found["location_text"] == ""


def test_image_is_the_first(spark, rows):
    menu = spark.createDataFrame([(1,), (2,)], "id bigint")
    images = spark.createDataFrame(
        [("menu", 1, "b", "x.jpg"), ("menu", 1, "a", "y.jpg"), ("vendor", 2, "a", "z.jpg")],
        "reference_type string, reference_id bigint, folder string, file_name string",
    )
    assert rows(vendors.product_image_url(menu, images, "h", "b")) == [(1, "https://h/b/resize_images/a/original_y.jpg"), (2, None)]


def test_hot_vendor_keeps_every_row(spark):
    """One vendor and one order hold most rows; counts stay whole."""
    items = spark.range(30000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS order_id", "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 50 END AS vendor_id",
        "id % 7 AS product_id", "1L AS qty", "2.0D AS price",
    )
    headers = spark.range(30000).selectExpr("id", "id AS employee_id", "'new' AS status", "DATE'2025-01-15' AS created_date")
    menu = spark.range(7).selectExpr("id", "concat('p', id) AS name", "1.5D AS price")
    revenue = orders.daily_revenue(headers, items, menu, DAY)
    assert revenue.agg({"total_orders": "sum"}).first()[0] == 30000
    counts = orders.product_daily_counts(headers, items, menu, DAY)
    assert counts.agg({"order_count": "sum"}).first()[0] == 30000


def test_unknown_statuses(spark, rows):
    df = spark.createDataFrame([("new",), ("cancelled",), ("cancelled",), (None,)], "status string")
    assert rows(orders.unknown_statuses(df)) == [("cancelled", 2)]


STAMPED = "id bigint, vendor_id bigint, created_date date, updated_at timestamp"


def test_only_touched_days_are_computed_again(spark, tmp_path, rows):
    day = lambda n: dt.date(2025, 1, 1) + dt.timedelta(days=n)
    at = lambda n: dt.datetime(2025, 2, 1, n)
    first = [(i, i % 2, day(i % 10), at(i % 3)) for i in range(40)]
    path, count = str(tmp_path / "daily"), lambda df: df.groupBy("vendor_id", "created_date").agg(F.count("*").alias("n"))
    whole = lambda data: rows(count(spark.createDataFrame(data, STAMPED)))
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "daily").rglob("*.parquet")}
    run = lambda data: incremental.refresh_daily(spark.createDataFrame(data, STAMPED), count, path)
    stored = lambda: rows(incremental.read_daily(spark, path).select("vendor_id", "created_date", "n"))
    run(first)
    assert stored() == whole(first)
    before = files()
    second = [*first, (100, 0, day(4), at(5)), (101, 1, day(12), at(6))]
    run(second)
    assert stored() == whole(second)
    kept = {f.parent.name for f in set(files()) & set(before)}
    # Days changed at the watermark itself are read again, days before it are not.
    again = {f"day={d}" for i, _, d, t in first if t >= at(2)} | {"day=" + str(day(4)), "day=" + str(day(12))}
    assert kept == {f.parent.name for f in before} - again
    middle = files()
    run(second)  # a repeated run changes nothing but rewrites the last days
    assert stored() == whole(second)
    assert set(middle) & set(files()) == {f for f in middle if f.parent.name != "day=" + str(day(12))}
    assert incremental.watermark(spark, path) == at(6)
    run([])
    assert stored() == whole(second)


def test_the_range_of_touched_days_reaches_the_scan(spark, tmp_path):
    data = [(i, 1, dt.date(2025, 1, 1) + dt.timedelta(days=i), dt.datetime(2025, 2, 1) + dt.timedelta(days=i)) for i in range(60)]
    spark.createDataFrame(data, STAMPED).write.parquet(str(tmp_path / "o"))
    orders_ = spark.read.parquet(str(tmp_path / "o"))
    found = incremental.touched(orders_, dt.datetime(2025, 3, 30), "updated_at", "created_date", incremental.MONTH)
    assert found.count() == 29 and found.agg({"created_date": "min"}).first()[0] == dt.date(2025, 2, 1)
    assert "GreaterThanOrEqual(created_date,2025-02-01)" in found._jdf.queryExecution().executedPlan().toString()
    assert incremental.touched(orders_, dt.datetime(2026, 1, 1), "updated_at", "created_date", incremental.DAY) is None


def test_refreshed_partitions_have_few_files(spark, tmp_path):
    """However many tasks make the aggregates; and shuffles start from more partitions than the session's."""
    stamped = spark.range(0, 4000, 1, 16).selectExpr("id", "id % 300 AS vendor_id", "date_add(date'2024-01-01', cast(id % 150 AS int)) AS created_date")
    stamped = stamped.withColumn("updated_at", F.col("created_date"))
    count = lambda df: df.groupBy("vendor_id", "created_date").agg(F.count("*").alias("order_count")).repartition(16, "vendor_id")
    incremental.refresh_daily(stamped, count, str(tmp_path / "daily"), unit=incremental.MONTH)
    for month in (tmp_path / "daily").glob("month=*"):
        assert len(list(month.glob("*.parquet"))) == 1
    found = incremental.read_daily(spark, str(tmp_path / "daily"), incremental.MONTH)
    assert found.count() == 300 and found.agg(F.sum("order_count")).first()[0] == 4000
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) > int(spark.conf.get("spark.sql.shuffle.partitions"))
