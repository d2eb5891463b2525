"""Order and revenue operators. Every one computes all vendors in one plan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.dates import day_literal, days_before
from platewise.schemas import ORDER_STATUSES

MONEY = "decimal(18,2)"
DAYS_PER_MONTH = 30  # the monthly averages divide by a fixed 30
DAYS_PER_WINDOW = 90  # the overall average divides by a fixed 90


def trailing_window(df: DataFrame, as_of: dt.date, days: int, date: str = "created_date") -> DataFrame:
    """Rows strictly younger than ``days`` before ``as_of``; no upper bound."""
    return df.filter(F.col(date) > days_before(as_of, days))


def date_between(df: DataFrame, start: dt.date | str, end: dt.date | str, date: str = "created_date") -> DataFrame:
    return df.filter(F.col(date).between(day_literal(start), day_literal(end)))


def status_filter(df: DataFrame, excluded: Sequence[str], status: str = "status") -> DataFrame:
    """Drops the listed statuses, and rows without a status."""
    return df.filter(~F.col(status).isin(*excluded))


def unknown_statuses(df: DataFrame, known: Sequence[str] = ORDER_STATUSES, status: str = "status") -> DataFrame:
    """Statuses outside the vocabulary with their row counts."""
    return df.filter(~F.col(status).isin(*known)).groupBy(status).agg(F.count("*").alias("rows"))


def order_item_join(orders: DataFrame, items: DataFrame) -> DataFrame:
    keyed = orders.withColumnRenamed("id", "order_id")
    keys = ["order_id"] + [c for c in ("vendor_id",) if c in keyed.columns and c in items.columns]
    return keyed.join(items, keys)


def order_item_menu_join(orders: DataFrame, items: DataFrame, menu: DataFrame) -> DataFrame:
    named = menu.select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), F.col("price").alias("menu_price")
    )
    return order_item_join(orders, items).join(named, "product_id")


def vendor_daily_orders(sales_order: DataFrame, as_of: dt.date, days: int = 60) -> DataFrame:
    return (
        trailing_window(sales_order, as_of, days)
        .groupBy("vendor_id", "created_date")
        .agg(F.count("*").alias("order_count"))
    )


def vendor_daily_orders_range(
    sales_order: DataFrame, start: dt.date | str, end: dt.date | str, min_points: int = 170
) -> DataFrame:
    """Daily orders of a fixed range with the number of days present per vendor.

    ``enough_history`` is the gate; a vendor has at most one row per day of the
    range, so the window is bounded by the range.
    """
    daily = (
        date_between(sales_order, start, end)
        .groupBy("vendor_id", "created_date")
        .agg(F.count("*").alias("order_count"))
    )
    points = F.count("*").over(Window.partitionBy("vendor_id"))
    return daily.withColumn("data_points", points).withColumn("enough_history", F.col("data_points") >= min_points)


def product_daily_qty(
    orders: DataFrame, items: DataFrame, as_of: dt.date, days: int = 60, keys: Sequence[str] = ("product_id",)
) -> DataFrame:
    return (
        order_item_join(trailing_window(orders, as_of, days), items)
        .groupBy(*keys, "created_date")
        .agg(F.sum("qty").cast("bigint").alias("order_count"))
    )


def _product_days(orders: DataFrame, items: DataFrame, as_of: dt.date, days: int, *aggs: Column) -> DataFrame:
    """Items counted per (vendor, product, day) before the menu is joined.

    The menu is unique by product, so joining after the count gives the same
    rows as joining first while a popular product shuffles one row per day.
    """
    return (
        order_item_join(trailing_window(orders, as_of, days), items)
        .groupBy("vendor_id", "product_id", "created_date")
        .agg(*aggs)
    )


def _product_names(menu: DataFrame) -> DataFrame:
    return menu.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))


def product_daily_counts(
    orders: DataFrame, items: DataFrame, menu: DataFrame, as_of: dt.date, days: int = 90
) -> DataFrame:
    """Item rows per (vendor, product, day)."""
    counted = _product_days(orders, items, as_of, days, F.count("*").alias("order_count"))
    return counted.join(_product_names(menu), "product_id").select(
        "vendor_id", "created_date", "product_id", "product_name", "order_count"
    )


def item_sales_price(
    orders: DataFrame, items: DataFrame, menu: DataFrame, as_of: dt.date, days: int = 90
) -> DataFrame:
    counted = _product_days(
        orders, items, as_of, days, F.count("qty").alias("order_count"), F.max("price").alias("item_price")
    )
    return counted.join(_product_names(menu), "product_id").select(
        "vendor_id", "created_date", "product_id", F.col("product_name").alias("menu_name"), "order_count", "item_price"
    )


def daily_revenue(
    orders: DataFrame,
    items: DataFrame,
    menu: DataFrame,
    as_of: dt.date,
    days: int = 90,
    excluded: Sequence[str] = ("rejected", "payment_failed"),
) -> DataFrame:
    """Menu price summed over item rows, per vendor and day."""
    counted = _product_days(status_filter(orders, excluded), items, as_of, days, F.count("*").alias("n"))
    priced = counted.join(
        menu.select(F.col("id").alias("product_id"), F.col("price").cast(MONEY).alias("menu_price")), "product_id"
    )
    return priced.groupBy("vendor_id", "created_date").agg(
        F.sum(F.col("menu_price") * F.col("n")).cast("double").alias("daily_sales"),
        F.sum("n").alias("total_orders"),
    )


def _total_sales(column: str = "daily_sales") -> Column:
    return F.sum(F.col(column).cast(MONEY)).cast("double")


def monthly_revenue(daily: DataFrame) -> DataFrame:
    return (
        daily.groupBy("vendor_id", F.date_format("created_date", "yyyy-MM").alias("month"))
        .agg(_total_sales().alias("sales"), F.sum("total_orders").alias("orders"))
        .withColumn("avg_daily_sales", F.round(F.col("sales") / DAYS_PER_MONTH, 4))
        .withColumn("avg_daily_orders", F.round(F.col("orders") / DAYS_PER_MONTH, 4))
    )


def revenue_totals(daily: DataFrame) -> DataFrame:
    return (
        daily.groupBy("vendor_id")
        .agg(_total_sales().alias("sales"), F.sum("total_orders").alias("orders"))
        .withColumn("avg_daily_sales", F.round(F.col("sales") / DAYS_PER_WINDOW, 4))
    )


def revenue_rollup(daily: DataFrame) -> DataFrame:
    """Day, month and overall totals of each vendor from one scan."""
    monthly = daily.withColumn("month", F.date_format("created_date", "yyyy-MM"))
    vendor, month, day = F.col("vendor_id"), F.col("month"), F.col("created_date")
    rolled = monthly.groupingSets([[vendor, month, day], [vendor, month], [vendor]], vendor, month, day).agg(
        F.when(F.grouping("created_date") == 0, "day")
        .when(F.grouping("month") == 0, "month")
        .otherwise("total")
        .alias("level"),
        _total_sales().alias("sales"),
        F.sum("total_orders").alias("orders"),
    )
    divisor = F.when(F.col("level") == "month", DAYS_PER_MONTH).when(F.col("level") == "total", DAYS_PER_WINDOW)
    return rolled.withColumn("avg_daily_sales", F.round(F.col("sales") / divisor, 4))


def item_total_orders(item_sales: DataFrame) -> DataFrame:
    """Orders per item name with the price of its first row (by day, then product)."""
    seen = F.struct("created_date", "product_id")
    return item_sales.groupBy("vendor_id", "menu_name").agg(
        F.sum("order_count").alias("orders"),
        F.min_by("item_price", seen).alias("price"),
        F.min("created_date").alias("first_date"),
        F.min_by("product_id", seen).alias("first_product_id"),
    )


def best_worst_selling(item_totals: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
    """Best and worst selling item of each vendor.

    Items rank by orders descending, ties in first-seen order, so the best is
    the first and the worst the last of that ranking. Both come from one partial
    aggregation instead of a sort of each vendor's items.
    """
    rank = F.struct((-F.col("orders")).alias("o"), "first_date", "first_product_id", "menu_name")
    item = F.struct("menu_name", "orders", "price")
    both = item_totals.groupBy("vendor_id").agg(F.min_by(item, rank).alias("best"), F.max_by(item, rank).alias("worst"))
    rows = both.select(
        "vendor_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("position"), *[F.col(f"{c}.{f}").alias(f) for f in ("menu_name", "orders", "price")])
                    for k, c in (("best", "best"), ("worst", "worst"))
                ]
            )
        ),
    )
    if ratings is None:
        return rows.withColumn("rating", F.lit(None).cast("double"))
    return rows.join(ratings.select("vendor_id", "menu_name", "rating"), ["vendor_id", "menu_name"], "left")


def next_day_change(daily_counts: DataFrame) -> DataFrame:
    """Last day, next-day prediction and change per (vendor, product).

    The prediction is the rounded mean of the last two days with sales. A
    product has one row per day of the window, which bounds the window frame.
    """
    by_day = Window.partitionBy("vendor_id", "product_id").orderBy(F.col("created_date").desc())
    last, previous = F.col("last_day_order_count"), F.col("previous_day_order_count")
    return (
        daily_counts.withColumn("rn", F.row_number().over(by_day))
        .withColumn("previous_day_order_count", F.lead("order_count").over(by_day))
        .filter("rn = 1")
        .select(
            "vendor_id",
            "product_id",
            "product_name",
            F.col("order_count").alias("last_day_order_count"),
            F.coalesce("previous_day_order_count", "order_count").alias("previous_day_order_count"),
        )
        .withColumn("this_day_prediction", F.round((last + previous) / 2).cast("bigint"))
        .withColumn(
            "increase_percentage",
            F.when(last == 0, 0.0).otherwise(F.round(100 * (F.col("this_day_prediction") - last) / last, 2)),
        )
    )


def attach_product_id(named: DataFrame, vendor_menu: DataFrame, name: str = "product_name") -> DataFrame:
    """Product id by menu name, -1 where the vendor lists no such name; of equal names the highest id."""
    ids = vendor_menu.filter("active = 1").groupBy("vendor_id", F.col("name").alias(name)).agg(F.max("id").alias("menu_id"))
    return (
        named.join(ids, ["vendor_id", name], "left")
        .withColumn("attached_id", F.coalesce("menu_id", F.lit(-1).cast("bigint")))
        .drop("menu_id")
    )


def holiday_sales(daily: DataFrame, holidays: DataFrame) -> DataFrame:
    return daily.join(holidays.select(F.col("date").alias("created_date")), "created_date", "left_semi").select(
        "vendor_id", "created_date", "daily_sales", "total_orders"
    )


def max_updated_at(df: DataFrame, updated_at: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(updated_at).alias("max_updated_at"))
