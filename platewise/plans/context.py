"""Everything a vendor's assistant is told, as text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators import orders


def _money(column: str) -> Column:
    return F.format_string("%.2f", F.col(column))


def _block(df: DataFrame, name: Column, line: Column, order: Column) -> DataFrame:
    """One text per vendor and block of ordered lines; callers pass rows bounded per vendor."""
    rows = df.select("vendor_id", name.alias("block"), line.alias("line"), order.alias("o")).groupBy("vendor_id", "block")
    text = F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY o)").alias("text")
    none = F.lit(0).cast("bigint")
    return rows.agg(text).select("vendor_id", "block", none.alias("section"), none.alias("part"), "text")


def _sales(daily: DataFrame, holidays: DataFrame) -> DataFrame:
    """The blocks of sales, from one pass over the days: the total, months, days and holidays."""
    off = holidays.select(F.col("date").alias("created_date"), F.lit(True).alias("off")).distinct()
    rolled = orders.revenue_rollup(daily).join(off, "created_date", "left")
    days = F.when(F.col("off"), F.array(F.lit("daily_revenue"), F.lit("holiday_sales"))).otherwise(F.array(F.lit("daily_revenue")))
    blocks = (
        F.when(F.col("level") == "total", F.array(F.lit("total_revenue")))
        .when(F.col("level") == "month", F.array(F.lit("monthly_revenue")))
        .otherwise(days)
    )
    when = F.when(F.col("level") == "day", F.col("created_date").cast("string")).when(F.col("level") == "month", F.col("month"))
    line = F.concat(F.coalesce(F.concat(when, F.lit(": ")), F.lit("")), F.lit("sales "), _money("sales"), F.lit(", orders "), F.col("orders").cast("string"))
    rows = rolled.select("vendor_id", F.explode(blocks).alias("name"), line.alias("text"), F.coalesce(when, F.lit("")).alias("when"))
    return _block(rows, F.col("name"), F.col("text"), F.col("when"))


def vendor_context(
    vendor: DataFrame,
    daily: DataFrame,
    item_performance: DataFrame,
    holidays: DataFrame,
    schedule_hours: DataFrame,
    review_parts: DataFrame,
    history: DataFrame | None = None,
) -> DataFrame:
    """Rows (vendor_id, block, section, part, text).

    A block is one row of bounded length, except that reviews and chat history come in
    sections, the day (as days since 1970) or the session, of as many parts as they need.
    ``daily`` is the daily revenue of the window, at most one row per day and vendor; it is
    read once for all blocks of sales.
    """
    # The line formats of the blocks.
    blocks = [
        _block(
            vendor.withColumnRenamed("id", "vendor_id"), F.lit("vendor"),
            F.concat(F.lit("Vendor Name: "), "vendor_name", F.lit("\nVendor Description: "), "description"), F.lit(0),
        ),
        _sales(daily, holidays),
        _block(
            item_performance, F.lit("item_performance"),
            F.concat(
                F.initcap("position"), F.lit(" selling item: "), "menu_name", F.lit(": "), F.col("orders").cast("string"),
                F.lit(" orders, Price: ₹"), _money("price"),
            ),
            F.col("position"),
        ),
        _block(
            schedule_hours, F.lit("schedule"),
            F.concat_ws(", ", "day_of_week", "start_time", "end_time", "location_name", "company_name", "city", "state_name"),
            F.struct("day_order", "location_id"),
        ),
        review_parts.select(
            "vendor_id", F.lit("reviews").alias("block"), F.unix_date("comment_date").cast("bigint").alias("section"),
            F.col("part").cast("bigint").alias("part"),
            F.concat(F.lit("Review Date: "), F.col("comment_date").cast("string"), F.lit("\n"), "review_text").alias("text"),
        ),
    ]
    if history is not None:
        named = F.when(F.col("history_used"), "history").otherwise("long_history")
        blocks.append(
            history.select(
                "vendor_id", named.alias("block"), F.col("conv_id").alias("section"), F.col("part").cast("bigint").alias("part"),
                F.col("history").alias("text"),
            )
        )
    result = blocks[0]
    for block in blocks[1:]:
        result = result.unionByName(block)
    return result
