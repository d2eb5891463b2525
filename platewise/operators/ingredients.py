"""Ingredient operators: from forecasts to kitchen requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.schemas import INGREDIENTS


def latest_ingredients(ingredients_data: DataFrame) -> DataFrame:
    """One ingredient list, as JSON text, per (vendor, menu name); of several the highest id counts."""
    return ingredients_data.groupBy("vendor_id", F.col("menu_name").alias("product_name")).agg(
        F.max_by("ingredients", "id").alias("ingredients")
    )


def parsed(ingredients: str = "ingredients") -> Column:
    return F.from_json(ingredients, INGREDIENTS)


def menu_ingredients(vendor_menu: DataFrame, ingredients_data: DataFrame) -> DataFrame:
    """Menu items with their ingredient list; items without one are left out."""
    listed = latest_ingredients(ingredients_data).withColumn("ingredients", parsed())
    return vendor_menu.select(
        "vendor_id", F.col("id").alias("product_id"), F.col("name").alias("product_name")
    ).join(listed, ["vendor_id", "product_name"])


def items_without_ingredients(vendor_menu: DataFrame, ingredients_data: DataFrame) -> DataFrame:
    known = ingredients_data.select("vendor_id", F.col("menu_name").alias("name"))
    return vendor_menu.select("vendor_id", "name").distinct().join(known, ["vendor_id", "name"], "left_anti")


def append_missing(found: DataFrame, ingredients_data: DataFrame) -> DataFrame:
    """The found rows whose (vendor, menu name) is not stored yet, ready to append; of equal names one."""
    keys = ["vendor_id", "menu_name"]
    once = found.groupBy(*keys).agg(F.min("ingredients").alias("ingredients"))
    return once.join(ingredients_data.select(*keys), keys, "left_anti")


def predictions_with_ingredients(forecast: DataFrame, ingredients_data: DataFrame) -> DataFrame:
    """Forecast totals per (vendor, product name) beside each of its ingredients; unknown products are skipped.

    The horizon is summed before the list is exploded, so a product contributes
    one row per ingredient and not one per day. The newest list is picked after
    the join, which shares its keys, so only lists of forecast products are
    compared and parsed.
    """
    seen = F.struct("date", "product_id")
    totals = forecast.groupBy("vendor_id", "product_name").agg(
        F.sum("order_count").alias("order_count"), F.min(seen).alias("first_seen")
    )
    lists = ingredients_data.select("vendor_id", F.col("menu_name").alias("product_name"), "id", "ingredients")
    return (
        totals.join(lists, ["vendor_id", "product_name"])
        .groupBy(*totals.columns)
        .agg(F.max_by("ingredients", "id").alias("ingredients"))
        .select("vendor_id", "product_name", "order_count", "first_seen", F.posexplode(parsed()).alias("position", "i"))
        .select(
            "vendor_id",
            "product_name",
            "order_count",
            F.col("i.ingredient").alias("ingredient"),
            F.col("i.measurement_unit").alias("measurement_unit"),
            F.col("i.measurement_value").alias("measurement_value"),
            F.struct("first_seen", "product_name", "position").alias("first_seen"),
        )
    )


def ration_requirements(forecast: DataFrame, ingredients_data: DataFrame) -> DataFrame:
    """Amount of each ingredient a vendor needs, and the products that need it.

    Amounts add up under the unit seen first; ``unit_conflict`` marks
    ingredients that come in several units.
    """
    amount = F.col("measurement_value") * F.col("order_count")
    return (
        predictions_with_ingredients(forecast, ingredients_data)
        .groupBy("vendor_id", "ingredient")
        .agg(
            F.min_by("measurement_unit", "first_seen").alias("measurement_unit"),
            F.round(F.sum(amount), 4).alias("measurement_value"),
            F.array_join(F.array_sort(F.collect_set("product_name")), ", ").alias("products"),
            (F.min("measurement_unit") != F.max("measurement_unit")).alias("unit_conflict"),
        )
    )
