"""Vendor, place and schedule operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.dates import day_name, day_position
from platewise.operators.orders import trailing_window


def vendors_by_company(vendor: DataFrame, company_id: int | None = None) -> DataFrame:
    """Active vendors of one company, or of every company when none is given."""
    active = vendor.filter("active = 1")
    if company_id is not None:
        active = active.filter(F.col("company_id") == company_id)
    return active.select("company_id", "id", "vendor_name")


def company_list(company: DataFrame) -> DataFrame:
    return company.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))


def active_menu(vendor_menu: DataFrame) -> DataFrame:
    return vendor_menu.filter("active = 1").select("vendor_id", "name", "id")


def menu_names(vendor_menu: DataFrame) -> DataFrame:
    return vendor_menu.select("vendor_id", "name")


def _places(location: DataFrame, addresses: DataFrame, states: DataFrame, cities: DataFrame) -> DataFrame:
    """Each location with its city and state."""
    at = addresses.select(F.col("id").alias("address_id"), "state_id", "city_id")
    return (
        location.join(at, "address_id")
        .join(states.select(F.col("id").alias("state_id"), F.col("name").alias("state_name")), "state_id")
        .join(cities.select(F.col("id").alias("city_id"), F.col("name").alias("city_name")), "city_id")
        .withColumnRenamed("id", "location_id")
    )


def vendor_geo(
    vendor: DataFrame,
    vendor_location: DataFrame,
    location: DataFrame,
    addresses: DataFrame,
    states: DataFrame,
    cities: DataFrame,
) -> DataFrame:
    """City and state of each vendor: the lowest (city id, state id) among its active places, '' if none."""
    places = _places(location.filter("active = 1"), addresses, states, cities)
    first = (
        vendor_location.filter("active = 1")
        .join(places.select("location_id", "city_id", "state_id", "city_name", "state_name"), "location_id")
        .groupBy("vendor_id")
        .agg(F.min_by(F.struct("city_name", "state_name"), F.struct("city_id", "state_id")).alias("place"))
    )
    return vendor.select(F.col("id").alias("vendor_id")).join(first, "vendor_id", "left").select(
        "vendor_id",
        F.col("place.city_name").alias("city_name"),
        F.col("place.state_name").alias("state_name"),
        F.when(
            F.col("place").isNotNull(),
            F.concat(F.lit("City: "), F.col("place.city_name"), F.lit(", State: "), F.col("place.state_name")),
        )
        .otherwise("")
        .alias("location_text"),
    )


def schedule_by_day(schedules: DataFrame) -> DataFrame:
    """Active schedules per vendor and weekday; ``day_order`` is 1 for Monday."""
    return (
        schedules.filter("active = 1")
        .groupBy("vendor_id", "day_of_week")
        .agg(F.count("*").alias("schedules"))
        .select("vendor_id", day_name(F.col("day_of_week")).alias("day_of_week"), "schedules")
        .withColumn("day_order", day_position(F.col("day_of_week")))
    )


def vendor_schedule_hours(
    schedules: DataFrame,
    location: DataFrame,
    company: DataFrame,
    addresses: DataFrame,
    states: DataFrame,
    cities: DataFrame,
) -> DataFrame:
    """Opening hours per vendor, location and weekday, with place names."""
    hours = (
        schedules.filter("active = 1")
        .groupBy("vendor_id", "location_id", "day_of_week")
        .agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
    )
    places = _places(location, addresses, states, cities).withColumnRenamed("name", "location_name")
    owners = company.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return (
        hours.join(places.drop("active"), "location_id")
        .join(owners, "company_id")
        .select(
            "vendor_id",
            "location_id",
            day_name(F.col("day_of_week")).alias("day_of_week"),
            "start_time",
            "end_time",
            "location_name",
            "company_name",
            F.col("city_name").alias("city"),
            "state_name",
        )
        .withColumn("day_order", day_position(F.col("day_of_week")))
    )


def repeat_customers(
    sales_order: DataFrame,
    vendor: DataFrame,
    as_of: dt.date,
    days: int = 90,
    excluded: str = "cancelled",
) -> DataFrame:
    """Customers and repeating customers per vendor; zeros for a vendor without orders."""
    per_customer = (
        trailing_window(sales_order, as_of, days)
        .filter(F.col("status") != excluded)
        .groupBy("vendor_id", "employee_id")
        .agg(F.count("*").alias("n"))
    )
    totals = per_customer.groupBy("vendor_id").agg(
        F.count("employee_id").alias("total_customers"), F.count_if(F.col("n") > 1).alias("repeating_customers")
    )
    share = F.col("repeating_customers") / F.col("total_customers") * 100
    return (
        vendor.select(F.col("id").alias("vendor_id"))
        .join(totals, "vendor_id", "left")
        .na.fill(0, ["total_customers", "repeating_customers"])
        .withColumn(
            "repeating_customers_percentage",
            F.when(F.col("total_customers") > 0, F.round(share, 2)).otherwise(0.0),
        )
    )


def product_image_url(menu: DataFrame, image_mappings: DataFrame, domain: str, bucket: str) -> DataFrame:
    """Address of each product's first image (by folder, then file name), null if it has none."""
    first = (
        image_mappings.filter("reference_type = 'menu'")
        .groupBy(F.col("reference_id").alias("product_id"))
        .agg(F.min(F.struct("folder", "file_name")).alias("image"))
    )
    # Fixed value: the address format.
    url = F.concat(
        F.lit(f"https://{domain}/{bucket}/resize_images/"), F.col("image.folder"), F.lit("/original_"), F.col("image.file_name")
    )
    return menu.select(F.col("id").alias("product_id")).join(first, "product_id", "left").select("product_id", url.alias("image_url"))
