"""Feed rows turned into table rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of stored reviews.
PROVIDER = "user"
QUESTION = "user comment"
REFERENCE_RANGE = 1_000_000_000


def expand_orders(feed: DataFrame) -> DataFrame:
    """``order_count`` orders of one item each for every feed row (``feed_id`` names the row).

    Rows with no orders yield none; the guard is needed because a descending
    sequence would count from 1 down to 0.
    """
    return (
        feed.filter("order_count >= 1")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "order_count")))
        .select(
            F.concat_ws("-", "feed_id", "copy").alias("order_ref"),
            "vendor_id",
            "employee_id",
            "location_id",
            "occasion_id",
            "product_id",
            F.col("product_price").alias("price"),
            F.lit(1).cast("bigint").alias("qty"),
            F.lit("new").alias("status"),
            "created_date",
        )
    )


def expanded_orders(expanded: DataFrame) -> DataFrame:
    """Order rows of an expanded feed, with zero charges."""
    zero = F.lit(0.0)
    return expanded.select(
        "order_ref", "vendor_id", "employee_id", "location_id", "occasion_id", "qty", "status", "created_date",
        zero.alias("company_paid"), zero.alias("employee_paid"), zero.alias("container_charges"),
        zero.alias("delivery_charges"), zero.alias("convenience_fee"),
    )


def expanded_items(expanded: DataFrame) -> DataFrame:
    return expanded.select("order_ref", "product_id", "price", F.col("price").alias("item_price"), "qty", "status")


class NormalisedReviews(NamedTuple):
    review: DataFrame
    options: DataFrame
    responses: DataFrame
    rejected: DataFrame


def resolve_products(feed: DataFrame, menu: DataFrame) -> DataFrame:
    """Feed rows with ``order_items``, the names of their comma-separated product ids.

    ``order_items`` is null where an id is unknown or listed twice.
    """
    ids = feed.select("feed_id", F.split("menu_id", ",").alias("ids"))
    named = (
        ids.select("feed_id", F.explode("ids").alias("text"))
        .select("feed_id", F.trim("text").try_cast("bigint").alias("product_id"))
        .distinct()
        .join(menu.select(F.col("id").alias("product_id"), "name"), "product_id")
        .groupBy("feed_id")
        .agg(
            F.count("*").alias("found"),
            F.expr("listagg(name, ', ') WITHIN GROUP (ORDER BY product_id)").alias("names"),
        )
    )
    wanted = F.size(F.split("menu_id", ","))
    return (
        feed.join(named, "feed_id", "left")
        .withColumn("order_items", F.when(F.col("found") == wanted, F.col("names")))
        .drop("found", "names")
    )


def normalise_reviews(feed: DataFrame, menu: DataFrame, provider_id: int = 0) -> NormalisedReviews:
    """Review, option and response rows of a review feed, and the rows whose products are not valid.

    ``provider_id`` is the account that gave the reviews. Every review has one text option and one response; the three share the
    feed's id, so they can be written independently.
    """
    resolved = resolve_products(feed, menu)
    good = resolved.filter("order_items IS NOT NULL").withColumn(
        "reference_id", F.pmod(F.xxhash64("feed_id"), F.lit(REFERENCE_RANGE)) + 1
    )
    review = good.select(
        F.col("feed_id").alias("id"), F.lit(PROVIDER).alias("provider"), F.lit(provider_id).cast("bigint").alias("provider_id"),
        F.lit("order").alias("reference"), "reference_id", "vendor_id", "location_id", "rating",
        F.lit("").alias("comment"), F.col("date").alias("order_created_date"), "order_items",
    )
    options = good.select(
        F.col("feed_id").alias("id"), "vendor_id", F.lit("text").alias("type"), F.lit(QUESTION).alias("question"),
        "rating", F.lit(1).alias("active"), F.col("date").alias("created_at"),
        F.lit(0).alias("reference_id"), F.lit("company").alias("reference_type"),
    )
    responses = good.select(
        F.col("feed_id").alias("id"), F.col("feed_id").alias("review_id"), F.col("feed_id").alias("review_option_id"),
        F.col("comment").alias("value"), F.col("date").alias("created_at"),
        F.lit("order").alias("reference"), "reference_id",
    )
    return NormalisedReviews(review, options, responses, resolved.filter("order_items IS NULL"))
