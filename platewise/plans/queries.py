"""Every operator bound to the driver's tables, by name."""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise import schemas
from platewise.adapters import DriverTables
from platewise.functions import lexicons, text
from platewise.operators import answers, incremental, inference, ingredients, menu, names, orders, reviews, sessions, timeseries, vectors, vendors
from platewise.plans.context import vendor_context
from platewise.session import scratch_path, tune
from platewise.sources import feeds, readers, writers

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Words of the driver's vocabulary that stand in for the food lexicons.
BRANDS = ("brand#1", "brand#2", "brand#3", "promo")
NON_VEG = ("gizmo", "plate", "medium")
VAGUE = ("new bolt", "old ring economy", "cold gear standard", "hot rod promo")
AMBIGUOUS_WORD = "anvil"
EXCLUDED = ("P",)
HORIZON = 14
BACKTEST_DAYS = 23
TRAINING_DAYS = 397  # fixed value: thirteen months, January to the January after
TEMPLATE = (
    "Holidays:\n{holidays}\n{location}\nVendor schedule:\n{schedule}\nHistorical data:\n{history}\nPredict the next 14 days."
)
FEEDBACK_TEMPLATE = "Rating, comment:\n{reviews}\nSummarise the feedback in three points."
# The index by hand of ann_topk_fixed: size of a code's steps, and how far above its centroid a cell is worth a visit.
CODE_STEP, CODE_REACH = 0.1, 0.15
CACHE_EPOCH = dt.datetime(2024, 1, 1)


def query(build: Callable[[DriverTables], DataFrame]) -> Callable[[DriverTables], DataFrame]:
    """Registers a function of the canonical tables under its own name."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        return build(DriverTables(tune(spark), directory))

    REGISTRY[build.__name__.strip("_")] = run
    return build


# --- sources and sinks --------------------------------------------------------


@query
def scan_tables(t: DriverTables) -> DataFrame:
    return readers.scan_query(
        t.spark,
        "SELECT order_id, vendor_id, product_id, qty, price FROM {items} WHERE qty >= :low AND price < :high",
        {"low": 10, "high": 60000.0},
        items=t.order_items,
    )


@query
def scan_daily_csv(t: DriverTables) -> DataFrame:
    path = scratch_path(t.spark, "daily")
    daily = t.order_headers.groupBy(F.col("created_date").alias("date")).agg(F.count("*").alias("order_count"))
    daily.write.csv(path, header=True)
    return readers.scan_daily_csv(t.spark, path)


@query
def scan_order_csv(t: DriverTables) -> DataFrame:
    path = scratch_path(t.spark, "orders")
    feed = t.order_feed.withColumn("created_date", F.date_format("created_date", "dd/MM/yy"))
    feed.select([f.name for f in schemas.struct_of(schemas.ORDER_FEED).fields]).write.csv(path, header=True)
    return readers.scan_order_csv(t.spark, path)


@query
def scan_review_csv(t: DriverTables) -> DataFrame:
    path = scratch_path(t.spark, "reviews")
    columns = [f.name for f in schemas.struct_of(schemas.REVIEW_FEED).fields]
    t.review_feed.select(columns).write.csv(path, header=True, quote='"', escape='"')
    return readers.scan_review_csv(t.spark, path)


@query
def scan_prompt_csv(t: DriverTables) -> DataFrame:
    path = scratch_path(t.spark, "prompts")
    prompts = t.raw("benchmark").select(
        F.col("item_id").cast("int").alias("prompt_id"), F.concat(F.lit('Find "matches" in:\n'), "text").alias("prompt")
    )
    prompts.write.csv(path, header=True, quote='"', escape='"')
    return readers.scan_prompt_csv(t.spark, path)


@query
def scan_root_items(t: DriverTables) -> DataFrame:
    path = scratch_path(t.spark, "roots")
    t.raw("part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.concat_ws(",", "p_brand", "p_type").alias("trace_ids"),
    ).write.csv(path, header=True, quote='"', escape='"')
    return readers.scan_root_items(t.spark, path)


@query
def expand_orders(t: DriverTables) -> DataFrame:
    return feeds.expand_orders(t.order_feed)


@query
def normalise_reviews(t: DriverTables) -> DataFrame:
    made = feeds.normalise_reviews(t.review_feed, t.menu)
    rows = (
        made.review.join(made.responses.select(F.col("review_id").alias("id"), "review_option_id", "value"), "id")
        .join(made.options.select(F.col("id").alias("review_option_id"), "type", "question"), "review_option_id")
        .select("id", "vendor_id", "rating", "order_created_date", "order_items", "type", "question", "value")
    )
    rejected = made.rejected.select(
        F.col("feed_id").alias("id"), "vendor_id", "rating", F.col("date").alias("order_created_date"),
        F.lit(None).cast("string").alias("order_items"), F.lit("rejected").alias("type"),
        F.lit(None).cast("string").alias("question"), F.col("comment").alias("value"),
    )
    return rows.unionByName(rejected)


@query
def append_missing(t: DriverTables) -> DataFrame:
    found = t.vendor_menu.select(
        "vendor_id", F.col("name").alias("menu_name"), F.concat(F.lit("found for "), "name").alias("ingredients")
    )
    return ingredients.append_missing(found, t.ingredients_data)


@query
def write_json(t: DriverTables) -> DataFrame:
    path = scratch_path(t.spark, "json")
    comments = _comments(t)
    nested = (
        reviews.sentiment_breakdown(comments)
        .join(reviews.total_reviews(comments), "vendor_id")
        .select(
            "vendor_id",
            "total_reviews",
            F.struct("positive_review_percentage", "neutral_review_percentage", "negative_review_percentage").alias("sentiment_breakdown"),
        )
    )
    writers.write_json(nested, path)
    read = t.spark.read.schema(nested.schema).json(path)
    return read.select("vendor_id", "total_reviews", "sentiment_breakdown.*")


@query
def write_lines(t: DriverTables) -> DataFrame:
    path = scratch_path(t.spark, "lines")
    writers.write_lines(t.menu, path, header="ID,NAME")
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@query
def write_predictions(t: DriverTables) -> DataFrame:
    path = scratch_path(t.spark, "predictions")
    writers.write_predictions(_predictions(t), path)
    return t.spark.read.parquet(path).select(
        "menu_id", "menu_name", "master_menu_id", "master_menu_name", "predicted_menu_name", "eval_current", "is_approved"
    )


# --- projections and filters --------------------------------------------------


@query
def vendors_by_company(t: DriverTables) -> DataFrame:
    return vendors.vendors_by_company(t.vendor)


@query
def active_menu(t: DriverTables) -> DataFrame:
    return vendors.active_menu(t.vendor_menu)


@query
def menu_names(t: DriverTables) -> DataFrame:
    return vendors.menu_names(t.vendor_menu)


@query
def trailing_window(t: DriverTables) -> DataFrame:
    return orders.trailing_window(t.order_headers, t.as_of, 60)


@query
def date_between(t: DriverTables) -> DataFrame:
    return orders.date_between(t.order_headers, t.as_of - dt.timedelta(days=400), t.as_of - dt.timedelta(days=100))


@query
def status_filter(t: DriverTables) -> DataFrame:
    return orders.status_filter(t.order_headers, EXCLUDED)


@query
def review_reference_filter(t: DriverTables) -> DataFrame:
    return reviews.review_reference_filter(t.review, t.as_of).select(
        "id", "vendor_id", "rating", "order_created_date", "order_items"
    )


@query
def review_comment_case(t: DriverTables) -> DataFrame:
    return reviews.response_segments(t.review_responses, t.review_options)


@query
def question_routing(t: DriverTables) -> DataFrame:
    asked = t.raw("conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    return sessions.question_routing(asked).withColumn("needs_menu", sessions.mentions_word(F.col("text"), "tion")).drop("text")


@query
def company_list(t: DriverTables) -> DataFrame:
    return vendors.company_list(t.company)


@query
def id_watermark(t: DriverTables) -> DataFrame:
    return menu.id_watermark(t.menu_names, 100)


@query
def parse_rating(t: DriverTables) -> DataFrame:
    answer = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise(
        F.concat(F.lit("Rating: "), F.col("p_size").cast("string"))
    )
    return t.raw("part").select("p_partkey", inference.parse_rating(answer).alias("rating"))


# --- joins --------------------------------------------------------------------


@query
def order_item_join(t: DriverTables) -> DataFrame:
    return orders.order_item_join(t.order_headers, t.order_items)


@query
def order_item_menu_join(t: DriverTables) -> DataFrame:
    return orders.order_item_menu_join(t.order_headers, t.order_items, t.menu)


@query
def menu_ingredients(t: DriverTables) -> DataFrame:
    listed = ingredients.menu_ingredients(t.vendor_menu, t.ingredients_data)
    return listed.select("vendor_id", "product_id", "product_name", F.inline("ingredients"))


@query
def vendor_geo(t: DriverTables) -> DataFrame:
    return vendors.vendor_geo(t.vendor, t.vendor_location, t.location, t.addresses, t.states, t.cities)


@query
def vendor_schedule_hours(t: DriverTables) -> DataFrame:
    return vendors.vendor_schedule_hours(t.vendor_schedules, t.location, t.company, t.addresses, t.states, t.cities)


@query
def attach_product_id(t: DriverTables) -> DataFrame:
    return orders.attach_product_id(_next_day(t), t.vendor_menu).select(
        "vendor_id", "product_id", "product_name", "attached_id"
    )


@query
def predicted_vs_actual(t: DriverTables) -> DataFrame:
    return _compared(t)


@query
def holiday_sales(t: DriverTables) -> DataFrame:
    return orders.holiday_sales(_revenue(t), t.holidays)


@query
def known_items_only(t: DriverTables) -> DataFrame:
    predicted = t.raw("part").select(
        (F.col("p_partkey") * 2).cast("string").alias("id"), F.col("p_name").alias("predicted_name")
    )
    return menu.known_items_only(predicted, t.menu)


@query
def items_without_ingredients(t: DriverTables) -> DataFrame:
    return ingredients.items_without_ingredients(t.vendor_menu, t.ingredients_data)


@query
def predictions_with_ingredients(t: DriverTables) -> DataFrame:
    return ingredients.predictions_with_ingredients(_item_forecast(t), t.ingredients_data).drop("first_seen")


@query
def product_image_url(t: DriverTables) -> DataFrame:
    return vendors.product_image_url(t.menu, t.image_mappings, "images.example.org", "menu-bucket")


# --- aggregations -------------------------------------------------------------


@query
def vendor_daily_orders(t: DriverTables) -> DataFrame:
    return orders.vendor_daily_orders(t.sales_order, t.as_of)


@query
def vendor_daily_orders_range(t: DriverTables) -> DataFrame:
    return orders.vendor_daily_orders_range(t.sales_order, t.as_of - dt.timedelta(days=395), t.as_of, 170)


@query
def product_daily_qty(t: DriverTables) -> DataFrame:
    return orders.product_daily_qty(t.order_headers, t.order_items, t.as_of)


@query
def product_daily_counts(t: DriverTables) -> DataFrame:
    return _product_counts(t)


@query
def item_sales_price(t: DriverTables) -> DataFrame:
    return _item_sales(t)


@query
def daily_revenue(t: DriverTables) -> DataFrame:
    return _revenue(t)


@query
def schedule_by_day(t: DriverTables) -> DataFrame:
    return vendors.schedule_by_day(t.vendor_schedules)


@query
def review_comments(t: DriverTables) -> DataFrame:
    return _comments(t)


@query
def repeat_customers(t: DriverTables) -> DataFrame:
    return vendors.repeat_customers(t.sales_order, t.vendor, t.as_of)


@query
def monthly_revenue(t: DriverTables) -> DataFrame:
    return orders.monthly_revenue(_revenue(t))


@query
def revenue_totals(t: DriverTables) -> DataFrame:
    return orders.revenue_totals(_revenue(t))


@query
def revenue_rollup(t: DriverTables) -> DataFrame:
    return orders.revenue_rollup(_revenue(t))


@query
def item_total_orders(t: DriverTables) -> DataFrame:
    return orders.item_total_orders(_item_sales(t))


@query
def item_rating(t: DriverTables) -> DataFrame:
    return reviews.item_rating(_comments(t), orders.item_total_orders(_item_sales(t)))


@query
def sentiment_breakdown(t: DriverTables) -> DataFrame:
    return reviews.sentiment_breakdown(_comments(t))


@query
def price_complaints(t: DriverTables) -> DataFrame:
    return reviews.price_complaints(_signals(t, lexicons.PRICE_WORDS), words=lexicons.PRICE_WORDS)


@query
def sentiment_score(t: DriverTables) -> DataFrame:
    words = lexicons.POSITIVE_WORDS + lexicons.NEGATIVE_WORDS
    return reviews.sentiment_score(_signals(t, words), words=words)


@query
def delivery_sentiment(t: DriverTables) -> DataFrame:
    words = reviews.DELIVERY_RULE_WORDS
    return reviews.delivery_sentiment(_signals(t, words), words=words)


@query
def item_review_ratios(t: DriverTables) -> DataFrame:
    return reviews.item_review_ratios(_comments(t))


@query
def total_reviews(t: DriverTables) -> DataFrame:
    return reviews.total_reviews(_comments(t))


@query
def ration_requirements(t: DriverTables) -> DataFrame:
    return ingredients.ration_requirements(_item_forecast(t), t.ingredients_data)


@query
def forecast_backtest(t: DriverTables) -> DataFrame:
    return timeseries.forecast_backtest(_compared(t))


@query
def reviews_by_date(t: DriverTables) -> DataFrame:
    return reviews.reviews_by_date(_comments(t))


@query
def refresh_daily(t: DriverTables) -> DataFrame:
    """Daily orders built from the orders known some days before, then brought up to date."""
    stamped = t.sales_order.withColumn("updated_at", F.date_add("created_date", (F.col("id") % 40).cast("int")))
    known = stamped.filter(F.col("updated_at") <= F.lit(t.as_of - dt.timedelta(days=20)))
    path = scratch_path(t.spark, "daily")
    count = lambda df: df.groupBy("vendor_id", "created_date").agg(F.count("*").alias("order_count"))
    for orders_so_far in (known, stamped):
        incremental.refresh_daily(orders_so_far, count, path, unit=incremental.MONTH)
    return incremental.read_daily(t.spark, path, incremental.MONTH)


@query
def max_updated_at(t: DriverTables) -> DataFrame:
    stamped = t.raw("lineitem").select(F.col("l_suppkey").alias("vendor_id"), F.to_date("l_shipdate").alias("updated_at"))
    return orders.max_updated_at(stamped, "updated_at", "vendor_id")


# --- ranking and order --------------------------------------------------------


@query
def best_worst_selling(t: DriverTables) -> DataFrame:
    return _performance(t)


@query
def best_worst_item(t: DriverTables) -> DataFrame:
    return reviews.best_worst_item(reviews.item_review_ratios(_comments(t)))


@query
def ffill_daily(t: DriverTables) -> DataFrame:
    return timeseries.ffill_daily(timeseries.daily_spine(_daily(t)))


@query
def next_day_change(t: DriverTables) -> DataFrame:
    return _next_day(t)


@query
def topk_per_query(t: DriverTables) -> DataFrame:
    return vectors.cosine_topk(t.menu_items.filter("embedding IS NOT NULL"), t.root_items, menu.CANDIDATES)


@query
def component_limit(t: DriverTables) -> DataFrame:
    components, reranked, flags = _resolved(t)
    best = menu.best_root_items(reranked, flags, NON_VEG)
    return menu.component_limit(best, components).select("item_id", "position", "root_id", "name", "place")


@query
def sentence_windows(t: DriverTables) -> DataFrame:
    return menu.sentence_windows(t.raw("documents").select("doc_id", "text"))


@query
def session_turns(t: DriverTables) -> DataFrame:
    return sessions.session_turns(t.raw("conversations"))


@query
def unanswered_turns(t: DriverTables) -> DataFrame:
    return sessions.unanswered_turns(t.raw("conversations"))


@query
def session_history(t: DriverTables) -> DataFrame:
    return sessions.session_history(sessions.session_turns(t.raw("conversations")))


@query
def candidate_union(t: DriverTables) -> DataFrame:
    return _candidates(t)[1]


# --- time series --------------------------------------------------------------


@query
def daily_spine(t: DriverTables) -> DataFrame:
    return timeseries.daily_spine(_daily(t))


@query
def dow_features(t: DriverTables) -> DataFrame:
    return timeseries.dow_features(_daily(t))


@query
def forecast_frame(t: DriverTables) -> DataFrame:
    return timeseries.forecast_frame(_daily(t), 28)


@query
def holiday_features(t: DriverTables) -> DataFrame:
    return timeseries.holiday_features(_daily(t), t.holidays)


@query
def sarimax_forecast(t: DriverTables) -> DataFrame:
    filled = timeseries.ffill_daily(timeseries.daily_spine(_all_daily(t)))
    return timeseries.sarimax_forecast(filled, training_days=TRAINING_DAYS)


@query
def seasonal_forecast(t: DriverTables) -> DataFrame:
    return timeseries.seasonal_forecast(_all_daily(t), t.as_of, HORIZON, schedules=t.vendor_schedules, holidays=t.holidays)


@query
def product_forecast(t: DriverTables) -> DataFrame:
    daily = orders.product_daily_qty(t.order_headers, t.order_items, t.as_of, 60, timeseries.PRODUCT)
    listed = ingredients.menu_ingredients(t.vendor_menu, t.ingredients_data).withColumn(
        "ingredients", F.array_join(F.transform("ingredients", lambda i: i["ingredient"]), ", ")
    )
    return timeseries.product_forecast(daily, listed, _comments(t), t.as_of, 30, t.holidays)


@query
def item_level_forecast(t: DriverTables) -> DataFrame:
    return _item_forecast(t)


# --- menu resolution ----------------------------------------------------------


@query
def normalize_name(t: DriverTables) -> DataFrame:
    return t.menu_names.withColumn("normalized", text.normalize_name(F.col("name")))


@query
def spell_correct(t: DriverTables) -> DataFrame:
    spellings = {"gizmo": "gadget", "anvil": "block", "rod": "bar"}
    return t.menu.select("id", text.spell_correct(F.col("name"), spellings).alias("corrected"))


def _misspelt(t: DriverTables) -> DataFrame:
    """Product names with a letter lost, doubled or replaced by product number."""
    name, key = F.col("p_name"), F.col("p_partkey")
    lost = F.concat(F.substring(name, 1, 1), F.expr("substring(p_name, 3)"))
    doubled = F.concat(name, F.expr("right(p_name, 1)"))
    other = F.regexp_replace(name, "i|o", "u")
    wrong = F.when(key % 4 == 1, lost).when(key % 4 == 2, doubled).when(key % 4 == 3, other).otherwise(name)
    return t.raw("part").select(key.alias("id"), wrong.alias("name"))


@query
def spell_correct_free(t: DriverTables) -> DataFrame:
    known = names.vocabulary(t.raw("part").select(F.col("p_name").alias("name")), ("bult",))
    return names.correct_names(_misspelt(t), known)


@query
def name_candidates(t: DriverTables) -> DataFrame:
    components = menu.menu_components(menu.folded_names(t.menu_names, False))
    roots = menu.normalized_catalogue(t.root_items.select("id", "name"), False)
    return names.name_candidates(components, roots, menu.PLAIN_CANDIDATES, 0.3)


@query
def strip_noise(t: DriverTables) -> DataFrame:
    return t.menu_names.withColumn("stripped", text.strip_noise(F.col("name")))


@query
def split_components(t: DriverTables) -> DataFrame:
    return menu.menu_components(t.menu_names, _root_names(t))


@query
def quantity_details(t: DriverTables) -> DataFrame:
    return t.menu_names.withColumn("quantity_details", text.quantity_details(F.col("name")))


@query
def is_ambiguous(t: DriverTables) -> DataFrame:
    return t.menu_names.withColumn("is_ambiguous", text.is_ambiguous(F.col("name"), VAGUE, AMBIGUOUS_WORD))


@query
def is_mrp(t: DriverTables) -> DataFrame:
    return t.menu_names.withColumn("is_mrp", text.is_mrp(F.col("name"), BRANDS))


@query
def is_veg(t: DriverTables) -> DataFrame:
    return t.menu_names.withColumn("is_veg", text.is_veg(F.col("name"), NON_VEG))


@query
def title_case(t: DriverTables) -> DataFrame:
    return t.menu.select("id", text.title_case(F.col("name")).alias("title"))


@query
def cosine_topk(t: DriverTables) -> DataFrame:
    every = t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.cosine_topk(every, every, menu.PLAIN_CANDIDATES)


@query
def ann_topk(t: DriverTables) -> DataFrame:
    every = t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.ann_topk(every, every, menu.PLAIN_CANDIDATES)


def block_index(dims: int) -> vectors.Index:
    """An index by hand: a centroid per four dimensions, the signs of four residuals as a code, one reach."""
    centroids = np.kron(np.eye(dims // 4), np.full((1, 4), 0.5))
    signs = np.array(list(itertools.product((-1, 1), repeat=4))) * CODE_STEP
    return vectors.Index(centroids, np.repeat(signs[None], dims // 4, axis=0), np.full(dims // 4, CODE_REACH))


@query
def ann_topk_fixed(t: DriverTables) -> DataFrame:
    every = t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    dims = every.select(F.max(F.size("embedding"))).first()[0] or 0
    return vectors.ann_topk(every, every, menu.PLAIN_CANDIDATES, index=block_index(dims))


@query
def rerank(t: DriverTables) -> DataFrame:
    return _resolved(t)[1].select("item_id", "position", "component", "root_id", "similarity", "relevance", "rank")


@query
def map_to_root_items(t: DriverTables) -> DataFrame:
    return _mapped(t)


@query
def attach_nutrition(t: DriverTables) -> DataFrame:
    nutrition = t.raw("part").groupBy(F.initcap("p_name").alias("quantity_component")).agg(
        F.max("p_size").alias("energy")
    )
    return menu.attach_nutrition(_mapped(t), nutrition)


@query
def evaluate_mapping(t: DriverTables) -> DataFrame:
    return menu.match_rate(menu.evaluate_mapping(_predictions(t)), "master_menu_name")


# --- inference ----------------------------------------------------------------


def _size_model() -> inference.Model:
    return lambda prompts: [f"{len(p)} characters" for p in prompts]


def _digest_model() -> inference.Model:
    return lambda prompts: [hashlib.md5(p.encode()).hexdigest()[:8] for p in prompts]


def _strict_model() -> inference.Model:
    """Answers short prompts and refuses long ones."""

    def answer(prompts):
        if any(len(p) > 22 for p in prompts):
            raise ValueError("prompt too long")
        return [p.upper() for p in prompts]

    return answer


MODELS = {"size": _size_model, "digest": _digest_model, "strict": _strict_model}


@query
def llm_batch(t: DriverTables) -> DataFrame:
    prompts = t.raw("conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return inference.llm_batch(prompts, MODELS, "size").drop("prompt", "error")


@query
def render_prompt(t: DriverTables) -> DataFrame:
    return _prompts(t)


@query
def render_feedback(t: DriverTables) -> DataFrame:
    return inference.render_feedback(FEEDBACK_TEMPLATE, _comments(t))


@query
def prompt_cache(t: DriverTables) -> DataFrame:
    asked = t.raw("conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    # Every question was asked before, the higher its session the longer ago.
    stored = t.raw("conversations").filter("role = 'user'").select(
        F.md5("text").alias("prompt_md5"),
        F.concat(F.lit("stored "), F.md5("text")).alias("response"),
        (F.lit(CACHE_EPOCH) - F.make_dt_interval(secs=F.col("conv_id") * 60)).alias("created_at"),
    )
    answered = inference.prompt_cache(asked, stored, CACHE_EPOCH, MODELS, "digest")
    return answered.select("conv_id", "turn", "prompt_md5", "response", "cache_hit")


@query
def parse_structured(t: DriverTables) -> DataFrame:
    parsed = inference.parse_structured(t.raw("events").select("event_id", "props"), "struct<k:bigint>", ["k"], "props")
    return parsed.select("event_id", F.col("parsed.k").alias("k"), "valid")


@query
def answer_violations(t: DriverTables) -> DataFrame:
    """Forecast answers, one per order and a day per line, with fields that are lost, mistyped or null by number."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    count = (
        F.when((order % 5 == 1) & (line % 2 == 0), '"many"').when((order % 5 == 2) & (line % 3 == 0), "null")
        .when((order % 5 == 3) & (line % 2 == 1), "2.5").otherwise(line.cast("string"))
    )
    date = F.when((order % 3 == 1) & (line % 4 == 1), "").otherwise('"date": "2025-02-01", ')
    day = F.when((order % 11 == 4) & (line == 2), "7").otherwise(F.concat(F.lit("{"), date, F.lit('"order_count": '), count, F.lit("}")))
    days = t.raw("lineitem").groupBy(order.alias("order_id")).agg(F.sort_array(F.collect_list(F.struct(line.alias("line"), day.alias("day")))).alias("days"))
    reason = F.when(F.col("order_id") % 4 == 2, "").otherwise(', "reasoning": "as before", "more": 1')
    whole = F.concat(F.lit('```json{"order_data": ['), F.array_join("days.day", ", "), F.lit("]"), reason, F.lit("}```"))
    answer = F.when(F.col("order_id") % 13 == 0, "Sorry, no forecast").when(F.col("order_id") % 13 == 1, '{"order_data": {}, "reasoning": 5}').otherwise(whole)
    checked = answers.checked_answers(days.select("order_id", answer.alias("response")), schemas.DAY_FORECAST)
    return answers.violations(checked, "order_id")


@query
def parse_fenced_json(t: DriverTables) -> DataFrame:
    """Three kinds of answer by product size: a fenced list, one with an apostrophe, and prose."""
    id_, name, size = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size")
    plain = F.concat(F.lit("```json[{'id': "), id_, F.lit(", 'name': '"), name, F.lit("'}, {'id': -7, 'name': 'x'}]```"))
    apostrophe = F.concat(F.lit('```json[{"id": '), id_, F.lit(', "name": "'), name, F.lit("'s\"}]```"))
    answer = F.when(size <= 20, plain).when(size <= 40, apostrophe).otherwise(F.concat(F.lit("Sorry, no "), name))
    given = t.raw("part").select("p_partkey", answer.alias("response"))
    return inference.parse_fenced_json(given, schemas.RANKED_ITEMS).drop("response")


@query
def retry(t: DriverTables) -> DataFrame:
    prompts = t.menu.select("id", F.col("name").alias("prompt"))
    return inference.llm_batch(prompts, MODELS, "strict")


@query
def _vendor_context(t: DriverTables) -> DataFrame:
    history = sessions.session_history(sessions.session_turns(t.raw("conversations"))).select(
        (F.col("conv_id") % t._size("supplier")).alias("vendor_id"), "conv_id", "part", "history_used", "history"
    )
    hours = vendors.vendor_schedule_hours(t.vendor_schedules, t.location, t.company, t.addresses, t.states, t.cities)
    return vendor_context(
        t.vendor, _revenue(t), _performance(t), t.holidays, hours, reviews.reviews_by_date(_comments(t)), history
    )


# --- shared steps -------------------------------------------------------------


def _comments(t: DriverTables) -> DataFrame:
    return reviews.review_comments(t.review, t.review_responses, t.review_options, t.as_of)


def _signals(t: DriverTables, words: tuple[str, ...]) -> DataFrame:
    return reviews.review_signals(t.review, t.review_responses, t.review_options, t.as_of, words=words)


def _daily(t: DriverTables) -> DataFrame:
    return orders.vendor_daily_orders(t.sales_order, t.as_of)


def _all_daily(t: DriverTables) -> DataFrame:
    return t.sales_order.groupBy("vendor_id", "created_date").agg(F.count("*").alias("order_count"))


def _product_counts(t: DriverTables) -> DataFrame:
    return orders.product_daily_counts(t.order_headers, t.order_items, t.menu, t.as_of)


def _next_day(t: DriverTables) -> DataFrame:
    return orders.next_day_change(_product_counts(t))


def _item_sales(t: DriverTables) -> DataFrame:
    return orders.item_sales_price(t.order_headers, t.order_items, t.menu, t.as_of)


def _revenue(t: DriverTables) -> DataFrame:
    return orders.daily_revenue(t.order_headers, t.order_items, t.menu, t.as_of, excluded=EXCLUDED)


def _performance(t: DriverTables) -> DataFrame:
    totals = orders.item_total_orders(_item_sales(t))
    return orders.best_worst_selling(totals, reviews.item_rating(_comments(t), totals))


def _item_forecast(t: DriverTables) -> DataFrame:
    return timeseries.item_level_forecast(_product_counts(t), t.as_of, schedules=t.vendor_schedules, holidays=t.holidays)


def _compared(t: DriverTables) -> DataFrame:
    daily = _all_daily(t)
    cut = t.as_of - dt.timedelta(days=BACKTEST_DAYS)
    forecast = timeseries.seasonal_forecast(daily, cut, BACKTEST_DAYS, schedules=t.vendor_schedules, holidays=t.holidays)
    came = daily.filter(F.col("created_date") > F.lit(cut))
    return timeseries.predicted_vs_actual(forecast, came)


def _root_names(t: DriverTables) -> DataFrame:
    """Catalogue of component names: what products and their kinds are called once noise is gone."""
    names = t.raw("part").select(F.explode(F.array("p_name", F.lower("p_type"))).alias("name")).distinct()
    return names.select(text.strip_noise(F.col("name")).alias("name")).filter("name <> ''").distinct()


def _candidates(t: DriverTables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    read, roots, components = menu.read_names(t.menu_items, t.root_items, BRANDS, NON_VEG, VAGUE, AMBIGUOUS_WORD)
    wanted = t.menu_items.join(read.filter(menu.SEARCHED).select("id"), "id", "left_semi")
    found = vectors.cosine_topk(wanted.filter("embedding IS NOT NULL"), t.root_items, menu.CANDIDATES)
    by_name = names.name_candidates(components, roots, menu.CANDIDATES)
    return components, menu.component_candidates(components, found, by_name), read, roots


def _resolved(t: DriverTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    components, candidates, flags, roots = _candidates(t)
    return components, menu.rerank(candidates, roots), flags


def _mapped(t: DriverTables) -> DataFrame:
    return menu.map_to_root_items(
        t.menu_items, t.root_items, brands=BRANDS, non_veg=NON_VEG, vague=VAGUE, ambiguous_word=AMBIGUOUS_WORD
    )


def _predictions(t: DriverTables) -> DataFrame:
    """Predicted names: right in other letters for small products, a kind for middling ones, none for large ones."""
    size = F.col("p_size")
    return t.raw("part").select(
        F.col("p_partkey").cast("int").alias("menu_id"),
        F.col("p_name").alias("menu_name"),
        F.col("p_partkey").cast("int").alias("master_menu_id"),
        F.col("p_name").alias("master_menu_name"),
        F.when(size <= 20, F.upper("p_name")).when(size <= 40, F.col("p_type")).alias("predicted_menu_name"),
        (size > 25).alias("eval_current"),
        F.when(size > 30, size > 40).alias("is_approved"),
    )


def _prompts(t: DriverTables) -> DataFrame:
    places = vendors.vendor_geo(t.vendor, t.vendor_location, t.location, t.addresses, t.states, t.cities)
    week = vendors.schedule_by_day(t.vendor_schedules)
    return inference.render_prompt(TEMPLATE, t.vendor, _daily(t), week, t.holidays, places)
