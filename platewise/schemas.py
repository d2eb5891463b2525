"""Schemas of the canonical tables and of structured model answers."""

from __future__ import annotations

from pyspark.sql import types as T

SALES_ORDER = "id bigint, vendor_id bigint, employee_id bigint, status string, created_date date, location_id bigint, total_value decimal(14,2)"
ORDER_ITEMS = "order_item_id bigint, order_id bigint, product_id bigint, price double, qty int"
VENDOR = "id bigint, vendor_name string, description string, company_id bigint, active int"
VENDOR_MENU = "id bigint, vendor_id bigint, name string, price double, active int"
VENDOR_SCHEDULES = "vendor_id bigint, location_id bigint, day_of_week int, start_time string, end_time string, active int"
VENDOR_LOCATION = "vendor_id bigint, location_id bigint, active int"
LOCATION = "id bigint, name string, company_id bigint, address_id bigint, active int"
ADDRESSES = "id bigint, state_id bigint, city_id bigint"
NAMED = "id bigint, name string"
REVIEW = "id bigint, vendor_id bigint, rating int, reference string, created_at timestamp, order_created_date date, order_items string"
REVIEW_OPTIONS = "id bigint, type string, question string, rating int, active int"
REVIEW_RESPONSES = "id bigint, review_id bigint, review_option_id bigint, value string"
INGREDIENTS_DATA = "id bigint, vendor_id bigint, menu_name string, ingredients string"
HOLIDAYS = "date date, holiday string, region string, weightage int"
IMAGE_MAPPINGS = "reference_type string, reference_id bigint, folder string, file_name string"
ROOT_ITEM_VECTORS = "id bigint, name string, embedding array<float>"
PROMPT_CACHE = "prompt_md5 string, response string, created_at timestamp"

TABLES = {
    "sales_order": SALES_ORDER,
    "order_items": ORDER_ITEMS,
    "vendor": VENDOR,
    "vendor_menu": VENDOR_MENU,
    "vendor_schedules": VENDOR_SCHEDULES,
    "vendor_location": VENDOR_LOCATION,
    "location": LOCATION,
    "addresses": ADDRESSES,
    "states": NAMED,
    "cities": NAMED,
    "company": NAMED,
    "review": REVIEW,
    "review_options": REVIEW_OPTIONS,
    "review_options_response": REVIEW_RESPONSES,
    "ingredients_data": INGREDIENTS_DATA,
    "holidays": HOLIDAYS,
    "image_mappings": IMAGE_MAPPINGS,
    "root_item_vectors": ROOT_ITEM_VECTORS,
    "prompt_cache": PROMPT_CACHE,
}

# Feeds.
DAILY_FEED = "date date, order_count bigint"
ORDER_FEED = (
    "vendor_id bigint, product_id bigint, product_price double, created_date string, "
    "order_count int, day_of_week string, location_id bigint, occasion_id bigint, employee_id bigint"
)
# The feed spells the fourth-party column this way.
REVIEW_FEED = (
    "vendor_id bigint, location_id bigint, ocassion_id bigint, menu_id string, menu_name string, "
    "pricing double, rating int, comment string, date string"
)
PROMPT_FEED = "prompt_id int, prompt string"
ROOT_ITEM_FEED = "id string, name string, trace_ids string"

# Result tables of the menu mapping.
MENU_MAPPING_PREDICTIONS = (
    "menu_id int, menu_name string, corrected_menu_name string, quantitative_menu_name string, "
    "master_menu_id int, master_menu_name string, eval_current boolean, predicted_menu_name string, "
    "eval_prediction boolean, log_id int, response string, ranked_nodes string, is_approved boolean"
)
MODEL_LOGS = "id int, model_name string, embedding_model string, prompt string"

# Structured answers.
INGREDIENTS = "array<struct<ingredient:string,measurement_unit:string,measurement_value:double>>"
ORDER_FORECAST = "struct<order_data:array<struct<date:string,product_name:string,order_count:int>>,reasoning:string>"
RANKED_ITEMS = "array<struct<id:string,name:string,relevance_score:double>>"

# The fields of nested answers, where NOT NULL marks the required ones.
DAY_FORECAST = "struct<order_data:array<struct<date:string NOT NULL,order_count:int NOT NULL>> NOT NULL,reasoning:string NOT NULL>"
PRODUCT_FEEDBACK = (
    "struct<feedback_summary:array<struct<points:string NOT NULL>> NOT NULL,"
    "suggestions:array<struct<points:string NOT NULL>> NOT NULL,rating_score:double NOT NULL>"
)
SENTIMENT_ANSWER = (
    "struct<sentiment_breakdown:struct<general_sentiment:string NOT NULL,positive_review_percentage:double NOT NULL,"
    "neutral_review_percentage:double NOT NULL,negative_review_percentage:double NOT NULL,"
    "high_price_complain_reviews:double NOT NULL,sentiment_score:double NOT NULL> NOT NULL,"
    "marketing_suggestions:struct<bundle_items:array<string>,promotional_strategies:array<string>>,"
    "pricing_optimization:struct<price_strategy:string,value_add_suggestions:array<string>>,"
    "best_item:struct<name:string NOT NULL,postive_neutral_review_percentage:double NOT NULL,reasoning:string NOT NULL> NOT NULL,"
    "worst_item:struct<name:string NOT NULL,negative_review_percentage:double NOT NULL,reasoning:string NOT NULL,"
    "marketing_suggestions:struct<improvement_suggestions:array<string>,alternative_items:array<string>> NOT NULL,"
    "pricing_optimization:struct<price_suggestion:string,bundle_suggestions:array<string>> NOT NULL> NOT NULL,"
    "delivery_packing_review_sentiment:struct<sentiment:string NOT NULL,negative_review_percentage:double NOT NULL>>"
)
NUTRITION_ANSWER = (
    "struct<quantity:string NOT NULL,energy:string NOT NULL,carbohydrates:string NOT NULL,"
    "fiber:string NOT NULL,protein:string NOT NULL,fat:string NOT NULL>"
)

# The order-status vocabulary.
ORDER_STATUSES = (
    "payment_pending", "approval_pending", "preorder", "new", "attention_required", "agent_picked",
    "payment_failed", "partially_confirmed", "confirmed", "partially_rejected", "in-transit",
    "partially_processed", "processed", "ready_for_pickup", "picked_up", "out_for_delivery",
    "reached_location", "rejected", "handed_over", "partially_delivered", "delivered", "not collected",
)


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
