"""Canonical tables derived from the driver's TPC-H-like tables."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions.dates import sunday_zero
from platewise.operators.timeseries import HOLIDAYS, holiday_calendar
from platewise.sources.readers import scan_parquet

# Days from the reference day on which the default holidays are placed, since
# the driver's orders lie in other years.
HOLIDAY_OFFSETS = (-75, -40, -12, 3, 6, 10, 17, 25)

# Schemas of the driver's tables; declaring them saves a job per read that infers them.
RAW_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Wording of the checkbox option by document language.
QUESTIONS = {
    "en": "Fresh food and good delivery",
    "fr": "Late and poor packaging",
    "es": "Expensive for the price",
}
QUESTION_ELSE = "Packed cold, not good"


class DriverTables:
    """The canonical tables of one data directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self._read: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A driver table; its files are listed once however many operators read it."""
        if name not in self._read:
            self._read[name] = scan_parquet(self.spark, self.directory, name, RAW_TABLES[name])
        return self._read[name]

    @cached_property
    def as_of(self) -> dt.date:
        """The last order day; a literal, so that date filters reach the scan."""
        return self.raw("orders").agg(F.to_date(F.max("o_orderdate"))).first()[0]

    def _size(self, table: str) -> Column:
        return self.raw(table).agg(F.count("*")).scalar()

    # --- orders -------------------------------------------------------------

    @cached_property
    def order_headers(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("employee_id"),
            F.col("o_orderstatus").alias("status"),
            F.to_date("o_orderdate").alias("created_date"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_suppkey").alias("vendor_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("bigint").alias("qty"),
            F.col("l_extendedprice").alias("price"),
        )

    @cached_property
    def sales_order(self) -> DataFrame:
        """An order once per vendor it holds items of; key (id, vendor_id)."""
        sellers = self.raw("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("vendor_id"))
        return self.order_headers.join(sellers, "id").distinct()

    # --- menus and vendors --------------------------------------------------

    @cached_property
    def menu(self) -> DataFrame:
        """Products by id."""
        return self.raw("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")
        )

    @cached_property
    def vendor_menu(self) -> DataFrame:
        listed = self.raw("lineitem").select(F.col("l_suppkey").alias("vendor_id"), F.col("l_partkey").alias("id")).distinct()
        product = self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_retailprice").alias("price"),
            (F.col("p_size") <= 45).cast("int").alias("active"),
            "p_type",
            "p_brand",
            "p_size",
        )
        return listed.join(product, "id")

    @cached_property
    def vendor(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("vendor_name"),
            F.concat(F.lit("Balance "), F.col("s_acctbal").cast("decimal(18,2)").cast("string")).alias("description"),
            F.col("s_nationkey").cast("bigint").alias("company_id"),
            (F.col("s_acctbal") > 0).cast("int").alias("active"),
        )

    @cached_property
    def company(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))

    @property
    def cities(self) -> DataFrame:
        return self.company

    @cached_property
    def states(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def addresses(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast("bigint").alias("id"),
            F.col("n_regionkey").cast("bigint").alias("state_id"),
            F.col("n_nationkey").cast("bigint").alias("city_id"),
        )

    @cached_property
    def location(self) -> DataFrame:
        key = F.col("n_nationkey").cast("bigint")
        return self.raw("nation").select(
            key.alias("id"),
            F.concat(F.lit("Site "), "n_name").alias("name"),
            key.alias("company_id"),
            key.alias("address_id"),
            (F.col("n_nationkey") > 4).cast("int").alias("active"),
        )

    @cached_property
    def vendor_location(self) -> DataFrame:
        """A vendor serves the nations of its own region."""
        nation = self.raw("nation")
        home = nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        near = nation.select(F.col("n_nationkey").cast("bigint").alias("location_id"), "n_regionkey")
        return (
            self.raw("supplier")
            .join(home, "s_nationkey")
            .join(near, "n_regionkey")
            .select(F.col("s_suppkey").alias("vendor_id"), "location_id", (F.col("s_acctbal") > 1000).cast("int").alias("active"))
        )

    @cached_property
    def vendor_schedules(self) -> DataFrame:
        """Per vendor, weekday and line status; days with many returns are not active."""
        hour = lambda h: F.format_string("%02d:00", h)
        shipped = (
            self.raw("lineitem")
            .groupBy(
                F.col("l_suppkey").alias("vendor_id"),
                sunday_zero(F.to_date("l_shipdate")).alias("day_of_week"),
                "l_linestatus",
            )
            .agg(
                F.min("l_linenumber").alias("low"),
                F.max("l_linenumber").alias("high"),
                (F.count_if(F.col("l_returnflag") == "R") * 3 <= F.count("*")).cast("int").alias("active"),
            )
        )
        home = self.raw("supplier").select(
            F.col("s_suppkey").alias("vendor_id"), F.col("s_nationkey").cast("bigint").alias("location_id")
        )
        return shipped.join(home, "vendor_id").select(
            "vendor_id", "location_id", "day_of_week",
            hour(F.col("low") + 6).alias("start_time"), hour(F.col("high") + 12).alias("end_time"), "active",
        )

    @cached_property
    def image_mappings(self) -> DataFrame:
        """Small products have image a, middling ones image b, some both, large ones none."""
        size = F.col("p_size")
        files = F.filter(
            F.array(F.when(size <= 20, F.lit("a.jpg")), F.when(size.between(11, 40), F.lit("b.jpg"))),
            lambda f: f.isNotNull(),
        )
        return self.raw("part").select(
            F.lit("menu").alias("reference_type"),
            F.col("p_partkey").alias("reference_id"),
            F.lower("p_type").alias("folder"),
            F.explode(files).alias("file_name"),
        )

    @cached_property
    def holidays(self) -> DataFrame:
        return holiday_calendar(
            self.spark,
            [(self.as_of + dt.timedelta(days=d), *rest) for d, (_, *rest) in zip(HOLIDAY_OFFSETS, HOLIDAYS)],
        )

    @cached_property
    def ingredients_data(self) -> DataFrame:
        """Two ingredients per menu name and vendor; none for promotional products."""
        entry = lambda name, unit, value: F.struct(
            name.alias("ingredient"), unit.alias("measurement_unit"), value.cast("double").alias("measurement_value")
        )
        size = F.col("p_size")
        recipe = F.array(
            entry(F.col("p_type"), F.lit("g"), size),
            entry(F.col("p_brand"), F.when(size > 25, "ml").otherwise("g"), size * 10),
        )
        return self.vendor_menu.filter("p_type <> 'PROMO'").select(
            "id", "vendor_id", F.col("name").alias("menu_name"), F.to_json(recipe).alias("ingredients")
        )

    # --- reviews ------------------------------------------------------------

    @cached_property
    def review(self) -> DataFrame:
        doc = self.raw("documents")
        day = F.date_sub(F.lit(self.as_of), (F.col("doc_id") % 120).cast("int"))
        return (
            doc.select(
                F.col("doc_id").alias("id"),
                (F.col("doc_id") % self._size("supplier")).alias("vendor_id"),
                (1 + F.col("doc_id") % 5).cast("int").alias("rating"),
                F.when(F.col("lang") == "de", "vendor").otherwise("order").alias("reference"),
                F.date_add(day, 1).cast("timestamp_ntz").alias("created_at"),
                day.alias("order_created_date"),
                (F.col("doc_id") % self._size("part")).alias("p_partkey"),
            )
            .join(self.raw("part").select("p_partkey", F.col("p_name").alias("order_items")), "p_partkey")
            .drop("p_partkey")
        )

    @cached_property
    def review_options(self) -> DataFrame:
        """Three options per review: its text, a checkbox and a star row."""
        wording = F.lit(QUESTION_ELSE)
        for lang, question in QUESTIONS.items():
            wording = F.when(F.col("lang") == lang, question).otherwise(wording)
        kinds = F.array(F.lit("text"), F.lit("checkbox"), F.lit("star"))
        return (
            self.raw("documents")
            .select("doc_id", "lang", F.posexplode(kinds).alias("i", "type"))
            .select((F.col("doc_id") * 3 + F.col("i")).alias("id"), "type", wording.alias("question"))
        )

    @cached_property
    def review_responses(self) -> DataFrame:
        """Every line of a document answers the text option; two more rows answer the others."""
        answer = lambda value, option: F.struct(value.alias("value"), F.lit(option).alias("option"))
        checked = F.when(F.col("n_chars") % 2 == 0, "true").otherwise("false")
        star = F.when(F.col("n_chars") % 3 == 0, "").otherwise((F.col("n_chars") % 6).cast("string"))
        lines = F.transform(F.split("text", "\n"), lambda line: answer(line, 0))
        return (
            self.raw("documents")
            .select("doc_id", F.posexplode(F.concat(lines, F.array(answer(checked, 1), answer(star, 2)))).alias("i", "answer"))
            .select(
                (F.col("doc_id") * 100000 + F.col("i")).alias("id"),
                F.col("doc_id").alias("review_id"),
                (F.col("doc_id") * 3 + F.col("answer.option")).alias("review_option_id"),
                "answer.value",
            )
        )

    # --- feeds and menu names -----------------------------------------------

    @cached_property
    def order_feed(self) -> DataFrame:
        date = F.to_date("l_shipdate")
        return self.raw("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("feed_id"),
            F.col("l_suppkey").alias("vendor_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_extendedprice").alias("product_price"),
            date.alias("created_date"),
            (F.col("l_linenumber") - 1).alias("order_count"),
            F.date_format(date, "EEEE").alias("day_of_week"),
            F.col("l_partkey").alias("location_id"),
            F.lit(0).cast("bigint").alias("occasion_id"),
            F.col("l_orderkey").alias("employee_id"),
        )

    @cached_property
    def review_feed(self) -> DataFrame:
        """One product id per row, two in English, some of them unknown."""
        parts = self._size("part")
        first = (F.col("doc_id") % parts).cast("string")
        second = ((F.col("doc_id") * 7 + 1) % (parts + 50)).cast("string")
        return self.raw("documents").select(
            F.col("doc_id").alias("feed_id"),
            (F.col("doc_id") % self._size("supplier")).alias("vendor_id"),
            F.col("doc_id").alias("location_id"),
            F.lit(0).cast("bigint").alias("ocassion_id"),
            F.when(F.col("lang") == "en", F.concat_ws(",", first, second)).otherwise(first).alias("menu_id"),
            F.col("source").alias("menu_name"),
            F.col("n_chars").cast("double").alias("pricing"),
            (1 + F.col("doc_id") % 5).cast("int").alias("rating"),
            F.col("text").alias("comment"),
            F.date_sub(F.lit(self.as_of), (F.col("doc_id") % 120).cast("int")).alias("date"),
        )

    @cached_property
    def menu_names(self) -> DataFrame:
        """Free-form names with brand, size words, quantities, prices, and one or two components."""
        size, price = F.col("p_size").cast("string"), F.floor("p_retailprice").cast("string")
        kind = F.lower("p_type")
        name = (
            F.when(F.col("p_size") > 40, F.concat_ws(" ", "p_name", kind))
            .when(F.col("p_size") > 25, F.concat(F.col("p_name"), F.lit(" "), size, F.lit(" ml with "), kind, F.lit(" "), price, F.lit("/-")))
            .when(F.col("p_size") > 10, F.concat(F.lit("AddOn "), F.initcap("p_name"), F.lit(" & "), F.col("p_type"), F.lit(" Rs "), price))
            .otherwise(F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"), F.lit(" ("), size, F.lit(" pcs)")))
        )
        return self.raw("part").select(F.col("p_partkey").alias("id"), name.alias("name"))

    @cached_property
    def root_items(self) -> DataFrame:
        """Catalogue: every product name, with the vector of the same number where there is one."""
        return self.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).join(
            self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left"
        )

    @cached_property
    def menu_items(self) -> DataFrame:
        """Items to resolve: a free-form name, with a vector where there is one."""
        return self.menu_names.join(self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")
