import datetime as dt

import pytest
from pyspark.sql import functions as F

from platewise import schemas, session
from platewise.sources import feeds, readers, writers


# The header lines of the feeds below are fixed values.
def test_order_feed(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(
        "vendor_id,product_id,product_price,created_date,order_count,day_of_week,location_id,occasion_id,employee_id\n"
        "1,2,150,24/12/24,3,Tuesday,5,6,18\n1,2,150,01/01/99,1,Friday,5,6,18\n1,2,150,bad,1,Friday,5,6,18\n"
    )
    found = readers.scan_order_csv(spark, str(path)).collect()
    assert [r["created_date"] for r in found] == [dt.date(2024, 12, 24), dt.date(1999, 1, 1), None]


def test_review_feed_quotes(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(
        "vendor_id,location_id,ocassion_id,menu_id,menu_name,pricing,rating,comment,date\n"
        '1,2,3,4,Upma,40,3,"""Came late, half full.\nAsk again.""",2025-03-12\n1,2,3,5,Kheer,55,4,"""one open quote ",2025-03-13\n'
    )
    found = readers.scan_review_csv(spark, str(path)).collect()
    assert [r["comment"] for r in found] == ['"Came late, half full.\nAsk again."', '"one open quote ']
    assert found[0]["date"] == dt.date(2025, 3, 12)


def test_prompts(spark, tmp_path):
    path = tmp_path / "prompts.csv"
    path.write_text('prompt_id,prompt\n1,"Find ""x"",\nplease"\n2,other\n')
    prompts = readers.scan_prompt_csv(spark, str(path))
    assert readers.prompt_by_id(prompts, 1).first()["prompt"] == 'Find "x",\nplease'
    with pytest.raises(Exception, match="No prompt found for prompt_id: 9"):
        readers.prompt_by_id(prompts, 9).collect()


def test_daily_and_root_items(spark, tmp_path):
    (tmp_path / "d.csv").write_text("date,order_count\n2024-04-01,939\n")
    assert readers.scan_daily_csv(spark, str(tmp_path / "d.csv")).first()["date"] == dt.date(2024, 4, 1)
    (tmp_path / "r.csv").write_text("id,name,trace_ids\n7,Veg Momo,\"1,2\"\n")
    assert readers.scan_root_items(spark, str(tmp_path / "r.csv")).first()["document"] == "7,Veg Momo"


def test_parameters_are_bound(spark):
    df = spark.createDataFrame([("it's",), ("x",)], "s string")
    found = readers.scan_query(spark, "SELECT s FROM {t} WHERE s = :s", {"s": "it's"}, t=df)
    assert [r["s"] for r in found.collect()] == ["it's"]


def test_expand_orders(spark):
    feed = spark.createDataFrame(
        [(1, 9, 5, 2.5, dt.date(2025, 1, 1), 0, 1, 1, 1), (2, 9, 5, 2.5, dt.date(2025, 1, 1), 3, 1, 1, 1)],
        "feed_id bigint, vendor_id bigint, product_id bigint, product_price double, created_date date, order_count int, "
        "location_id bigint, occasion_id bigint, employee_id bigint",
    )
    expanded = feeds.expand_orders(feed)
    assert sorted(r["order_ref"] for r in expanded.collect()) == ["2-1", "2-2", "2-3"]
    assert feeds.expanded_orders(expanded).count() == feeds.expanded_items(expanded).count() == 3
    assert {r["status"] for r in expanded.collect()} == {"new"}


def test_normalise_reviews(spark, rows):
    feed = spark.createDataFrame(
        [(1, 9, 1, "5,4", 3, "ok", dt.date(2025, 1, 1)), (2, 9, 1, "4,77", 1, "bad", dt.date(2025, 1, 1)),
         (3, 9, 1, "4,4", 1, "twice", dt.date(2025, 1, 1)), (4, 9, 1, "x", 1, "text", dt.date(2025, 1, 1))],
        "feed_id bigint, vendor_id bigint, location_id bigint, menu_id string, rating int, comment string, date date",
    )
    menu = spark.createDataFrame([(4, "Dosa"), (5, "Idli")], "id bigint, name string")
    made = feeds.normalise_reviews(feed, menu)
    assert rows(made.review.select("id", "order_items")) == [(1, "Dosa, Idli")]
    assert rows(made.options.select("id", "type")) == [(1, "text")]
    assert rows(made.responses.select("review_id", "value")) == [(1, "ok")]
    assert sorted(r["feed_id"] for r in made.rejected.collect()) == [2, 3, 4]


def test_writers(spark, tmp_path):
    items = spark.createDataFrame([(1, "Dosa")], "id bigint, name string")
    writers.write_lines(items, str(tmp_path / "lines"), "ID,NAME")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["1,Dosa", "ID,NAME"]
    writers.write_json(items.select(F.struct("id", "name").alias("item")), str(tmp_path / "json"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "json")).collect()] == ['{"item":{"id":1,"name":"Dosa"}}']
    for _ in range(2):
        writers.write_predictions(items.select(F.col("id").alias("menu_id")), str(tmp_path / "p"))
        writers.write_model_logs(items.select("id", F.col("name").alias("model_name")), str(tmp_path / "m"))
    found = spark.read.parquet(str(tmp_path / "p"))
    assert found.count() == 2 and found.schema.simpleString() == schemas.struct_of(schemas.MENU_MAPPING_PREDICTIONS).simpleString()
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_daily_aggregates_are_partitioned_by_month(spark, tmp_path):
    daily = spark.createDataFrame([(dt.date(2025, 1, 3), 1), (dt.date(2025, 2, 3), 2)], "created_date date, n int")
    writers.write_daily(daily, str(tmp_path / "daily"))
    january = spark.read.parquet(str(tmp_path / "daily")).filter("month = '2025-01'")
    assert january.count() == 1
    assert "PartitionFilters: [isnotnull(month" in january._jdf.queryExecution().executedPlan().toString()


def test_tables_are_read_under_their_schema(spark, tmp_path):
    spark.createDataFrame([(1, "old")], "id bigint, vendor_name string").write.parquet(str(tmp_path / "vendor"))
    found = readers.scan_table(spark, str(tmp_path), "vendor").first()
    assert (found["vendor_name"], found["active"]) == ("old", None)


def test_scratch_folders_are_shared_or_refused(spark, tmp_path):
    from types import SimpleNamespace

    before = spark.conf.get("spark.checkpoint.dir", None)
    assert session.scratch_path(spark, "x", str(tmp_path)).startswith(f"{tmp_path}/platewise/x-")
    session.scratch_path(spark, "x")
    assert spark.conf.get("spark.checkpoint.dir", None) == before
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError):
        session.scratch_path(cluster, "x")
