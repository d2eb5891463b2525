import datetime as dt

import pytest

from platewise.operators import inference, reviews

DAY = dt.date(2025, 1, 10)
COMMENTS = "review_id bigint, vendor_id bigint, order_items string, rating string, user_comment string, comment_date date"


def comments(spark, *rows):
    return spark.createDataFrame([(i, 1, item, f"{n}/5", text, DAY) for i, (item, n, text) in enumerate(rows)], COMMENTS)


def signals(spark, *rows):
    return reviews.comment_signals(comments(spark, *rows))


@pytest.mark.parametrize(
    "rating, text, score", [(5, "great food", 72.8), (1, "", 9.8), (1, None, 9.8), (3, "not good", 44.4), (5, "chocolate", 55.2)]
)
def test_sentiment_score(spark, rating, text, score):
    found = reviews.sentiment_score(signals(spark, ("a", rating, text))).first()["sentiment_score"]
    # 'chocolate' contains 'late': 0.7·(70 − 4) + 0.3·30
    assert found == pytest.approx(score)


def test_ratings_out_of_range_are_counted(spark):
    found = reviews.sentiment_score(signals(spark, ("a", 5, ""), ("a", 9, ""))).first()
    assert (found["scored_reviews"], found["excluded_reviews"]) == (1, 1)


def test_delivery_share_must_exceed_the_threshold(spark):
    ten = [("a", 5, "delivery ok")] * 7 + [("a", 1, "delivery")] * 3
    found = reviews.delivery_sentiment(signals(spark, *ten)).first()
    assert (found["sentiment"], found["negative_review_percentage"]) == ("positive", 30.0)
    found = reviews.delivery_sentiment(signals(spark, ("a", 1, "tasty"))).first()
    assert (found["sentiment"], found["negative_review_percentage"]) == ("neutral", 0.0)


def test_breakdown_totals_100(spark):
    found = reviews.sentiment_breakdown(comments(spark, ("a", 5, ""), ("a", 3, ""), ("a", 1, ""))).first()
    assert sum(found[c] for c in found.asDict() if c != "vendor_id") == pytest.approx(100)


def test_comment_assembly(spark, rows):
    review = spark.createDataFrame(
        [(1, 9, 4, "order", dt.datetime(2025, 1, 2, 10), DAY, "Dosa"), (2, 9, 2, "order", dt.datetime(2025, 1, 3, 10), DAY, "Idli"),
         (3, 9, 2, "vendor", dt.datetime(2025, 1, 3, 10), DAY, "Idli"), (4, 9, 2, "order", dt.datetime(2025, 1, 3, 10), dt.date(2024, 1, 1), "Idli")],
        "id bigint, vendor_id bigint, rating int, reference string, created_at timestamp, order_created_date date, order_items string",
    )
    options = spark.createDataFrame(
        [(1, "text", "q"), (2, "checkbox", "Fresh"), (3, "star", "s"), (4, "checkbox", "Cold")], "id bigint, type string, question string"
    )
    responses = spark.createDataFrame(
        [(12, 1, 2, "true"), (11, 1, 1, "nice"), (13, 1, 3, "4"), (14, 1, 4, "0"), (15, 1, 3, "")],
        "id bigint, review_id bigint, review_option_id bigint, value string",
    )
    found = reviews.review_comments(review, responses, options, DAY).select("review_id", "rating", "user_comment")
    assert rows(found) == [(1, "4/5", "nice. Fresh. star:4. . "), (2, "2/5", "")]
    only = reviews.review_comments(review, responses, options, DAY, item="Idli")
    assert [r["review_id"] for r in only.collect()] == [2]


def test_busy_day_is_split_and_kept_whole(spark):
    many = comments(spark, *[("a", 5, f"c{i}") for i in range(95)])
    parts = reviews.reviews_by_date(many, part_size=10).collect()
    assert len(parts) == 10
    assert sum(p["reviews"] for p in parts) == 95
    assert sum(p["review_text"].count("\n") + 1 for p in parts) == 95


def test_item_rating_without_reviews(spark):
    totals = spark.createDataFrame(
        [(1, "a", 3, 2.0), (1, "b", 4, 2.0)], "vendor_id bigint, menu_name string, orders bigint, price double"
    )
    found = {r["menu_name"]: r["rating"] for r in reviews.item_rating(comments(spark, ("a", 5, ""), ("a", 2, "")), totals).collect()}
    assert found == {"a": 3.5, "b": None}


def test_best_and_worst_item(spark):
    rated = comments(spark, ("a", 5, ""), ("b", 5, ""), ("b", 4, ""), ("c", 1, ""), ("c", 5, ""))
    found = reviews.best_worst_item(reviews.item_review_ratios(rated)).first()
    assert (found["best_item"], found["worst_item"]) == ("b", "c")


def test_long_word_lists_take_several_columns(spark):
    words = tuple(f"w{i}x" for i in range(150))
    rated = comments(spark, ("a", 4, "W3x w70x w149x"), ("a", 4, None))
    found = reviews.comment_signals(rated, words).select("commented", reviews.matches(words[60:], words).alias("n")).collect()
    assert [(r["commented"], r["n"]) for r in found] == [(True, 2), (False, 0)]
    with pytest.raises(ValueError, match="words without a bit"):
        reviews.matches(["other"], words)


def test_signals_equal_those_of_the_assembled_comments(spark, rows):
    """The short way, bits per segment, agrees with searching the whole comment."""
    texts = ["Good. Not", "good and LATE", "", None, "late delivery", "packed. Bad", "price"]
    review = spark.createDataFrame(
        [(i, 1, 1 + i % 5, "order", dt.datetime(2025, 1, 2), DAY, "a") for i in range(40)],
        "id bigint, vendor_id bigint, rating int, reference string, created_at timestamp, order_created_date date, order_items string",
    )
    answers = [(i * 10 + j, i, j % 3, texts[(i * 3 + j * j) % len(texts)]) for i in range(35) for j in range(i % 4)]
    responses = spark.createDataFrame(answers, "id bigint, review_id bigint, review_option_id bigint, value string")
    options = spark.createDataFrame([(0, "text", "q"), (1, "text", "q"), (2, "star", "q")], "id bigint, type string, question string")
    short = reviews.review_signals(review, responses, options, DAY)
    long = reviews.comment_signals(reviews.review_comments(review, responses, options, DAY))
    assert rows(short.select(*long.columns)) == rows(long)
    assert short.filter("commented").count() > 10


def test_ids_in_steps_are_spread_over_the_parts(spark):
    """All ids of a group may be alike modulo any number of parts."""
    base = spark.range(6000).selectExpr(
        "id * 3000 AS review_id", "CAST(1 AS bigint) AS vendor_id", "'Dosa' AS order_items", "'4/5' AS rating",
        "concat('c', id) AS user_comment", "DATE'2025-01-01' AS comment_date",
    )
    parts = [r["reviews"] for r in reviews.reviews_by_date(base, part_size=1000).collect()]
    assert len(parts) == 6 and sum(parts) == 6000 and max(parts) < 1200
    prompts = inference.render_feedback("{reviews}", base, part_size=1000).collect()
    assert len(prompts) == 6 and sum(p["prompt"].count("\n") + 1 for p in prompts) == 6000


def test_only_responses_of_the_window_are_searched(spark):
    """Responses meet the window's reviews before their text is read."""
    review = spark.createDataFrame(
        [(1, 9, 4, "order", dt.datetime(2025, 1, 2, 10), DAY, "Dosa"), (2, 9, 2, "order", dt.datetime(2024, 1, 3, 10), dt.date(2024, 1, 1), "Idli")],
        "id bigint, vendor_id bigint, rating int, reference string, created_at timestamp, order_created_date date, order_items string",
    )
    options = spark.createDataFrame([(1, "text", "q")], "id bigint, type string, question string")
    responses = spark.createDataFrame(
        [(11, 1, 1, "great"), (12, 2, 1, "great, tasty")], "id bigint, review_id bigint, review_option_id bigint, value string"
    )
    signals = reviews.review_signals(review, responses, options, DAY)
    assert [r["review_id"] for r in signals.collect()] == [1]
    plan = signals._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = lambda i: len(lines[i]) - len(lines[i].lstrip(" :+-"))
    search = next(i for i, line in enumerate(lines) if "Contains(" in line or "contains(" in line.lower())
    semi = next(i for i, line in enumerate(lines) if "Join LeftSemi" in line)
    assert semi > search and depth(semi) > depth(search)
