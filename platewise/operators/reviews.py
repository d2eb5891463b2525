"""Review operators: comment assembly, sentiment, best and worst items."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import lexicons
from platewise.operators.orders import trailing_window
from platewise.session import spread


def review_reference_filter(
    review: DataFrame, as_of: dt.date, days: int = 90, item: str | None = None
) -> DataFrame:
    """Order reviews of the trailing window, optionally of one exact item."""
    kept = trailing_window(review.filter("reference = 'order'"), as_of, days, "order_created_date")
    return kept if item is None else kept.filter(F.col("order_items") == item)


def comment_segment(kind: Column, question: Column, value: Column) -> Column:
    """The piece of comment one answered option contributes; '' where it says nothing."""
    return (
        F.when(kind == "text", value)
        .when((kind == "checkbox") & value.isin("1", "true"), question)
        .when((kind == "star") & (value != ""), F.concat(kind, F.lit(":"), value))
        .otherwise("")
    )


def response_segments(responses: DataFrame, options: DataFrame) -> DataFrame:
    """One row per response with its segment. Options may be as many as reviews, so no side is forced to be small."""
    described = options.select(F.col("id").alias("review_option_id"), "type", "question")
    return responses.join(described, "review_option_id", "left").select(
        F.col("id").alias("response_id"),
        "review_id",
        "review_option_id",
        "type",
        comment_segment(F.col("type"), F.col("question"), F.col("value")).alias("segment"),
    )


def review_comments(
    review: DataFrame,
    responses: DataFrame,
    options: DataFrame,
    as_of: dt.date,
    days: int = 90,
    item: str | None = None,
) -> DataFrame:
    """One row per review with its segments joined by '. ' in response order.

    The join and the grouping share the review id, so they share one exchange.
    A review without responses has the comment ''.
    """
    kept = _window_reviews(review, as_of, days, item)
    joined = kept.join(response_segments(responses, options), "review_id", "left")
    return (
        joined.withColumn("segment", F.when(F.col("response_id").isNull(), "").otherwise(F.col("segment")))
        .groupBy(*kept.columns)
        .agg(F.expr("listagg(segment, '. ') WITHIN GROUP (ORDER BY response_id)").alias("user_comment"))
    )


def _window_reviews(review: DataFrame, as_of: dt.date, days: int, item: str | None = None) -> DataFrame:
    return review_reference_filter(review, as_of, days, item).select(
        F.col("id").alias("review_id"),
        "vendor_id",
        "order_items",
        F.concat(F.col("rating").cast("string"), F.lit("/5")).alias("rating"),
        F.to_date("created_at").alias("comment_date"),
    )


def stars(rating: str = "rating") -> Column:
    return F.split_part(F.col(rating), F.lit("/"), F.lit(1)).try_cast("int")


# --- words of a comment ---------------------------------------------------------

# Which listed words a comment holds is kept as bits, so that a review shuffles a
# few whole numbers and not its text.
BITS = 62
DELIVERY_RULE_WORDS = lexicons.DELIVERY_WORDS + lexicons.DELIVERY_NEGATIVE_WORDS
# Every rule's words. A job that needs one rule passes that rule's words alone, as each costs a search.
WORDS = tuple(
    dict.fromkeys(lexicons.POSITIVE_WORDS + lexicons.NEGATIVE_WORDS + DELIVERY_RULE_WORDS + lexicons.PRICE_WORDS)
)


def _chunks(words: Sequence[str]) -> list[tuple[str, Sequence[str]]]:
    return [(f"words_{i // BITS}", words[i : i + BITS]) for i in range(0, len(words), BITS)]


def word_bits(text: Column, words: Sequence[str] = WORDS) -> dict[str, Column]:
    """Bit columns telling which words occur in a lower-case text, as substrings."""
    bits = {}
    for name, chunk in _chunks(words):
        mask = F.lit(0).cast("bigint")
        for i, word in enumerate(chunk):
            mask = mask + text.contains(word).cast("bigint") * (1 << i)
        bits[name] = F.coalesce(mask, F.lit(0).cast("bigint"))
    return bits


def matches(wanted: Sequence[str], words: Sequence[str] = WORDS) -> Column:
    """How many of the wanted words a row's bits hold."""
    missing = set(wanted) - set(words)
    if missing:
        raise ValueError(f"words without a bit: {sorted(missing)}")
    hits = F.lit(0)
    for name, chunk in _chunks(words):
        mask = sum(1 << i for i, word in enumerate(chunk) if word in wanted)
        if mask:
            hits = hits + F.bit_count(F.col(name).bitwiseAND(F.lit(mask).cast("bigint")))
    return hits


def comment_signals(comments: DataFrame, words: Sequence[str] = WORDS) -> DataFrame:
    """Word bits of assembled comments, and whether there is a comment at all."""
    text = F.col("user_comment")
    return (
        comments.withColumn("lowered", F.lower(text))
        .withColumns(word_bits(F.col("lowered"), words))
        .withColumn("commented", F.coalesce(text, F.lit("")) != "")
        .drop("lowered", "user_comment")
    )


def review_signals(
    review: DataFrame,
    responses: DataFrame,
    options: DataFrame,
    as_of: dt.date,
    days: int = 90,
    words: Sequence[str] = WORDS,
) -> DataFrame:
    """What :func:`comment_signals` gives for :func:`review_comments`, without building the comments.

    No listed word spans the '. ' between two segments, so each segment is
    searched where it is read and only bits are combined per review, before the
    shuffle as well as after. Responses to reviews outside the window are left out
    before their text is read.
    """
    names = [name for name, _ in _chunks(words)]
    kept = _window_reviews(review, as_of, days)
    inside = responses.join(kept.select("review_id"), "review_id", "left_semi")
    found = (
        response_segments(inside, options)
        .withColumn("lowered", F.lower("segment"))
        .select("review_id", "segment", *[c.alias(n) for n, c in word_bits(F.col("lowered"), words).items()])
        .groupBy("review_id")
        .agg(
            *[F.bit_or(n).alias(n) for n in names],
            ((F.count("segment") > 1) | F.coalesce(F.bool_or(F.col("segment") != ""), F.lit(False))).alias("commented"),
        )
    )
    return (
        kept.join(found, "review_id", "left")
        .na.fill(0, names)
        .withColumn("commented", F.coalesce("commented", F.lit(False)))
    )


def sentiment_score(
    signals: DataFrame,
    positive: Sequence[str] = lexicons.POSITIVE_WORDS,
    negative: Sequence[str] = lexicons.NEGATIVE_WORDS,
    keys: Sequence[str] = ("vendor_id",),
    words: Sequence[str] = WORDS,
) -> DataFrame:
    """Score 0–100 from stars and listed words.

    A review is worth 0.7·20·stars + 0.2·20·(positive − negative) words; the
    score weighs the mean of those 0.7 and the mean of the clamped comment part
    0.3. Both per-review terms are whole numbers, so the sums are exact however
    the rows are split. Ratings outside 1–5 are left out and counted.
    """
    scored = signals.select(
        *keys,
        stars().alias("stars"),
        "commented",
        (matches(positive, words) - matches(negative, words)).alias("tone"),
    ).withColumn("valid", F.coalesce(F.col("stars").between(1, 5), F.lit(False)))
    with_comment = F.col("valid") & F.col("commented")
    value = 14 * F.col("stars") + F.when(F.col("commented"), 4 * F.col("tone")).otherwise(0)
    comment_value = F.greatest(F.lit(0), F.least(F.lit(100), 20 * F.col("tone") + 50))
    sums = scored.groupBy(*keys).agg(
        F.count_if("valid").alias("scored_reviews"),
        F.count_if(~F.col("valid")).alias("excluded_reviews"),
        F.count_if(with_comment).alias("n_commented"),
        F.coalesce(F.sum(F.when(F.col("valid"), value)), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(with_comment, comment_value)), F.lit(0)).alias("comment_total"),
    )
    rating_part = F.when(F.col("scored_reviews") > 0, F.col("total") / F.col("scored_reviews")).otherwise(0.0)
    comment_part = F.when(F.col("n_commented") > 0, F.col("comment_total") / F.col("n_commented")).otherwise(0.0)
    score = (7 * rating_part + 3 * comment_part) / 10
    return sums.select(
        *keys,
        "scored_reviews",
        "excluded_reviews",
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2).alias("sentiment_score"),
    )


def _share(condition: Column) -> Column:
    return F.round(F.count_if(condition) * 100 / F.count("*"), 2)


def sentiment_breakdown(comments: DataFrame) -> DataFrame:
    """Positive (4–5), neutral (3) and negative (1–2) shares that total 100."""
    return (
        comments.withColumn("stars", stars())
        .filter("stars BETWEEN 1 AND 5")
        .groupBy("vendor_id")
        .agg(
            _share(F.col("stars") >= 4).alias("positive_review_percentage"),
            _share(F.col("stars") <= 2).alias("negative_review_percentage"),
        )
        .withColumn(
            "neutral_review_percentage",
            F.round(100 - F.col("positive_review_percentage") - F.col("negative_review_percentage"), 2),
        )
    )


def price_complaints(
    signals: DataFrame, price: Sequence[str] = lexicons.PRICE_WORDS, words: Sequence[str] = WORDS
) -> DataFrame:
    return signals.groupBy("vendor_id").agg(
        F.count_if(matches(price, words) > 0).alias("high_price_complain_reviews")
    )


def delivery_sentiment(
    signals: DataFrame,
    delivery: Sequence[str] = lexicons.DELIVERY_WORDS,
    negative: Sequence[str] = lexicons.DELIVERY_NEGATIVE_WORDS,
    threshold: float = 0.3,
    words: Sequence[str] = WORDS,
) -> DataFrame:
    """Label and negative share of the reviews that speak of delivery or packing."""
    about = matches(delivery, words) > 0
    bad = about & ((stars() <= 2) | (matches(negative, words) > 0))
    counted = signals.groupBy("vendor_id").agg(
        F.count_if(about).alias("total_mentions"), F.count_if(bad).alias("negative_mentions")
    )
    share = F.col("negative_mentions") / F.col("total_mentions")
    mentioned = F.col("total_mentions") > 0
    return counted.withColumn(
        "sentiment", F.when(mentioned, F.when(share > threshold, "negative").otherwise("positive")).otherwise("neutral")
    ).withColumn(
        "negative_review_percentage",
        F.when(mentioned, F.round(F.col("negative_mentions") * 100 / F.col("total_mentions"), 2)).otherwise(0.0),
    )


def item_review_ratios(comments: DataFrame) -> DataFrame:
    return (
        comments.withColumn("stars", stars())
        .filter("stars BETWEEN 1 AND 5")
        .groupBy("vendor_id", "order_items")
        .agg(
            F.count("*").alias("reviews"),
            _share(F.col("stars") >= 3).alias("positive_neutral_percentage"),
            _share(F.col("stars") <= 2).alias("negative_percentage"),
        )
    )


def best_worst_item(ratios: DataFrame) -> DataFrame:
    """Item with the highest positive-or-neutral share and item with the highest negative share.

    Ties go to the item with more reviews, then by name.
    """
    def top(share: str) -> Column:
        key = F.struct((-F.col(share)).alias("s"), (-F.col("reviews")).alias("n"), "order_items")
        return F.min_by(F.struct("order_items", F.col(share).alias("share")), key)

    return (
        ratios.groupBy("vendor_id")
        .agg(top("positive_neutral_percentage").alias("best"), top("negative_percentage").alias("worst"))
        .select(
            "vendor_id",
            F.col("best.order_items").alias("best_item"),
            F.col("best.share").alias("best_positive_neutral_percentage"),
            F.col("worst.order_items").alias("worst_item"),
            F.col("worst.share").alias("worst_negative_percentage"),
        )
    )


def total_reviews(comments: DataFrame) -> DataFrame:
    return comments.groupBy("vendor_id").agg(F.count("*").alias("total_reviews"))


def item_rating(comments: DataFrame, item_totals: DataFrame) -> DataFrame:
    """Average stars per sold item with its orders and price; null without reviews."""
    rated = comments.groupBy("vendor_id", F.col("order_items").alias("menu_name")).agg(
        F.round(F.avg(stars().cast("double")), 4).alias("rating"), F.count("*").alias("reviews")
    )
    return (
        item_totals.select("vendor_id", "menu_name", "orders", "price")
        .join(rated, ["vendor_id", "menu_name"], "left")
        .na.fill(0, ["reviews"])
    )


def reviews_by_date(comments: DataFrame, part_size: int = 1000) -> DataFrame:
    """Reviews of each vendor and day as text lines, in parts of about ``part_size`` reviews.

    A busy day is spread over several parts, so no group holds an unbounded
    number of comments and none is dropped.
    """
    day = ["vendor_id", "comment_date"]
    parts = comments.groupBy(*day).agg(F.ceil(F.count("*") / part_size).alias("parts"))
    line = F.concat(
        F.lit("- Item: "), "order_items", F.lit(" - Rating (out of 5): "), "rating",
        F.when(F.col("user_comment") != "", F.concat(F.lit("- Comment: "), "user_comment")).otherwise(""),
    )
    return (
        comments.join(parts, day)
        .select(*day, spread(F.col("review_id"), F.col("parts")).alias("part"), "order_items", "review_id", line.alias("line"))
        .groupBy(*day, "part")
        .agg(
            F.count("*").alias("reviews"),
            F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY struct(order_items, review_id))").alias("review_text"),
        )
    )
