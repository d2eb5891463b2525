import datetime as dt
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from platewise import schemas
from platewise.operators import answers, inference, menu, sessions

# The models below travel with the jobs, like a user's script would.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
NOW = dt.datetime(2025, 1, 1, 12)


def upper():
    return lambda prompts: [p.upper() for p in prompts]


def picky():
    def answer(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("refused")
        return [p.upper() for p in prompts]

    return answer


MODELS = {"upper": upper, "picky": picky}


def prompts(spark, *texts):
    return spark.createDataFrame([(i, p) for i, p in enumerate(texts)], "id bigint, prompt string")


def test_a_failing_prompt_fails_alone(spark):
    found = {r["prompt"]: r for r in inference.llm_batch(prompts(spark, "a", "bad", "c"), MODELS, "picky").collect()}
    assert found["a"]["completion"] == "A" and found["c"]["completion"] == "C"
    assert found["bad"]["completion"] is None and found["bad"]["error"] == "ValueError: refused"


def test_attempts(spark):
    calls = []

    def unsteady(texts):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return texts

    assert inference._attempt(unsteady, ["x"], 3) == (["x"], None)
    assert inference._attempt(lambda t: [], ["x"], 2)[1] == "answer count differs from prompt count"


def test_unknown_model(spark):
    with pytest.raises(KeyError):
        inference.llm_batch(prompts(spark, "a"), MODELS, "other")


def test_cache(spark):
    md5 = lambda s: spark.range(1).select(F.md5(F.lit(s))).first()[0]
    cache = spark.createDataFrame(
        [(md5("a"), "old", NOW - dt.timedelta(seconds=7200)), (md5("b"), "first", NOW - dt.timedelta(seconds=90)), (md5("b"), "last", NOW - dt.timedelta(seconds=9))],
        schemas.PROMPT_CACHE,
    )
    answered = inference.prompt_cache(prompts(spark, "a", "b", "a"), cache, NOW, MODELS, "upper")
    assert sorted((r["prompt"], r["response"], r["cache_hit"]) for r in answered.collect()) == [("a", "A", False), ("a", "A", False), ("b", "last", True)]
    assert answered.filter("error IS NOT NULL").count() == 0


def test_failed_prompts_keep_their_error(spark, tmp_path):
    path = str(tmp_path / "cache")
    for _ in range(2):
        found = inference.answer_with_cache(prompts(spark, "a", "bad"), path, NOW, MODELS, "picky")
        assert sorted((r["prompt"], r["response"], r["error"]) for r in found.collect()) == [("a", "A", None), ("bad", None, "ValueError: refused")]
    assert spark.read.parquet(path).count() == 1


def test_large_ids_beside_nulls_pass_through(spark):
    rows = [(9007199254740993, "a"), (None, "b"), (-9223372036854775808, "c")]
    found = inference.llm_batch(spark.createDataFrame(rows, "id bigint, prompt string"), MODELS, "upper", batch_size=2)
    assert sorted(((r["id"], r["prompt"]) for r in found.collect()), key=str) == sorted(rows, key=str)


def test_cache_table_is_extended(spark, tmp_path):
    path = str(tmp_path / "cache")
    for later in range(2):
        now = NOW + dt.timedelta(seconds=later)
        found = inference.answer_with_cache(prompts(spark, "a", "b", "a"), path, now, MODELS, "upper")
        assert sorted(r["response"] for r in found.collect()) == ["A", "A", "B"]
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize("answer, expected", [("7", 7), (" 10 ", 10), ("11", None), ("0", None), ("Rating: 7", None), (None, None)])
def test_parse_rating(spark, answer, expected):
    df = spark.createDataFrame([(answer,)], "a string")
    assert df.select(inference.parse_rating(F.col("a")).alias("r")).first()["r"] == expected


def test_parse_fenced_json(spark):
    texts = ["```json[{'id': 1, 'name': 'Dosa'}, {'id': 99, 'name': 'Unknown'}]```", '```json[{"id": 2, "name": "Domino\'s"}]```', "not json", "[]"]
    answers = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row bigint, response string")
    parsed = inference.parse_fenced_json(answers, schemas.RANKED_ITEMS)
    found = sorted((r["row"], r["item_id"], r["item_name"]) for r in parsed.collect())
    assert found == [(0, "1", "Dosa"), (0, "99", "Unknown"), (1, "2", "Domino's"), (2, "-1", inference.PARSE_FAILURE)]
    catalogue = spark.createDataFrame([(1, "Dosa Plain"), (2, "Pizza")], "id bigint, name string")
    known = menu.known_items_only(parsed.withColumnRenamed("item_id", "id"), catalogue)
    assert sorted((r["row"], r["root_name"]) for r in known.collect()) == [(0, "Dosa Plain"), (1, "Pizza")]


def test_parse_structured(spark):
    answers = spark.createDataFrame([('{"order_data":[],"reasoning":"x"}',), ('{"order_data":[]}',), ("oops",)], "response string")
    found = inference.parse_structured(answers, schemas.ORDER_FORECAST, ["order_data", "reasoning"])
    assert [r["valid"] for r in found.collect()] == [True, False, False]


def test_long_sessions_are_marked_and_keep_their_history(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}.{t}") for c, n in ((1, 14), (2, 4), (3, 1)) for t in range(n)]
    pairs = sessions.session_turns(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    assert {(r["conv_id"], r["pairs"], r["history_used"]) for r in pairs.collect()} == {(1, 7, False), (2, 2, True)}
    history = {(r["conv_id"], r["part"], r["history_used"]): r["history"] for r in sessions.session_history(pairs, 10).collect()}
    assert set(history) == {(1, 0, False), (1, 1, False), (2, 0, True)}
    assert history[2, 0, True] == "Vendor_Question: 2.0\nSystem_Answer: 2.1\nVendor_Question: 2.2\nSystem_Answer: 2.3"
    assert sum(h.count("Vendor_Question") for h in history.values()) == 9
    asked = sessions.unanswered_turns(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    assert [tuple(r) for r in asked.collect()] == [(3, 0, "3.0")]


def test_schedule_questions(spark):
    asked = spark.createDataFrame([("What is my SCHEDULE?",), ("Sales?",)], "text string")
    assert [r["needs_schedule"] for r in sessions.question_routing(asked).collect()] == [True, False]


def test_feedback_prompts_are_split_and_whole(spark):
    rated = [(i, 1, "Dosa", "4/5", f"c{i}", dt.date(2025, 1, 1)) for i in range(25)]
    comments = spark.createDataFrame(
        rated, "review_id bigint, vendor_id bigint, order_items string, rating string, user_comment string, comment_date date"
    )
    found = inference.render_feedback("Reviews:\n{reviews}\nEnd", comments, part_size=10).collect()
    lines = [line for r in found for line in r["prompt"].split("\n")[1:-1]]
    assert len(found) == 3 and sorted(lines) == sorted(f"4/5, c{i}" for i in range(25))


def wrong(spark, schema, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id bigint, response string")
    checked = answers.checked_answers(frame, schema)
    found = {i: [] for i in range(len(texts))}
    for r in answers.violations(checked, "id").collect():
        found[r["id"]].append((r["path"], r["problem"]))
    return [sorted(found[i]) for i in range(len(texts))]


def test_sentiment_answers_are_checked_with_paths(spark):
    right = {
        "sentiment_breakdown": {
            "general_sentiment": "good", "positive_review_percentage": 60, "neutral_review_percentage": 20.5,
            "negative_review_percentage": 1e1, "high_price_complain_reviews": 0, "sentiment_score": 71,
        },
        "best_item": {"name": "Upma", "postive_neutral_review_percentage": 90, "reasoning": "fresh"},
        "worst_item": {
            "name": "Kheer", "negative_review_percentage": 30, "reasoning": "late", "pricing_optimization": {},
            "marketing_suggestions": {"improvement_suggestions": ["a", "b"], "alternative_items": None},
        },
        "not named by the schema": [1],
    }
    lost = json.loads(json.dumps(right))
    del lost["best_item"]["name"], lost["worst_item"]["pricing_optimization"]
    lost["sentiment_breakdown"]["sentiment_score"] = None
    odd = json.loads(json.dumps(right))
    odd["worst_item"]["marketing_suggestions"]["improvement_suggestions"] = ["a", 5, None]
    odd["best_item"], odd["marketing_suggestions"] = [], {"bundle_items": "one"}
    found = wrong(spark, schemas.SENTIMENT_ANSWER, json.dumps(right), json.dumps(lost), json.dumps(odd))
    assert found == [
        [],
        [("$.best_item.name", "missing"), ("$.sentiment_breakdown.sentiment_score", "missing"), ("$.worst_item.pricing_optimization", "missing")],
        [
            ("$.best_item", "not an object"), ("$.marketing_suggestions.bundle_items", "not an array"),
            ("$.worst_item.marketing_suggestions.improvement_suggestions[1]", "not a string"),
            ("$.worst_item.marketing_suggestions.improvement_suggestions[2]", "missing"),
        ],
    ]


def test_product_and_nutrition_answers_are_checked(spark):
    points = lambda *p: [{"points": x} for x in p]
    right = json.dumps({"feedback_summary": points("a", "b"), "suggestions": [], "rating_score": 7})
    odd = json.dumps({"feedback_summary": [*points("a", 3), {}], "suggestions": 1, "rating_score": "7"})
    assert wrong(spark, schemas.PRODUCT_FEEDBACK, right, odd) == [
        [],
        [("$.feedback_summary[1].points", "not a string"), ("$.feedback_summary[2].points", "missing"),
         ("$.rating_score", "not a number"), ("$.suggestions", "not an array")],
    ]
    food = {"quantity": "70 g", "energy": "320 kcal", "carbohydrates": "41 g", "fiber": "1 g", "protein": "6 g", "fat": "14 g"}
    fenced = "```json" + json.dumps(food) + "```"
    assert wrong(spark, schemas.NUTRITION_ANSWER, fenced, json.dumps(food | {"fat": 14}), "", "[1]", None, "no food") == [
        [], [("$.fat", "not a string")], [("$", "not json")], [("$", "not an object")], [("$", "not json")], [("$", "not json")],
    ]


def test_right_answers_are_parsed(spark):
    text = '```json\n{"order_data": [{"date": "2025-02-01", "order_count": 3}], "reasoning": "x"}\n```'
    row = answers.checked_answers(spark.createDataFrame([(text,)], "response string"), schemas.DAY_FORECAST).first()
    assert row["problems"] == [] and row["parsed"]["order_data"][0]["order_count"] == 3
