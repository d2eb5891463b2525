import random

import pytest
from pyspark.sql import functions as F

from platewise.functions import text
from platewise.operators import menu, names


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "s string").select(build(F.col("s")).alias("r")).first()["r"]


# The examples of names that the rules are stated with.
@pytest.mark.parametrize(
    "name, expected",
    [
        ("AddOn Cola 500 ML (Chilled)", "cola chilled"),
        ("addons cola", "addons cola"),
        ("250ml coke zero", "coke zero"),
        ("20℃ milk", "20 C milk"),
        ("ﬁsh curry", "fish curry"),
        (None, None),
    ],
)
def test_normalize_name(spark, name, expected):
    assert one(spark, name, text.normalize_name) == expected


@pytest.mark.parametrize(
    "name, expected",
    [
        ("chapathi laccha", "chapati lachha"),
        ("egg rool", "egg roll"),
        ("kal dosa", "kal dosa"),
        ("malabar parotta", "malabar parotta"),
        ("aloo pattice poori subji", "aloo patties puri sabji"),
    ],
)
def test_spell_correct(spark, name, expected):
    assert one(spark, name, text.spell_correct) == expected


@pytest.mark.parametrize(
    "name, expected",
    [
        ("Medium Pizza Non veg", "pizza non veg"),
        ("Add on Special Raita", "raita"),
        ("Amul Lassi 200 ml Rs 30", "amul lassi"),
    ],
)
def test_strip_noise(spark, name, expected):
    assert one(spark, name, text.strip_noise) == expected


@pytest.mark.parametrize(
    "name, expected",
    [
        ("Chapati 3 Egg Curry", ["chapati", "egg curry"]),
        ("Aloo Paratha - 1 No With Channa Masala - 60 Grm Curd", ["aloo paratha", "channa masala", "curd"]),
        ("Bread Butter Jam", ["bread butter jam"]),
        ("2 piece dossa & idlly 50 milligram 30 /- Rs", ["dosa", "idli"]),
        ("1 litre of milk 50 -/", ["milk"]),
    ],
)
def test_split_components(spark, name, expected):
    assert one(spark, name, text.split_components) == expected


@pytest.mark.parametrize(
    "name, expected",
    [
        ("2 piece dossa & idlly 50 milligram 30 /- Rs", "Dosa (2 piece) | Idli (50 mg) [30 Rs]"),
        ("1 litre of milk 50 -/", "Milk (1 l) [50 Rs]"),
        ("samosa", "Samosa"),
    ],
)
def test_quantity_details(spark, name, expected):
    assert one(spark, name, text.quantity_details) == expected


@pytest.mark.parametrize(
    "name, expected",
    [("Deluxe Thali", True), ("Lunch", True), ("mango", True), ("Mango Masti", False), ("apple", False), ("Tea", False), ("Glazed Night Snack", True)],
)
def test_is_ambiguous(spark, name, expected):
    assert one(spark, name, text.is_ambiguous) is expected


@pytest.mark.parametrize("name, expected", [("Amul Butter", True), ("Boost", False), ("Veg Sandwich", False)])
def test_is_mrp(spark, name, expected):
    assert one(spark, name, text.is_mrp) is expected


@pytest.mark.parametrize(
    "name, expected", [("Chicken Momo", False), ("Pizza Non Veg", False), ("Veg Momo", True), ("Eggless Cake", True),
     ("Prawns Curry", False), ("Eggs Benedict", False), ("Fishes", False), ("Tuna Sandwich", False), ("Seekh Kebab", False), ("Veg Egg-free cake", True)]
)
def test_is_veg(spark, name, expected):
    assert one(spark, name, text.is_veg) is expected


@pytest.mark.parametrize(
    "query, item, expected",
    [
        ("veg momo", "veg momo", 1.0),
        ("veg momo", "chicken momo", round(1 / 3 + 0.1, 6)),
        ("aloo paratha", "paratha", 0.6),
        ("tea", "coffee", 0.0),
    ],
)
def test_relevance(spark, query, item, expected):
    found = spark.createDataFrame([(query, item)], "q string, c string").select(text.relevance(F.col("q"), F.col("c")))
    assert found.first()[0] == expected


def test_compounds_split_on_catalogue_names(spark, rows):
    names = spark.createDataFrame(
        [(1, "Sambar Idli"), (2, "Masala Dosa"), (3, "Sambar Vada Idli"), (4, "Idli & Sambar Idli")], "id bigint, name string"
    )
    catalogue = spark.createDataFrame([("sambar",), ("idli",), ("masala dosa",), ("sambar vada",)], "name string")
    found = menu.menu_components(names, catalogue)
    assert rows(found.select("id", "position", "component")) == [
        (1, 0, "sambar"), (1, 1, "idli"), (2, 0, "masala dosa"), (3, 0, "sambar vada"), (3, 1, "idli"),
        (4, 0, "idli"), (4, 1, "sambar"), (4, 2, "idli"),
    ]


def test_compounds_of_three_names(spark, rows):
    """No list of dish words is needed; the fewest names win, then the longer first name, and a gap keeps the name whole."""
    asked = spark.createDataFrame(
        [(1, "Lemon Rice Sambar Medu Vada"), (2, "Lemon Rice Unknown Vada"), (3, "Curd Rice Rice"), (4, "Vada Vada Vada")], "id bigint, name string"
    )
    catalogue = ["lemon rice", "rice", "lemon", "sambar", "medu vada", "vada", "curd", "curd rice", "rice rice"]
    found = menu.menu_components(asked, spark.createDataFrame([(c,) for c in catalogue], "name string"))
    assert rows(found.select("id", "position", "component")) == [
        (1, 0, "lemon rice"), (1, 1, "sambar"), (1, 2, "medu vada"), (2, 0, "lemon rice unknown vada"),
        (3, 0, "curd rice"), (3, 1, "rice"), (4, 0, "vada"), (4, 1, "vada"), (4, 2, "vada"),
    ]


def test_free_form_spelling(spark, rows):
    known = [("paneer masala",), ("paneer tikka",), ("paratha",), ("malabar parotta",), ("chicken manchurian",), ("dal",), ("tikki",)]
    vocabulary = names.vocabulary(spark.createDataFrame(known, "name string"), ("chocolate",))
    asked = {
        1: ("panner masalla", "paneer masala"),
        2: ("parotta", "parotta"),  # a known word, however near another one
        3: ("manchuriyan", "manchurian"),
        4: ("mnchuran", "manchurian"),  # two letters of a long word
        5: ("dl tikka", "dl tikka"),  # too short to tell
        6: ("tikkx", "tikka"),  # tikka is used as often as tikki: the first in order
        7: ("chocolat 500", "chocolate 500"),
        8: ("completely different", "completely different"),
        9: ("", ""),
        10: ("x" * 400, "x" * 400),
    }
    found = names.correct_names(spark.createDataFrame([(i, a) for i, (a, _) in asked.items()], "id bigint, name string"), vocabulary)
    assert {r["id"]: r["corrected"] for r in found.collect()} == {i: b for i, (_, b) in asked.items()}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_corrections_miss_nothing(spark):
    rng = random.Random(12)
    known = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 10))) for _ in range(120)})
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 11))) for _ in range(200)})
    vocabulary = spark.createDataFrame([(w, 1 + i % 3) for i, w in enumerate(known)], "known string, names bigint")
    found = {r["word"]: r["corrected"] for r in names.word_corrections(spark.createDataFrame([(w,) for w in words], "word string"), vocabulary).collect()}
    expected = {}
    for w in set(words) - set(known):
        near = [(edit_distance(w, k), -(1 + i % 3), k) for i, k in enumerate(known) if len(k) >= 4]
        near = [x for x in near if x[0] <= (2 if len(x[2]) >= 8 else 1)]
        if near:
            expected[w] = min(near)[2]
    assert found == expected and len(found) > 20


def test_name_candidates_miss_nothing(spark, rows):
    rng = random.Random(14)
    word = lambda: rng.choice("aa bb cc dd ee ff gg hh common common common common".split())
    some = lambda n: [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(n)]
    asked, roots = some(40), some(150)
    found = names.name_candidates(
        spark.createDataFrame([(a,) for a in asked + asked[:9]], "component string"),
        spark.createDataFrame(list(enumerate(roots)), "id bigint, root_name string"), 1000, 0.4,
    )
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    expected = sorted({(a, i) for a in asked for i, r in enumerate(roots) if share(a.split(), r.split()) >= 0.4})
    assert sorted(rows(found)) == expected
    few = names.name_candidates(
        spark.createDataFrame([("common aa",)], "component string"),
        spark.createDataFrame([(i, "common aa" if i % 2 else "aa") for i in range(40)], "id bigint, root_name string"), 5,
    )
    assert rows(few) == [("common aa", i) for i in (1, 3, 5, 7, 9)]


def test_items_without_a_vector_are_mapped_by_name(spark):
    items = spark.createDataFrame([(1, "Domino\'s Pizza 2 pcs", None), (2, "Lemon Rice Sambar", None), (3, "Mystery", [1.0, 0.0])], VECTORS)
    catalogue = spark.createDataFrame(
        [(10, "Domino\'s Pizza", None), (11, "Lemon Rice", None), (12, "Sambar", [1.0, 0.0]), (13, "ﬁsh", None)], VECTORS
    )
    found = {r["id"]: r["root_item_name"] for r in menu.map_to_root_items(items, catalogue).collect()}
    assert found == {1: "Domino\'s Pizza", 2: "Lemon Rice | Sambar", 3: ""}


def test_both_sides_are_written_alike(spark):
    assert one(spark, "Domino\'s Pizza", lambda c: text.canonical_name(c)) == "domino\'s pizza"
    assert one(spark, "Domino\'s Pizza", text.split_components) == ["domino\'s pizza"]
    assert one(spark, "Special Chappathi 2 pcs Rs 30", lambda c: text.canonical_name(c)) == "chapati"


def test_sentence_windows(spark, rows):
    docs = spark.createDataFrame([(1, "A. B! C? D\nE."), (2, " ... "), (3, "Z")], "doc_id bigint, text string")
    assert rows(menu.sentence_windows(docs, 1)) == [
        (1, 0, "A", "A B"), (1, 1, "B", "A B C"), (1, 2, "C", "B C D"), (1, 3, "D", "C D E"), (1, 4, "E", "D E"), (3, 0, "Z", "Z"),
    ]


VECTORS = "id bigint, name string, embedding array<float>"


def test_map_to_root_items(spark):
    items = spark.createDataFrame(
        [
            (1, "Veg Momo", [1.0, 0.0]),
            (2, "Special Thali", [1.0, 0.0]),
            (3, "Aloo Paratha with Curd", [0.0, 1.0]),
            (4, "Chicken Momo 2 pcs", [1.0, 0.1]),
            (5, "Amul Kool", [1.0, 0.1]),
        ],
        VECTORS,
    )
    catalogue = spark.createDataFrame(
        [(10, "Chicken Momo", [1.0, 0.0]), (11, "Paratha", [0.0, 1.0]), (12, "Curd", [0.1, 1.0])], VECTORS
    )
    found = {r["id"]: r for r in menu.map_to_root_items(items, catalogue).collect()}
    assert found[1]["root_item_name"] == ""  # a vegetarian name takes no meat
    assert found[2]["is_ambiguous"] and found[2]["root_item_name"] == ""
    assert sorted(found[3]["root_item_name"].split(" | ")) == ["Curd", "Paratha"]
    assert found[4]["root_item_name"] == "Chicken Momo"
    assert found[4]["quantity_details"] == "Chicken Momo (2 pc)"
    assert found[5]["is_mrp"] and found[5]["root_item_ids"] == ""


def test_attach_nutrition_ends_with_the_shorter_list(spark, rows):
    mapped = spark.createDataFrame(
        [(1, "Dosa | Idli | Vada", "Dosa | Idli"), (2, "Tea", ""), (3, "Tea", "Tea | Milk")],
        "id bigint, quantity_details string, root_item_name string",
    )
    nutrition = spark.createDataFrame([("Dosa", 168), ("Tea", 30)], "quantity_component string, energy int")
    found = menu.attach_nutrition(mapped, nutrition).select("id", "position", "quantity_component", "root_item", "energy")
    assert rows(found) == [(1, 0, "Dosa", "Dosa", 168), (1, 1, "Idli", "Idli", None), (3, 0, "Tea", "Tea", 30)]


def test_evaluate_mapping(spark):
    predictions = spark.createDataFrame(
        [("Dosa (500 ml)", "dosa"), ("Idli", "vada"), (None, "tea")], "predicted_menu_name string, master_menu_name string"
    )
    judged = menu.evaluate_mapping(predictions)
    assert [r["eval_prediction"] for r in judged.collect()] == [True, False, None]
    assert menu.match_rate(judged).first()["match_rate"] == 0.5


def test_component_limit(spark):
    components = spark.createDataFrame([(1, 0, "a")], "id bigint, position int, component string")
    ranked = spark.createDataFrame(
        [(1, 0, 7, "x", 0.5), (1, 0, 8, "y", 0.9)], "item_id bigint, position int, root_id bigint, name string, relevance double"
    )
    assert [r["name"] for r in menu.component_limit(ranked, components).collect()] == ["y"]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("Veg Manchurian Noodle Combo", ["veg manchurian", "noodle"]),
        ("Combo Chicken Curry Rice", ["chicken curry", "rice"]),
        ("Fried Rice Combo", ["fried rice"]),
    ],
)
def test_combos_are_split_after_each_dish(spark, name, expected):
    assert one(spark, name, text.split_components) == expected


def test_candidates_of_a_name_that_many_items_carry_are_not_expanded_before_they_are_merged(spark, rows):
    components = spark.createDataFrame([(i, 0, "dal") for i in range(400)] + [(7, 0, "dal"), (7, 1, None)], "id long, position int, component string")
    near = spark.createDataFrame([(3, 1, 0.5), (3, 1, 0.75), (3, 90, 0.25), (7, 5, 1.0)], "query_id long, id long, similarity double")
    by_name = spark.createDataFrame([("dal", i) for i in [None, *range(50)]], "component string, root_id long")
    found = menu.component_candidates(components, near, by_name)
    got = rows(found)
    assert len(got) == len(set(got)) == 400 * 51 + 1 + 1  # one candidate of item 3 that no name has, one of the null component
    assert {r[4] for r in got if r[0] == 3 and r[3] == 1} == {0.75} and (3, 0, "dal", 90, 0.25) in got
    assert (0, 0, "dal", None, 0.0) in got and (7, 0, "dal", 5, 1.0) in got and (7, 1, None, 5, 1.0) in got
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("inline(") < min(plan.index(a) for a in ("Aggregate", "Join"))  # expanded last
