"""Names found by their words: spelling, compounds, and candidates from an inverted index.

Every step works on distinct names or words and joins the result back, so a name that a
third of all rows carry is looked up once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions import text

# Names that share less of their words than this are no candidates.
MIN_SHARE = 0.5
# More names than any text has words.
NO_PATH = 1 << 30
# Word lengths from which one and two wrong letters are corrected; longer words than the last are left alone.
ONE_ERROR, TWO_ERRORS, LONGEST = 4, 8, 30


def _words(name: str) -> Column:
    return F.array_distinct(F.split(F.col(name), " "))


def share_of_words(a: Column, b: Column) -> Column:
    """Words in both of two single-spaced names as a share of the words in either."""
    a, b = F.split(a, " "), F.split(b, " ")
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _prefixes(names: DataFrame, name: str, frequency: DataFrame, least: float) -> DataFrame:
    """The rarest words of every name: two names that share enough have one of these in common."""
    words = names.select(name, F.size(_words(name)).alias("n"), F.explode(_words(name)).alias("word"))
    rarity = F.struct(F.coalesce("names", F.lit(0)).alias("names"), "word")
    ordered = words.join(frequency, "word", "left").groupBy(name, "n").agg(F.sort_array(F.collect_list(rarity)).alias("ordered"))
    # Of n words at least ceil(least * n) are shared, so not all shared ones can come after these.
    length = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1
    return ordered.select(name, "n", F.explode(F.slice("ordered", F.lit(1), length)).alias("w")).select(name, "n", "w.word")


def name_candidates(components: DataFrame, catalogue: DataFrame, k: int, least: float = MIN_SHARE) -> DataFrame:
    """The k closest catalogue rows of every component by name, among those that share at least `least` of all words.

    ``components`` has ``component``, ``catalogue`` has ``id`` and ``root_name``; the result
    has ``component`` and ``root_id``. Closeness is that of `text.relevance`, ties by id. The
    index holds only each name's rarest words, which is enough to miss nothing.
    """
    asked = components.filter("component <> ''").select("component").distinct()
    named = catalogue.filter("root_name <> ''").select("id", "root_name")
    names = named.select("root_name").distinct()
    frequency = names.select(F.explode(_words("root_name")).alias("word")).groupBy("word").agg(F.count("*").alias("names"))
    met = (
        _prefixes(asked, "component", frequency, least)
        .join(_prefixes(names, "root_name", frequency, least).withColumnRenamed("n", "m"), "word")
        .filter((F.col("m") >= F.col("n") * least) & (F.col("n") >= F.col("m") * least))
        .select("component", "root_name")
        .distinct()
        .filter(share_of_words(F.col("component"), F.col("root_name")) >= least)
        .withColumn("relevance", text.relevance(F.col("component"), F.col("root_name")))
    )
    # No component takes more than k rows of one name.
    of_name = Window.partitionBy("root_name").orderBy("id")
    first = named.withColumn("nth", F.row_number().over(of_name)).filter(F.col("nth") <= k)
    order = Window.partitionBy("component").orderBy(F.col("relevance").desc(), "id")
    found = met.join(first, "root_name").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return found.select("component", F.col("id").alias("root_id"))


def split_compounds(components: DataFrame, catalogue_names: DataFrame) -> DataFrame:
    """Splits components that consist of several catalogue names with no separator between them.

    Input rows (id, position, component). The words of a distinct component are the nodes
    of a lattice and the catalogue names among its runs of words the edges, found by an
    equi-join; the path of the fewest names through all its words is taken, of several the
    one whose first names are longer. A component without such a path stays whole, and so
    does one that is a catalogue name itself.
    """
    known = catalogue_names.select(F.col("name").alias("span")).distinct()
    words = F.split("component", " ")
    size = F.size(words)
    lone = components.select("component").distinct().join(known, F.col("component") == F.col("span"), "left_anti").filter(size >= 2)
    starts = lone.select("component", size.alias("n"), words.alias("words"), F.explode(F.sequence(F.lit(0), size - 1)).alias("first"))
    runs = starts.select("component", "n", "words", "first", F.explode(F.sequence(F.col("first") + 1, F.col("n"))).alias("last"))
    length = F.col("last") - F.col("first")
    runs = runs.withColumn("span", F.array_join(F.slice("words", F.col("first") + 1, length), " "))
    edges = runs.join(known, "span", "left_semi").groupBy("component", "n").agg(F.collect_list(F.struct("first", "last", "span")).alias("edges"))

    def path(names: Column, lengths: Column, parts: Column) -> Column:
        return F.struct(names.alias("names"), lengths.alias("lengths"), parts.alias("parts"))

    def reach(paths: Column, node: Column) -> Column:
        """The best path to a node, from the best ones to the nodes before it."""

        def extended(edge: Column) -> Column:
            before = F.get(paths, edge["first"])
            longer = F.concat(before["lengths"], F.array(edge["first"] - edge["last"]))
            return path(before["names"] + 1, longer, F.concat(before["parts"], F.array(edge["span"])))

        into = F.filter("edges", lambda e: (e["last"] == node) & (F.get(paths, e["first"])["names"] < NO_PATH))
        return F.concat(paths, F.array(F.coalesce(F.array_min(F.transform(into, extended)), nothing(NO_PATH))))

    def nothing(names: int) -> Column:
        return path(F.lit(names), F.array().cast("array<int>"), F.array().cast("array<string>"))

    best = F.element_at(F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array(nothing(0)), reach), -1)
    chosen = edges.select("component", best.alias("best")).filter(F.col("best.names") < NO_PATH).select("component", "best.parts")
    return (
        components.join(chosen, "component", "left")
        .select("id", "position", F.posexplode(F.coalesce("parts", F.array("component"))).alias("part", "component"))
        .select("id", "position", "part", "component")
    )


def _without_one(words: Column) -> Column:
    """Every word of a list with one letter left out."""

    def shortened(word: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))

    return F.flatten(F.transform(words, shortened))


def _shortened(words: DataFrame, word: str, two: Column) -> DataFrame:
    """A word with up to two letters left out, one row each; two only where `two`."""
    once = _without_one(F.array(word))
    forms = F.concat(F.array(word), once, F.when(two, _without_one(once)).otherwise(F.array().cast("array<string>")))
    return words.select("*", F.explode(F.array_distinct(forms)).alias("form"))


def word_corrections(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The vocabulary's word for every word that is none, but differs from one by a letter or two.

    ``words`` has ``word``; ``vocabulary`` has ``known`` and ``names``, how many names use
    it. Words are joined on what is left of them without some letters, and checked by edit
    distance: 1 for known words of 4 to 7 letters, 2 from 8 on. The nearest known word wins,
    of several the more frequent one, then the first in order. Words with digits, and
    those above 30 letters, are left alone.
    """
    known = vocabulary.filter((F.length("known") >= ONE_ERROR) & (F.length("known") <= LONGEST))
    two = F.length("known") >= TWO_ERRORS
    known = _shortened(known.withColumn("errors", F.when(two, 2).otherwise(1)), "known", two)
    plain = words.select("word").distinct().filter((F.length("word") <= LONGEST) & F.col("word").rlike("^[a-z']{2,}$"))
    asked = plain.join(vocabulary.select(F.col("known").alias("word")), "word", "left_anti")
    asked = _shortened(asked, "word", F.length("word") >= TWO_ERRORS - 2)
    distance = F.levenshtein("word", "known")
    met = asked.join(known, "form").select("word", "known", "names", "errors").distinct().withColumn("distance", distance)
    order = F.struct("distance", (-F.col("names")).alias("a"), "known")
    return met.filter("distance <= errors").groupBy("word").agg(F.min_by("known", order).alias("corrected"))


def vocabulary(names: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The words of a catalogue's names and how many names use each; `keep` are spellings that stand as they are."""
    words = names.select(F.explode(_words("name")).alias("known")).filter("known <> ''").groupBy("known").agg(F.count("*").alias("names"))
    if not keep:
        return words
    more = names.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, keep))).alias("known"), F.lit(0).cast("long").alias("names"))
    return words.unionByName(more).groupBy("known").agg(F.max("names").alias("names"))


def correct_names(names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Names (id, name; lower case, single-spaced) with every word corrected by :func:`word_corrections`."""
    each = names.select("id", F.posexplode(F.split("name", " ")).alias("place", "word"))
    found = word_corrections(each, vocabulary)
    word = F.struct("place", F.coalesce("corrected", "word").alias("word"))
    whole = each.join(found, "word", "left").groupBy("id").agg(F.sort_array(F.collect_list(word)).alias("words"))
    return whole.select("id", F.array_join("words.word", " ").alias("corrected"))
