"""Menu-name expressions. All but the Unicode folding run inside the JVM.

Patterns use only the syntax Java, Python and RE2 agree on, so the same strings
serve the comparison SQL.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions import lexicons

# The normalisation patterns.
ADDON = r"\baddon\b"
MILLILITRES = r"\b\d+\s*ml\b"
NOT_ALPHANUMERIC = r"[^a-zA-Z0-9]"

ADD_ON = r"\badd\s*on\b"
# '50 rs', '50/-', '50 -/', 'rs 50', '30 /- rs'
PRICE_AFTER = r"\b(\d+)\s*(/-|-/)\s*(rs\b)?|\b(\d+)\s*(rs|inr)\b"
PRICE_BEFORE = r"\b(rs|inr)\.?\s*(\d+)\b"
UNIT = "(" + "|".join(lexicons.UNIT_WORDS) + ")"
QUANTITY = r"\b(\d+)\s*" + UNIT + r"\b"
# A quantity as one word, '50_ml', so that a number with a unit and a bare one can be told apart.
JOINED_QUANTITY = r"\b(\d+)_([a-z]+)\b"
# A quantity between two words starts a new component.
INNER_QUANTITY = r"([a-z])\s+(\d+(_[a-z]+)?)\s+([a-z])"
HARD_SEPARATOR = r"\s*(&|\+|,|\|)\s*|\s+with\s+"
PRICE_MARK = r"@(\d+)"
COMBO = r"\bcombo\b"
# 'egg-free', 'meat free'
WITHOUT = r"\b[a-z]+[- ]free\b"


def nfkc(name: Column) -> Column:
    """Unicode compatibility folding, for which Spark has no built-in."""

    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))

    return F.pandas_udf(fold, T.StringType())(name)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_name(name: Column, fold_unicode: bool = True) -> Column:
    """Lower case, folded, without 'addon' and millilitres, alphanumerics only.

    Folding runs after lower-casing, so it can bring capitals back. Callers whose
    names are plain ASCII can leave it out and stay inside the JVM.
    """
    text = F.lower(name)
    if fold_unicode:
        text = nfkc(text)
    text = F.regexp_replace(text, "(?U)" + ADDON, "")
    text = F.regexp_replace(text, "(?U)" + MILLILITRES, "")
    return squeeze(F.regexp_replace(text, NOT_ALPHANUMERIC, " "))


def spell_correct(text: Column, spellings: Mapping[str, str] = lexicons.SPELLINGS) -> Column:
    """Canonical spelling of every word of a lower-case, single-spaced text."""
    table = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])
    words = F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.array_join(words, " ")


def _any_word(words: Sequence[str]) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def mark_prices(text: Column) -> Column:
    """Prices of a lower-case text rewritten as '@<rupees>'."""
    text = F.regexp_replace(text, PRICE_BEFORE, " @$2 ")
    return F.regexp_replace(text, PRICE_AFTER, " @$1$4 ")


def strip_noise(name: Column, noise: Sequence[str] = lexicons.NOISE_WORDS) -> Column:
    """Name without size words, 'add on', price and quantity; veg markers and brands stay."""
    text = F.regexp_replace(mark_prices(F.lower(name)), PRICE_MARK, " ")
    for pattern in (QUANTITY, ADD_ON, _any_word(noise)):
        text = F.regexp_replace(text, pattern, " ")
    return squeeze(text)


def segments(name: Column) -> Column:
    """The raw pieces of a multi-item name, each with its own quantity and price mark."""
    text = F.regexp_replace(mark_prices(F.lower(name)), HARD_SEPARATOR, "|")
    text = F.regexp_replace(text, r"\s-\s", " ")
    text = F.regexp_replace(text, QUANTITY, "$1_$2")
    text = F.regexp_replace(text, INNER_QUANTITY, "$1|$2 $4")
    return F.split(text, r"\|")


def component_name(segment: Column, noise: Sequence[str], spellings: Mapping[str, str]) -> Column:
    """Name part of one segment: no quantity, price or noise, words spelled canonically."""
    text = F.regexp_replace(segment, PRICE_MARK, " ")
    for pattern in (JOINED_QUANTITY, r"\b\d+\b", ADD_ON, _any_word(noise), r"[^a-z0-9' ]", r"^\s*of\b"):
        text = F.regexp_replace(text, pattern, " ")
    return spell_correct(squeeze(text), spellings)


def canonical_name(
    name: Column, noise: Sequence[str] = lexicons.NOISE_WORDS, spellings: Mapping[str, str] = lexicons.SPELLINGS
) -> Column:
    """A whole name written as `component_name` writes one segment, so that the two can be compared."""
    return component_name(F.regexp_replace(mark_prices(F.lower(name)), QUANTITY, "$1_$2"), noise, spellings)


def _dishes(component: Column) -> Column:
    text = F.regexp_replace(component, COMBO, " ")
    text = F.regexp_replace(squeeze(text), r"\b(" + "|".join(lexicons.DISH_WORDS) + r")\b ", "$1|")
    return F.transform(F.split(text, r"\|"), squeeze)


def is_single_item(name: Column, single: Sequence[str] = lexicons.SINGLE_ITEMS) -> Column:
    return squeeze(F.lower(name)).isin(*single)


def split_components(
    name: Column,
    noise: Sequence[str] = lexicons.NOISE_WORDS,
    spellings: Mapping[str, str] = lexicons.SPELLINGS,
    single: Sequence[str] = lexicons.SINGLE_ITEMS,
) -> Column:
    """Component names of a menu name, in order, split on separators and inner quantities.

    The names of a combo are also split after each word that ends a dish.
    """
    parts = F.transform(segments(name), lambda s: component_name(s, noise, spellings))
    parts = F.when(F.lower(name).rlike(COMBO), F.flatten(F.transform(parts, _dishes))).otherwise(parts)
    return F.when(is_single_item(name, single), F.array(squeeze(F.lower(name)))).otherwise(
        F.filter(parts, lambda p: p != "")
    )


def title_case(text: Column) -> Column:
    return F.initcap(text)


def _short_unit(unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in lexicons.UNITS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, unit), unit)


def quantity_details(
    name: Column,
    noise: Sequence[str] = lexicons.NOISE_WORDS,
    spellings: Mapping[str, str] = lexicons.SPELLINGS,
) -> Column:
    """'Name (quantity) [price Rs]' per component, joined by ' | '."""

    def detail(segment: Column) -> Column:
        name_part = component_name(segment, noise, spellings)
        amount = F.regexp_extract(segment, JOINED_QUANTITY, 1)
        unit = _short_unit(F.regexp_extract(segment, JOINED_QUANTITY, 2))
        price = F.regexp_extract(segment, PRICE_MARK, 1)
        text = F.concat(
            title_case(name_part),
            F.when(amount != "", F.concat(F.lit(" ("), amount, F.lit(" "), unit, F.lit(")"))).otherwise(""),
            F.when(price != "", F.concat(F.lit(" ["), price, F.lit(" Rs]"))).otherwise(""),
        )
        return F.when(name_part != "", text)

    return F.array_join(F.transform(segments(name), detail), " | ")


def is_ambiguous(
    name: Column,
    vague: Sequence[str] = lexicons.AMBIGUOUS_NAMES,
    word: str = lexicons.AMBIGUOUS_WORD,
    specific: Sequence[str] = lexicons.SPECIFIC_NAMES,
    endings: Sequence[str] = lexicons.VAGUE_ENDINGS,
) -> Column:
    text = squeeze(F.lower(name))
    last = F.element_at(F.split(text, " "), -1)
    return (text.contains(word) | text.isin(*vague) | last.isin(*endings)) & ~text.isin(*specific)


def is_mrp(
    name: Column,
    brands: Sequence[str] = lexicons.BRANDS,
    exceptions: Sequence[str] = lexicons.NOT_PACKAGED,
) -> Column:
    """Packaged retail item: names a listed brand and is no exception."""
    text = squeeze(F.lower(name))
    return text.rlike(_any_word(brands)) & ~text.isin(*exceptions)


def non_veg_pattern(words: Sequence[str]) -> str:
    """A listed word, also in the plural."""
    return r"\b(" + "|".join(words) + r")(s|es)?\b"


def is_veg(name: Column, non_veg: Sequence[str] = lexicons.NON_VEG_WORDS) -> Column:
    """No listed word, where 'eggless' and '… free' do not count as one."""
    return ~F.regexp_replace(F.lower(name), WITHOUT, " ").rlike(non_veg_pattern(non_veg))


def relevance(query: Column, candidate: Column) -> Column:
    """Closeness of two single-spaced lower-case names.

    1 where equal, else shared over all words, with 0.1 more (at most 0.99)
    where the last words, the main components, agree.
    """
    q, c = F.split(query, " "), F.split(candidate, " ")
    overlap = F.size(F.array_intersect(q, c)) / F.size(F.array_union(q, c))
    boosted = F.when(
        F.element_at(q, -1) == F.element_at(c, -1), F.least(F.lit(0.99), overlap + 0.1)
    ).otherwise(overlap)
    return F.round(F.when(query == candidate, 1.0).otherwise(boosted), 6)
