"""Menu resolution: free-form names to items of a master catalogue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions import lexicons, text
from platewise.operators.names import MIN_SHARE, name_candidates, split_compounds
from platewise.operators.vectors import cosine_topk
from platewise.session import materialized

SEPARATOR = " | "
CANDIDATES = 50
PLAIN_CANDIDATES = 10
WATERMARK = 720465  # fixed value: ids up to here are already mapped


def id_watermark(items: DataFrame, low: int = WATERMARK, fold_unicode: bool = True) -> DataFrame:
    """Items above an id, with normalised names, in id order."""
    return (
        items.filter(F.col("id") > low)
        .withColumn("name", text.normalize_name(F.col("name"), fold_unicode))
        .orderBy("id")
    )


def menu_components(
    names: DataFrame,
    catalogue_names: DataFrame | None = None,
    noise: Sequence[str] = lexicons.NOISE_WORDS,
    spellings: Mapping[str, str] = lexicons.SPELLINGS,
    single: Sequence[str] = lexicons.SINGLE_ITEMS,
) -> DataFrame:
    """Rows (id, position, component) of menu names (id, name), position from 0."""
    parts = names.select(
        "id", F.posexplode(text.split_components(F.col("name"), noise, spellings, single)).alias("position", "component")
    )
    if catalogue_names is None:
        return parts
    split = split_compounds(parts, catalogue_names)
    order = Window.partitionBy("id").orderBy("position", "part")
    return split.select("id", (F.row_number().over(order) - 1).alias("position"), "component")


def menu_flags(
    names: DataFrame,
    brands: Sequence[str] = lexicons.BRANDS,
    non_veg: Sequence[str] = lexicons.NON_VEG_WORDS,
    vague: Sequence[str] = lexicons.AMBIGUOUS_NAMES,
    ambiguous_word: str = lexicons.AMBIGUOUS_WORD,
) -> DataFrame:
    name = F.col("name")
    return names.withColumns(
        {
            "is_ambiguous": text.is_ambiguous(name, vague, ambiguous_word),
            "is_mrp": text.is_mrp(name, brands),
            "is_veg": text.is_veg(name, non_veg),
        }
    )


def component_candidates(components: DataFrame, candidates: DataFrame, by_name: DataFrame | None = None) -> DataFrame:
    """Candidate list of every component, duplicates between components kept.

    ``candidates`` holds the ranked neighbours of each item (query_id, id, similarity),
    ``by_name`` those of each component's words (component, root_id), at most k either
    way, so an item yields components × 2 k rows. A candidate that the vectors did not
    give has similarity 0.
    """
    asked = components.withColumnRenamed("id", "item_id")
    found = candidates.select(F.col("query_id").alias("item_id"), F.col("id").alias("root_id"), "similarity")
    if by_name is None:
        return asked.join(found, "item_id")
    # Either side comes to a component as one list, so a name that many items carry is not expanded before it is merged.
    near = found.groupBy("item_id", "root_id").agg(F.coalesce(F.max("similarity"), F.lit(0.0)).alias("similarity"))
    near = near.groupBy("item_id").agg(F.collect_list(F.struct("root_id", "similarity")).alias("near"))
    named = by_name.groupBy("component").agg(F.collect_set(F.struct("root_id")).alias("named"))  # sets leave out nulls, but not structs of them
    named = named.withColumn("named", F.col("named.root_id"))
    both = asked.select("item_id", "position", "component").distinct().join(near, "item_id", "left").join(named, "component", "left")
    near = F.coalesce("near", F.array().cast(near.schema["near"].dataType))
    named = F.coalesce("named", F.array().cast(named.schema["named"].dataType))
    more = F.transform(F.array_except(named, near["root_id"]), lambda r: F.struct(r.alias("root_id"), F.lit(0.0).alias("similarity")))
    return both.select("item_id", "position", "component", F.inline(F.concat(near, more)))


def rerank(candidates: DataFrame, catalogue: DataFrame, top_n: int = CANDIDATES) -> DataFrame:
    """Candidates per component by closeness of name, then similarity, then id.

    ``catalogue`` has id, name and its normalised spelling ``root_name``.
    """
    named = catalogue.select(F.col("id").alias("root_id"), "name", "root_name")
    scored = candidates.join(named, "root_id").withColumn(
        "relevance", text.relevance(F.col("component"), F.col("root_name"))
    )
    order = Window.partitionBy("item_id", "position").orderBy(
        F.col("relevance").desc(), F.col("similarity").desc(), "root_id"
    )
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def component_limit(ranked: DataFrame, components: DataFrame) -> DataFrame:
    """At most as many mapped items per name as it has components, in order of relevance."""
    sizes = components.groupBy(F.col("id").alias("item_id")).agg(F.count("*").alias("components"))
    order = Window.partitionBy("item_id").orderBy(F.col("relevance").desc(), "position", "root_id")
    return (
        ranked.join(sizes, "item_id")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= F.col("components"))
        .drop("components")
    )


def best_root_items(
    reranked: DataFrame, flags: DataFrame, non_veg: Sequence[str] = lexicons.NON_VEG_WORDS
) -> DataFrame:
    """The closest root item of each component.

    A vegetarian name never takes a non-vegetarian item, and a name that shares
    no word takes none. One aggregation, no sort.
    """
    veg = flags.select(F.col("id").alias("item_id"), "is_veg")
    allowed = (
        reranked.filter("relevance > 0")
        .join(veg, "item_id")
        .filter(~F.col("is_veg") | text.is_veg(F.col("name"), non_veg))
    )
    order = F.struct((-F.col("relevance")).alias("a"), (-F.col("similarity")).alias("b"), "root_id")
    return (
        allowed.groupBy("item_id", "position")
        .agg(F.min_by(F.struct("root_id", "name", "relevance"), order).alias("best"))
        .select("item_id", "position", "best.root_id", "best.name", "best.relevance")
    )


def folded_names(df: DataFrame, fold_unicode: bool = True) -> DataFrame:
    """Names in lower case, with compatibility characters folded."""
    name = F.lower("name")
    return df.withColumn("name", text.nfkc(name) if fold_unicode else name)


def normalized_catalogue(
    catalogue: DataFrame, fold_unicode: bool = True, spellings: Mapping[str, str] = lexicons.SPELLINGS
) -> DataFrame:
    """The catalogue with ``root_name``, its name written as components of menu names are."""
    folded = text.nfkc(F.lower("name")) if fold_unicode else F.lower("name")
    return catalogue.withColumn("root_name", text.canonical_name(folded, spellings=spellings))


# Names that are looked for in the catalogue.
SEARCHED = "NOT is_ambiguous AND NOT is_mrp"


def read_names(
    items: DataFrame,
    catalogue: DataFrame,
    brands: Sequence[str] = lexicons.BRANDS,
    non_veg: Sequence[str] = lexicons.NON_VEG_WORDS,
    vague: Sequence[str] = lexicons.AMBIGUOUS_NAMES,
    ambiguous_word: str = lexicons.AMBIGUOUS_WORD,
    fold_unicode: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the names say, read once and written: flags and quantities of items, root names, and components of the searched."""
    flags = menu_flags(items.select("id", "name"), brands, non_veg, vague, ambiguous_word)
    read = materialized(flags.withColumn("quantity_details", text.quantity_details(F.col("name"))), "names")
    roots = materialized(normalized_catalogue(catalogue.select("id", "name"), fold_unicode), "roots")
    names = folded_names(read.filter(SEARCHED).select("id", "name"), fold_unicode)
    components = menu_components(names, roots.select(F.col("root_name").alias("name")))
    return read, roots, materialized(components, "components")


def map_to_root_items(
    items: DataFrame,
    catalogue: DataFrame,
    k: int = CANDIDATES,
    brands: Sequence[str] = lexicons.BRANDS,
    non_veg: Sequence[str] = lexicons.NON_VEG_WORDS,
    vague: Sequence[str] = lexicons.AMBIGUOUS_NAMES,
    ambiguous_word: str = lexicons.AMBIGUOUS_WORD,
    fold_unicode: bool = True,
    least: float = MIN_SHARE,
) -> DataFrame:
    """Root items of every menu name.

    ``items`` and ``catalogue`` have id, name and embedding. Candidates of a component are
    the item's nearest vectors and the catalogue names that share at least ``least`` of
    its words, so items and catalogue rows without a vector are found by name. Ambiguous
    and packaged names are set aside before the search and come back with an empty list.
    """
    read, roots, components = read_names(items, catalogue, brands, non_veg, vague, ambiguous_word, fold_unicode)
    flags = read.select("id", "is_veg")
    wanted = items.join(read.filter(SEARCHED).select("id"), "id", "left_semi")
    near = cosine_topk(*(side.filter("embedding IS NOT NULL") for side in (wanted, catalogue)), k)
    # Components of items without a vector are looked up once for all items that are alike.
    own = F.when(F.col("near_id").isNotNull(), F.col("id").cast("string"))
    each = components.join(flags, "id").join(wanted.filter("embedding IS NOT NULL").select("id", F.col("id").alias("near_id")), "id", "left")
    each = each.withColumn("lookup", F.concat_ws("|", own, F.col("is_veg").cast("string"), F.col("component")))
    lookups = each.select(F.col("lookup").alias("id"), F.lit(0).alias("position"), "component", "is_veg", "near_id").distinct()
    near = near.withColumnRenamed("query_id", "near_id").join(lookups.select("near_id", F.col("id").alias("query_id")).distinct(), "near_id")
    candidates = component_candidates(lookups.select("id", "position", "component"), near, name_candidates(components, roots, k, least))
    best = best_root_items(rerank(candidates, roots, k), lookups.select("id", "is_veg"), non_veg)
    best = best.select(F.col("item_id").alias("lookup"), "root_id", "name", "relevance")
    found = each.select(F.col("id").alias("item_id"), "position", "lookup").join(best, "lookup")
    kept = component_limit(found, components)
    listed = kept.groupBy("item_id").agg(
        F.expr(f"listagg(name, '{SEPARATOR}') WITHIN GROUP (ORDER BY place)").alias("root_item_name"),
        F.expr("listagg(cast(root_id AS string), ',') WITHIN GROUP (ORDER BY place)").alias("root_item_ids"),
    )
    return read.join(listed.withColumnRenamed("item_id", "id"), "id", "left").select(
        "id", "name", "quantity_details", "is_ambiguous", "is_mrp", "is_veg",
        F.coalesce("root_item_name", F.lit("")).alias("root_item_name"),
        F.coalesce("root_item_ids", F.lit("")).alias("root_item_ids"),
    )


def known_items_only(predicted: DataFrame, catalogue: DataFrame, key: str = "id") -> DataFrame:
    """Predicted rows whose id, compared as text, is in the catalogue, under the catalogue's name."""
    known = catalogue.select(F.col("id").cast("string").alias(key), F.col("name").alias("root_name"))
    return predicted.withColumn(key, F.col(key).cast("string")).join(known, key)


def attach_nutrition(mapped: DataFrame, nutrition: DataFrame) -> DataFrame:
    """The i-th quantity component beside the i-th root item, with its nutrition.

    Both lists end with the shorter. ``nutrition`` is keyed by the component
    text, from a table or from batch inference.
    """
    wanted, found = F.split("quantity_details", r" \| "), F.split("root_item_name", r" \| ")
    shorter = F.least(F.size(wanted), F.size(found))
    pairs = F.zip_with(
        F.slice(wanted, 1, shorter),
        F.slice(found, 1, shorter),
        lambda a, b: F.struct(a.alias("quantity_component"), b.alias("root_item")),
    )
    return (
        mapped.filter("quantity_details <> '' AND root_item_name <> ''")
        .select("id", F.posexplode(pairs).alias("position", "pair"))
        .select("id", "position", "pair.*")
        .join(nutrition, "quantity_component", "left")
    )


def evaluate_mapping(predictions: DataFrame, fold_unicode: bool = True) -> DataFrame:
    """Verdict per prediction and its group's match rate.

    A prediction is right where its normalised name equals the reference name;
    null where either is missing. Approval is left as it came.
    """
    same = text.normalize_name(F.col("predicted_menu_name"), fold_unicode) == text.normalize_name(
        F.col("master_menu_name"), fold_unicode
    )
    return predictions.withColumn("eval_prediction", same)


def match_rate(evaluated: DataFrame, *keys: str) -> DataFrame:
    return evaluated.groupBy(*keys).agg(
        F.count("*").alias("predictions"),
        F.count_if(F.col("eval_prediction").isNull()).alias("not_judged"),
        F.round(F.avg(F.col("eval_prediction").cast("int")), 4).alias("match_rate"),
    )


def sentence_windows(documents: DataFrame, size: int = 2, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Each sentence with up to ``size`` neighbours on either side.

    The neighbours come from the document's own sentence array, so nothing is
    shuffled.
    """
    sentences = F.filter(
        F.transform(F.split(column, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != ""
    )

    def with_window(sentence: Column, i: Column) -> Column:
        first = F.greatest(i - size, F.lit(0))
        near = F.slice("sentences", first + 1, i + size - first + 1)
        return F.struct(sentence.alias("sentence"), F.array_join(near, " ").alias("window"))

    return (
        documents.select(key, sentences.alias("sentences"))
        .select(key, F.posexplode(F.transform("sentences", with_window)).alias("position", "s"))
        .select(key, "position", "s.*")
    )
