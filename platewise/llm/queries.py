"""The operators of this package applied to whole tables, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm import ann, bpe, chat, exact, jaccard, licenses, lines, manifest, mixing, passages, suffixes, toxicity, trie
from platewise.llm.common import conversations, documents, labels, prepare


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detections(documents(spark, sf_dir)).drop("spans")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_groups(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(documents(spark, sf_dir)).drop("kept")


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_report(documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), labels(spark, sf_dir)).drop("evidence")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.formatted(chat.with_intruder(conversations(spark, sf_dir))))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proofs(documents(spark, sf_dir))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(conversations(spark, sf_dir))


REGISTRY = {
    "op1_licenses": op1_licenses,
    "op2_jaccard": op2_jaccard,
    "op3_mixing": op3_mixing,
    "op4_suffixes": op4_suffixes,
    "op5_exact": op5_exact,
    "op6_passages": op6_passages,
    "op7_bpe": op7_bpe,
    "op8_lines": op8_lines,
    "op9_toxicity": op9_toxicity,
    "op10_ann": op10_ann,
    "op11_chat": op11_chat,
    "op12_manifest": op12_manifest,
    "op13_trie": op13_trie,
}
SQL = {
    "op2_jaccard": jaccard.OP2_SQL,
    "op5_exact": exact.OP5_SQL,
    "op11_chat": chat.OP11_SQL,
    "op12_manifest": manifest.OP12_SQL,
    "op13_trie": trie.OP13_SQL,
}
