"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import boilerplate, encoding, language, leakage, lookalike, mixing, quality, reading, repeated_lines, residue
from foliomill.llm.common import shared_model, table


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "chapters"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_statistics(spark, d).where(F.col("kind").isin("list", "table", "junk")).select("chapter_id")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged_values(table(spark, d, "books"), table(spark, d, "chapters"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_restored(spark, d).select("src_table", "row_id", "field")


def _languages(spark: SparkSession, d: str) -> language.LinearChain:
    return shared_model(spark, d, "p3", ("documents",), lambda: language.fit(table(spark, d, "documents")))


def p3_works(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "books"), table(spark, d, "chapters"), _languages(spark, d))[0]


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "books"), table(spark, d, "chapters"), _languages(spark, d))[1]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(table(spark, d, "books"), table(spark, d, "chapters"), _languages(spark, d))


def _labeller(spark: SparkSession, d: str) -> boilerplate.Labeller | None:
    return shared_model(spark, d, "p4", ("chapters", "pages"), lambda: boilerplate.fit(table(spark, d, "chapters"), table(spark, d, "pages")))


def p4_main_content(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_content(table(spark, d, "chapters"), _labeller(spark, d))


def p4_pages(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.page_content(table(spark, d, "pages"), _labeller(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    labels = boilerplate.boilerplate(table(spark, d, "chapters"), _labeller(spark, d))
    return labels.select("chapter_id", F.explode("boilerplate").alias("block_idx"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "chapters"), table(spark, d, "books"))


def p5_without_lines(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, d, "chapters"), table(spark, d, "books"))


def p6_one_form(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.one_form(table(spark, d, "chapters"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_one_form(spark, d).select("chapter_id", "field")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "chapters")).select("chapter_id")


def p7_messages(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "chapters"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix_report(mixing.mixture(table(spark, d, "documents"), targets), targets)


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    documents, labels = table(spark, d, "documents"), table(spark, d, "labels")
    # kept as bytes, as its tables are large and mostly zeros
    saved = shared_model(spark, d, "p10", ("documents", "labels"), lambda: reading.fit(documents, labels).save())
    return reading.reading_levels(documents, reading.ReadingModel.load(saved))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_levels(spark, d).where("level = 4").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_statistics": p1_statistics,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p3_works": p3_works,
    "p3_segments": p3_segments,
    "p4_found": p4_found,
    "p4_main_content": p4_main_content,
    "p4_pages": p4_pages,
    "p5_found": p5_found,
    "p5_without_lines": p5_without_lines,
    "p6_found": p6_found,
    "p6_one_form": p6_one_form,
    "p7_found": p7_found,
    "p7_messages": p7_messages,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_mixture": p9_mixture,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
}
