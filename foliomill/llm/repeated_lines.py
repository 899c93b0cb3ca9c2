"""Problem 5: lines repeated across one site's documents.

Lines are normalised, hashed, and counted by distinct document within a source;
lines above the threshold are joined back and the documents rebuilt without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_DOCUMENTS = 6
MIN_LETTERS = 10


def normal_line(line: Column) -> Column:
    """The form in which lines are compared: letter case folded, decimal digits
    dropped, white space runs made one space, ends trimmed."""
    folded = F.lower(F.upper(line))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"\p{Nd}+", ""), r"[\s\p{Z}]+", " "))


def has_letters(line: Column, least: int = MIN_LETTERS) -> Column:
    return line.rlike(r"^(?:\P{L}*+\p{L}){%d}" % least)


def lines_of(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per line that can count: ``keep``, ``line_no``, ``k1``, ``k2``.

    ``k1`` and ``k2`` are 64 and 32 bits of hash of source and normalised line,
    so that only hashes travel. Null texts have no lines.
    """
    lines = docs.select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "_line"))
    norm = normal_line(F.col("_line"))
    return (
        lines.where(has_letters(F.col("_line")))
        .withColumn("_norm", norm)
        .select(*keep, "line_no", F.xxhash64("_source", "_norm").alias("k1"), F.hash("_norm").alias("k2"))
    )


def repeated_keys(lines: DataFrame, document: list[str], least: int = MIN_DOCUMENTS) -> DataFrame:
    """``k1``, ``k2``, ``documents`` of lines that stand in ``least`` documents.

    Two steps: distinct (line, document) pairs, then a count per line. The first
    is spread over the documents, the second is combined before its shuffle, so a
    line in a third of all documents burdens no task.
    """
    pairs = lines.select("k1", "k2", F.xxhash64(*document).alias("_doc")).distinct()
    return pairs.groupBy("k1", "k2").agg(F.count("*").alias("documents")).where(F.col("documents") >= least)


def with_source(chapters: DataFrame, books: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the chapters with ``_source``, the host of their work.

    Chapters whose work is unknown have no source and no repeated lines.
    """
    hosts = books.select(F.col("book_id").alias("_b"), F.col("host").alias("_source")).where("_source IS NOT NULL")
    return chapters.select(*columns).join(hosts, F.col("book_id") == F.col("_b")).drop("_b")


def repeated_lines(chapters: DataFrame, books: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """``chapter_id``, ``line_no`` of every occurrence of a repeated line.

    A line counts once per (``book_id``, ``idx``), however often it is repeated or
    delivered again. Null, empty and short lines never count; every row of
    ``chapters`` that holds a repeated line is answered, whatever its status.
    """
    docs = with_source(chapters, books, ["chapter_id", "book_id", "idx", "plain_text"])
    lines = lines_of(docs.where("plain_text IS NOT NULL"), "plain_text", ["chapter_id", "book_id", "idx", "_source"])
    keys = repeated_keys(lines, ["book_id", "idx"], least)
    return lines.join(keys, ["k1", "k2"], "left_semi").select("chapter_id", F.col("line_no").cast("int").alias("line_no"))


def without_repeated_lines(chapters: DataFrame, books: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """``chapter_id``, ``plain_text`` without repeated lines, ``removed`` lines.

    Every chapter is returned; a null text stays null, a text whose lines are all
    repeated becomes empty.
    """
    gone = repeated_lines(chapters, books, least).groupBy("chapter_id").agg(F.collect_set("line_no").alias("_gone"))
    joined = chapters.select("chapter_id", "plain_text").join(gone, "chapter_id", "left")
    lines = F.split("plain_text", "\n", -1)
    none = F.array().cast("array<int>")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.coalesce(F.col("_gone"), none), i))
    return joined.select(
        "chapter_id",
        F.array_join(kept, "\n").alias("plain_text"),
        F.size(F.coalesce(F.col("_gone"), none)).alias("removed"),
    )
