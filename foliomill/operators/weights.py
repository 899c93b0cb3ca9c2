"""Size report: totals, estimated size per output format, share of each part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.operators.store import current

#: Fixed values of the size model.
BYTES_PER_CHAR, BYTES_PER_TITLE, BYTES_PER_IMAGE, WORDS_PER_MINUTE = 1.7, 90, 143360, 180


def _done(name: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("status") == "done", F.col(name))), F.lit(0)).cast("long")


def totals(chapters: DataFrame) -> DataFrame:
    """Words, characters, images and reading minutes over the done parts of each work."""
    rows = current(chapters.select("chapter_id", "book_id", "idx", "status", "word_count", "char_count", "image_count", "fetched_at"))
    sums = rows.groupBy("book_id").agg(
        _done("word_count").alias("words"), _done("char_count").alias("chars"), _done("image_count").alias("images"),
        F.count("*").alias("chapters"), F.count_if(F.col("status") == "done").alias("fetched"), F.count_if(F.col("status").isin("failed", "empty")).alias("failed"),
    )
    return sums.withColumn("reading_minutes", F.greatest(F.lit(1), F.round(F.col("words") / float(WORDS_PER_MINUTE))).cast("long"))


def formats(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Estimated bytes and images of eight formats for each work."""
    cover = F.coalesce(F.length("cover"), F.lit(0)).cast("long")
    rows = totals(chapters).join(books.select("book_id", cover.alias("c")), "book_id")
    base = (F.round(F.col("chars") * F.lit(BYTES_PER_CHAR)) + F.col("fetched") * BYTES_PER_TITLE).alias("b")
    sized = rows.select("book_id", "images", "c", base, (F.col("images") * BYTES_PER_IMAGE).alias("i"))
    # name, share of the text, images, cover, constant, whether images count
    model = (
        ("txt", 1.0, 0.0, 0, 0), ("md", 1.08, 0.0, 0, 0), ("html", 1.3, 0.0, 0, 4096), ("json", 0.42, 0.0, 0, 0),
        ("fb2", 1.35, 1.0, 0, 0), ("epub", 1.15, 1.0, 1, 26624), ("docx", 0.55, 1.0, 0, 22528), ("pdf", 0.5, 0.75, 0, 40960),
    )
    each = [
        F.struct(
            F.lit(name).alias("format"),
            (F.round(F.col("b") * F.lit(text)) + F.round(F.col("i") * F.lit(image)) + F.col("c") * cover_too + constant).cast("long").alias("bytes"),
            (F.lit(0) if not image else F.col("images") + (F.col("c") > 0).cast("int") if name == "epub" else F.col("images")).cast("long").alias("images"),
            F.lit(bool(image)).alias("estimated"),
        )
        for name, text, image, cover_too, constant in model
    ]
    return sized.select("book_id", F.inline(F.array(*each)))


def bars(sizes: DataFrame) -> DataFrame:
    """Length of each format's bar: percent of the largest of the work, at least 4."""
    most = F.max("bytes").over(Window.partitionBy("book_id"))
    percent = F.greatest(F.lit(4), F.round(F.col("bytes") / F.greatest(F.lit(1), most) * 100)).cast("int")
    return sizes.select("book_id", "format", percent.alias("percent"))


def shares(chapters: DataFrame) -> DataFrame:
    """Each current part's percentage of the characters of the work's done parts.

    The sum per work is aggregated and joined, not taken in a window, so a work with
    very many parts is never one task's."""
    rows = current(chapters.select("chapter_id", "book_id", "idx", "title", "status", "char_count", "fetched_at"))
    sums = rows.groupBy("book_id").agg(_done("char_count").alias("s"))
    percent = F.round(F.coalesce("char_count", F.lit(0)) / F.greatest(F.lit(1), F.col("s")) * 100).cast("int")
    return rows.join(sums, "book_id").select("book_id", "idx", F.coalesce("char_count", F.lit(0)).alias("chars"), percent.alias("share"))


def extremes(chapters: DataFrame) -> DataFrame:
    """Heaviest and lightest done part of each work; the first of equal heaviest, the
    last of equal lightest."""
    rows = current(chapters.select("chapter_id", "book_id", "idx", "status", "char_count", "fetched_at")).where("status = 'done'")
    size = F.coalesce("char_count", F.lit(0))
    return rows.groupBy("book_id").agg(
        F.min_by("idx", F.struct(-size, F.col("idx"))).alias("heaviest"), F.max(size).alias("most"),
        F.min_by("idx", F.struct(size, -F.col("idx"))).alias("lightest"), F.min(size).alias("least"),
    )
