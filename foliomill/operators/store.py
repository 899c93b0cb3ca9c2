"""The two-level store of works and parts as DataFrame transformations.

Nothing that can be computed is stored: counters and status are views. The latest
delivery of a part (by ``fetched_at``, then ``chapter_id``) is its current row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import blocks as B
from foliomill.functions.text import IMAGE_EXTENSIONS, trimmed
from foliomill.functions.text import lookup as lookup_value

STATES = ("pending", "fetching", "done", "failed", "empty")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order, found by aggregation: partial maxima are
    combined before the shuffle, so a key with many rows burdens no task."""
    names = [c for c in rows.columns if c not in key]
    best = F.min_by(F.struct(*names), F.struct(*order)) if order else F.first(F.struct(*names))
    return rows.groupBy(*key).agg(best.alias("_row")).select(*key, "_row.*").select(*rows.columns)


def current(chapters: DataFrame) -> DataFrame:
    """One row per (``book_id``, ``idx``): the last delivered. Rows never fetched come
    last; equal times are decided by the higher ``chapter_id``."""
    age = -F.coalesce(F.unix_micros("fetched_at"), F.lit(-(2**62)).cast("long"))
    return latest(chapters, ["book_id", "idx"], [age.alias("a"), (-F.col("chapter_id")).alias("c")])


def current_whole(chapters: DataFrame) -> DataFrame:
    """``current`` for rows with texts and blocks: parts that were delivered once, nearly
    all, stay where they are. Aggregates of narrow rows give the newest of the parts that
    came again; older rows of these are taken out by a join that the planner broadcasts
    where they are few. Only exact repetitions of a newest row go through ``current``."""
    key = ["book_id", "idx"]
    # time and id as one number, which aggregates by hash; times before the year one are null
    age = F.coalesce(F.unix_micros("fetched_at"), F.lit(-(10**17)))
    place = (age.cast("decimal(18,0)") * F.lit(Decimal(10**19))).cast("decimal(38,0)") + F.coalesce("chapter_id", F.lit(-(2**62))).cast("decimal(19,0)")
    placed = chapters.withColumn("_at", place.cast("decimal(38,0)"))
    rows = placed.groupBy(*key, "_at").agg(F.count("*").alias("_m"))
    newest = rows.groupBy(*key).agg(F.max("_at").alias("_best"), F.sum("_m").alias("_n"), F.max("_m").alias("_most")).where("_n > 1")
    newest = newest.select(F.col("book_id").alias("_book"), F.col("idx").alias("_idx"), "_best", "_most")
    this = placed["book_id"].eqNullSafe(F.col("_book")) & placed["idx"].eqNullSafe(F.col("_idx"))
    last = F.col("_at") == F.col("_best")
    once = placed.join(newest, this, "left").where(F.col("_best").isNull() | (last & (F.col("_most") == 1)))
    twice = placed.join(newest.where("_most > 1"), this).where(last)
    return once.select(*chapters.columns).unionByName(current(twice.select(*chapters.columns)))


def status_counts(chapters: DataFrame) -> DataFrame:
    """Parts of each work by state."""
    states = [F.count_if(F.col("status") == s).alias(s) for s in STATES]
    return current(chapters.select("chapter_id", "book_id", "idx", "status", "fetched_at")).groupBy("book_id").agg(F.count("*").alias("total"), *states)


def book_status(counts: DataFrame) -> DataFrame:
    """importing while parts are open, ready if any is done, failed otherwise; with
    the percentage done."""
    state = F.when(F.col("pending") + F.col("fetching") > 0, "importing").when(F.col("done") > 0, "ready").otherwise("failed")
    percent = F.when(F.col("total") > 0, F.round(F.col("done") / F.col("total") * 100)).otherwise(0).cast("int")
    return counts.select("book_id", state.alias("status"), "done", (F.col("failed") + F.col("empty")).alias("failed"), "total", percent.alias("percent"))


def library(books: DataFrame, chapters: DataFrame, limit: int = 60) -> DataFrame:
    """The newest works with their counts; works without parts have zeros."""
    newest = books.select("book_id", "title", "author", "created_at").orderBy(F.col("created_at").desc_nulls_last(), "book_id").limit(limit)
    counts = status_counts(chapters)
    return newest.join(counts, "book_id", "left").select(
        "book_id", "title", "author", "created_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "done", "failed")]
    )


def search(books: DataFrame, text: str) -> DataFrame:
    """Works whose title or author holds a text, letter case ignored; blank finds all."""
    needle = text.strip().lower()
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("author", F.lit(""))))
    return books if not needle else books.where(hay.contains(needle))


def listed_parts(refs: DataFrame, chapters: DataFrame) -> DataFrame:
    """The listing drives: state, words and stored title of each listed part, with
    defaults where it isn't stored."""
    have = current(chapters.select("chapter_id", "book_id", "idx", "title", "status", "word_count", "fetched_at")).select(
        "book_id", "idx", F.col("title").alias("_t"), F.col("status").alias("_s"), F.col("word_count").alias("_w")
    )
    return refs.select("book_id", "idx", "title", "url").join(have, ["book_id", "idx"], "left").select(
        "book_id", "idx", F.coalesce(F.nullif("_t", F.lit("")), "title").alias("title"), "url",
        F.coalesce("_s", F.lit("pending")).alias("status"), F.coalesce("_w", F.lit(0)).alias("word_count"),
    )


def listing(refs: DataFrame) -> DataFrame:
    """The last received listing row of each part."""
    age = -F.coalesce(F.unix_micros("received_at"), F.lit(-(2**62)).cast("long"))
    return latest(refs, ["book_id", "idx"], [age.alias("r"), (-F.coalesce(F.unix_micros("listed_at"), F.lit(0))).alias("l"), F.col("url").alias("u"), F.col("title").alias("t")])


def absent(refs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Listed parts that aren't stored: what an insert would add."""
    return refs.select("book_id", "idx", "title", "url").join(chapters.select("book_id", "idx").distinct(), ["book_id", "idx"], "left_anti")


def changed(refs: DataFrame, chapters: DataFrame) -> DataFrame:
    """Listed parts that aren't stored or have another title or URL."""
    have = current(chapters.select("chapter_id", "book_id", "idx", "title", "source_url", "fetched_at")).select(
        "book_id", "idx", F.col("title").alias("_t"), F.col("source_url").alias("_u"), F.lit(True).alias("_have")
    )
    joined = refs.select("book_id", "idx", "title", "url").join(have, ["book_id", "idx"], "left")
    same = F.col("_have").isNotNull() & F.col("title").eqNullSafe(F.col("_t")) & F.col("url").eqNullSafe(F.col("_u"))
    return joined.where(~same).select("book_id", "idx", "title", "url", F.col("_have").isNull().alias("is_new"))


def updated(chapters: DataFrame, refs: DataFrame) -> DataFrame:
    """The current parts with titles and URLs of the listing, content kept, and the
    parts only listed added as pending."""
    have = current(chapters.select("chapter_id", "book_id", "idx", "title", "source_url", "status", "word_count", "fetched_at"))
    new = refs.select("book_id", "idx", F.col("title").alias("_t"), F.col("url").alias("_u"))
    return have.join(new, ["book_id", "idx"], "full").select(
        "book_id", "idx", F.coalesce("_t", "title").alias("title"), F.coalesce("_u", "source_url").alias("source_url"),
        F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("word_count", F.lit(0)).alias("word_count"),
    )


def upserted(books: DataFrame, incoming: DataFrame, fields: tuple[str, ...] = ("title", "author", "description", "cover_url")) -> DataFrame:
    """Works after an import, matched by ``source_url``. Incoming fields replace the
    stored ones, but an empty incoming cover keeps the stored one. New works get the
    next ids in the order of their URLs' hashes."""
    old = books.select("book_id", "source_url", *[F.col(f).alias("_" + f) for f in fields])
    joined = incoming.select("source_url", *fields, F.lit(True).alias("_new")).join(old, "source_url", "full")
    value = lambda f: F.when(F.col("_new").isNull(), F.col("_" + f)).otherwise(F.coalesce(F.nullif(f, F.lit("")), "_" + f) if f == "cover_url" else F.col(f))
    merged = joined.select("book_id", "source_url", *[value(f).alias(f) for f in fields])
    return next_ids(merged, books)


def next_ids(merged: DataFrame, books: DataFrame) -> DataFrame:
    """Fill null ``book_id`` with the ids after the highest, numbered in the
    order of the URLs' hashes.

    Rows are split into 4,096 ranges by the first digits of the URL's hash, counted, and
    numbered within each range, so no task orders all of them."""
    top = books.agg(F.max("book_id")).head()[0] or 0
    new = merged.where("book_id IS NULL").drop("book_id").withColumn("_range", F.substring(F.sha1("source_url"), 1, 3))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = new.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(F.sha1("source_url")))
    numbered = new.withColumn("_n", within).join(F.broadcast(offsets), "_range")
    filled = numbered.withColumn("book_id", F.lit(top) + F.col("_before") + F.col("_n")).select(*merged.columns)
    return merged.where("book_id IS NOT NULL").unionByName(filled)


def saved_parts(chapters: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, index) after a write of contents: the parts with the incoming ones in place
    of those with their (``book_id``, ``idx``), and one index row of each part with its state,
    counts and the first 200 characters. Of parts that come several times the last is kept."""
    parts = current_whole(chapters.join(incoming.select("book_id", "idx").distinct(), ["book_id", "idx"], "left_anti").unionByName(current_whole(incoming), allowMissingColumns=True))
    index = parts.select("book_id", "idx", "status", "title", "word_count", "char_count", "image_count", F.coalesce("error", F.lit("")).alias("error"), F.left(F.coalesce("plain_text", F.lit("")), F.lit(200)).alias("preview"))
    return parts, index


def replaced_covers(books: DataFrame, covers: DataFrame) -> DataFrame:
    """Works with the pictures of ``covers`` (``book_id``, ``cover``, ``cover_mime``) in place of
    their own, bytes untouched, and ``cover_file``, the name of the file that holds it; null
    where there is none. Covers of unknown works and empty ones change nothing."""
    new = latest(covers.where(F.length("cover") > 0).select("book_id", F.col("cover").alias("_c"), F.col("cover_mime").alias("_m")), ["book_id"], [F.sha1("_c").alias("h")])
    joined = books.join(new, "book_id", "left")
    cover, mime = F.coalesce("_c", "cover"), F.when(F.col("_c").isNotNull(), F.col("_m")).otherwise(F.col("cover_mime"))
    name = F.concat(F.lit("cover."), lookup_value(IMAGE_EXTENSIONS, F.lower(mime), "img"))
    rest = [c for c in books.columns if c not in ("cover", "cover_mime", "cover_file")]
    return joined.select(*rest, cover.alias("cover"), mime.alias("cover_mime"), F.when(F.length(cover) > 0, name).alias("cover_file"))


def without_books(books: DataFrame, chapters: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works and parts without the works of ``gone``."""
    ids = gone.select("book_id").distinct()
    return books.join(ids, "book_id", "left_anti"), chapters.join(ids, "book_id", "left_anti")


def lookup(chapters: DataFrame, book_id: int, idx: int) -> DataFrame:
    """The current row of one part; empty if it isn't stored. The filter reaches the scan."""
    return current(chapters.where((F.col("book_id") == book_id) & (F.col("idx") == idx)))


def reset_failed(chapters: DataFrame) -> DataFrame:
    """Failed and empty parts made pending again, counts zeroed and errors cleared."""
    again = F.col("status").isin("failed", "empty")
    zero = lambda c: F.when(again, 0).otherwise(F.col(c)).alias(c)
    return chapters.select(
        "chapter_id", "book_id", "idx", F.when(again, "pending").otherwise(F.col("status")).alias("status"),
        zero("word_count"), zero("char_count"), zero("image_count"), F.when(again, "").otherwise(F.col("error")).alias("error"), again.alias("was_reset"),
    )


def exportable(chapters: DataFrame) -> DataFrame:
    """Current done parts that have text or an image."""
    rows = current_whole(chapters.select("chapter_id", "book_id", "idx", "title", "source_url", "status", "blocks", "plain_text", "fetched_at"))
    return rows.where((F.col("status") == "done") & ((trimmed(F.coalesce("plain_text", F.lit(""))) != "") | B.has_image(F.col("blocks"))))


def unavailable(chapters: DataFrame) -> DataFrame:
    """Current parts that aren't done."""
    return current(chapters.select("chapter_id", "book_id", "idx", "title", "status", "fetched_at")).where("status IS DISTINCT FROM 'done'").select("book_id", "idx", "title")
