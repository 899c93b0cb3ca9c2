"""Queries on the store: counts, status, listings, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.functions import url as U
from foliomill.operators import export, ranking, store
from foliomill.plans.registry import CURRENT, LISTING, Registry, table

query = Registry()

COUNTS = f"""{CURRENT},
counts AS (
  SELECT book_id, count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'fetching') AS fetching,
         count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'empty') AS "empty"
  FROM cur GROUP BY book_id
)"""


@query(f"WITH {CURRENT} SELECT chapter_id, book_id, idx, status FROM cur")
def current_chapters(spark, d):
    return store.current(table(spark, d, "chapters").select("chapter_id", "book_id", "idx", "status", "fetched_at")).select("chapter_id", "book_id", "idx", "status")


@query(f"WITH {COUNTS} SELECT * FROM counts")
def status_counts(spark, d):
    return store.status_counts(table(spark, d, "chapters"))


@query(
    f"""WITH {COUNTS} SELECT book_id, CASE WHEN pending + fetching > 0 THEN 'importing' WHEN done > 0 THEN 'ready' ELSE 'failed' END AS status,
    done, failed + "empty" AS failed, total, CAST(CASE WHEN total > 0 THEN round(done / total * 100) ELSE 0 END AS INTEGER) AS percent FROM counts"""
)
def book_status(spark, d):
    return store.book_status(store.status_counts(table(spark, d, "chapters")))


@query(
    f"""WITH {COUNTS}, newest AS (SELECT book_id, title, author, created_at FROM books ORDER BY created_at DESC NULLS LAST, book_id LIMIT 60)
    SELECT n.book_id, title, author, created_at, coalesce(total, 0) AS total, coalesce(done, 0) AS done, coalesce(failed, 0) AS failed
    FROM newest n LEFT JOIN counts c ON n.book_id = c.book_id"""
)
def library(spark, d):
    return store.library(table(spark, d, "books"), table(spark, d, "chapters"))


@query("SELECT book_id, title FROM books WHERE contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(author, ''))), 'lantern')")
def library_search(spark, d):
    return store.search(table(spark, d, "books"), "Lantern").select("book_id", "title")


@query("SELECT book_id, source_url, title, coalesce(octet_length(cover), 0) > 0 AS has_cover FROM books")
def public_books(spark, d):
    return table(spark, d, "books").select("book_id", "source_url", "title", (F.coalesce(F.length("cover"), F.lit(0)) > 0).alias("has_cover"))


@query("SELECT chapter_id, book_id, idx, title, status, left(coalesce(plain_text, ''), 200) AS preview FROM chapters")
def light_chapters(spark, d):
    preview = F.left(F.coalesce("plain_text", F.lit("")), F.lit(200)).alias("preview")
    return table(spark, d, "chapters").select("chapter_id", "book_id", "idx", "title", "status", preview)


@query(f"WITH {CURRENT} SELECT book_id, idx, CASE WHEN status IN ('pending', 'fetching') THEN 'open' ELSE 'broken' END AS list FROM cur WHERE status IN ('pending', 'fetching', 'failed', 'empty')")
def open_and_broken(spark, d):
    rows = store.current(table(spark, d, "chapters").select("chapter_id", "book_id", "idx", "status", "fetched_at"))
    kind = F.when(F.col("status").isin("pending", "fetching"), "open").otherwise("broken")
    return rows.where(F.col("status").isin("pending", "fetching", "failed", "empty")).select("book_id", "idx", kind.alias("list"))


@query(
    f"""WITH {LISTING}, {CURRENT} SELECT r.book_id, r.idx, coalesce(nullif(c.title, ''), r.title) AS title, r.url, coalesce(c.status, 'pending') AS status,
    coalesce(c.word_count, 0) AS word_count FROM refs r LEFT JOIN cur c ON r.book_id = c.book_id AND r.idx = c.idx"""
)
def chapter_refs_index(spark, d):
    return store.listed_parts(store.listing(table(spark, d, "chapter_refs")), table(spark, d, "chapters"))


@query(f"WITH {LISTING} SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM chapters c WHERE c.book_id = r.book_id AND c.idx = r.idx)")
def insert_absent(spark, d):
    return store.absent(store.listing(table(spark, d, "chapter_refs")), table(spark, d, "chapters"))


@query(
    f"""WITH {LISTING}, {CURRENT} SELECT r.book_id, r.idx, r.title, r.url, c.chapter_id IS NULL AS is_new FROM refs r LEFT JOIN cur c ON r.book_id = c.book_id AND r.idx = c.idx
    WHERE c.chapter_id IS NULL OR r.title IS DISTINCT FROM c.title OR r.url IS DISTINCT FROM c.source_url"""
)
def changed_rows(spark, d):
    return store.changed(store.listing(table(spark, d, "chapter_refs")), table(spark, d, "chapters"))


@query(
    f"""WITH {LISTING}, {CURRENT} SELECT coalesce(c.book_id, r.book_id) AS book_id, coalesce(c.idx, r.idx) AS idx, coalesce(r.title, c.title) AS title,
    coalesce(r.url, c.source_url) AS source_url, coalesce(c.status, 'pending') AS status, coalesce(c.word_count, 0) AS word_count
    FROM cur c FULL JOIN refs r ON r.book_id = c.book_id AND r.idx = c.idx"""
)
def bulk_update(spark, d):
    return store.updated(table(spark, d, "chapters"), store.listing(table(spark, d, "chapter_refs")))


def _incoming(books):
    """An import of the pages' works again: titles trimmed, every second cover missing,
    and a copy of each work under a new address."""
    fields = ["source_url", F.trim("title").alias("title"), "author", "description"]
    again = books.select(*fields, F.when(F.col("book_id") % 2 == 0, "").otherwise(F.concat("cover_url", F.lit("?v=2"))).alias("cover_url"))
    new = books.select(F.concat("source_url", F.lit("/copy")).alias("source_url"), "title", "author", "description", "cover_url")
    return again.unionByName(new)


@query(
    """WITH incoming AS (
      SELECT source_url, trim(title) AS title, author, description, CASE WHEN book_id % 2 = 0 THEN '' ELSE cover_url || '?v=2' END AS cover_url FROM books
      UNION ALL SELECT source_url || '/copy', title, author, description, cover_url FROM books),
    merged AS (
      SELECT b.book_id, coalesce(i.source_url, b.source_url) AS source_url, CASE WHEN i.source_url IS NULL THEN b.title ELSE i.title END AS title,
             CASE WHEN i.source_url IS NULL THEN b.author ELSE i.author END AS author, CASE WHEN i.source_url IS NULL THEN b.description ELSE i.description END AS description,
             CASE WHEN i.source_url IS NULL THEN b.cover_url ELSE coalesce(nullif(i.cover_url, ''), b.cover_url) END AS cover_url
      FROM incoming i FULL JOIN books b ON i.source_url = b.source_url)
    SELECT coalesce(book_id, (SELECT max(book_id) FROM books) + row_number() OVER (PARTITION BY book_id IS NULL ORDER BY sha1(source_url))) AS book_id,
           source_url, title, author, description, cover_url FROM merged"""
)
def upsert_books(spark, d):
    books = table(spark, d, "books")
    return store.upserted(books, _incoming(books)).select("book_id", "source_url", "title", "author", "description", "cover_url")


@query("SELECT chapter_id, book_id FROM chapters c WHERE NOT EXISTS (SELECT 1 FROM books b WHERE b.book_id = c.book_id AND b.status = 'failed')")
def delete_cascade(spark, d):
    books = table(spark, d, "books")
    return store.without_books(books, table(spark, d, "chapters"), books.where("status = 'failed'"))[1].select("chapter_id", "book_id")


@query(
    """SELECT chapter_id, book_id, idx, CASE WHEN s THEN 'pending' ELSE status END AS status, CASE WHEN s THEN 0 ELSE word_count END AS word_count,
    CASE WHEN s THEN 0 ELSE char_count END AS char_count, CASE WHEN s THEN 0 ELSE image_count END AS image_count, CASE WHEN s THEN '' ELSE error END AS error, s AS was_reset
    FROM (SELECT *, status IN ('failed', 'empty') AS s FROM chapters)"""
)
def reset_failed(spark, d):
    return store.reset_failed(table(spark, d, "chapters"))


@query("SELECT book_id, count(*) AS reset FROM chapters WHERE status IN ('failed', 'empty') GROUP BY book_id")
def reset_count(spark, d):
    return store.reset_failed(table(spark, d, "chapters")).where("was_reset").groupBy("book_id").agg(F.count("*").alias("reset"))


@query(
    f"""WITH {CURRENT} SELECT book_id, idx, title FROM cur WHERE status = 'done' AND
    (regexp_replace(coalesce(plain_text, ''), '\\s', '', 'g') <> '' OR len(list_filter(coalesce(blocks, []), lambda b: b.type = 'img')) > 0)"""
)
def exportable(spark, d):
    return store.exportable(table(spark, d, "chapters")).select("book_id", "idx", "title")


@query(f"WITH {CURRENT} SELECT book_id, idx, title FROM cur WHERE status IS DISTINCT FROM 'done'")
def unavailable(spark, d):
    return store.unavailable(table(spark, d, "chapters"))


@query("SELECT chapter_id, book_id, idx FROM chapters WHERE status = 'done'")
def done_chapters(spark, d):
    return table(spark, d, "chapters").where("status = 'done'").select("chapter_id", "book_id", "idx")


@query(f"WITH {CURRENT} SELECT b.book_id, b.title AS work, c.idx, c.title FROM books b JOIN cur c ON b.book_id = c.book_id")
def book_with_chapters(spark, d):
    rows = store.current(table(spark, d, "chapters").select("chapter_id", "book_id", "idx", "title", "fetched_at"))
    return table(spark, d, "books").select("book_id", F.col("title").alias("work")).join(rows.select("book_id", "idx", "title"), "book_id")


@query(f"WITH {LISTING} SELECT book_id, idx, url, CAST(row_number() OVER (PARTITION BY book_id ORDER BY idx, url) AS INTEGER) AS n FROM refs WHERE url <> ''")
def dense_index(spark, d):
    refs = store.listing(table(spark, d, "chapter_refs")).where("url <> ''")
    return ranking.dense_index(refs, "book_id", [F.col("idx"), F.col("url")], ranking.ranges(F.col("idx"))).select("book_id", "idx", "url", "n")


_ORD = r"""coalesce(try_cast(nullif(regexp_extract(title, '(?i)(?:الفصل|الجزء|chapter|chapitre|part|episode)\s*[-_#]*\s*(\d{1,4})', 1), '') AS INTEGER),
           try_cast(nullif(regexp_extract(url, '(?i)(?:post_id|chapter|chapitre|chapter_id|ep|part|id)=(\d{1,7})', 1), '') AS INTEGER))"""


@query(f"WITH {LISTING} SELECT book_id, url, idx, {_ORD} AS ordinal, CAST(row_number() OVER (PARTITION BY book_id ORDER BY {_ORD} NULLS LAST, idx) AS INTEGER) AS n FROM refs")
def ordinal_sort(spark, d):
    refs = store.listing(table(spark, d, "chapter_refs")).withColumn("ordinal", T.chapter_ordinal(F.col("title"), F.col("url")))
    return ranking.dense_index(refs, "book_id", [F.col("ordinal").asc_nulls_last(), F.col("idx")], ranking.ranges(F.col("ordinal"), F.col("idx"))).select("book_id", "url", "idx", "ordinal", "n")


@query(f"WITH {CURRENT} SELECT book_id, idx, CAST(row_number() OVER (PARTITION BY book_id ORDER BY idx) AS INTEGER) AS play_order FROM cur WHERE status = 'done'")
def play_order(spark, d):
    rows = store.current(table(spark, d, "chapters").select("chapter_id", "book_id", "idx", "status", "fetched_at")).where("status = 'done'")
    return ranking.dense_index(rows.select("book_id", "idx"), "book_id", [F.col("idx")], ranking.ranges(F.col("idx")), "play_order")


@query(
    r"""WITH links AS (SELECT book_id, url, title, idx, title IS NULL OR title = '' OR regexp_matches(title, '(?i)ابدأ القراءة|أبدأ القراءة|اقرأ الآن|اقرأي|متابعة القراءة|الصفحة التالية|السابق|التالي|start reading|read now|continue reading|next chapter|previous chapter|login|sign in|register|share|comments?') AS noise FROM chapter_refs)
    SELECT book_id, url, min(idx) AS position, arg_min(title, struct_pack(a := idx, b := title)) FILTER (WHERE NOT noise) AS title FROM links GROUP BY book_id, url"""
)
def link_groups(spark, d):
    links = table(spark, d, "chapter_refs")
    noise = F.col("title").isNull() | (F.col("title") == "") | T.call_to_action(F.col("title"))
    named = F.when(~noise, F.struct("idx", "title"))
    return links.groupBy("book_id", "url").agg(F.min("idx").alias("position"), F.min(named)["title"].alias("title"))


_IMAGES = f"""{CURRENT}, imgs AS (
  SELECT book_id, idx, t.pos, t.b.src AS src FROM cur, unnest(blocks) WITH ORDINALITY AS t(b, pos) WHERE t.b.type = 'img' AND t.b.src IS NOT NULL)"""


def _image_refs(spark, d):
    rows = store.current(table(spark, d, "chapters").select("chapter_id", "book_id", "idx", F.filter("blocks", lambda b: b["type"] == "img").alias("blocks"), F.transform("blocks", lambda b, i: F.when(b["type"] == "img", i)).alias("_p"), "fetched_at"))
    places = F.filter("_p", lambda p: p.isNotNull())
    return rows.select("book_id", "idx", F.inline(F.arrays_zip(F.transform("blocks", lambda b: b["src"]).alias("src"), places.alias("pos")))).where("src IS NOT NULL")


@query(f"WITH {_IMAGES} SELECT book_id, src, idx, pos FROM (SELECT book_id, src, idx, CAST(pos - 1 AS INTEGER) AS pos, row_number() OVER (PARTITION BY book_id, src ORDER BY idx, pos) AS rn FROM imgs) WHERE rn = 1")
def distinct_images(spark, d):
    return ranking.first_occurrences(_image_refs(spark, d), ["book_id", "src"], [F.col("idx"), F.col("pos")]).select("book_id", "src", "idx", "pos")


@query(
    f"""WITH {_IMAGES}, firsts AS (SELECT book_id, src, min(struct_pack(a := idx, b := pos)) AS place FROM imgs GROUP BY book_id, src),
    sized AS (SELECT f.book_id, f.src, f.place, octet_length(i.bytes) AS size FROM firsts f JOIN images i ON f.src = i.src),
    summed AS (SELECT book_id, src, CAST(sum(size) OVER w AS BIGINT) AS running, CAST(count(*) OVER w AS BIGINT) AS n FROM sized WINDOW w AS (PARTITION BY book_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT * FROM summed WHERE running <= 62914560 AND n <= 400"""
)
def byte_budget(spark, d):
    firsts = ranking.first_occurrences(_image_refs(spark, d), ["book_id", "src"], [F.col("idx"), F.col("pos")])
    sized = firsts.join(table(spark, d, "images").select("src", F.length("bytes").alias("size")), "src")
    return ranking.within_budget(sized, "book_id", [F.col("idx"), F.col("pos")], ranking.ranges(F.col("idx")), "size", export.MOST_IMAGE_BYTES, export.MOST_IMAGES).select("book_id", "src", "running", "n")


@query(
    f"""WITH {_IMAGES} SELECT m.book_id, m.idx, m.src, octet_length(i.bytes) AS size, i.mime, CAST(m.pos - 1 AS INTEGER) AS pos FROM imgs m JOIN images i ON m.src = i.src"""
)
def blocks_with_images(spark, d):
    pics = table(spark, d, "images").select("src", F.length("bytes").alias("size"), "mime")
    return _image_refs(spark, d).join(pics, "src").select("book_id", "idx", "src", "size", "mime", "pos")


@query(
    f"""WITH {_IMAGES}, scored AS (SELECT m.book_id, m.src, m.idx, m.pos, i.width * i.height + CASE WHEN regexp_matches(lower(m.src), 'cover|book|novel|poster|thumb|story') THEN 500 ELSE 0 END AS score
      FROM imgs m JOIN images i ON m.src = i.src)
    SELECT book_id, src, score FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, idx, pos) AS rn FROM scored WHERE score > 0) WHERE rn = 1"""
)
def cover_choice(spark, d):
    bonus = F.when(F.lower("src").rlike("cover|book|novel|poster|thumb|story"), 500).otherwise(0)
    rows = _image_refs(spark, d).join(table(spark, d, "images").select("src", "width", "height"), "src")
    scored = rows.select("book_id", "src", "idx", "pos", (F.col("width") * F.col("height") + bonus).alias("score")).where("score > 0")
    return ranking.first_occurrences(scored, ["book_id"], [-F.col("score"), F.col("idx"), F.col("pos")]).select("book_id", "src", "score")


@query(
    """SELECT host, description FROM (SELECT host, description, row_number() OVER (PARTITION BY host ORDER BY length(description) DESC, book_id) AS rn
    FROM books WHERE length(description) > 40) WHERE rn = 1"""
)
def longest_description(spark, d):
    rows = table(spark, d, "books").where(F.length("description") > 40).select("host", "description", "book_id")
    return ranking.first_occurrences(rows, ["host"], [-F.length("description"), F.col("book_id")]).select("host", "description")


@query("SELECT src, mime, width, height FROM images WHERE octet_length(bytes) > 0 AND starts_with(mime, 'image/') AND mime <> 'image/svg+xml'")
def loadable_images(spark, d):
    rows = table(spark, d, "images").where((F.length("bytes") > 0) & F.col("mime").startswith("image/") & (F.col("mime") != "image/svg+xml"))
    return rows.select("src", "mime", "width", "height")


@query(
    f"""WITH {COUNTS} SELECT book_id, CASE WHEN pending + fetching = 0 AND done > 0 AND failed + "empty" = 0 THEN 'ready' WHEN done > 0 THEN done || '/' || total
    WHEN pending + fetching = 0 THEN 'failed' ELSE 'importing' END AS label FROM counts"""
)
def status_label(spark, d):
    open_, bad = F.col("pending") + F.col("fetching"), F.col("failed") + F.col("empty")
    label = F.when((open_ == 0) & (F.col("done") > 0) & (bad == 0), "ready").when(F.col("done") > 0, F.concat(F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string")))
    return store.status_counts(table(spark, d, "chapters")).select("book_id", label.when(open_ == 0, "failed").otherwise("importing").alias("label"))


@query(
    rf"""WITH {LISTING}, n AS (SELECT *, try_cast(nullif(regexp_extract(url, '(?i)chapters/(\d+)', 1), '') AS BIGINT) AS number FROM refs)
    SELECT book_id, url, number, CAST(row_number() OVER (PARTITION BY book_id ORDER BY number NULLS LAST, idx) AS INTEGER) AS n FROM n"""
)
def modern_order(spark, d):
    refs = store.listing(table(spark, d, "chapter_refs")).withColumn("number", U.modern_number(F.col("url")))
    return ranking.dense_index(refs, "book_id", [F.col("number").asc_nulls_last(), F.col("idx")], ranking.ranges(F.col("number"), F.col("idx"))).select("book_id", "url", "number", "n")


@query(
    f"""WITH {LISTING}, n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY idx) AS n, count(*) OVER (PARTITION BY book_id) AS total FROM refs)
    SELECT r.book_id, CASE WHEN total < 2 THEN b.source_url ELSE r.url END AS url, CAST(n AS INTEGER) AS n FROM n r JOIN books b ON r.book_id = b.book_id WHERE n <= 500"""
)
def listing_limit(spark, d):
    """The first 500 parts of a listing; a single link means the work's page is its part."""
    refs = store.listing(table(spark, d, "chapter_refs"))
    totals = refs.groupBy("book_id").agg(F.count("*").alias("total"))
    rows = ranking.dense_index(refs, "book_id", [F.col("idx")], ranking.ranges(F.col("idx"))).where("n <= 500")
    rows = rows.join(totals, "book_id").join(table(spark, d, "books").select("book_id", "source_url"), "book_id")
    return rows.select("book_id", F.when(F.col("total") < 2, F.col("source_url")).otherwise(F.col("url")).alias("url"), "n")
