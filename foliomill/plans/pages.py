"""Queries on fetched pages and the import pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.operators import pages
from foliomill.plans.registry import Registry, table

query = Registry()


@query(r"SELECT page_id, html_title AS title FROM (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?i)<title>([^<]*)', 1), '\s+', ' ', 'g')) AS html_title FROM pages)")
def page_title(spark, d):
    raw = F.regexp_extract("html", "(?i)<title>([^<]*)", 1)
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(raw, r"\s+", " ")).alias("title"))


@query("SELECT page_id, length(html) AS chars FROM pages WHERE html IS NOT NULL")
def page_scan(spark, d):
    return table(spark, d, "pages").where("html IS NOT NULL").select("page_id", F.length("html").alias("chars"))


@query()
def generic_meta(spark, d):
    return pages.page_meta(table(spark, d, "pages"))


@query()
def page_links(spark, d):
    return pages.page_links(table(spark, d, "pages"))


@query()
def page_tags(spark, d):
    return pages.page_tags(table(spark, d, "pages"))


@query()
def extract_content(spark, d):
    return pages.page_chapters(table(spark, d, "pages"))


@query()
def generic_links(spark, d):
    """The links a listing keeps, filtered in the JVM from all links."""
    return pages.kept_links(pages.page_links(table(spark, d, "pages")))


@query()
def import_parts(spark, d):
    """Every page as a work with its parts, the parts numbered."""
    meta = pages.page_meta(table(spark, d, "pages"))
    return meta.select("page_id", F.col("title").alias("work"), F.inline("chapters")).withColumnRenamed("title", "part")
