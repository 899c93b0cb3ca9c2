"""Fetched pages to works, parts and content blocks: one parse per page."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliomill.functions import blocks as B
from foliomill.functions import page
from foliomill.functions import url as U
from foliomill.functions.text import call_to_action, trimmed, word_count

REF = "struct<idx:int,title:string,url:string>"
META = f"page_id bigint, url string, adapter string, host string, title string, author string, description string, language_code string, cover_url string, chapters array<{REF}>"
CHAPTER = f"page_id bigint, url string, title string, blocks array<{B.BLOCK}>"
LINKS = "page_id bigint, url string, position int, href string, label string"


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """Apply ``fn``, row to dict or list of dicts, to Arrow batches. ``fn`` must be
    importable by the workers."""
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                got = fn(row)
                rows += got if isinstance(got, list) else [got]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, out)


def _meta(row: dict) -> dict:
    return {"page_id": row["page_id"], "url": row["url"], **page.book_meta(row["url"] or "", row["html"])}


def _chapter(row: dict) -> dict:
    return {"page_id": row["page_id"], "url": row["url"], **page.chapter(row["url"] or "", row["html"], rendered=row.get("rendered"))}


def _links(row: dict) -> list[dict]:
    doc, base = page.parse(row["html"]), row["url"] or ""
    hrefs = [(page.absolute(a.get("href"), base), page.sanitize(a.get("title") or a.text())) for a in doc.find(page.tag("a"))]
    return [{"page_id": row["page_id"], "url": row["url"], "position": k, "href": h, "label": t} for k, (h, t) in enumerate(hrefs) if h]


def _tags(row: dict) -> dict:
    doc = page.parse(row["html"])
    found = {}
    for m in doc.find(page.tag("meta")):
        name = m.get("property") or m.get("name")
        if name and m.get("content").strip():
            found.setdefault(name, page.normalize(m.get("content")))
    import json

    return {"page_id": row["page_id"], "tags": list(found.items()), "linked_data": [json.dumps(x, ensure_ascii=False) for x in page.json_ld(doc)]}


def page_meta(pages: DataFrame) -> DataFrame:
    """Work metadata and the ordered list of parts of every page. Null pages give an
    untitled work whose only part is the page."""
    return map_rows(pages.select("page_id", "url", "html"), _meta, META)


def page_links(pages: DataFrame) -> DataFrame:
    """All links of every page, absolute, in order."""
    return map_rows(pages.select("page_id", "url", "html"), _links, LINKS)


def kept_links(links: DataFrame) -> DataFrame:
    """``page_id``, ``href``, ``label``, ``position``: of all links those a listing keeps, filtered
    in the JVM: on the page's own site, like a part's, and no call to read or sign in."""
    href, label = F.col("href"), F.col("label")
    keep = (U.origin(href) == U.origin(F.col("url"))) & ~U.listing_blacklist(href) & U.chapter_like(href, label) & (F.length(label) >= 2) & ~call_to_action(label)
    return links.where(keep).groupBy("page_id", "href").agg(F.min_by("label", "position").alias("label"), F.min("position").alias("position"))


def page_tags(pages: DataFrame) -> DataFrame:
    """Meta tags and linked data of every page."""
    return map_rows(pages.select("page_id", "html"), _tags, "page_id bigint, tags map<string,string>, linked_data array<string>")


def page_chapters(pages: DataFrame) -> DataFrame:
    """Title, blocks, text and counts of every page as a part, with its state: done,
    or empty where nothing was found. A column ``rendered``, if there, holds the page as
    readers see it, for answers of a story service that have hardly any text."""
    rows = map_rows(pages.select("page_id", "url", "html", *[c for c in pages.columns if c == "rendered"]), _chapter, CHAPTER)
    blocks = B.drop_blank(F.col("blocks"))
    rows = rows.withColumn("blocks", blocks).withColumn("plain_text", B.plain_text(F.col("blocks")))
    images = B.image_count(F.col("blocks"))
    state = F.when((trimmed(F.col("plain_text")) != "") | (images > 0), "done").otherwise("empty")
    return rows.select("page_id", "url", "title", "blocks", "plain_text", word_count(F.col("plain_text")).alias("word_count"), F.length("plain_text").alias("char_count"), images.alias("image_count"), state.alias("status"))
