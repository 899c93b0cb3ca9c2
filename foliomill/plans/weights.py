"""Queries of the size report."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import weights
from foliomill.plans.registry import CURRENT, Registry, table

query = Registry()

TOTALS = f"""{CURRENT},
totals AS (
  SELECT book_id, CAST(coalesce(sum(word_count) FILTER (WHERE status = 'done'), 0) AS BIGINT) AS words, CAST(coalesce(sum(char_count) FILTER (WHERE status = 'done'), 0) AS BIGINT) AS chars,
         CAST(coalesce(sum(image_count) FILTER (WHERE status = 'done'), 0) AS BIGINT) AS images, count(*) AS chapters, count(*) FILTER (WHERE status = 'done') AS fetched,
         count(*) FILTER (WHERE status IN ('failed', 'empty')) AS failed
  FROM cur GROUP BY book_id
)"""
FORMATS = f"""{TOTALS},
base AS (
  SELECT t.book_id, images, coalesce(octet_length(cover), 0) AS c, round(chars * 1.7::DOUBLE) + fetched * 90 AS b, images * 143360 AS i FROM totals t JOIN books USING (book_id)
),
formats AS (
  SELECT book_id, 'txt' AS format, CAST(b AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS images, false AS estimated FROM base
  UNION ALL SELECT book_id, 'md', CAST(round(b * 1.08::DOUBLE) AS BIGINT), 0, false FROM base
  UNION ALL SELECT book_id, 'html', CAST(round(b * 1.3::DOUBLE) + 4096 AS BIGINT), 0, false FROM base
  UNION ALL SELECT book_id, 'json', CAST(round(b * 0.42::DOUBLE) AS BIGINT), 0, false FROM base
  UNION ALL SELECT book_id, 'fb2', CAST(round(b * 1.35::DOUBLE) + i AS BIGINT), images, true FROM base
  UNION ALL SELECT book_id, 'epub', CAST(round(b * 1.15::DOUBLE) + i + c + 26624 AS BIGINT), images + CASE WHEN c > 0 THEN 1 ELSE 0 END, true FROM base
  UNION ALL SELECT book_id, 'docx', CAST(round(b * 0.55::DOUBLE) + i + 22528 AS BIGINT), images, true FROM base
  UNION ALL SELECT book_id, 'pdf', CAST(round(b * 0.5::DOUBLE) + round(i * 0.75::DOUBLE) + 40960 AS BIGINT), images, true FROM base
)"""


@query(f"WITH {TOTALS} SELECT *, CAST(greatest(1, round(words / 180.0::DOUBLE)) AS BIGINT) AS reading_minutes FROM totals")
def weights_totals(spark, d):
    return weights.totals(table(spark, d, "chapters"))


@query(f"WITH {FORMATS} SELECT * FROM formats")
def weights_formats(spark, d):
    return weights.formats(table(spark, d, "books"), table(spark, d, "chapters"))


@query(f"WITH {FORMATS} SELECT book_id, max(bytes) AS estimated_bytes FROM formats GROUP BY book_id")
def estimated_bytes(spark, d):
    return weights_formats(spark, d).groupBy("book_id").agg(F.max("bytes").alias("estimated_bytes"))


@query(f"WITH {FORMATS} SELECT book_id, format, CAST(greatest(4, round(bytes / greatest(1, max(bytes) OVER (PARTITION BY book_id)) * 100)) AS INTEGER) AS percent FROM formats")
def format_bar(spark, d):
    return weights.bars(weights_formats(spark, d))


@query(
    f"""WITH {FORMATS} SELECT book_id, format, CASE WHEN bytes <= 0 THEN '0 B' WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024.0::DOUBLE)
    ELSE printf('%.2f MB', bytes / 1048576.0::DOUBLE) END AS size FROM formats"""
)
def format_bytes(spark, d):
    return weights_formats(spark, d).select("book_id", "format", T.format_bytes(F.col("bytes")).alias("size"))


@query(f"WITH {TOTALS} SELECT c.book_id, idx, coalesce(char_count, 0) AS chars, CAST(round(coalesce(char_count, 0) / greatest(1, t.chars) * 100) AS INTEGER) AS share FROM cur c JOIN totals t USING (book_id)")
def weights_chapters(spark, d):
    return weights.shares(table(spark, d, "chapters"))


@query(
    f"""WITH {CURRENT}, done AS (SELECT book_id, idx, coalesce(char_count, 0) AS s FROM cur WHERE status = 'done')
    SELECT book_id, arg_min(idx, struct_pack(a := -s, b := idx)) AS heaviest, max(s) AS most, arg_min(idx, struct_pack(a := s, b := -idx)) AS lightest, min(s) AS least FROM done GROUP BY book_id"""
)
def heaviest_lightest(spark, d):
    return weights.extremes(table(spark, d, "chapters"))


@query(f"WITH {FORMATS} SELECT book_id, format, bytes, CASE format WHEN 'epub' THEN 'application/epub+zip' WHEN 'pdf' THEN 'application/pdf' ELSE 'other' END AS kind FROM formats")
def format_kinds(spark, d):
    mime = T.lookup(T.FORMAT_TYPES, F.col("format"), "")
    kind = F.when(F.col("format").isin("epub", "pdf"), mime).otherwise("other")
    return weights_formats(spark, d).select("book_id", "format", "bytes", kind.alias("kind"))
