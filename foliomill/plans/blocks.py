"""Queries on block arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import blocks as B
from foliomill.plans.registry import Registry, table

query = Registry()

_W = r"[ \t\n\v\f\r]"
_T = rf"regexp_replace(coalesce(b.text, ''), '^{_W}+|{_W}+$', '', 'g')"
_EXACT = "^(?:السابق|التالي|الفصل السابق|الفصل التالي|مشاركة|الإبلاغ|إبلاغ|تعليقات|رد|إعجاب|views?|likes?|comments?|share|report|next|previous|prev|next chapter|previous chapter|chapter list|فهرس الفصول|قائمة الفصول|<|>)$"
_LINE = rf"^(?:الفصل|الجزء|chapter|chapitre|part|episode){_W}*(?:السابق|التالي|previous|next|précédent|suivant)?{_W}*$"
_FLAT = lambda c: rf"regexp_replace(regexp_replace(coalesce({c}, ''), '^{_W}+|{_W}+$', '', 'g'), '{_W}+', ' ', 'g')"
ROWS = rf"""
rows AS (
  SELECT chapter_id, title, u.pos - 1 AS pos, u.b.type AS type, u.b.text AS text, u.b.src AS src, u.b.alt AS alt FROM chapters, unnest(blocks) WITH ORDINALITY AS u(b, pos)
),
judged AS (
  SELECT *, {_T.replace("b.text", "text")} AS t, type = 'p' AND {_T.replace("b.text", "text")} <> '' AND (regexp_matches({_T.replace("b.text", "text")}, '^\d{{1,5}}$') OR regexp_matches({_T.replace("b.text", "text")}, '(?i){_EXACT}')
    OR regexp_matches({_T.replace("b.text", "text")}, '(?i){_LINE}') OR regexp_matches({_T.replace("b.text", "text")}, '(?i)^(?:الفصل|chapter){_W}+\d+{_W}*$')
    OR ({_FLAT("title")} <> '' AND {_FLAT("text")} = {_FLAT("title")})) AS noise
  FROM rows
)"""
_CLEAN = f"""{ROWS},
clean AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, CASE WHEN type IN ('p', 'h') THEN t END, CASE WHEN type NOT IN ('p', 'h') THEN pos END ORDER BY pos) AS rn
    FROM judged WHERE NOT noise AND (type NOT IN ('p', 'h') OR t <> '')) WHERE rn = 1
)"""


@query(f"WITH {ROWS} SELECT chapter_id, CAST(pos AS INTEGER) AS pos FROM judged WHERE noise")
def noise_blocks(spark, d):
    rows = table(spark, d, "chapters").select("chapter_id", "title", F.posexplode("blocks").alias("pos", "b"))
    return rows.where(B.is_noise(F.col("b.type"), F.col("b.text"), F.col("title"))).select("chapter_id", "pos")


@query(f"WITH {_CLEAN} SELECT c.chapter_id, CAST(count(k.chapter_id) AS INTEGER) AS n, string_agg(k.t, chr(10) ORDER BY k.pos) FILTER (WHERE k.type IN ('p', 'h')) AS text FROM chapters c LEFT JOIN clean k ON c.chapter_id = k.chapter_id WHERE c.blocks IS NOT NULL GROUP BY c.chapter_id")
def clean_blocks(spark, d):
    rows = table(spark, d, "chapters").where("blocks IS NOT NULL").select("chapter_id", B.clean(F.col("blocks"), F.col("title")).alias("k"))
    texts = F.transform(F.filter("k", lambda b: b["type"].isin("p", "h")), lambda b: F.regexp_replace(b["text"], r"^\s+|\s+$", ""))
    return rows.select("chapter_id", F.size("k").alias("n"), F.when(F.size(texts) > 0, F.array_join(texts, "\n")).alias("text"))


@query(f"WITH {ROWS} SELECT chapter_id, CAST(count(*) AS BIGINT) AS n FROM judged WHERE type <> 'p' OR t <> '' GROUP BY chapter_id")
def drop_blank(spark, d):
    rows = table(spark, d, "chapters").select("chapter_id", F.explode(B.drop_blank(F.col("blocks"))).alias("b"))
    return rows.groupBy("chapter_id").agg(F.count("*").alias("n"))


@query(f"WITH {ROWS} SELECT chapter_id, CAST(pos AS INTEGER) AS pos, type FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, CASE WHEN type IN ('p', 'h') THEN t END, CASE WHEN type NOT IN ('p', 'h') THEN pos END ORDER BY pos) AS rn FROM judged) WHERE rn = 1")
def first_occurrence(spark, d):
    placed = F.transform("blocks", lambda b, i: F.struct(b["type"].alias("type"), b["text"].alias("text"), b["src"].alias("src"), i.cast("string").alias("alt")))
    rows = table(spark, d, "chapters").select("chapter_id", F.explode(B.first_of_text(placed)).alias("b"))
    return rows.select("chapter_id", F.col("b.alt").cast("int").alias("pos"), F.col("b.type").alias("type"))


def _joined(sep: str) -> str:
    return rf"""SELECT chapter_id, regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(blocks, lambda b: b.type IN ('p', 'h')), lambda b: coalesce(b.text, '')), {sep}), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_W}+|{_W}+$', '', 'g') AS text
    FROM chapters WHERE blocks IS NOT NULL"""


@query(_joined("chr(10)"))
def plain_text(spark, d):
    return table(spark, d, "chapters").where("blocks IS NOT NULL").select("chapter_id", B.plain_text(F.col("blocks")).alias("text"))


@query(_joined("chr(10) || chr(10)"))
def chapter_text(spark, d):
    return table(spark, d, "chapters").where("blocks IS NOT NULL").select("chapter_id", B.plain_text(F.col("blocks"), "\n\n").alias("text"))


@query("SELECT book_id, b.type AS type, count(*) AS n FROM chapters, unnest(blocks) AS u(b) GROUP BY book_id, b.type")
def block_histogram(spark, d):
    return table(spark, d, "chapters").select("book_id", F.explode("blocks").alias("b")).groupBy("book_id", F.col("b.type").alias("type")).agg(F.count("*").alias("n"))


@query("SELECT chapter_id, CAST(coalesce(len(list_filter(blocks, lambda b: b.type = 'img')), 0) AS INTEGER) AS images FROM chapters")
def image_count(spark, d):
    return table(spark, d, "chapters").select("chapter_id", B.image_count(F.col("blocks")).alias("images"))


@query(
    rf"""WITH lines AS (SELECT chapter_id, u.pos AS pos, 'p' AS type, u.t AS text FROM chapters, unnest(string_split(coalesce(plain_text, ''), chr(10))) WITH ORDINALITY AS u(t, pos) WHERE coalesce(len(blocks), 0) = 0
      UNION ALL SELECT chapter_id, u.pos, u.b.type, u.b.text FROM chapters, unnest(blocks) WITH ORDINALITY AS u(b, pos))
    SELECT chapter_id, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM lines WHERE type <> 'p' OR regexp_replace(coalesce(text, ''), '^{_W}+|{_W}+$', '', 'g') <> '' GROUP BY chapter_id"""
)
def reader_blocks(spark, d):
    rows = table(spark, d, "chapters").select("chapter_id", F.explode(B.reader_blocks(F.col("blocks"), F.col("plain_text"))).alias("b"))
    return rows.groupBy("chapter_id").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("b.text", F.lit("")))).alias("chars"))
