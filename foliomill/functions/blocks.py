"""Functions on ordered block arrays, ``array<struct<type, text, src, alt>>``.

The order of an array is the order of the document and is kept. Null arrays give
null unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.functions.text import trimmed

BLOCK = "struct<type:string,text:string,src:string,alt:string>"
#: Paragraphs that are only a site's navigation.
NOISE_LINE = r"(?iu)^(?:الفصل|الجزء|chapter|chapitre|part|episode)\s*(?:السابق|التالي|previous|next|précédent|suivant)?\s*$"
NOISE_EXACT = (
    r"(?iu)^(?:السابق|التالي|الفصل السابق|الفصل التالي|مشاركة|الإبلاغ|إبلاغ|تعليقات|رد|إعجاب|views?|likes?|comments?|share|report"
    r"|next|previous|prev|next chapter|previous chapter|chapter list|فهرس الفصول|قائمة الفصول|<|>)$"
)


def drop_blank(blocks: Column) -> Column:
    """Without paragraphs that have no text."""
    return F.filter(blocks, lambda b: (b["type"] != "p") | (trimmed(F.coalesce(b["text"], F.lit(""))) != ""))


def _flat(text: Column) -> Column:
    return F.regexp_replace(trimmed(F.coalesce(text, F.lit(""))), r"\s+", " ")


def _noise(kind: Column, t: Column, head: Column) -> Column:
    """Noise by a block's kind, its trimmed text and the flattened title. Cheap tests that
    any noise must pass come first, so long paragraphs meet no pattern."""
    short = (F.length(t) <= 64) | t.rlike(r"\s{9}|\d{9}")
    said = t.rlike(r"^\d{1,5}$") | t.rlike(NOISE_EXACT) | t.rlike(NOISE_LINE) | t.rlike(r"(?iu)^(?:الفصل|chapter)\s+\d+\s*$")
    title = (head != "") & (F.length(t) >= F.length(head)) & (F.left(t, F.lit(1)) == F.left(head, F.lit(1))) & (F.regexp_replace(t, r"\s+", " ") == head)
    return (kind == "p") & (t != "") & ((short & said) | title)


def is_noise(kind: Column, text: Column, title: Column) -> Column:
    """Whether a paragraph is a counter, a navigation word or the title again."""
    return _noise(kind, trimmed(F.coalesce(text, F.lit(""))), _flat(title))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` has it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _key(b: Column) -> Column:
    return F.when(b["type"].isin("p", "h"), trimmed(F.coalesce(b["text"], F.lit(""))))


def _first_of_key(items: Column, key: Callable[[Column], Column]) -> Column:
    """The items whose key none before them has, in order; those without a key all stay.

    Equal keys are brought together by sorting, so that the time grows little faster
    than the number of items."""
    placed = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
    new = lambda ps: F.filter(ps, lambda p, j: p["k"].isNull() | (j == 0) | ~p["k"].eqNullSafe(F.get(ps, j - 1)["k"]))
    kept = F.sort_array(F.transform(bound(placed, new), lambda p: p["i"]))
    return F.transform(kept, lambda i: F.get(items, i))


def first_of_text(blocks: Column) -> Column:
    """The first block of each text, images all kept; paragraphs and headings share
    one set of texts."""
    return bound(blocks, lambda bs: _first_of_key(bs, _key))


def clean(blocks: Column, title: Column) -> Column:
    """Without noise and blank texts, each text once."""
    is_text = lambda x: x["b"]["type"].isin("p", "h")
    pairs = F.transform(blocks, lambda b: F.struct(b.alias("b"), trimmed(F.coalesce(b["text"], F.lit(""))).alias("t")))
    kept = lambda head: F.filter(pairs, lambda x: (~is_text(x) | (x["t"] != "")) & ~_noise(x["b"]["type"], x["t"], head))
    first = lambda items: F.transform(_first_of_key(items, lambda x: F.when(is_text(x), x["t"])), lambda x: x["b"])
    return bound(bound(_flat(title), kept), first)


def plain_text(blocks: Column, separator: str = "\n") -> Column:
    """Texts of paragraphs and headings, one after the other; images are skipped."""
    texts = F.transform(F.filter(blocks, lambda b: b["type"].isin("p", "h")), lambda b: F.coalesce(b["text"], F.lit("")))
    return trimmed(F.regexp_replace(F.array_join(texts, separator), r"\n{3,}", "\n\n"))


def image_count(blocks: Column) -> Column:
    """Number of images; 0 for null."""
    return F.coalesce(F.size(F.filter(blocks, lambda b: b["type"] == "img")), F.lit(0))


def has_image(blocks: Column) -> Column:
    return F.coalesce(F.exists(blocks, lambda b: b["type"] == "img"), F.lit(False))


def reader_blocks(blocks: Column, text: Column) -> Column:
    """The blocks; where there are none, a paragraph for each line of the text.
    Blank paragraphs are left out."""
    none = F.lit(None).cast("string")
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda t: F.struct(F.lit("p").alias("type"), t.alias("text"), none.alias("src"), none.alias("alt")))
    return drop_blank(F.when(F.coalesce(F.size(blocks), F.lit(0)) > 0, blocks.cast(f"array<{BLOCK}>")).otherwise(lines))
