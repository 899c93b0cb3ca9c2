"""The store on small tables: nulls, ties, repeated rows, empty tables, extra columns."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import block
from foliomill.functions import blocks as B
from foliomill.functions import text as T
from foliomill.functions import url as U
from foliomill.functions.htmltree import normalize
from foliomill.operators import export, ranking, store, weights

DAY = dt.datetime(2024, 1, 1)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_current_takes_last_delivery(make_chapters):
    df = make_chapters([dict(chapter_id=1, fetched_at=DAY), dict(chapter_id=2, fetched_at=None), dict(chapter_id=3, fetched_at=DAY), dict(chapter_id=4, idx=None), dict(chapter_id=5, idx=None, fetched_at=DAY)], ", extra string")
    assert rows(store.current(df.withColumn("_row", F.lit(1))), "chapter_id") == [(3,), (5,)]
    assert rows(store.current(df.where("false")), "chapter_id") == []


def test_counts_and_status(make_chapters, make_books):
    df = make_chapters([dict(chapter_id=k, idx=k, status=s) for k, s in enumerate(["done", "failed", "empty", None, "pending"])] + [dict(chapter_id=9, book_id=2, idx=1, status="failed")])
    counts = store.status_counts(df)
    assert rows(counts, "book_id", "total", "done", "failed", "empty", "pending") == [(1, 5, 1, 1, 1, 1), (2, 1, 0, 1, 0, 0)]
    assert rows(store.book_status(counts), "book_id", "status", "percent") == [(1, "importing", 20), (2, "failed", 0)]
    assert rows(store.library(make_books([dict(book_id=3)]), df), "book_id", "total") == [(3, 0)]


def test_listing_changes(spark, make_chapters):
    refs = spark.createDataFrame([(1, 1, "new", "u"), (1, 2, "t", "u2"), (1, 3, None, "u")], "book_id bigint, idx int, title string, url string")
    have = make_chapters([dict(idx=1), dict(chapter_id=2, idx=3, title=None)])
    assert rows(store.absent(refs, have), "idx") == [(2,)]
    assert rows(store.changed(refs, have), "idx", "is_new") == [(1, False), (2, True)]
    assert rows(store.updated(have, refs), "idx", "title", "status") == [(1, "new", "done"), (2, "t", "pending"), (3, None, "done")]
    assert rows(store.listed_parts(refs, have), "idx", "title", "status") == [(1, "t", "done"), (2, "t", "pending"), (3, None, "done")]


def test_upsert_keeps_cover_and_numbers_new(spark, make_books):
    books = make_books([dict(book_id=7, source_url="a", cover_url="old"), dict(book_id=8, source_url="b", cover_url="keep")])
    new = spark.createDataFrame([("a", "N", "", "", ""), ("c", "C", "", "", "x"), ("d", "D", "", "", "x")], "source_url string, title string, author string, description string, cover_url string")
    got = {r["source_url"]: r for r in store.upserted(books, new).collect()}
    assert got["a"]["cover_url"] == "old" and got["a"]["title"] == "N" and got["b"]["title"] == "T"
    assert sorted((got["c"]["book_id"], got["d"]["book_id"])) == [9, 10]


def test_reset_and_cascade_and_lookup(make_chapters, make_books):
    df = make_chapters([dict(status="failed", word_count=3, error="x"), dict(chapter_id=2, idx=2, book_id=2)])
    assert rows(store.reset_failed(df), "chapter_id", "status", "word_count", "error") == [(1, "pending", 0, ""), (2, "done", 0, None)]
    books = make_books([dict(), dict(book_id=2)])
    left = store.without_books(books, df, books.where("book_id = 1"))
    assert rows(left[0], "book_id") == [(2,)] and rows(left[1], "chapter_id") == [(2,)]
    assert rows(store.lookup(df, 2, 2), "chapter_id") == [(2,)]


def test_blocks(spark, make_chapters):
    bs = [block("p", "a"), block("p", " a "), block("h", "a"), block("img", None, "s"), block("img", None, "s"), block("p", " "), block("p", "12"), block("p", "Chapter 3"), block("p", "My title"), block("h", "b")]
    df = make_chapters([dict(blocks=bs, title="My  title"), dict(chapter_id=2), dict(chapter_id=3, blocks=[], plain_text="x\n\ny")])
    got = {r["chapter_id"]: r for r in df.select("chapter_id", B.clean(F.col("blocks"), F.col("title")).alias("c"), B.plain_text(F.col("blocks")).alias("p"), B.image_count(F.col("blocks")).alias("i"), B.reader_blocks(F.col("blocks"), F.col("plain_text")).alias("r")).collect()}
    assert [(b["type"], b["text"]) for b in got[1]["c"]] == [("p", "a"), ("img", None), ("img", None), ("h", "b")]
    assert (got[1]["i"], got[2]["i"], got[2]["c"], got[3]["p"]) == (2, 0, None, "")
    assert [b["text"] for b in got[3]["r"]] == ["x", "y"] and got[2]["r"] == []


def test_weights_of_empty_and_null(make_chapters, make_books):
    df = make_chapters([dict(word_count=None, char_count=None, image_count=None)])
    assert rows(weights.totals(df), "words", "chars", "images", "reading_minutes") == [(0, 0, 0, 1)]
    assert rows(weights.shares(df), "share") == [(0,)]
    sizes = {r["format"]: r["bytes"] for r in weights.formats(make_books([dict(cover=b"12345")]), df).collect()}
    assert (sizes["txt"], sizes["epub"], sizes["pdf"]) == (90, round(90 * 1.15) + 5 + 26624, 45 + 40960)
    ties = make_chapters([dict(chapter_id=k, idx=k, char_count=5) for k in (1, 2, 3)])
    assert rows(weights.extremes(ties), "heaviest", "lightest") == [(1, 3)]
    assert weights.totals(df.where("false")).count() == 0


def test_ranking(spark):
    df = spark.createDataFrame([(1, 900 * k, 10) for k in range(5)] + [(2, 0, 99), (None, 7, 1), (None, None, 1), (3, 1, None)], "g int, k int, s int")
    coarse = ranking.ranges(F.col("k"))
    got = rows(ranking.within_budget(df, "g", [F.col("k")], coarse, "s", 35, 9), "g", "k", "running", "n")
    assert sorted(x for x in got if x[0] == 1) == [(1, 0, 10, 1), (1, 900, 20, 2), (1, 1800, 30, 3)] and (3, 1, 0, 1) in got and not any(x[0] == 2 for x in got)
    numbered = rows(ranking.dense_index(df, "g", [F.col("k").asc_nulls_last()], coarse), "g", "k", "n")
    assert sorted(x[1:] for x in numbered if x[0] == 1) == [(900 * k, k + 1) for k in range(5)]
    assert (None, 7, 1) in numbered and (None, None, 2) in numbered


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).head()["x"]
    assert pick(T.safe_filename(F.lit('a/b:"c"'), F.lit(3), "txt")) == "a b c - 3.txt"
    assert pick(T.safe_filename(F.lit(None).cast("string"), F.lit(3), "txt")) == "book-3 - 3.txt"
    assert [pick(T.format_bytes(F.lit(v))) for v in (0, 512, 1536, 3 * 1048576)] == ["0 B", "512 B", "1.5 KB", "3.00 MB"]
    assert pick(T.scrub_copy_guards(F.lit("aaaaaab nbsp c"))) == "ab c"
    assert pick(T.chapter_ordinal(F.lit("الفصل 12"), F.lit(""))) == 12 and pick(T.chapter_ordinal(F.lit("x"), F.lit("?id=7"))) == 7
    got = [tuple(pick(U.normalize_url(F.lit(v)))) for v in ("", "a.be/c", "x", "https://novlar.com/views/...id=55", "abc…")]
    assert got == [(None, "empty"), ("https://a.be/c", None), (None, "invalid"), ("https://www.novlar.com/views/novel/details.php?id=55", None), (None, "truncated")]
    assert [pick(U.private_address(F.lit(v))) for v in ("http://127.0.0.1/x", "https://a.example", "ftp://a.b", "http://172.20.1.1")] == [True, False, True, True]
    assert pick(U.generic_number(F.lit("https://a.b/x/12/y?chap=3"), F.lit(""))) == 3
    assert pick(T.strip_suffixes(F.lit("Work - Site"), ["site"])) == "Work"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="a \t\n​b", max_size=30))
def test_normalize_is_stable(text):
    once = normalize(text)
    assert normalize(once) == once and "​" not in once


def test_exports_in_volumes(spark, make_books, make_chapters, monkeypatch):
    monkeypatch.setattr(export, "VOLUME_PARTS", 2)
    df = make_chapters([dict(chapter_id=k, idx=k, title=f"t{k}", plain_text="x", blocks=[block("p", f"text {k}")]) for k in (1, 2, 3)])
    got = {r["volume"]: r["content"] for r in export.txt(make_books([dict()]), df).collect()}
    assert "text 1" in got[0] and "text 2" in got[0] and "text 3" in got[1] and "text 1" not in got[1]


def test_whole_current_rows_are_the_current_rows(make_chapters):
    import datetime as dt
    import random

    rng = random.Random(4)
    times = [None, *[dt.datetime(2024, 1, d) for d in (1, 2, 3)]]
    rows = [dict(chapter_id=rng.choice([None, *range(40)]), book_id=rng.choice([None, 1, 2]), idx=rng.choice([None, 1, 2, 3]), fetched_at=rng.choice(times), plain_text="x") for _ in range(120)]
    rows += rows[:30] + [dict(chapter_id=900 + k, book_id=9, idx=k, plain_text="y") for k in range(5)]
    df = make_chapters(rows, ", _best string, _at string")
    from foliomill.operators import store

    names = ["chapter_id", "book_id", "idx", "fetched_at", "plain_text"]
    want = sorted(map(repr, store.current(df.select(*names)).collect()))
    assert sorted(map(repr, store.current_whole(df.select(*names)).collect())) == want and store.current_whole(df.select(*names).where("false")).count() == 0


def test_rows_without_number_are_split(spark):
    from foliomill.operators import ranking

    rows = [(1, None, k) for k in range(3000)] + [(1, k, k) for k in range(50)]
    df = spark.createDataFrame(rows, "g int, number int, idx int")
    coarse = ranking.ranges(F.col("number"), F.col("idx"))
    assert df.select(coarse).distinct().count() == 4
    got = ranking.dense_index(df, "g", [F.col("number").asc_nulls_last(), F.col("idx")], coarse).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 3051)) and [r["number"] for r in got[:50]] == list(range(50)) and [r["idx"] for r in got[50:]] == list(range(3000))


def test_budget_ends_where_it_is_passed(spark):
    from foliomill.operators import ranking

    df = spark.createDataFrame([(1, k, 150 if k != 2 else None) for k in range(6)] + [(2, 0, 500)], "g int, idx int, size int")
    got = ranking.within_budget(df, "g", [F.col("idx")], ranking.ranges(F.col("idx")), "size", 400, 400).collect()
    assert sorted((r["g"], r["idx"], r["running"], r["n"]) for r in got) == [(1, 0, 150, 1), (1, 1, 300, 2), (1, 2, 300, 3)]


def test_saved_parts_and_index(make_chapters):
    old = make_chapters([dict(chapter_id=k, idx=k, plain_text="old", status="pending") for k in (1, 2)])
    new = make_chapters([dict(chapter_id=9, idx=2, plain_text="x" * 300, word_count=1, fetched_at=dt.datetime(2024, 1, 2)), dict(chapter_id=8, idx=2, plain_text="older"), dict(chapter_id=7, idx=3, plain_text=None, error="gone")])
    parts, index = store.saved_parts(old, new)
    assert {(r["idx"], r["chapter_id"]) for r in parts.collect()} == {(1, 1), (2, 9), (3, 7)}
    assert {r["idx"]: (len(r["preview"]), r["error"]) for r in index.collect()} == {1: (3, ""), 2: (200, ""), 3: (0, "gone")}
    assert store.saved_parts(old, new.where("false"))[0].count() == 2 and store.saved_parts(old.where("false"), new)[0].count() == 2


def test_replaced_covers(make_books, spark):
    books = make_books([dict(book_id=1, cover=b"a", cover_mime="image/png"), dict(book_id=2), dict(book_id=3, cover=b"c", cover_mime="image/gif"), dict(book_id=4)])
    covers = spark.createDataFrame([(1, b"z", "image/webp"), (2, b"y", "application/x"), (2, b"y", "application/x"), (3, b"", "image/png"), (77, b"q", "image/png"), (4, None, None)], "book_id bigint, cover binary, cover_mime string")
    got = {r["book_id"]: (r["cover"], r["cover_file"]) for r in store.replaced_covers(books, covers).collect()}
    assert {k: (v and bytes(v), f) for k, (v, f) in got.items()} == {1: (b"z", "cover.webp"), 2: (b"y", "cover.img"), 3: (b"c", "cover.gif"), 4: (None, None)}
