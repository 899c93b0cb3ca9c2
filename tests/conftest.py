import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


CHAPTERS = (
    "chapter_id bigint, book_id bigint, host string, idx int, title string, source_url string, status string,"
    " blocks array<struct<type:string,text:string,src:string,alt:string>>, plain_text string, word_count int, char_count int,"
    " image_count int, error string, fetched_at timestamp"
)
BOOKS = (
    "book_id bigint, source_url string, host string, adapter string, title string, author string, description string,"
    " language_code string, cover_url string, cover_mime string, cover binary, created_at timestamp"
)


def block(kind, text=None, src=None, alt=None):
    return {"type": kind, "text": text, "src": src, "alt": alt}


@pytest.fixture
def make_chapters(spark):
    def make(rows, extra=""):
        base = dict(chapter_id=1, book_id=1, host="h", idx=1, title="t", source_url="u", status="done", blocks=None, plain_text=None, word_count=0, char_count=0, image_count=0, error=None, fetched_at=None)
        return spark.createDataFrame([base | r for r in rows], CHAPTERS + extra)

    return make


@pytest.fixture
def make_books(spark):
    def make(rows):
        base = dict(book_id=1, source_url="https://a.example/1", host="h", adapter="generic", title="T", author="A", description="D", language_code="en", cover_url="", cover_mime="", cover=None, created_at=None)
        return spark.createDataFrame([base | r for r in rows], BOOKS)

    return make
