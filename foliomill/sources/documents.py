"""Reading and writing of stored documents: JSON files, binaries, text of any charset."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliomill.functions.loose import embedded_object, loose_json

#: Larger files aren't read as pictures.
MOST_BYTES = 12 * 1024 * 1024
#: The characters of a page in which its charset is looked for.
HEAD_CHARS = 4096
FALLBACK = "windows-1256"
_HEADER = re.compile(r"charset=([\w-]+)", re.I)
_IN_PAGE = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?([\w-]+)|<\?xml[^>]+encoding=[\"']([\w-]+)", re.I)


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file; unreadable and broken files are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_pictures(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """``src``, ``bytes``, ``size`` of the files of a folder that aren't too large; the
    size is filtered before contents are read."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= most).select(F.col("path").alias("src"), F.col("content").alias("bytes"), F.col("length").alias("size"))


def decode_page(data: bytes | None, content_type: str | None = None) -> str | None:
    """Text of a page: by the charset its header or its first characters name, else
    UTF-8, and windows-1256 where that leaves broken characters. Null stays null."""
    if data is None:
        return None
    head = _HEADER.search(content_type or "")
    page = _IN_PAGE.search(data[:HEAD_CHARS])
    name = head.group(1) if head else (page.group(1) or page.group(2)).decode("ascii", "replace") if page else ""
    try:
        text = data.decode(name or "utf-8", "replace")
    except LookupError:
        text, name = data.decode("utf-8", "replace"), ""
    return data.decode(FALLBACK, "replace") if "\ufffd" in text and not name else text


@F.pandas_udf(StringType())
def decoded(data: pd.Series, content_type: pd.Series) -> pd.Series:
    """``decode_page`` over columns."""
    return pd.Series([decode_page(d, c) for d, c in zip(data, content_type)], dtype=object)


@F.pandas_udf(StringType())
def _from_dump(text: pd.Series) -> pd.Series:
    out = [loose_json(t) for t in text]
    return pd.Series([None if v is None else json.dumps(v, ensure_ascii=False) for v in out], dtype=object)


def loose(text: Column) -> Column:
    """Almost-JSON text as JSON text; null for anything else. Valid JSON stays in the
    JVM, only the rest goes to Python."""
    good = F.try_parse_json(text).isNotNull()
    return F.when(good, text).otherwise(_from_dump(F.when(~good, text)))


@F.pandas_udf(StringType())
def embedded(html: pd.Series) -> pd.Series:
    """The object with a list of parts that a page embeds, as JSON; null if none."""
    found = [embedded_object(h) for h in html]
    return pd.Series([None if v is None else json.dumps(v, ensure_ascii=False) for v in found], dtype=object)


def story_parts(stories: DataFrame, column: str) -> DataFrame:
    """The fields and ordered parts of embedded objects, opened in the JVM."""
    schema = "struct<title:string,description:string,cover:string,user:struct<name:string>,language:struct<name:string>,parts:array<struct<id:bigint,title:string,url:string>>>"
    s = F.from_json(F.col(column), schema)
    rows = stories.withColumn("_s", s).where("_s.parts IS NOT NULL")
    return rows.select(*[c for c in stories.columns if c != column], F.col("_s.title").alias("work"), F.col("_s.user.name").alias("author"), F.posexplode("_s.parts").alias("pos", "part")).select(
        *[c for c in stories.columns if c != column], "work", "author", (F.col("pos") + 1).alias("idx"), F.col("part.title").alias("title"), F.col("part.url").alias("url")
    )


def write_swapped(df: DataFrame, path: str, *partitions: str) -> None:
    """Write a Parquet table so that readers see the old or the new one: into a staging
    folder first, then by renames through the cluster's file system."""
    spark = df.sparkSession
    staging, old = f"{path}.staging", f"{path}.old"
    out = df.write.mode("overwrite")
    (out.partitionBy(*partitions) if partitions else out).parquet(staging)
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    before = jvm.org.apache.hadoop.fs.Path(old)
    fs.delete(before, True)
    if fs.exists(to) and not fs.rename(to, before):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), to):
        fs.rename(before, to)
        raise OSError(f"cannot move {staging} to {path}")
    fs.delete(before, True)
