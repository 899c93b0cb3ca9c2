"""Queries on fetch runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.plans.registry import Registry, table
from foliomill.streaming import progress

query = Registry()


@query("SELECT book_id, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status IN ('failed', 'empty')) AS failed, count(*) AS total FROM chapters GROUP BY book_id")
def run_progress(spark, d):
    return progress.progress(table(spark, d, "chapters"))


@query("SELECT time_bucket(INTERVAL 30 DAY, fetched_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') AS start, count(*) AS parts FROM chapters WHERE fetched_at IS NOT NULL GROUP BY 1")
def parts_by_window(spark, d):
    return progress.windowed_progress(table(spark, d, "chapters").select("fetched_at"))


@query("SELECT date_trunc('day', fetched_at) AS day, count(*) AS parts, count(DISTINCT book_id) AS works FROM chapters WHERE fetched_at IS NOT NULL GROUP BY 1")
def parts_by_day(spark, d):
    rows = table(spark, d, "chapters").where("fetched_at IS NOT NULL").select(F.date_trunc("day", "fetched_at").alias("day"), "book_id")
    return rows.groupBy("day").agg(F.count("*").alias("parts"), F.countDistinct("book_id").alias("works"))
