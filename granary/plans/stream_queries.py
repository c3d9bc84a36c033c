"""Incremental forms over ``documents`` and ``events``, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.plans.registry import query, table
from granary.store import fresh_path
from granary.streaming import ingest


def stream(spark, d, name):
    """The table as a stream of the files that its folder holds."""
    path = fresh_path(spark, f"arriving-{name}")
    table(spark, d, name).write.parquet(path)
    return ingest.arriving(spark, path, table(spark, d, name).schema, 4), fresh_path(spark, "stream-state")


@query("str_new_chunks", "SELECT DISTINCT sha256(text) AS hash FROM documents")
def _(spark, d):
    """All rows bear one time here, so the state keeps them to the end."""
    rows, state = stream(spark, d, "documents")
    chunks = rows.select(F.sha2("text", 256).alias("hash"), F.timestamp_seconds(F.lit(946_684_800)).alias("ts"))
    return ingest.drain(ingest.new_chunks(chunks, "ts"), fresh_path(spark, "new-chunks"), state).select("hash")


@query("str_window", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    rows, state = stream(spark, d, "events")
    hours = rows.withColumn("start", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"))
    return ingest.totals(hours, ["start", "event_type"], fresh_path(spark, "windows"), state)
