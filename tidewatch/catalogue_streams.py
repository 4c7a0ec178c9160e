"""Queries that run the streaming jobs over a whole table as a stream until it is read, with the SQL of the same in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import _VOLUME, registry
from .problems import SQL as PROBLEMS
from .session import shared_folder
from .streaming import jobs
from .tables import load

QUERIES, SQL, query = registry()
_RAW = "o AS (SELECT * FROM observations)"


def _stream(spark, d: str, *columns: str) -> DataFrame:
    """The table as a stream; zone-less times become instants as in ``load``."""
    stored = spark.read.parquet(f"{d}/observations.parquet").schema
    wanted = dict(load(spark, d, "observations").dtypes)
    rows = jobs.read_stream(spark, f"{d}/observations.parque[t]", stored)  # a pattern, as a file isn't a folder
    return rows.select(*[F.col(c).cast(wanted[c]).alias(c) for c in columns])


def _result(spark, frame: DataFrame) -> DataFrame:
    """What a stream's aggregate holds when everything is read."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out")
    jobs.start(frame, f"{folder}/checkpoint", mode="complete").foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{folder}/out")


@query(f"WITH {_RAW}, {_VOLUME} SELECT category, grid_cell, bucket_s, observed FROM h")
def stream_hourly(spark, d):
    """Tumbling hours per category and cell."""
    rows = _result(spark, jobs.hourly_volume(_stream(spark, d, "category", "grid_cell", "occurred_at", "severity").where("category is not null")))
    return rows.select("category", "grid_cell", F.unix_seconds("bucket").alias("bucket_s"), "observed")


@query("SELECT category, (epoch_us(occurred_at) // 3600000000 - k) * 3600 AS start_s, count(*) AS n FROM observations, range(0, 6) t(k) WHERE occurred_at IS NOT NULL GROUP BY 1, 2")
def stream_sliding(spark, d):
    """Windows of six hours, one every hour."""
    rows = _result(spark, jobs.sliding_volume(_stream(spark, d, "category", "occurred_at"), "6 hours", "1 hour"))
    return rows.select("category", F.unix_seconds("start").alias("start_s"), "n")


@query(
    """WITH g AS (SELECT category, grid_cell, epoch_us(occurred_at) AS us, CASE WHEN epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER w <= 21600000000 THEN 0 ELSE 1 END AS new FROM observations WHERE grid_cell IS NOT NULL WINDOW w AS (PARTITION BY category, grid_cell ORDER BY occurred_at)),
s AS (SELECT *, sum(new) OVER (PARTITION BY category, grid_cell ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT category, grid_cell, min(us) AS first_us, count(*) AS n FROM s GROUP BY category, grid_cell, k"""
)
def stream_sessions(spark, d):
    """Stretches of reports without a gap of six hours."""
    rows = _result(spark, jobs.sessions(_stream(spark, d, "category", "grid_cell", "occurred_at"), "6 hours"))
    return rows.select("category", "grid_cell", F.unix_micros("first_seen_at").alias("first_us"), "n")


@query(PROBLEMS["p2_hours"])
def stream_late_hours(spark, d):
    """Hours corrected by late rows, by the sink with stored states."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = _stream(spark, d, "source_id", "external_id", "occurred_at", "ingested_at", "category", "grid_cell")
    sink = jobs.corrected_hours_sink(spark, f"{folder}/log", f"{folder}/hours", parts=4)
    jobs.start(rows, f"{folder}/checkpoint").foreachBatch(sink).start().awaitTermination()
    return jobs.latest_hours(spark, f"{folder}/hours").select("category", "grid_cell", "period", "count", "n_periods", "running", "sum_sq")


@query("SELECT source_id, count(DISTINCT external_id) AS n FROM observations GROUP BY 1")
def stream_dedup(spark, d):
    """First deliveries within a watermark that spans the table."""
    once = jobs.deduplicated(_stream(spark, d, "source_id", "external_id", "occurred_at"), delay="60 days")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.start(once, f"{folder}/checkpoint").format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{folder}/out").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
