"""Structured Streaming forms of the pipeline: deduplication, windows, late corrections, state and upserts."""

from __future__ import annotations

import signal
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.late_events import STATE, Lateness, first_deliveries, period_counts, replay

KEYS = ["category", "grid_cell"]


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number of them in each micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def deduplicated(stream: DataFrame, event_time: str = "occurred_at", delay: str = "48 hours") -> DataFrame:
    """First delivery of every (source_id, external_id) within the watermark's delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["source_id", "external_id"])


def hourly_volume(stream: DataFrame, delay: str | None = "1 hour") -> DataFrame:
    """Completed hours per category and cell; in append mode an hour comes out once the watermark passed it.

    No ``delay`` for a stream that has its watermark already.
    """
    marked = stream.where("grid_cell is not null")
    marked = marked.withWatermark("occurred_at", delay) if delay else marked
    grouped = marked.groupBy(F.window("occurred_at", "1 hour"), *KEYS).agg(F.count(F.lit(1)).alias("observed"), F.max("severity").alias("max_severity"))
    return grouped.select(*KEYS, F.col("window.start").alias("bucket"), "observed", "max_severity")


def sliding_volume(stream: DataFrame, length: str, slide: str, delay: str = "1 hour") -> DataFrame:
    """Counts over sliding windows."""
    grouped = stream.withWatermark("occurred_at", delay).groupBy(F.window("occurred_at", length, slide), "category").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("category", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(stream: DataFrame, gap: str = "72 hours", delay: str = "1 hour") -> DataFrame:
    """Stretches of reports per category and cell without a gap longer than ``gap``."""
    grouped = stream.where("grid_cell is not null").withWatermark("occurred_at", delay).groupBy(F.session_window("occurred_at", gap), *KEYS).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*KEYS, F.col("session_window.start").alias("first_seen_at"), F.col("session_window.end").alias("until"), "n")


def running_baselines(volume: DataFrame, min_samples: int = 12, min_z: float = 3.0, min_observed: int = 4) -> DataFrame:
    """Welford state per category and cell, kept by the stream; emits every hour's z and whether it is unusual.

    Hours of a key must arrive in order, as ``hourly_volume`` gives them in append mode; an hour not
    later than the last folded one is left out, so a replay changes nothing.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, last = state.get if state.exists else (0, 0.0, 0.0, -1)
        rows = pd.concat(list(frames)).sort_values("bucket_s")
        out = []
        for bucket, observed in zip(rows["bucket_s"].tolist(), rows["observed"].tolist()):
            if bucket <= last:
                continue
            sd = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
            z = (observed - mean) / sd if sd > 0 else 0.0
            unusual = n >= min_samples and z >= min_z and observed >= min_observed
            n, last, delta = n + 1, bucket, observed - mean
            mean += delta / n
            m2 += delta * (observed - mean)
            out.append((*key, bucket, observed, z, mean, bool(unusual)))
        state.update((n, mean, m2, last))
        yield pd.DataFrame(out, columns=[*KEYS, "bucket_s", "observed", "z", "expected", "unusual"])

    rows = volume.select(*KEYS, F.unix_seconds("bucket").alias("bucket_s"), "observed")
    schema = "category string, grid_cell string, bucket_s bigint, observed bigint, z double, expected double, unusual boolean"
    return rows.groupBy(*KEYS).applyInPandasWithState(fold, schema, "n bigint, mean double, m2 double, last bigint", "append", GroupStateTimeout.NoTimeout)


#: Folders by key hash that the log and the states are cut into; a batch reads whole folders, so more of them for more keys.
PARTS = 64


def corrected_hours_sink(spark: SparkSession, log: str, target: str, lateness: Lateness = Lateness(), state: str | None = None, parts: int = PARTS):
    """foreachBatch function: appends a batch to the log and replaces the corrected hours from each key's earliest touched block on.

    Log and states are cut by key hash and by block (``lateness.checkpoint_periods`` periods); at the end of every block the state of a
    key is stored. A batch reads the log of its own key hashes from its earliest block on, restores each key's last state before
    that, replays the sorted suffix and writes hours and states under the batch's id, so a batch that is run again overwrites itself. Deliveries
    of one record are taken to lie in one block. Rows with a null key or event time count nowhere.
    """
    state = state or f"{target}_state"
    step = lateness.period_us * lateness.checkpoint_periods
    saved = ", ".join(["category string, grid_cell string", *(f"{c} bigint" for c in STATE), "version bigint, part bigint, block bigint"])

    def run(batch: DataFrame, batch_id: int) -> None:
        placed = batch.dropna(subset=[*KEYS, "occurred_at"]).withColumns({"part": F.pmod(F.xxhash64(*KEYS), F.lit(parts)), "block": F.floor(F.unix_micros("occurred_at") / step)})
        placed.repartition("part", "block").write.mode("overwrite").partitionBy("part", "block").parquet(f"{log}/batch={batch_id}")
        placed = spark.read.schema(placed.schema).option("basePath", f"{log}/batch={batch_id}").parquet(f"{log}/batch={batch_id}")
        touched = placed.groupBy("part", *KEYS).agg(F.min("block").alias("from_block"))
        # One row a key hash, ``parts`` at most; they prune the folders that are read.
        firsts = {r["part"]: r["b"] for r in touched.groupBy("part").agg(F.min("from_block").alias("b")).collect()}
        if not firsts:
            return
        everything = spark.read.option("basePath", log).schema(T.StructType([*placed.schema.fields, T.StructField("batch", T.LongType())])).parquet(log)
        near = everything.where(F.col("part").isin(list(firsts)) & (F.col("block") >= min(firsts.values())))
        suffix = near.join(touched, ["part", *KEYS]).where("block >= from_block").drop("batch", "part", "block", "from_block")
        once = first_deliveries(suffix, ["source_id", "external_id"], "ingested_at")
        counts = period_counts(once, KEYS, "occurred_at", "ingested_at", lateness).withColumn("accepted", F.col("on_time") + F.col("late")).where("accepted > 0")
        older = spark.read.schema(saved).parquet(state) if batch_id and _exists(spark, state) else spark.createDataFrame([], saved)
        before = older.where(F.col("part").isin(list(firsts)) & (F.col("block") < max(firsts.values())) & (F.col("version") < batch_id)).join(touched, ["part", *KEYS]).where("block < from_block")
        # Of a block the state of the last batch that wrote it counts, of a key that of its last block.
        restored = before.groupBy(*KEYS).agg(F.max_by(F.struct(*STATE), F.struct("block", "version")).alias("r")).select(*KEYS, *[F.col(f"r.{c}").alias(f"r_{c}") for c in STATE])
        hours = replay(counts.join(restored, KEYS, "left"), KEYS, "accepted", [f"r_{c}" for c in STATE])
        hours = hours.withColumns({"part": F.pmod(F.xxhash64(*KEYS), F.lit(parts)), "block": F.floor(F.col("period") / step)})
        hours.drop("block").repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{target}/version={batch_id}")
        ends = hours.groupBy("part", "block", *KEYS).agg(F.max_by(F.struct(*STATE), "period").alias("s")).select(*KEYS, *[f"s.{c}" for c in STATE], "part", "block")
        ends.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{state}/version={batch_id}")

    return run


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def latest_hours(spark: SparkSession, target: str) -> DataFrame:
    """Corrected hours: every hour as the last batch that replayed it wrote it."""
    rows = spark.read.parquet(target).drop("part")
    values = [c for c in rows.columns if c not in (*KEYS, "period", "version")]
    return rows.groupBy(*KEYS, "period").agg(F.max_by(F.struct(*values), "version").alias("r")).select(*KEYS, "period", "r.*")


def start(df: DataFrame, checkpoint: str, once: bool = True, every: str = "30 seconds", mode: str = "append") -> DataStreamWriter:
    """A writer with its checkpoint and trigger: everything that is there, once, or every so often."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)


def assignment_sink(spark: SparkSession, state: str, target: str, max_gap_hours: float = 72.0):
    """foreachBatch function: assigns a batch of observations to the live events of the state table.

    The order of arrival decides and both sides share no key, so a batch is one sequence; batches are bounded by
    the reader (``files_per_trigger``) and the state by the events of the last ``max_gap_hours``. Links are written a folder
    a batch id, and the state a new folder a batch, so a batch that is run again gives the same.
    """
    from ..operators.events import OnlineClusters

    columns = ["id", "embedding", "category", "lat", "lon", "geo_precision", "country_code", "occurred_at"]
    saved = "id string, category string, lat double, lon double, geo_precision string, country_code string, total array<double>, n bigint, last timestamp"

    def run(batch: DataFrame, batch_id: int) -> None:
        live = spark.read.schema(saved).parquet(f"{state}/{batch_id - 1}") if batch_id else spark.createDataFrame([], saved)
        marked = live.select(F.lit(True).alias("old"), F.struct(*live.columns).alias("event"), F.lit(None).cast(batch.select(*columns).schema).alias("row"))
        fresh = batch.where("id is not null and occurred_at is not null").select(*columns).dropDuplicates(["id"])
        both = marked.unionByName(fresh.select(F.lit(False).alias("old"), F.lit(None).cast(live.schema).alias("event"), F.struct(*columns).alias("row"))).withColumn("all", F.lit(1))

        def assign(pdf: pd.DataFrame) -> pd.DataFrame:
            import numpy as np

            clusters = OnlineClusters()
            none = lambda d: {k: None if isinstance(v, float) and v != v else v for k, v in d.items()}
            for e in (none(dict(x)) for x in pdf.loc[pdf["old"], "event"]):
                clusters.ids.append(e["id"])
                clusters.rows.append({**{k: e[k] for k in ("category", "lat", "lon", "geo_precision", "country_code")}, "sum": None if e["total"] is None else np.asarray(e["total"], float), "n": e["n"], "last": e["last"]})
            rows = sorted((none(dict(x)) for x in pdf.loc[~pdf["old"], "row"]), key=lambda r: (r["occurred_at"], r["id"]))
            out = [("link", r["id"], *clusters.assign(r)[:2], None) for r in rows]
            newest = max((e["last"] for e in clusters.rows), default=None)
            for name, e in zip(clusters.ids, clusters.rows):
                if (newest - e["last"]).total_seconds() <= max_gap_hours * 3600:
                    kept = {**{k: e[k] for k in ("category", "lat", "lon", "geo_precision", "country_code", "n", "last")}, "id": name, "total": None if e["sum"] is None else e["sum"].tolist()}
                    out.append(("event", name, None, None, kept))
            return pd.DataFrame(out, columns=["what", "observation_id", "event_id", "similarity", "event"])

        schema = f"what string, observation_id string, event_id string, similarity double, event struct<{', '.join(p.replace(' ', ':', 1) for p in saved.split(', '))}>"
        done = both.groupBy("all").applyInPandas(assign, schema).persist()
        done.where("what = 'link'").select("observation_id", "event_id", "similarity").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        done.where("what = 'event'").select("event.*").write.mode("overwrite").parquet(f"{state}/{batch_id}")
        done.unpersist()

    return run


def stop_gracefully(spark: SparkSession, seconds: float = 60.0) -> list[str]:
    """Stops the running queries, each after the batch that it is at; names of those that had to be cut off after ``seconds``."""
    deadline, cut = time.monotonic() + seconds, []
    for query in spark.streams.active:
        while query.isActive and query.status["isTriggerActive"] and time.monotonic() < deadline:
            time.sleep(0.1)
        if query.isActive and query.status["isTriggerActive"]:
            cut.append(query.name or str(query.id))
        query.stop()
    return cut


def stop_on_signal(spark: SparkSession, seconds: float = 60.0) -> None:
    """The first SIGINT or SIGTERM stops gracefully; a second one ends the process as usual."""

    def first(number, frame):
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, signal.SIG_DFL)
        stop_gracefully(spark, seconds)

    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, first)
