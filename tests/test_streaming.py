from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators.late_events import hourly_counts
from tidewatch.streaming import jobs

SCHEMA = "id string, source_id string, external_id string, occurred_at timestamp, ingested_at timestamp, category string, grid_cell string, severity int"
T0 = datetime(2025, 3, 1)


def rows(n=400):
    out = []
    for i in range(n):
        at = T0 + timedelta(minutes=13 * i)
        late = 30 if i % 7 else 60 * 20
        out.append((f"o{i}", "s", f"x{i}", at, at + timedelta(minutes=late), "c", f"g{i % 3}", 10))
    return out


def write_batches(spark, data, folder, parts=4):
    size = -(-len(data) // parts)
    for p in range(parts):
        spark.createDataFrame(data[p * size : (p + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(df, folder, name, mode="append"):
    query = jobs.start(df, str(folder / f"cp-{name}"), mode=mode).format("parquet").option("path", str(folder / name)).start()
    query.awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(str(folder / name))


def test_deduplication_and_hours(spark, tmp_path):
    data = rows()
    write_batches(spark, data + data[:50], tmp_path / "in")
    stream = jobs.read_stream(spark, str(tmp_path / "in"), SCHEMA, 1)
    assert run(jobs.deduplicated(stream), tmp_path, "dedup").count() == len(data)
    hours = run(jobs.hourly_volume(jobs.deduplicated(stream), None), tmp_path, "hours")
    batch = {}
    for r in data:
        k = (r[6], r[3].replace(minute=0))
        batch[k] = batch.get(k, 0) + 1
    got = {(r["grid_cell"], r["bucket"]): r["observed"] for r in hours.collect()}
    assert got and all(batch[k] == n for k, n in got.items())


def test_running_baselines(spark, tmp_path):
    counts = [4, 5, 4, 3, 5, 4, 4, 5, 3, 4, 4, 5, 4, 40, 4]
    volume = [("c", "g", T0 + timedelta(hours=i), n) for i, n in enumerate(counts)]
    spark.createDataFrame(volume, "category string, grid_cell string, bucket timestamp, observed bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), "category string, grid_cell string, bucket timestamp, observed bigint")
    out = run(jobs.running_baselines(stream), tmp_path, "z", "append")
    assert [r["observed"] for r in out.where("unusual").collect()] == [40] and out.count() == len(counts)


def test_late_corrections_equal_the_batch(spark, tmp_path):
    data = rows(200)
    # The last batch brings records that are late for hours of the first.
    late = [("late%d" % i, "s", "late%d" % i, T0 + timedelta(minutes=i), T0 + timedelta(hours=5), "c", "g0", 10) for i in range(5)]
    write_batches(spark, data, tmp_path / "in", 2)
    write_batches(spark, late, tmp_path / "in", 1)
    stream = jobs.read_stream(spark, str(tmp_path / "in"), SCHEMA, 1)
    sink = jobs.corrected_hours_sink(spark, str(tmp_path / "log"), str(tmp_path / "out"))
    jobs.start(stream, str(tmp_path / "cp")).foreachBatch(sink).start().awaitTermination(180)
    want = hourly_counts(spark.createDataFrame(data + late, SCHEMA)).select("category", "grid_cell", "period", "count", "running")
    got = jobs.latest_hours(spark, str(tmp_path / "out")).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_hours_read_the_touched_blocks_only(spark, tmp_path):
    """Three days in order, then a late record for the third: the batch starts from the state after the second day."""
    import shutil

    day = lambda n, names: [(f"{x}{n}", "s", f"{x}{n}", T0 + timedelta(days=n, minutes=i), T0 + timedelta(days=n, minutes=i + 1), "c", "g0", 10) for i, x in enumerate(names)]
    late = [("late", "s", "late", T0 + timedelta(days=2, hours=3), T0 + timedelta(days=2, hours=6), "c", "g0", 10)]
    parts = [day(0, "ab"), day(1, "abc"), day(2, "a"), late]
    sink = jobs.corrected_hours_sink(spark, str(tmp_path / "log"), str(tmp_path / "out"))
    for i, part in enumerate(parts):
        sink(spark.createDataFrame(part, SCHEMA), i)
        if i == 2:
            # What lies before the block isn't needed any more.
            for n in (0, 1):
                shutil.rmtree(tmp_path / "log" / f"batch={n}")
    sink(spark.createDataFrame(parts[3], SCHEMA), 3)
    want = hourly_counts(spark.createDataFrame(sum(parts, []), SCHEMA)).select("category", "grid_cell", "period", "count", "n_periods", "running", "sum_sq")
    assert sorted(map(tuple, jobs.latest_hours(spark, str(tmp_path / "out")).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    sink(spark.createDataFrame([], SCHEMA), 4)


def test_graceful_stop(spark, tmp_path):
    write_batches(spark, rows(20), tmp_path / "in", 1)
    done = []
    query = jobs.start(jobs.read_stream(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "cp"), once=False, every="1 second").foreachBatch(lambda df, n: done.append(df.count())).start()
    while not done:
        query.awaitTermination(1)
    assert jobs.stop_gracefully(spark) == [] and not query.isActive and sum(done) == 20


def test_windows_compile(spark, tmp_path):
    write_batches(spark, rows(60), tmp_path / "in", 2)
    stream = jobs.read_stream(spark, str(tmp_path / "in"), SCHEMA)
    assert run(jobs.sliding_volume(stream, "6 hours", "1 hour"), tmp_path, "slide").where(F.col("n") <= 0).count() == 0
    assert run(jobs.sessions(stream, "1 hour"), tmp_path, "sessions").count() >= 0


def test_streamed_assignment_equals_one_sequence(spark, tmp_path):
    from tidewatch.operators.events import cluster_online

    schema = "id string, embedding array<double>, category string, lat double, lon double, geo_precision string, country_code string, occurred_at timestamp"
    data = [(f"o{i:02d}", [1.0, float(i % 3)], "c", 10.0 + i % 2, 10.0, "city", "AA", T0 + timedelta(hours=3 * i)) for i in range(24)] + [("none", None, "c", None, None, None, None, T0 + timedelta(hours=80))]
    for part in (data[:9], data[9:17], data[17:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), schema, 1)
    sink = jobs.assignment_sink(spark, str(tmp_path / "state"), str(tmp_path / "links"))
    jobs.start(stream, str(tmp_path / "cp")).foreachBatch(sink).start().awaitTermination(180)
    got = {r["observation_id"]: r["event_id"] for r in spark.read.parquet(str(tmp_path / "links")).collect()}
    want = {r["observation_id"]: r["event_id"] for r in cluster_online(spark.createDataFrame(data, schema)).collect()}
    assert got == want and len(set(got.values())) < len(got)
