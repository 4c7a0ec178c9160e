import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from tidewatch.operators.late_events import Lateness, corrected_periods, first_deliveries, period_counts, stale_records

SCHEMA = "id string, source_id string, external_id string, occurred_at timestamp, ingested_at timestamp, category string, grid_cell string, period string"
T0 = datetime(2025, 3, 3)


def brute(rows):
    first = {}
    for r in rows:
        k = (r[1], r[2])
        if None in k:
            first[object()] = r
        elif k not in first or r[4] < first[k][4]:
            first[k] = r
    counts = Counter()
    for r in first.values():
        if r[5] is None or r[6] is None or r[3] is None or r[4] is None:
            continue
        hour = r[3].replace(minute=0, second=0, microsecond=0)
        if r[4] <= hour + timedelta(hours=25):
            counts[r[5], r[6], hour] += 1
    return counts


def make(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + timedelta(seconds=rng.randrange(10 * 86_400))
        late = rng.choice([60, 1800, 4000, 20 * 3600, 24 * 3600, 30 * 3600, -600])
        # One cell holds a third of all rows.
        cell = rng.choice(["5:1:1", "5:1:2", None]) if rng.random() > 0.4 else "5:9:9"
        r = (f"o{i}", rng.choice(["a", "b"]), f"x{i}", at, at + timedelta(seconds=late), rng.choice(["seismic", "health"]), cell, "clash")
        rows.append(r)
        if rng.random() < 0.1:
            rows.append((*r[:4], r[4] + timedelta(hours=1), *r[5:]))
    return rows


@pytest.mark.parametrize("checkpoint", [1, 24, 100])
def test_corrected_counts_and_state(spark, checkpoint):
    rows = make(1)
    lateness = Lateness(checkpoint_periods=checkpoint)
    once = first_deliveries(spark.createDataFrame(rows, SCHEMA), ["source_id", "external_id"], "ingested_at")
    out = corrected_periods(period_counts(once.drop("period"), ["category", "grid_cell"], "occurred_at", "ingested_at", lateness), ["category", "grid_cell"], lateness).collect()
    want = brute(rows)
    epoch = datetime(1970, 1, 1)
    got = {(r["category"], r["grid_cell"], epoch + timedelta(microseconds=r["period"])): r for r in out}
    assert {k: r["count"] for k, r in got.items()} == dict(want) and len(out) == len(got)
    running = defaultdict(lambda: [0, 0, 0])
    for k in sorted(want):
        s = running[k[:2]]
        s[0] += 1
        s[1] += want[k]
        s[2] += want[k] ** 2
        assert [got[k]["n_periods"], got[k]["running"], got[k]["sum_sq"]] == s
    assert any(r["replayed"] for r in out) and (checkpoint > 24 or not all(r["replayed"] for r in out))


def test_stale_records(spark, rows):
    data = make(2)
    want = brute(data)
    obs = spark.createDataFrame(data, SCHEMA)
    hours = sorted(want)[:40]
    alerts = [(f"al{i}", *k[:2], k[2], want[k] + (i % 3 == 0)) for i, k in enumerate(hours)]
    alerts += [alerts[0], ("al-none", "seismic", "9:9:9", T0, 0), ("al-null", "seismic", "9:9:9", T0, None), ("al-nocell", "seismic", None, T0, 2)]
    alert_df = spark.createDataFrame(alerts, "id string, category string, grid_cell string, bucket_at timestamp, observed int")
    last = {}
    for c, g, h in want:
        last[c, g] = max(last.get((c, g), h), h)
    base = [(c, g, T0, h if i % 2 else h - timedelta(hours=1)) for i, ((c, g), h) in enumerate(sorted(last.items()))]
    base += [("space", "1:1:1", T0, None), ("space", "1:1:2", T0, T0)]
    base_df = spark.createDataFrame(base, "category string, grid_cell string, period_start timestamp, last_bucket_at timestamp")
    got = rows(stale_records(obs, alert_df, base_df))
    expect = [("alerts", f"al{i}") for i in range(40) if i % 3 == 0] + [("alerts", "al-null"), ("alerts", "al-nocell")]
    expect += [("baselines", f"{c}|{g}|2025-03-03") for i, ((c, g), _) in enumerate(sorted(last.items())) if i % 2 == 0] + [("baselines", "space|1:1:2|2025-03-03")]
    assert got == sorted(expect)


def test_empty_tables(spark):
    obs = spark.createDataFrame([], SCHEMA)
    alerts = spark.createDataFrame([], "id string, category string, grid_cell string, bucket_at timestamp, observed int")
    base = spark.createDataFrame([], "category string, grid_cell string, period_start timestamp, last_bucket_at timestamp")
    assert stale_records(obs, alerts, base).count() == 0


def test_first_deliveries_with_null_identity(spark):
    rows = [("o1", None, "x", T0, T0, "c", "g", ""), ("o2", None, "x", T0, T0, "c", "g", ""), ("o3", "a", "x", T0, None, "c", "g", ""), ("o4", "a", "x", T0, T0, "c", "g", "")]
    out = first_deliveries(spark.createDataFrame(rows, SCHEMA), ["source_id", "external_id"], "ingested_at")
    assert sorted(r["id"] for r in out.collect()) == ["o1", "o2", "o4"]
