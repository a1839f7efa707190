"""Keyed streams with timers against their batch twins."""

import time

import numpy as np
import pytest

from landshift.operators import control_plane as cp
from landshift.streaming import monitoring


@pytest.fixture
def timers(spark):
    monitoring.stream_settings(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def wait_for(query, name, spark, n, seconds=120):
    for _ in range(seconds):
        if query.exception() or spark.table(name).count() >= n:
            break
        time.sleep(1)
    query.stop()
    assert query.exception() is None


def test_events_out_of_order_are_decided_in_order(timers, tmp_path):
    spark, rng = timers, np.random.default_rng(3)
    when = np.sort(rng.random(300) * 60) + 1000.0
    rows = [(f"k{k % 2}", k, float(t), bool(k % 3 > 0)) for k, t in enumerate(when)]
    rows += [("k0", 900, 2500.0, True), ("k1", 901, 2500.5, False)]  # long after: the keys were idle meanwhile
    kind = "key string, seq long, ts double, is_run boolean"
    want = sorted(map(tuple, monitoring.rate_limited(spark.createDataFrame(rows, kind)).collect()))
    assert 0 < sum(not r[4] for r in want) < len(want)
    late = sorted(range(300), key=lambda k: when[k] + rng.random() * 8)  # none is late by more than ten seconds
    parts = [[rows[k] for k in late[:100]], [rows[k] for k in late[100:200]], [rows[k] for k in late[200:]], rows[300:], [("zz", 999, 4000.0, False)], [("zz", 1000, 4001.0, False)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = monitoring.rate_limited_in_order(source)
    q = out.writeStream.format("memory").queryName("in_order").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    wait_for(q, "in_order", spark, len(want))
    got = sorted(map(tuple, spark.table("in_order").where("key <> 'zz'").collect()))
    assert got == want


def test_a_completion_is_seen_once(timers, tmp_path):
    spark = timers
    polls = [("a", 1, 1.0, "running"), ("b", 2, 1.0, "running"), ("a", 3, 6.0, "completed"), ("b", 4, 6.0, "running"), ("a", 5, 11.0, "completed"), ("b", 6, 11.0, "failed"), ("a", 7, 16.0, "running"), ("a", 8, 21.0, "completed"), ("c", 9, 21.0, "completed")]
    kind = "run_id string, seq long, ts double, status string"
    want = {(r["run_id"], r["seq"]) for r in cp.completion_edges(spark.createDataFrame(polls, kind), "run_id", ["ts", "seq"]).collect()}
    for k in range(0, 9, 3):
        spark.createDataFrame(polls[k : k + 3], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    seen = []
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = monitoring.watch(source, lambda df, k: seen.extend((r["run_id"], r["seq"]) for r in df.collect()), str(tmp_path / "state"), "1 second")
    for _ in range(60):
        if q.exception() or len(seen) >= len(want):
            break
        time.sleep(1)
    time.sleep(2)
    q.stop()
    assert q.exception() is None and sorted(seen) == sorted(want) == [("a", 3), ("a", 8), ("c", 9)]
