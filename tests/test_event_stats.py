import os
import random
from datetime import datetime, timedelta
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq

from larder.plans import registered as R
from larder.streaming import event_stats as ES


def test_windowed_tool_events_counts_files_in_any_order_of_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "event_stream", partial(R.event_stream, max_files=1))
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    days = [5, 1, 4, 1, 0, 5, 2]
    for k, day in enumerate(days):
        at = datetime(2024, 1, 1, 9) + timedelta(days=day)
        rows = [
            {"event_id": 3 * k + n, "ts": at + timedelta(minutes=n), "user_id": n, "event_type": kind, "value": 1.5 + day + k, "props": "{}"}
            for n, kind in enumerate(["error", "view", "view"])
        ]
        path = folder / f"part-{k}.parquet"
        schema = pa.schema(
            [("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())]
        )
        pq.write_table(pa.Table.from_pylist(rows, schema), path)
        os.utime(path, (1_700_000_000 + 10 * k,) * 2)
    got = {(r.day, r.tool): (r.calls, r.errors, r.total_ms, r.max_ms) for r in R.registered()["windowed_tool_events"](spark, str(tmp_path)).collect()}
    expected = {}
    for day in set(days):
        values = [1.5 + day + k for k, d in enumerate(days) if d == day]
        name = f"2024-01-0{1 + day}"
        expected[name, "error"] = (len(values), len(values), sum(values), max(values))
        expected[name, "view"] = (2 * len(values), 0, 2 * sum(values), max(values))
    assert got == expected


def test_late_events_and_bounded_parts(spark, tmp_path):
    """Sliding windows over files in any order of time: no state, few folders, and the sums of the batch result."""
    rng = random.Random(4)
    schema = pa.schema([("tool", pa.string()), ("started_at", pa.timestamp("us", "UTC")), ("duration_ms", pa.float64()), ("success", pa.bool_())])
    incoming, parts = tmp_path / "in", str(tmp_path / "parts")
    incoming.mkdir()
    for k in range(11):
        at = datetime(2024, 1, 1) + timedelta(hours=rng.choice([0, 1, 2, 300]))
        rows = [{"tool": rng.choice("ab"), "started_at": at + timedelta(minutes=n), "duration_ms": rng.choice([None, 1.5, 8.25]), "success": n % 3 > 0} for n in range(20)]
        rows.append({"tool": "a", "started_at": None, "duration_ms": 1.0, "success": True})
        pq.write_table(pa.Table.from_pylist(rows, schema), incoming / f"{k}.parquet")
        os.utime(incoming / f"{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    every = spark.read.parquet(str(incoming))
    stream = ES.event_stream(spark, str(incoming), every.schema, max_files=1)
    query = ES.start_window_parts(stream, parts, str(tmp_path / "progress"), "1 hour", "20 minutes", fan=3)
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress) and len(query.recentProgress) >= 11
    folders = {(r.level, r.n) for r in ES.live_parts(spark, parts, 3).select("level", "n").distinct().collect()}
    assert folders == {(2, 0), (0, 9), (0, 10)}
    show = lambda df: sorted((r.window_start, r.tool, r.calls, r.errors, None if r.avg_ms is None else round(r.avg_ms, 6), r.max_ms) for r in df.collect())
    assert show(ES.read_window_stats(spark, parts, 3)) == show(ES.windowed_tool_stats(every, "1 hour", "20 minutes"))
