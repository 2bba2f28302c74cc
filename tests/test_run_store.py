"""Runs from folder to folder: what is written, what is referred to, and what the log says at each point."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larder.operators.ingest import run_rows
from larder.schemas import SCHEMAS
from larder.sources import store
from larder.sources.runlog import run_states
from larder.sources.store import run_errors, run_ingest
from larder.sources.tables import read_parts, read_table, seed_empty_tables, write_table
from larder.streaming.ingest_stream import RECORD_STREAM

AT, LATER = datetime(2024, 5, 1, 8), datetime(2024, 5, 1, 9, 30)
SOURCES = [{"id": 1, "key": "fooby"}, {"id": 2, "key": "migusto"}, {"id": 3, "key": "swissmilk"}]


def table(spark, name, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMAS[name].fields) for r in rows], SCHEMAS[name])


def record(source, position, url, **kw):
    row = {"title": f"T{url}", "ingredients_raw": ["1 Ei"], "steps_raw": ["Kochen"], "source_url": url, "language": "de", "source_id": source, "position": position, **kw}
    return tuple(row.get(f.name, "" if f.name in ("description", "cook_time") else None) for f in RECORD_STREAM.fields)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD_STREAM)


def written(folder):
    return {str(p.relative_to(folder)): p.stat().st_size for p in Path(folder).rglob("*.parquet") if p.is_file()}


def run(spark, records, old, new, **kw):
    return run_ingest(spark, records, old, new, table(spark, "ingredients", [{"id": 1, "key": "egg", "display_de": "Ei"}]), table(spark, "sources", SOURCES), AT, LATER, **kw)


@pytest.fixture()
def folders(spark, tmp_path):
    out = [str(tmp_path / f"v{k}") for k in range(4)]
    seed_empty_tables(spark, out[0])
    return out


def test_a_run_without_deletions_writes_the_batch_only(spark, folders):
    many = [record(1 + k % 2, k, f"u{k}", title=f"Rezept {k}", ingredients_raw=[f"{k} Eier, Nummer {k * 7919}"] * 20, steps_raw=[f"Schritt {k * 104729}"] * 20) for k in range(600)]
    run(spark, batch(spark, *many), folders[0], folders[1])
    first = written(folders[1])
    # everything that was found before is found again, and one more
    run(spark, batch(spark, *many, record(1, 999, "neu")), folders[1], folders[2])
    second = written(folders[2])
    data = {f: n for f, n in second.items() if not f.startswith("_")}
    assert not [f for f in data if "rewritten" in f]
    assert sum(data.values()) < sum(n for f, n in first.items() if not f.startswith("_")) / 4
    assert read_table(spark, folders[2], "recipes").count() == 601
    assert read_table(spark, folders[2], "recipe_steps").count() == 600 * 20 + 1
    assert read_table(spark, folders[1], "recipes").count() == 600
    own = [p for p in read_parts(spark, folders[2]) if p.path.startswith(folders[2])]
    assert {p.source_id for p in own if p.table == "recipes"} == {1}


def test_only_sources_with_deletions_are_written_again(spark, folders):
    run(spark, batch(spark, *[record(s, k, f"{s}-{k}", title=f"{s}-{k}") for s in (1, 2, 3) for k in range(4)]), folders[0], folders[1])
    kept = [record(s, k, f"{s}-{k}", title=f"{s}-{k}") for s in (1, 2) for k in range(4) if (s, k) != (2, 1)]
    run(spark, batch(spark, *kept), folders[1], folders[2])
    status = {r.source_url: r.status for r in read_table(spark, folders[2], "recipes").collect()}
    # the third source was not discovered, so nothing of it is gone
    assert len(status) == 12 and [u for u, s in status.items() if s == "deleted"] == ["2-1"]
    again = [p for p in read_parts(spark, folders[2]) if p.table == "recipes" and p.path.startswith(folders[2])]
    assert {p.source_id for p in again} == {2} and all("rewritten" in p.path for p in again)
    runs = {r.source: r for r in read_table(spark, folders[2], "etl_runs").filter("id > 3").collect()}
    assert {s: r.soft_deleted for s, r in runs.items()} == {"fooby": 0, "migusto": 1, "swissmilk": 0}
    # a third run on top: parts of three folders
    run(spark, batch(spark, *kept, record(3, 9, "3-9", title="3-9")), folders[2], folders[3])
    status = {r.source_url: r.status for r in read_table(spark, folders[3], "recipes").collect()}
    assert sorted(u for u, s in status.items() if s == "deleted") == ["2-1", "3-0", "3-1", "3-2", "3-3"] and len(status) == 13


def test_a_plain_table_is_dealt_by_source_once(spark, folders):
    write_table(table(spark, "recipes", [{"id": k, "source_id": 1 + k % 2, "source_url": f"u{k}", "status": "active"} for k in range(6)]), folders[0], "recipes")
    run(spark, batch(spark, record(1, 1, "u0"), record(1, 2, "u2")), folders[0], folders[1])
    rows = {r.source_url: (r.source_id, r.status) for r in read_table(spark, folders[1], "recipes").collect()}
    assert rows["u4"] == (1, "deleted") and [v for v in rows.values() if v[0] == 2] == [(2, "active")] * 3 and len(rows) == 6
    assert all(p.source_id is not None for p in read_parts(spark, folders[1]) if p.table == "recipes")


def test_log_of_a_run(spark, folders, monkeypatch):
    seen = {}

    def look(records, *args, keep_decided, **kw):
        seen["start"] = {r.source: (r.status, r.discovered, r.finished_at) for r in run_states(spark, folders[0]).collect()}

        def keep(decided):
            out = keep_decided(decided)
            seen["decided"] = {r.source: (r.status, r.discovered, r.fetched, r.errors) for r in run_states(spark, folders[0]).collect()}
            return out

        return ingest(records, *args, keep_decided=keep, **kw)

    ingest = store.ingest
    monkeypatch.setattr(store, "ingest", look)
    records = [record(1, 1, "a"), record(1, 2, "b", error="Fetch failed"), record(2, 1, "c", error="kaputt"), record(2, 2, "d", language="xx")]
    records += [record(2, 10 + k, f"e{k}", error=f"Fehler {k}") for k in range(15)]
    failures = spark.createDataFrame([(3, "timeout")], "source_id int, error string")
    run(spark, batch(spark, *records), folders[0], folders[1], languages=["de"], failures=failures, batch_size=50, limit_per_source=7)
    assert seen["start"] == {s["key"]: ("running", 0, None) for s in SOURCES}
    assert seen["decided"] == {"fooby": ("running", 2, 1, 1), "migusto": ("running", 17, 0, 16), "swissmilk": ("running", 0, 0, 0)}
    rows = {r.source: r for r in read_table(spark, folders[1], "etl_runs").collect()}
    assert {s: (r.status, r.discovered, r.fetched, r.skipped, r.errors) for s, r in rows.items()} == {
        "fooby": ("partial", 2, 1, 0, 1), "migusto": ("failed", 17, 0, 1, 16), "swissmilk": ("failed", 0, 0, 0, 1),
    }
    assert rows["swissmilk"].error_summary == "Discovery failed: timeout"
    assert rows["migusto"].error_summary.count(";") == 9 and rows["fooby"].duration_seconds == 5400.0
    assert (rows["fooby"].batch_size, rows["fooby"]["limit"], rows["fooby"].id) == (50, 7, 1)
    # all errors, not the first ten only
    assert run_errors(spark, folders[1]).filter("source_id = 2").count() == 16
    assert {r.status for r in run_states(spark, folders[0]).collect()} == {"failed", "partial"}


def test_a_run_that_broke_off_is_closed_as_crashed(spark, folders, monkeypatch):
    def broken(*args, **kw):
        raise RuntimeError("power cut")

    with monkeypatch.context() as m:
        m.setattr(store, "ingest", broken)
        with pytest.raises(RuntimeError):
            run(spark, batch(spark, record(1, 1, "a")), folders[0], folders[1])
    assert {r.status for r in run_states(spark, folders[0]).collect()} == {"running"}
    run(spark, batch(spark, record(1, 1, "a")), folders[0], folders[2])
    runs = read_table(spark, folders[2], "etl_runs").orderBy("id").collect()
    assert [(r.id, r.source, r.status) for r in runs] == [
        (1, "fooby", "crashed"), (2, "migusto", "crashed"), (3, "swissmilk", "crashed"), (4, "fooby", "success"), (5, "migusto", "success"), (6, "swissmilk", "success"),
    ]
    assert all(r.finished_at is not None for r in runs) and "running" not in {r.status for r in run_states(spark, folders[0]).collect()}


def test_run_rows_without_records(spark):
    decided = spark.createDataFrame([], "source_id int, position long, content_hash string, error string, disposition string")
    rows = run_rows(table(spark, "sources", SOURCES), decided, AT, AT).orderBy("source_id").collect()
    assert [(r.source, r.discovered, r.status, r.error_summary) for r in rows] == [(s["key"], 0, "success", None) for s in SOURCES]
    twice = spark.createDataFrame([(2, "b"), (2, "a")], "source_id int, error string")
    row = run_rows(table(spark, "sources", SOURCES), decided, AT, AT, failures=twice).filter(F.col("source_id") == 2).first()
    assert (row.errors, row.status, row.error_summary) == (2, "failed", "Discovery failed: a")
