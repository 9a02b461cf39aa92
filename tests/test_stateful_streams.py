"""Streams with a state per customer: late, repeated and replayed input adds nothing twice."""

from __future__ import annotations

from pathlib import Path

import pytest

from holdfast import schemas
from holdfast.sources import tables
from holdfast.sources.versions import VersionedTable
from holdfast.streaming.stateful import alerts_with_state, ingest_with_state

HEADER = ",".join(schemas.ENGAGEMENT.fieldNames())


def written(path, *rows):
    lines = [f"{c},{p},5,{calls},2.5,3,4,0,61.5,0" for c, p, calls in rows]
    path.write_text("\n".join([HEADER, *lines]) + "\n")


def content(table):
    return sorted((r["customer_id"], r["period"], r["api_calls"]) for r in table.read().collect())


def forget_last_batch(checkpoint):
    """As if the stream had stopped after the sink's write and before its commit."""
    last = max((f for f in Path(checkpoint, "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)


@pytest.fixture
def engagement(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "engagement"), "period", "customer_id", 2)


def test_late_and_repeated_files_equal_one_batch(spark, tmp_path, engagement, monkeypatch):
    source, mark = tmp_path / "in", str(tmp_path / "mark")
    source.mkdir()
    first = [("A", "2024-01", 1), ("A", "2024-01", 2), ("B", "2024-03", 3), ("", "2024-01", 9)]
    second = [("A", "2024-03", 4), ("A", "2024-01", 5), ("B", "2024-02", 6), ("B", "2024-03", 7)]
    written(source / "1.csv", *first)
    ingest_with_state(spark, str(source), engagement, mark).awaitTermination()
    assert content(engagement) == [("A", "2024-01", 1), ("B", "2024-03", 3)]
    with monkeypatch.context() as blind:  # the second batch reads no stored row
        blind.setattr(VersionedTable, "read", lambda *a, **k: pytest.fail("read"))
        written(source / "2.csv", *second)
        ingest_with_state(spark, str(source), engagement, mark).awaitTermination()
    wanted = [("A", "2024-01", 1), ("A", "2024-03", 4), ("B", "2024-02", 6), ("B", "2024-03", 3)]
    assert content(engagement) == wanted
    whole = VersionedTable(spark, str(tmp_path / "whole"), "period", "customer_id", 2)
    ingest_with_state(spark, str(source), whole, str(tmp_path / "other")).awaitTermination()
    assert content(whole) == wanted
    forget_last_batch(mark)
    ingest_with_state(spark, str(source), engagement, mark).awaitTermination()
    assert content(engagement) == wanted


def test_periods_older_than_the_state_are_compared_with_the_stored_ones(spark, tmp_path, engagement):
    source, mark = tmp_path / "in", str(tmp_path / "mark")
    source.mkdir()
    written(source / "1.csv", *[("A", f"2024-0{m}", m) for m in (1, 3, 4, 5)])
    ingest_with_state(spark, str(source), engagement, mark, remembered=2).awaitTermination()
    written(source / "2.csv", ("A", "2024-01", 91), ("A", "2024-02", 92), ("A", "2024-05", 95), ("A", "2024-06", 96))
    ingest_with_state(spark, str(source), engagement, mark, remembered=2).awaitTermination()
    assert content(engagement) == [
        ("A", "2024-01", 1), ("A", "2024-02", 92), ("A", "2024-03", 3), ("A", "2024-04", 4), ("A", "2024-05", 5),
        ("A", "2024-06", 96)]


def test_one_alert_a_day_over_replays_and_restarts(spark, make_predictions, tmp_path, monkeypatch):
    runs, mark = str(tmp_path / "runs"), str(tmp_path / "mark")
    log = VersionedTable(spark, str(tmp_path / "log"), "log_day", "customer_id", 2)

    def run(*rows):
        if rows:
            tables.store_predictions(spark, make_predictions(*rows), runs)
        with monkeypatch.context() as blind:
            blind.setattr(VersionedTable, "read", lambda *a, **k: pytest.fail("read"))
            alerts_with_state(spark, runs, log, mark, keep_days=3).awaitTermination()
        return sorted((r["customer_id"], r["log_day"], r["action_type"]) for r in log.read().collect())

    one = run(("A", "2024-01-01", 0.9, "High Risk"), ("B", "2024-01-01", 0.1, "Low Risk"))
    assert {x[:2] for x in one} == {("A", "2024-01-01")} and len(one) == 2
    again = run(("A", "2024-01-01", 0.95, "High Risk"), ("B", "2024-01-01", 0.9, "High Risk"))  # the run anew
    assert {x[:2] for x in again} == {("A", "2024-01-01"), ("B", "2024-01-01")} and len(again) == 4
    forget_last_batch(mark)
    assert run() == again
    later = run(("A", "2024-01-02", 0.9, "High Risk"))
    assert len(later) == 6
    much_later = run(("B", "2024-02-01", 0.9, "High Risk"))
    assert len(much_later) == 8
