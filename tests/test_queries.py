"""Every query runs at the smallest scale, and equals its SQL where it has one."""

import json
import os

import pytest

from support import SMALL, assert_matches_duckdb
from tapewright import source_queries  # noqa: F401 - registers its queries
from tapewright.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert_matches_duckdb(QUERIES[name], ORACLES[name], spark, SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.collect() and len(set(df.columns)) == len(df.columns)


def test_book_replay_equals_a_loop(spark):
    """The replay of order books, message by message, in plain Python."""
    from datetime import timedelta

    from tapewright import views
    from tapewright.queries import book_messages

    rows = book_messages(views.trades(spark, SMALL, per_venue=True)).collect()
    want = []
    for symbol in sorted({m["symbol"] for m in rows}):
        book, last, exact, due, counts = {"bids": {}, "asks": {}}, None, False, None, [0, 0, 0]
        for m in sorted((m for m in rows if m["symbol"] == symbol), key=lambda m: m["seq"]):
            levels = {side: {x["price"]: x["quantity"] for x in m[side]} for side in book}
            if m["kind"] == "snapshot":
                book = {side: {p: n for p, n in levels[side].items() if n} for side in book}
                last, exact = m["final_update_id"], False
                continue
            if last is None or m["final_update_id"] <= last:
                counts[1] += 1
                continue
            if m["first_update_id"] > last + 1 or (exact and m["first_update_id"] != last + 1):
                counts[2] += 1
                last = None
                continue
            for side in book:
                book[side] = {p: n for p, n in (book[side] | levels[side]).items() if n}
            last, exact = m["final_update_id"], True
            counts[0] += 1
            if due is None or m["event_time"] >= due:
                due = m["event_time"] + timedelta(hours=1)
                bids, asks = sorted(book["bids"], reverse=True), sorted(book["asks"])
                want.append((symbol, m["event_time"], bids[0] if bids else None, asks[0] if asks else None, sum(book["bids"][p] for p in bids[:5]), sum(book["asks"][p] for p in asks[:5]), *counts))
    got = [tuple(x) for x in QUERIES["order_book_replay"](spark, SMALL).collect()]
    assert len(want) > 20 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_book_replay_of_repeated_ids_equals_sql(spark, tmp_path):
    """Trades that share time and id, but not their quantity, count in one order on both sides."""
    import duckdb

    rows = f"SELECT event_id, ts, user_id + i AS user_id, event_type, value, props FROM '{SMALL}/events.parquet', (VALUES (4), (0), (6), (2)) t(i) ORDER BY hash(event_id, i)"
    duckdb.connect().execute(f"COPY ({rows}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert_matches_duckdb(QUERIES["order_book_replay"], ORACLES["order_book_replay"], spark, str(tmp_path))


def test_book_replay_shuffles_epochs_after_its_joins(spark):
    """A join may turn into a broadcast that keeps no epoch in one task: the shuffle behind it must not be left out for the join's own."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # joins as they are planned for larger tables
    try:
        plan = QUERIES["order_book_replay"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert plan.count("REPARTITION_BY_COL") == 2  # before the survey and before the books


def test_recorded_frames_come_in_bounded_batches(spark, tmp_path, monkeypatch):
    """A book takes a micro-batch in one task, so a longer feed means more batches, not larger ones."""
    monkeypatch.setattr(source_queries, "workspace", lambda _: str(tmp_path / "w"))
    monkeypatch.setattr(source_queries, "_FILE_FRAMES", 100, raising=False)
    monkeypatch.setattr(source_queries, "_BATCH_FILES", 5, raising=False)
    assert_matches_duckdb(QUERIES["recorded_trades"], ORACLES["recorded_trades"], spark, SMALL)
    for consumer in ("depth", "trades"):
        assert len([n for n in os.listdir(tmp_path / "w" / "state" / consumer / "offsets") if n.isdigit()]) >= 4


def test_books_take_a_live_feed_in_bounded_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "workspace", lambda _: str(tmp_path / "w"))
    monkeypatch.setattr(source_queries, "_BOOK_FRAMES", 300, raising=False)
    assert_matches_duckdb(QUERIES["recorded_depth"], ORACLES["recorded_depth"], spark, SMALL)
    ends = {}
    for n in os.listdir(tmp_path / "w" / "state" / "depth" / "offsets"):
        if n.isdigit():
            feed = (tmp_path / "w" / "state" / "depth" / "offsets" / n).read_text().splitlines()[2:]
            ends[int(n)] = json.loads(next(x for x in feed if "all" in x))["all"]
    assert len(set(ends.values())) >= 2


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
