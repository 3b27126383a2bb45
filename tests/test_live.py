"""Live feeds, books as state, snapshots on demand, and what a crash leaves behind."""

import json
import os
import random
import time
from datetime import timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from support import START
from tapewright.model import Listing, Market
from tapewright.sources.rest import SnapshotGuard
from tapewright.sources.store import CANDLE_TABLE, DEPTH_TABLE, TRADE_TABLE, Store
from tapewright.streaming import keeper, live, orderbook, recorder
from test_sources import trade_frame, update_frame

BTC = Listing("BTC/USDT", Market.SPOT)
MS = int(START.timestamp() * 1000)
QUICK = {"first_pause": 0.01, "longest_pause": 0.05, "seal_seconds": 0.05}


def feed_files(folder, values, first=0):
    os.makedirs(folder, exist_ok=True)
    for at in range(0, len(values), 40):
        part = values[at : at + 40]
        pq.write_table(pa.table({"position": pa.array(range(first + at, first + at + len(part)), pa.int64()), "value": part}), f"{folder}/{first + at:08d}.parquet")
    return str(folder)


def drained(spark, tmp_path, feeds, name="q", **options):
    df = live.frames(spark, "tapewright.streaming.live:recorded", feeds, str(tmp_path / "journal"), drain=True, keep=True, **QUICK, **options)
    out = str(tmp_path / name)
    df.writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(live.SCHEMA).parquet(out)


def test_two_lost_connections_lose_and_repeat_nothing(spark, tmp_path):
    values = [f"frame {i}" for i in range(100)]
    path = feed_files(tmp_path / "in", values)
    got = drained(spark, tmp_path, {"a": {"path": path, "drop_every": 40, "repeats": 3}, "b": {"path": path}})
    for feed in "ab":
        rows = got.where(f"feed = '{feed}'").orderBy("frame").collect()
        assert [r["value"] for r in rows] == values and [r["frame"] for r in rows] == [r["position"] for r in rows] == list(range(100))
    journal = live.Journal(str(tmp_path / "journal" / "a"))
    assert (journal.end, journal.last) == (100, 99)


def test_restart_goes_on_where_the_journal_ends(spark, tmp_path):
    path = feed_files(tmp_path / "in", [f"frame {i}" for i in range(50)])
    assert drained(spark, tmp_path, {"a": {"path": path}}).count() == 50
    feed_files(tmp_path / "in", [f"frame {i}" for i in range(50, 75)], first=50)
    got = drained(spark, tmp_path, {"a": {"path": path, "drop_every": 10, "repeats": 5}})
    assert sorted(r["position"] for r in got.collect()) == list(range(75))
    assert drained(spark, tmp_path, {"a": {"path": path}}).count() == 75


def test_backoff_doubles_to_its_limit_and_starts_anew():
    slept = []
    b = live.Backoff(1, 30, slept.append)
    for _ in range(7):
        b.wait()
    b.reset()
    b.wait()
    assert slept == [1, 2, 4, 8, 16, 30, 30, 1]


def test_full_queue_holds_the_feed_back(tmp_path):
    sent = []

    def transport(options, after):
        for i in range(1000):
            sent.append(i)
            yield i, "x"
        raise live.Finished

    journal = live.Journal(str(tmp_path / "j"))
    feed = live.Feed(transport, {}, journal, queue=10)
    feed.listener.start()  # nobody writes the journal yet
    time.sleep(0.5)
    assert len(sent) <= 12
    feed.writer.start()
    feed.drained()
    assert journal.end == 1000 and [r for s in journal.segments() for r in journal.read(*s).column("position").to_pylist()] == list(range(1000))


def test_refused_connections_and_failures(tmp_path):
    tries = []

    def transport(options, after):
        tries.append(after)
        if len(tries) < 4:
            raise ConnectionRefusedError
        if len(tries) == 5:
            raise ValueError("not a feed")
        return iter([(None, "a"), (None, "b")])

    feed = live.Feed(transport, {}, live.Journal(str(tmp_path / "j")), backoff=live.Backoff(0, 0)).start()
    feed.drained()
    with pytest.raises(ValueError):
        feed.end()
    assert tries == [None] * 5


def test_journal_forgets_what_is_done(tmp_path):
    j = live.Journal(str(tmp_path / "j"))
    for i in range(4):
        j.append([(10 * i + k, START, "v") for k in range(10)])
    open(tmp_path / "j" / "00-half.parquet.writing", "w").close()
    j.forget(25)
    assert j.segments() == [(20, 10), (30, 10)] and live.Journal(str(tmp_path / "j")).last == 39
    j.forget(1000)
    assert j.segments() == [(30, 10)] and live.Journal(str(tmp_path / "j")).end == 40


def test_lost_journal_is_an_error(tmp_path):
    reader = live._LiveReader({"feeds": '{"a": {}}', "journal": str(tmp_path)})
    j = live.Journal(str(tmp_path / "a"))
    j.append([(None, START, "v")] * 3)
    assert [(p.start, p.end) for p in reader.partitions({"a": 1}, {"a": 3})] == [(1, 3)]
    with pytest.raises(ValueError):
        reader.partitions({"a": 0}, {"a": 5})


def test_a_reconnection_reads_on_from_its_place(tmp_path, monkeypatch):
    """Rows read over all connections grow with the feed, not with its square."""
    n, read = 4_000, []
    for at in range(0, n, 100):
        pq.write_table(pa.table({"position": pa.array(range(at, at + 100), pa.int64()), "value": ["x"] * 100}), tmp_path / f"{at:05d}.parquet", row_group_size=50)

    class Counting(pq.ParquetFile):
        def iter_batches(self, *args, **options):
            for b in super().iter_batches(*args, **options):
                read.append(b.num_rows)
                yield b

    monkeypatch.setattr(live.pq, "ParquetFile", Counting)
    feed = live.Feed(live.recorded, {"path": str(tmp_path), "drop_every": 50, "repeats": 5}, live.Journal(str(tmp_path / "j")), backoff=live.Backoff(0, 0)).start()
    feed.drained()
    journal = live.Journal(str(tmp_path / "j"))
    assert feed.end() == n and feed.connections > 80 and [p for s in journal.segments() for p in journal.read(*s).column("position").to_pylist()] == list(range(n))
    assert sum(read) < feed.connections * 250


def test_two_listeners_may_write_the_same_file_at_once(tmp_path, monkeypatch):
    mine, other = live.Journal(str(tmp_path / "a")), live.Journal(str(tmp_path / "a"))
    frames, write, turns = [(i, START, f"{i}") for i in range(100)], pq.write_table, []

    def interrupted(table, out, **options):
        turns.append(1)
        if len(turns) == 1:
            other.append(frames)  # between the opening of the first file and its end
        write(table, out, **options)

    monkeypatch.setattr(live.pq, "write_table", interrupted)
    mine.append(frames)
    assert mine.segments() == [(0, 100)] and mine.read(0, 100).column("position").to_pylist() == list(range(100))
    assert len(os.listdir(tmp_path / "a")) == 1


def test_a_journal_that_fails_ends_its_listener(tmp_path, monkeypatch):
    """With a full queue, which nothing empties any more."""

    def transport(options, after):
        yield from ((i, "x") for i in range(1000))
        raise live.Finished

    def broken(self, frames):
        raise OSError("disk")

    monkeypatch.setattr(live.Journal, "append", broken)
    feed = live.Feed(transport, {}, live.Journal(str(tmp_path / "j")), queue=10, segment=50).start()
    feed.listener.join(10)
    assert not feed.listener.is_alive()
    with pytest.raises(OSError, match="disk"):
        feed.end()


def test_tasks_read_many_journal_files_and_none_twice(tmp_path, monkeypatch):
    j = live.Journal(str(tmp_path / "a"))
    for i in range(6):
        j.append([(10 * i + k, START, str(10 * i + k)) for k in range(10)])
    other = live.Journal(str(tmp_path / "a"))  # a second listener that cuts elsewhere
    other.end = 15
    other.append([(k, START, str(k)) for k in range(15, 40)])
    monkeypatch.setattr(live, "_TASK", 20)
    reader = live._LiveReader({"feeds": '{"a": {}}', "journal": str(tmp_path)})
    parts = reader.partitions({"a": 3}, {"a": 57})
    monkeypatch.setattr(live.Journal, "segments", None)  # tasks don't list the folder
    got = [v for p in parts for b in reader.read(p) for v in zip(b.column("frame").to_pylist(), b.column("value").to_pylist())]
    assert got == [(i, str(i)) for i in range(3, 57)] and len(parts) <= 3


# --- books -----------------------------------------------------------------


class Exchange:
    """Updates of one listing, some of them lost on the way, and its true book at any id."""

    def __init__(self, n, lost, seed=1, symbol="BTC/USDT"):
        r = random.Random(seed)
        self.symbol, self.updates, self.asked = symbol, [], []
        for i in range(1, n + 1):
            level = lambda base: [(float(base + r.randrange(30)), float(r.randrange(4))) for _ in range(3)]
            self.updates.append((i * 10 + 1, i * 10 + 10, MS + i * 400, level(100), level(140)))
        self.arrived = [u for i, u in enumerate(self.updates, 1) if i not in lost]

    def book(self, after):
        sides = ({}, {})
        for _, final, _, *levels in self.updates:
            if final <= after:
                for side, changes in zip(sides, levels):
                    side.update(changes)
        return {"lastUpdateId": after, "bids": [[str(p), str(q)] for p, q in sides[0].items() if q], "asks": [[str(p), str(q)] for p, q in sides[1].items() if q]}

    def fetch(self, path, params):
        self.asked.append(params["after"])
        return self.book(params["after"]), 1

    def loop(self, interval_ms):
        """The plain loop: it stops for a snapshot with an update in hand, and at every break."""
        book, out, due, counts, requests = None, [], None, [0, 0, 0], 0
        syncing = True
        for first, final, at, bids, asks in self.arrived:
            if book is None:
                book, requests = self.book(final), requests + 1
                local, sides = final, [dict((float(p), float(q)) for p, q in book[s]) for s in ("bids", "asks")]
            what = orderbook.decide(local, first, final, syncing)
            if what == "discard":
                counts[1] += 1
                continue
            if what == "resynchronize":
                counts[2] += 1
                book, requests, syncing = self.book(final), requests + 1, True
                local, sides = final, [dict((float(p), float(q)) for p, q in book[s]) for s in ("bids", "asks")]
                continue
            for side, changes in zip(sides, (bids, asks)):
                for p, q in changes:
                    side.pop(p, None) if q == 0 else side.__setitem__(p, q)
            local, syncing = final, False
            counts[0] += 1
            if due is None or at >= due:
                best = [sorted(sides[0].items(), reverse=True), sorted(sides[1].items())]
                sums = [sum(q for _, q in side[:n]) for n in (5, 10, 20) for side in best]
                out.append((at, best[0][0][0], best[1][0][0], *sums, *counts))
                due = at + interval_ms
        return out, counts, requests

    def frames(self):
        text = lambda levels: [[str(p), str(q)] for p, q in levels]
        return [update_frame(first, final, at, text(bids), text(asks)) for first, final, at, bids, asks in self.arrived]


def desk_of(exchange, folder):
    return keeper.SnapshotDesk(exchange.fetch, str(folder), guard=SnapshotGuard(0))


def test_lost_updates_lead_to_one_request_each(spark, tmp_path):
    exchange = Exchange(120, {30, 31, 77})
    path = feed_files(tmp_path / "in", [trade_frame(i, MS + i * 700, 100 + i) for i in range(25)] + exchange.frames())
    raw = live.frames(spark, "tapewright.streaming.live:recorded", {"btc": {"path": path, "drop_every": 60}}, str(tmp_path / "journal"), drain=True, keep=True, **QUICK)
    store, desk = Store(spark, str(tmp_path / "s")), desk_of(exchange, tmp_path / "answers")
    store.migrate()
    n = recorder.record(spark, raw, desk, BTC, store, str(tmp_path / "ck"), once=True)
    want, counts, requests = exchange.loop(1000)
    assert requests == len(desk.served) == len(exchange.asked) == 3 and [r[2] for r in desk.served] == [1, 2, 3]
    got = store.read(DEPTH_TABLE).orderBy("captured_at").collect()
    assert [(int(r["captured_at"].replace(tzinfo=timezone.utc).timestamp() * 1000), r["best_bid_price"], r["best_ask_price"], *[r[f"{s}_quantity_{k}"] for k in (5, 10, 20) for s in ("bid", "ask")]) for r in got] == [w[:9] for w in want]
    assert n == {"trades": 25, "depth": len(want), **dict(zip(recorder.COUNTERS, want[-1][9:]))} and counts[2] == 2
    assert store.read(TRADE_TABLE).count() == 25


def test_several_listings_ask_on_their_own(spark, tmp_path):
    """Straight through the state, in small batches: each listing equals its own loop."""
    both = {"BTC/USDT": Exchange(60, {20}, 2), "ETH/USDT": Exchange(80, {15, 40, 41, 79}, 3, "ETH/USDT")}
    rows = [(s, "spot", final, "update", at, first, final, bids, asks) for s, e in both.items() for first, final, at, bids, asks in e.arrived]
    rows.sort(key=lambda r: r[4])
    (tmp_path / "in").mkdir()
    schema = orderbook.MESSAGE.replace("event_time timestamp", "event_time long")
    for k in range(0, len(rows), 25):
        spark.createDataFrame(rows[k : k + 25], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"{k:05d}"))
    updates = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    from pyspark.sql import functions as F

    updates = updates.withColumn("event_time", F.timestamp_millis("event_time"))
    desk = keeper.SnapshotDesk(lambda path, params: both[{"BTCUSDT": "BTC/USDT", "ETHUSDT": "ETH/USDT"}[params["symbol"]]].fetch(path, params), str(tmp_path / "answers"), guard=SnapshotGuard(0))
    store = Store(spark, str(tmp_path / "s"))
    store.migrate()
    q, flushes = recorder.save_books(updates, desk, store, str(tmp_path / "ck"))
    try:
        recorder._settled(q)
    finally:
        q.stop()
    flushes.flush()
    for symbol, exchange in both.items():
        want, _, requests = exchange.loop(1000)
        got = store.read(DEPTH_TABLE, Listing(symbol, Market.SPOT)).orderBy("captured_at").collect()
        assert [r["bid_quantity_20"] for r in got] == [w[7] for w in want] and len(exchange.asked) == requests


def test_snapshots_that_come_by_themselves_equal_a_replay(spark, tmp_path):
    r, rows, last = random.Random(8), [], 0
    for seq in range(150):
        level = [(float(r.randrange(1, 30)), float(r.randrange(3)))]
        if r.random() < 0.06:
            rows.append(("A", "spot", seq, "snapshot", None, None, last, level, [(40.0, 1.0)]))
        first, last = last + 1 + (r.random() < 0.05), last + 3
        rows.append(("A", "spot", seq, "update", MS + 300 * seq, first, last, level, [(41.0, 2.0)]))
    schema = orderbook.MESSAGE.replace("event_time timestamp", "event_time long")
    from pyspark.sql import functions as F

    typed = lambda df: df.withColumn("event_time", F.timestamp_millis("event_time"))
    for k in range(0, len(rows), 50):
        spark.createDataFrame(rows[k : k + 50], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    books = keeper.stream(typed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))))
    books.writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    want = [tuple(x) for x in orderbook.replay(typed(spark.createDataFrame(rows, schema))).orderBy("captured_at").collect()]
    got = [tuple(x)[: len(want[0])] for x in spark.read.parquet(out).orderBy("captured_at").collect()]
    assert got == want and len(want) > 10


class FakeMap:
    """A map state that counts what is written."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def updateValue(self, key, value):
        self.held[key] = value
        self.writes += 1

    def removeKey(self, key):
        self.held.pop(key, None)
        self.writes += 1

    def clear(self):
        self.held = {}

    def iterator(self):
        return iter(list(self.held.items()))


def test_what_is_written_grows_with_the_changed_levels():
    state, plain = FakeMap(), {}
    side = keeper.StoredSide(state)
    for p in range(5_000):
        side[float(p)] = plain[float(p)] = 1.0
    side.flush()
    assert state.writes == 5_000
    r = random.Random(1)
    for _ in range(50):
        side, before = keeper.StoredSide(state), state.writes
        for _ in range(6):
            p = float(r.randrange(5_200))
            if r.random() < 0.4:
                side.pop(p, None)
                plain.pop(p, None)
            else:
                side[p] = plain[p] = r.random()
        if r.random() < 0.5:
            assert dict(side.items()) == plain
        side.flush()
        assert state.writes - before <= 6 and {k[0]: v[0] for k, v in state.held.items()} == plain
    side = keeper.StoredSide(state)
    side.clear()
    side[7.0] = 2.0
    assert dict(side.items()) == {7.0: 2.0}
    side.flush()
    assert state.held == {(7.0,): (2.0,)}


def test_answers_count_once_and_requests_are_sent_again():
    book, desk = orderbook.Book(), keeper.Desk()
    u = lambda first, final: (final, "update", 0, first, final, [], [], None)
    answer = lambda request, at: (at, "answer", None, None, at, [], [], request)
    out, waiting = keeper.advance(book, desk, [u(1, 5), u(6, 9)], 10, True)
    assert (out, [m[4] for m in waiting], desk.asked) == ([], [5, 9], [(1, 5)])
    out, waiting = keeper.advance(book, desk, [answer(7, 3), *waiting], 10, True)  # to nothing that was asked
    assert desk.asking and len(waiting) == 2
    out, waiting = keeper.advance(book, desk, [answer(1, 5), answer(1, 100), *waiting, u(12, 13), u(14, 15)], 10, True)
    assert len(out) == 1 and (book.applied, book.discarded, book.resynchronized) == (1, 1, 1)
    assert desk.asked == [(1, 5), (2, 13)] and [m[4] for m in waiting] == [15]

    class State:
        def exists(self):
            return True

        def get(self):
            return None, True, None, 0, 0, 0, 3, True, 42

    class Timers:
        def getCurrentProcessingTimeInMs(self):
            return 1_000

    k = keeper.BookKeeper(1, True, 500)
    registered = []
    k.handle = type("H", (), {"registerTimer": lambda self, t: registered.append(t)})()
    k.head, k.bids, k.asks = State(), FakeMap(), FakeMap()
    (again,) = k.handleExpiredTimer(("A", "spot"), Timers(), None)
    assert registered == [1_500] and again[["kind", "request", "after_id"]].values.tolist() == [["request", 3, 42]]


def _blocks(rows):
    level = pa.list_(pa.struct([("price", pa.float64()), ("quantity", pa.float64())]))
    kinds = [pa.int64(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.int64(), level, level]
    columns = zip(*((r[0], r[2], r[3], r[4], r[5], r[6]) for r in rows))
    return pa.table([pa.array(c, pa.int64()).cast(k) if pa.types.is_timestamp(k) else pa.array(c, k) for c, k in zip(columns, kinds)], names=keeper._BLOCK)


@pytest.mark.parametrize("on_demand", [True, False])
def test_runs_of_updates_equal_one_by_one(on_demand):
    """Blocks of updates with breaks, repeats, snapshots and answers, against the plain loop."""
    r = random.Random(5)
    levels = lambda: [{"price": float(r.randrange(8)), "quantity": float(r.randrange(3))} for _ in range(r.randrange(3))]
    for _ in range(60):
        plain, packed, desks, last, waiting, kept = orderbook.Book(), orderbook.Book(), (keeper.Desk(), keeper.Desk()), 0, [], []
        for _ in range(6):
            rows = []
            for _ in range(r.randrange(1, 30)):
                first = last + 1 + (r.random() < 0.05) - (r.random() < 0.05)
                last = first + r.randrange(3)
                rows.append((last, "update", r.randrange(100), first, last, levels(), levels(), None))
            other = [(last, "snapshot", None, None, last, levels(), levels(), None)] if r.random() < 0.3 else []
            answers = [(0, "answer", None, None, desks[0].after_id, levels(), levels(), desks[0].request)] if desks[0].asking and r.random() < 0.7 else []
            out, waiting = keeper.advance(plain, desks[0], [*answers, *waiting, *other, *rows], 20, on_demand)
            got, kept = keeper.advance_all(packed, desks[1], [*answers, *map(keeper.Updates, kept), *other, keeper.Updates(_blocks(rows))], 20, on_demand)
            assert got == out and packed == plain and desks[0] == desks[1]
            assert [i for t in kept for i in t.column("final_update_id").to_pylist()] == [m[4] for m in waiting]


def test_a_batch_takes_a_bounded_number_of_frames(spark, tmp_path):
    path, sizes = feed_files(tmp_path / "in", [f"frame {i}" for i in range(230)]), []
    raw = live.frames(spark, "tapewright.streaming.live:recorded", {"a": {"path": path, "drop_every": 60}}, str(tmp_path / "journal"), drain=True, keep=True, most=100, **QUICK)
    q = raw.writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda b, _: sizes.append(b.count())).start()
    end = time.monotonic() + 60
    while sum(sizes) < 230 and time.monotonic() < end:
        time.sleep(0.1)
    q.stop()
    assert sizes == [100, 100, 30]


# --- what a crash leaves ---------------------------------------------------


def test_recorder_starts_again_after_a_crash_within_a_write(spark, make_candles, tmp_path):
    """A whole batch is saved, a half-written one deleted, with and without part files."""
    store, held = Store(spark, str(tmp_path / "s")), tmp_path / "held"
    store.migrate()
    rows = make_candles([100.0] * 9).selectExpr("*", "'rest' AS source")
    rules = recorder.RecordingRules(flush_rows=1000, flush_seconds=10_000)
    first = recorder.Flushes(store, CANDLE_TABLE, str(held), rules)
    first.take(rows.where("hour(open_time) < 4"), 3)
    (held / "4" / "_temporary").mkdir(parents=True)
    rows.where("hour(open_time) >= 4").write.parquet(str(held / "5"))
    (held / "5" / "_SUCCESS").unlink()
    again = recorder.Flushes(store, CANDLE_TABLE, str(held), rules)
    assert store.read(CANDLE_TABLE).count() == again.written == 4 and store.names(str(held)) == []
    again.take(rows.where("hour(open_time) >= 4"), 4)  # the stream gives it again
    again.flush()
    assert store.read(CANDLE_TABLE).count() == 9


def test_a_failed_consumer_ends_the_other(spark, tmp_path):
    path = feed_files(tmp_path / "in", [trade_frame(1, MS, 1.0), json.dumps({"stream": "btcusdt@depth@100ms", "data": {"E": 1}})])
    raw = live.frames(spark, "tapewright.streaming.live:recorded", {"a": {"path": path}}, str(tmp_path / "journal"), keep=True, **QUICK)
    store = Store(spark, str(tmp_path / "s"))
    store.migrate()
    with pytest.raises(Exception):
        recorder.record(spark, raw, desk_of(Exchange(1, ()), tmp_path / "answers"), BTC, store, str(tmp_path / "ck"), timeout=60)
    assert not spark.streams.active
