import io
import json
import zipfile
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from support import START
from tapewright.model import Instrument, Listing, Market, SourceKind, Timeframe, TimeRange
from tapewright.operators.bars import trades_to_candles
from tapewright.plans import ingest as ing
from tapewright.sources import columns, files, payloads, rest
from tapewright.sources.routing import route
from tapewright.sources.store import CANDLE_TABLE, TRADE_TABLE, Store
from tapewright.streaming import orderbook, recorder

BTC = Instrument("BTC/USDT", Market.SPOT, Timeframe("1h"))


def utc(*a):
    return datetime(*a, tzinfo=timezone.utc)


def zipped(path, name, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(name, text)


def kline(t_ms, close, micro=False):
    t = t_ms * 1000 if micro else t_ms
    return f"{t},1,2,0.5,{close},10,{t},100,7,4,40,0"


def test_names():
    assert BTC.native_symbol == "BTCUSDT" and BTC.storage_key == "spot_BTCUSDT_1h"
    with pytest.raises(ValueError):
        Timeframe("2h")
    with pytest.raises(ValueError):
        TimeRange(utc(2024, 1, 2), utc(2024, 1, 1))
    with pytest.raises(ValueError):
        TimeRange(datetime(2024, 1, 1), utc(2024, 1, 2))


def test_archive_planning():
    urls = files.kline_files(BTC, TimeRange(utc(2024, 1, 30), utc(2024, 4, 2)))
    assert [u.rsplit("-1h-", 1)[1] for u in urls] == ["2024-02.zip", "2024-03.zip", "2024-01-30.zip", "2024-01-31.zip", "2024-04-01.zip"]
    assert files.agg_trades_url(BTC.listing, date(2024, 1, 5)).endswith("/spot/daily/aggTrades/BTCUSDT/BTCUSDT-aggTrades-2024-01-05.zip")


def test_checksum():
    files.verify(b"abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad  x.zip")
    with pytest.raises(ValueError):
        files.verify(b"abd", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad  x.zip")


def test_downloader(spark, tmp_path):
    import hashlib

    origin, root = tmp_path / "origin", tmp_path / "mirror"
    for url in ("a.zip", "b.zip"):
        for name, content in ((url, url.encode()), (f"{url}.CHECKSUM", f"{hashlib.sha256(url.encode()).hexdigest()}  {url}".encode())):
            files.commit_file(*files.open_folder(str(origin / "x" / name)), content)
    (origin / "x" / "b.zip").write_bytes(b"damaged")
    (tmp_path / "calls").mkdir()

    def fetch(url, folder=str(tmp_path)):
        import os
        import uuid

        open(f"{folder}/calls/{uuid.uuid4().hex}", "w").close()
        path = url.replace(files.BASE_URL, f"{folder}/origin")
        return open(path, "rb").read() if os.path.exists(path) else None

    d, calls = files.Downloader(spark, str(root), fetch, tasks=3), lambda: len(list((tmp_path / "calls").iterdir()))
    urls = [f"{files.BASE_URL}/x/{n}.zip" for n in "nab"]
    assert d.all(urls[:2] * 2) == [d.path(urls[1])] * 2 and (root / "x" / "a.zip").read_bytes() == b"a.zip" and calls() == 3
    assert d.all(urls[1:2]) == [d.path(urls[1])] and calls() == 3
    with pytest.raises(ValueError, match="sha256"):
        d.all(urls)
    assert {r["url"][-5]: (r["bytes"], r["status"]) for r in d.mirror(spark.createDataFrame([(u,) for u in [*urls, None]], "url string")).collect()} == {"n": (None, "absent"), "a": (5, "there"), "b": (7, "damaged")}
    assert [p.name for p in (root / "x").iterdir()] == ["a.zip"] and d.all([]) == []
    again = files.Downloader(spark, f"file://{root}", fetch)
    assert again.all(urls[1:2]) == [f"file://{root}/x/a.zip"]


def test_racing_writers_leave_one_file(tmp_path):
    from threading import Barrier, Thread

    start = Barrier(8)

    def write(i):
        start.wait()
        for _ in range(20):
            files.commit_file(*files.open_folder(str(tmp_path / "y" / "one.zip")), bytes([i]) * 100_000)

    threads = [Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    (only,) = (tmp_path / "y").iterdir()
    assert only.name == "one.zip" and len(set(only.read_bytes())) == 1 and only.stat().st_size == 100_000


def test_verified_files(spark, tmp_path):
    import hashlib

    for name, good in (("a.zip", True), ("b.zip", False)):
        (tmp_path / name).write_bytes(name.encode())
        (tmp_path / f"{name}.CHECKSUM").write_text((hashlib.sha256(name.encode()).hexdigest() if good else "0" * 64) + f"  {name}\n")
    read = lambda glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in files.verified(read("*.zip"), read("*.CHECKSUM")).collect()] == ["a.zip"]


def test_archive_candles(spark, tmp_path):
    """Header, both epoch units, a missing day, and a period that cuts a file."""
    ms = int(utc(2024, 1, 1).timestamp() * 1000)
    urls = files.kline_files(BTC, TimeRange(utc(2024, 1, 1), utc(2024, 1, 4)))
    header = ",".join(files.KLINE_COLUMNS)
    for day, (url, text) in enumerate(zip(urls[:2], (f"{header}\n{kline(ms, 5)}\n{kline(ms + 3_600_000, 6)}\n", f"{kline(ms + 86_400_000, 7, True)}\n"))):
        zipped(tmp_path / url.removeprefix(files.BASE_URL + "/"), f"{day}.csv", text)
    got = files.archive_candles(spark, str(tmp_path), BTC, TimeRange(utc(2024, 1, 1, 1), utc(2024, 1, 4))).orderBy("open_time").collect()
    assert [(r["open_time"].replace(tzinfo=timezone.utc), r["close"], r["trade_count"]) for r in got] == [(utc(2024, 1, 1, 1), 6.0, 7), (utc(2024, 1, 2), 7.0, 7)]


def test_archive_trades(spark, tmp_path):
    url = files.agg_trades_url(BTC.listing, date(2024, 1, 1))
    ms = int(utc(2024, 1, 1, 5).timestamp() * 1000)
    zipped(tmp_path / url.removeprefix(files.BASE_URL + "/"), "t.csv", f"1,10.5,2,1,3,{ms},True,True\n1,10.5,2,1,3,{ms},True,True\n2,11,1,4,4,{ms},false,True\n")
    got = files.archive_trades(spark, str(tmp_path), BTC.listing, TimeRange(utc(2024, 1, 1), utc(2024, 1, 2))).orderBy("trade_id").collect()
    assert [(r["trade_id"], r["price"], r["last_trade_id"], r["buyer_is_maker"]) for r in got] == [(1, 10.5, 3, True), (2, 11.0, 4, False)]
    bad = spark.createDataFrame([("f", f"1,1,1,1,1,{ms},maybe,True")], "path string, line string")
    with pytest.raises(Exception, match="not a flag"):
        files.parse_agg_trades(bad, BTC.listing).collect()


def test_epoch_units(spark):
    x = spark.createDataFrame([("a", 1_700_000_000), ("b", 1_700_000_000_000), ("c", 1_700_000_000_000_000), ("c", 5)], "f string, e long")
    got = {(r["f"], r["e"]): r["t"].replace(tzinfo=timezone.utc) for r in columns.epoch_to_timestamp(x, "e", "t", by=("f",)).collect()}
    assert got["a", 1_700_000_000] == got["b", 1_700_000_000_000] == got["c", 1_700_000_000_000_000]
    assert got["c", 5] == utc(1970, 1, 1) + timedelta(microseconds=5)


def test_conform(spark):
    x = spark.createDataFrame([("BTC/USDT", float("nan"), 1)], "symbol string, close double, extra int")
    r = columns.conform_candles(x).first()
    assert r["close"] is None and r["trade_count"] is None and "extra" not in r.asDict()
    with pytest.raises(ValueError, match="trade_id"):
        columns.conform_trades(x)


PAGES = {"calls": []}


def fake_fetch(path, params):
    """Serves an hour's bars from START for 2,500 hours, with a repeated last bar."""
    start, end = params["startTime"], params["endTime"]
    first = int(START.timestamp() * 1000)
    rows = [[first + i * 3_600_000, "1", "2", "0.5", str(i), "10"] for i in range(2500)]
    page = [r for r in rows if start <= r[0] <= end][: params["limit"]]
    return page, 1


def test_rest_paging(spark):
    period = TimeRange(START, START + timedelta(hours=3000))
    got = rest.rest_candles(spark, "test_sources:fake_fetch", BTC, period)
    assert got.count() == 2500 and got.agg({"close": "max"}).first()[0] == 2499


def test_paging_stops_without_progress():
    stuck = lambda path, params: ([[params["startTime"] - 3_600_000, "1", "1", "1", "1", "1"]], 1)
    assert len(list(rest.pages(stuck, "X", "1h", 0, 10_000_000))) == 1


def test_rate_limit():
    slept, calls = [], []

    def flaky(path, params):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "ok", 1300

    limit = rest.RateLimit(sleep=slept.append, now=lambda: 30.0, seed=1)
    assert limit.call(flaky, "x", {}) == "ok" and len(slept) == 3 and slept[2] == 30.0 and slept[1] > slept[0] * 0.9
    with pytest.raises(OSError):
        rest.RateLimit(sleep=slept.append).call(lambda p, q: (_ for _ in ()).throw(OSError()), "x", {})
    guard, times = rest.SnapshotGuard(sleep=slept.append, now=iter([0.0, 0.5, 2.0]).__next__), len(slept)
    guard.wait(), guard.wait()
    assert slept[times:] == [1.5] and [rest.snapshot_weight(d) for d in (100, 500, 1000, 5000)] == [5, 25, 50, 250]


class Clock:
    """A task's own time: sleeping moves it, and so does a request."""

    def __init__(self, at):
        self.at = at

    def sleep(self, seconds):
        assert seconds > 0
        self.at += seconds


@pytest.mark.parametrize("tasks, weight, budget", [(1, 2, 1200), (7, 2, 1200), (64, 2, 1200), (600, 2, 1200), (1500, 2, 1200), (13, 250, 1200), (3, 7, 20), (5, 20, 20)])
def test_one_budget_over_all_tasks(tasks, weight, budget):
    """What tasks send that know nothing of each other, with failures and slow answers, and some run twice."""
    import random
    from collections import Counter

    r, seen, done = random.Random(tasks), Counter(), 0
    for n, lease in enumerate(rest.leases(tasks, weight, budget)):
        clock = Clock(1_700_000_000 + r.random() * 50)

        def fetch(path, params, clock=clock):
            seen[int(clock.at // 60)] += weight
            clock.at += r.random() * 3
            if r.random() < 0.2:
                raise OSError
            return "page", 0

        for attempt in range(2 if n % 5 == 0 else 1):  # the second attempt starts in the minute in which the first was lost
            limit = rest.LeasedLimit(lease, weight, anew=attempt > 0, sleep=clock.sleep, now=lambda clock=clock: clock.at, attempts=50, base=0.01)
            for _ in range(r.randrange(3, 12)):
                done += limit.call(fetch, "klines", {}) == "page"
    assert max(seen.values()) <= budget and done >= 3 * tasks
    if tasks < 3:
        assert len(seen) <= 4  # and it doesn't idle


def test_budget_that_pays_nothing():
    with pytest.raises(ValueError):
        rest.leases(3, 30, 20)
    assert {(x.share, x.cycle) for x in rest.leases(8, 2, 1200)} == {(150, 1)} and [x.turn for x in rest.leases(4, 10, 20)] == [0, 1, 0, 1]


def test_pages_are_dealt_with_their_leases():
    reader = rest._KlineReader({"start": "0", "end": str(3_600_000 * 9_500), "interval": "1h", "tasks": "4"})
    parts = reader.partitions()
    assert [(p.start // 3_600_000, p.end // 3_600_000) for p in parts] == [(0, 3000), (3000, 6000), (6000, 9000), (9000, 9500)]
    assert sum(p.lease.share for p in parts) <= rest.WEIGHT_LIMIT
    assert len(rest._KlineReader({"start": "5", "end": "5", "interval": "1h"}).partitions()) == 1


def test_reference_closes(spark):
    ms = int(START.timestamp() * 1000)
    got = rest.reference_closes(spark, {"prices": [[ms, 1.0], [ms + 1000, 2.0], [ms + 86_400_000, 3.0]]}).orderBy("day").collect()
    assert [r["close"] for r in got] == [2.0, 3.0]


def test_routing():
    now = utc(2024, 1, 10, 5)
    kinds = lambda a, b: [(i.kind, i.period.start.day, i.period.end.day) for i in route(TimeRange(a, b), now)]
    assert kinds(utc(2024, 1, 1), utc(2024, 1, 10)) == [(SourceKind.ARCHIVE, 1, 8), (SourceKind.REST, 8, 10)]
    assert kinds(utc(2024, 1, 9), utc(2024, 1, 10)) == [(SourceKind.REST, 9, 10)]
    assert kinds(utc(2024, 1, 1), utc(2024, 1, 2)) == [(SourceKind.REST, 1, 2)]
    assert kinds(utc(2024, 1, 1), utc(2024, 1, 1)) == []


def test_routed_rows_equal_routed_ranges(spark):
    import random

    r, now, periods = random.Random(2), utc(2024, 3, 10, 5), []
    for i in range(200):
        a = utc(2024, 1, 1) + timedelta(hours=r.randrange(1900))
        periods.append((i, a, a + timedelta(hours=r.choice([0, 1, 30, 47, 48, 49, 200, 2000]))))
    from tapewright.sources.routing import route_table

    rows = route_table(spark.createDataFrame(periods, "id int, start timestamp, end timestamp"), now).collect()
    want = [(i, part.kind.value, part.period.start, part.period.end) for i, a, b in periods for part in route(TimeRange(a, b), now)]
    assert sorted((x["id"], x["source"], x["start"].replace(tzinfo=timezone.utc), x["end"].replace(tzinfo=timezone.utc)) for x in rows) == sorted(want)


def test_spans_by_month(spark):
    """Many gaps give a row a month and source; neighbouring months join."""
    now, hour = utc(2024, 6, 1), Timeframe("1h")
    times = [utc(2024, 1, 10) + timedelta(hours=h) for h in range(60)] + [utc(2024, 1, 20, h) for h in range(0, 24, 2)] + [utc(2024, 2, 28) + timedelta(hours=h) for h in range(80)] + [utc(2024, 5, 31, 22)]
    got = ing.spans(spark.createDataFrame([(t,) for t in times], "open_time timestamp"), hour, now)
    assert got[SourceKind.ARCHIVE] == [TimeRange(utc(2024, 1, 10), utc(2024, 1, 12, 12)), TimeRange(utc(2024, 2, 28), utc(2024, 3, 2, 8))]
    assert got[SourceKind.REST] == [TimeRange(utc(2024, 1, 20), utc(2024, 1, 20, 23)), TimeRange(utc(2024, 5, 31, 22), utc(2024, 5, 31, 23))]
    assert ing.spans(spark.createDataFrame([], "open_time timestamp"), hour, now) == {}


def test_store_is_idempotent(spark, make_candles, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert set(store.migrate()) == {"candles", "candles_5m", "candles_1h", "agg_trades", "order_book_depth"} and store.migrate() == []
    c = make_candles([1, 2, 3]).selectExpr("*", "'rest' source")
    assert store.save(CANDLE_TABLE, c) == 3 and store.save(CANDLE_TABLE, c) == 0
    more = make_candles([9, 9, 9, 4]).selectExpr("*", "'archive' source")
    assert store.save(CANDLE_TABLE, more) == 1
    got = store.read(CANDLE_TABLE, BTC, TimeRange(START, START + timedelta(hours=10)))
    assert [r["close"] for r in got.orderBy("open_time").collect()] == [1, 2, 3, 4]
    assert store.existing_open_times(BTC, TimeRange(START, START + timedelta(hours=2))).count() == 2
    assert store.latest_trade_id(BTC.listing) is None


def test_rollup_refresh(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.migrate()
    rows = [("BTC/USDT", "spot", "1m", START + timedelta(minutes=i), 1.0 + i, 2.0 + i, 0.5, 1.5 + i, 1.0, 2) for i in range(120)]
    c = spark.createDataFrame(rows, "symbol string, market string, timeframe string, open_time timestamp, open double, high double, low double, close double, volume double, trade_count long")
    store.save(CANDLE_TABLE, c)
    period = TimeRange(START, START + timedelta(hours=2))
    assert store.refresh(Timeframe("1h"), period) == 2 and store.refresh(Timeframe("1h"), period) == 2
    got = store.read(store.candle_table(Timeframe("1h")), BTC, period).orderBy("open_time").collect()
    assert [(r["open"], r["close"], r["trade_count"]) for r in got] == [(1.0, 60.5, 120), (61.0, 120.5, 120)]


MINUTES = "symbol string, market string, timeframe string, open_time timestamp, open double, high double, low double, close double, volume double, trade_count long"


def minutes(spark, spans, price=1.0, symbol="BTC/USDT"):
    """One-minute candles from START, by spans of minutes."""
    rows = [(symbol, "spot", "1m", START + timedelta(minutes=i), price + i, price + i + 1, price + i - 1, price + i, 1.0, 2) for a, b in spans for i in range(a, b)]
    return spark.createDataFrame(rows, MINUTES)


def test_touched_days_alone_are_rolled_up(spark, tmp_path):
    store, hour, day = Store(spark, str(tmp_path / "s")), Timeframe("1h"), 1440
    store.migrate()
    table = store.candle_table(hour)
    bars = lambda df: sorted(map(repr, df.collect()))
    from tapewright.operators.bars import continuous_aggregate

    def agrees():
        want = bars(columns.conform(continuous_aggregate(store.read(CANDLE_TABLE), hour), table.schema))
        return bars(store.read(table)) == want

    def stamps():
        return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "s" / table.name).rglob("*.parquet")}

    store.save(CANDLE_TABLE, minutes(spark, [(0, 90), (day, day + 30), (5 * day, 5 * day + 200)]).unionByName(minutes(spark, [(0, 10)], symbol="ETH/USDT")))
    assert store.touched(hour).count() == 4 and store.touched(Timeframe("5m")).count() == 4
    assert bars(store.rolled_up(hour)) != [] and store.read(table).count() == 0  # computed where nothing is stored yet
    assert store.refresh_touched(hour) == 4 and agrees() and store.refresh_touched(hour) == 0
    before = stamps()

    # one day changes: no other file is written again
    assert store.save(CANDLE_TABLE, minutes(spark, [(day, day + 70)])) == 40
    assert not agrees() and bars(store.rolled_up(hour)) == bars(columns.conform(continuous_aggregate(store.read(CANDLE_TABLE), hour), table.schema))
    assert store.refresh_touched(hour) == 1 and agrees()
    changed = {p for p in stamps() if p not in before}
    assert changed and all("date=2024-01-02" in p for p in changed) and len(set(before) - set(stamps())) == 1

    # minutes go: some of a day's bars, and a whole day
    assert store.remove(CANDLE_TABLE, minutes(spark, [(0, 60), (5 * day, 6 * day)])) == 260
    assert store.remove(CANDLE_TABLE, minutes(spark, [(0, 60)])) == 0
    assert store.read(CANDLE_TABLE).count() == 110 and not agrees()
    assert store.refresh_touched(hour, TimeRange(START, START + timedelta(days=1))) == 1 and not agrees()  # the other day stays noted
    assert [r["date"].isoformat() for r in store.touched(hour).collect()] == ["2024-01-06"]
    assert store.refresh_touched(hour) == 1 and agrees() and store.touched(hour).count() == 0
    assert store.touched(Timeframe("5m")).count() == 4  # each roll-up has its own notes
    assert store.refresh_touched(Timeframe("5m")) == 4

    # candles of other timeframes touch nothing; a full refresh removes what is gone as well
    store.save(CANDLE_TABLE, minutes(spark, [(7 * day, 7 * day + 5)]).withColumn("timeframe", F.lit("1h")))
    assert store.touched(hour).count() == 0
    store.remove(CANDLE_TABLE, minutes(spark, [(day, 2 * day)]))
    store.refresh(hour, TimeRange(START, START + timedelta(days=9)))
    assert agrees()
    with pytest.raises(ValueError):
        store.refresh_touched(Timeframe("1d"))


def test_half_written_notes_count_for_nothing(spark, tmp_path):
    store, hour = Store(spark, str(tmp_path / "s")), Timeframe("1h")
    store.migrate()
    store.save(CANDLE_TABLE, minutes(spark, [(0, 5)]))
    (tmp_path / "s" / "touched" / "1h" / "half" / "_temporary").mkdir(parents=True)
    assert store.touched(hour).count() == 1 and store.refresh_touched(hour) == 1 and store.touched(hour).count() == 0


def test_ingest_fills_gaps_and_isolates_failures(spark, make_candles, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.migrate()
    full = make_candles([100 + i % 3 for i in range(72)])
    store.save(CANDLE_TABLE, full.limit(0).unionByName(full.where("hour(open_time) < 20")).selectExpr("*", "'rest' source"))
    inside = lambda i, p: full.where((full.open_time >= p.start) & (full.open_time < p.end))
    eth = Instrument("ETH/USDT", Market.SPOT, Timeframe("1h"))

    def loader(i, p):
        if i == eth:
            raise RuntimeError("down")
        return inside(i, p)

    period, now = TimeRange(START, START + timedelta(hours=72)), START + timedelta(hours=80)
    reports = ing.ingest(spark, store, [BTC, eth], period, now, {SourceKind.ARCHIVE: loader, SourceKind.REST: loader})
    assert (reports[0].expected, reports[0].before, reports[0].after, reports[0].ok) == (72, 60, 72, True)
    assert not reports[1].ok and "down" in reports[1].failure


def trade_frame(i, t_ms, price):
    return json.dumps({"stream": "btcusdt@aggTrade", "data": {"e": "aggTrade", "E": t_ms, "T": t_ms, "a": i, "f": i, "l": i, "p": str(price), "q": "2", "m": False}})


def update_frame(first, final, t_ms, bids, asks):
    return json.dumps({"stream": "btcusdt@depth@100ms", "data": {"e": "depthUpdate", "E": t_ms, "U": first, "u": final, "b": bids, "a": asks}})


def test_payloads(spark):
    ms = int(START.timestamp() * 1000)
    f = spark.createDataFrame([(trade_frame(7, ms, 1.5),)], "value string")
    r = payloads.agg_trades(f).first()
    assert (r["trade_id"], r["price"], r["quantity"], r["buyer_is_maker"], r["transact_time"].replace(tzinfo=timezone.utc)) == (7, 1.5, 2.0, False, START)
    u = payloads.depth_updates(spark.createDataFrame([(update_frame(5, 9, ms, [["1.0", "2"]], []),)], "value string")).first()
    assert (u["first_update_id"], u["final_update_id"], u["bids"][0]["price"], u["asks"]) == (5, 9, 1.0, [])
    s = payloads.snapshots(spark.createDataFrame([(json.dumps({"lastUpdateId": 3, "bids": [["1", "2"]], "asks": []}),)], "value string")).first()
    assert s["last_update_id"] == 3
    with pytest.raises(Exception):
        payloads.agg_trades(spark.createDataFrame([('{"T": 1}',)], "value string")).collect()
    assert payloads.stream_url(BTC.listing, ("aggTrade",)).endswith("/stream?streams=btcusdt@aggTrade")


@pytest.mark.parametrize("local, first, final, syncing, want", [
    (100, 95, 105, True, "apply"), (100, 90, 100, True, "discard"), (100, 101, 110, True, "apply"), (100, 102, 110, True, "resynchronize"), (100, 50, 99, False, "discard"),
    (100, 101, 105, False, "apply"), (100, 99, 105, False, "resynchronize"), (100, 103, 110, False, "resynchronize"), (100, 100, 100, False, "discard"),
])
def test_sequence(local, first, final, syncing, want):
    assert orderbook.decide(local, first, final, syncing) == want


def test_book_summary():
    b = orderbook.Book()
    level = lambda *x: [{"price": float(p), "quantity": float(q)} for p, q in x]
    b.restart(10, level(*[(100 - i, 1) for i in range(25)]), level(*[(101 + i, 2) for i in range(25)]))
    b.update(11, 12, level((100, 0), (50, 3)), level((101, 5)))
    assert b.summary() == [99.0, 101.0, 5.0, 13.0, 10.0, 23.0, 20.0, 43.0]
    assert b.update(20, 21, [], []) == "resynchronize" and b.last_update_id is None and b.update(22, 23, [], []) == "discard"


def test_recording_equals_replay(spark, tmp_path):
    ms = int(START.timestamp() * 1000)
    lines = [trade_frame(i, ms + i * 700, 100 + i) for i in range(20)] + [update_frame(i * 2 + 1, i * 2 + 2, ms + i * 400, [[str(100 - i), "1"]], [[str(200 + i), "1"]]) for i in range(1, 20) if i != 12]
    (tmp_path / "f" / "stream").mkdir(parents=True)
    (tmp_path / "f" / "snapshots").mkdir()
    (tmp_path / "f" / "stream" / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "f" / "snapshots" / "a.txt").write_text(json.dumps({"lastUpdateId": 2, "bids": [["99", "4"]], "asks": [["201", "4"]]}) + "\n")
    from pyspark.sql import functions as F

    def shots(df):
        return payloads.snapshots(df).withColumns({"symbol": F.lit("BTC/USDT"), "market": F.lit("spot"), "seq": F.col("last_update_id")})

    store = Store(spark, str(tmp_path / "s"))
    store.migrate()
    raw = lambda: recorder.frames(spark, str(tmp_path / "f" / "stream"))
    n = recorder.record(spark, raw(), shots(recorder.frames(spark, str(tmp_path / "f" / "snapshots"))), BTC.listing, store, str(tmp_path / "ck"), once=True)
    stored = spark.read.text(str(tmp_path / "f" / "stream"))
    want = orderbook.replay(orderbook.messages(recorder.update_stream(stored, BTC.listing), shots(spark.read.text(str(tmp_path / "f" / "snapshots")))))
    assert n["trades"] == 20 and n["depth"] == want.count() > 2
    # a second recording of the same frames adds nothing
    again = recorder.record(spark, raw(), shots(recorder.frames(spark, str(tmp_path / "f" / "snapshots"))), BTC.listing, store, str(tmp_path / "ck2"), once=True)
    assert (again["trades"], again["depth"]) == (0, 0)
    counters = want.orderBy("captured_at").collect()[-1]
    assert all(again[c] == n[c] == counters[c] for c in recorder.COUNTERS) and n["applied"] > 0
    assert store.names(str(tmp_path / "ck" / "trades" / "held")) == []
    bars = trades_to_candles(store.read(TRADE_TABLE, BTC.listing), Timeframe("1m")).first()
    assert (bars["open"], bars["close"], bars["trade_count"]) == (100.0, 119.0, 20)


def test_flush_by_rows_and_by_time(spark, make_candles, tmp_path):
    store, at = Store(spark, str(tmp_path / "s")), [0.0]
    store.migrate()
    flushes = recorder.Flushes(store, CANDLE_TABLE, str(tmp_path / "held"), recorder.RecordingRules(flush_rows=5, flush_seconds=30), lambda: at[0])
    rows = make_candles([100.0] * 12).selectExpr("*", "'rest' AS source")
    first = lambda a, b: rows.where(f"hour(open_time) >= {a} and hour(open_time) < {b}")
    flushes.take(first(0, 3), 0)
    assert store.read(CANDLE_TABLE).count() == 0 and store.names(str(tmp_path / "held")) == ["0"]
    flushes.take(first(0, 3), 0)  # a replay replaces itself
    assert store.read(CANDLE_TABLE).count() == 0
    flushes.take(first(3, 5), 1)  # five rows
    assert store.read(CANDLE_TABLE).count() == flushes.written == 5
    flushes.take(first(5, 6), 2)
    at[0] = 31.0
    flushes.take(first(6, 7), 3)
    assert store.read(CANDLE_TABLE).count() == flushes.written == 7 and store.names(str(tmp_path / "held")) == []


def test_compaction_of_closed_days(spark, make_candles, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.migrate()
    rows = make_candles([100.0 + i for i in range(60)]).selectExpr("*", "'rest' AS source")
    for part in range(3):
        store.save(CANDLE_TABLE, rows.where(f"hour(open_time) % 3 = {part}"))
    want = sorted(map(repr, store.read(CANDLE_TABLE).collect()))
    assert store.compact(CANDLE_TABLE, (START + timedelta(days=2)).date()) == 2
    assert sorted(map(repr, store.read(CANDLE_TABLE).collect())) == want
    files = store.read(CANDLE_TABLE).selectExpr("date(open_time) AS day", "input_file_name() AS f").groupBy("day").agg({"f": "approx_count_distinct"}).collect()
    assert sorted(r[1] for r in files) == [1, 1, 3] and store.compact(CANDLE_TABLE, START.date() + timedelta(days=2)) == 0


def test_compaction_by_age(spark, make_candles, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.migrate()
    rows = make_candles([100.0 + i for i in range(60)]).selectExpr("*", "'rest' AS source")
    for part in range(2):
        store.save(CANDLE_TABLE, rows.where(f"hour(open_time) % 2 = {part}"))
    want = sorted(map(repr, store.read(CANDLE_TABLE).collect()))
    assert store.compact_aged(START + timedelta(days=30)) == {"candles": 0}
    assert store.compact_aged(START + timedelta(days=31)) == {"candles": 1} and store.compact_aged(START + timedelta(days=31)) == {"candles": 0}
    assert sorted(map(repr, store.read(CANDLE_TABLE).collect())) == want


def test_reads_are_pruned_by_listing_and_day(spark, tmp_path):
    """A read of one listing and day opens that day's files alone, and the latest trade id those of its listing."""
    store, t = Store(spark, str(tmp_path / "s")), "symbol string, market string, trade_id long, transact_time timestamp, price double, quantity double, first_trade_id long, last_trade_id long, buyer_is_maker boolean"
    store.migrate()
    rows = [(s, "spot", i, START + timedelta(hours=i), 1.0, 1.0, i, i, True) for s in ("BTC/USDT", "ETH/USDT") for i in range(96)]
    store.save(TRADE_TABLE, spark.createDataFrame(rows, t))
    day = TimeRange(START + timedelta(days=1), START + timedelta(days=2))
    for df, partitions in ((store.read(TRADE_TABLE, BTC.listing, day), 1), (store.read(TRADE_TABLE, BTC.listing), 4), (store.read(TRADE_TABLE), 8)):
        df.collect()
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert scan.metrics().apply("numPartitions").value() == partitions
    assert store.latest_trade_id(BTC.listing) == 95
    plan = store.read(TRADE_TABLE, BTC.listing, day).select("trade_id", "price")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ReadSchema: struct<trade_id:bigint,transact_time:timestamp,price:double>" in plan and "GreaterThanOrEqual(transact_time" in plan


def test_live_candles(spark, tmp_path):
    ms = int(START.timestamp() * 1000)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.txt").write_text("\n".join(trade_frame(i, ms + i * 60_000, i) for i in range(120)) + "\n" + trade_frame(5, ms + 5 * 60_000, 5) + "\n")
    live = recorder.live_candles(recorder.trade_stream(recorder.frames(spark, str(tmp_path / "a")), BTC.listing), Timeframe("1h"))
    q = live.writeStream.format("memory").queryName("live_bars").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("live_bars").collect()
    assert len(got) == 1 and got[0]["trade_count"] == 60


def test_zip_reader_takes_plain_text():
    from tapewright.sources.files import _lines
    import pyarrow as pa

    out = list(_lines([pa.RecordBatch.from_arrays([pa.array(["p"]), pa.array([b"a\nb"])], ["path", "content"])]))
    assert out[0].column(1).to_pylist() == ["a", "b"] and io is not None


def test_cli(spark, make_candles, tmp_path, capsys):
    from tapewright import cli

    store = Store(spark, str(tmp_path / "s"))
    store.migrate()
    import math

    c = make_candles([100 + 10 * math.sin(i / 11) for i in range(300)], trade_count=[1 + i % 17 for i in range(300)]).selectExpr("*", "'rest' source")
    store.save(store.candle_table(Timeframe("1h")), c)
    base = ["--store", str(tmp_path / "s"), "--start", "2024-01-01", "--end", "2024-02-01"]
    for name in ("crossover", "vwap", "activity", "smoothing-comparison", "backtest", "signals-report", "relative-strength"):
        assert cli.main([name, *base]) == 0
    assert "look-ahead" in capsys.readouterr().out


def test_listing_identity():
    assert Listing("eth/usdt", Market.USDM).native_symbol == "ETHUSDT"


def test_handover_equals_each_capture():
    import random

    r = random.Random(3)
    for _ in range(300):
        times = [r.randrange(60) for _ in range(r.randrange(12))]
        times = sorted(times) if r.random() < 0.5 else times
        step = r.randrange(1, 20)
        most = r.randrange(70)
        until, after = orderbook.handover(times, step, most)
        assert until == sorted(until) and len(until) == len(after)
        for start in range(most + 1):
            due = start
            for t in times:
                due = t + step if t >= due else due
            at = next((i for i, u in enumerate(until) if u >= start), None)
            assert (start if at is None else after[at]) == due


def test_replay_by_epochs_equals_one_pass(spark, monkeypatch):
    import random

    monkeypatch.setattr(orderbook, "_BLOCK", 16)
    r, rows = random.Random(8), []
    for symbol in ("A", "B"):
        last, now = 0, 0
        for seq in range(400):
            level = [(float(r.randrange(1, 30)), float(r.randrange(3)))]
            if r.random() < 0.05:
                rows.append((symbol, "spot", seq, "snapshot", None, None, last, level, [(40.0, 1.0)]))
            now += r.randrange(0, 900_000)
            first, last = last + 1 + (r.random() < 0.03), last + 3
            rows.append((symbol, "spot", seq, "update", datetime.fromtimestamp(now / 1e6, timezone.utc), first, last, level, [(41.0, 2.0)]))
    r.shuffle(rows)
    stored = spark.createDataFrame(rows, orderbook.MESSAGE).repartition(4)
    got = sorted(tuple(x) for x in orderbook.replay(stored).collect())
    want = []
    for symbol in ("A", "B"):
        one = stored.where(F.col("symbol") == symbol).toPandas()
        want += [(symbol, "spot", *x) for x in orderbook.process(orderbook.Book(), one, 1_000_000)]
    assert orderbook.handover([5, 6, 90], 10, None) == ([5], [100])
    assert len(got) > 50 and [x[3:] for x in got] == [tuple(x[3:]) for x in sorted(want)]


def test_stored_keys_are_read_within_the_batch_s_time(spark, tmp_path, monkeypatch):
    """A batch of a few minutes doesn't read what the day already holds."""
    from tapewright.sources import store as stored

    def trades(first, n):
        return spark.range(first, first + n).selectExpr("'BTC/USDT' symbol", "'spot' market", "timestamp_seconds(1704067200 + id) transact_time", "id trade_id", "1.0D price", "1.0D quantity", "id first_trade_id", "id last_trade_id", "true buyer_is_maker")

    seen, real = [], stored.new_rows

    def counted(batch, target, key, *order):
        seen.append(target.count())
        return real(batch, target, key, *order)

    monkeypatch.setattr(stored, "new_rows", counted)
    s = Store(spark, str(tmp_path))
    s.migrate()
    assert [s.save(TRADE_TABLE, trades(0, 1000)), s.save(TRADE_TABLE, trades(900, 200)), s.save(TRADE_TABLE, trades(2000, 10))] == [1000, 100, 10]
    assert seen == [0, 100, 0] and s.read(TRADE_TABLE).count() == 1110


def test_frames_are_parsed_once(spark):
    """However many columns and checks ask for a message's fields."""
    frames = spark.createDataFrame([("{}",)], "value string")
    for parsed in (payloads.depth_updates(frames), payloads.agg_trades(frames)):
        plan = parsed._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("$.data") == 1
