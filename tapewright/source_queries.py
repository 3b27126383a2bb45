"""Queries that go through sources, the store, streams and specifications, and their SQL."""

from __future__ import annotations

import io
import zipfile
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import views
from .functions.indicators import sma
from .functions.windows import KEYS, ordered
from .model import ConditionTree, Instrument, Listing, Market, SourceKind, Timeframe, TimeRange
from .operators import merge, quality
from .plans import ingest as filling
from .plans.strategy import ConditionAxis, FeatureAxis, Increasing, SearchSpace
from .queries import _LEVELS_SQL, BAR, BAR_SQL, D, HOUR, ORACLES, T, C, _bars, _candles, _expected, _trades, book_sql, ntz, q, query, r, shipped
from .session import workspace
from .sources import columns as cols, files, payloads, rest
from .sources.routing import route_table
from .sources.store import CANDLE_TABLE, CANDLES_1H, DEPTH_TABLE, TRADE_TABLE, Store, write_gaps, write_with_identity
from .streaming import keeper, live, recorder
from .views import sql_candles

ALL = Instrument("ALL/USDT", Market.SPOT, HOUR)
TRADE_SQL = f"WITH {T} SELECT trade_id, transact_time, {q('price')} AS price, quantity, first_trade_id, last_trade_id, buyer_is_maker FROM trades"


def _plain_trades(t: DataFrame) -> DataFrame:
    return t.select("trade_id", ntz("transact_time"), r("price").alias("price"), "quantity", "first_trade_id", "last_trade_id", "buyer_is_maker")


def _utc(t: datetime) -> datetime:
    return t.astimezone(timezone.utc) if t.tzinfo else t.replace(tzinfo=timezone.utc)


def _span(df: DataFrame, time: str) -> tuple[datetime, datetime]:
    """First and last moment of a table: two values."""
    low, high = df.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    return tuple(datetime.fromtimestamp(x / 1e6, timezone.utc) for x in (low, high))


# --- archive files -----------------------------------------------------------


def _zipped(lines: DataFrame) -> DataFrame:
    """``path, content``: a zip archive of the lines of each path, in the order of ``n``."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("rows.csv", "\n".join(pdf.sort_values("n")["line"]) + "\n")
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [raw.getvalue()]})

    return lines.groupBy("path").applyInPandas(pack, "path string, content binary")


@query(f"WITH {C} SELECT symbol, market, open_time, {BAR_SQL}, trade_count FROM candles")
def archive_klines(s, d):
    """Candles written as zipped files of a day, some with a header and in microseconds, and parsed again."""
    us, day = F.unix_micros("open_time"), F.dayofmonth("open_time")
    x = _candles(s, d).withColumns({"path": F.date_format("open_time", "yyyy-MM-dd"), "n": us})
    epoch = F.when(day % 2 == 0, us).otherwise(F.floor(us / 1000))
    cells = [epoch, *BAR[:5], F.lit("0"), "quote_volume", "trade_count", "taker_buy_base_volume", "taker_buy_quote_volume", F.lit("0")]
    lines = x.select("path", "n", F.concat_ws(",", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cells]).alias("line"))
    head = x.where(day % 3 == 0).select("path").distinct().select("path", F.lit(0).cast("long").alias("n"), F.lit(",".join(files.KLINE_COLUMNS)).alias("line"))
    parsed = files.parse_klines(files.lines_of(_zipped(lines.unionByName(head))), ALL)
    return _bars(cols.conform_candles(merge.keep_first(parsed, merge.CANDLE_KEY, F.lit(0))))


@query(TRADE_SQL)
def archive_agg_trades(s, d):
    """Trades written as zipped files of a day, some rows in two of them, and parsed again."""
    us = F.unix_micros("transact_time")
    x = _trades(s, d).withColumns({"path": F.date_format("transact_time", "yyyy-MM-dd"), "n": us})
    flag = F.when(F.col("trade_id") % 2 == 0, F.initcap(F.col("buyer_is_maker").cast("string"))).otherwise(F.col("buyer_is_maker").cast("string"))
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "n")], flag, F.lit("True")).alias("line")
    again = x.where("trade_id % 5 = 0").withColumn("path", F.concat("path", F.lit("-late")))
    lines = x.unionByName(again).select("path", "n", line)
    parsed = files.parse_agg_trades(files.lines_of(_zipped(lines)), ALL.listing)
    return _plain_trades(cols.conform_trades(merge.keep_first(parsed, merge.TRADE_KEY, F.col("transact_time"))))


@query(f"""WITH {T}, p AS (SELECT venue AS symbol, date_trunc('hour', min(transact_time)) AS a, date_trunc('hour', max(transact_time)) + INTERVAL 60 DAY AS b FROM trades GROUP BY venue),
days AS (SELECT symbol, a, b, CAST(unnest(generate_series(CAST(a AS DATE), CAST(b - INTERVAL 1 MICROSECOND AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM p),
m AS (SELECT *, date_trunc('month', day) >= CAST(a AS DATE) AND date_trunc('month', day) + INTERVAL 1 MONTH - INTERVAL 1 DAY < CAST(b AS DATE) AS whole FROM days),
k AS (SELECT DISTINCT symbol, CASE WHEN whole THEN 'monthly' ELSE 'daily' END AS period, CASE WHEN whole THEN strftime(day, '%Y-%m') ELSE strftime(day, '%Y-%m-%d') END AS stamp FROM m)
SELECT symbol, 'klines' AS kind, '{files.BASE_URL}/futures/um/' || period || '/klines/' || upper(symbol) || '/1h/' || upper(symbol) || '-1h-' || stamp || '.zip' AS url FROM k
UNION ALL SELECT symbol, 'aggTrades', '{files.BASE_URL}/spot/daily/aggTrades/' || upper(symbol) || '/' || upper(symbol) || '-aggTrades-' || strftime(day, '%Y-%m-%d') || '.zip' FROM days""")
def archive_plan(s, d):
    """The files of each symbol's period, from its first trade to 60 days after its last one."""
    c = views.candles(_venues(s, d))
    rows = []
    for p in c.groupBy("symbol").agg(F.min(F.unix_micros("open_time")), F.max(F.unix_micros("open_time"))).collect():  # a row a listing
        first, last = (datetime.fromtimestamp(x / 1e6, timezone.utc) for x in p[1:])
        period = TimeRange(first, last + timedelta(days=60))
        rows += [(p[0], "klines", u) for u in files.kline_files(Instrument(p[0], Market.USDM, HOUR), period)] + [(p[0], "aggTrades", u) for u in files.agg_trade_files(Listing(p[0], Market.SPOT), period)]
    return s.createDataFrame(rows, "symbol string, kind string, url string")


@query(f"""WITH {T}, c AS (SELECT DISTINCT venue AS symbol, date_trunc('hour', transact_time) AS open_time FROM trades), h AS (SELECT * FROM c WHERE day(open_time) NOT IN (5, 6, 7, 8, 27, 28, 29)),
p AS (SELECT min(open_time) AS a, max(open_time) AS b, date_trunc('day', max(open_time)) - INTERVAL 2 DAY AS cutoff FROM c),
e AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS open_time FROM (SELECT DISTINCT symbol FROM c), p), m AS (SELECT * FROM e ANTI JOIN h USING (symbol, open_time)),
i AS (SELECT *, epoch(open_time) - 3600 * row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS island FROM m),
g AS (SELECT symbol, min(open_time) AS first, max(open_time) + INTERVAL 1 HOUR AS last FROM i GROUP BY symbol, island),
l AS (SELECT g.*, cutoff, last - first >= INTERVAL 48 HOUR AND first < cutoff AS long FROM g, p)
SELECT symbol, 'archive' AS source, first, least(last, cutoff) AS last FROM l WHERE long
UNION ALL SELECT symbol, 'rest', CASE WHEN long THEN greatest(first, cutoff) ELSE first END, last FROM l WHERE NOT long OR last > cutoff""")
def source_routing(s, d):
    """Where the missing bars of each symbol are to come from: its gaps, with two stretches of days lost, routed as rows."""
    c = views.candles(_venues(s, d))
    first, last = _span(c, "open_time")
    expected = c.select(*KEYS).distinct().select(*KEYS, F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 HOUR"))).alias("open_time"))
    there = c.where(~F.dayofmonth("open_time").isin(5, 6, 7, 8, 27, 28, 29))
    gaps = quality.gaps(expected.join(there.select(*KEYS, "open_time"), [*KEYS, "open_time"], "left_anti"), HOUR, KEYS)
    x = route_table(gaps.select("symbol", F.col("gap_start").alias("first"), (F.col("gap_end") + F.expr("INTERVAL 1 HOUR")).alias("last")), last, "first", "last")
    return x.select("symbol", "source", ntz("first"), ntz("last"))


# --- messages ----------------------------------------------------------------


def _trade_frames(t: DataFrame, *keep: str) -> DataFrame:
    """Frames of a combined stream: each trade, and a book update of the same id between them."""
    ms = F.floor(F.unix_micros("transact_time") / 1000)
    data = F.to_json(F.struct(F.lit("aggTrade").alias("e"), ms.alias("T"), F.col("trade_id").alias("a"), F.col("first_trade_id").alias("f"), F.col("last_trade_id").alias("l"), F.col("price").cast("string").alias("p"), F.col("quantity").cast("string").alias("q"), F.col("buyer_is_maker").alias("m")))
    trade = F.concat(F.lit('{"stream":"allusdt@aggTrade","data":'), data, F.lit("}"))
    i = F.col("trade_id").cast("string")
    levels = F.concat(F.lit('"b":[["'), F.floor("price").cast("string"), F.lit('","'), (F.col("trade_id") % 5).cast("string"), F.lit('"]],"a":[]'))
    update = F.concat(F.lit('{"stream":"allusdt@depth@100ms","data":{"e":"depthUpdate","E":'), ms.cast("string"), F.lit(',"U":'), i, F.lit(',"u":'), (F.col("trade_id") + 1).cast("string"), F.lit(","), levels, F.lit("}}"))
    return t.select(*keep, F.explode(F.array(trade, update, F.lit(None).cast("string"))).alias("value"))


_MS_SQL = f"WITH {T} SELECT trade_id, date_trunc('millisecond', transact_time) AS transact_time, {q('price')} AS price, quantity, first_trade_id, last_trade_id, buyer_is_maker FROM trades"


@query(_MS_SQL)
def json_trades(s, d):
    return _plain_trades(recorder.trade_stream(_trade_frames(_trades(s, d)), ALL.listing))


@query(f"""WITH {T} SELECT trade_id AS first_update_id, trade_id + 1 AS final_update_id, date_trunc('millisecond', transact_time) AS event_time, floor(price) AS price, CAST(trade_id % 5 AS DOUBLE) AS quantity, 0 AS asks FROM trades""")
def json_book_updates(s, d):
    x = recorder.update_stream(_trade_frames(_trades(s, d)), ALL.listing)
    best = F.col("bids")[0]
    return x.select("first_update_id", "final_update_id", ntz("event_time"), best["price"].alias("price"), best["quantity"].alias("quantity"), F.size("asks").alias("asks"))


@query(f"""WITH {T} SELECT trade_id AS last_update_id, floor(price) AS best_bid, floor(price) + 2 AS best_ask, 1.0::DOUBLE AS quantity FROM trades""")
def json_snapshots(s, d):
    price = F.floor("price")
    level = lambda p: F.array(F.array(p.cast("string"), F.lit("1.0")))
    frames = _trades(s, d).select(F.to_json(F.struct(F.col("trade_id").alias("lastUpdateId"), level(price).alias("bids"), level(price + 2).alias("asks"))).alias("value"))
    x = payloads.snapshots(frames)
    return x.select("last_update_id", F.col("bids")[0]["price"].alias("best_bid"), F.col("asks")[0]["price"].alias("best_ask"), F.col("bids")[0]["quantity"].alias("quantity"))


#: A micro-batch of recorded frames is at most so many files of so many frames: a listing's book takes a batch's updates in one task.
_FILE_FRAMES, _BATCH_FILES = 100_000, 24
#: Frames of a live feed in a micro-batch of its book.
_BOOK_FRAMES = 500_000


@query(_MS_SQL)
def recorded_trades(s, d):
    """Frames in a folder, recorded by the streaming recorder and read back from the store."""
    path = workspace(s)
    # in order of time, so that a batch touches few days; a batch is a few files of bounded size, whatever the feed's length
    in_time = _trades(s, d).repartitionByRange("transact_time").sortWithinPartitions("transact_time", "trade_id")
    _trade_frames(in_time).where("value is not null").write.option("maxRecordsPerFile", _FILE_FRAMES).text(f"{path}/frames")
    s.createDataFrame([('{"lastUpdateId":0,"bids":[],"asks":[]}',)], "value string").write.text(f"{path}/snapshots")
    shots = payloads.snapshots(recorder.frames(s, f"{path}/snapshots")).select(F.lit(ALL.symbol).alias("symbol"), F.lit("spot").alias("market"), F.col("last_update_id").alias("seq"), "last_update_id", "bids", "asks")
    store = Store(s, f"{path}/store")
    store.migrate()
    recorder.record(s, recorder.frames(s, f"{path}/frames", files_per_trigger=_BATCH_FILES), shots, ALL.listing, store, f"{path}/state", once=True)
    return _plain_trades(store.read(TRADE_TABLE, ALL.listing))


# --- feeds, requests and downloads ------------------------------------------


def _feed(frames: DataFrame, path: str) -> dict[str, dict]:
    """A finite feed of ``position, value`` that loses its connection every 3,000 frames and then repeats 20."""
    frames.select("position", "value").orderBy("position").write.option("parquet.block.size", 1 << 20).parquet(path)  # small row groups, as each connection begins within one
    return {"all": {"path": path, "drop_every": 3000, "repeats": 20}}


@query(_MS_SQL)
def live_trades(s, d):
    """Trades as frames of a live feed with lost connections, through the journal of the live source."""
    path, t = workspace(s), _trades(s, d)
    frames = _trade_frames(t, "trade_id").where("value like '%aggTrade%'").withColumnRenamed("trade_id", "position")
    raw = live.frames(s, "tapewright.streaming.live:recorded", _feed(frames, f"{path}/feed"), f"{path}/journal", drain=True, first_pause=0.01)
    trades = recorder.trade_stream(raw, ALL.listing)
    out = trades.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{path}/trades"))
    out.trigger(availableNow=True).start().awaitTermination()
    return _plain_trades(s.read.schema(trades.schema).parquet(f"{path}/trades"))


def _numbered(t: DataFrame, path: str) -> DataFrame:
    """Trades with ``n`` in order of time and their ``total``: numbered within ranges of time, which are written at ``path``."""
    from pyspark.sql import Window as W

    order = ["transact_time", "trade_id"]
    t.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = t.sparkSession.read.parquet(path)
    per = ranged.groupBy("part").agg(F.count("*").alias("rows"))  # a row a task
    before = F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = per.select("part", before.alias("before"), F.sum("rows").over(W.partitionBy()).alias("total"))
    n = F.row_number().over(W.partitionBy("part").orderBy(*order)) + F.col("before")
    return ranged.join(F.broadcast(firsts), "part").withColumn("n", n.cast("long")).drop("part", "before")


def _book_updates(x: DataFrame) -> DataFrame:
    """An update of the book for each numbered trade; every third part of the way one is ``lost``."""
    level = lambda p, v: F.array(p.cast("string"), v.cast("string"))
    price = F.round("price")
    return x.select(
        "n", F.floor(F.unix_micros("transact_time") / 1000).alias("ms"), ((F.col("n") % F.greatest(F.floor(F.col("total") / 3), F.lit(2)) == 0) & (F.col("n") < F.col("total"))).alias("lost"),
        F.array(level(price - 1, F.col("quantity") - 1), level(price - 2, F.col("quantity"))).alias("b"), F.array(level(price + 1, F.col("quantity") - 1), level(price + 2, F.col("quantity"))).alias("a"),
    )


@query(f"""WITH RECURSIVE {T}, x AS (SELECT row_number() OVER (ORDER BY transact_time, trade_id) AS n, epoch_us(transact_time) // 1000 AS ms, price, quantity, count(*) OVER () AS total FROM trades),
l AS (SELECT *, (n % greatest(total // 3, 2) = 0 AND n < total) AS lost FROM x), g AS (SELECT *, coalesce(lag(lost) OVER (ORDER BY n), false) AS behind FROM l),
s AS (SELECT *, CAST(count(*) FILTER (NOT lost AND NOT behind AND n > 1) OVER (ORDER BY n) AS BIGINT) AS applied, CAST(count(*) FILTER (NOT lost AND behind) OVER (ORDER BY n) AS BIGINT) AS resynchronized FROM g),
a AS (SELECT * FROM s WHERE NOT lost AND NOT behind AND n > 1),
due AS (SELECT min(n) AS n FROM a UNION ALL SELECT min(y.n) FROM due JOIN a p ON p.n = due.n JOIN a y ON y.ms >= p.ms + 3600000 HAVING min(y.n) IS NOT NULL),
captures AS (SELECT n FROM due WHERE n IS NOT NULL), levels AS ({_LEVELS_SQL.format(k="n", t="x")}), {book_sql("", (5, 10, 20))}
SELECT make_timestamp(ms * 1000) AS captured_at, best_bid_price, best_ask_price, {", ".join(f"{x}_quantity_{k}" for k in (5, 10, 20) for x in ("bid", "ask"))} FROM books JOIN a USING (n)""")
def recorded_depth(s, d):
    """A feed of book updates of which some are lost: the book asks for a snapshot at first and after each loss."""
    path = workspace(s)
    _book_updates(_numbered(_trades(s, d), f"{path}/ranged")).write.parquet(f"{path}/updates")
    updates = s.read.parquet(f"{path}/updates")
    data = F.to_json(F.struct(F.lit("depthUpdate").alias("e"), F.col("ms").alias("E"), (F.col("n") * 10 + 1).alias("U"), (F.col("n") * 10 + 10).alias("u"), "b", "a"))
    frames = updates.where("not lost").select(F.col("n").alias("position"), F.concat(F.lit('{"stream":"allusdt@depth@100ms","data":'), data, F.lit("}")).alias("value"))
    feed = _feed(frames, f"{path}/feed")
    # the books take a long feed in bounded batches; trades have no state, and their trigger wants all frames at once
    whole, bounded = (live.frames(s, "tapewright.streaming.live:recorded", feed, f"{path}/journal", drain=True, keep=True, first_pause=0.01, most=most) for most in (0, _BOOK_FRAMES))

    def fetch(_, params):
        """The book as of the last update that the request has seen: the last quantity of each price."""
        seen = updates.where(F.col("n") * 10 + 10 <= params["after"])
        sides = [seen.select("n", F.explode(c).alias("x")).groupBy(F.col("x")[0].alias("p")).agg(F.max_by(F.col("x")[1], "n").alias("q")).where("cast(q as double) > 0").collect() for c in ("b", "a")]
        return {"lastUpdateId": params["after"], "bids": [[r["p"], r["q"]] for r in sides[0]], "asks": [[r["p"], r["q"]] for r in sides[1]]}, 50

    store = Store(s, f"{path}/store")
    store.migrate()
    desk = keeper.SnapshotDesk(fetch, f"{path}/answers", guard=rest.SnapshotGuard(0))
    recorder.record(s, whole, desk, ALL.listing, store, f"{path}/state", recorder.RecordingRules(capture_seconds=3600), once=True, raw_updates=bounded)
    x = store.read(DEPTH_TABLE, ALL.listing)
    return x.select(ntz("captured_at"), "best_bid_price", "best_ask_price", *[f"{side}_quantity_{k}" for k in (5, 10, 20) for side in ("bid", "ask")])


@query(f"WITH {C} SELECT open_time, {q('open')} AS open, {q('high')} AS high, {q('low')} AS low, {q('close')} AS close, volume FROM candles")
def requested_candles(s, d):
    """Candles page by page from a server that many tasks ask under one budget."""
    path, c = workspace(s), _candles(s, d)
    rows = c.select((F.unix_micros("open_time") / 1000).cast("long").alias("epoch"), "open", "high", "low", "close", "volume")
    rows.repartitionByRange(4, "epoch").write.parquet(path)
    first, last = _span(c, "open_time")
    x = rest.rest_candles(s, f"tapewright.sources.rest:stored_pages|{path}", ALL, TimeRange(first, last + timedelta(hours=1)), tasks=4)
    return x.select(ntz("open_time"), *[r(k).alias(k) for k in ("open", "high", "low", "close")], "volume")


@query(f"WITH {C} SELECT symbol, market, open_time, {BAR_SQL}, trade_count FROM candles")
def mirrored_candles(s, d):
    """Candles written as an archive with checksum files, mirrored in tasks, and read by the plan of their period."""
    path, c = workspace(s), _candles(s, d)
    first, last = _span(c, "open_time")
    period = TimeRange(first, last + timedelta(hours=1))
    ms = (F.unix_micros("open_time") / 1000).cast("long")
    cells = [ms, *[F.col(k) for k in ("open", "high", "low", "close", "volume")], ms + 3_599_999, *[F.col(k) for k in ("quote_volume", "trade_count", "taker_buy_base_volume", "taker_buy_quote_volume")], F.lit(0)]
    name = F.concat(F.lit(files.kline_url(ALL, first.date(), False).rsplit("-1h-", 1)[0] + "-1h-"), F.date_format("open_time", "yyyy-MM-dd"), F.lit(".zip"))
    days = _zipped(c.select(name.alias("path"), ms.alias("n"), F.concat_ws(",", *cells).alias("line")))
    months = _zipped(c.select(F.concat(F.lit(files.kline_url(ALL, first.date(), True).rsplit("-1h-", 1)[0] + "-1h-"), F.date_format("open_time", "yyyy-MM"), F.lit(".zip")).alias("path"), ms.alias("n"), F.concat_ws(",", *cells).alias("line")))
    days.unionByName(months).write.parquet(f"{path}/packed")  # a zip file holds the time of its making
    both = s.read.parquet(f"{path}/packed")
    sums = both.select(files.checksum_of(F.col("path")).alias("path"), F.concat(F.sha2("content", 256), F.lit("  archive.zip\n")).cast("binary").alias("content"))
    origin, mirror = f"{path}/origin", f"{path}/mirror"
    files.put_files(both.unionByName(sums), origin).count()

    def fetch(url: str) -> bytes | None:
        folder, root = files.open_folder(origin)
        where = root + url.removeprefix(files.BASE_URL)
        if folder.get_file_info(where).type == files.fs.FileType.NotFound:
            return None
        with folder.open_input_stream(where) as f:
            return f.read()

    files.Downloader(s, mirror, fetch).all(files.kline_files(ALL, period))
    return _bars(cols.conform_candles(files.archive_candles(s, mirror, ALL, period)))


# --- the store ---------------------------------------------------------------


def _store(s: SparkSession) -> Store:
    store = Store(s, workspace(s))
    store.migrate()
    return store


def _venues(s, d) -> DataFrame:
    return views.trades(s, d, per_venue=True)


@query(f"""WITH {C}, p AS (SELECT date_trunc('day', min(open_time)) + INTERVAL 1 DAY AS a, max(open_time) AS b FROM candles)
SELECT open_time, {q("CASE WHEN trade_count % 2 = 0 THEN close WHEN trade_count % 3 = 0 THEN close + 2 ELSE close + 1 END")} AS close,
  CASE WHEN trade_count % 2 = 0 THEN 'rest' WHEN trade_count % 3 = 0 THEN 'archive' ELSE 'rest' END AS source FROM candles, p WHERE open_time >= a AND open_time < b""")
def stored_candles(s, d):
    """Two saves: stored rows win, then the smaller source; read back for a half-open period."""
    store, c = _store(s), _candles(s, d).withColumn("timeframe", F.lit("1h"))
    store.save(CANDLE_TABLE, c.where("trade_count % 2 = 0").withColumn("source", F.lit("rest")))
    rest = c.withColumns({"close": F.col("close") + 1, "source": F.lit("rest")})
    store.save(CANDLE_TABLE, rest.unionByName(c.where("trade_count % 3 = 0").withColumns({"close": F.col("close") + 2, "source": F.lit("archive")})))
    first, last = _span(c, "open_time")
    period = TimeRange(Timeframe("1d").floor(first) + timedelta(days=1), last + timedelta(days=3)).clamp_end(last)
    return store.read(CANDLE_TABLE, ALL, period).select(ntz("open_time"), r("close").alias("close"), "source")


@query(f"WITH {C} SELECT open_time FROM candles WHERE trade_count % 2 = 0")
def stored_open_times(s, d):
    store, c = _store(s), _candles(s, d).withColumn("timeframe", F.lit("1h"))
    store.save(CANDLE_TABLE, c.where("trade_count % 2 = 0"))
    first, last = _span(c, "open_time")
    return store.existing_open_times(ALL, TimeRange(first, last + timedelta(hours=1))).select(ntz("open_time"))


@query(f"""WITH {T}, n AS (SELECT venue AS symbol, row_number() OVER (PARTITION BY venue ORDER BY transact_time, trade_id) AS place, trade_id, transact_time, CASE WHEN trade_id % 3 <> 0 THEN price ELSE price + 1 END AS price FROM trades)
SELECT symbol, place, trade_id, transact_time, {q("price")} AS price FROM n""")
def stored_trades(s, d):
    """Trades of several symbols in two overlapping saves, in the order of time and id."""
    from pyspark.sql import Window as W

    store, t = _store(s), _venues(s, d)
    store.save(TRADE_TABLE, t.where("trade_id % 3 <> 0"))
    store.save(TRADE_TABLE, t.withColumn("price", F.col("price") + 1))
    place = F.row_number().over(W.partitionBy("symbol", "market").orderBy("transact_time", "trade_id")).cast("long")
    return store.read(TRADE_TABLE).select("symbol", place.alias("place"), "trade_id", ntz("transact_time"), r("price").alias("price"))


@query(f"""WITH {D}, one AS (SELECT captured_at, arg_min(best_bid_price, trade_id) AS bid, arg_min(bid_quantity_20, trade_id) AS quantity FROM depth GROUP BY captured_at)
SELECT captured_at, {q("bid")} AS bid, quantity FROM one""")
def stored_depth(s, d):
    store, t = _store(s), _trades(s, d)
    once = t.join(t.groupBy("transact_time").agg(F.min("trade_id").alias("trade_id")), ["transact_time", "trade_id"])
    depth = cols.conform_depth(views.depth(once))
    store.save(DEPTH_TABLE, depth.where("second(captured_at) < 30"))
    store.save(DEPTH_TABLE, depth)
    return store.read(DEPTH_TABLE, ALL.listing).select(ntz("captured_at"), r("best_bid_price").alias("bid"), F.col("bid_quantity_20").alias("quantity"))


@query(f"""WITH {T}, {sql_candles("m", "minute")} SELECT date_trunc('hour', open_time) AS open_time, first(open ORDER BY open_time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY open_time) AS close,
  sum(volume) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM m GROUP BY 1""")
def rollup_refresh(s, d):
    """One-minute candles in the store, rolled up twice: the second refresh replaces the first."""
    store, minutes = _store(s), views.candles(_trades(s, d), Timeframe("1m")).withColumn("timeframe", F.lit("1m"))
    store.save(CANDLE_TABLE, minutes.where("minute(open_time) < 30"))
    first, last = _span(minutes, "open_time")
    store.refresh(HOUR, TimeRange(first, last + timedelta(minutes=1)))
    store.save(CANDLE_TABLE, minutes)
    store.refresh(HOUR, TimeRange(first, last + timedelta(minutes=1)))
    return store.read(CANDLES_1H).select(ntz("open_time"), "open", "high", "low", "close", "volume", "trade_count")


@query(f"""WITH {T}, {sql_candles("m", "minute")}, left_over AS (SELECT * FROM m WHERE NOT (hour(open_time) % 5 = 0 OR day(open_time) % 7 = 3 OR trade_count % 4 = 0))
SELECT date_trunc('hour', open_time) AS open_time, first(open ORDER BY open_time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY open_time) AS close,
  sum(volume) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM left_over GROUP BY 1""")
def rollup_invalidation(s, d):
    """Minutes come and go: hours, whole days and single minutes are removed, and the roll-up follows the touched days."""
    store, minutes = _store(s), views.candles(_trades(s, d), Timeframe("1m")).withColumn("timeframe", F.lit("1m"))
    store.save(CANDLE_TABLE, minutes.where("minute(open_time) < 40"))
    store.refresh_touched(HOUR)
    store.save(CANDLE_TABLE, minutes)
    store.refresh_touched(HOUR)
    store.remove(CANDLE_TABLE, minutes.where("hour(open_time) % 5 = 0 or day(open_time) % 7 = 3"))
    store.refresh_touched(HOUR)
    store.remove(CANDLE_TABLE, minutes.where("trade_count % 4 = 0"))
    return store.rolled_up(HOUR).select(ntz("open_time"), "open", "high", "low", "close", "volume", "trade_count")


@query(f"WITH {C} SELECT 'BTC/USDT' AS instrument, open_time, {q('close')} AS close FROM candles")
def parquet_sink(s, d):
    path = workspace(s)
    write_with_identity(_candles(s, d).select("open_time", "close"), path, instrument="BTC/USDT")
    return s.read.parquet(path).select("instrument", ntz("open_time"), r("close").alias("close"))


@query(ORACLES["integrity_gaps"])
def gap_sink(s, d):
    path, c = workspace(s), views.candles(_venues(s, d))
    missing = _expected(c).join(c.select(*KEYS, "open_time"), [*KEYS, "open_time"], "left_anti")
    write_gaps(quality.gaps(missing, HOUR, KEYS), path)
    back = s.read.option("header", True).csv(path)
    return back.select("symbol", F.col("gap_start").cast("timestamp").cast("timestamp_ntz").alias("gap_start"), F.col("gap_end").cast("timestamp").cast("timestamp_ntz").alias("gap_end"), F.col("missing").cast("long").alias("missing"))


@query(f"""WITH {C}, e AS (SELECT unnest(generate_series(min(open_time), max(open_time), INTERVAL 1 HOUR)) AS open_time FROM candles), there AS (SELECT open_time FROM candles WHERE trade_count % 3 <> 0),
x AS (SELECT count(*) AS expected, count(there.open_time) AS actual FROM e LEFT JOIN there USING (open_time)) SELECT expected, actual, expected - actual AS missing, {q("actual / CAST(expected AS DOUBLE)")} AS coverage FROM x""")
def completeness(s, d):
    c = _candles(s, d)
    x = quality.completeness(c.where("trade_count % 3 <> 0"), _expected(c).select("open_time"))
    return x.select("expected", "actual", "missing", r("coverage").alias("coverage"))


_VENUES = f"{T}, v AS (SELECT venue AS symbol, date_trunc('hour', transact_time) AS open_time, last(price ORDER BY transact_time, trade_id) AS close, CAST(sum(last_trade_id - first_trade_id + 1) AS BIGINT) AS trade_count FROM trades GROUP BY 1, 2)"


@query(f"""WITH {_VENUES}, e AS (SELECT symbol, unnest(generate_series(min(open_time), max(open_time), INTERVAL 1 HOUR)) AS open_time FROM v GROUP BY symbol), x AS (SELECT symbol, count(*) AS expected, count(v.open_time) AS actual FROM e LEFT JOIN v USING (symbol, open_time) GROUP BY symbol)
SELECT symbol, expected, actual, expected - actual AS missing, {q("actual / CAST(expected AS DOUBLE)")} AS coverage FROM x""")
def completeness_by_instrument(s, d):
    c = views.candles(_venues(s, d))
    return quality.completeness(c, _expected(c), KEYS).select("symbol", "expected", "actual", "missing", r("coverage").alias("coverage"))


@query(f"""WITH {_VENUES}, f AS (SELECT symbol, open_time, CASE WHEN trade_count % 2 = 1 THEN close END AS odd, avg(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS n FROM v),
g AS (SELECT symbol, open_time, odd, CASE WHEN n >= 3 THEN m END AS sma_3 FROM f)
SELECT symbol, 'odd' AS feature, {q("avg(CASE WHEN odd IS NULL THEN 0 ELSE 1 END)")} AS known, {q("arg_max(odd, open_time)")} AS last FROM g GROUP BY symbol
UNION ALL SELECT symbol, 'sma_3', {q("avg(CASE WHEN sma_3 IS NULL THEN 0 ELSE 1 END)")}, {q("arg_max(sma_3, open_time)")} FROM g GROUP BY symbol""")
def feature_availability(s, d):
    x = views.candles(_venues(s, d)).withColumns({"odd": F.when(F.col("trade_count") % 2 == 1, F.col("close")), "sma_3": sma(F.col("close"), 3, ordered())})
    return quality.availability(x, ["odd", "sma_3"], KEYS).select("symbol", "feature", r("known").alias("known"), r("last").alias("last"))


@query(f"WITH {C} SELECT open_time, {q('close')} AS close FROM candles WHERE open_time <= (SELECT max(open_time) FROM candles) - INTERVAL 2 HOUR")
def closed_candles(s, d):
    c = _candles(s, d)
    now = _span(c, "open_time")[1] - timedelta(minutes=1)
    return quality.closed_only(c, HOUR, now).select(ntz("open_time"), r("close").alias("close"))


# --- whole runs and specifications -------------------------------------------


@query(f"""WITH {C}, p AS (SELECT min(open_time) AS first, max(open_time) AS last, date_trunc('day', min(open_time)) AS day, date_trunc('day', max(open_time)) - INTERVAL 2 DAY AS cutoff FROM candles),
st AS (SELECT open_time, close FROM candles, p WHERE trade_count % 3 <> 0 AND NOT (open_time >= day + INTERVAL 5 DAY AND open_time < day + INTERVAL 9 DAY) AND open_time < last),
e AS (SELECT unnest(generate_series(first, last - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS open_time FROM p), m AS (SELECT open_time FROM e ANTI JOIN st USING (open_time)),
i AS (SELECT open_time, epoch(open_time) - 3600 * row_number() OVER (ORDER BY open_time) AS island FROM m), g AS (SELECT *, min(open_time) OVER (PARTITION BY island) AS a, count(*) OVER (PARTITION BY island) AS n FROM i),
f AS (SELECT open_time, CASE WHEN n >= 48 AND a < cutoff AND open_time < cutoff THEN 'archive' ELSE 'rest' END AS source FROM g, p)
SELECT open_time, {q("close")} AS close, 'stored' AS source FROM st
UNION ALL SELECT open_time, {q("close + CASE WHEN source = 'archive' THEN 2 ELSE 1 END")}, source FROM f JOIN candles USING (open_time) WHERE trade_count % 13 <> 0""")
def ingest_fills_gaps(s, d):
    """A store with holes and a lost stretch, filled from both kinds of source; bars that break the price order are not taken."""
    store, c = _store(s), _candles(s, d).withColumn("timeframe", F.lit("1h"))
    first, last = _span(c, "open_time")
    day = Timeframe("1d").floor(first)
    lost = (F.col("open_time") >= F.lit(day + timedelta(days=5))) & (F.col("open_time") < F.lit(day + timedelta(days=9)))
    store.save(CANDLE_TABLE, c.where((F.col("trade_count") % 3 != 0) & ~lost & (F.col("open_time") < F.lit(last))).withColumn("source", F.lit("stored")))

    def loader(more: int):
        high = F.when(F.col("trade_count") % 13 == 0, F.col("low") - 1).otherwise(F.col("high") + more)
        given = c.withColumns({"close": F.col("close") + more, "high": high})
        return lambda _, p: given.where((F.col("open_time") >= F.lit(p.start)) & (F.col("open_time") < F.lit(p.end)))

    report = filling.synchronize(s, store, ALL, TimeRange(first, last), last, {SourceKind.ARCHIVE: loader(2), SourceKind.REST: loader(1)})
    if not report.ok:
        raise ValueError(report.failure)
    return store.read(CANDLE_TABLE, ALL, TimeRange(first, last)).select(ntz("open_time"), r("close").alias("close"), "source")


@query(f"""WITH {C}, fast(a) AS (VALUES (8), (12), (21)), slow(b) AS (VALUES (12), (21), (55)), limits AS (SELECT DISTINCT CAST(floor(close / 5) * 5 AS BIGINT) AS v FROM candles)
SELECT 'trend_ema_rsi__period' || a || '_period' || b || '_value' || v AS name, 'ema_' || a AS fast, 'ema_' || b AS slow, CAST(v AS DOUBLE) AS allowed FROM fast, slow, limits WHERE a < b""")
def search_space(s, d):
    """All combinations of the axes that the constraint allows, as the conditions name them; the last axis holds the levels that closes reach."""
    levels = [x[0] for x in _candles(s, d).select((F.floor(F.col("close") / 5) * 5).cast("long")).distinct().collect()]
    space = SearchSpace(shipped()[0], (FeatureAxis(0, "period", (8, 12, 21)), FeatureAxis(1, "period", (12, 21, 55)), ConditionAxis(ConditionTree.FILTERS, "value", tuple(sorted(levels)))), (Increasing(0, 1),))
    rows = [(x.name, x.entry.parameters["fast"], x.entry.parameters["slow"], float(x.filters.children[0].parameters["value"])) for x in space.expand()]
    return s.createDataFrame(rows, "name string, fast string, slow string, allowed double")
