"""Archive files: planning which to read, verifying and parsing them.

The archives are zip files, which Spark has no codec for: they are read as
binary files, each task unzips the first member in memory and hands its lines
on, and Spark's CSV functions parse them.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Callable, Sequence
from datetime import date, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..model import Instrument, Listing, Market, TimeRange
from ..operators.merge import CANDLE_KEY, TRADE_KEY, keep_first
from .columns import epoch_to_timestamp

# The public archive's layout and the columns of its files.
BASE_URL = "https://data.binance.vision/data"
MARKET_PREFIX = {Market.SPOT: "spot", Market.USDM: "futures/um"}
KLINE_COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_count", "taker_buy_base_volume", "taker_buy_quote_volume", "ignore")
AGG_TRADE_COLUMNS = ("trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "transact_time", "buyer_is_maker", "best_match")


def kline_url(i: Instrument, stamp: date, monthly: bool) -> str:
    period, text = ("monthly", f"{stamp:%Y-%m}") if monthly else ("daily", f"{stamp:%Y-%m-%d}")
    return f"{BASE_URL}/{MARKET_PREFIX[i.market]}/{period}/klines/{i.native_symbol}/{i.timeframe}/{i.native_symbol}-{i.timeframe}-{text}.zip"


def agg_trades_url(listing: Listing, day: date) -> str:
    """Trades come by day only."""
    return f"{BASE_URL}/{MARKET_PREFIX[listing.market]}/daily/aggTrades/{listing.native_symbol}/{listing.native_symbol}-aggTrades-{day:%Y-%m-%d}.zip"


def checksum_url(url: str) -> str:
    return f"{url}.CHECKSUM"


def _next_month(d: date) -> date:
    return date(d.year + d.month // 12, d.month % 12 + 1, 1)


def days(period: TimeRange) -> list[date]:
    """The days that a half-open range touches."""
    out, d = [], period.start.date()
    last = (period.end - timedelta(microseconds=1)).date()
    while not period.is_empty and d <= last:
        out.append(d)
        d += timedelta(days=1)
    return out


def kline_files(i: Instrument, period: TimeRange) -> list[str]:
    """Monthly files for the months that lie within the period whole, daily ones for the rest."""
    all_days = days(period)
    months: list[date] = []
    m = period.start.date().replace(day=1)
    while m < period.end.date():
        whole = m >= period.start.date() and _next_month(m) - timedelta(days=1) < period.end.date()
        months += [m] if whole else []
        m = _next_month(m)
    left = [d for d in all_days if d.replace(day=1) not in months]
    return [kline_url(i, m, True) for m in months] + [kline_url(i, d, False) for d in left]


def agg_trade_files(listing: Listing, period: TimeRange) -> list[str]:
    return [agg_trades_url(listing, d) for d in days(period)]


def verify(content: bytes, checksum: str) -> None:
    """``checksum``: the text of a .CHECKSUM file."""
    expected = checksum.split()[0].lower()
    if hashlib.sha256(content).hexdigest() != expected:
        raise ValueError("the archive's sha256 differs from its checksum file")


def open_folder(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that driver and executors share, and the path there."""
    return fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)


def commit_file(files: fs.FileSystem, path: str, content: bytes) -> None:
    """Write a whole file under a name of its own, then give it its name: of several writers one file is left."""
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(own) as out:
        out.write(content)
    try:
        files.move(own, path)
    except OSError:
        if files.get_file_info(path).type != fs.FileType.File:
            raise
        files.delete_file(own)  # another writer was first


def put_files(rows: DataFrame, root: str) -> DataFrame:
    """Write ``path, content`` (paths as the archive's) below a shared folder, in tasks; gives the paths when it is read."""

    def run(batches):
        files, base = open_folder(root)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                commit_file(files, mirrored_path(base, path), content)
            yield b.select(["path"])

    return rows.select("path", "content").mapInArrow(run, "path string")


def checksum_of(path: Column) -> Column:
    return F.concat(path, F.lit(".CHECKSUM"))


_MIRRORED = "url string, path string, bytes long, status string"


def mirrored_path(root: str, url: str) -> str:
    return f"{root}/{url.removeprefix(BASE_URL).lstrip('/')}"


class Downloader:
    """Archive files into a shared mirror, fetched and verified in tasks, with the transport injected.

    ``fetch(url)`` gives the content, or None where the archive has no such file; it goes
    to the executors.  A file is verified against its checksum file before it takes its
    name, so a mirror never holds half a file; files that are there are not fetched
    again; a task that runs twice leaves one file.  Nothing passes the driver's disk.
    """

    def __init__(self, spark: SparkSession, root: str, fetch: Callable[[str], bytes | None], tasks: int = 8):
        self.spark, self.root, self.fetch, self.tasks = spark, root.rstrip("/"), fetch, tasks

    def path(self, url: str) -> str:
        return mirrored_path(self.root, url)

    def mirror(self, urls: DataFrame) -> DataFrame:
        """Per distinct ``url``: ``path, bytes, status`` (fetched, there, absent or damaged); the work is done when it is read."""
        root, fetch = self.root, self.fetch

        def place(url: str) -> str:
            return mirrored_path(root, url)

        def run(batches):
            files, base = open_folder(root)
            for b in batches:
                out = [(url, place(url), *_mirror_one(files, base + place(url)[len(root) :], url, fetch)) for url in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.string()))], ["url", "path", "bytes", "status"]) if out else b.slice(0, 0)

        return urls.select("url").where("url is not null").distinct().repartition(self.tasks, "url").mapInArrow(run, _MIRRORED)

    def all(self, urls: Sequence[str]) -> list[str]:
        """Mirror what a plan names; paths of the files that exist, in the order of ``urls``.  Damaged files raise, when all others are there."""
        done = {r["url"]: r for r in self.mirror(self.spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
        damaged = sorted(u for u, r in done.items() if r["status"] == "damaged")
        if damaged:
            raise ValueError(f"the sha256 of {len(damaged)} files differs from their checksum files, as of {damaged[0]}")
        return [done[u]["path"] for u in urls if done[u]["status"] != "absent"]


def _mirror_one(files: fs.FileSystem, path: str, url: str, fetch: Callable[[str], bytes | None]) -> tuple[int | None, str]:
    there = files.get_file_info(path)
    if there.type == fs.FileType.File:
        return there.size, "there"
    checksum = fetch(checksum_url(url))
    content = None if checksum is None else fetch(url)
    if content is None:
        return None, "absent"
    try:
        verify(content, checksum.decode())
    except ValueError:
        return len(content), "damaged"
    commit_file(files, path, content)
    return len(content), "fetched"


def verified(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """Binary files (``path, content``) whose checksum file (``path`` + .CHECKSUM) agrees."""
    sums = checksums.select(F.regexp_replace("path", r"\.CHECKSUM$", "").alias("path"), F.lower(F.substring_index(F.trim(F.decode("content", "UTF-8")), " ", 1)).alias("sha"))
    return files.join(sums, "path").where(F.sha2("content", 256) == F.col("sha")).drop("sha")


def _lines(batches):
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if content[:2] == b"PK":
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                    text = io.TextIOWrapper(f, "utf-8", newline="")
                    lines = text.read().splitlines()
            else:
                lines = content.decode("utf-8").splitlines()
            for at in range(0, len(lines), 50_000):
                part = lines[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(part, pa.string())], ["path", "line"])


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, line`` of archive files, zipped or plain."""
    return lines_of(spark.read.format("binaryFile").load(list(paths)))


def lines_of(files: DataFrame) -> DataFrame:
    """``path, line`` of ``path, content``; of a zip archive its first member."""
    return files.select("path", "content").mapInArrow(_lines, "path string, line string")


def _cells(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.split("line", ",")
    return lines.select("path", *[F.trim(F.get(cells, F.lit(i))).alias(c) for i, c in enumerate(columns)])


def _number(c: str, kind: str):
    return F.expr(f"try_cast({c} as {kind})")


def parse_klines(lines: DataFrame, instrument: Instrument) -> DataFrame:
    """Candles; a header line, whose first cell is no integer, goes.  Epoch units are told file by file."""
    x = _cells(lines, KLINE_COLUMNS).withColumn("epoch", _number("open_time", "bigint")).where("epoch is not null")
    x = epoch_to_timestamp(x, "epoch", "t", by=("path",))
    floats = ["open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume"]
    return x.select(
        F.lit(instrument.symbol).alias("symbol"), F.lit(instrument.market.value).alias("market"), F.lit(instrument.timeframe.value).alias("timeframe"), F.col("t").alias("open_time"),
        *[_number(c, "double").alias(c) for c in floats], _number("trade_count", "bigint").alias("trade_count"),
    )


def parse_agg_trades(lines: DataFrame, listing: Listing) -> DataFrame:
    """Trades; the flag may be written True, true, False or false, anything else raises."""
    x = _cells(lines, AGG_TRADE_COLUMNS).withColumn("epoch", _number("transact_time", "bigint")).where("epoch is not null")
    x = epoch_to_timestamp(x, "epoch", "t", by=("path",))
    flag = F.lower(F.col("buyer_is_maker"))
    maker = F.when(flag == "true", True).when(flag == "false", False).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), F.coalesce("buyer_is_maker", F.lit("null")))).cast("boolean"))
    return x.select(
        F.lit(listing.symbol).alias("symbol"), F.lit(listing.market.value).alias("market"), F.col("trade_id").cast("long").alias("trade_id"), F.col("t").alias("transact_time"),
        F.col("price").cast("double").alias("price"), F.col("quantity").cast("double").alias("quantity"), F.col("first_trade_id").cast("long").alias("first_trade_id"),
        F.col("last_trade_id").cast("long").alias("last_trade_id"), maker.alias("buyer_is_maker"),
    )


def _present(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Missing files are skipped, as the archive lacks days that never traded."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    return [p for p in paths if (path := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(path)]


def archive_candles(spark: SparkSession, root: str, instrument: Instrument, period: TimeRange) -> DataFrame:
    """Candles of a period from a mirror of the archive below ``root``; of equal bars the first file's stays."""
    paths = _present(spark, [u.replace(BASE_URL, root) for u in kline_files(instrument, period)])
    lines = read_lines(spark, paths) if paths else spark.createDataFrame([], "path string, line string")
    tagged = parse_klines(lines, instrument)
    return keep_first(tagged, CANDLE_KEY, F.lit(0)).where((F.col("open_time") >= F.lit(period.start)) & (F.col("open_time") < F.lit(period.end)))


def archive_trades(spark: SparkSession, root: str, listing: Listing, period: TimeRange) -> DataFrame:
    """Trades of a period from a mirror of the archive, one row for each trade id."""
    paths = _present(spark, [u.replace(BASE_URL, root) for u in agg_trade_files(listing, period)])
    lines = read_lines(spark, paths) if paths else spark.createDataFrame([], "path string, line string")
    trades = keep_first(parse_agg_trades(lines, listing), TRADE_KEY, F.col("transact_time"))
    return trades.where((F.col("transact_time") >= F.lit(period.start)) & (F.col("transact_time") < F.lit(period.end)))
