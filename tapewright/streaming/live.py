"""A live feed of text frames as a streaming data source.

A *transport* is a callable ``(options, after) -> iterator of (position, text)``,
named as ``module:function``.  It connects when called and raises OSError when the
connection is lost or can't be made; ``after`` is the last position that has
arrived, so a feed that can resume does; a feed without positions gives None.  A
finite feed raises ``Finished`` at its end.

Each feed has a thread that listens into a bounded queue (a slow journal holds the
socket back) and one that writes what has come to a journal: small Parquet files in a
shared folder, complete before their frames get an offset.  Offsets count a feed's
journaled frames, so a batch that is run again reads the same frames, on any
executor, and a restarted query goes on where the journal ends.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from functools import lru_cache
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.files import open_folder
from ..sources.rest import load_fetcher

Transport = Callable[[dict[str, Any], int | None], Iterator[tuple[int | None, str]]]

SCHEMA = "feed string, frame long, position long, received_at timestamp, value string"
_SEGMENT = pa.schema([("position", pa.int64()), ("received_at", pa.timestamp("us", tz="UTC")), ("value", pa.string())])
_TICK = 0.05


class Finished(Exception):
    """The end of a finite feed."""


class Backoff:
    """Pauses between attempts to connect: doubling up to a limit, from the start again after a success."""

    def __init__(self, first: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep):
        self.first, self.most, self.sleep, self.next = first, most, sleep, first

    def reset(self) -> None:
        self.next = self.first

    def wait(self) -> None:
        self.sleep(self.next)
        self.next = min(2 * self.next, self.most)


class Journal:
    """Frames of one feed in files named by their first offset and count; any URI that Arrow's file systems open."""

    def __init__(self, path: str):
        self.fs, self.root = open_folder(path)
        self.fs.create_dir(self.root, recursive=True)
        self.end, self.last = 0, None
        segments = self.segments()
        if segments:
            first, count = segments[-1]
            self.end = first + count
            positions = [p for p in self.read(first, count).column("position").to_pylist() if p is not None]
            self.last = max(positions, default=None)

    def _file(self, first: int, count: int) -> str:
        return f"{self.root}/{first:020d}-{count:08d}.parquet"

    def segments(self) -> list[tuple[int, int]]:
        names = [f.base_name for f in self.fs.get_file_info(fs.FileSelector(self.root)) if f.base_name.endswith(".parquet")]
        return sorted(tuple(map(int, n.removesuffix(".parquet").split("-"))) for n in names)

    def append(self, frames: list[tuple[int | None, datetime, str]]) -> None:
        """Write a file under a name of its own first: a reader never sees half of one, also where two listeners journal the same frames."""
        done = self._file(self.end, len(frames))
        table = pa.table([list(c) for c in zip(*frames)], schema=_SEGMENT)
        own = f"{done}.{uuid.uuid4().hex}.writing"
        with self.fs.open_output_stream(own) as out:
            pq.write_table(table, out, compression="zstd")
        try:
            self.fs.move(own, done)
        except OSError:  # some file systems don't replace a file
            if self.fs.get_file_info(done).type != fs.FileType.File:
                raise
            self.fs.delete_file(own)
        self.end += len(frames)

    def read(self, first: int, count: int) -> pa.Table:
        with self.fs.open_input_file(self._file(first, count)) as f:
            return pq.read_table(f)

    @classmethod
    def reading(cls, path: str) -> "Journal":
        """To read known files alone: the folder is not listed."""
        self = cls.__new__(cls)
        self.fs, self.root = open_folder(path)
        return self

    def forget(self, before: int) -> None:
        """Delete files whose frames all lie before an offset; the last file stays, as it tells where to resume."""
        for first, count in self.segments()[:-1]:
            if first + count <= before:
                self.fs.delete_file(self._file(first, count))


class Feed:
    """Listens to one transport and journals its frames."""

    def __init__(self, transport: Transport, options: dict[str, Any], journal: Journal, *, queue: int = 1024, segment: int = 5000, seal_seconds: float = 0.2, backoff: Backoff | None = None):
        self.transport, self.options, self.journal, self.segment, self.seal, self.backoff = transport, options, journal, segment, seal_seconds, backoff or Backoff()
        self.queue, self.limit, self.turn = deque(), queue, threading.Condition()
        self.after, self.finished, self.stopping, self.error, self.connections = journal.last, False, threading.Event(), None, 0
        self.listener = threading.Thread(target=self._listen, daemon=True)
        self.writer = threading.Thread(target=self._write, daemon=True)

    def start(self) -> "Feed":
        self.listener.start()
        self.writer.start()
        return self

    def _put(self, frame: tuple) -> None:
        """Into the queue, as soon as it has room; the writer is woken where it was empty."""
        if len(self.queue) >= self.limit:
            with self.turn:
                while len(self.queue) >= self.limit and not self.stopping.is_set():
                    self.turn.wait(_TICK)
        self.queue.append(frame)
        if len(self.queue) == 1:
            with self.turn:
                self.turn.notify_all()

    def _take(self, most: int) -> list[tuple]:
        """Up to so many frames at once; none after a tick without any."""
        if not self.queue:
            with self.turn:
                self.turn.wait_for(lambda: self.queue or self.finished, _TICK)
        frames = [self.queue.popleft() for _ in range(min(most, len(self.queue)))]
        with self.turn:
            self.turn.notify_all()
        return frames

    def _listen(self) -> None:
        try:
            while not self.stopping.is_set():
                try:
                    frames = self.transport(self.options, self.after)
                    self.connections += 1
                    came = False
                    for position, text in frames:
                        if not came:
                            came = True
                            self.backoff.reset()
                        if self.stopping.is_set():
                            return
                        if position is not None and self.after is not None and position <= self.after:
                            continue  # sent again after a reconnection
                        self._put((position, datetime.now(timezone.utc), text))
                        self.after = position if position is not None else self.after
                    if not came:
                        self.backoff.wait()
                except OSError:
                    self.backoff.wait()
        except Finished:
            pass
        except Exception as e:  # noqa: BLE001 - told to the query by the next call
            self.error = e
        finally:
            self.finished = True

    def _write(self) -> None:
        try:
            while not (self.stopping.is_set() or (self.finished and not self.queue)):
                frames, until = [], None
                while len(frames) < self.segment and (until is None or time.monotonic() < until):
                    came = self._take(self.segment - len(frames))
                    frames += came
                    until = until or (time.monotonic() + self.seal if came else None)
                    if not came and (frames or self.finished or self.stopping.is_set()):
                        break
                if frames:
                    self.journal.append(frames)
        except Exception as e:  # noqa: BLE001
            self.error = e
            self.stopping.set()  # the listener doesn't wait for room any more

    def drained(self) -> None:
        """Wait for the end of a finite feed and its journal."""
        self.listener.join()
        self.writer.join()

    def reached(self, offset: int) -> None:
        """Wait until so many frames are journaled, or for the end of a finite feed."""
        while self.journal.end < offset and self.writer.is_alive():
            time.sleep(_TICK)

    def end(self) -> int:
        if self.error:
            raise self.error
        return self.journal.end

    def stop(self) -> None:
        self.stopping.set()


#: Frames that one task reads, in whole journal files.
_TASK = 100_000


class _Segment(InputPartition):
    """Neighbouring journal files, as (first, count), of which the frames from start up to end count."""

    def __init__(self, feed: str, path: str, files: list[tuple[int, int]], start: int, end: int):
        self.feed, self.path, self.files, self.start, self.end = feed, path, files, start, end


class _LiveReader(DataSourceStreamReader):
    """Plans on the driver beside the feeds; reads journal files in tasks."""

    def __init__(self, options: dict[str, str]):
        self.o, self.feeds, self.at = options, None, None
        self.names = json.loads(options["feeds"])

    def __getstate__(self):
        return {"o": self.o, "feeds": None, "names": self.names, "at": None}

    def _path(self, name: str) -> str:
        return f"{self.o['journal'].rstrip('/')}/{name}"

    def _listening(self) -> dict[str, Feed]:
        if self.feeds is None:
            opened = {name: Journal(self._path(name)).end for name in self.names}  # no batch has reached further
            transport, number = load_fetcher(self.o["transport"]), lambda k, d: float(self.o.get(k, d))
            self.feeds = {
                name: Feed(transport, options, Journal(self._path(name)), queue=int(number("queue", 1024)), segment=int(number("segment", 5000)), seal_seconds=number("seal_seconds", 0.2), backoff=Backoff(number("first_pause", 1), number("longest_pause", 30))).start()
                for name, options in self.names.items()
            }
            self.at = opened
        return self.feeds

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.names, 0)

    def latestOffset(self) -> dict:
        """At most ``most`` frames of each feed beyond the last batch, at first beyond what the journal held when it was opened."""
        feeds, most = self._listening(), int(self.o.get("most", 0))
        if most:
            if self.o.get("drain", "false").lower() == "true":
                for name, feed in feeds.items():
                    feed.reached(self.at.get(name, 0) + most)
            self.at = {name: min(feed.end(), self.at.get(name, 0) + most) for name, feed in feeds.items()}
            return self.at
        if self.o.get("drain", "false").lower() == "true":
            for feed in feeds.values():
                feed.drained()
        return {name: feed.end() for name, feed in feeds.items()}

    def partitions(self, start: dict, end: dict):
        out = []
        for name, until in end.items():
            covered, task = start.get(name, 0), None
            for first, count in Journal(self._path(name)).segments():
                b = min(first + count, until)
                if first > covered and b > covered:
                    break  # a hole
                if b > covered:  # what a second listener has journaled too counts once
                    if task is None or task.end - task.start >= _TASK:
                        task = _Segment(name, self._path(name), [], covered, covered)
                        out.append(task)
                    task.files.append((first, count))
                    task.end = covered = b
            if covered < until:
                raise ValueError(f"the journal of {name} lacks frames {covered} to {until}")
        return out

    def read(self, partition):
        p, journal, at = partition, Journal.reading(partition.path), partition.start
        for first, count in p.files:
            until = min(first + count, p.end)
            table, n = journal.read(first, count).slice(at - first, until - at), until - at
            named = pa.table([pa.array([p.feed] * n, pa.string()), pa.array(range(at, until), pa.int64()), *table.columns], ["feed", "frame", *_SEGMENT.names])
            yield from named.to_batches()
            at = until

    def commit(self, end: dict) -> None:
        if self.o.get("keep", "false").lower() != "true":
            for name, until in end.items():
                Journal(self._path(name)).forget(until)

    def stop(self) -> None:
        for feed in (self.feeds or {}).values():
            feed.stop()


class LiveFrames(DataSource):
    """``spark.readStream.format("live_frames")``: options transport, feeds (JSON: name -> the transport's options), journal."""

    @classmethod
    def name(cls) -> str:
        return "live_frames"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return _LiveReader(dict(self.options))


def frames(spark: SparkSession, transport: str, feeds: dict[str, dict[str, Any]], journal: str, **options: Any) -> DataFrame:
    """A stream of frames of several feeds.

    ``journal`` is a folder that driver and executors share.  Further options: ``queue``
    (frames held in memory for each feed), ``segment`` and ``seal_seconds`` (when a journal
    file is closed), ``first_pause`` and ``longest_pause`` (seconds between attempts to
    connect), ``drain`` (each batch waits for the end of finite feeds, or with ``most`` for so
    many frames), ``most`` (frames of a feed in a batch, else all that there are;
    not with ``availableNow``, which may end after the first batch), ``keep`` (journal
    files stay when their frames are done).
    """
    spark.dataSource.register(LiveFrames)
    return spark.readStream.format("live_frames").options(transport=transport, feeds=json.dumps(feeds), journal=journal, **{k: str(v) for k, v in options.items()}).load()


def websocket(options: dict[str, Any], after: int | None) -> Iterator[tuple[int | None, str]]:
    """The transport of a public feed: ``url``; needs the websockets package.  Such feeds have no positions."""
    from websockets.exceptions import WebSocketException
    from websockets.sync.client import connect

    def listen(connection):
        try:
            with connection:
                for frame in connection:
                    yield None, frame if isinstance(frame, str) else frame.decode()
        except WebSocketException as e:
            raise OSError(str(e)) from e

    try:
        return listen(connect(options["url"], max_queue=1024))
    except WebSocketException as e:
        raise OSError(str(e)) from e


@lru_cache(maxsize=4096)
def _ends(folder: str, file: str, changed: int | None) -> tuple[int | None, ...]:
    """The greatest position of each row group of a file, as its footer tells; None where it doesn't."""
    with open_folder(folder)[0].open_input_file(file) as f:
        groups = pq.ParquetFile(f).metadata
    column = groups.schema.names.index("position")
    told = [groups.row_group(i).column(column).statistics for i in range(groups.num_row_groups)]
    return tuple(s.max if s is not None and s.has_min_max else None for s in told)


def recorded(options: dict[str, Any], after: int | None) -> Iterator[tuple[int | None, str]]:
    """A finite feed from Parquet files with ``position, value``, in order of their names and rows.

    With ``drop_every`` a connection is lost after so many frames, and after a
    reconnection the last ``repeats`` frames come again, as some feeds do.  A
    reconnection reads the row groups from its position on, not those before.
    """
    files, path = open_folder(options["path"])
    found = sorted((f.path, f.mtime_ns) for f in files.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet"))
    drop, repeats = int(options.get("drop_every", 0)), int(options.get("repeats", 0))

    def listen():
        sent, since = 0, None if after is None else after - repeats
        for name, changed in found:
            groups = [i for i, end in enumerate(_ends(options["path"], name, changed)) if since is None or end is None or end > since]
            if not groups:
                continue
            with files.open_input_file(name) as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=["position", "value"], row_groups=groups, batch_size=4096):
                    if since is not None:
                        batch = batch.filter(pc.greater(batch.column(0), since))
                    for position, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        yield position, value
                        sent += 1
                        if drop and sent == drop:
                            raise ConnectionResetError("lost")
        raise Finished

    return listen()
