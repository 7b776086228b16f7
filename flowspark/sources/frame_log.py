"""A streaming source of frames: the logs of several sockets, merged by time of receipt.

A log is a folder of Parquet segments in the order of their names, each with frames (ts_recv_ns,
symbol, raw, size) in the order of receipt; a file _END (or the _SUCCESS of a finished Spark job)
says that nothing follows. Whoever holds the socket appends with `Appender`; `land` writes a whole
frame as a log. A root has one log for each socket.

The stream's rows come in one order over all sockets: by receipt, then by socket, then by place in
the log; `arrival` numbers them from 0. A frame is given out only when every log that is still open
has a frame received as late or later, so that a slow socket can't be overtaken; a log that is silent
for `patience_ms` of receipt time behind the newest one is no longer waited for.

Each micro-batch takes at most `max_rows` frames and `max_bytes` of their text (one frame at least):
what lies beyond waits in the log, never in memory. `backlog` says how many frames were waiting when
the batch was planned, its own included; its maximum is the high-water mark.

Offsets are places in the segments, so a batch that is run again reads the same rows with the same
numbers. Planning reads the times and sizes of the next frames of each log up to either limit, never
their text, several segments at a time, and keeps them until they are taken, so none is read again for
the next batch; the counts of segments, which never change, and the names of those of an ended log are
read once. The tasks read the text, each some TASK_ROWS frames of whole segments,
so small segments are not tasks of their own. A source is not told where its query stands
after a restart, so it looks it up in the query's offset log under `checkpoint`.

Null texts and symbols pass through; an empty root gives no rows, and so do empty segments. Columns
of the segments other than these four are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "frame_log"
SCHEMA = "arrival long, socket string, place long, ts_recv_ns long, symbol string, raw string, backlog long"
SEGMENT = pa.schema([("ts_recv_ns", pa.int64()), ("symbol", pa.string()), ("raw", pa.string()), ("size", pa.int32())])
ENDS = ("_END", "_SUCCESS")
MAX_ROWS, MAX_BYTES, PATIENCE_MS = 100_000, 64 << 20, 60_000
#: Frames of one task, if its segments are smaller; segments that the driver reads at once.
TASK_ROWS, AT_ONCE = 32_768, 8


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" and not rest.startswith("//"):
        path = f"file://{rest}"
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Appender:
    """Appends frames to the log of one socket, a segment at a time."""

    def __init__(self, root: str, socket: str):
        self.fs, at = opened(root)
        self.at = f"{at.rstrip('/')}/{socket}"
        self.fs.create_dir(self.at, recursive=True)
        self.n = len(segments(self.fs, self.at)[0])

    def append(self, frames: Sequence[tuple[int, str | None, str | None]]) -> None:
        """Frames (ts_recv_ns, symbol, raw) in the order of receipt; readers see all of them or none."""
        ts = [f[0] for f in frames]
        if any(a > b for a, b in zip(ts, ts[1:])):
            raise ValueError("frames must be in the order of receipt")
        rows = pa.table([ts, [f[1] for f in frames], [f[2] for f in frames], [len((f[2] or "").encode()) for f in frames]], schema=SEGMENT)
        hidden = f"{self.at}/.{self.n:012d}.parquet"
        with self.fs.open_output_stream(hidden) as out:
            pq.write_table(rows, out)
        self.fs.move(hidden, f"{self.at}/{self.n:012d}.parquet")
        self.n += 1

    def end(self) -> None:
        with self.fs.open_output_stream(f"{self.at}/{ENDS[0]}"):
            pass


def land(frames: DataFrame, root: str, socket: str, rows: int = 50_000) -> None:
    """Frames (ts_recv_ns, symbol, raw) as an ended log: sorted by range, so that Spark's part files
    stand in order, each cut into segments of at most `rows`."""
    sized = frames.select("ts_recv_ns", "symbol", "raw", F.coalesce(F.octet_length("raw"), F.lit(0)).alias("size"))
    sized.orderBy("ts_recv_ns", "symbol", "raw").write.option("maxRecordsPerFile", rows).parquet(f"{root}/{socket}")


def segments(fs: pafs.FileSystem, at: str) -> tuple[list[str], bool]:
    """Paths of a log's segments in order, and whether it has ended."""
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.type == pafs.FileType.File]
    names = [p.rpartition("/")[2] for p in files]
    return sorted(p for p, n in zip(files, names, strict=True) if n.endswith(".parquet") and n[0] not in "._"), any(n in ENDS for n in names)


class Span(NamedTuple):
    """Rows of one segment, and the numbers that they get."""

    path: str
    first: int
    n: int


class Part(NamedTuple):
    """A span, the place of its first row in the log, and the numbers of its rows."""

    span: Span
    place: int
    arrivals: np.ndarray


class Taken(InputPartition):
    def __init__(self, socket: str, parts: list[Part], backlog: int):
        self.socket, self.parts, self.backlog = socket, parts, backlog


class Seen:
    """What the driver has read of segments: their numbers of rows, times and sizes of those that are
    looked at, and the names of all in ended logs."""

    def __init__(self, fs: pafs.FileSystem):
        self.fs, self.counts, self.rows, self.whole = fs, {}, {}, {}

    def _read(self, one: Callable[[str], Any], paths: Sequence[str], known: dict[str, Any]) -> list[Any]:
        new = [p for p in paths if p not in known]
        if new:
            with ThreadPoolExecutor(AT_ONCE) as pool:
                known.update(zip(new, pool.map(one, new), strict=True))
        return [known[p] for p in paths]

    def listed(self, at: str) -> tuple[list[str], bool]:
        if at not in self.whole:
            paths, ended = segments(self.fs, at)
            if not ended:
                return paths, False
            self.whole[at] = paths
        return self.whole[at], True

    def n_rows(self, paths: Sequence[str]) -> list[int]:
        return self._read(lambda p: pq.read_metadata(p, filesystem=self.fs).num_rows, paths, self.counts)

    def times(self, paths: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        def one(path: str) -> tuple[np.ndarray, np.ndarray]:
            with self.fs.open_input_file(path) as file:
                part = pq.ParquetFile(file).read(columns=["ts_recv_ns", "size"], use_threads=False)
            return tuple(part[c].to_numpy().astype(np.int64) for c in ("ts_recv_ns", "size"))

        return self._read(one, paths, self.rows)

    def forget(self, kept: set[str]) -> None:
        """Drops times and sizes of all other segments."""
        self.rows = {p: x for p, x in self.rows.items() if p in kept}


class Log:
    """One socket's log from a place on: {"segment": s, "row": r, "place": p, "seen": latest receipt}."""

    def __init__(self, seen: Seen, at: str, start: dict[str, int]):
        self.seen, self.start = seen, start
        every, self.ended = seen.listed(at)
        self.paths = every[start["segment"] :]
        self.counts = seen.n_rows(self.paths)
        self.unread = sum(self.counts) - start["row"]

    def ahead(self, most: int, most_bytes: int | None = None) -> tuple[np.ndarray, np.ndarray, list[Span]]:
        """Times and sizes of the next rows, and where they lie: whole segments up to `most` rows or
        `most_bytes` of text, and some more, as several are read at a time."""
        spans, found, n, size, row = [], [], 0, 0, self.start["row"]
        left = iter(zip(self.paths, self.counts, strict=True))
        while n < most and (most_bytes is None or size < most_bytes):
            some, more = [], 0
            while n + more < most and (len(some) < AT_ONCE or more < TASK_ROWS) and (at := next(left, None)):
                some.append(Span(at[0], row, max(0, at[1] - row)))
                more, row = more + some[-1].n, 0
            if not some:
                break
            parts = [tuple(x[s.first :] for x in rows) for s, rows in zip(some, self.seen.times([s.path for s in some]), strict=True)]
            spans, found, n, size = spans + some, found + parts, n + more, size + sum(int(x[1].sum()) for x in parts)
        whole = lambda i: np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64)
        return whole(0), whole(1), spans

    def after(self, n: int, spans: list[Span], ts: np.ndarray) -> dict[str, int]:
        """The place n rows on."""
        segment, row, left = self.start["segment"], self.start["row"], n
        for span in spans:
            if left < span.n:
                row = span.first + left
                break
            segment, row, left = segment + 1, 0, left - span.n
        return {"segment": segment, "row": row, "place": self.start["place"] + n, "seen": int(ts[n - 1]) if n else self.start["seen"]}


FIRST = {"segment": 0, "row": 0, "place": 0, "seen": -(1 << 63)}


class FrameLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.max_rows = int(options.get("max_rows", MAX_ROWS))
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.patience = int(options.get("patience_ms", PATIENCE_MS)) * 1_000_000
        if min(self.max_rows, self.max_bytes) < 1:
            raise ValueError("max_rows and max_bytes must be >= 1")
        self.seen: Seen | None = None
        self.planned = (_last_offset(options["checkpoint"], self.root) if "checkpoint" in options else None) or self.initialOffset()

    def __getstate__(self) -> dict[str, Any]:
        return self.__dict__ | {"seen": None}  # tasks need none of it

    def initialOffset(self) -> dict[str, Any]:
        return {"root": self.root, "arrivals": 0, "backlog": 0, "logs": {}}

    def _logs(self, start: dict[str, Any], names: Sequence[str] | None = None) -> dict[str, Log]:
        fs, at = opened(self.root)
        if names is None:
            below = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
            names = [f.base_name for f in below if f.type == pafs.FileType.Directory]
        self.seen = self.seen or Seen(fs)
        return {n: Log(self.seen, f"{at.rstrip('/')}/{n}", start["logs"].get(n, FIRST)) for n in sorted(names)}

    def latestOffset(self) -> dict[str, Any]:
        """The end of the next batch: the earliest frames over all logs, within the limits."""
        logs = self._logs(self.planned)
        ahead = {n: log.ahead(self.max_rows, self.max_bytes) for n, log in logs.items()}
        newest = max((int(ts[-1]) if len(ts) else logs[n].start["seen"] for n, (ts, _, _) in ahead.items()), default=0)
        safe = newest
        for n, (ts, _, _) in ahead.items():
            known = int(ts[-1]) if len(ts) else logs[n].start["seen"]
            complete = logs[n].ended and len(ts) == logs[n].unread
            if not complete and (len(ts) < logs[n].unread or newest - known <= self.patience):
                safe = min(safe, known)
        order, owner = _merged(ahead)
        sizes = np.concatenate([s for _, s, _ in ahead.values()] or [np.zeros(0, np.int64)])[order]
        times = np.concatenate([t for t, _, _ in ahead.values()] or [np.zeros(0, np.int64)])[order]
        n = int(min(self.max_rows, np.searchsorted(times, safe, side="right"), max(1, np.searchsorted(np.cumsum(sizes), self.max_bytes, side="right"))))
        if n:
            counts = np.bincount(owner[:n], minlength=len(logs)).tolist()
            self.planned = {
                "root": self.root, "arrivals": self.planned["arrivals"] + n, "backlog": sum(log.unread for log in logs.values()),
                "logs": {name: logs[name].after(k, ahead[name][2], ahead[name][0]) for name, k in zip(logs, counts, strict=True)},
            }
        return self.planned

    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> list[Taken]:
        logs = self._logs(start, list(end["logs"]))
        taken = {}
        for name, log in logs.items():
            n = end["logs"][name]["place"] - log.start["place"]
            ts, sizes, spans = log.ahead(n)
            taken[name] = (ts[:n], sizes[:n], spans)
        order, owner = _merged(taken)
        numbers = np.empty(len(order), np.int64)
        numbers[order] = np.arange(start["arrivals"], start["arrivals"] + len(order))
        out, at = [], 0
        for name, (ts, _, spans) in taken.items():
            done, parts, size = 0, [], 0
            for span in spans:
                k = min(span.n, len(ts) - done)
                if k > 0:
                    if parts and size + k > TASK_ROWS:
                        out.append(Taken(name, parts, end["backlog"]))
                        parts, size = [], 0
                    parts.append(Part(Span(span.path, span.first, k), logs[name].start["place"] + done, numbers[at : at + k]))
                    at, done, size = at + k, done + k, size + k
            if parts:
                out.append(Taken(name, parts, end["backlog"]))
        self.seen.forget({p for log in self._logs(end, list(end["logs"])).values() for p in log.paths})
        return out

    def read(self, partition: Taken) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.root)
        for part in partition.parts:
            yield from self._rows(fs, partition, part)

    def _rows(self, fs: pafs.FileSystem, partition: Taken, part: Part) -> Iterator[pa.RecordBatch]:
        span, done = part.span, 0
        names = ["arrival", "socket", "place", "ts_recv_ns", "symbol", "raw", "backlog"]
        skipped = 0
        with fs.open_input_file(span.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(8192, columns=["ts_recv_ns", "symbol", "raw"]):
                first = max(0, span.first - skipped)
                skipped += batch.num_rows
                rows = batch.slice(first, span.n - done) if first < batch.num_rows else batch.slice(0, 0)
                if rows.num_rows:
                    n = rows.num_rows
                    place = pa.array(np.arange(part.place + done, part.place + done + n))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(part.arrivals[done : done + n]), pa.array([partition.socket] * n), place, pc.cast(rows.column("ts_recv_ns"), pa.int64()),
                        rows.column("symbol").cast(pa.string()), rows.column("raw").cast(pa.string()), pa.array([partition.backlog] * n, pa.int64())], names)
                    done += n
                if done == span.n:
                    return

    def commit(self, end: dict[str, Any]) -> None:
        """Segments are kept: how long is for whoever lands them to say."""

    def stop(self) -> None:
        pass


def _merged(ahead: dict[str, tuple[np.ndarray, np.ndarray, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    """Order of all rows by receipt, then log, then place; and the log that each in order is of."""
    times = np.concatenate([t for t, _, _ in ahead.values()] or [np.zeros(0, np.int64)])
    of = np.repeat(np.arange(len(ahead)), [len(t) for t, _, _ in ahead.values()])
    order = np.argsort(times, kind="stable")  # logs stand one after the other, each in order
    return order, of[order]


def _last_offset(checkpoint: str, root: str) -> dict[str, Any] | None:
    """The last offset that the query of this checkpoint has planned for this root."""
    fs, at = opened(checkpoint)
    files = fs.get_file_info(pafs.FileSelector(f"{at.rstrip('/')}/offsets", allow_not_found=True))
    batches = sorted((int(f.base_name), f.path) for f in files if f.base_name.isdigit())
    for _, path in reversed(batches):
        with fs.open_input_stream(path) as file:
            lines = file.read().decode().splitlines()
        for line in lines[2:]:  # version and metadata stand before the sources' offsets
            offset = json.loads(line) if line.startswith("{") else None
            if isinstance(offset, dict) and offset.get("root") == root:
                return offset
    return None


class FrameLog(DataSource):
    """Format `frame_log`; options path, checkpoint, max_rows, max_bytes, patience_ms."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> FrameLogReader:
        return FrameLogReader(dict(self.options))


def stream(spark: SparkSession, root: str, checkpoint: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, patience_ms: int = PATIENCE_MS) -> DataFrame:
    """The merged logs under root as a stream, for the query that will run with this checkpoint."""
    spark.dataSource.register(FrameLog)
    options = {"checkpoint": checkpoint, "max_rows": max_rows, "max_bytes": max_bytes, "patience_ms": patience_ms}
    return spark.readStream.format(NAME).options(**options).load(root)
