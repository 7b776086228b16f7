"""Tapes: partitioned Parquet of snapshots, deltas and trades; instruments; sidecars."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import decimals, utc_date

LEVELS = T.ArrayType(T.StructType([T.StructField("price", T.DoubleType()), T.StructField("qty", T.DoubleType())]))
_COMMON = [T.StructField("exchange", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("ts_event_ns", T.LongType()), T.StructField("ts_recv_ns", T.LongType())]


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*_COMMON, *(T.StructField(n, t) for n, t in fields)])


SCHEMAS = {
    "snapshots": _schema(("last_update_id", T.LongType()), ("bids", LEVELS), ("asks", LEVELS)),
    "deltas": _schema(("first_update_id", T.LongType()), ("final_update_id", T.LongType()), ("prev_final_update_id", T.LongType()), ("bids", LEVELS), ("asks", LEVELS)),
    "trades": _schema(("trade_id", T.LongType()), ("price", T.DoubleType()), ("qty", T.DoubleType()), ("aggressor_sign", T.ByteType())),
}
#: Total order within a symbol at one event time.
TIEBREAK = {"snapshots": "last_update_id", "deltas": "final_update_id", "trades": "trade_id"}
PROBE = T.StructType([T.StructField("ts_local_ns", T.LongType()), T.StructField("last_update_id", T.LongType()), T.StructField("symbol", T.StringType()), T.StructField("n_levels", T.IntegerType()), T.StructField("bids", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("asks", T.ArrayType(T.ArrayType(T.DoubleType())))])
INSTRUMENT = ("exchange", "symbol", "base_asset", "quote_asset", "tick_size", "lot_size", "min_price", "max_price", "min_qty", "max_qty", "min_notional")


class NoInstrument(LookupError):
    """No run of the tape states its instrument."""


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowspark-"))
        at = spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder, for plans that read it more than once."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def capture_dirs(spark: SparkSession, root: str) -> list[str]:
    """root itself if it holds a tape, else its folders that do, sorted: one per run."""
    if any(exists(spark, f"{root}/{k}") for k in SCHEMAS):
        return [root]
    if not exists(spark, root):
        return []
    fs, at = _fs(spark, root)
    below = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.isDirectory())
    return [d for d in below if any(exists(spark, f"{d}/{k}") for k in SCHEMAS)]


def scan(spark: SparkSession, root: str, kind: str, exchange: str | None = None, symbol: str | None = None, date: str | None = None, row_id: bool = False) -> DataFrame:
    """One kind of event over all runs, in its declared columns; predicates prune partitions. A
    missing or empty tape gives an empty frame of the same schema. With `row_id`, a column of that
    name tells rows apart, in the order of parts and of rows in them."""
    wanted = [*SCHEMAS[kind].names, *["row_id"] * row_id]
    rows = _stored(spark, root, kind, {"exchange": exchange, "symbol": symbol, "date": date})
    if rows is None:
        return spark.createDataFrame([], T.StructType([*SCHEMAS[kind].fields, *[T.StructField("row_id", T.StringType())] * row_id]))
    own = F.concat_ws(":", "_metadata.file_path", F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"))
    return (rows.withColumn("row_id", own) if row_id else rows).select(*wanted)


#: Folders of a stored kind, from the outer one on.
PARTITIONS = ("exchange", "symbol", "date")
_NULL = "__HIVE_DEFAULT_PARTITION__"


def _folder(name: str, value: str | None) -> str:
    """Glob of a partition's folder, as Spark names it; of all, if no value is asked for."""
    if value is None:
        return "*"
    escaped = "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in '"#%\'*/:=?\\\x7f{[]^' else c for c in value)
    return f"{name}={escaped}"


def _pattern(spark: SparkSession, root: str, kind: str, where: dict[str, str | None]) -> str | None:
    """The folders of one kind that a scan reads, over all runs, as one pattern, which Spark resolves;
    None if there are none."""
    fs, at = _fs(spark, root)
    base = root if any(exists(spark, f"{root}/{k}") for k in SCHEMAS) else f"{root}/*"
    asked = [_folder(n, where.get(n)) for n in PARTITIONS]
    while asked and asked[-1] == "*":
        asked.pop()
    pattern = "/".join([base, kind, *asked])
    return pattern if len(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)) or []) else None


def _partition(name: str) -> Column:
    """A partition's value, out of the path of the file. Names are escaped once by the writer, and once
    more where Spark gives the path as a URI."""
    raw = F.regexp_extract("_metadata.file_path", f"/{name}=([^/]*)/", 1)
    value = F.url_decode(F.replace(F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), F.lit("+"), F.lit("%2B")))
    return F.when(raw != _NULL, value)


def _stored(spark: SparkSession, root: str, kind: str, where: dict[str, str | None]) -> DataFrame | None:
    """The stored rows of all runs as one scan, with their partitions as columns. Spark lists the folders
    of many runs in a job; spark.sql.sources.parallelPartitionDiscovery.parallelism says in how many
    tasks, of which a few for each core do."""
    if not (pattern := _pattern(spark, root, kind, where)):
        return None
    inside = T.StructType([f for f in SCHEMAS[kind].fields if f.name not in PARTITIONS])
    rows = spark.read.schema(inside).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(pattern)
    return rows.withColumns({n: _partition(n) for n in PARTITIONS})


def _files(spark: SparkSession, root: str, kind: str, where: dict[str, str | None]) -> DataFrame:
    """path, exchange, symbol, size of the parts; files are listed, none is read."""
    if not (pattern := _pattern(spark, root, kind, where)):
        return spark.createDataFrame([], "path string, exchange string, symbol string, size long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), _partition("exchange").alias("exchange"), _partition("symbol").alias("symbol"), F.col("length").alias("size"))


def stored_bytes(spark: SparkSession, root: str, kind: str, **where: str | None) -> DataFrame:
    """exchange, symbol, bytes of the stored parts."""
    return _files(spark, root, kind, where).groupBy("exchange", "symbol").agg(F.sum("size").alias("bytes"))


def read(spark: SparkSession, root: str, kind: str, **where: str | None) -> DataFrame:
    """The scan, globally sorted by event time, ties by id."""
    return scan(spark, root, kind, **where).orderBy("ts_event_ns", TIEBREAK[kind])


def part_files(spark: SparkSession, root: str, kind: str, exchange: str | None = None, symbol: str | None = None, date: str | None = None) -> list[str]:
    """The parts of these partitions, sorted."""
    return sorted(r["path"] for r in _files(spark, root, kind, {"exchange": exchange, "symbol": symbol, "date": date}).collect())


class LowDisk(OSError):
    """Less space is left than the sink was told to leave."""


def check_space(spark: SparkSession, root: str, least_bytes: int) -> None:
    fs, at = _fs(spark, root)
    while not fs.exists(at) and at.getParent() is not None:
        at = at.getParent()
    left = fs.getStatus(at).getRemaining()
    if left < least_bytes:
        raise LowDisk(f"{left} bytes are left at {root}, fewer than {least_bytes}; nothing was written")


def write(events: DataFrame, root: str, kind: str, compression: str = "zstd", max_rows: int = 5_000_000, exchange: str | None = None, symbol: str | None = None, least_free: int = 0) -> None:
    """Appends events to the tape, by exchange, symbol and UTC date. Spark's committer makes the
    parts appear at once or not at all. Rows are dealt out by (exchange, symbol, date, hour), so a
    hot symbol's day is written by several tasks, and a part has at most max_rows rows. Events of
    an exchange or symbol other than the given ones fail the write, as does a file system with
    fewer than least_free bytes."""
    if least_free:
        check_space(events.sparkSession, root, least_free)
    schema = SCHEMAS[kind]
    rows = events.select(*(F.col(f.name).cast(f.dataType) for f in schema)).withColumn("date", utc_date("ts_event_ns"))
    for name, value in (("exchange", exchange), ("symbol", symbol)):
        if value is not None:
            foreign = F.raise_error(F.concat(F.lit(f"the tape is of {name} {value}, not of "), F.coalesce(name, F.lit("null")))).cast("string")
            rows = rows.withColumn(name, F.when(F.col(name).eqNullSafe(F.lit(value)), F.col(name)).otherwise(foreign))
    hour = F.expr("ts_event_ns div 3600000000000")
    rows = rows.repartition("exchange", "symbol", "date", hour).sortWithinPartitions("exchange", "symbol", "date", "ts_event_ns", TIEBREAK[kind])
    rows.write.mode("append").partitionBy("exchange", "symbol", "date").option("compression", compression).option("maxRecordsPerFile", max_rows).parquet(f"{root}/{kind}")


def events_frame(spark: SparkSession, kind: str, rows: list[dict]) -> DataFrame:
    """A frame of a kind's schema from dicts, e.g. of one fetched snapshot."""
    return spark.createDataFrame(rows, SCHEMAS[kind])


def write_stream(events: DataFrame, root: str, kind: str, checkpoint: str, every: str | None = None):
    """The streaming sink: each micro-batch is appended to the tape once."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: write(batch, root, kind))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def write_instrument(spark: SparkSession, root: str, spec: dict[str, str]) -> None:
    """instrument.json: fixed-point strings, as given."""
    fs, at = _fs(spark, f"{root}/instrument.json")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps({k: spec[k] for k in INSTRUMENT if k in spec}, indent=2).encode()))
    out.close()


def instrument(spark: SparkSession, root: str) -> DataFrame | None:
    """The tape's one-row instrument, decimals as decimal(38,18) and precisions of tick and lot.
    Runs that disagree raise ValueError; null where no run has one."""
    paths = [f"{d}/instrument.json" for d in capture_dirs(spark, root)]
    paths = [p for p in dict.fromkeys([*paths, f"{root}/instrument.json"]) if exists(spark, p)]
    if not paths:
        return None
    schema = ", ".join(f"{c} string" for c in INSTRUMENT)
    rows = spark.read.schema(schema).option("multiLine", True).json(paths).distinct()
    if len(rows.take(2)) > 1:
        raise ValueError(f"runs under {root} state different instruments")
    return _typed(rows)


#: The instrument of tapes that were recorded before instruments were stored.
LEGACY = {
    "exchange": "binance_futures", "symbol": "BTCUSDT", "base_asset": "BTC", "quote_asset": "USDT", "tick_size": "0.1", "lot_size": "0.001",
    "min_price": "0.1", "max_price": "1000000.0", "min_qty": "0.001", "max_qty": "1000", "min_notional": "10",
}


def resolve_instrument(spark: SparkSession, root: str, symbol: str) -> DataFrame:
    """The tape's instrument, or the legacy one where the tape states none and it is asked for."""
    found = instrument(spark, root)
    if found is None:
        if symbol.upper() != LEGACY["symbol"]:
            raise NoInstrument(f"no instrument.json under {root}")
        found = _typed(spark.createDataFrame([tuple(LEGACY[c] for c in INSTRUMENT)], ", ".join(f"{c} string" for c in INSTRUMENT)))
    if not found.where(F.upper("symbol") == symbol.upper()).take(1):
        raise ValueError(f"the instrument under {root} is not {symbol}")
    return found


def _typed(rows: DataFrame) -> DataFrame:
    sizes = INSTRUMENT[4:]
    return rows.select(*INSTRUMENT[:4], *(F.col(c).cast("decimal(38,18)").alias(c) for c in sizes), decimals("tick_size").alias("price_precision"), decimals("lot_size").alias("size_precision"))


def probes(spark: SparkSession, path: str) -> DataFrame:
    """A probe sidecar (JSON lines) with levels as structs."""
    level = lambda c: F.transform(c, lambda x: F.struct(F.get(x, F.lit(0)).alias("price"), F.get(x, F.lit(1)).alias("qty")))
    return spark.read.schema(PROBE).json(path).withColumns({"bids": level("bids"), "asks": level("asks")})


def write_probes(probes: DataFrame, path: str) -> None:
    """Appends reference books (as `probes` gives them) to a sidecar of JSON lines."""
    pairs = lambda c: F.transform(c, lambda x: F.array(x["price"], x["qty"])).alias(c)
    rows = probes.select("ts_local_ns", "last_update_id", "symbol", F.coalesce("n_levels", F.size("bids") + F.size("asks")).alias("n_levels"), pairs("bids"), pairs("asks"))
    rows.write.mode("append").json(path)


def write_clock_samples(samples: DataFrame, path: str) -> None:
    samples.select("phase", "local_before_ns", "server_time_ns", "local_after_ns").write.mode("append").json(path)


def clock_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("phase string, local_before_ns long, server_time_ns long, local_after_ns long").json(path)
