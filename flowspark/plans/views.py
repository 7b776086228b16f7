"""Market tapes derived from the star-schema tables, the same way in Spark and in SQL.

Prices and quantities are whole numbers in doubles, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import Order, previous

KEYS = ("symbol",)
HOUR = 3_600_000_000_000
LEVELS = 3
TICK = 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a timestamp without time zone (or with one)."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(name))
    return F.unix_micros(name)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_of(_events(spark, sf_dir))


def trades_of(e: DataFrame) -> DataFrame:
    ts = micros(e, "ts") * 1000
    return e.select(
        F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"), ts.alias("ts_event_ns"), (ts + (F.col("event_id") % 97) * 1_000_000).alias("ts_recv_ns"),
        F.col("event_id").alias("trade_id"), F.rint(F.col("value") * 100).alias("price"),
        (F.lit(1) + F.regexp_extract("props", "[0-9]+", 0).cast("long") % 20).cast("double").alias("qty"),
        F.when(F.col("event_type").isin("click", "purchase", "signup"), 1).otherwise(-1).cast("byte").alias("aggressor_sign"))


TRADES_SQL = """t AS (SELECT 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol, epoch_us(ts) * 1000 AS ts_event_ns,
    epoch_us(ts) * 1000 + (event_id % 97) * 1000000 AS ts_recv_ns, event_id AS trade_id, round_even(value * 100, 0) AS price,
    CAST(1 + CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 20 AS DOUBLE) AS qty,
    CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE -1 END AS aggressor_sign FROM events)"""


def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l1_of(_events(spark, sf_dir))


def l1_of(e: DataFrame) -> DataFrame:
    bid = (F.lit(1000) + F.col("event_id") * 7 % 5).cast("double")
    return e.select(
        F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"), F.expr("event_id div 2500").alias("epoch"), F.col("event_id").alias("seq"), (micros(e, "ts") * 1000).alias("ts_event_ns"),
        bid.alias("bid_px"), (F.lit(1) + F.col("user_id") % 9).cast("double").alias("bid_qty"), (bid + 1 + F.col("event_id") % 3).alias("ask_px"), (F.lit(1) + F.col("event_id") % 11).cast("double").alias("ask_qty"))


L1_SQL = """l AS (SELECT 'S' || CAST(user_id % 8 AS VARCHAR) AS symbol, event_id // 2500 AS epoch, event_id AS seq, epoch_us(ts) * 1000 AS ts_event_ns,
    CAST(1000 + event_id * 7 % 5 AS DOUBLE) AS bid_px, CAST(1 + user_id % 9 AS DOUBLE) AS bid_qty,
    CAST(1000 + event_id * 7 % 5 + 1 + event_id % 3 AS DOUBLE) AS ask_px, CAST(1 + event_id % 11 AS DOUBLE) AS ask_qty FROM events)"""


def lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels; the third is missing in every eleventh state."""
    return lm_of(_events(spark, sf_dir))


def lm_of(e: DataFrame) -> DataFrame:
    top = l1_of(e)
    there = lambda i, c: c if i < LEVELS - 1 else F.when(F.col("seq") % 11 != 0, c)
    step = lambda name, f: F.array(*(there(i, f(i)) for i in range(LEVELS))).alias(name)
    return top.select(
        "symbol", "epoch", "seq", "ts_event_ns", step("bid_px", lambda i: F.col("bid_px") - i), step("bid_qty", lambda i: (F.col("bid_qty") + F.col("seq") * i % 7)),
        step("ask_px", lambda i: F.col("ask_px") + i), step("ask_qty", lambda i: (F.col("ask_qty") + F.col("seq") * i % 5)))


LM_SQL = L1_SQL + """, m AS (SELECT symbol, epoch, seq, ts_event_ns, i, CASE WHEN i < 2 OR seq % 11 <> 0 THEN bid_px - i END AS bid_px,
    CASE WHEN i < 2 OR seq % 11 <> 0 THEN bid_qty + seq * i % 7 END AS bid_qty, CASE WHEN i < 2 OR seq % 11 <> 0 THEN ask_px + i END AS ask_px,
    CASE WHEN i < 2 OR seq % 11 <> 0 THEN ask_qty + seq * i % 5 END AS ask_qty FROM l, (SELECT unnest(range(0, 3)) AS i))"""


def level_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, side and price: 0 deletes the level."""
    return level_changes_of(table(spark, sf_dir, "lineitem"))


def level_changes_of(lineitem: DataFrame) -> DataFrame:
    bid = F.col("l_linestatus") == "F"
    x = F.col("l_partkey") % 40
    rows = lineitem.select(
        F.col("l_orderkey").alias("k"), F.when(bid, "bid").otherwise("ask").alias("side"), F.when(bid, 100 - x).otherwise(101 + x).cast("double").alias("price"), "l_returnflag", "l_quantity")
    return rows.groupBy("k", "side", "price").agg(F.when(F.max("l_returnflag") == "R", 0.0).otherwise(F.max("l_quantity")).alias("qty"))


CHANGES_SQL = """c AS (SELECT l_orderkey AS k, CASE WHEN l_linestatus = 'F' THEN 'bid' ELSE 'ask' END AS side,
    CAST(CASE WHEN l_linestatus = 'F' THEN 100 - l_partkey % 40 ELSE 101 + l_partkey % 40 END AS DOUBLE) AS price,
    CASE WHEN max(l_returnflag) = 'R' THEN 0.0 ELSE max(l_quantity) END AS qty FROM lineitem GROUP BY 1, 2, 3)"""


def delta_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delta per order in four symbols, with breaks of the chain, but for its levels: orders alone say it."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("B"), (k % 4).cast("string")).alias("symbol"))
    o = previous(o, Order(("symbol",), ("k",), F.expr(f"k div {1 << 20}")), ["k"])
    o = o.withColumn("pu", F.coalesce(F.col("prev.k") * 10 + 9, F.col("k") * 10 - 1) - F.when(F.col("k") % 400 == 7, 1).otherwise(0)).drop("prev")
    return o.select(
        "symbol", (F.col("k") * 100_000_000).alias("ts_event_ns"), (F.col("k") * 100_000_000 + F.col("k") % 50 * 1_000_000).alias("ts_recv_ns"), (F.col("k") * 10).alias("first_update_id"), (F.col("k") * 10 + 9).alias("final_update_id"),
        F.col("pu").alias("prev_final_update_id"), F.col("k").alias("row_id"))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deltas with their levels. Lines are shuffled once, by order, for their levels, the arrays of
    these and the join."""
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("price", "qty"))))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_partkey", "l_returnflag", "l_quantity")
    levels = level_changes_of(lines.repartition("l_orderkey")).groupBy("k").agg(side("bid").alias("bids"), side("ask").alias("asks"))
    empty = F.expr("CAST(array() AS array<struct<price:double,qty:double>>)")
    rows = delta_headers(spark, sf_dir).join(levels.withColumnRenamed("k", "row_id"), "row_id", "left")
    return rows.select(
        "symbol", "ts_event_ns", "ts_recv_ns", "first_update_id", "final_update_id", "prev_final_update_id", F.coalesce("bids", empty).alias("bids"), F.coalesce("asks", empty).alias("asks"), "row_id")


DELTAS_SQL = CHANGES_SQL + """, d AS (SELECT o_orderkey AS k, 'B' || CAST(o_orderkey % 4 AS VARCHAR) AS symbol, o_orderkey * 100000000 AS ts_event_ns,
    o_orderkey * 100000000 + o_orderkey % 50 * 1000000 AS ts_recv_ns, o_orderkey * 10 AS first_update_id, o_orderkey * 10 + 9 AS final_update_id,
    coalesce(lag(o_orderkey * 10 + 9) OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey), o_orderkey * 10 - 1) - CASE WHEN o_orderkey % 400 = 7 THEN 1 ELSE 0 END AS prev_final_update_id FROM orders)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed full book at every 125th order of a symbol; every tenth is crossed, and half are
    off the grid by a quarter tick at one level."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").where(F.expr("(o_orderkey div 4) % 125 = 0")).select(k.alias("k"), F.expr("o_orderkey div 500").alias("g"))
    level = lambda price, qty: F.struct(price.cast("double").alias("price"), qty.cast("double").alias("qty"))
    n = F.sequence(F.lit(0), F.lit(39))
    bids = F.transform(n, lambda i: level(100 - i + F.when((i == 0) & (F.col("g") % 10 == 9), 1).otherwise(0), 5 + (i + F.col("g")) % 7))
    asks = F.transform(n, lambda i: level(101 + i + F.when((i == 39) & (F.col("g") % 2 == 1), 0.25).otherwise(0.0), 5 + (i * 2 + F.col("g")) % 9))
    return rows.select(
        F.concat(F.lit("B"), (F.col("k") % 4).cast("string")).alias("symbol"), (F.col("k") * 100_000_000 + 5_000_000).alias("ts_event_ns"), (F.col("k") * 100_000_000 + 7_000_000).alias("ts_recv_ns"),
        (F.col("k") * 10 + 9).alias("last_update_id"), bids.alias("bids"), asks.alias("asks"), F.col("k").alias("row_id"))


SNAPSHOTS_SQL = """s AS (SELECT o_orderkey AS k, 'B' || CAST(o_orderkey % 4 AS VARCHAR) AS symbol, o_orderkey // 500 AS g, o_orderkey * 100000000 + 5000000 AS ts_event_ns,
    o_orderkey * 100000000 + 7000000 AS ts_recv_ns, o_orderkey * 10 + 9 AS last_update_id FROM orders WHERE (o_orderkey // 4) % 125 = 0),
sl AS (SELECT s.*, i, side, CAST(CASE WHEN side = 'bid' THEN 100 - i + CASE WHEN i = 0 AND g % 10 = 9 THEN 1 ELSE 0 END
      ELSE 101 + i + CASE WHEN i = 39 AND g % 2 = 1 THEN 0.25 ELSE 0 END END AS DOUBLE) AS price,
    CAST(CASE WHEN side = 'bid' THEN 5 + (i + g) % 7 ELSE 5 + (i * 2 + g) % 9 END AS DOUBLE) AS qty
    FROM s, (SELECT unnest(range(0, 40)) AS i), (VALUES ('bid'), ('ask')) v(side))"""


def depth_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth updates as wire frames, every third in a combined-stream envelope, some broken."""
    d = deltas(spark, sf_dir)
    pairs = lambda c: F.transform(c, lambda x: F.array(x["price"].cast("string"), x["qty"].cast("string")))
    body = F.to_json(F.struct(
        F.lit("depthUpdate").alias("e"), (F.col("row_id") * 100).alias("E"), F.lower("symbol").alias("s"), F.col("first_update_id").alias("U"), F.col("final_update_id").alias("u"), F.col("prev_final_update_id").alias("pu"), pairs("bids").alias("b"), pairs("asks").alias("a")))
    raw = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit('{"stream":"x","data":'), body, F.lit("}"))).when(F.col("row_id") % 101 == 1, F.substring(body, 1, 20)).otherwise(body)
    return d.select(raw.alias("raw"), "ts_recv_ns")


def trade_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    body = F.to_json(F.struct(
        F.lit("aggTrade").alias("e"), F.col("symbol").alias("s"), F.col("trade_id").alias("a"), F.col("price").cast("string").alias("p"), F.col("qty").cast("string").alias("q"),
        F.expr("ts_event_ns div 1000000").alias("T"), (F.col("aggressor_sign") < 0).alias("m")))
    return t.select(F.when(F.col("trade_id") % 97 == 5, F.lit("not json")).otherwise(body).alias("raw"), "ts_recv_ns")
