"""Trade-volume operators: cumulative delta, equal-volume buckets, toxicity.

Trades are rows of (keys, ts_event_ns, trade_id, price, qty, aggressor_sign).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import Order, dense, rolling_by_index, running_sum
from ..functions.scalars import bar_start, normal_cdf

TOLERANCE = 1e-9
CHUNK_NS = 3_600_000_000_000


def trade_order(keys: tuple[str, ...]) -> Order:
    return Order.of_time(keys, ("ts_event_ns", "trade_id"), "ts_event_ns", CHUNK_NS)


def checked(trades: DataFrame) -> DataFrame:
    """Trades whose signs and quantities are checked as they stream by: a bad one fails the query."""
    sign = F.when(F.col("aggressor_sign").isin(-1, 1), F.col("aggressor_sign")).otherwise(F.raise_error("aggressor_sign must be +1 or -1").cast("byte"))
    qty = F.when(F.col("qty") < 0, F.raise_error("qty must be non-negative").cast("double")).otherwise(F.col("qty"))
    return trades.withColumns({"aggressor_sign": sign, "qty": qty})


def trade_delta() -> Column:
    return F.col("qty") * F.col("aggressor_sign")


def cvd(trades: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Trades with delta and its running sum."""
    return running_sum(checked(trades).withColumn("delta", trade_delta()), trade_order(keys), cvd=F.col("delta"))


def cvd_bars(trades: DataFrame, keys: tuple[str, ...], width: int, origin: int = 0) -> DataFrame:
    """keys, bar_start_ns, delta, cvd for every bar from the first trade to the last."""
    if width <= 0:
        raise ValueError("width must be > 0")
    bars = checked(trades).groupBy(*keys, bar_start("ts_event_ns", width, origin).alias("bar_start_ns")).agg(F.sum(trade_delta()).alias("delta"))
    rows = dense(bars, keys, "bar_start_ns", width).withColumn("delta", F.coalesce("delta", F.lit(0.0)))
    return running_sum(rows, Order.of_time(keys, ("bar_start_ns",), "bar_start_ns", 4096 * width), cvd=F.col("delta")).select(*keys, "bar_start_ns", "delta", "cvd")


def volume_buckets(trades: DataFrame, keys: tuple[str, ...], size: float) -> DataFrame:
    """keys, bucket, buy, sell, close of every complete bucket of `size`. Trades over a border
    are split pro rata; a bucket closes at the trade that fills it."""
    if not size > 0:
        raise ValueError("size must be > 0")
    rows = running_sum(checked(trades).where("qty > 0"), trade_order(keys), c1=F.col("qty")).withColumn("c0", F.col("c1") - F.col("qty"))
    first = F.floor(F.col("c0") / size + TOLERANCE)
    last = F.greatest(first, F.ceil(F.col("c1") / size - TOLERANCE) - 1)
    rows = rows.withColumn("bucket", F.explode(F.sequence(first, last)))
    part = F.least("c1", (F.col("bucket") + 1) * F.lit(float(size))) - F.greatest("c0", F.col("bucket") * F.lit(float(size)))
    got = rows.groupBy(*keys, "bucket").agg(
        F.sum(F.when(F.col("aggressor_sign") > 0, part).otherwise(0.0)).alias("buy"),
        F.max_by("price", F.struct("ts_event_ns", "trade_id")).alias("close"),
    )
    total = trades.where("qty > 0").groupBy(*keys).agg(F.floor(F.sum("qty") / size + TOLERANCE).alias("__n"))
    got = got.join(total, list(keys)).where("bucket < __n")
    buy = F.least(F.lit(float(size)), F.greatest(F.lit(0.0), F.col("buy")))
    return got.select(*keys, "bucket", buy.alias("buy"), (F.lit(float(size)) - buy).alias("sell"), "close")


def remainder(trades: DataFrame, keys: tuple[str, ...], size: float) -> DataFrame:
    """keys, n_buckets, remainder: complete buckets and the volume left over."""
    total = trades.where("qty > 0").groupBy(*keys).agg(F.sum("qty").alias("v"))
    n = F.floor(F.col("v") / size + TOLERANCE)
    return total.select(*keys, n.alias("n_buckets"), F.greatest(F.lit(0.0), F.col("v") - n * size).alias("remainder"))


def bulk_classified(buckets: DataFrame, first_price: DataFrame, keys: tuple[str, ...], size: float, sigma: float | None = None, phi=normal_cdf) -> DataFrame:
    """Buckets with buy and sell from price changes: size times Phi(change / sigma). The first
    change is taken from `first_price` (keys, price); sigma is the sample deviation unless given,
    and without one every bucket is half and half."""
    before = buckets.select(*keys, (F.col("bucket") + 1).alias("bucket"), F.col("close").alias("__before"))
    rows = buckets.join(before, [*keys, "bucket"], "left").join(first_price.withColumnRenamed("price", "__first"), list(keys))
    rows = rows.withColumn("change", F.col("close") - F.coalesce("__before", "__first"))
    if sigma is None:
        spread = rows.groupBy(*keys).agg(F.coalesce(F.stddev_samp("change"), F.lit(0.0)).alias("__sigma"))
        rows = rows.join(spread, list(keys))
    else:
        rows = rows.withColumn("__sigma", F.lit(float(sigma)))
    z = F.when(F.col("__sigma") > 0, F.col("change") / F.col("__sigma")).otherwise(0.0)
    rows = rows.withColumn("buy", F.lit(float(size)) * phi(z))
    return rows.select(*keys, "bucket", "buy", (F.lit(float(size)) - F.col("buy")).alias("sell"), "close", "change")


def first_prices(trades: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return trades.where("qty > 0").groupBy(*keys).agg(F.min_by("price", F.struct("ts_event_ns", "trade_id")).alias("price"))


def toxicity(buckets: DataFrame, keys: tuple[str, ...], size: float, window: int) -> DataFrame:
    """keys, bucket, vpin: mean |sell - buy| over `window` buckets, from the first whole window on."""
    if window < 1:
        raise ValueError("window must be >= 1")
    rows = rolling_by_index(buckets, keys, "bucket", window, F.abs(F.col("sell") - F.col("buy")), "__sum")
    vpin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__sum") / (window * float(size))))
    return rows.where(F.col("bucket") >= window - 1).select(*keys, "bucket", vpin.alias("vpin"))


def vpin(trades: DataFrame, keys: tuple[str, ...], size: float, window: int, classification: str = "aggressor", sigma: float | None = None) -> DataFrame:
    buckets = volume_buckets(trades, keys, size)
    if classification == "bvc":
        buckets = bulk_classified(buckets, first_prices(trades, keys), keys, size, sigma)
    elif classification != "aggressor":
        raise ValueError(f"unknown classification: {classification!r}")
    return toxicity(buckets, keys, size, window)
