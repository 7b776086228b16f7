"""Wire frames (JSON text) as typed rows.

Frames are rows of (raw string, ts_recv_ns long). A frame that cannot be decoded, or is of another
kind, gives no row; `rejected` counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ms_to_ns, sign_of_maker_flag

INFO = "symbols array<struct<symbol: string, baseAsset: string, quoteAsset: string, filters: array<struct<filterType: string, tickSize: string, minPrice: string, maxPrice: string, stepSize: string, minQty: string, maxQty: string, notional: string>>>>"


def unwrapped(raw: Column | str = "raw") -> Column:
    """The payload of a combined-stream envelope, or the frame itself."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.when(F.get_json_object(raw, "$.stream").isNotNull(), F.get_json_object(raw, "$.data")).otherwise(raw)


def kind(raw: Column | str = "raw") -> Column:
    return F.get_json_object(unwrapped(raw), "$.e")


def _levels(name: str) -> Column:
    """A field [["price", "qty"], ...] as an array of struct(price, qty)."""
    return F.transform(_field(name, "array<array<string>>"), lambda x: F.struct(F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("qty")))


def _field(name: str, kind: str = "string") -> Column:
    """A field of the frame, which is parsed once. Paths tell e from E and u from U."""
    return F.try_variant_get("m", f"$.{name}", kind)


def _common(exchange: str, symbol: Column, ts: Column) -> list[Column]:
    return [F.lit(exchange).alias("exchange"), F.upper(symbol).alias("symbol"), ts.alias("ts_event_ns"), F.col("ts_recv_ns")]


def _parsed(frames: DataFrame) -> DataFrame:
    """Frames with their payload as `m`. Filters on it stay above the explode, where they would
    else be pushed below and parse the frame again for each field that they look at."""
    rows = frames.select("*", F.explode(F.array(F.try_parse_json("raw"))).alias("m"))
    inside = F.when(F.try_variant_get("m", "$.stream", "string").isNotNull(), F.try_variant_get("m", "$.data", "variant")).otherwise(F.col("m"))
    return rows.withColumn("m", inside)


def _time(*names: str) -> Column:
    return F.coalesce(*(ms_to_ns(_field(n, "long")) for n in names), F.col("ts_recv_ns"))


def depth_updates(frames: DataFrame, exchange: str) -> DataFrame:
    """Deltas; their time is E, else T, else the time of receipt."""
    first, final = _field("U", "long"), _field("u", "long")
    rows = _parsed(frames).where((_field("e") == "depthUpdate") & first.isNotNull() & final.isNotNull())
    return rows.select(*_common(exchange, _field("s"), _time("E", "T")), first.alias("first_update_id"), final.alias("final_update_id"), _field("pu", "long").alias("prev_final_update_id"), _levels("b").alias("bids"), _levels("a").alias("asks"))


def prints(frames: DataFrame, exchange: str, event: str = "aggTrade") -> DataFrame:
    """Trades of one event kind (aggTrade or trade); their time is T, else E, else of receipt."""
    number = _field({"aggTrade": "a", "trade": "t"}[event], "long")
    price, qty, maker = _field("p", "double"), _field("q", "double"), _field("m", "boolean")
    rows = _parsed(frames).where((_field("e") == event) & number.isNotNull() & price.isNotNull() & qty.isNotNull() & maker.isNotNull())
    return rows.select(*_common(exchange, _field("s"), _time("T", "E")), number.alias("trade_id"), price.alias("price"), qty.alias("qty"), sign_of_maker_flag(maker).alias("aggressor_sign"))


def rest_snapshots(frames: DataFrame, exchange: str) -> DataFrame:
    """Snapshots from REST bodies; frames also have the symbol asked for."""
    uid = _field("lastUpdateId", "long")
    rows = _parsed(frames).where(uid.isNotNull())
    return rows.select(*_common(exchange, F.col("symbol"), _time("E", "T")), uid.alias("last_update_id"), _levels("bids").alias("bids"), _levels("asks").alias("asks"))


def book_events(frames: DataFrame, *carried: str) -> DataFrame:
    """Depth updates and snapshot bodies in one pass, as processors of books take them: symbol,
    is_snapshot, ids, levels, ts_event_ns, ts_recv_ns, and the columns of the frames named in
    `carried`. A snapshot has its id in all three places, an update that names none before it -1. Frames of other kinds give no row."""
    uid, body = _field("lastUpdateId", "long"), F.col("symbol").isNotNull()
    first, final = _field("U", "long"), _field("u", "long")
    snapshot = body & uid.isNotNull()
    delta = (_field("e") == "depthUpdate") & first.isNotNull() & final.isNotNull()
    either = lambda a, b: F.when(snapshot, a).otherwise(b)
    rows = _parsed(frames).where(F.coalesce(snapshot, F.lit(False)) | F.coalesce(delta, F.lit(False)))
    return rows.select(
        *carried, F.upper(either(F.col("symbol"), _field("s"))).alias("symbol"), snapshot.alias("is_snapshot"), either(uid, first).alias("first_update_id"), either(uid, final).alias("final_update_id"),
        F.coalesce(either(uid, _field("pu", "long")), F.lit(-1)).alias("prev_final_update_id"), either(_levels("bids"), _levels("b")).alias("bids"), either(_levels("asks"), _levels("a")).alias("asks"), _time("E", "T").alias("ts_event_ns"), "ts_recv_ns")


def instruments(bodies: DataFrame, exchange: str) -> DataFrame:
    """One row per symbol of an exchange-info body, sizes as fixed-point strings."""
    s = bodies.select(F.explode(F.from_json("raw", INFO)["symbols"]).alias("s"))
    of = lambda name, field: F.get(F.filter("s.filters", lambda f: f["filterType"] == name), F.lit(0))[field]
    return s.select(
        F.lit(exchange).alias("exchange"), F.col("s.symbol").alias("symbol"), F.col("s.baseAsset").alias("base_asset"), F.col("s.quoteAsset").alias("quote_asset"),
        of("PRICE_FILTER", "tickSize").alias("tick_size"), of("LOT_SIZE", "stepSize").alias("lot_size"), of("PRICE_FILTER", "minPrice").alias("min_price"), of("PRICE_FILTER", "maxPrice").alias("max_price"),
        of("LOT_SIZE", "minQty").alias("min_qty"), of("LOT_SIZE", "maxQty").alias("max_qty"), of("MIN_NOTIONAL", "notional").alias("min_notional"))


def probe_events(frames: DataFrame) -> DataFrame:
    """Depth and trade frames as latency probes, both exchange times kept."""
    event = _field("e")
    rows = _parsed(frames).where(event.isin("depthUpdate", "aggTrade", "trade") & _field("E", "long").isNotNull())
    return rows.select(F.when(event == "depthUpdate", "depth").otherwise("trade").alias("kind"), ms_to_ns(_field("E", "long")).alias("ts_exchange_e_ns"), ms_to_ns(_field("T", "long")).alias("ts_exchange_t_ns"),
                       "ts_recv_ns", _field("U", "long").alias("first_update_id"), _field("u", "long").alias("final_update_id"), _field("pu", "long").alias("prev_final_update_id"))


def rejected(frames: DataFrame) -> DataFrame:
    """One row: frames, and those that no parser takes."""
    known = F.coalesce(kind().isin("depthUpdate", "aggTrade", "trade"), F.lit(False))
    return frames.agg(F.count("*").alias("n_frames"), F.count_if(~known).alias("n_rejected"))


def stream_urls(base: str, symbol: str, speed: str = "100ms") -> dict[str, str]:
    s = symbol.lower()
    depth, trade = f"{s}@depth@{speed}", f"{s}@aggTrade"
    return {"combined": f"{base}/stream?streams={trade}/{depth}", "depth": f"{base}/ws/{depth}", "trade": f"{base}/ws/{trade}"}
