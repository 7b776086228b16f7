"""The registered queries over the derived tapes, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import book, chain, convert, flow, lookup, quality, regress, validate, volume
from ..sources import tape, wire
from ..streaming import processors
from . import views as V
from .views import CHANGES_SQL, DELTAS_SQL, HOUR, KEYS, L1_SQL, LM_SQL, SNAPSHOTS_SQL, TICK, TRADES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BUCKET, WINDOW = 250.0, 5
AT_NS, AT_ID = 700_000_000_000, 70_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as the query of its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


BAR = f"(ts_event_ns - ((ts_event_ns % {HOUR}) + {HOUR}) % {HOUR})"
CVD_SQL = f"WITH {TRADES_SQL} SELECT symbol, trade_id, qty * aggressor_sign AS delta, sum(qty * aggressor_sign) OVER (PARTITION BY symbol ORDER BY ts_event_ns, trade_id) AS cvd FROM t"
E_SQL = """CASE WHEN bid_px >= pb THEN 1 ELSE 0 END * bid_qty - CASE WHEN bid_px <= pb THEN 1 ELSE 0 END * pbq
    - CASE WHEN ask_px <= pa THEN 1 ELSE 0 END * ask_qty + CASE WHEN ask_px >= pa THEN 1 ELSE 0 END * paq"""
P_SQL = f"""{L1_SQL}, p AS (SELECT *, lag(epoch) OVER w AS pe, lag(bid_px) OVER w AS pb, lag(bid_qty) OVER w AS pbq, lag(ask_px) OVER w AS pa, lag(ask_qty) OVER w AS paq
    FROM l WINDOW w AS (PARTITION BY symbol ORDER BY seq)), e AS (SELECT symbol, epoch, seq, ts_event_ns, {E_SQL} AS e FROM p WHERE pe = epoch)"""
MP_SQL = f"""{LM_SQL}, p AS (SELECT *, lag(epoch) OVER w AS pe, lag(bid_px) OVER w AS pb, lag(bid_qty) OVER w AS pbq, lag(ask_px) OVER w AS pa, lag(ask_qty) OVER w AS paq
    FROM m WINDOW w AS (PARTITION BY symbol, i ORDER BY seq)),
    f AS (SELECT *, CASE WHEN bid_px IS NULL OR pb IS NULL THEN NULL ELSE {E_SQL} END AS e FROM p)"""


@query(f"WITH {TRADES_SQL} SELECT ts_event_ns, trade_id, price, qty FROM t WHERE symbol = 'S3' AND ts_event_ns <= 1705000000000000000")
def scan_pruned(spark: SparkSession, d: str) -> DataFrame:
    return V.trades(spark, d).where("symbol = 'S3' and ts_event_ns <= 1705000000000000000").select("ts_event_ns", "trade_id", "price", "qty")


@query(f"WITH {TRADES_SQL} SELECT symbol, ts_event_ns, trade_id, price, qty, CAST(aggressor_sign AS TINYINT) AS aggressor_sign FROM t")
def tape_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Trades written as a partitioned tape and read back by its scan."""
    root = tape.work_path(spark, "tape")
    tape.write(V.trades(spark, d).withColumn("exchange", F.lit("x")), root, "trades")
    return tape.scan(spark, root, "trades", exchange="x").drop("exchange", "ts_recv_ns")


@query(f"WITH {TRADES_SQL} SELECT trade_id, qty * aggressor_sign AS delta FROM t")
def trade_delta(spark: SparkSession, d: str) -> DataFrame:
    return volume.checked(V.trades(spark, d)).select("trade_id", volume.trade_delta().alias("delta"))


@query(CVD_SQL)
def cvd(spark: SparkSession, d: str) -> DataFrame:
    return volume.cvd(V.trades(spark, d), KEYS).select("symbol", "trade_id", "delta", "cvd")


@query(f"""WITH {TRADES_SQL}, b AS (SELECT symbol, {BAR} AS bar_start_ns, sum(qty * aggressor_sign) AS delta FROM t GROUP BY 1, 2),
    g AS (SELECT symbol, unnest(range(min(bar_start_ns), max(bar_start_ns) + 1, {HOUR})) AS bar_start_ns FROM b GROUP BY symbol)
    SELECT symbol, bar_start_ns, coalesce(delta, 0) AS delta, sum(coalesce(delta, 0)) OVER (PARTITION BY symbol ORDER BY bar_start_ns) AS cvd FROM g LEFT JOIN b USING (symbol, bar_start_ns)""")
def cvd_bars(spark: SparkSession, d: str) -> DataFrame:
    return volume.cvd_bars(V.trades(spark, d), KEYS, HOUR)


@query(f"WITH {P_SQL} SELECT symbol, epoch, seq, e FROM e")
def ofi_events(spark: SparkSession, d: str) -> DataFrame:
    return flow.events(V.l1(spark, d), KEYS).select("symbol", "epoch", "seq", "e")


@query(f"""WITH {P_SQL}, n AS (SELECT symbol, e, (row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1) // 10 AS "window" FROM e)
    SELECT symbol, "window", count(*) AS n_events, sum(e) AS e FROM n GROUP BY 1, 2 HAVING count(*) = 10""")
def ofi_event_windows(spark: SparkSession, d: str) -> DataFrame:
    return flow.event_windows(flow.events(V.l1(spark, d), KEYS), KEYS, 10)


BARS_SQL = f"""a AS (SELECT symbol, {BAR} AS bar_start_ns, sum(CASE WHEN pe = epoch THEN {E_SQL} ELSE 0 END) AS ofi, count(pe) AS n,
        min(CASE WHEN pe IS NOT NULL THEN epoch END) AS lo, max(CASE WHEN pe IS NOT NULL THEN epoch END) AS hi, arg_max((bid_px + ask_px) / 2, seq) AS m0 FROM p GROUP BY 1, 2),
    r AS (SELECT symbol, min(bar_start_ns) AS f, max(bar_start_ns) AS z FROM a WHERE n > 0 GROUP BY 1),
    g AS (SELECT symbol, unnest(range(f, z + 1, {HOUR})) AS bar_start_ns FROM r),
    j AS (SELECT g.symbol, g.bar_start_ns, coalesce(ofi, 0) AS ofi, coalesce(n, 0) AS n, lo, hi, m0 FROM g LEFT JOIN a ON g.symbol = a.symbol AND g.bar_start_ns = a.bar_start_ns),
    k AS (SELECT *, last_value(m0 IGNORE NULLS) OVER b AS mid, last_value(hi IGNORE NULLS) OVER b AS ph, first_value(lo IGNORE NULLS) OVER f AS nl FROM j
      WINDOW b AS (PARTITION BY symbol ORDER BY bar_start_ns ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY symbol ORDER BY bar_start_ns ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    bars AS (SELECT symbol, bar_start_ns, ofi, mid, mid - lag(mid) OVER w AS delta_mid, lead(mid) OVER w - mid AS delta_mid_lead1, CAST(n AS BIGINT) AS n_events,
      mid IS NOT NULL AND CASE WHEN n > 0 THEN lo = hi ELSE ph = nl END AS valid FROM k WINDOW w AS (PARTITION BY symbol ORDER BY bar_start_ns))"""


@query(f"WITH {P_SQL}, {BARS_SQL} SELECT * FROM bars")
def ofi_time_bars(spark: SparkSession, d: str) -> DataFrame:
    return flow.time_bars(V.l1(spark, d), KEYS, HOUR)


@query(f"WITH {P_SQL}, {BARS_SQL} SELECT symbol, bar_start_ns, mid FROM bars")
def bar_last_mid(spark: SparkSession, d: str) -> DataFrame:
    return flow.time_bars(V.l1(spark, d), KEYS, HOUR).select("symbol", "bar_start_ns", "mid")


@query(f"WITH {P_SQL}, {BARS_SQL} SELECT symbol, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE NOT valid) AS n_invalid FROM bars GROUP BY symbol")
def bar_validity(spark: SparkSession, d: str) -> DataFrame:
    bars = flow.time_bars(V.l1(spark, d), KEYS, HOUR)
    return bars.groupBy("symbol").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))


@query(f"WITH {P_SQL} SELECT symbol, seq, sum(e) OVER (PARTITION BY symbol ORDER BY ts_event_ns RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW) AS rolling FROM e")
def ofi_rolling(spark: SparkSession, d: str) -> DataFrame:
    return flow.rolling(flow.events(V.l1(spark, d), KEYS), KEYS, HOUR).select("symbol", "seq", "rolling")


@query(f"WITH {MP_SQL} SELECT symbol, seq, max(e) FILTER (i = 0) AS e1, max(e) FILTER (i = 1) AS e2, max(e) FILTER (i = 2) AS e3 FROM f WHERE pe = epoch GROUP BY 1, 2")
def mlofi_events(spark: SparkSession, d: str) -> DataFrame:
    rows = flow.events(V.lm(spark, d), KEYS, V.LEVELS)
    return rows.select("symbol", "seq", *(F.get("e", F.lit(i)).alias(f"e{i + 1}") for i in range(V.LEVELS)))


@query(f"""WITH {MP_SQL} SELECT symbol, seq, round(max(e) FILTER (i = 0) + max(e) FILTER (i = 1) / 2 + max(e) FILTER (i = 2) / 3, 6) AS weighted FROM f WHERE pe = epoch GROUP BY 1, 2""")
def mlofi_weighted(spark: SparkSession, d: str) -> DataFrame:
    rows = flow.events(V.lm(spark, d), KEYS, V.LEVELS)
    return rows.select("symbol", "seq", F.round(flow.weighted("e", flow.level_weights(V.LEVELS, "inverse")), 6).alias("weighted"))


@query(f"""WITH {MP_SQL}, a AS (SELECT symbol, {BAR} AS bar_start_ns, sum(CASE WHEN i = 0 AND pe = epoch THEN e END) AS o1, sum(CASE WHEN i = 1 AND pe = epoch THEN e END) AS o2,
      sum(CASE WHEN i = 2 AND pe = epoch THEN e END) AS o3, count(*) FILTER (i = 0 AND pe IS NOT NULL) AS n FROM f GROUP BY 1, 2),
    r AS (SELECT symbol, min(bar_start_ns) AS lo, max(bar_start_ns) AS hi FROM a WHERE n > 0 GROUP BY 1), g AS (SELECT symbol, unnest(range(lo, hi + 1, {HOUR})) AS bar_start_ns FROM r)
    SELECT g.symbol, g.bar_start_ns, coalesce(o1, 0) AS ofi_1, coalesce(o2, 0) AS ofi_2, coalesce(o3, 0) AS ofi_3, CAST(coalesce(n, 0) AS BIGINT) AS n_events
    FROM g LEFT JOIN a ON g.symbol = a.symbol AND g.bar_start_ns = a.bar_start_ns""")
def mlofi_time_bars(spark: SparkSession, d: str) -> DataFrame:
    bars = flow.time_bars(V.lm(spark, d), KEYS, HOUR, levels=V.LEVELS)
    return bars.select("symbol", "bar_start_ns", "ofi_1", "ofi_2", "ofi_3", "n_events")


BUCKETS_SQL = f"""{TRADES_SQL}, v AS (SELECT *, sum(qty) OVER (PARTITION BY symbol ORDER BY ts_event_ns, trade_id) AS c1 FROM t),
    x AS (SELECT *, c1 - qty AS c0, CAST(floor((c1 - qty) / {BUCKET}) AS BIGINT) AS b0, CAST(ceil(c1 / {BUCKET}) AS BIGINT) - 1 AS b1 FROM v),
    y AS (SELECT *, unnest(range(b0, b1 + 1)) AS bucket FROM x), z AS (SELECT symbol, CAST(floor(sum(qty) / {BUCKET}) AS BIGINT) AS n FROM t GROUP BY 1),
    b AS (SELECT y.symbol, bucket, sum(CASE WHEN aggressor_sign > 0 THEN least(c1, (bucket + 1) * {BUCKET}) - greatest(c0, bucket * {BUCKET}) ELSE 0 END) AS buy, arg_max(price, trade_id) AS close
      FROM y JOIN z ON y.symbol = z.symbol AND bucket < n GROUP BY 1, 2)"""
VPIN_SQL = f"""WITH {BUCKETS_SQL}, w AS (SELECT symbol, bucket, sum(abs({BUCKET} - 2 * buy)) OVER (PARTITION BY symbol ORDER BY bucket ROWS {WINDOW - 1} PRECEDING) AS s FROM b)
    SELECT symbol, bucket, round(least(1, greatest(0, s / ({WINDOW} * {BUCKET}))), 9) AS vpin FROM w WHERE bucket >= {WINDOW - 1}"""


@query(f"WITH {BUCKETS_SQL} SELECT symbol, bucket, buy, {BUCKET} - buy AS sell, close FROM b")
def vpin_buckets(spark: SparkSession, d: str) -> DataFrame:
    return volume.volume_buckets(V.trades(spark, d), KEYS, BUCKET)


@query(VPIN_SQL)
def vpin_rolling(spark: SparkSession, d: str) -> DataFrame:
    return volume.vpin(V.trades(spark, d), KEYS, BUCKET, WINDOW).withColumn("vpin", F.round("vpin", 9))


@query(f"""WITH {BUCKETS_SQL}, f AS (SELECT symbol, arg_min(price, trade_id) AS p FROM t GROUP BY 1),
    c AS (SELECT b.symbol, bucket, close - coalesce(lag(close) OVER (PARTITION BY b.symbol ORDER BY bucket), p) AS ch FROM b JOIN f ON b.symbol = f.symbol),
    s AS (SELECT symbol, stddev_samp(ch) AS sd FROM c GROUP BY 1), q AS (SELECT c.symbol, bucket, ch, abs(ch / sd) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(ch / sd) / sqrt(2)) AS u FROM c JOIN s ON c.symbol = s.symbol),
    h AS (SELECT *, 0.5 * u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429)))) * exp(-x * x) AS tail FROM q)
    SELECT symbol, bucket, round({BUCKET} * CASE WHEN ch >= 0 THEN 1 - tail ELSE tail END, 6) AS buy FROM h""")
def vpin_bvc(spark: SparkSession, d: str) -> DataFrame:
    t = V.trades(spark, d)
    rows = volume.bulk_classified(volume.volume_buckets(t, KEYS, BUCKET), volume.first_prices(t, KEYS), KEYS, BUCKET)
    return rows.select("symbol", "bucket", F.round("buy", 6).alias("buy"))


AT_SQL = """WITH {views}, h AS (SELECT symbol, arg_max(k, k) AS k0 FROM s WHERE {snap} GROUP BY 1),
    x AS (SELECT s.symbol, 0 AS o, sl.side, sl.price, sl.qty FROM h JOIN s ON s.symbol = h.symbol AND s.k = h.k0 JOIN sl ON sl.k = s.k
      UNION ALL SELECT d.symbol, d.k AS o, c.side, c.price, c.qty FROM h JOIN d ON d.symbol = h.symbol AND {delta} JOIN c ON c.k = d.k)
    SELECT symbol, side, price, arg_max(qty, o) AS qty FROM x GROUP BY 1, 2, 3 HAVING arg_max(qty, o) > 0"""


@query(AT_SQL.format(views=f"{DELTAS_SQL}, {SNAPSHOTS_SQL}", snap=f"ts_event_ns <= {AT_NS}", delta=f"d.ts_event_ns > h.k0 * 100000000 + 5000000 AND d.ts_event_ns <= {AT_NS}"))
def book_at_ts(spark: SparkSession, d: str) -> DataFrame:
    return chain.book_at_time(V.snapshots(spark, d), V.deltas(spark, d), KEYS, AT_NS)[0]


@query(AT_SQL.format(views=f"{DELTAS_SQL}, {SNAPSHOTS_SQL}", snap=f"last_update_id <= {AT_ID}",
       delta=f"d.k > h.k0 AND d.final_update_id <= (SELECT min(y.final_update_id) FROM d y WHERE y.symbol = d.symbol AND y.final_update_id >= {AT_ID})"))
def book_at_id(spark: SparkSession, d: str) -> DataFrame:
    return chain.book_at_id(V.snapshots(spark, d), V.deltas(spark, d), KEYS, AT_ID)[0]


#: Two hundred times and ids a symbol, spread over the tape.
ASKED_SQL = "ask AS (SELECT DISTINCT 'B' || CAST(o_orderkey % 4 AS VARCHAR) AS symbol, i AS query, o.most * i * 500000 + 12345 AS ts, o.most * i // 20 - 3 AS rest_id FROM orders, (SELECT max(o_orderkey) AS most FROM orders) o, (SELECT unnest(range(1, 201)) AS i))"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    orders = V.table(spark, d, "orders")
    most = orders.agg(F.max("o_orderkey")).first()[0] or 0
    rows = orders.select(F.concat(F.lit("B"), (F.col("o_orderkey") % 4).cast("string")).alias("symbol")).distinct()
    i = F.col("query")
    return rows.select("symbol", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(200).cast("long"))).alias("query")).withColumns({"ts_event_ns": i * (most * 500_000) + 12_345, "rest_id": F.floor(i * most / 20).cast("long") - 3})


MANY_SQL = """WITH {views}, {asked}, h AS (SELECT ask.symbol, query, ts, rest_id, max(s.k) AS k0 FROM ask JOIN s ON s.symbol = ask.symbol AND {snap} GROUP BY ALL),
    z AS (SELECT h.*, {stop} AS stop FROM h),
    dd AS (SELECT z.symbol, query, d.k, prev_final_update_id AS pu, first_update_id AS fu, coalesce(lag(d.final_update_id) OVER w, k0 * 10 + 9) AS pr, row_number() OVER w AS n, k0 * 10 + 9 AS su, d.final_update_id AS uu
      FROM z JOIN d ON d.symbol = z.symbol AND {delta} WINDOW w AS (PARTITION BY z.symbol, query ORDER BY d.k)),
    g AS (SELECT symbol, query, count(*) AS n, count(*) FILTER (WHERE pu <> pr AND NOT (n = 1 AND fu <= su AND su <= uu)) AS n_gaps FROM dd GROUP BY 1, 2),
    x AS (SELECT z.symbol, query, -1 AS o, sl.side, sl.price, sl.qty FROM z JOIN sl ON sl.k = k0 UNION ALL SELECT dd.symbol, query, dd.k, c.side, c.price, c.qty FROM dd JOIN c ON c.k = dd.k),
    l AS (SELECT symbol, query, side, price, arg_max(qty, o) AS qty FROM x GROUP BY 1, 2, 3, 4 HAVING arg_max(qty, o) > 0)
    SELECT l.symbol, l.query, k0 * 10 + 9 AS snapshot_id, coalesce(n_gaps, 0) AS n_gaps, {more}l.side, price, qty FROM l JOIN z ON z.symbol = l.symbol AND z.query = l.query LEFT JOIN g ON g.symbol = l.symbol AND g.query = l.query"""


@query(MANY_SQL.format(views=f"{DELTAS_SQL}, {SNAPSHOTS_SQL}", asked=ASKED_SQL, snap="s.ts_event_ns <= ts", stop="0", delta="d.ts_event_ns > k0 * 100000000 + 5000000 AND d.ts_event_ns <= ts", more=""))
def book_at_many_times(spark: SparkSession, d: str) -> DataFrame:
    levels, status = lookup.books_at_times(V.snapshots(spark, d), V.deltas(spark, d), KEYS, _asked(spark, d))
    return status.join(levels, ["symbol", "query"])


@query(MANY_SQL.format(views=f"{DELTAS_SQL}, {SNAPSHOTS_SQL}", asked=ASKED_SQL, snap="s.last_update_id <= rest_id", stop="(SELECT min(y.final_update_id) FROM d y WHERE y.symbol = h.symbol AND y.final_update_id >= h.rest_id)",
                       delta="d.k > k0 AND d.final_update_id <= stop AND k0 * 10 + 9 <> rest_id", more="CASE WHEN k0 * 10 + 9 = rest_id THEN rest_id ELSE stop END AS aligned_u, coalesce(n, 0) AS n_batches, "))
def book_at_many_ids(spark: SparkSession, d: str) -> DataFrame:
    levels, status = lookup.books_at_ids(V.snapshots(spark, d), V.deltas(spark, d), KEYS, _asked(spark, d))
    return status.join(levels, ["symbol", "query"])


BBO_SQL = f"""{CHANGES_SQL}, iv AS (SELECT k % 4 AS s, k // 500 AS g, side, price, qty, k AS a, coalesce(lead(k) OVER (PARTITION BY k % 4, k // 500, side, price ORDER BY k), 1152921504606846976) AS z FROM c),
    pt AS (SELECT o_orderkey AS k, o_orderkey % 4 AS s, o_orderkey // 500 AS g FROM orders),
    bb AS (SELECT pt.k AS seq, 'B' || CAST(pt.s AS VARCHAR) AS symbol, max(CASE WHEN side = 'bid' THEN price END) AS bid_px, arg_max(qty, price) FILTER (side = 'bid') AS bid_qty,
      min(CASE WHEN side = 'ask' THEN price END) AS ask_px, arg_min(qty, price) FILTER (side = 'ask') AS ask_qty FROM pt JOIN iv ON pt.s = iv.s AND pt.g = iv.g AND a <= k AND k < z WHERE qty > 0 GROUP BY 1, 2)"""


def _tops(spark: SparkSession, d: str) -> DataFrame:
    """The top of a book that starts empty every 500 orders, after every order."""
    rows = V.level_changes(spark, d).select(F.concat(F.lit("B"), (F.col("k") % 4).cast("string")).alias("symbol"), F.expr("k div 500").alias("group"), F.col("k").alias("seq"), F.lit(0).alias("pos"), "side", "price", "qty")
    at = V.table(spark, d, "orders").select(F.concat(F.lit("B"), (F.col("o_orderkey") % 4).cast("string")).alias("symbol"), F.expr("o_orderkey div 500").alias("group"), F.col("o_orderkey").alias("seq"))
    return book.best_at(rows, at, KEYS)


@query(f"WITH {BBO_SQL} SELECT * FROM bb")
def book_bbo_series(spark: SparkSession, d: str) -> DataFrame:
    return _tops(spark, d).drop("group")


@query(f"""WITH {BBO_SQL} SELECT symbol, seq, round((ask_px * bid_qty + bid_px * ask_qty) / (bid_qty + ask_qty), 9) AS microprice, round((bid_qty - ask_qty) / (bid_qty + ask_qty), 9) AS imbalance,
    (bid_px + ask_px) / 2 AS mid, ask_px - bid_px AS spread FROM bb WHERE bid_px IS NOT NULL AND ask_px IS NOT NULL""")
def microprice_imbalance(spark: SparkSession, d: str) -> DataFrame:
    rows = _tops(spark, d).where(book.valid_top())
    side = lambda p, q: F.array(F.struct(F.col(p).alias("price"), F.col(q).alias("qty")))
    return rows.select(
        "symbol", "seq", F.round(S.microprice("bid_px", "bid_qty", "ask_px", "ask_qty"), 9).alias("microprice"), F.round(S.imbalance(side("bid_px", "bid_qty"), side("ask_px", "ask_qty"), 1), 9).alias("imbalance"),
        S.mid("bid_px", "ask_px").alias("mid"), S.spread("bid_px", "ask_px").alias("spread"))


@query(f"""WITH {CHANGES_SQL}, y AS (SELECT 'B' || CAST(k % 4 AS VARCHAR) AS symbol, side, price, arg_max(qty, k) AS qty FROM c GROUP BY 1, 2, 3 HAVING arg_max(qty, k) > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS level FROM y) SELECT symbol, side, level, price, qty FROM r WHERE level <= 5""")
def book_depth_topn(spark: SparkSession, d: str) -> DataFrame:
    rows = V.level_changes(spark, d).select(F.concat(F.lit("B"), (F.col("k") % 4).cast("string")).alias("symbol"), F.col("k").alias("seq"), F.lit(0).alias("pos"), "side", "price", "qty")
    top = book.depth(book.live_levels(rows, KEYS), KEYS, 5)
    sides = [top.select("symbol", F.lit(s).alias("side"), F.posexplode(c).alias("i", "x")) for s, c in (("bid", "bids"), ("ask", "asks"))]
    return sides[0].unionByName(sides[1]).select("symbol", "side", (F.col("i") + 1).cast("long").alias("level"), "x.price", "x.qty")


@query(f"WITH {SNAPSHOTS_SQL} SELECT symbol, last_update_id FROM sl GROUP BY 1, 2 HAVING max(price) FILTER (side = 'bid') >= min(price) FILTER (side = 'ask')")
def crossed(spark: SparkSession, d: str) -> DataFrame:
    return V.snapshots(spark, d).where(quality.crossed_snapshots()).select("symbol", "last_update_id")


@query(f"""WITH {SNAPSHOTS_SQL}, {CHANGES_SQL}, a AS (SELECT symbol, price FROM sl UNION ALL SELECT 'B' || CAST(k % 4 AS VARCHAR), price FROM c) SELECT symbol, count(*) AS n,
    count(*) FILTER (WHERE abs(price - round_even(price, 0)) > 0.000001) AS n_off FROM a GROUP BY symbol""")
def off_grid(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "symbol string, price double")
    rows = quality.all_prices(V.snapshots(spark, d), V.deltas(spark, d), none, KEYS)
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(quality.off_grid("price", TICK)).alias("n_off"))


@query(f"""WITH {TRADES_SQL}, n AS (SELECT symbol, trade_id, ts_event_ns, ts_recv_ns, row_number() OVER (PARTITION BY symbol ORDER BY trade_id) AS r FROM t)
    SELECT symbol, trade_id, min(ts_event_ns - r) OVER w + r AS ts_event_ns, min(ts_recv_ns - r) OVER w + r AS ts_recv_ns FROM n
    WINDOW w AS (PARTITION BY symbol ORDER BY trade_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def restamp(spark: SparkSession, d: str) -> DataFrame:
    return chain.restamp(V.trades(spark, d), KEYS, "trade_id").select("symbol", "trade_id", "ts_event_ns", "ts_recv_ns")


AUDIT_SQL = f"""{DELTAS_SQL}, {SNAPSHOTS_SQL}, jn AS (SELECT *, lag(final_update_id) OVER (PARTITION BY symbol ORDER BY final_update_id) AS lu FROM d),
    jj AS (SELECT jn.*, EXISTS (SELECT 1 FROM s WHERE s.symbol = jn.symbol AND (s.last_update_id BETWEEN jn.first_update_id AND jn.final_update_id OR s.last_update_id = jn.prev_final_update_id)) AS ok FROM jn WHERE lu IS NULL OR lu <> prev_final_update_id),
    au AS (SELECT symbol, count(*) FILTER (WHERE ok) AS epochs, count(*) FILTER (WHERE NOT ok) AS breaks FROM jj GROUP BY symbol)"""


@query(f"WITH {AUDIT_SQL} SELECT * FROM au")
def chain_audit(spark: SparkSession, d: str) -> DataFrame:
    return chain.audit(V.deltas(spark, d), V.snapshots(spark, d), KEYS)


@query(f"""WITH {TRADES_SQL}, g AS (SELECT symbol, lag(ts_event_ns) OVER w AS e0, ts_event_ns AS e1, lag(ts_recv_ns) OVER w AS r0, ts_recv_ns AS r1 FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts_event_ns, trade_id)),
    u AS (SELECT symbol, 'event' AS clock, e0 AS start_ns, e1 AS end_ns FROM g UNION ALL SELECT symbol, 'recv', r0, r1 FROM g) SELECT *, end_ns - start_ns AS gap_ns FROM u WHERE end_ns - start_ns > {2 * HOUR}""")
def gaps(spark: SparkSession, d: str) -> DataFrame:
    return quality.gaps(V.trades(spark, d), KEYS, 2 * HOUR, "trade_id")


@query(f"""WITH {DELTAS_SQL}, {SNAPSHOTS_SQL}, u AS (SELECT symbol, 'd' AS kind, ts_event_ns FROM d UNION ALL SELECT symbol, 's', ts_event_ns FROM s),
    a AS (SELECT symbol, count(*) FILTER (kind = 's') AS n_snapshots, count(*) FILTER (kind = 'd') AS n_deltas, min(ts_event_ns) AS first_ns, max(ts_event_ns) AS last_ns FROM u GROUP BY 1)
    SELECT *, (last_ns - first_ns) / 1000000000 AS duration_s, round(n_snapshots / ((last_ns - first_ns) / 1000000000), 9) AS snapshots_per_s, round(n_deltas / ((last_ns - first_ns) / 1000000000), 9) AS deltas_per_s FROM a""")
def capture_stats(spark: SparkSession, d: str) -> DataFrame:
    out = quality.capture_stats({"snapshots": V.snapshots(spark, d), "deltas": V.deltas(spark, d)}, KEYS)
    return out.withColumns({c: F.round(c, 9) for c in ("snapshots_per_s", "deltas_per_s")})


@query(f"WITH {DELTAS_SQL} SELECT symbol, ts_event_ns // 1000000000 AS second, count(*) AS updates FROM d GROUP BY 1, 2")
def updates_hist(spark: SparkSession, d: str) -> DataFrame:
    return quality.updates_per_second(V.deltas(spark, d), KEYS)


@query(f"""WITH {DELTAS_SQL}, h AS (SELECT symbol, ts_event_ns // 1000000000 AS second, count(*) AS updates FROM d GROUP BY 1, 2)
    SELECT symbol, min(updates) AS least, quantile_cont(updates, 0.5) AS median, max(updates) AS most, round(avg(updates), 9) AS mean FROM h GROUP BY 1""")
def updates_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.histogram_summary(quality.updates_per_second(V.deltas(spark, d), KEYS), KEYS).withColumn("mean", F.round("mean", 9))


LAT_SQL = """{head} SELECT symbol, count(v) AS n, min(v) AS least, round(quantile_cont(v, 0.5), 3) AS p50, round(quantile_cont(v, 0.9), 3) AS p90, round(quantile_cont(v, 0.99), 3) AS p99,
    round(quantile_cont(v, 0.999), 3) AS p99_9, max(v) AS most, round(avg(v), 3) AS mean FROM x GROUP BY symbol"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 3) for c in ("p50", "p90", "p99", "p99_9", "mean")})


@query(LAT_SQL.format(head=f"WITH {TRADES_SQL}, x AS (SELECT symbol, ts_recv_ns - ts_event_ns - 48000002 AS v FROM t)"))
def latency_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Latencies adjusted by the mean of four clock samples."""
    samples = spark.createDataFrame([(0, -47_999_998), (0, -48_000_001), (0, -48_000_000), (4, -47_999_999)], "before long, server long")
    clock = samples.select(S.clock_offset_ns("before", "server", F.col("before") + 2).alias("offset_ns"))
    return _rounded(quality.distribution(quality.latencies(V.trades(spark, d), clock), KEYS, "adjusted_ns"))


@query(f"""WITH {TRADES_SQL}, x AS (SELECT symbol, ts_recv_ns - ts_event_ns AS v, (ts_recv_ns - ts_event_ns) // 1000000 AS ms FROM t), h AS (SELECT symbol, ms, count(*) AS n FROM x GROUP BY 1, 2),
    c AS (SELECT symbol, ms, sum(n) OVER (PARTITION BY symbol ORDER BY ms) AS cum, sum(n) OVER (PARTITION BY symbol) AS total FROM h),
    p AS (SELECT symbol, min(ms) FILTER (cum > 0.5 * (total - 1)) AS a, min(ms) FILTER (cum > 0.99 * (total - 1)) AS b FROM c GROUP BY 1), y AS (SELECT symbol, count(*) AS n, min(v) AS least, max(v) AS most, round(avg(v), 3) AS mean FROM x GROUP BY 1)
    SELECT y.symbol, n, least, most, mean, least(most, greatest(least, a * 1000000 + 500000)) AS p50, least(most, greatest(least, b * 1000000 + 500000)) AS p99 FROM y JOIN p ON y.symbol = p.symbol""")
def latency_hist_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = V.trades(spark, d).withColumn("v", S.observed_latency_ns("ts_event_ns", "ts_recv_ns"))
    return quality.bucketed_percentiles(rows, KEYS, "v", {"p50": 50.0, "p99": 99.0}).withColumn("mean", F.round("mean", 3))


@query(LAT_SQL.format(head=f"WITH {TRADES_SQL}, x AS (SELECT symbol, (ts_event_ns - lag(ts_event_ns) OVER (PARTITION BY symbol ORDER BY ts_event_ns, trade_id)) / 1000000000 AS v FROM t)"))
def inter_arrival(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.inter_arrival(V.trades(spark, d), KEYS, "ts_event_ns", "trade_id").withColumn("gap_s", F.col("gap_ns") / S.NS_PER_S)
    return _rounded(quality.distribution(rows, KEYS, "gap_s"))


@query(f"""WITH {SNAPSHOTS_SQL}, {CHANGES_SQL}, lo AS (SELECT 'B' || CAST(k % 4 AS VARCHAR) AS symbol, side, price, arg_max(qty, k) AS qty FROM c GROUP BY 1, 2, 3 HAVING arg_max(qty, k) > 0),
    lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS r FROM lo) WHERE r <= 20),
    re AS (SELECT sl.symbol, side, price, qty FROM sl WHERE k = (SELECT max(k) FROM s y WHERE y.symbol = sl.symbol)),
    rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS r FROM re) WHERE r <= 20),
    j AS (SELECT rr.symbol, abs(rr.qty - coalesce(lr.qty, 0)) AS df, lr.qty IS NULL OR abs(rr.qty - coalesce(lr.qty, 0)) > 0.000000001 AS bad FROM rr LEFT JOIN lr ON rr.symbol = lr.symbol AND rr.side = lr.side AND rr.price = lr.price)
    SELECT symbol, count(*) AS compared, count(*) FILTER (WHERE bad) AS mismatches, coalesce(max(df) FILTER (WHERE bad), 0) AS most FROM j GROUP BY symbol""")
def probe_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = V.level_changes(spark, d).select(F.concat(F.lit("B"), (F.col("k") % 4).cast("string")).alias("symbol"), F.col("k").alias("seq"), F.lit(0).alias("pos"), "side", "price", "qty")
    last = V.snapshots(spark, d).groupBy("symbol").agg(F.max_by(F.struct("bids", "asks"), "last_update_id").alias("s")).select("symbol", "s.*")
    return quality.compare_top(book.live_levels(rows, KEYS), book.changes(last, KEYS).drop("pos"), KEYS, 20).drop("details")


@query(f"""WITH {AUDIT_SQL}, tr AS (SELECT 'B' || CAST(o_custkey % 4 AS VARCHAR) AS symbol, o_custkey AS trade_id, o_totalprice AS p, o_orderkey % 50 AS q FROM orders),
    ts AS (SELECT symbol, count(*) AS n_trades, count(*) - count(DISTINCT trade_id) AS n_duplicate_ids, count(*) FILTER (WHERE q <= 0) AS n_zero_qty FROM tr GROUP BY 1),
    sc AS (SELECT symbol, count(DISTINCT k) AS n_snapshots FROM s GROUP BY 1), xc AS (SELECT symbol, count(*) AS n FROM (SELECT symbol, k FROM sl GROUP BY 1, 2 HAVING max(price) FILTER (side = 'bid') >= min(price) FILTER (side = 'ask')) GROUP BY 1),
    dc AS (SELECT symbol, count(*) AS n_deltas FROM d GROUP BY 1)
    SELECT sc.symbol, n_snapshots, coalesce(xc.n, 0) AS n_crossed, n_deltas, n_trades, n_duplicate_ids, n_zero_qty, epochs AS n_epochs, breaks AS n_breaks,
      breaks = 0 AND coalesce(xc.n, 0) = 0 AND n_duplicate_ids = 0 AS ok FROM sc LEFT JOIN xc ON sc.symbol = xc.symbol JOIN dc ON sc.symbol = dc.symbol JOIN ts ON sc.symbol = ts.symbol JOIN au ON sc.symbol = au.symbol""")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    t = V.table(spark, d, "orders").select(F.concat(F.lit("B"), (F.col("o_custkey") % 4).cast("string")).alias("symbol"), F.col("o_custkey").alias("trade_id"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 50).cast("double").alias("qty"))
    out = quality.summary(V.snapshots(spark, d), V.deltas(spark, d), t, KEYS)
    return out.select("symbol", "n_snapshots", "n_crossed", "n_deltas", "n_trades", "n_duplicate_ids", "n_zero_qty", "n_epochs", "n_breaks", "ok")


@query(f"""WITH {DELTAS_SQL}, o AS (SELECT d.symbol, d.final_update_id AS sequence, c.side, c.price, c.qty AS size, CAST(greatest(1, round_even(c.price, 0)) AS BIGINT) AS order_id,
      row_number() OVER (PARTITION BY d.k ORDER BY CASE WHEN c.side = 'bid' THEN 0 ELSE 1 END, c.price) AS r, count(*) OVER (PARTITION BY d.k) AS n FROM d JOIN c ON c.k = d.k)
    SELECT symbol, sequence, CAST(r - 1 AS INTEGER) AS pos, CASE WHEN size = 0 THEN 'delete' ELSE 'update' END AS action, CASE WHEN r = n THEN 128 ELSE 0 END AS flags, side, price, size, order_id FROM o""")
def ops_from_deltas(spark: SparkSession, d: str) -> DataFrame:
    return convert.delta_ops(V.deltas(spark, d), KEYS, TICK).drop("ts_event_ns", "ts_init_ns")


@query(f"""WITH {SNAPSHOTS_SQL}, o AS (SELECT symbol, last_update_id AS sequence, 'clear' AS action, -1 AS i, CAST(NULL AS VARCHAR) AS side, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS size FROM s
      UNION ALL SELECT symbol, last_update_id, 'add', CASE WHEN side = 'bid' THEN i ELSE 40 + i END, side, price, qty FROM sl)
    SELECT symbol, sequence, i + 1 AS pos, action, CASE WHEN i = -1 THEN 32 WHEN i = 79 THEN 128 ELSE 0 END AS flags, side, price, size FROM o""")
def ops_from_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return convert.snapshot_ops(V.snapshots(spark, d), KEYS, TICK).drop("ts_event_ns", "ts_init_ns", "order_id")


@query(f"""WITH {TRADES_SQL} SELECT symbol, trade_id AS order_id, 2 + (1 << 31) + (1 << 30) + CASE WHEN aggressor_sign > 0 THEN 1 << 29 ELSE 1 << 28 END AS ev, ts_event_ns AS exch_ts,
    greatest(ts_recv_ns, ts_event_ns + 1) AS local_ts, price AS px, qty, CAST(0 AS BIGINT) AS ival, 0.0::DOUBLE AS fval FROM t WHERE qty > 0""".replace("1 << 31", "2147483648"))
def feed_trades(spark: SparkSession, d: str) -> DataFrame:
    return convert.trade_rows(V.trades(spark, d), KEYS).drop("line")


@query(f"""WITH {L1_SQL}, q AS (SELECT symbol, seq, CAST(round_even((bid_px + ask_px) / 2, 0) AS BIGINT) + CASE WHEN bid_qty - ask_qty > 3 THEN 1 WHEN bid_qty - ask_qty < -3 THEN -1 ELSE 0 END AS c, bid_px, ask_px FROM l),
    r AS (SELECT symbol, seq, least(c - 1, CAST(ask_px AS BIGINT) - 1) AS bid_ticks, greatest(c + 1, CAST(bid_px AS BIGINT) + 1) AS ask_ticks FROM q) SELECT * FROM r WHERE bid_ticks < ask_ticks""")
def maker_quotes(spark: SparkSession, d: str) -> DataFrame:
    rows = V.l1(spark, d)
    q = convert.maker_quotes(S.mid("bid_px", "ask_px"), F.col("bid_qty") - F.col("ask_qty"), "bid_px", "ask_px", TICK, 1, 3.0)
    return rows.withColumn("q", q).where("q is not null").select("symbol", "seq", "q.*")


@query(f"""WITH {L1_SQL}, q AS (SELECT symbol, seq, CAST(round_even((bid_px + ask_px) / 2, 0) AS BIGINT) + CASE WHEN bid_qty - ask_qty > 3 THEN 1 WHEN bid_qty - ask_qty < -3 THEN -1 ELSE 0 END AS c, bid_px, ask_px FROM l),
    r AS (SELECT symbol, seq, least(c - 1, CAST(ask_px AS BIGINT) - 1) AS b, greatest(c + 1, CAST(bid_px AS BIGINT) + 1) AS a FROM q),
    u AS (SELECT symbol, seq, 'bid' AS side, 1 AS rank, CASE WHEN b < a AND seq % 31 <> 0 THEN b END AS ticks FROM r UNION ALL SELECT symbol, seq, 'ask', 1, CASE WHEN b < a AND seq % 31 <> 0 THEN a END FROM r
      UNION ALL SELECT symbol, seq, 'bid', 0, NULL FROM r WHERE seq % 5 = 3 UNION ALL SELECT symbol, seq, 'ask', 0, NULL FROM r WHERE seq % 7 = 5),
    w AS (SELECT *, lag(ticks) OVER (PARTITION BY symbol, side ORDER BY seq, rank) AS open FROM u),
    x AS (SELECT *, ticks IS NOT NULL AND ticks IS DISTINCT FROM open AS starts, open IS NOT NULL AND ticks IS DISTINCT FROM open AS ends FROM w),
    y AS (SELECT *, CAST(sum(CAST(starts AS INT)) OVER (PARTITION BY symbol, side ORDER BY seq, rank) AS BIGINT) AS n FROM x)
    SELECT symbol, seq, side, 'submit' AS action, ticks, n AS order_id FROM y WHERE starts
    UNION ALL SELECT symbol, seq, side, CASE WHEN rank = 0 THEN 'fill' ELSE 'cancel' END, open, n - CAST(starts AS INT) FROM y WHERE ends""")
def maker_order_life(spark: SparkSession, d: str) -> DataFrame:
    """Submits, cancels and fills of the quoting rule; every 31st target is void, some orders are filled."""
    rows = V.l1(spark, d)
    q = convert.maker_quotes(S.mid("bid_px", "ask_px"), F.col("bid_qty") - F.col("ask_qty"), "bid_px", "ask_px", TICK, 1, 3.0)
    targets = rows.withColumn("q", F.when(F.col("seq") % 31 != 0, q)).select("symbol", "seq", "q.bid_ticks", "q.ask_ticks")
    filled = F.array_compact(F.array(F.when(F.col("seq") % 5 == 3, F.lit("bid")), F.when(F.col("seq") % 7 == 5, F.lit("ask"))))
    return convert.order_life(targets, rows.select("symbol", "seq", F.explode(filled).alias("side")), KEYS)


@query(f"""WITH {P_SQL}, {BARS_SQL}, xy AS (SELECT symbol, bar_start_ns AS t, ofi AS x, delta_mid AS y FROM (SELECT *, lag(valid) OVER (PARTITION BY symbol ORDER BY bar_start_ns) AS before FROM bars) WHERE valid AND before AND ofi IS NOT NULL AND delta_mid IS NOT NULL),
    ff AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM xy GROUP BY 1),
    gg AS (SELECT xy.symbol, t, (y - a - b * x) * (x - mx) AS g, row_number() OVER (PARTITION BY xy.symbol ORDER BY t) AS i FROM xy JOIN ff f ON xy.symbol = f.symbol),
    vv AS (SELECT p.symbol, sum(CASE WHEN k = 0 THEN p.g * q.g WHEN k <= greatest(1, floor(4 * (n / 100.0) ^ (2.0 / 9))) THEN 2 * (1 - k / (greatest(1, floor(4 * (n / 100.0) ^ (2.0 / 9))) + 1)) * p.g * q.g ELSE 0 END) AS s
      FROM gg p JOIN ff f ON p.symbol = f.symbol, (SELECT unnest(range(0, 25)) AS k), gg q WHERE q.symbol = p.symbol AND q.i = p.i - k GROUP BY 1)
    SELECT f.symbol, n, round(a, 6) AS alpha, round(b, 6) AS beta, round(r2, 6) AS r2, round(sqrt(s) / sxx, 6) AS se_beta, round(b / (sqrt(s) / sxx), 4) AS t_beta FROM ff f JOIN vv v ON f.symbol = v.symbol""")
def ols_hac(spark: SparkSession, d: str) -> DataFrame:
    rows = validate.paired(flow.time_bars(V.l1(spark, d), KEYS, HOUR), KEYS, ["ofi"]).where("spec = 'contemporaneous'")
    out = regress.ols(rows, KEYS, x="ofi")
    return out.withColumns({c: F.round(c, 6) for c in ("alpha", "beta", "r2", "se_beta")} | {"t_beta": F.round("t_beta", 4)})


@query(f"""WITH {DELTAS_SQL} SELECT d.symbol, k * 100000000 AS ts_event_ns, first_update_id, final_update_id, prev_final_update_id, (SELECT count(*) FROM c WHERE c.k = d.k) AS n_levels,
    coalesce((SELECT sum(price * qty) FROM c WHERE c.k = d.k), 0) AS notional FROM d WHERE NOT (k % 3 <> 0 AND k % 101 = 1)""")
def parse_depth_json(spark: SparkSession, d: str) -> DataFrame:
    rows = wire.depth_updates(V.depth_frames(spark, d), "x")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["price"] * x["qty"])
    return rows.select("symbol", "ts_event_ns", "first_update_id", "final_update_id", "prev_final_update_id", (F.size("bids") + F.size("asks")).cast("long").alias("n_levels"), (total("bids") + total("asks")).alias("notional"))


@query(f"WITH {TRADES_SQL} SELECT symbol, ts_event_ns // 1000000 * 1000000 AS ts_event_ns, trade_id, price, qty, CAST(aggressor_sign AS TINYINT) AS aggressor_sign FROM t WHERE trade_id % 97 <> 5")
def parse_trade_json(spark: SparkSession, d: str) -> DataFrame:
    return wire.prints(V.trade_frames(spark, d), "x").drop("exchange", "ts_recv_ns")


SLICES = 5


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a file stream of SLICES micro-batches, in order of event_id."""
    events = V.table(spark, d, "events")
    path = tape.work_path(spark, "stream-events")
    lo, hi = events.agg(F.min("event_id"), F.max("event_id")).first()
    part = F.least(F.lit(SLICES - 1), ((F.col("event_id") - F.lit(lo)) * SLICES / F.lit(max(1, (hi or 0) - (lo or 0)))).cast("int"))
    for k in range(SLICES):
        events.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drained(spark: SparkSession, rows: DataFrame, processor) -> DataFrame:
    return processors.drained(processors.stateful(rows, processor), tape.work_path(spark, "stream"), tape.work_path(spark, "stream-state"))


@query(CVD_SQL)
def stream_cvd(spark: SparkSession, d: str) -> DataFrame:
    return _drained(spark, V.trades_of(_stream(spark, d)), processors.Cvd())


@query(f"WITH {P_SQL} SELECT symbol, seq, e FROM e")
def stream_ofi(spark: SparkSession, d: str) -> DataFrame:
    return _drained(spark, V.l1_of(_stream(spark, d)), processors.Ofi())


@query(f"WITH {MP_SQL} SELECT symbol, seq, max(e) FILTER (i = 0) AS e1, max(e) FILTER (i = 1) AS e2, max(e) FILTER (i = 2) AS e3 FROM f WHERE pe = epoch GROUP BY 1, 2")
def stream_mlofi(spark: SparkSession, d: str) -> DataFrame:
    rows = _drained(spark, V.lm_of(_stream(spark, d)), processors.Mlofi())
    return rows.select("symbol", "seq", *(F.get("e", F.lit(i)).alias(f"e{i + 1}") for i in range(V.LEVELS)))


@query(VPIN_SQL)
def stream_vpin(spark: SparkSession, d: str) -> DataFrame:
    return _drained(spark, V.trades_of(_stream(spark, d)), processors.Vpin(BUCKET, WINDOW)).select("symbol", "bucket", F.round("vpin", 9).alias("vpin"))


@query(f"""WITH {P_SQL}, r AS (SELECT p.symbol, p.seq, p.ts_event_ns, coalesce(CASE WHEN pe = epoch THEN {E_SQL} END, 0) AS e FROM p)
    SELECT symbol, seq, ts_event_ns, sum(e) OVER (PARTITION BY symbol ORDER BY ts_event_ns, seq RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - coalesce(sum(e) OVER (PARTITION BY symbol ORDER BY ts_event_ns RANGE BETWEEN UNBOUNDED PRECEDING AND {HOUR + 1} PRECEDING), 0) AS rolling FROM r""")
def stream_ofi_rolling(spark: SparkSession, d: str) -> DataFrame:
    return _drained(spark, V.l1_of(_stream(spark, d)), processors.RollingOfi(HOUR))


@query(f"""WITH {BUCKETS_SQL}, f AS (SELECT symbol, arg_min(price, trade_id) AS p FROM t GROUP BY 1),
    c AS (SELECT b.symbol, bucket, close - coalesce(lag(close) OVER (PARTITION BY b.symbol ORDER BY bucket), p) AS ch FROM b JOIN f ON b.symbol = f.symbol),
    q AS (SELECT symbol, bucket, ch, abs(ch / 9000.0) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(ch / 9000.0) / sqrt(2)) AS u FROM c),
    h AS (SELECT *, 0.5 * u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429)))) * exp(-x * x) AS tail FROM q),
    w AS (SELECT symbol, bucket, sum(abs({BUCKET} - 2 * {BUCKET} * CASE WHEN ch >= 0 THEN 1 - tail ELSE tail END)) OVER (PARTITION BY symbol ORDER BY bucket ROWS {WINDOW - 1} PRECEDING) AS s FROM h)
    SELECT symbol, bucket, round(least(1, greatest(0, s / ({WINDOW} * {BUCKET}))), 6) AS vpin FROM w WHERE bucket >= {WINDOW - 1}""")
def stream_vpin_bvc(spark: SparkSession, d: str) -> DataFrame:
    rows = _drained(spark, V.trades_of(_stream(spark, d)), processors.Vpin(BUCKET, WINDOW, "bvc", 9000.0))
    return rows.select("symbol", "bucket", F.round("vpin", 6).alias("vpin"))
