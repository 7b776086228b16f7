"""Least squares with HAC errors, from distributed sums.

Rows are (keys, t, x.., y). Lags run over the rows that stay after nulls are taken out.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import Order, row_index
from ..functions.scalars import floor_div
from ..sources.tape import written


#: Fewer rows say too little to be fitted, unless a caller asks for it.
LEAST_ROWS = 8


def hac_lags(n) -> object:
    """Newey-West's lag number for a row-count column: 4 (n / 100)^(2/9), at least 1."""
    return F.greatest(F.lit(1), F.floor(F.lit(4.0) * F.pow(n / 100.0, F.lit(2.0 / 9.0)))).cast("int")


def ols(rows: DataFrame, keys: tuple[str, ...], x: str = "x", y: str = "y", order: str = "t", max_lags: int | None = None, least: int = LEAST_ROWS) -> DataFrame:
    """keys, n, alpha, beta, r2, se_beta, t_beta. Null coefficients below `least` rows; r2 is null where
    y does not vary. Lags up to max_lags are summed in one pass; the key's n picks how many count.
    By default max_lags is what the longest key needs, found first (one number on the driver)."""
    rows = written(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, order, x, y), "ols-rows")  # read by every step
    if max_lags is None:
        longest = rows.groupBy(*keys).count().agg(F.max("count").alias("n"))
        max_lags = longest.select(F.coalesce(hac_lags(F.col("n")), F.lit(1))).first()[0]
    fit = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"),
        F.when(F.var_pop(y) > 0, F.regr_r2(y, x)).alias("r2"), F.avg(x).alias("__mx"), F.regr_sxx(y, x).alias("__sxx"))
    u = F.col(y) - F.col("alpha") - F.col("beta") * F.col(x)
    scored = rows.join(fit, list(keys)).withColumn("__g", u * (F.col(x) - F.col("__mx")))
    lagged = _lagged(scored, keys, order, max_lags)
    sums = lagged.groupBy(*keys).agg(F.sum(F.col("__g") * F.col("__g")).alias("__s0"), *(F.coalesce(F.sum(F.col("__g") * F.col(f"__g{k}")), F.lit(0.0)).alias(f"__s{k}") for k in range(1, max_lags + 1)))
    out = fit.join(sums, list(keys)).withColumn("__l", hac_lags(F.col("n")))
    total = F.col("__s0")
    for k in range(1, max_lags + 1):
        total = total + F.when(F.col("__l") >= k, F.lit(2.0) * (F.lit(1.0) - F.lit(float(k)) / (F.col("__l") + 1)) * F.col(f"__s{k}")).otherwise(0.0)
    enough = F.col("n") >= least
    se = F.sqrt(total) / F.col("__sxx")
    out = out.withColumn("se_beta", F.when(enough & (total >= 0) & (F.col("__sxx") > 0), se))
    return out.select(*keys, "n", *(F.when(enough, F.col(c)).alias(c) for c in ("alpha", "beta", "r2")), "se_beta", F.try_divide("beta", "se_beta").alias("t_beta"))


CHUNK = 65_536


def _lagged(rows: DataFrame, keys: tuple[str, ...], order: str, lags: int) -> DataFrame:
    """keys, __g and its lags. Rows are numbered by their place among all distinct times, found by
    ranges of time; a chunk of them gets the `lags` rows before it, so that no key is one task."""
    span = rows.groupBy(*keys).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"), F.count("*").alias("__rows"))
    rows = rows.select(*keys, order, "__g").join(span, list(keys))
    # Some CHUNK rows a range of time, if they are spread evenly.
    per = F.greatest(F.lit(1).cast("long"), ((F.col("__hi") - F.col("__lo")) / F.greatest(F.lit(1.0), F.col("__rows") / CHUNK)).cast("long"))
    rows = rows.withColumn("__part", floor_div(F.col(order) - F.col("__lo"), per)).select(*keys, order, "__g", "__part")
    rows = row_index(rows, Order(keys, (order,), F.col("__part")), "__i")
    chunk = max(CHUNK, lags)
    rows = rows.withColumns({"__c": floor_div("__i", chunk), "__to": F.explode(F.sequence(floor_div("__i", chunk), floor_div(F.col("__i") + lags, chunk)))})
    w = Window.partitionBy(*keys, "__to").orderBy("__i")
    return rows.select(*keys, "__c", "__to", "__g", *(F.lag("__g", k).over(w).alias(f"__g{k}") for k in range(1, lags + 1))).where("__c = __to")


def gram(rows: DataFrame, keys: tuple[str, ...], xs: list[str], y: str) -> DataFrame:
    """keys, n and the sums of products of (1, xs.., y): all that a fit needs, in one aggregation."""
    names = [*xs, y]
    for c in names:
        rows = rows.where(F.col(c).isNotNull())
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(names)]
    sums += [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s_{i}_{j}") for i, j in combinations_with_replacement(range(len(names)), 2)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)


def r2_of_few(rows: DataFrame, keys: tuple[str, ...], xs: list[str], y: str, order: str = "t") -> DataFrame:
    """keys, r2 of the keys with fewer than LEAST_ROWS rows, each regressor being made orthogonal to those
    before it. With fewer rows than coefficients the later ones are left with rounding errors, and so is
    r2; it is NaN where one is left with nothing. Sums run in order of `order`."""
    for c in (*xs, y):
        rows = rows.where(F.col(c).isNotNull())
    few = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") < LEAST_ROWS).drop("__n")
    own = F.sort_array(F.collect_list(F.struct(order, F.array(*xs, y).alias("v"))))  # fewer than LEAST_ROWS
    kept = rows.join(few, list(keys)).groupBy(*keys).agg(F.transform(own, lambda r: r["v"]).alias("__rows"))

    @F.pandas_udf("double")
    def r2(each: pd.Series) -> pd.Series:
        total = lambda v: np.cumsum(v)[-1]  # noqa: E731  one by one
        out = []
        for rows in each:
            *left, dy = (c - total(c) / len(c) for c in np.array([list(r) for r in rows], float).T)
            explained = 0.0
            with np.errstate(all="ignore"):
                for i, r in enumerate(left):
                    v = total(r * r)
                    c = total(r * dy) / v
                    explained += c * c * v
                    for j in range(i + 1, len(left)):
                        left[j] = left[j] - total(r * left[j]) / v * r
                out.append(float(explained / total(dy * dy)))
        return pd.Series(out)

    return kept.select(*keys, F.coalesce(r2("__rows"), F.lit(float("nan"))).alias("r2"))  # Arrow takes NaN for null


def ols_multi(rows: DataFrame, keys: tuple[str, ...], xs: list[str], y: str) -> DataFrame:
    """keys, n, coefficients (intercept first), r2. One small system per key, solved where its
    sums are."""
    k = len(xs)
    sums = gram(rows, keys, xs, y)

    @F.pandas_udf("array<double>")
    def solve(frame: pd.DataFrame) -> pd.Series:
        out = []
        for r in frame.to_dict("records"):
            s = lambda i: r[f"s_{i}"]
            p = lambda i, j: r[f"s_{min(i, j)}_{max(i, j)}"]
            n = r["n"]
            if n < max(LEAST_ROWS, k + 2):
                out.append(None)
                continue
            a = np.array([[n, *(s(j) for j in range(k))], *([s(i), *(p(i, j) for j in range(k))] for i in range(k))], float)
            b = np.array([s(k), *(p(i, k) for i in range(k))], float)
            c, *_ = np.linalg.lstsq(a, b, rcond=None)
            syy = p(k, k) - s(k) ** 2 / n
            rss = p(k, k) - c @ b
            out.append([*map(float, c), float(1 - rss / syy) if syy > 0 else float("nan")])
        return pd.Series(out)

    out = sums.withColumn("__c", solve(F.struct("n", *(c for c in sums.columns if c.startswith("s_")))))
    return out.select(*keys, "n", F.slice("__c", 1, k + 1).alias("coefficients"), F.nanvl(F.get("__c", F.lit(k + 1)), F.lit(None).cast("double")).alias("r2"))
