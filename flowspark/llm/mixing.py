"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight over training time, given by knots. Integrating it gives the source's
cumulative demand for words. Targets are the demands at the end, held to MAX_EPOCHS times a
source's size, the excess reshared by weight (a water level over the sources). Without a schedule
of its own a source gets one by its place in the order of names: WEIGHTS are the integrals, SHAPES
how they rise or fall over time. Within a source, documents stand in the order of a hash of their
id and text, the same in every epoch; the place of a document in that supply, put through the inverse of
the source's cumulative demand, is its training position, and documents are range-sorted by it.

Only whole documents are taken. The last epoch takes documents in their order until one doesn't
fit in what is left of the target, then goes on behind it with those of at most that gap, ROUNDS
times; what is left goes to the document not taken whose size is nearest to the gap. So one large
document doesn't keep a source from its target.

Decisions are made on ids, sizes and hashes alone. Sums within a source are made in 4096 buckets of
the hash, and what is known of a source reaches its rows by (source, bucket), so that no task gets
a whole source; `arrange` then moves each text twice, to its decision and into training order.

Nulls: a null source is a source of its own, last in order; a null text has size 0; a null id is
an id like any other. Documents of size 0 take nothing, but come along in every full epoch.
Rows that are repeated or share an id are mixed each on its own. Empty tables give empty results. `plan` returns doc_id, source and columns named
`mix_`; `arrange` returns the input's columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Tables, read_table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by their order, repeating, and how each changes from the start to the
#: end of training: the integrals of WEIGHTS times SHAPES are WEIGHTS.
WEIGHTS = (5, 2, 1)
SHAPES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
POINTS = 257
MAX_EPOCHS = 3
ROUNDS = 3
SEED = "mix-1"

Schedule = dict[str, list[tuple[float, float]]]


def cumulative(weights: np.ndarray) -> tuple[float, list[float]]:
    """The integral over time of a weight given on an even grid, and the normalised demand up to
    each point of the grid."""
    cum = np.concatenate([[0.0], np.cumsum((weights[1:] + weights[:-1]) / 2)]) / (len(weights) - 1)
    return float(cum[-1]), (cum / cum[-1]).tolist() if cum[-1] > 0 else [0.0, 1.0]


def integrate(schedule: Schedule) -> dict[str, tuple[float, list[float]]]:
    """Per source of a schedule {source: [(time in 0..1, weight), ...]}: the integral of its share
    of all weights and its cumulative demand."""
    t = np.linspace(0.0, 1.0, POINTS)
    weights = {s: np.interp(t, *zip(*sorted(knots), strict=True)) for s, knots in schedule.items()}
    total = np.sum(list(weights.values()), axis=0)
    return {s: cumulative(np.divide(w, total, out=np.zeros_like(w), where=total > 0)) for s, w in weights.items()}


def standing() -> list[tuple[float, list[float]]]:
    """Integral and cumulative demand of the first, second, ... source where no schedule is given."""
    t = np.linspace(0.0, 1.0, POINTS)
    return [cumulative(w * np.interp(t, (0.0, 1.0), shape)) for w, shape in zip(WEIGHTS, SHAPES, strict=True)]


def curves_of(schedule: Schedule | None) -> list[list[float]]:
    """Cumulative demands by number; the last one is the flat one of sources without a schedule."""
    return [c for _, c in (standing() if schedule is None else integrate(schedule).values())] + [[0.0, 1.0]]


def source_key(source: Column | str = "source") -> Column:
    """Sorts like the source by code point, null last, and is never null."""
    c = F.col(source) if isinstance(source, str) else source
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c))


def targets(sizes: DataFrame, schedule: Schedule | None = None) -> DataFrame:
    """mix_source, mix_source_size -> also mix_target, mix_curve (its number). One row per source: the windows
    over all rows see the sources only, never the documents."""
    by_name = Window.orderBy("mix_source")
    if schedule is None:
        made = sizes.sparkSession.createDataFrame([(k, w, k) for k, (w, _) in enumerate(standing())], "mix_k int, mix_weight double, mix_curve int")
        rows = sizes.withColumn("mix_k", (F.row_number().over(by_name) - 1) % len(WEIGHTS)).join(made, "mix_k").drop("mix_k")
    else:
        made = [(f"0{s}", w, k) for k, (s, (w, _)) in enumerate(integrate(schedule).items())]
        known = sizes.sparkSession.createDataFrame(made, "mix_source string, mix_weight double, mix_curve int")
        rows = sizes.join(known, "mix_source", "left").withColumns({
            "mix_weight": F.coalesce("mix_weight", F.lit(0.0)), "mix_curve": F.coalesce("mix_curve", F.lit(len(made)))})
    cap = F.lit(MAX_EPOCHS) * F.col("mix_source_size")
    # Sources are capped in the order of cap over weight; the first that is not sets the level.
    order = Window.orderBy(F.try_divide(F.col("mix_source_size").cast("double"), "mix_weight").asc_nulls_last(), "mix_source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumns({
        "mix_total": F.sum("mix_source_size").over(Window.partitionBy()),
        "mix_capped": F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "mix_free": F.sum("mix_weight").over(after),
    })
    left = F.col("mix_total") - F.col("mix_capped")
    open_ = F.col("mix_weight") * left < cap * F.col("mix_free")
    first = F.first(F.when(open_, F.struct(left.alias("left"), F.col("mix_free").alias("free"))), ignorenulls=True)
    level = first.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("mix_level", level)
    share = F.col("mix_weight") * F.col("mix_level.left") / F.col("mix_level.free")
    # Below the level's source all are capped; from it on, none is.
    target = F.when(F.col("mix_level").isNotNull() & (F.col("mix_capped") >= F.col("mix_total") - F.col("mix_level.left")), share)
    return rows.select("mix_source", "mix_source_size", "mix_total", "mix_curve",
                       F.coalesce(target, cap.cast("double")).alias("mix_target"))


BUCKET = ["mix_source", "mix_bucket"]
#: A row's place in its source.
PLACE = ["mix_source", "mix_hash"]
STEP = "struct<lo: bigint, hi: bigint, gap: double, place: double, scale: double>"


def keyed() -> list[Column]:
    """Source and hash of id and text, neither of them null."""
    parts = [F.coalesce(c, F.lit("null")) for c in (F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")))]
    number = F.md5(F.concat(F.lit(f"{SEED}:"), parts[0], F.lit(":"), parts[1]).cast("binary"))
    return [source_key("source").alias("mix_source"), number.alias("mix_hash")]


def ranked(docs: DataFrame, tables: Tables, schedule: Schedule | None = None) -> DataFrame:
    """One row per row of docs: doc_id, source, its key, mix_size, mix_end (words of its source up
    to its end) and what is known of its source, of which `decided` makes the decision."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("mix_size")
    slim = docs.select("doc_id", "source", *keyed(), size).withColumn("mix_bucket", F.substring("mix_hash", 1, 3))
    slim = tables.put("mix-slim", slim)
    per_bucket = slim.groupBy(*BUCKET).agg(F.sum("mix_size").alias("mix_sum"))
    earlier = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Sources have up to 4096 rows here; documents meet them by bucket only.
    buckets = tables.put("mix-buckets", per_bucket.withColumn("mix_offset", F.coalesce(F.sum("mix_sum").over(earlier), F.lit(0))))
    full = F.when(F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))).otherwise(F.lit(MAX_EPOCHS)).cast("long")
    goal = targets(buckets.groupBy("mix_source").agg(F.sum("mix_sum").alias("mix_source_size")), schedule)
    goal = goal.withColumn("mix_full", full).withColumn("mix_rest", F.col("mix_target") - F.col("mix_full") * F.col("mix_source_size"))
    goal = goal.withColumns({"mix_lo": F.lit(0).cast("long"), "mix_gap": F.col("mix_rest"), "mix_steps": F.array().cast(f"array<{STEP}>")})
    goal = tables.put("mix-goal", goal)
    inside = Window.partitionBy(*BUCKET).orderBy("mix_hash", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = slim.withColumn("mix_end", F.sum("mix_size").over(inside)).join(buckets.drop("mix_sum"), BUCKET)
    rows = tables.put("mix-ranked", rows.withColumn("mix_end", F.col("mix_end") + F.col("mix_offset")).drop("mix_offset"))
    names = buckets.select(*BUCKET)
    for _ in range(ROUNDS):
        goal = tables.put("mix-goal", _round(rows, names, goal))
    # Sizes are positive here, so mix_end tells a source's documents apart.
    off = F.abs(F.col("mix_size") - F.col("mix_gap"))
    over = rows.where("mix_size > 0").join(names.join(goal, "mix_source"), BUCKET).where(_step().isNull() & (off < F.col("mix_gap")))
    extra = over.groupBy("mix_source").agg(F.min(F.struct(off.alias("off"), F.col("mix_end").alias("mix_end"))).alias("x")).select("mix_source", F.col("x.mix_end").alias("mix_extra"))
    facts = goal.drop("mix_lo").join(extra, "mix_source", "left")
    return rows.join(tables.put("mix-facts", names.join(facts, "mix_source")), BUCKET)


def _round(rows: DataFrame, names: DataFrame, goal: DataFrame) -> DataFrame:
    """goal after one more step of the last epoch: behind mix_lo, documents of at most mix_gap words
    are taken up to the first that doesn't fit. Only the bucket that holds that one is walked."""
    open_ = names.join(goal.select("mix_source", "mix_lo", "mix_gap"), "mix_source")
    fitting = rows.select(*BUCKET, "mix_end", "mix_size").join(open_, BUCKET).where(
        (F.col("mix_size") > 0) & (F.col("mix_end") - F.col("mix_size") >= F.col("mix_lo")) & (F.col("mix_size") <= F.col("mix_gap")))
    per = fitting.groupBy(*BUCKET).agg(F.sum("mix_size").alias("sum"), F.first("mix_gap").alias("gap"))
    earlier = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    held = per.where((F.col("before") <= F.col("gap")) & (F.col("before") + F.col("sum") > F.col("gap"))).select(*BUCKET, "before")
    inside = Window.partitionBy(*BUCKET).orderBy("mix_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = fitting.join(held, BUCKET).withColumn("run", F.col("before") + F.sum("mix_size").over(inside)).where(F.col("run") > F.col("mix_gap"))
    first = walked.groupBy("mix_source").agg(F.min(F.struct("mix_end", "mix_size", "run")).alias("x"))
    out = goal.join(per.groupBy("mix_source").agg(F.sum("sum").alias("sum")), "mix_source", "left").join(first, "mix_source", "left")
    got = F.coalesce(F.col("x.run") - F.col("x.mix_size"), F.col("sum"), F.lit(0))
    # Where all fit, the step reaches to the end of the source.
    hi, lo = F.coalesce(F.col("x.mix_end") - F.col("x.mix_size"), F.col("mix_source_size")), F.coalesce(F.col("x.mix_end"), F.col("mix_source_size"))
    left = F.col("mix_gap") - got
    scale = F.coalesce(F.try_divide(F.col("mix_gap") - left, hi - F.col("mix_lo")), F.lit(0.0))
    step = F.struct(F.col("mix_lo").alias("lo"), hi.alias("hi"), F.col("mix_gap").alias("gap"), (F.col("mix_rest") - F.col("mix_gap")).alias("place"), scale.alias("scale")).cast(STEP)
    return out.withColumns({"mix_steps": F.array_append("mix_steps", step), "mix_lo": lo, "mix_gap": left}).drop("sum", "x")


def _step() -> Column:
    """The step of the last epoch that takes the row, else null."""
    start = F.col("mix_end") - F.col("mix_size")
    return F.get(F.filter("mix_steps", lambda s: (s["lo"] <= start) & (F.col("mix_end") <= s["hi"]) & (F.col("mix_size") <= s["gap"])), F.lit(0))


def decided(rows: DataFrame) -> DataFrame:
    """Rows of `ranked` with mix_copies and mix_start, the words that the last epoch takes before the
    row: within a step, rows keep their distances in the supply, shrunk by what the step leaves out."""
    rows = rows.withColumn("mix_step", _step())
    is_extra = F.coalesce((F.col("mix_extra") == F.col("mix_end")) & (F.col("mix_size") > 0), F.lit(False))
    partial = (F.col("mix_step").isNotNull() & (F.col("mix_rest") > 0)) | is_extra
    start = F.col("mix_step.place") + (F.col("mix_end") - F.col("mix_size") - F.col("mix_step.lo")) * F.col("mix_step.scale")
    return rows.withColumns({"mix_copies": F.col("mix_full") + partial.cast("long"), "mix_start": F.when(is_extra, F.col("mix_rest") - F.col("mix_gap")).otherwise(start)})


def place(copy: Column) -> Column:
    """Words of its source before a copy, numbered from 0, of a row of `decided`."""
    whole = copy * F.col("mix_source_size")
    return F.when(copy == F.col("mix_full"), whole + F.col("mix_start")).otherwise((whole + F.col("mix_end") - F.col("mix_size")).cast("double"))


def plan(docs: DataFrame, schedule: Schedule | None = None) -> DataFrame:
    """doc_id and source of every row of docs with mix_size, mix_source_size, mix_target, mix_copies
    (how often the mix takes the document) and mix_position (of its first copy)."""
    rows = decided(ranked(docs, Tables(docs.sparkSession), schedule))
    rows = rows.withColumn("mix_position", F.when(F.col("mix_copies") > 0, position(place(F.lit(0).cast("long")), curves_of(schedule))))
    return rows.select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_position")


def position(words: Column, curves: list[list[float]]) -> Column:
    """The training position at which a source's demand has reached `words`, the time as a part of
    all words: the inverse of its cumulative demand, linear between grid points."""
    every = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in c) + ")" for c in curves) + ")")
    curve, f = F.get(every, F.col("mix_curve")), F.least(F.lit(1.0), F.coalesce(F.try_divide(words, F.col("mix_target")), F.lit(0.0)))
    n = F.size(curve) - 1
    i = F.least(F.size(F.filter(curve, lambda x: x <= f)), n)  # 1-based left grid point
    lo, hi = F.get(curve, i - 1), F.get(curve, i)
    inside = F.coalesce(F.try_divide(f - lo, hi - lo), F.lit(0.0))
    return (F.lit(1.0) * (i - 1) + inside) / n * F.col("mix_total")


def arrange(docs: DataFrame, schedule: Schedule | None = None) -> DataFrame:
    """The mix itself: docs' rows, repeated as often as taken, range-sorted by training position."""
    tables = Tables(docs.sparkSession)
    first = ranked(docs, tables, schedule).groupBy(*PLACE).agg(
        F.min("mix_end").alias("mix_end"), *(F.first(c).alias(c) for c in ("mix_size", "mix_source_size", "mix_target", "mix_total", "mix_curve", "mix_full", "mix_rest", "mix_gap", "mix_steps", "mix_extra")))
    first = tables.put("mix-first", first)
    tables.drop("mix-slim", "mix-ranked", "mix-buckets", "mix-facts", "mix-goal")
    # The user's columns travel in one struct. Rows of one key stand one after the other in their
    # source, so the first one's end tells the others'.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mix_whole"), *keyed())
    same = Window.partitionBy(*PLACE).orderBy("mix_source")
    rows = whole.join(first, PLACE).withColumn("mix_no", F.row_number().over(same) - 1)
    rows = decided(rows.withColumn("mix_end", F.col("mix_end") + F.col("mix_no") * F.col("mix_size")))
    copy = rows.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_copies") - 1)))
    placed = copy.select("mix_whole", "mix_source", "mix_copy", position(place(F.col("mix_copy")), curves_of(schedule)).alias("mix_at"))
    return placed.orderBy("mix_at", "mix_source", "mix_copy", "mix_whole.doc_id").select("mix_whole.*")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
        F.col("mix_position").alias("position"),
    ).orderBy("position", "doc_id")


def _rounds_sql() -> str:
    """The steps g1, g2, ... of the last epoch over r (s, n, rest, size, e), as `_round` takes them."""
    out = ["g0 AS (SELECT s, any_value(n) AS n, any_value(rest) AS rest, CAST(0 AS BIGINT) AS lo, any_value(rest) AS gap FROM r GROUP BY s)"]
    for i in range(1, ROUNDS + 1):
        out.append(f"""c{i} AS (SELECT r.s, e, size, gap, CAST(sum(size) OVER (PARTITION BY r.s ORDER BY e) AS BIGINT) AS run FROM r JOIN g{i - 1} g ON r.s = g.s
      WHERE size > 0 AND e - size >= lo AND size <= gap),
f{i} AS (SELECT s, min(e) FILTER (run > gap) AS fe, arg_min(size, e) FILTER (run > gap) AS fs, max(run) FILTER (run <= gap) AS got FROM c{i} GROUP BY s),
g{i} AS (SELECT g.s, n, rest, g.lo AS lo_{i}, coalesce(fe - fs, n) AS hi, g.gap AS was, rest - g.gap AS place, coalesce(fe, n) AS lo, g.gap - coalesce(got, 0) AS gap,
      coalesce((g.gap - (g.gap - coalesce(got, 0))) / nullif(coalesce(fe - fs, n) - g.lo, 0), 0) AS scale FROM g{i - 1} g LEFT JOIN f{i} f ON g.s = f.s)""")
    every = ", ".join(f"{{'lo': g{i}.lo_{i}, 'hi': g{i}.hi, 'gap': g{i}.was, 'place': g{i}.place, 'scale': g{i}.scale}}" for i in range(1, ROUNDS + 1))
    out.append(f"g AS (SELECT g1.s, g{ROUNDS}.gap, [{every}] AS steps FROM g1 " + " ".join(f"JOIN g{i} ON g{i}.s = g1.s" for i in range(2, ROUNDS + 1)) + ")")
    return ",\n".join(out)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
             CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')) AS h FROM documents),
z AS (SELECT s, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY s),
u AS (SELECT s, n, (row_number() OVER (ORDER BY s) - 1) % 3 AS k, CAST(sum(n) OVER () AS BIGINT) AS total FROM z),
w AS (SELECT s, n, total, CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
        list_transform(range(0, 257), lambda i: CASE k WHEN 0 THEN 1.5::DOUBLE * i / 256 - 0.5::DOUBLE * i * i / 65536 WHEN 1 THEN 0.5::DOUBLE * i / 256 + 0.5::DOUBLE * i * i / 65536 ELSE 1::DOUBLE * i / 256 END) AS curve FROM u),
o AS (SELECT *, CAST(coalesce(sum(3 * n) OVER (ORDER BY CAST(n AS DOUBLE) / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
        CAST(sum(w) OVER (ORDER BY CAST(n AS DOUBLE) / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS free FROM w),
l AS (SELECT min(capped) AS capped, arg_min(free, capped) AS free FROM o WHERE w * (total - capped) < 3 * n * free),
t AS (SELECT o.s, n, total, curve, CASE WHEN l.capped IS NOT NULL AND o.capped >= l.capped
        THEN CAST(w * (total - l.capped) AS DOUBLE) / l.free ELSE CAST(3 * n AS DOUBLE) END AS target FROM o, l),
c AS (SELECT d.*, n, total, target, curve, CASE WHEN n > 0 THEN floor(target / n) ELSE 3 END AS f,
        CAST(sum(size) OVER (PARTITION BY d.s ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM d JOIN t ON d.s = t.s),
r AS (SELECT *, target - f * n AS rest FROM c),
""" + _rounds_sql() + r""",
v AS (SELECT r.*, gap, list_filter(steps, lambda x: x.lo <= e - size AND e <= x.hi AND size <= x.gap)[1] AS step FROM r JOIN g ON r.s = g.s),
x AS (SELECT s, arg_min(e, {'off': abs(size - gap), 'e': e}) AS xe FROM v WHERE step IS NULL AND size > 0 AND abs(size - gap) < gap GROUP BY s),
y AS (SELECT v.*, coalesce(xe = e AND size > 0, false) AS extra FROM v LEFT JOIN x ON v.s = x.s),
k AS (SELECT *, CAST(f AS BIGINT) + CASE WHEN (step IS NOT NULL AND rest > 0) OR extra THEN 1 ELSE 0 END AS copies,
        CAST(CASE WHEN f > 0 THEN e - size WHEN extra THEN rest - gap ELSE step.place + (e - size - step.lo) * step.scale END AS DOUBLE) AS start FROM y),
q AS (SELECT *, least(1.0::DOUBLE, coalesce(start / nullif(target, 0), 0)) AS part FROM k),
i AS (SELECT *, least(len(list_filter(curve, lambda x: x <= part)), 256) AS left_point FROM q)
SELECT doc_id, size, n AS source_size, target, CAST(size * copies AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN (1.0::DOUBLE * (left_point - 1) + (part - curve[left_point]) / (curve[left_point + 1] - curve[left_point])) / 256 * total END AS position
FROM i
"""
