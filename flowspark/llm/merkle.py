"""A Merkle manifest of a dataset: a digest per row, per source and of the whole, with proofs.

A row's leaf is the digest of its columns. Per source, leaves stand by id; every FAN consecutive
nodes (the last run may be shorter) become the digest of their concatenation, until one node is
left: the source's subroot. Subroots, in the order of sources, become the root in the same way.

Leaves are numbered within their sources by one range sort, then dealt to aligned blocks of
FAN ** BLOCK_LEVELS consecutive ones. A block is one Arrow table in one task, in which DuckDB runs
the level queries (ordered string_agg, then sha256) and returns the block's root. Spark combines
block roots level by level, joins each block with its outer proof, and DuckDB puts the inner proof
before it and folds the leaf to be checked up to the root. A block has 4096 leaves at most,
whatever the size of a source; blocks and outer levels are small tables, written one by one.

Only ids, sources and digests are shuffled, never texts. The texts are read once.

Nulls: a null column enters a leaf as `-`; a null source is a source of its own, first in order; a
null id is the smallest. Texts enter whole, an empty one as `0:`. Rows that share an id stand in
the order of their leaves, so repeated rows have equal leaves but places and proofs of their own.
A table without rows gives no rows. Other columns of the table do not enter, whatever their names.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Tables, crc32_sql, read_table

FAN = 16
BLOCK_LEVELS = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row's values, each with its length before it."""
    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*(field(c) for c in columns.values())), 256)


def positions(rows: DataFrame, tables: Tables, name: str, order: list[Column]) -> DataFrame:
    """rows with `pos`, the place from 0 of each within its `grp`, by a range sort: no task gets a
    whole group, and what is counted is a row for each group and partition that has it."""
    placed = rows.orderBy("grp", *order).withColumn("row", F.monotonically_increasing_id())
    placed = tables.put(name, placed.withColumn("part", F.shiftright("row", 33)))
    runs = placed.groupBy("part", "grp").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "grp", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    runs = tables.put(f"{name}-runs", runs)
    return placed.join(runs, ["part", "grp"]).withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")


@functools.cache
def engine():
    """This worker's DuckDB: one thread, nothing outside memory."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "384MB", "temp_directory": ""})


def levels_of(block: int, n: int, most: int) -> int:
    """Levels inside a block of n leaves: all, unless it is all there is of its source."""
    if block > 0:
        return most
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def climbed(leaves: pa.Table, most: int) -> int:
    """Runs the level queries on a block's (pos, leaf): tables run1, run2, ... with the digests of
    each run in order, and node0, node1, ...; returns the number of levels."""
    db, size = engine(), FAN**most
    levels = levels_of(leaves["block"][0].as_py(), leaves.num_rows, most)
    db.register("leaves", leaves)
    db.execute(f"CREATE OR REPLACE TEMP TABLE node0 AS SELECT pos % {size} AS pos, leaf AS h FROM leaves")
    for k in range(1, levels + 1):
        db.execute(f"CREATE OR REPLACE TEMP TABLE run{k} AS SELECT pos // {FAN} AS run, string_agg(h, '' ORDER BY pos) AS hs FROM node{k - 1} GROUP BY run")
        db.execute(f"CREATE OR REPLACE TEMP TABLE node{k} AS SELECT run AS pos, sha256(hs) AS h FROM run{k}")
    return levels


def block_root(most: int):
    def run(leaves: pa.Table) -> pa.Table:
        levels = climbed(leaves, most)
        [(h,)] = engine().execute(f"SELECT h FROM node{levels}").fetchall()
        return pa.table({"grp": [leaves["grp"][0].as_py()], "pos": pa.array([leaves["block"][0].as_py()], pa.int64()), "h": [h]})

    return run


def climb(nodes: DataFrame, tables: Tables, name: str) -> tuple[DataFrame, DataFrame]:
    """(grp, pos, h) -> the last node of each group (grp, h) and each node's path (grp, pos, path):
    what stands left and right of it in its run, level by level. A task gets runs of FAN nodes."""
    at = nodes.join(nodes.groupBy("grp").agg(F.max("pos").alias("last")), "grp")
    at, levels = tables.put(name, at), []
    most = at.agg(F.max("last")).first()[0] or 0
    while most:
        runs = at.groupBy("grp", F.expr(f"pos div {FAN}").alias("run"), "last").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("hs"))
        levels.append(tables.put(f"{name}-{len(levels)}", runs.withColumn("hs", F.col("hs.h"))))
        up = F.when(F.col("last") == 0, F.get("hs", F.lit(0))).otherwise(F.sha2(F.array_join("hs", ""), 256))
        at = levels[-1].select("grp", F.col("run").alias("pos"), up.alias("h"), F.expr(f"last div {FAN}").alias("last"))
        most //= FAN
    paths = at.select("grp", "pos", F.expr("cast(array() AS array<struct<l: string, r: string>>)").alias("path"))
    for runs in reversed(levels):
        inside = runs.join(paths.withColumnRenamed("pos", "run"), ["grp", "run"]).select("*", F.posexplode("hs").alias("i", "h"))
        sides = F.struct(F.array_join(F.slice("hs", 1, F.col("i")), "").alias("l"), F.array_join(F.slice("hs", F.col("i") + 2, F.lit(FAN)), "").alias("r"))
        path = F.when(F.col("last") == 0, F.col("path")).otherwise(F.concat(F.array(sides), "path"))
        paths = inside.select("grp", (F.col("run") * FAN + F.col("i")).alias("pos"), path.alias("path"))
    return at.select("grp", "h"), paths


def proved(most: int):
    """A block's leaves and its outer path: each leaf's siblings up to the root, and the root that
    the leaf to be checked leads to."""
    def run(leaves: pa.Table, outer: pa.Table) -> pa.Table:
        above = outer["path"][0].as_py()
        levels = climbed(leaves, most)
        joins, siblings, own, given = "", [], "checked", {}
        for k in range(1, levels + 1):
            joins += f" JOIN run{k} ON run{k}.run = (pos % {FAN**most}) // {FAN**k}"
            at = f"(64 * (pos // {FAN ** (k - 1)} % {FAN}))::INTEGER"
            before, after = f"left(run{k}.hs, {at})", f"substr(run{k}.hs, {at} + 65)"
            siblings.append(f"{before} || {after}")
            own = f"sha256({before} || {own} || {after})"
        for k, side in enumerate(above):
            given |= {f"l{k}": side["l"], f"r{k}": side["r"]}
            own = f"sha256($l{k} || {own} || $r{k})"
        given["outer"] = "".join(side["l"] + side["r"] for side in above)
        proof = " || ".join([*siblings, "$outer"])
        out = engine().sql(f"SELECT doc_id, leaf, {proof} AS proof, {own} AS folded_root FROM leaves{joins}", params=given).to_arrow_table()
        whole = [pa.array([outer[c][0].as_py()] * out.num_rows, pa.string()) for c in ("subroot", "root")]
        return pa.table([out["doc_id"].cast(pa.int64()), out["leaf"].cast(pa.string()), out["proof"].cast(pa.string()), out["folded_root"].cast(pa.string()), *whole],
                        names=["doc_id", "leaf", "proof", "folded_root", "subroot", "root"])

    return run


class Manifest(NamedTuple):
    """leaves: grp, pos, block, doc_id, leaf, checked; outer: grp, block, path, subroot, root; one row a
    block."""

    leaves: DataFrame
    outer: DataFrame
    block_levels: int

    def proofs(self) -> DataFrame:
        """doc_id, leaf, proof (all siblings up to the root, as hex digits in a row), folded_root (to which
        the leaf under `checked` leads with this proof), subroot and root of every row."""
        pairs = self.leaves.groupBy("grp", "block").cogroup(self.outer.groupBy("grp", "block"))
        return pairs.applyInArrow(proved(self.block_levels), "doc_id long, leaf string, proof string, folded_root string, subroot string, root string")


def manifest(docs: DataFrame, checked_text: Column | None = None, block_levels: int = BLOCK_LEVELS) -> Manifest:
    """The manifest of docs. With `checked_text`, the leaves to be checked are made of that text in
    place of the row's own."""
    tables = Tables(docs.sparkSession)
    own = {c: F.col(c) for c in COLUMNS}
    other = F.lit(None).cast("string") if checked_text is None else F.when(~checked_text.eqNullSafe(F.col("text")), leaf(own | {"text": checked_text}))
    group = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    leaves = tables.put("merkle-leaves", docs.select(group.alias("grp"), F.col("doc_id").cast("long"), leaf(own).alias("leaf"), other.alias("checked")))
    leaves = positions(leaves, tables, "merkle-order", [F.asc_nulls_first("doc_id"), F.col("leaf"), F.col("checked")])
    size = FAN**block_levels
    leaves = leaves.select("grp", "pos", F.expr(f"pos div {size}").alias("block"), "doc_id", "leaf", F.coalesce("checked", "leaf").alias("checked"))
    leaves = tables.put("merkle-placed", leaves)
    tables.drop("merkle-leaves", "merkle-order", "merkle-order-runs")
    roots = leaves.groupBy("grp", "block").applyInArrow(block_root(block_levels), "grp string, pos long, h string")
    subroots, inside = climb(tables.put("merkle-roots", roots), tables, "merkle-blocks")
    subroots = tables.put("merkle-subroots", subroots)
    everything = positions(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "h"), tables, "merkle-sources", [F.col("source")])
    everything = tables.put("merkle-ranked", everything)
    root, across = climb(everything.select("grp", "pos", "h"), tables, "merkle-top")
    tops = everything.join(across.select("pos", F.col("path").alias("across")), "pos").join(root.select("grp", F.col("h").alias("root")), "grp")
    tops = tops.select(F.col("source").alias("grp"), F.col("h").alias("subroot"), "across", "root")
    outer = inside.join(tops, "grp").select("grp", F.col("pos").alias("block"), F.concat("path", "across").alias("path"), "subroot", "root")
    return Manifest(leaves, tables.put("merkle-outer", outer), block_levels)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    checked = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = manifest(read_table(spark, sf_dir, "documents"), checked).proofs()
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _climbed_sql(name: str, levels: int) -> str:
    """CTEs name1, name2, ... over name0(grp, pos, h, last): runs with their digests in order, and what
    they become; a group's last node stays."""
    return ",\n".join(
        f"{name}{k} AS (SELECT grp, pos // 16 AS pos, CASE WHEN any_value(last) = 0 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h,"
        f" any_value(last) // 16 AS last, any_value(last) = 0 AS over, string_agg(h, '' ORDER BY pos) AS hs FROM {name}{k - 1} GROUP BY grp, pos // 16)"
        for k in range(1, levels + 1))


def _proved_sql(name: str, tree: str, levels: int, grp: str, pos: str) -> str:
    """CTEs name1, name2, ... over name0(..., proof, own): siblings added and the leaf folded, level by level."""
    at = lambda k: f"(64 * ({pos} // {16 ** (k - 1)} % 16))::INTEGER"
    return ",\n".join(
        f"{name}{k} AS (SELECT p.* EXCLUDE (proof, own), CASE WHEN over THEN proof ELSE proof || left(hs, {at(k)}) || substr(hs, {at(k)} + 65) END AS proof,"
        f" CASE WHEN over THEN own ELSE sha256(left(hs, {at(k)}) || own || substr(hs, {at(k)} + 65)) END AS own"
        f" FROM {name}{k - 1} p JOIN {tree}{k} t ON t.grp = {grp} AND t.pos = {pos} // {16**k})"
        for k in range(1, levels + 1))


def _leaf_sql(text: str) -> str:
    fields = (f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(fields)})"


#: Five levels of leaves (a million a source) and three of sources (4096).
OP13_SQL = f"""
WITH d AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 0
             THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other FROM documents),
l AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS grp, {_leaf_sql("text")} AS leaf, {_leaf_sql("other")} AS own FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, own) - 1 AS pos FROM l),
a0 AS (SELECT grp, pos, leaf AS h, count(*) OVER (PARTITION BY grp) - 1 AS last FROM p),
{_climbed_sql("a", 5)},
b0 AS (SELECT '' AS grp, grp AS source, row_number() OVER (ORDER BY grp) - 1 AS pos, h, count(*) OVER () - 1 AS last FROM a5),
{_climbed_sql("b", 3)},
p0 AS (SELECT p.doc_id, leaf, own, '' AS proof, p.grp AS mine, p.pos AS place, b0.h AS subroot, b0.pos AS rank, b3.h AS root FROM p JOIN b0 ON b0.source = p.grp, b3),
{_proved_sql("p", "a", 5, "mine", "place")},
q0 AS (SELECT * FROM p5),
{_proved_sql("q", "b", 3, "''", "rank")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified FROM q3
"""
