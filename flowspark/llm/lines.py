"""Line dedup with levelled sorted runs of line hashes.

Every line of at least `least` code points (after stripping and ASCII lower-casing) becomes a
128-bit key. Documents come in batches of descending id. A batch merge-anti-joins the runs
(only its keys that the runs already hold in `min_docs` documents are settled and add nothing: of
others the number of documents is still needed) and adds the rest as a run of its own: (key, number of documents, largest id), sorted by key. When
a level has FANOUT runs, they are compacted into one run of the next level. In the end the runs
name, for each key of at least `min_docs` documents, the largest document that holds it, which
alone keeps its lines.

A null or empty text is one empty line. Rows that share a doc_id are one document: a key counts
once, and all of the document's rows keep or lose it together; a null id is smaller than any
other. Each row is sent its own keys only, by id and a hash of its text. Repeated lines within the keeping document all stay. Empty tables give empty results.
Columns besides doc_id and text pass through `dedup` unchanged, whatever their names: the row of a
document is one struct on the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ._common import ASCII_LOWER, map_rows, new_path, partitions, read_table, remove, written

BATCHES = 4
FANOUT = 2
MIN_DOCS = 3
LEAST = 20
NO_ID = -(2**63)


def key_of(line: bytes, least: int) -> bytes | None:
    """The line's 128-bit key, null for a line of fewer than `least` code points."""
    key = line.strip()
    if len(key) < least or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < least):
        return None
    return xxhash.xxh3_128_digest(key.translate(ASCII_LOWER))


def line_keys(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """ld_key, ld_doc, ld_text: the distinct keys of each row's text."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        keys, ids, hashes = [], [], []
        for i, h, text in zip(cols["ld_doc"], cols["ld_text"], cols["text"], strict=True):
            found = {k for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if (k := key_of(x, least))}
            keys += found
            ids += [i] * len(found)
            hashes += [h] * len(found)
        return {"ld_key": keys, "ld_doc": ids, "ld_text": hashes}

    return map_rows(docs.select(*row_of(), "text"), run, "ld_key binary, ld_doc long, ld_text long")


def row_of() -> list[Column]:
    """A row's document and the hash of its text; rows that have both in common lose the same lines."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ld_doc"), F.xxhash64("text").alias("ld_text")]


class Runs:
    """Levels of sorted runs (ld_key, ld_n, ld_last), each a table in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame) -> str:
        """A run sorted by key: rows arrive hash-partitioned by key from the aggregation."""
        path = new_path(self.spark, "line-run")
        df.sortWithinPartitions("ld_key").write.parquet(path)
        return path

    def rows(self) -> DataFrame | None:
        """All runs merged: one row per key."""
        paths = [p for level in self.levels for p in level]
        return self._merged(paths) if paths else None

    def _merged(self, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema("ld_key binary, ld_n long, ld_last long").parquet(*paths)
        return rows if len(paths) == 1 else rows.groupBy("ld_key").agg(F.sum("ld_n").alias("ld_n"), F.max("ld_last").alias("ld_last"))

    def add(self, keys: DataFrame, min_docs: int) -> None:
        """One batch of (ld_key, ld_doc), all ids smaller than those of the batches before."""
        fresh = keys.groupBy("ld_key").agg(F.count_distinct("ld_doc").alias("ld_n"), F.max("ld_doc").alias("ld_last"))
        known = self.rows()
        if known is not None:
            settled = known.where(F.col("ld_n") >= min_docs).select("ld_key")
            fresh = fresh.join(settled.hint("merge"), "ld_key", "left_anti")
        self._place(0, self._write(fresh))

    def _place(self, level: int, path: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(old))
            remove(self.spark, *old)
            self._place(level + 1, merged)


def drops(docs: DataFrame, batches: int = BATCHES, min_docs: int = MIN_DOCS, least: int = LEAST) -> DataFrame:
    """ld_doc, ld_text, ld_keys: the keys whose lines a row loses."""
    spark = docs.sparkSession
    keys = line_keys(docs, least)
    # Bounds between batches come from a sketch of the ids; batches are contiguous and descend.
    cuts = F.percentile_approx(F.col("doc_id").cast("double"), [k / batches for k in range(1, batches + 1)], 1000)
    bounds = sorted(set((docs.agg(cuts).first()[0] or [])[: batches - 1]), reverse=True)
    batch = F.lit(0)
    for b in bounds:
        batch = batch + (F.col("ld_doc").cast("double") < b).cast("int")
    path = new_path(spark, "line-keys")
    keys.withColumn("ld_batch", batch).write.partitionBy("ld_batch").parquet(path)
    schema = "ld_key binary, ld_doc long, ld_text long, ld_batch int"
    keys = spark.read.schema(schema).parquet(path)
    runs = Runs(spark)
    for k in range(len(bounds) + 1):
        runs.add(keys.where(F.col("ld_batch") == k).select("ld_key", "ld_doc"), min_docs)
    heavy = runs.rows().where(F.col("ld_n") >= min_docs).select("ld_key", "ld_last")
    lost = keys.join(heavy, "ld_key").where("ld_doc <> ld_last")
    out = written(lost.groupBy("ld_doc", "ld_text").agg(F.collect_set("ld_key").alias("ld_keys")), "line-drops")
    remove(spark, path, *(p for level in runs.levels for p in level))
    return out


def kept_lines(text: str | None, lost: list[bytes] | None, least: int) -> tuple[int, list[bytes]]:
    """The number of lines, and those that stay."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    if not lost:
        return len(lines), lines
    gone = set(lost)
    return len(lines), [x for x in lines if key_of(x, least) not in gone]


def _with_drops(docs: DataFrame, **options) -> DataFrame:
    """ld_row, the whole row of docs, and ld_keys, the keys that it loses."""
    lost = drops(docs, **options)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("ld_row")
    return docs.select(whole, *row_of()).join(lost, ["ld_doc", "ld_text"], "left").drop("ld_doc", "ld_text")


def dedup(docs: DataFrame, least: int = LEAST, **options) -> DataFrame:
    """docs with the lost lines taken out of `text` (a null text stays null); n_chars, where
    there is such a column, follows the text."""
    names = docs.columns
    counted = "n_chars" in names and dict(docs.dtypes)["n_chars"] in ("bigint", "int")
    schema = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                cols = dict(zip(names, b.column(0).flatten(), strict=True))
                texts, lost = cols["text"].to_pylist(), b.column(1).to_pylist()
                new = [b"\n".join(kept_lines(t, g, least)[1]).decode("utf-8", "surrogatepass") if g else t for t, g in zip(texts, lost, strict=True)]
                cols["text"] = pa.array(new, schema.field("text").type)
                if counted:
                    n = cols["n_chars"].to_pylist()
                    cols["n_chars"] = pa.array([len(t) if g else v for t, g, v in zip(new, lost, n, strict=True)], schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], schema=schema)

    return _with_drops(docs, least=least, **options).mapInArrow(run, docs.schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(cols: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": cols["doc_id"], "n_lines": [], "n_dropped": [], "kept_sha256": []}
        for text, lost in zip(cols["text"], cols["ld_keys"], strict=True):
            n, kept = kept_lines(text, lost, LEAST)
            out["n_lines"].append(n)
            out["n_dropped"].append(n - len(kept))
            out["kept_sha256"].append(hashlib.sha256(b"\n".join(kept)).hexdigest())
        return out

    return map_rows(_with_drops(docs).select("ld_row.*", "ld_keys"), run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
h AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
x AS (SELECT k.r, k.doc_id, line, i, h.last IS NOT NULL AND h.last <> k.doc_id AS gone FROM k LEFT JOIN h ON k.k = h.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY r, doc_id
"""
