"""Rule bitmask ledger: every rule is evaluated once per document, its outcome kept as one bit.

`ledger` holds the measurements and `fail_bits`. Policies (a name, a version and a mask of
rules) are applied to the ledger later, without touching a text again, and `ablation` computes
by bitwise aggregation what each rule of a policy decides alone.

Null and empty texts measure 0 everywhere and fail `few_words`. Rows are independent of each
other: repeated rows get the same verdict, row order does not matter, and an empty table gives
an empty ledger. Only `doc_id` and `text` are read; other columns pass `filter_documents`
whatever their names, as a whole row and its ledger are one struct each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_rows, read_table, written

#: Measurements, in the order of `measure`.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
)
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5

#: Rule i fails a document where its condition over the measurements holds; bit i of fail_bits.
#: Conditions use only what SQL and Python write alike.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars > 100 * n_words or 2 * word_chars < 3 * n_words"),
    ("shouting", "2 * n_upper > word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """Documents that fail a rule of `rules` are rejected."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, (name, _) in enumerate(RULES) if name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(name for name, _ in RULES))


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text; words are runs of non-white-space (ASCII white space)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0, 0)
    word_chars = len((text or "").translate(_DROP_SPACES)) if not raw.isascii() else sum(map(len, words))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    n_upper = len(raw) - len(raw.translate(None, _UPPER))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (n, word_chars, n_symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines), n_upper)


_DROP_SPACES = dict.fromkeys(SPACES)
_UPPER = bytes(range(65, 91))


def repeat_words(words: list[bytes]) -> int:
    """Words inside WINDOW-word windows that occur at least twice, the first occurrence included."""
    n = len(words)
    m = n - WINDOW + 1
    if m < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    # Windows get exact ids by pairing ids step by step: no hash, no collision.
    key = w[:m]
    for i in range(1, WINDOW):
        _, key = np.unique(key * len(ids) + w[i : i + m], return_inverse=True)
    hit = np.bincount(key)[key] > 1
    if not hit.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measured(texts: Column | str, df: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and the measurements of column `texts`."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    schema = ", ".join([f"`{k}` {fields[k].simpleString()}" for k in keep] + [f"{m} long" for m in MEASURES])

    def run(cols: dict[str, list]) -> dict[str, list]:
        got = [measure(x) for x in cols["__text"]]
        out = {k: cols[k] for k in keep}
        return out | {m: [g[i] for g in got] for i, m in enumerate(MEASURES)}

    return map_rows(df.select(*keep, F.col(texts).alias("__text") if isinstance(texts, str) else texts.alias("__text")), run, schema)


def fail_bits() -> Column:
    """The ledger's bit set, from measurement columns."""
    bits = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits: one row per row of docs."""
    return measured("text", docs, ["doc_id"]).withColumn("fail_bits", fail_bits())


def verdict(policy: Policy, bits: str | Column = "fail_bits") -> Column:
    """Whether a document stays under the policy."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents failing it, rejected by it alone, and kept without it.

    One pass over the ledger; only counts are shuffled.
    """
    mask = policy.mask
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    named = [(i, name) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    sums = [F.count(F.lit(1)).alias("n_docs"), F.count_if(hit == 0).alias("n_kept")]
    for i, name in named:
        sums += [
            F.count_if(hit.bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias(f"{name}_fail"),
            F.count_if(hit == (1 << i)).alias(f"{name}_alone"),
        ]
    one = rows.agg(*sums)
    made = F.array(*(
        F.struct(
            F.lit(name).alias("rule"),
            F.col(f"{name}_fail").alias("n_fail"),
            F.col(f"{name}_alone").alias("n_alone"),
            (F.col("n_kept") + F.col(f"{name}_alone")).alias("n_kept_without"),
        )
        for _, name in named
    ))
    return one.select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"),
                      "n_docs", "n_kept", F.explode(made).alias("r")).select("policy", "version", "n_docs", "n_kept", "r.*")


def ledgered(docs: DataFrame) -> DataFrame:
    """`row`, the whole row of docs, and `ledger`, its measurements and fail_bits."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    at = docs.columns.index("text")
    kinds = pa.struct([(m, pa.int64()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                row = whole.slice(start, 512).column(0)
                got = [dict(zip(MEASURES, measure(t.as_py()), strict=True)) for t in row.field(at)]
                yield pa.RecordBatch.from_arrays([row, pa.array(got, kinds)], ["row", "m"])

    schema = T.StructType([rows.schema["row"], T.StructField("m", T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))])
    made = rows.mapInArrow(run, schema).select("row", "m.*")
    return made.select("row", F.struct(*MEASURES, fail_bits().alias("fail_bits")).alias("ledger"))


def filter_documents(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The rows of docs that the policy keeps, all columns unchanged. The ledger is written beside
    its rows in the shared folder and stays there for other policies (`row`, `ledger`)."""
    book = written(ledgered(docs), "quality-ledger")
    return book.where(verdict(policy, F.col("ledger.fail_bits"))).select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict(BASE)).alias("base_failed"), verdict(STANDARD).alias("kept"),
        "fail_bits", F.lit(f"{STANDARD.name}-{STANDARD.version}").alias("policy"),
    )


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, concat_ws(' ', ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]) AS k
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1),
c AS (SELECT r, count(DISTINCT i + o) AS n FROM h, (SELECT unnest(range(0, 5)) AS o) GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
      FROM w LEFT JOIN c ON w.r = c.r),
b AS (SELECT *, CAST(
        CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 100 * n_words OR 2 * word_chars < 3 * n_words THEN 16 ELSE 0 END
        + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, fail_bits = 0 AS kept, fail_bits, 'standard-1' AS policy
FROM b
"""
