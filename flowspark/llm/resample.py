"""Importance resampling of documents towards the word n-grams of a target set.

Every n-gram up to MAX_N words falls into one of BUCKETS buckets. The log ratio of a bucket's share
in the target to its share in the corpus is its gain, a document's weight is the mean gain of its
n-grams, and noise drawn from its id turns the highest scores into a sample without replacement.

The n-grams of a partition are enumerated by a suffix array over word ids: suffixes of the words of
many texts, ordered to a depth of MAX_N words by prefix doubling. Neighbours that agree on n words
or more form a run, which is one distinct n-gram; it is hashed once, and its bucket is scattered
to the places where its suffixes start. The buckets of every text are written once, as two bytes an
n-gram; counts of the corpus and weights of documents are then sums over them, without the texts.

What reaches the driver is BUCKETS counts for each side and the histogram of scores, which are whole
numbers within the logarithms of 64-bit counts: RANGE bounds it. The drawn documents alone are
range-sorted and numbered.

Nulls: a null text has no words; a null id draws its noise from `null` and is the smallest id. Texts
count whole: those of over CHUNK words are taken in overlapping pieces. Documents without words have
weight 0. Rows that share an id share its noise, each with its own weight; rows that agree in all of
this are numbered one after the other. No documents give no rows; without any target text the
target's shares are even. Other columns of the tables take no part, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ASCII_LOWER, Tables, crc32_sql, read_table

BUCKETS = 10_000
MAX_N = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Words of one suffix array, and bytes of text split at a time.
CHUNK = 1 << 20
PIECE = 1 << 22
#: Scores lie within this distance of 0: 1000 times the logarithms of a 64-bit count and of the noise.
RANGE = 1 << 17

#: Bytes that are no part of a word become a space: white space, controls and ASCII signs.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_SPACED = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def word_pieces(text: str | None, overlap: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in pieces, each with the last `overlap` words before it, and their number."""
    rest, before = (text or "").encode().translate(ASCII_LOWER).translate(_SPACED), []
    at = 0
    while at < len(rest):
        end = rest.find(b" ", at + PIECE) if at + PIECE < len(rest) else -1
        words = rest[at : end if end >= 0 else None].split()
        at = end if end >= 0 else len(rest)
        for i in range(0, len(words), CHUNK):
            part = words[i : i + CHUNK]
            yield before + part, len(before)
            before = (before + part)[-overlap:] if overlap else []


def suffix_order(ids: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the words that follow, up to `depth` of them; ends: where each place's
    text ends. Equal ones stay in the order of places."""
    place, rank, known = np.arange(len(ids)), ids, 1
    while True:
        after = place + known
        follows = np.where(after < ends, rank[np.minimum(after, len(ids) - 1)] + 1, 0) if known < depth else np.zeros(len(ids), np.int64)
        key = rank * (int(rank.max()) + 2) + follows
        order = np.argsort(key, kind="stable")
        if known * 2 >= depth:
            return order
        rank, known = np.empty(len(ids), np.int64), known * 2
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])


def common_words(ids: np.ndarray, ends: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many words, up to `depth`, each suffix in order shares with the one before it."""
    lcp = np.zeros(len(order), np.int64)
    alive = np.ones(len(order), bool)
    alive[:1] = False
    prev, here = np.roll(order, 1), order
    for j in range(depth):
        inside = alive & (prev + j < ends[prev]) & (here + j < ends[here])
        alive = np.zeros(len(order), bool)
        alive[inside] = ids[prev[inside] + j] == ids[here[inside] + j]
        lcp[alive] = j + 1
    return lcp


def ngram_buckets(parts: list[tuple[list[bytes], int]], max_n: int, buckets: int) -> list[np.ndarray]:
    """For each list of words the buckets of its n-grams of 1 to max_n words; those within the given
    number of first words are left out, as an earlier piece has them."""
    words = [w for part, _ in parts for w in part]
    if not words:
        return [np.zeros(0, np.uint16) for _ in parts]
    sizes = np.array([len(part) for part, _ in parts])
    bounds = np.cumsum(sizes)
    ends = np.repeat(bounds, sizes)
    fresh = np.repeat(bounds - sizes + np.array([n for _, n in parts]), sizes)
    number = {w: i for i, w in enumerate(sorted(set(words)))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    order = suffix_order(ids, ends, max_n)
    lcp = common_words(ids, ends, order, max_n)
    places, found = [], []
    for n in range(1, max_n + 1):
        whole = order + n <= ends[order]
        run = np.cumsum(lcp < n)  # shorter suffixes are runs of their own
        run, at = run[whole], order[whole]
        first = np.flatnonzero(np.diff(run, prepend=-1))
        hashed = np.fromiter((zlib.crc32(b" ".join(words[i : i + n])) % buckets for i in at[first].tolist()), np.int64, len(first))
        new = at + n > fresh[at]
        places.append(at[new])
        found.append(np.repeat(hashed, np.diff(first, append=len(at)))[new])
    at, of = np.concatenate(places), np.concatenate(found).astype(np.uint16)
    text = np.searchsorted(bounds, at, side="right")
    by_text = np.argsort(text, kind="stable")
    return np.split(of[by_text], np.cumsum(np.bincount(text, minlength=len(parts)))[:-1])


def bucketed(texts: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_features and the buckets of all n-grams, two bytes each."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket's number has two bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n_words, whole = batch.column(0), [0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            waiting: list[tuple[int, list[bytes], int]] = []
            size = 0

            def flush() -> None:
                made = ngram_buckets([(w, n) for _, w, n in waiting], max_n, buckets)
                for (i, _, _), part in zip(waiting, made, strict=True):
                    whole[i].append(part.astype("<u2").tobytes())
                waiting.clear()

            for i, text in enumerate(batch.column(1)):
                for words, n_before in word_pieces(text.as_py(), max_n - 1):
                    if size + len(words) > CHUNK:
                        flush()
                        size = 0
                    waiting.append((i, words, n_before))
                    size += len(words)
                    n_words[i] += len(words) - n_before
            flush()
            joined = [b"".join(x) for x in whole]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array([len(x) // 2 for x in joined], pa.int64()), pa.array(joined, pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows: a row for each bucket and task, summed by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    n, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    pairs = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in pairs], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and the mean gain of the n-grams, rounded down."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(x.as_buffer(), "<u2")].sum()) for x in batch.column(3)]
            weight = [s // n if n else 0 for s, n in zip(sums, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, drawn from the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """Every row's doc_id, n_words, n_features, weight, score and rank: 1, 2, ... for the `percent` of the
    rows with `least_words` that have the highest scores, null for the others."""
    tables = Tables(docs.sparkSession)
    wanted = bucket_counts(bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), max_n, buckets), buckets)
    features = tables.put("resample-buckets", bucketed(docs.select("doc_id", "text"), max_n, buckets))
    scored = weighed(features, gains(bucket_counts(features, buckets), wanted))
    scored = tables.put("resample-scores", scored.withColumn("score", F.col("weight") + noise(seed)))
    tables.drop("resample-buckets")
    counts = dict(scored.where(F.col("n_words") >= least_words).groupBy("score").count().collect())
    drawn = percent * sum(counts.values()) // 100
    least, above = RANGE, 0  # the lowest score drawn, and how many rows have more
    for score in sorted(counts, reverse=True):
        if above >= drawn:
            break
        least, above = score, above + counts[score]
    is_open = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    return _numbered(scored.where(is_open), tables, drawn).unionByName(scored.where(~is_open).withColumn("rank", F.lit(None).cast("long")))


def _numbered(rows: DataFrame, tables: Tables, drawn: int) -> DataFrame:
    """rows with their rank by falling score and id, null beyond `drawn`; sorted by range, so that every
    partition needs only the number of rows before it."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.col("weight"), F.col("n_features")]
    placed = tables.put("resample-drawn", rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()))
    sizes = dict(placed.groupBy(F.shiftright("place", 33).alias("part")).count().collect())
    parts = sorted(sizes)
    before = dict(zip(parts, np.cumsum([0, *(sizes[p] for p in parts)]).tolist()))
    shift = placed.sparkSession.createDataFrame([(p, before[p]) for p in parts], "part int, before long")
    place = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = placed.withColumn("part", F.shiftright("place", 33).cast("int")).join(F.broadcast(shift), "part")
    return placed.withColumn("rank", F.when(place <= drawn, place)).drop("part", "before", "place")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
u AS (SELECT f, {crc32_sql("f")} % 10000 AS k FROM (SELECT f FROM df UNION SELECT f FROM bf)),
s AS (SELECT k, count(*) AS n FROM df JOIN u USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM bf JOIN u USING (f) GROUP BY k),
g AS (SELECT s.k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.k = t.k),
w AS (SELECT r, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM df JOIN u USING (f) JOIN g USING (k) GROUP BY r),
c AS (SELECT r, doc_id, len(w) AS n_words, CAST(('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) AS h FROM d),
x AS (SELECT c.*, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM c LEFT JOIN w USING (r)),
y AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS place, count(*) OVER (PARTITION BY n_words >= {LEAST_WORDS}) AS n FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM y
"""
