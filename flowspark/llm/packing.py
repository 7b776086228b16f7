"""Best-fit packing by linear grouping.

Documents become token pieces of at most CAPACITY; only their lengths' histogram (at most
CAPACITY numbers, whatever the corpus) reaches the driver. Lengths over CAPACITY / SMALL_PART
are sorted and divided into GROUPS groups of equal cardinality, each rounded up to its largest
length. Over those few sizes, configurations are optimised one after the other: the one that
holds the largest size left and fills a sequence best, found by dynamic programming over all
sub-multisets (or, as the other choice, by taking the largest size that fits, again and again),
is used as often as the sizes last; of the GROUPS and choices tried, the plan of fewest sequences
stays. Then actual pieces take the places of the
rounded ones, which leaves room, and small pieces go best-fit, longest first, into what is left.
The plan is a table of (length, rank) ranges; pieces get their rank within their length in a
distributed way and look up their sequence. No piece or document is ever on the driver.

Null and empty texts are one piece that holds only the end token. Repeated rows are packed each
on its own. Pieces of equal length are ranked by document id (null first), piece and checksum;
rows equal in all of that can change places without a difference. Empty tables give empty results.
Columns other than doc_id and text are not read; helper columns start with `pk_`.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import map_rows, read_table, written
from .tokens import Encoder

CAPACITY = 2048
SMALL_PART = 8
#: Numbers of groups to try; more round less, fewer leave simpler sizes to combine.
GROUPS = (64, 256, 2048)
END_ID = 0
#: Buckets that share the rows of one length when they are ranked.
BUCKETS = 256

_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece. A document longer than
    the capacity is cut into full pieces, the first taking the remainder."""
    tokenizer = tokenizer or default_tokenizer()

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for i, ids in zip(cols["doc_id"], _encoder(tokenizer).encode([t or "" for t in cols["text"]]), strict=True):
            ids = np.append(ids, END_ID).astype("<u4")
            cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                out["doc_id"].append(i)
                out["piece"].append(k)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                out["ids"].append(ids[a:b] if with_ids else None)
        return out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


class Plan:
    """For each length, ranges of ranks and the sequences that they go to: rank r of a range goes
    to sequence + (r - rank + shift) // per."""

    def __init__(self) -> None:
        self.ranges: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        self.n_sequences = 0

    def add(self, length: int, rank: int, sequence: int, shift: int, per: int) -> None:
        self.ranges[length].append((rank, sequence, shift, per))

    def arrays(self) -> dict[int, np.ndarray]:
        return {n: np.array(sorted(r), np.int64) for n, r in self.ranges.items()}


def lookup(arrays: dict[int, np.ndarray], lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    out = np.full(len(lengths), -1, np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        table = arrays[int(n)]
        row = table[np.searchsorted(table[:, 0], ranks[at], side="right") - 1]
        out[at] = row[:, 1] + (ranks[at] - row[:, 0] + row[:, 2]) // row[:, 3]
    return out


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The best plan for `counts` pieces of each length."""
    tried = [(g, choice) for choice in (_greedy, _fullest) for g in GROUPS]
    return min((_solve(counts, capacity, *t) for t in tried), key=lambda plan: plan.n_sequences)


def _solve(counts: dict[int, int], capacity: int, groups: int, choice) -> Plan:
    plan = Plan()
    full = counts.get(capacity, 0)
    if full:
        plan.add(capacity, 0, 0, 0, 1)
    plan.n_sequences = full
    small = capacity // SMALL_PART
    large = sorted(((n, c) for n, c in counts.items() if small < n < capacity and c), reverse=True)
    room = _large(plan, large, capacity, groups, choice)
    _best_fit(plan, sorted(((n, c) for n, c in counts.items() if n <= small and c), reverse=True), room, capacity)
    return plan


def _large(plan: Plan, large: list[tuple[int, int]], capacity: int, groups: int, choice) -> list[tuple[int, int, int]]:
    """Places the large pieces; returns (room, first sequence, number of sequences) of what is left."""
    n = sum(c for _, c in large)
    if not n:
        return []
    # Order index of pieces, longest first: `edges` are where lengths change, `bounds` where groups do.
    edges = np.concatenate([[0], np.cumsum([c for _, c in large])]).astype(np.int64)
    lengths = np.array([k for k, _ in large], np.int64)
    if len(large) <= groups:
        bounds = edges
    else:
        bounds = np.unique(np.minimum(n, np.arange(groups + 1, dtype=np.int64) * -(-n // groups)))
    of = lambda i: int(lengths[np.searchsorted(edges, i, side="right") - 1])
    sizes = [of(b) for b in bounds[:-1]]
    left = np.diff(bounds).tolist()
    used = [int(b) for b in bounds[:-1]]
    room: list[tuple[int, int, int]] = []
    first = 0
    while True:
        while first < len(left) and not left[first]:
            first += 1
        if first == len(left):
            return room
        config = choice(sizes, left, first, capacity)
        times = min(left[g] // a for g, a in config.items())
        cuts = {0, times}
        for g, a in config.items():
            base = used[g]
            lo, hi = np.searchsorted(edges, base, side="right") - 1, np.searchsorted(edges, base + times * a, side="left")
            for j in range(lo, hi):
                start = max(int(edges[j]), base)
                plan.add(int(lengths[j]), start - int(edges[j]), plan.n_sequences + (start - base) // a, (start - base) % a, a)
                if start > base:  # the sequence in which this length begins may hold two lengths
                    cuts |= {(start - base) // a, min(times, (start - base) // a + 1)}
        marks = sorted(cuts)
        for b, e in zip(marks[:-1], marks[1:], strict=True):
            taken = sum(of(used[g] + b * a + k) for g, a in config.items() for k in range(a))
            room.append((capacity - taken, plan.n_sequences + b, e - b))
        for g, a in config.items():
            used[g] += times * a
            left[g] -= times * a
        plan.n_sequences += times


def _greedy(sizes: list[int], left: list[int], first: int, capacity: int) -> dict[int, int]:
    """{group: pieces}: from group `first` on, as many of each size as still fit."""
    config = {}
    for g in range(first, len(sizes)):
        if k := min(left[g], capacity // sizes[g]):
            config[g] = k
            capacity -= k * sizes[g]
    return config


def _fullest(sizes: list[int], left: list[int], first: int, capacity: int) -> dict[int, int]:
    """{group: pieces} of the fullest sequence that holds a piece of group `first`. Sets of sums
    are bits of an integer; the larger sizes are preferred among equally full ones."""
    cap = capacity - sizes[first]
    config = {first: 1}
    mask = (1 << (cap + 1)) - 1
    reach, steps = 1, []
    for g in range(len(sizes) - 1, first - 1, -1):
        s, c = sizes[g], left[g] - (g == first)
        if s > cap:
            break
        if not c:
            continue
        before = reach
        for _ in range(min(c, cap // s)):
            more = (reach | (reach << s)) & mask
            if more == reach:
                break
            reach = more
        steps.append((g, s, min(c, cap // s), before))
        if reach >> cap & 1:
            break
    at = reach.bit_length() - 1
    for g, s, most, before in reversed(steps):
        k = next(k for k in range(most, -1, -1) if at >= k * s and before >> (at - k * s) & 1)
        if k:
            config[g] = config.get(g, 0) + k
            at -= k * s
    return config


def _best_fit(plan: Plan, small: list[tuple[int, int]], room: list[tuple[int, int, int]], capacity: int) -> None:
    """Small pieces, longest first, each into the fullest sequence that still takes it; runs of
    equal sequences and of equal pieces are handled at once."""
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    order: list[int] = []

    def put(space: int, start: int, n: int) -> None:
        if n and space:
            if space not in runs:
                insort(order, space)
            runs[space].append((start, n))

    for space, start, n in room:
        put(space, start, n)
    for length, count in small:
        rank = 0
        while rank < count:
            at = bisect_left(order, length)
            if at == len(order):
                put(capacity, plan.n_sequences, -(-(count - rank) // (capacity // length)))
                plan.n_sequences += -(-(count - rank) // (capacity // length))
                continue
            space = order[at]
            start, n = runs[space].pop()
            if not runs[space]:
                del runs[space]
                order.pop(at)
            per = space // length
            take = min(count - rank, n * per)
            plan.add(length, rank, start, 0, per)
            whole, rest = divmod(take, per)
            put(space - per * length, start, whole)
            if rest:
                put(space - rest * length, start + whole, 1)
            put(space, start + whole + (rest > 0), n - whole - (rest > 0))
            rank += take


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (a written table of pieces) with sequence_id and offset."""
    spark = parts.sparkSession
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = solve(counts, capacity)
    arrays = spark.sparkContext.broadcast(plan.arrays())
    # One length may hold a third of all rows: rank = rows in earlier buckets + rank in the bucket.
    rows = parts.withColumn("pk_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    per = rows.groupBy("length", "pk_bucket").agg(F.count("*").alias("pk_n"))
    earlier = Window.partitionBy("length").orderBy("pk_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "pk_bucket", F.coalesce(F.sum("pk_n").over(earlier), F.lit(0)).alias("pk_before"))
    inside = Window.partitionBy("length", "pk_bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    rows = rows.withColumn("pk_rank", F.row_number().over(inside)).join(per, ["length", "pk_bucket"])

    @F.pandas_udf("long")
    def sequence(length: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(lookup(arrays.value, length.to_numpy(np.int64), rank.to_numpy(np.int64)))

    rows = rows.withColumn("sequence_id", sequence("length", F.col("pk_before") + F.col("pk_rank") - 1))
    within = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long")).drop("pk_bucket", "pk_rank", "pk_before")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(written(pieces(read_table(spark, sf_dir, "documents")), "pack-pieces"))
