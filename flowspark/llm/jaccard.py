"""N-gram Jaccard self-join with PartEnum signatures.

A document is the set of its distinct word n-grams. Sizes are divided into bands; two sets with
a Jaccard similarity of at least `num / den` meet in the band of the larger one, where at most k
of their members can differ. Each band partitions the domain of n-grams into n1 parts of n2
cells. If at most k members differ, some parts differ in at most k2 of them, and so agree on all
but k2 cells: the projections on every choice of n2 - k2 cells of a part are the set's
signatures, and similar sets share at least one. That is exact: no similar pair is missed.

An empty projection says nothing and would be shared by everyone. So n1 has `slack` parts to
spare, and a set with at most `slack` hollow parts (with an empty projection) leaves these
signatures out: of at least slack + 1 parts on which a similar pair agrees, one is not hollow.
Sets with more hollow parts emit the empty projections, too.

Equal sets are one node, so a group of copies costs one node however large it is: a task emits a
node once. Within the rows of one signature every node is paired with one pivot only; verified
links are contracted to components, and only signatures whose nodes are still in different
components go on: a round with pivots of many links, then the remaining pairs across components.
All links between different components are thereby found, without listing pairs inside a group.

Before a set travels, a pair has to pass its sketches: the domain in some 1.2 n cells, one byte of
an additive hash each. Every cell that differs holds a member in which the sets differ, so more
unequal cells than the threshold allows rule a pair out; equal bytes by chance only let it pass.
Sets that share no more than a passage fail here. In the last round the sketches of one signature
are compared in blocks of bounded size, and only pairs that pass are ever rows.

Null and empty texts have empty sets and are linked with nothing; fewer than n words are one
n-gram. Every row is a document of its own, even if rows share an id; equal rows are equal sets.
A component's id is its smallest doc_id, null only if it has no other. Empty tables give empty
results. `doc_id` and `text` are read; helper columns start with `nj_`, and `representatives`
returns docs' own columns. Sets are told apart by 64-bit hashes of n-grams and of sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from ._common import ASCII_LOWER, Tables, read_table, written

WORDS = 5
WORD = r"[^\x20\x09-\x0D]+"
NUM, DEN = 80, 100
#: Rows of one signature that are compared with as many others at a time.
BLOCK = 2048
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = []
    for b in (_BASE, _INVERSE):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        made.append(np.cumprod(x, dtype=np.uint64))
    return made[0], made[1]


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the text's n-grams of words."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER), np.uint8)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(1 << max(17, len(raw).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODE[raw] * power[: len(raw)], dtype=np.uint64)])
    words = mix((sums[ends] - sums[starts]) * inverse[starts])
    n = min(n, len(words))
    m = len(words) - n + 1
    key = np.full(m, n, np.uint64)
    for i in range(n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m]
    return np.unique(mix(key))


class Bands:
    """Size bands and the shape (n1, n2, k2, slack) of their signatures."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges, self.shapes = [1], []

    def _grow(self) -> None:
        e = self.edges[-1]
        end = max(e + 1, math.ceil(e * (1.25 if e < 64 else 1.5)))
        k = 2 * (end - 1) * (self.den - self.num) // (self.den + self.num)
        if k <= 4:
            n2, k2 = {0: (1, 0), 1: (3, 1), 2: (4, 2), 3: (6, 3), 4: (7, 4)}[k]
            shape = (1, n2, k2, 0)
        else:
            n1 = k // 2 + 1
            slack = 1 + n1 // 16
            shape = (n1 + slack, 3, 1, slack)
        self.shapes.append((k, *shape))
        self.edges.append(end)

    def of(self, n: int) -> range:
        """The bands in which a set of size n meets sets at least as large, and its own."""
        most = n * self.den // self.num
        while self.edges[-1] <= most:
            self._grow()
        return range(int(np.searchsorted(self.edges, n, side="right")) - 1, int(np.searchsorted(self.edges, most, side="right")))


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of a sorted set of n-gram hashes."""
    out = []
    for band in bands.of(len(s)):
        k, n1, n2, k2, slack = bands.shapes[band]
        if not k:
            continue  # only equal sets are similar here, and they are one node
        v = mix(s ^ np.uint64((band + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        cell = ((v >> np.uint64(32)) % np.uint64(n1 * n2)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        counts = np.bincount(cell, minlength=n1 * n2)
        sums = np.zeros(n1 * n2, np.uint64)
        filled = np.flatnonzero(counts)
        sums[filled] = np.add.reduceat(mix(v[order]), (np.cumsum(counts) - counts)[filled])
        sums, counts = sums.reshape(n1, n2), counts.reshape(n1, n2)
        part = np.arange(n1, dtype=np.uint64)
        cells = [mix(sums[:, t] + np.uint64(t + 1)) for t in range(n2)]
        made, full = [], []
        for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
            key = part * np.uint64(1024) + np.uint64(c + 1) + np.uint64(band) * np.uint64(1 << 40)
            for t in chosen:
                key = key * np.uint64(0x9E3779B97F4A7C15) + cells[t]
            made.append(mix(key))
            full.append(counts[:, list(chosen)].sum(1) > 0)
        made, full = np.stack(made), np.stack(full)
        hollow = int((~full).any(0).sum())
        out.append(made.ravel() if hollow > slack else made[full])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(s: np.ndarray, bands: Bands) -> bytes:
    """One byte for each of 2 ** p cells: the sum, mod 256, of a hash of its members. Neighbouring
    cells add up to the cells of a sketch half as long."""
    p = max(4, (10 * len(s) * (bands.den - bands.num) // (bands.den + bands.num)).bit_length())
    v = mix(s ^ np.uint64(0x2545F4914F6CDD1D))
    cell = (v >> np.uint64(64 - p)).astype(np.int64)
    return (np.bincount(cell, weights=(v & np.uint64(255)).astype(np.float64), minlength=1 << p).astype(np.int64) & 255).astype(np.uint8).tobytes()


def packed(x: bytes, bits: int) -> bytes:
    """The lowest `bits` (2 or 4) of every cell, which add up like the whole cells."""
    a = (np.frombuffer(x, np.uint8) & ((1 << bits) - 1)).reshape(-1, 8 // bits)
    return (a << np.arange(0, 8, bits, dtype=np.uint8)).sum(axis=1, dtype=np.uint64).astype(np.uint8).tobytes()


def unpacked(x: bytes, bits: int, size: int) -> np.ndarray:
    """`size` cells of a packed sketch."""
    low = (1 << bits) - 1
    a = (np.frombuffer(x, np.uint8)[:, None] >> np.arange(0, 8, bits, dtype=np.uint8)) & low
    return a.ravel() if a.size == size else a.reshape(size, -1).sum(axis=1, dtype=np.uint64).astype(np.uint8) & low


def _packed_nodes(nodes: DataFrame, bits: int) -> DataFrame:
    """nodes with sketches of `bits` a cell: fewer bits let more pairs pass by chance, never fewer."""

    @F.pandas_udf("binary")
    def shorter(x: pd.Series) -> pd.Series:
        return x.map(lambda v: packed(v, bits))

    return nodes.withColumn("nj_sketch", shorter("nj_sketch"))


def most_unequal(total: np.ndarray | int, num: int, den: int):
    """Members in which similar sets of `total` members together may differ."""
    return total * (den - num) // (den + num)


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit hash of the whole set."""
    x = xxhash.xxh3_64_intdigest(s.tobytes())
    return x - (1 << 64) if x >> 63 else x


def signed(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """nj_node, nj_sigs of every row with a set; a task emits a node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                node, sigs = [], []
                for text in whole.slice(at, 256).column(0):
                    s = shingles(text.as_py(), n)
                    if len(s) and (x := node_of(s)) not in seen:
                        seen.add(x)
                        node.append(x)
                        sigs.append(signatures(s, bands).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), _lists(sigs)], ["nj_node", "nj_sigs"])

    return docs.select("text").mapInArrow(run, "nj_node long, nj_sigs array<long>")


def sized(docs: DataFrame, met: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, nj_n (set size), nj_node (null for empty sets) of every row, and nj_sketch and nj_text
    (a hash of its text) for the nodes of `met` (a Bloom filter may add a few) where the task has not
    emitted it before."""
    level = docs.sparkSession.sparkContext.broadcast(bloom.of_longs(met, "nj_node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = [shingles(text.as_py(), n) for text in b.column(1)]
                node = [node_of(s) if len(s) else None for s in sets]
                held = bloom.holds_longs(level.value, np.array([x or 0 for x in node], np.int64))
                cells = []
                for s, x, h in zip(sets, node, held, strict=True):
                    fresh = h and x is not None and x not in seen
                    cells.append(sketch(s, bands) if fresh else None)
                    if fresh:
                        seen.add(x)
                size = pa.array(list(map(len, sets)), pa.int64())
                cells = pa.array(cells, pa.binary())
                text = pc.if_else(cells.is_valid(), b.column(2), None)
                yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(node, pa.int64()), cells, text], ["doc_id", "nj_n", "nj_node", "nj_sketch", "nj_text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("nj_text"))
    return rows.mapInArrow(run, "doc_id long, nj_n long, nj_node long, nj_sketch binary, nj_text long")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


#: Nodes of a signature that are held at once to see whether another signature has the same.
HELD = 1024


def buckets(sigs: DataFrame) -> DataFrame:
    """nj_bucket, nj_node of signatures that at least two nodes share. Rows arrive sorted, so a
    task holds up to HELD nodes of one signature; smaller signatures with equal nodes become
    one bucket, named by a hash of its nodes."""
    rows = sigs.select(F.explode("nj_sigs").alias("nj_sig"), "nj_node")
    rows = rows.repartition("nj_sig").sortWithinPartitions("nj_sig", "nj_node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[tuple[int, ...]] = set()
        sig, nodes, spilled = None, [], False
        out_b: list[int] = []
        out_n: list[int] = []

        def close() -> None:
            if spilled:
                out_b.extend([sig] * len(nodes))
                out_n.extend(nodes)
            elif len(nodes) > 1 and (key := tuple(nodes)) not in made:
                if len(made) < 100_000:
                    made.add(key)
                name = xxhash.xxh3_64_intdigest(np.array(nodes, np.int64).tobytes()) >> 1
                out_b.extend([name] * len(nodes))
                out_n.extend(nodes)

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array(out_n, pa.int64())], ["nj_bucket", "nj_node"])
            out_b.clear()
            out_n.clear()
            return b

        for b in batches:
            s, n = np.asarray(b.column(0)), np.asarray(b.column(1))
            if not len(s):
                continue
            # Most signatures have one row; only runs and the batch's edges are looked at.
            same = np.zeros(len(s), bool)
            same[1:] = s[1:] == s[:-1]
            same[:-1] |= s[1:] == s[:-1]
            same[[0, -1]] = True
            for x, y in zip(s[same].tolist(), n[same].tolist(), strict=True):
                if x != sig:
                    close()
                    sig, nodes, spilled = x, [], False
                if not nodes or nodes[-1] != y:
                    nodes.append(y)
                    if len(nodes) > HELD:
                        out_b.extend([sig] * (len(nodes) - 1))
                        out_n.extend(nodes[:-1])
                        nodes, spilled = nodes[-1:], True
            if len(out_b) > 50_000:
                yield flush()
        close()
        yield flush()

    return rows.mapInArrow(run, "nj_bucket long, nj_node long").distinct()


def needed_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """nj_node, nj_set of the given distinct nodes, made from the texts of their nj_text. A Bloom
    filter of bounded size keeps other documents from being split and shuffled; where it is too small
    for the nodes, more are."""
    level = docs.sparkSession.sparkContext.broadcast(bloom.of_longs(nodes, "nj_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            held = np.flatnonzero(bloom.holds_longs(level.value, whole.column(1).to_numpy()))
            for at in range(0, len(held), 256):
                sets, ids = [], []
                for i in held[at : at + 256].tolist():
                    s = shingles(whole.column(0)[i].as_py(), n)
                    if len(s) and (x := node_of(s)) not in seen:
                        sets.append(s.view(np.int64))
                        ids.append(x)
                        seen.add(x)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(sets)], ["nj_node", "nj_set"])

    found = docs.select("text", F.xxhash64("text").alias("nj_text")).mapInArrow(run, "nj_node long, nj_set array<long>")
    return found.groupBy("nj_node").agg(F.first("nj_set").alias("nj_set")).join(nodes, "nj_node", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (nj_a, nj_b) whose sets are similar: one set travels with each pair."""
    a = sets.select(F.col("nj_node").alias("nj_a"), F.col("nj_set").alias("nj_sa"))
    b = sets.select(F.col("nj_node").alias("nj_b"), F.col("nj_set").alias("nj_sb"))
    both = F.size(F.array_intersect("nj_sa", "nj_sb")).cast("long")
    joined = pairs.join(b, "nj_b").join(a, "nj_a").select("nj_a", "nj_b", both.alias("i"), (F.size("nj_sa") + F.size("nj_sb")).cast("long").alias("t"))
    return joined.where(F.col("i") * den >= (F.col("t") - F.col("i")) * num).select("nj_a", "nj_b")


def passing(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (nj_a, nj_b) whose sketches allow the similarity."""
    nodes = _packed_nodes(nodes, 2)
    side = lambda x: nodes.select(F.col("nj_node").alias(f"nj_{x}"), F.col("nj_n").alias(f"nj_n{x}"), F.col("nj_sketch").alias(f"nj_s{x}"))

    @F.pandas_udf("boolean")
    def allowed(a: pd.Series, b: pd.Series, total: pd.Series) -> pd.Series:
        out = [
            int((unpacked(x, 2, m := 4 * min(len(x), len(y))) != unpacked(y, 2, m)).sum()) <= most_unequal(int(t), num, den)
            for x, y, t in zip(a, b, total, strict=True)
        ]
        return pd.Series(out, dtype=bool)

    joined = pairs.join(side("b"), "nj_b").join(side("a"), "nj_a")
    return joined.where(allowed("nj_sa", "nj_sb", F.col("nj_na") + F.col("nj_nb"))).select("nj_a", "nj_b")


#: Parts in which the buckets' rows travel one after the other, so that the sketches on the way
#: are a part of all.
PASSES = 4


def crossing(open_: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (nj_a < nj_b) of one bucket, but of different components, that sizes and sketches
    allow. A bucket's rows are cut into blocks, and a task compares one pair of blocks. Rows of a
    bucket's largest component have blocks of their own, which meet the others' blocks only."""
    of = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    main = open_.groupBy("nj_bucket", "nj_comp").agg(F.count("*").alias("m")).groupBy("nj_bucket").agg(F.max(F.struct("m", "nj_comp")).alias("p"), F.sum("m").alias("n"))
    main = main.select("nj_bucket", F.col("p.nj_comp").alias("nj_main"), F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("p.m")) / BLOCK).cast("int")).alias("nj_others"), of("p.m").alias("nj_mains"))
    rows = open_.select("nj_bucket", "nj_node", "nj_comp").join(main, "nj_bucket").join(_packed_nodes(nodes, 4), "nj_node")
    # A small bucket is one block; in others the largest component's blocks come after the rest.
    small = (F.col("nj_others") == 1) & (F.col("nj_mains") == 1)
    place = F.xxhash64("nj_node")
    own = F.when(small, F.lit(0)).when(F.col("nj_comp") == F.col("nj_main"), F.col("nj_others") + F.pmod(place, F.col("nj_mains"))).otherwise(F.pmod(place, F.col("nj_others"))).cast("int")
    last = F.when(small, F.lit(0)).when(F.col("nj_own") < F.col("nj_others"), F.col("nj_others") + F.col("nj_mains") - 1).otherwise(F.col("nj_others") - 1)
    rows = rows.withColumn("nj_own", own).withColumn("nj_with", F.explode(F.sequence(F.lit(0), last)))
    ids = [F.col("nj_bucket"), F.least("nj_own", "nj_with").alias("nj_x"), F.greatest("nj_own", "nj_with").alias("nj_y")]
    rows = rows.select(*ids, "nj_own", "nj_node", "nj_comp", "nj_n", "nj_sketch")

    def compared(x: int, y: int, own, node, comp, n, raw) -> Iterator[tuple[int, np.ndarray]]:
        """Each row of block x with the rows of block y that it may be similar to."""
        m = 2 * min(map(len, raw))
        cells = np.stack([unpacked(r, 4, m) for r in raw])
        right = np.flatnonzero(own == y)
        right = right[np.argsort(n[right], kind="stable")]
        sizes, most = n[right], [-(-n * num // den), n * den // num + 1]
        for i in np.flatnonzero(own == x):
            lo, hi = np.searchsorted(sizes, [most[0][i], most[1][i]])
            j = right[lo:hi]
            j = j[(comp[j] != comp[i]) & ((node[j] > node[i]) if x == y else True)]
            if len(j):
                j = j[(cells[j] != cells[i]).sum(axis=1) <= most_unequal(n[j] + n[i], num, den)]
            if len(j):
                yield int(node[i]), node[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["nj_bucket", "nj_x", "nj_y", "nj_own", "nj_node", "nj_comp", "nj_n"]
        kept: list[pa.RecordBatch] = []  # rows of the group that goes on in the next batch

        def groups(t: pa.Table, end: int) -> pa.RecordBatch:
            c = {k: t[k].to_numpy() for k in names}
            edge = np.flatnonzero((c["nj_bucket"][1:end] != c["nj_bucket"][: end - 1]) | (c["nj_x"][1:end] != c["nj_x"][: end - 1]) | (c["nj_y"][1:end] != c["nj_y"][: end - 1])) + 1
            raw = t["nj_sketch"].to_pylist()
            got = []
            for a, b in zip([0, *edge], [*edge, end], strict=True):
                if b - a > 1:
                    got += compared(int(c["nj_x"][a]), int(c["nj_y"][a]), *(c[k][a:b] for k in names[3:]), raw[a:b])
            merged: dict[int, list[np.ndarray]] = {}
            for a, more in got:
                merged.setdefault(a, []).append(more)
            lists = [np.unique(np.concatenate(x)) for x in merged.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int64()), _lists(lists)], ["nj_a", "nj_more"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*kept, b]).combine_chunks()
            last = [t[k][-1].as_py() for k in names[:3]]
            same = np.logical_and.reduce([t[k].to_numpy() == v for k, v in zip(names[:3], last, strict=True)])
            end = int(np.argmax(same))  # rows are sorted, so the last group starts here
            if end:
                yield groups(t.slice(0, end), end)
            kept = t.slice(end).to_batches()
        if kept:
            t = pa.Table.from_batches(kept).combine_chunks()
            yield groups(t, t.num_rows)

    order = ["nj_bucket", "nj_x", "nj_y"]
    met = rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "nj_a long, nj_more array<long>")
    # The same two nodes meet in many buckets: a node's partners are united before they are rows.
    # A row has at most BLOCK partners of one bucket; a node's partners stay as many as pass.
    each = met.groupBy("nj_a").agg(F.array_distinct(F.flatten(F.collect_list("nj_more"))).alias("nj_more"))
    pairs = each.select("nj_a", F.explode("nj_more").alias("nj_b"))
    return pairs.select(F.least("nj_a", "nj_b").alias("nj_a"), F.greatest("nj_a", "nj_b").alias("nj_b")).distinct()


def contracted(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """nj_node, nj_comp of every linked node: its component's smallest node. Every round hooks
    each node to its smallest neighbour and halves the components' nodes at least; tables are
    written between rounds and replace those of the round before."""
    tables = tables or Tables(links.sparkSession)
    edges = tables.put("nj-edges", links.where("nj_a <> nj_b").select("nj_a", "nj_b").distinct())
    ends = edges.select(F.col("nj_a").alias("nj_node")).union(edges.select("nj_b")).distinct()
    comp = tables.put("nj-comp", ends.withColumn("nj_comp", F.col("nj_node")))
    while not edges.isEmpty():
        near = edges.union(edges.select("nj_b", "nj_a")).groupBy("nj_a").agg(F.min("nj_b").alias("nj_p"))
        up = tables.put("nj-near", near.select(F.col("nj_a").alias("nj_c"), F.least("nj_a", "nj_p").alias("nj_p")))
        for _ in range(2):  # parents of parents: chains get four times shorter
            over = up.select(F.col("nj_c").alias("nj_p"), F.col("nj_p").alias("nj_q"))
            up = up.join(over, "nj_p", "left").select("nj_c", F.coalesce("nj_q", "nj_p").alias("nj_p"))
        up = tables.put("nj-up", up)
        comp = tables.put("nj-comp", comp.join(up.withColumnRenamed("nj_c", "nj_comp"), "nj_comp", "left").select("nj_node", F.coalesce("nj_p", "nj_comp").alias("nj_comp")))
        a = up.select(F.col("nj_c").alias("nj_a"), F.col("nj_p").alias("nj_x"))
        b = up.select(F.col("nj_c").alias("nj_b"), F.col("nj_p").alias("nj_y"))
        edges = edges.join(a, "nj_a").join(b, "nj_b").where("nj_x <> nj_y").select(F.col("nj_x").alias("nj_a"), F.col("nj_y").alias("nj_b")).distinct()
        edges = tables.put("nj-edges", edges)
    tables.drop("nj-near", "nj-up", "nj-edges")
    return comp


def components(docs: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, nj_n, nj_node and nj_comp (the node's component, null where it has no links) of
    every row of docs."""
    tables = Tables(docs.sparkSession)
    found = tables.put("nj-buckets", buckets(signed(docs, n, num, den)))
    met = found.select("nj_node").distinct()
    base = tables.put("nj-base", sized(docs, met, n, num, den))
    once = base.where("nj_sketch is not null").select("nj_node", "nj_n", "nj_sketch", "nj_text").dropDuplicates(["nj_node"])
    nodes = tables.put("nj-nodes", once.join(met, "nj_node", "left_semi"))

    fits = F.least("nj_na", "nj_nb") * den >= F.greatest("nj_na", "nj_nb") * num
    with_size = found.join(nodes.select("nj_node", "nj_n"), "nj_node")
    # Round 1: every node of a bucket with the bucket's smallest node.
    pivot = with_size.groupBy("nj_bucket").agg(F.min(F.struct("nj_node", "nj_n")).alias("p"))
    pairs = with_size.join(pivot, "nj_bucket").select(F.col("p.nj_node").alias("nj_a"), F.col("nj_node").alias("nj_b"), F.col("p.nj_n").alias("nj_na"), F.col("nj_n").alias("nj_nb"))
    tried = tables.put("nj-pairs-1", pairs.where("nj_a <> nj_b").where(fits).select("nj_a", "nj_b").distinct())
    links = _verified(tables, docs, nodes, [passing(tried, nodes, num, den)], n, num, den, "nj-links-1")
    comp = contracted(links, tables)
    for turn in (2, 3):
        open_ = tables.put("nj-open", _open(found, comp, nodes))
        if open_.isEmpty():
            break
        if turn == 2:
            # Round 2: the node with the most links so far is the pivot.
            degree = links.select(F.col("nj_a").alias("nj_node")).union(links.select("nj_b")).groupBy("nj_node").agg(F.count("*").alias("nj_d"))
            ranked = open_.join(degree, "nj_node", "left").withColumn("nj_d", F.coalesce("nj_d", F.lit(0)))
            pivot = ranked.groupBy("nj_bucket").agg(F.max(F.struct("nj_d", "nj_node", "nj_n", "nj_comp")).alias("p"))
            pairs = open_.join(pivot, "nj_bucket").where("nj_comp <> p.nj_comp").select(
                F.least("nj_node", "p.nj_node").alias("nj_a"), F.greatest("nj_node", "p.nj_node").alias("nj_b"), F.col("nj_n").alias("nj_na"), F.col("p.nj_n").alias("nj_nb"))
            fresh = tables.put("nj-pairs-2", pairs.where(fits).select("nj_a", "nj_b").distinct().join(tried, ["nj_a", "nj_b"], "left_anti"))
            tried = tried.union(fresh)
            fresh = [passing(fresh, nodes, num, den)]
        else:
            # Round 3: what is left across components, a part of the buckets at a time.
            part = F.pmod(F.xxhash64("nj_bucket"), F.lit(PASSES))
            fresh = [crossing(open_.where(part == k), nodes, num, den).join(tried, ["nj_a", "nj_b"], "left_anti") for k in range(PASSES)]
        links = links.union(_verified(tables, docs, nodes, fresh, n, num, den, f"nj-links-{turn}"))
        comp = contracted(links, tables)
    tables.drop("nj-buckets", "nj-nodes", "nj-open", "nj-pairs-1", "nj-pairs-2", "nj-links-1", "nj-links-2", "nj-links-3")
    return base.join(comp, "nj_node", "left").select("doc_id", "nj_n", "nj_node", "nj_comp")


def _verified(tables: Tables, docs: DataFrame, nodes: DataFrame, parts: list[DataFrame], n: int, num: int, den: int, name: str) -> DataFrame:
    """The similar ones of pairs that passed their sketches, by their whole sets."""
    pairs = None
    for k, part in enumerate(parts):
        part = tables.put(f"nj-passed-{k}", part)
        pairs = part if pairs is None else pairs.union(part)
    pairs = pairs.distinct() if len(parts) > 1 else pairs
    ends = pairs.select(F.col("nj_a").alias("nj_node")).union(pairs.select("nj_b")).distinct()
    needed = tables.put("nj-needed", nodes.select("nj_node", "nj_text").join(ends, "nj_node", "left_semi"))
    if needed.isEmpty():
        links = tables.put(name, pairs)
    else:
        links = tables.put(name, verified(pairs, tables.put("nj-sets", needed_sets(docs, needed, n)), num, den))
    tables.drop("nj-needed", "nj-sets", *(f"nj-passed-{k}" for k in range(len(parts))))
    return links


def _open(found: DataFrame, comp: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the buckets whose nodes are in more than one component."""
    rows = found.join(nodes.select("nj_node", "nj_n"), "nj_node").join(comp, "nj_node", "left").withColumn("nj_comp", F.coalesce("nj_comp", "nj_node"))
    many = rows.groupBy("nj_bucket").agg(F.min("nj_comp").alias("lo"), F.max("nj_comp").alias("hi"), F.count("*").alias("nj_m")).where("lo <> hi and nj_m > 2").select("nj_bucket")
    return rows.join(many, "nj_bucket", "left_semi")


def with_component_ids(rows: DataFrame) -> DataFrame:
    """rows of `components` with component_id, the smallest doc_id of each component."""
    rows = rows.withColumn("nj_key", F.coalesce("nj_comp", "nj_node"))
    least = rows.where("nj_key is not null").groupBy("nj_key").agg(F.min("doc_id").alias("nj_least"))
    out = rows.join(least, "nj_key", "left")
    return out.withColumn("component_id", F.when(F.col("nj_key").isNull(), F.col("doc_id")).otherwise(F.col("nj_least")))


def representatives(docs: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row of docs for each component, of its smallest doc_id (null after all others); all rows
    with empty sets. Rows are told apart by a 64-bit hash of id and text, as an id may be shared by
    rows of several components; of rows equal in both, one stays, that of the smallest hash of its
    other columns."""
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    plain = [f.name for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    rest = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in plain)))) if plain else F.lit(0).cast("long")
    rows = components(docs.select(key.alias("doc_id"), "text"), n, num, den)
    rows = rows.select(F.col("doc_id").alias("nj_row"), F.coalesce("nj_comp", "nj_node").alias("nj_key")).where("nj_key is not null").distinct()
    ids = docs.select(F.col("doc_id").cast("long").alias("nj_id"), key.alias("nj_row"), rest.alias("nj_rest"))
    least = F.min(F.struct(F.col("nj_id").isNull().alias("nj_none"), "nj_id", "nj_row", "nj_rest"))
    kept = written(ids.join(rows, "nj_row").groupBy("nj_key").agg(least.alias("p")).select(F.col("p.nj_row").alias("nj_row"), F.col("p.nj_rest").alias("nj_rest")), "nj-kept")
    # The user's columns travel in one struct, so that their names meet none of these.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("nj_whole"), key.alias("nj_row"), rest.alias("nj_rest"), (F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) == 0).alias("nj_empty"))
    one = whole.where("not nj_empty").join(kept, ["nj_row", "nj_rest"], "left_semi").dropDuplicates(["nj_row", "nj_rest"])
    return one.select("nj_whole.*").unionByName(whole.where("nj_empty").select("nj_whole.*"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = with_component_ids(components(docs, n=4, num=85, den=100))
    return rows.select("doc_id", F.col("nj_n").alias("n_shingles"), "component_id")


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]) END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.r JOIN n y ON p.b = y.r WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(r, t) AS (SELECT r, r FROM d UNION SELECT c.r, e.b FROM c JOIN e ON c.t = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN c ON d.r = c.r JOIN d o ON c.t = o.r LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""
