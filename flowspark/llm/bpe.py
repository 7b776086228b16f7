"""Byte-level BPE: ids of whole texts by a rank file, and bytes of ids.

Encoding folds merges over distinct words only. A first pass splits texts at the pre-tokeniser's
pattern and writes them as codes into a dictionary of their part, which is at most PART_BYTES of
texts of one task. The words of all dictionaries are then sorted, and the first of each is encoded
by Spark's higher-order functions: a word is an array of byte ranges, each with the rank of what it
and the next one would merge to, looked up in a literal map; `aggregate` merges the leftmost range
of the least rank until none is left that has one. The ids go back to the dictionaries that have the
word, and there to the codes: parts lie in buckets, so the codes are not shuffled. A word is encoded
once for GROUP parts, so that no task gets all places of a word. Decoding looks the pieces up in a
literal array and joins them.

The rank map is as large as the vocabulary, never as the data; it is kept in SLOTS small maps, as a
look-up in a map compares its keys one by one.

A fold takes a step for each byte of a word, and a step goes through the whole array. Words of over
LONGEST bytes, for which that square would matter, are merged in tasks with a heap instead: the
same merges in the same order.

Nulls: a null text is an empty one; both have no ids, and no bytes when decoded. A null id is an id
like any other. Texts and words count whole, however long. Rows that are repeated or share an id are encoded each on its own. Empty tables give empty
results. Other columns do not enter, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import new_path, partitions, read_table, shuffles_freed

#: Bytes of text that share a dictionary, and words in one of its rows.
PART_BYTES = 48 << 20
ROW_WORDS = 1 << 13
#: Parts for which a word is encoded once; bits of a word's code in its part, and of a part in its task.
GROUP = 4096
CODE_BITS, PART_BITS = 24, 12
PACKED_WORDS = 1 << 18
LONGEST = 2048
SLOTS = 1 << 13
#: A rank above all others, and what ranks are multiplied by to stand above a place in a word.
NONE, ABOVE = 1 << 30, 1 << 32


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pieces_of(rank_file: str) -> dict[str, int]:
    """Rank of each piece; its bytes stand as the characters U+0000 to U+00FF."""
    with open(rank_file, "rb") as f:
        return {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def literal(spark: SparkSession, ranks: dict[str, int]) -> Column:
    """The rank map as a literal: SLOTS small maps, each piece in that of its hash."""
    maps: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, at in spark.createDataFrame([(p,) for p in ranks], "p string").select("p", slot(F.col("p"))).collect():
        maps[at][piece] = ranks[piece]
    return F.from_json(F.lit(json.dumps(maps, ensure_ascii=False)), "array<map<string,int>>")


def slot(piece: Column) -> Column:
    return F.pmod(F.hash(piece), F.lit(SLOTS))


def word_ids(word: Column, table: Column) -> Column:
    """The ids of one word by ranked merges."""
    return let(table, lambda maps: let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), lambda w: _merged(w, lambda p: F.coalesce(F.get(maps, slot(p))[p], F.lit(NONE)))))


def _merged(w: Column, rank: Callable[[Column], Column]) -> Column:
    """A word is an array of one number for each piece: the rank of its union with the next piece,
    times ABOVE, plus the place where it starts. The least number is the leftmost best merge. One
    entry stands before the first piece and two after the last, none of which ever merges."""
    n = F.length(w)

    def place(entry: Column) -> Column:
        return entry.bitwiseAND(F.lit(ABOVE - 1)).cast("int")

    def entry(start: Column, end: Column, never: Column) -> Column:
        return F.when(never, F.lit(NONE)).otherwise(rank(F.substring(w, start, end - start))).cast("long") * ABOVE + start

    edge = F.array(n + F.lit(NONE * ABOVE + 1), n + F.lit(NONE * ABOVE + 1))
    pieces = F.concat(F.array(F.lit(NONE * ABOVE)), F.transform(F.sequence(F.lit(1), n), lambda i: entry(i, i + 2, i == n)), edge)

    def merge(v: Column, i: Column) -> Column:
        before, start, end, next_end = (place(F.element_at(v, i + k)) for k in (-1, 0, 2, 3))
        return F.concat(F.slice(v, F.lit(1), i - 2), F.array(entry(before, end, before == 0), entry(start, next_end, end == next_end)), F.slice(v, i + 2, F.size(v)))

    def step(v: Column, _: Column) -> Column:
        return let(F.array_min(v), lambda least: F.when(least >= NONE * ABOVE, v).otherwise(let(F.array_position(v, least).cast("int"), lambda i: merge(v, i))))

    def ids(v: Column) -> Column:
        at = F.sequence(F.lit(2), F.size(v) - 2)
        return F.transform(at, lambda j: let(place(F.element_at(v, j)), lambda s: rank(F.substring(w, s, place(F.element_at(v, j + 1)) - s))))

    return let(rank(w), lambda whole: F.when(whole < NONE, F.array(whole)).otherwise(let(F.aggregate(F.sequence(F.lit(2), n), pieces, step), ids)))


def merged_by_heap(word: str, ranks: dict[str, int]) -> list[int]:
    """The same ids of a very long word: merges wait in a heap and are skipped when outdated."""
    w = word.encode().decode("latin-1")
    if w in ranks:
        return [ranks[w]]
    end, before, alive = list(range(1, len(w) + 1)), list(range(-1, len(w) - 1)), [True] * len(w)
    waiting: list[tuple[int, int, int]] = []

    def wait(at: int) -> None:
        if at >= 0 and end[at] < len(w) and (rank := ranks.get(w[at : end[end[at]]])) is not None:
            heapq.heappush(waiting, (rank, at, end[end[at]]))

    for at in range(len(w)):
        wait(at)
    while waiting:
        _, at, to = heapq.heappop(waiting)
        if alive[at] and end[at] < len(w) and end[end[at]] == to:
            alive[end[at]] = False
            end[at] = to
            if to < len(w):
                before[to] = at
            wait(before[at])
            wait(at)
    return [ranks[w[at : end[at]]] for at in range(len(w)) if alive[at]]


def squeezed(*numbers: np.ndarray) -> bytes:
    """Arrays of numbers below 2 ** 32, their bytes of a kind together, compressed."""
    return pa.compress(b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in numbers), "zstd", asbytes=True)


def unsqueezed(data: bytes, *sizes: int) -> list[np.ndarray]:
    whole = np.frombuffer(pa.decompress(data, 4 * sum(sizes), "zstd", asbytes=True), np.uint8)
    parts = np.split(whole, np.cumsum([4 * n for n in sizes])[:-1])
    return [x.reshape(4, -1).T.copy().view("<u4").ravel() for x in parts]


def _packed(ranks: dict[str, int]):
    """Rows of (place, ids, word if it is a very long one) -> a row for each part: its codes, how many
    ids each has, and the ids."""
    def rows(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(waiting).combine_chunks()
        place, ids = whole["place"].to_numpy(), whole["ids"].to_pylist() if whole["word"].null_count < len(whole) else whole["ids"].combine_chunks()
        if isinstance(ids, list):
            ids = pa.array([i if w is None else merged_by_heap(w, ranks) for i, w in zip(ids, whole["word"].to_pylist(), strict=True)], pa.list_(pa.int32()))
        flat, n = np.asarray(ids.flatten()), np.diff(np.asarray(ids.offsets))
        order = np.argsort(place, kind="stable")
        first, place, n = (np.cumsum(n) - n)[order], place[order], n[order]
        flat = flat[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
        part, code = place >> CODE_BITS, place & ((1 << CODE_BITS) - 1)
        ends = np.concatenate([[0], np.cumsum(n)])
        cut = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        spans = list(zip(cut, cut[1:], strict=False))
        data = [squeezed(np.diff(code[a:b], prepend=0), n[a:b], flat[ends[a] : ends[b]]) for a, b in spans]
        return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), pa.array([b - a for a, b in spans], pa.int32()), pa.array([ends[b] - ends[a] for a, b in spans], pa.int32()), pa.array(data, pa.binary())], ["of", "n_words", "n_ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= PACKED_WORDS:
                yield rows(waiting)
                waiting, size = [], 0
        if size:
            yield rows(waiting)

    return run


def _coded(pattern: str):
    """Rows of (doc_id, text) -> the same as codes, and the words of each part's dictionary in rows of
    ROW_WORDS, the first of which has the code `base`."""
    import regex

    find = regex.compile(pattern).findall
    names = ["part", "doc_id", "codes", "base", "words"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.string())]

    def rows(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, words = TaskContext.get().partitionId() << PART_BITS, 0, {}

        def dictionary() -> Iterator[pa.RecordBatch]:
            every = list(words)
            for base in range(0, len(every), ROW_WORDS):
                yield rows([[part], [None], [None], [base], [every[base : base + ROW_WORDS]]])

        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                made: list[list] = [[], []]
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found = find(text.as_py() or "")
                    codes = np.fromiter((words.setdefault(w, len(words)) for w in found), np.uint32, len(found))
                    made[0].append(i)
                    made[1].append(codes.view(np.uint8).reshape(-1, 4).T.tobytes())  # bytes of a kind together
                n = batch.num_rows
                yield rows([[part] * n, *made, [None] * n, [None] * n])
                size += batch.column(1).nbytes
                if size >= PART_BYTES:
                    yield from dictionary()
                    part, size, words = part + 1, 0, {}
                    if part % (1 << PART_BITS) == 0:
                        raise ValueError(f"a task has over {1 << PART_BITS} parts: read the texts in smaller partitions")
        yield from dictionary()

    return run


def _scattered(rows: pa.Table, dictionary: pa.Table) -> pa.Table:
    """A part's codes and the ids of its words -> the ids of its texts, 256 texts at a time."""
    parts = [unsqueezed(d, n, n, m) for n, m, d in zip(*(dictionary[c].to_pylist() for c in ("n_words", "n_ids", "data")), strict=True)]
    none = np.zeros(0, np.int64)
    code, n, flat = (np.concatenate([none, *x]) for x in ([np.cumsum(p[0], dtype=np.int64) for p in parts], [p[1] for p in parts], [p[2] for p in parts]))
    first, count = np.zeros((2, int(code.max(initial=-1)) + 1), np.int64)
    first[code], count[code] = np.cumsum(n) - n, n
    out = []
    for at in range(0, rows.num_rows, 256):
        part = rows.slice(at, 256)
        codes = [np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for x in part["codes"]]
        every = np.concatenate(codes)
        counts = count[every]
        ends = np.cumsum(counts)
        total = int(counts.sum())
        made = flat[np.repeat(first[every] - ends + counts, counts) + np.arange(total)]
        offsets = np.concatenate([[0], ends])[np.cumsum([0, *map(len, codes)])]
        out.append(pa.table([part["doc_id"], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(made, pa.int32()))], ["doc_id", "ids"]))
    return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})


def encode(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id and ids of every row, by the merges of `rank_file` within each match of
    `pattern`."""
    import public_tokenizers

    spark, ranks = docs.sparkSession, pieces_of(rank_file or default_ranks())
    path = new_path(spark, "bpe-codes")
    name = path.rpartition("/")[2].replace("-", "_")
    coded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_coded(pattern or public_tokenizers.PATTERN), "part long, doc_id long, codes binary, base long, words array<string>")
    with shuffles_freed(spark):
        coded.write.format("parquet").bucketBy(partitions(spark), "part").option("path", path).option("compression", "zstd").saveAsTable(name)
    coded = spark.read.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, the name is not needed any more
    known = coded.where("words IS NOT NULL").select("part", "base", F.posexplode("words").alias("at", "word"))
    place = F.shiftleft("part", CODE_BITS) + F.col("base") + F.col("at")
    same = Window.partitionBy("word", "grp").orderBy("place")
    known = known.select("word", F.expr(f"part div {GROUP << PART_BITS}").cast("int").alias("grp"), place.alias("place")).withColumn("no", F.row_number().over(same))
    is_long = F.octet_length("word") > LONGEST
    ids = F.when((F.col("no") == 1) & ~is_long, word_ids(F.col("word"), literal(spark, ranks)))
    known = known.withColumn("ids", ids).withColumn("ids", F.first("ids").over(same)).select("place", "ids", F.when(is_long, F.col("word")).alias("word"))
    dictionary = known.mapInArrow(_packed(ranks), "of long, n_words int, n_ids int, data binary")
    texts = coded.where("words IS NULL").select("part", "doc_id", "codes")
    return texts.groupBy("part").cogroup(dictionary.groupBy("of")).applyInArrow(_scattered, "doc_id long, ids array<int>")


def decode(ids: Column, rank_file: str | None = None) -> Column:
    """The bytes of an array of ids."""
    ranks = pieces_of(rank_file or default_ranks())
    pieces = F.from_json(F.lit(json.dumps(sorted(ranks, key=ranks.__getitem__), ensure_ascii=False)), "array<string>")
    return let(pieces, lambda every: F.encode(F.array_join(F.transform(ids, lambda i: F.get(every, i)), ""), "ISO-8859-1"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(read_table(spark, sf_dir, "documents"))
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2(decode(F.col("ids")), 256).alias("decoded_sha256"))
