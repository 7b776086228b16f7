"""Substring dedup by sliding spans of words, removed in sentences.

A passage is repeated where a run of at least MIN_WORDS words stands in another place, too,
wherever it starts there: every word of a text starts a span of MIN_WORDS words, and a word is
covered if a span that holds it is not the first of its kind (by doc_id, then place). Words are
lower-cased, white space aside. A text is cut into units: sentences, ending at `.`, `!` or `?`
before white space or at a line end, those of more than LONG words cut further every LONG words.
Units of covered words only are removed with the white space after them; the unit at either end of
a passage stays if it holds other words. A unit has LONG words at most, so that a repeat of
MIN_WORDS + LONG - 1 words or more always loses all but LONG - 1 words at each end, and a span is
never inside one unit. Every span of whole units (`spans`) is thereby covered.

A span's anchor is the least hash of its runs of RUN words. Equal spans have equal anchors, and
neighbours mostly share theirs: only anchors meet over all documents first. Spans whose anchor a
Bloom filter of the repeated ones holds travel once, those of one anchor as one row to the anchor,
where they are compared in the order of doc_id. Spans of anchors in more than HOT places travel one
by one to a task by their own hash, so that memory stays bounded. Repeats inside one document are
found where it is written. Spans are told apart by two 64-bit hashes of their words' hashes.

Null and empty texts have no units and stay as they are. Rows that share an id are one document:
what only they share stays in all of them; each row's own repeats go. A null id comes before all
others. Empty tables give empty results. `dedup` leaves other columns as they are, whatever their
names: the row of a document is one struct on the way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import bloom
from ._common import ASCII_LOWER, map_rows, read_table, written
from .jaccard import _CODE, _SPACE, _powers, mix

MIN_UNITS = 2
MIN_WORDS = 20
LONG = 12
#: Words of the runs of which a span's least one is its anchor.
RUN = 8
#: Places of an anchor beyond which its spans are compared one by one.
HOT = 10_000
#: Spans of one row, and bytes of the texts that are hashed together, at most (or one text).
ROW, CHUNK = 1024, 1 << 19

#: Ends of sentences, with the white space that belongs to them.
_END = re.compile(rb"(?:(?<=[.!?])[\x20\x09-\x0D]+|[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*)")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def units(raw: bytes) -> list[bytes]:
    """Pieces that joined give raw, each one unit with the white space after it."""
    out, at = [], 0
    for m in _END.finditer(raw):
        if m.end() > at:
            out.append(raw[at : m.end()])
            at = m.end()
    if at < len(raw):
        out.append(raw[at:])
    if not any(len(u) > 2 * LONG for u in out):
        return out
    cut = []
    for u in out:
        if len(u) > 2 * LONG and len(words := _WORD.findall(u)) > LONG:
            lead = u[: len(u) - sum(map(len, words))]
            parts = [b"".join(words[i : i + LONG]) for i in range(0, len(words), LONG)]
            parts[0] = lead + parts[0]
            cut += parts
        else:
            cut.append(u)
    return cut


def spans(pieces: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(first unit, number of units, hash) of the shortest run of whole units from each unit that
    has at least MIN_UNITS units and MIN_WORDS words."""
    words = [u.translate(ASCII_LOWER).split() for u in pieces]
    sizes = list(map(len, words))
    keys = [b" ".join(w) for w in words]
    n, end, total = len(pieces), 0, 0
    for i in range(n):
        while end < n and (end - i < MIN_UNITS or total < MIN_WORDS):
            total += sizes[end]
            end += 1
        if end - i < MIN_UNITS or total < MIN_WORDS:
            return
        yield i, end - i, xxhash.xxh3_128_digest(b" ".join(keys[i:end]))
        total -= sizes[i]


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


NO_ID = -(2**63)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Numbers of first texts and raw texts of some CHUNK bytes together."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = _raw(t)
        if held and size + len(raw) > CHUNK:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def _step(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    """Hashes of runs, each run of a followed by that of b that starts `by` words later."""
    m = min(len(a), len(b) - by)
    return mix(a[:m] * np.uint64(0x9E3779B97F4A7C15) + b[by : by + m])


def windows(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """Every span of MIN_WORDS words: number of its text, place of its first word there, anchor and
    two hashes; then the number of words of every text."""
    raw = np.frombuffer(b"\n".join(raws).translate(ASCII_LOWER), np.uint8)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    offset = np.cumsum([0, *(len(r) + 1 for r in raws)])
    before = np.searchsorted(starts, offset)  # words before each text
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3, np.diff(before)
    if len(starts) < MIN_WORDS:
        return none
    power, inverse = _powers(1 << max(20, len(raw).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODE[raw] * power[: len(raw)], dtype=np.uint64)])
    h1 = mix((sums[ends] - sums[starts]) * inverse[starts])
    h2 = _step(h1, h1, 1)
    h4 = _step(h2, h2, 2)
    h8 = _step(h4, h4, 4)
    whole = _step(_step(h8, h8, 8), h4, 16)
    least = h8  # over 2, 4, 8 and at last MIN_WORDS - RUN + 1 runs
    for by in (1, 2, 4, MIN_WORDS - RUN + 1 - 8):
        least = np.minimum(least[: len(least) - by], least[by:])
    other = mix(whole + h1[: len(whole)] * np.uint64(3)) ^ mix(h8[: len(whole)] ^ h1[MIN_WORDS - 1 :])
    text = np.repeat(np.arange(len(raws)), np.diff(before))
    i = np.flatnonzero(text[: len(whole)] == text[MIN_WORDS - 1 :])
    return text[i], i - before[text[i]], least[i], whole[i], other[i], np.diff(before)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that are equal in these columns starts."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def removals(docs: DataFrame) -> DataFrame:
    """sp_doc, sp_text (id and hash of a row) and sp_spans, runs of spans that stand in a document
    before it, as place of the first << 16 | number."""
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("sp_doc"), F.xxhash64("text").alias("sp_text"), "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                ids = np.asarray(b.column(0))
                for first, raws in _chunks(b.column(1).to_pylist()):
                    text, _, anchor, _, _, _ = windows(raws)
                    if len(text):
                        i = _changes(text, anchor)
                        yield pa.RecordBatch.from_arrays([pa.array(anchor[i].view(np.int64)), pa.array(ids[first + text[i]])], ["sp_g", "sp_doc"])

    found = slim.select("sp_doc", "text").mapInArrow(anchors, "sp_g long, sp_doc long")
    found = found.groupBy("sp_g").agg(F.min("sp_doc").alias("lo"), F.max("sp_doc").alias("hi"), F.count("*").alias("n"))
    found = written(found.where("lo <> hi").select("sp_g", "n"), "spans-anchors")
    context = docs.sparkSession.sparkContext
    level = context.broadcast(bloom.of_longs(found, "sp_g"))
    hot = context.broadcast(bloom.of_longs(found.where(F.col("n") > HOT), "sp_g"))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                ids, hashes = np.asarray(b.column(0)), np.asarray(b.column(1))
                for first, raws in _chunks(b.column(2).to_pylist()):
                    text, at, anchor, w, other, _ = windows(raws)
                    if not len(text):
                        continue
                    # Neighbours share anchors: the filters are asked once a run.
                    run = _changes(text, anchor)
                    size = np.diff(np.append(run, len(text)))
                    key = anchor[run].view(np.int64)
                    held = np.repeat(bloom.holds_longs(level.value, key), size)
                    alone = np.repeat(bloom.holds_longs(hot.value, key), size)[held]
                    text, at, anchor, w, other = (x[held] for x in (text, at, anchor, w, other))
                    if not len(text):
                        continue
                    g = np.where(alone, other, anchor)
                    i = _changes(text, g, at - np.arange(len(at)), at // ROW)
                    ends = pa.py_buffer((np.append(i, len(text)) * 8).astype(np.int32))
                    spans_ = pa.Array.from_buffers(pa.binary(), len(i), [None, ends, pa.py_buffer(w.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[i].view(np.int64)), pa.array(ids[first + text[i]]), pa.array(hashes[first + text[i]]), pa.array(at[i]), spans_], ["sp_g", "sp_doc", "sp_text", "sp_at", "sp_w"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen = None, {}
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for g, i, h, at, raw in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if g != group:
                    group, seen = g, {}
                n = len(raw) // 8
                gone = [seen.setdefault(raw[k : k + 8], i) < i for k in range(0, len(raw), 8)]
                if all(gone):
                    out.append((i, h, at << 16 | n))
                elif any(gone):
                    for no, run in groupby(range(n), gone.__getitem__):
                        if no:
                            run = list(run)
                            out.append((i, h, at + run[0] << 16 | len(run)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], []))], ["sp_doc", "sp_text", "sp_run"])

    rows = slim.mapInArrow(repeated, "sp_g long, sp_doc long, sp_text long, sp_at long, sp_w binary")
    rows = rows.repartition("sp_g").sortWithinPartitions("sp_g", "sp_doc")
    met = rows.mapInArrow(later, "sp_doc long, sp_text long, sp_run long")
    return met.groupBy("sp_doc", "sp_text").agg(F.collect_set("sp_run").alias("sp_spans"))


def cut(raw: bytes, covered: np.ndarray) -> tuple[int, int, bytes]:
    """Units in all, units removed, and the text that stays; `covered` is given for every word."""
    pieces = units(raw)
    if not covered.any():
        return len(pieces), 0, raw
    ends = np.cumsum([len(u.split()) for u in pieces])
    total = np.concatenate([[0], np.cumsum(covered)])
    starts = np.append(0, ends[:-1])
    gone = total[ends] - total[starts] == ends - starts
    for i in np.flatnonzero(ends == starts)[::-1]:  # white space before the first word
        gone[i] = i + 1 < len(pieces) and gone[i + 1]
    return len(pieces), int(gone.sum()), b"".join(u for u, g in zip(pieces, gone, strict=True) if not g)


def cuts(texts: list[str | None], gone: list[list[int] | None]) -> Iterator[tuple[int, int, str | None]]:
    """`cut` of texts without the runs of spans given for each, and without their own repeats."""
    for first, raws in _chunks(texts):
        text, at, _, w, other, n_words = windows(raws)
        start = np.cumsum(n_words) - n_words
        order = np.lexsort((at, other, w, text))
        t, a, b = text[order], w[order], other[order]
        again = order[1:][(t[1:] == t[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
        change = np.zeros(int(n_words.sum()) + 1, np.int64)
        from_, number = [start[text[again]] + at[again]], [np.ones(len(again), np.int64)]
        for i in range(len(raws)):
            if g := gone[first + i]:
                runs = np.array(g, np.int64)
                from_.append(start[i] + (runs >> 16))
                number.append(runs & 0xFFFF)
        from_, number = np.concatenate(from_), np.concatenate(number)
        np.add.at(change, from_, 1)
        np.add.at(change, from_ + number + MIN_WORDS - 1, -1)
        covered = np.cumsum(change)[:-1] > 0
        for i, raw in enumerate(raws):
            n, k, rest = cut(raw, covered[start[i] : start[i] + n_words[i]])
            yield n, k, rest.decode("utf-8", "surrogatepass") if k else texts[first + i]


def _joined(docs: DataFrame) -> DataFrame:
    """sp_row, the whole row of docs, and sp_spans."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("sp_row")
    rows = docs.select(whole, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("sp_doc"), F.xxhash64("text").alias("sp_text"))
    return rows.join(removals(docs), ["sp_doc", "sp_text"], "left").drop("sp_doc", "sp_text")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with repeated passages taken out of `text`."""
    names, schema = docs.columns, to_arrow_schema(docs.schema)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                cols = b.column(0).flatten()
                new = [c[2] for c in cuts(cols[at].to_pylist(), b.column(1).to_pylist())]
                cols[at] = pa.array(new, schema.field("text").type)
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return _joined(docs).mapInArrow(run, docs.schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(cols: dict[str, list]) -> dict[str, list]:
        got = list(cuts(cols["text"], cols["sp_spans"]))
        return {"doc_id": cols["doc_id"], "n_sentences": [g[0] for g in got], "n_removed": [g[1] for g in got], "text": [g[2] for g in got]}

    return map_rows(_joined(docs).select("sp_row.*", "sp_spans"), run, "doc_id long, n_sentences long, n_removed long, text string")
