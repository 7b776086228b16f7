"""Importance resampling against plain counts of n-grams."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from flowspark.llm import resample

from .cases import SCHEMA, documents, empty, wild, words


def features(text: str | None, max_n: int, buckets: int) -> list[int]:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def n_words(text: str | None) -> int:
    return len(features(text, 1, 1))


def expected(docs, target, percent, least, max_n, buckets):
    every = [(r["doc_id"], features(r["text"], max_n, buckets), n_words(r["text"])) for r in docs]
    s, t = Counter(b for _, f, _ in every for b in f), Counter(b for r in target for b in features(r["text"], max_n, buckets))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    out = []
    for i, f, n in every:
        h = int(sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    open_ = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    for k, r in enumerate(open_[: percent * len(open_) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("max_n", "buckets", "percent", "least"), [(2, 10_000, 25, 20), (3, 97, 60, 1), (1, 5, 100, 0)])
def test_against_plain_counts(spark, max_n, buckets, percent, least):
    more = spark.createDataFrame([(100 + i, words(i % 11, 25 + i % 5), "en", "a", 1) for i in range(120)] + [(None, words(3, 30), "en", "a", 1)] * 3, SCHEMA)
    docs = documents(spark).unionByName(more)
    target = spark.createDataFrame([(1, words(4, 50)), (2, None), (3, "")], "item_id long, text string")
    mine = resample.resample(wild(docs.repartition(3), "n_words", "buckets", "score", "rank"), wild(target, "doc_id"), percent, least, max_n=max_n, buckets=buckets)
    assert sorted(map(tuple, mine.collect()), key=str) == expected(docs.collect(), target.collect(), percent, least, max_n, buckets)


def test_empty_tables(spark):
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resample.resample(empty(spark), target).count() == 0
    docs = documents(spark)
    assert resample.resample(docs, target.limit(0)).count() == docs.count()


@pytest.mark.parametrize("max_n", [1, 2, 3, 5])
def test_pieces_of_long_texts(monkeypatch, max_n):
    """Texts cut into pieces have the n-grams of the whole."""
    monkeypatch.setattr(resample, "CHUNK", 7)
    monkeypatch.setattr(resample, "PIECE", 30)
    rng = random.Random(max_n)
    for _ in range(60):
        text = "".join(rng.choice(["ab ", "é", "C-", "1\n", " ", "中x ", "zz.", "  a"]) for _ in range(rng.randint(0, 120)))
        parts = list(resample.word_pieces(text, max_n - 1))
        made = resample.ngram_buckets(parts, max_n, 50) if parts else []
        assert sorted(b for x in made for b in x.tolist()) == sorted(features(text, max_n, 50))
        assert sum(len(w) - n for w, n in parts) == n_words(text)
