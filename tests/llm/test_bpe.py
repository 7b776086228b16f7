"""Byte-level BPE against the library that the rank file is made for."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from flowspark.llm import bpe

from ..conftest import SF
from .cases import documents, empty, wild


@pytest.fixture(scope="module")
def ranks():
    return bpe.pieces_of(bpe.default_ranks())


@pytest.fixture(scope="module")
def library(ranks):
    own = {k.encode("latin-1"): v for k, v in ranks.items()}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})


def odd_texts(n: int) -> list[str]:
    rng = random.Random(5)
    bits = ["'s", "'re", "''", " ", "  ", "\n", "\t", "a", "é", "1", "½", "中文", "!", "<|endoftext|>", "\x1c", "don't", "I'VE", " '", "́", "😀", "_", "\U0010ffff", "　", "Straße", "\x00", "\x85", "слово", "ÿ", "Ā"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["a" * 700, "\n" * 300, "語" * 200, "xyzzy" * 100, " " * 50 + "x"]


def test_odd_texts(spark, library):
    """Ids as the library's, for repeated rows, shared and null ids too; decoding gives the bytes back."""
    texts = odd_texts(400)
    rows = [(None if i % 50 == 0 else i // 2, t) for i, t in enumerate(texts)] + [(1, texts[7])] * 3 + [(9, "zq" * 3000), (9, "-" * 5000)]
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    made = bpe.encode(wild(docs.repartition(3), "part", "codes", "words", "base", "ids", "word")).withColumn("back", bpe.decode(F.col("ids"))).collect()
    expected = Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in docs.collect())
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["back"])) for r in made) == expected
    assert bpe.encode(empty(spark)).count() == 0


def test_heap_merges_alike(ranks, library):
    rng = random.Random(6)
    words = [t for t in odd_texts(0)] + ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    assert [bpe.merged_by_heap(w, ranks) for w in words if " " not in w] == [library.encode_ordinary(w) for w in words if " " not in w]


def test_every_character_is_split_alike(library):
    """The splitting pattern in tasks and in the library see the same letters, numbers and spaces."""
    import regex

    find = regex.compile(public_tokenizers.PATTERN).findall
    points = [c for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 997):
        text = "".join(f"a{chr(c)}1" for c in points[at : at + 997])
        assert [t for w in find(text) for t in library.encode_ordinary(w)] == library.encode_ordinary(text)


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    made = bpe.op12_byte_bpe(spark, SF).collect()
    assert len(made) == len(texts)
    for r in made:
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
