"""Mixing, packing, URL cascades, archives and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.llm import mixing, packing, urls, warc
from flowspark.llm.tokens import Encoder

from ..conftest import SF
from .cases import documents, empty, ordered, plain, wild


def test_mix_large_document(spark):
    """One document as large as the target does not keep its source from it; null ids are not one task."""
    rows = [(i, "w " * 100, "z") for i in range(200)] + [(None, "w " * 20_000, "z"), (999, "w " * 60_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weight in (0.2, 0.1003):
        out = mixing.plan(docs, {"y": [(0.0, 1.0 - weight)], "z": [(0.0, weight)]}).where("source = 'z'").collect()
        assert abs(sum(r["mix_size"] * r["mix_copies"] for r in out) - out[0]["mix_target"]) <= 50
    same = spark.createDataFrame([(None, f"text number {i}", "z") for i in range(500)], "doc_id long, text string, source string")
    assert same.select(*mixing.keyed()).distinct().count() == 500


def test_mix(spark):
    docs = wild(documents(spark), "mix_size", "size", "mix_source", "mix_hash", "mix_text", "mix_whole", "mix_end", "mix_foo")
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["mix_copies"] <= 3
    total = sum(r["mix_size"] for r in rows)
    assert sum(g[0]["mix_target"] for g in by.values()) == pytest.approx(total)
    for g in by.values():
        assert g[0]["mix_target"] <= 3 * sum(r["mix_size"] for r in g) + 1e-9
        assert abs(sum(r["mix_size"] * r["mix_copies"] for r in g) - g[0]["mix_target"]) <= max(r["mix_size"] for r in g)
    mixed = mixing.arrange(docs)
    assert mixed.columns == docs.columns
    want = Counter((r["doc_id"]) for r in rows for _ in range(r["mix_copies"]))
    assert Counter(i for i, _ in plain(mixed)) == want
    assert {r["mix_size"] for r in mixed.collect()} == {"mix_size"}
    assert [r[0] for r in mixed.collect()] == [r[0] for r in mixing.arrange(docs).collect()]
    assert mixing.arrange(empty(spark)).count() == 0


def test_curriculum(spark):
    """One source fades out as the other fades in; positions follow the integrated weights."""
    d = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.plan(d, {"a": [(0.0, 1.0), (1.0, 0.0)], "b": [(0.0, 0.0), (1.0, 1.0)]}).where("mix_copies > 0").collect()
    at = {s: np.sort([r["mix_position"] / 4000 for r in rows if r["source"] == s]) for s in "ab"}
    assert len(at["a"]) == len(at["b"]) == 200
    assert np.median(at["a"]) == pytest.approx(1 - 0.5**0.5, abs=0.01) and np.median(at["b"]) == pytest.approx(0.5**0.5, abs=0.01)


def test_standing_schedule(spark):
    """The first source fades, the second grows, the third stays; 5 : 2 : 1 are their integrals."""
    assert [w for w, _ in mixing.standing()] == list(mixing.WEIGHTS)
    d = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    rows = mixing.plan(d).where("mix_copies > 0").collect()
    middle = {s: np.median([r["mix_position"] / 9000 for r in rows if r["source"] == s]) for s in "bc"}
    # Half of b's demand has come at the time t with (t + t * t) / 2 = 1 / 2.
    assert middle["b"] == pytest.approx((5**0.5 - 1) / 2, abs=0.02) and middle["c"] == pytest.approx(0.5, abs=0.02)
    mixed = [r["source"] for r in mixing.arrange(d).collect()]
    third = len(mixed) // 3
    assert mixed[:third].count("a") > mixed[-third:].count("a") and mixed[:third].count("b") < mixed[-third:].count("b")


def test_ids_are_the_librarys():
    rng = random.Random(1)
    bits = ["'s", "'re", "'ll", "''", " ", "  ", "\n", "\t", "a", "é", "1", "½", "中", "!", "<|endoftext|>", "\x1c", "don't", "I'VE", "'d", " '", "́", "😀", "_", "\U0010ffff", "　"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", "a" * 300, "\n" * 400, "x y " * 200_000]
    e = Encoder(packing.default_tokenizer())
    slow = e.slow.encode_batch(texts, add_special_tokens=False)
    assert all(a.tolist() == list(b.ids) for a, b in zip(e.encode(texts), slow, strict=True))


def packed(parts):
    load = defaultdict(list)
    for r in parts:
        load[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in load.values():
        x.sort()
        assert [o for o, _ in x] == np.cumsum([0, *(n for _, n in x[:-1])]).tolist()
        assert sum(n for _, n in x) <= packing.CAPACITY
    return load


def test_packing(spark):
    docs = wild(documents(spark), "length", "piece").unionByName(wild(documents(spark), "length", "piece"))
    parts = packing.written(packing.pieces(docs), "t")
    got = packing.pack(parts).collect()
    packed(got)
    slow = Encoder(packing.default_tokenizer()).slow
    texts = Counter()
    for i, t in plain(docs):
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 0]
        m = -(-len(ids) // 2048)
        cuts = [0, *(len(ids) - 2048 * (m - 1 - k) for k in range(m))]
        for k in range(m):
            texts[i, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(np.array(ids[cuts[k] : cuts[k + 1]], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == texts
    assert packing.pack(packing.written(packing.pieces(empty(spark)), "t")).count() == 0


@pytest.mark.parametrize("lengths", [lambda r: r.randint(1, 2048), lambda r: min(2048, int(r.lognormvariate(6, 1)) + 1), lambda r: r.choice([1025, 1023, 683, 300]), lambda r: r.randint(600, 760), lambda r: r.randint(1, 9)])
def test_plans(lengths):
    r = random.Random(7)
    items = [lengths(r) for _ in range(3000)]
    counts = Counter(items)
    plan = packing.solve(counts)
    at = plan.arrays()
    load = Counter()
    for n, c in counts.items():
        for s in packing.lookup(at, np.full(c, n), np.arange(c)):
            load[int(s)] += n
    assert max(load.values()) <= 2048 and len(load) == plan.n_sequences
    room = []
    for n in sorted(items, reverse=True):  # best fit, longest first
        fit = [i for i, x in enumerate(room) if x >= n]
        if fit:
            room[min(fit, key=room.__getitem__)] -= n
        else:
            room.append(2048 - n)
    assert plan.n_sequences <= len(room) + 1


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key like '%7%'").unionByName(spark.createDataFrame([("elsewhere",)], "key string"))
    c = urls.build(universe, listed)
    h1, h2 = urls.hashes(F.col("key"))
    rows = universe.select("key", h1.alias("a"), h2.alias("b")).toPandas()
    got = c.contains(rows["a"].to_numpy(), rows["b"].to_numpy())
    assert got.tolist() == rows["key"].str.contains("7").tolist()
    assert len(c.parts) == 1 and len(c.parts[0].levels) >= 2
    many = urls.build(universe, listed, max_bits=1000)
    assert len(many.parts) > 3 and np.array_equal(many.contains(rows["a"].to_numpy(), rows["b"].to_numpy()), got)
    assert {(r["key"], r["listed"]) for r in urls.membership(universe, listed).collect()} == {(k, "7" in k) for k in rows["key"]}


def test_urls(spark):
    cases = {
        "http://Example.NET/en/x": ("example.net", "/en/x", "example.net/en/", "allow"), "http://a.b.net/": ("a.b.net", "/", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"), "http://fooexample.com/de/": ("fooexample.com", "/de/", None, "allow"),
        "https://x.example.com/de/1?q=/fr/": ("x.example.com", "/de/1", "example.com/de/", "block"), "x://spam-a.org/y": ("spam-a.org", "/y", None, "block"), "nothing": ("", "", None, "block"), None: ("", "", None, "block"), "a://b://c/d#e": ("b:", "//c/d", None, "allow"),
        "http://net/fr/?": ("net", "/fr/", "net/", "block"), "://": ("", "", None, "block"), "http://x.org/fr/#": ("x.org", "/fr/", "org/fr/", "allow"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumns({"host": F.lit("h"), "keys": F.lit(1)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert urls.judge(df.limit(0)).count() == 0


def test_a_list_of_hosts(spark):
    """A hundred thousand listed hosts: they and their subdomains are blocked, nobody else."""
    hosts = spark.range(100_000).select(F.concat(F.lit("h"), "id", F.lit(".example"), F.col("id") % 7).alias("key")).unionByName(spark.createDataFrame([(None,), ("co.uk",)], "key string"))
    at = F.col("id")
    url = F.when(at % 3 == 0, F.concat(F.lit("http://h"), at * 40, F.lit(".example"), (at * 40) % 7, F.lit("/x"))).when(at % 3 == 1, F.concat(F.lit("http://www.a.h"), at * 40, F.lit(".example"), (at * 40) % 7)).otherwise(F.concat(F.lit("http://h"), at * 40, F.lit(".example"), (at * 40 + 1) % 7))
    pages = spark.range(4000).select(at.alias("page_id"), url.alias("url")).unionByName(spark.createDataFrame([(9001, "http://x.co.uk/"), (9002, "http://uk/"), (9003, None)], "page_id long, url string"))
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, hosts=hosts).collect()}
    assert got.pop(9001) == "block" and got.pop(9002) == "allow" and got.pop(9003) == "block"
    assert got == {i: "block" if i % 3 < 2 and i * 40 < 100_000 else "allow" for i in range(4000)}


def test_archives(spark, tmp_path):
    pages = [(5, "http://a/é x\n", "same"), (3, "http://b", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (None, "n", "alone"), (None, "n", "same"), (4, "w", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nX: y\r\n\r\n"), (6, "r", "line\r\nline\n\n"), (7, "l", "é" * 200_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = warc.write_archives(df, str(tmp_path / "w"))
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == len(pages)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows)
    assert got == Counter([(5, "revisit", 3, 4), (3, "response", None, 4), (3, "response", None, 4), (9, "revisit", 3, 4), (1, "response", None, 0), (2, "revisit", 1, 0), (None, "response", None, 5), (None, "revisit", 3, 4),
                           (4, "response", None, len(pages[8][2])), (6, "response", None, 12), (7, "response", None, 400_000)])
    ids = [x for r in spark.read.text(path).where("value like 'WARC-Record-ID%'").collect() for x in r]
    assert len(ids) == len(set(ids)) == len(pages)
    text = {r["page_id"]: r["payload"] for r in rows if r["record_type"] == "response" and r["page_id"] is not None}
    assert all(bytes(text[i]).decode() == (h or "") for i, _, h in pages if i in text)
    few = warc.read_archives(spark, warc.write_archives(df, str(tmp_path / "f"), least_bytes=5))
    assert few.where("record_type = 'revisit'").count() == 0
    assert warc.read_archives(spark, warc.write_archives(df.limit(0), str(tmp_path / "e"))).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse(iter([b"broken"])))


def test_pipeline(spark):
    """Stage by stage against plain Python over the same documents."""
    import corpus_pipeline as pipe
    from flowspark.llm import quality

    from .test_joins import brute_components
    from .test_text import brute_lines

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipe.STAGES] == ["quality rules", "line dedup", "near duplicates", "source mixing", "sequence packing"]
    a = pipe.quality_rules(spark, docs, SF)
    ok = lambda t: not any(eval(c, {}, dict(zip(quality.MEASURES, quality.measure(t), strict=True))) for _, c in quality.RULES)
    assert ordered(plain(a)) == ordered((i, t) for i, t in plain(docs) if ok(t))
    b = packing.written(pipe.line_dedup(spark, a, SF), "t")
    rows = plain(b)
    assert ordered(rows) == ordered((i, t) for i, _, _, t in brute_lines(plain(a)))
    c = packing.written(pipe.near_duplicates(spark, b, SF), "t")
    comps = brute_components(rows, 5, 80, 100)
    assert sorted(i for i, _ in plain(c)) == sorted(i for i, n, k in comps if i == k or not n)
    d = packing.written(pipe.source_mixing(spark, c, SF), "t")
    assert set(plain(d)) <= set(plain(c)) and d.columns == docs.columns
    e = pipe.sequence_packing(spark, d, SF).collect()
    packed(e)
    assert Counter(r["doc_id"] for r in e if r["piece"] == 0) == Counter(i for i, _ in plain(d))


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_takes_any_table(spark, rows):
    """Nulls, empty and long texts, repeated rows and ids, extra columns of the operators' own names."""
    import corpus_pipeline as pipe

    names = ["row", "ledger", "ld_doc", "ld_keys", "ld_row", "nj_row", "nj_key", "nj_whole", "mix_size", "mix_whole", "mix_source", "length", "sequence_id", "pk_n"]
    docs = wild(documents(spark) if rows == "odd" else empty(spark), *names)
    docs = docs.unionByName(docs).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    at = docs
    for name, stage in pipe.STAGES[:-1]:
        at = packing.written(stage(spark, at, SF), "t")
        assert at.columns == docs.columns, name
    out = pipe.STAGES[-1][1](spark, at, SF).collect()
    packed(out)
    kept = Counter(i for i, _ in plain(at))
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == kept
    if rows == "odd":
        assert 1 in kept and not {4, 5} & set(kept) and not {2, 3} & set(kept)  # empty; near and exact copies
        assert all(n <= mixing.MAX_EPOCHS for n in kept.values())


def test_warc_payloads_are_shuffled_once(spark, tmp_path, monkeypatch):
    """The copies' numbers need no other distribution than the join with the decisions, null ids included."""
    plans = []
    classic = type(spark.range(1))
    own = classic.mapInArrow
    monkeypatch.setattr(classic, "mapInArrow", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, *a, **k))
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (None, "v", "a"), (None, "v", "a")], "page_id long, url string, html string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        path = warc.write_archives(df, str(tmp_path / "once"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    head = plans[0][: plans[0].index("SortMergeJoin")]
    assert "Window" in head and "Exchange" not in head
    got = sorted((r["page_id"] is None, r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect())
    assert got == [(False, 1, "response", None), (False, 2, "revisit", 1), (True, None, "revisit", 1), (True, None, "revisit", 1)]
