"""Quality rules, licences, line and span dedup against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from flowspark.llm import licenses, lines, quality, spans

from ..conftest import SF
from .cases import PASSAGE, documents, empty, ordered, plain, wild

WHITE = " \t\n\x0b\x0c\r"


def test_measures():
    text = "one two three four five " * 2 + "é#$\n\n same \nsame\n same "
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
    m = dict(zip(quality.MEASURES, quality.measure(text), strict=True))
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == (len(w), sum(map(len, w)), 2, 1, len(covered))
    assert quality.measure(None) == quality.measure("") == (0,) * 7
    assert quality.measure("#")[2] == 1


def test_ledger_and_policies(spark):
    docs = wild(documents(spark), "fail_bits", "n_words", "row", "ledger", "m")
    book = quality.ledger(docs).cache()
    assert book.count() == docs.count()
    kept = ordered(plain(quality.filter_documents(docs)))
    want = [(i, t) for i, t in plain(docs) if not any(eval(c, {}, dict(zip(quality.MEASURES, quality.measure(t), strict=True))) for _, c in quality.RULES)]
    assert kept == ordered(want)
    assert quality.filter_documents(docs).columns == docs.columns
    got = {r["rule"]: r for r in quality.ablation(book, quality.STANDARD).collect()}
    bits = [r["fail_bits"] & quality.STANDARD.mask for r in book.collect()]
    for i, (name, _) in enumerate(quality.RULES):
        assert (got[name]["n_fail"], got[name]["n_alone"]) == (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits))
    assert quality.ledger(empty(spark)).count() == 0


def test_licences(spark):
    docs = wild(documents(spark), "words", "labels")
    by = {r["doc_id"]: r for r in licenses.scan(docs, licenses.build_index(docs)).collect()}
    assert (by[15]["labels"], by[15]["base_labels"], by[15]["n_base"], by[15]["first_word"], by[15]["score"]) == ("apache-2.0,reserved", "reserved", 1, 8, 1.0)
    assert (by[4]["n_words"], by[4]["labels"], by[4]["first_word"], by[4]["score"]) == (0, "", None, 0.0)
    index = licenses.Index({})
    w = licenses.words_of("cc by cc by general public general public license")
    assert licenses.base_places(w) == ([0, 2, 6], {"cc-by", "gpl"})
    altered = licenses.words_of("x " * 40 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and related documentation files")
    assert [p[0] for p in index.scan(altered)] == ["mit"] and index.scan(licenses.words_of("permission granted free of charge")) == []
    assert licenses.scan(empty(spark), index).count() == 0


def brute_places(words, idf_free_templates):
    """Every start of every template tried; the most words in order by plain recursion."""
    from functools import cache

    out = []
    for label, text, phrases in idf_free_templates:
        model = text.encode().split()
        good = []
        for start in range(-len(model) - 3, len(words) + 4):

            @cache
            def most(q, after, start=start):
                if q == len(model):
                    return 0
                at = [p for p in range(max(after, start + q - 3, 0), min(len(words), start + q + 4)) if words[p] == model[q]]
                return max([most(q + 1, after), *(1 + most(q + 1, p + 1) for p in at)])

            stands = True
            for phrase in phrases:
                w = phrase.encode().split()
                places = [q for q in range(len(model)) if model[q : q + len(w)] == w]
                stands &= any(words[p : p + len(w)] == w for q in places for p in range(max(0, start + q - 3), start + q + 4))
            if stands and 10 * most(0, 0) >= 6 * len(model):
                good.append((start, most(0, 0) / len(model)))
        while good:
            run = [good.pop(0)]
            while good and good[0][0] - run[-1][0] <= 3:
                run.append(good.pop(0))
            score = max(x for _, x in run)
            out.append((label, max(0, next(s for s, x in run if x == score)), len(model), score))
    return sorted(out)


def test_licences_against_every_start():
    """Notices cut, broken by other words, with changed words and next to each other."""
    rng = random.Random(6)
    common = sorted({w for _, t, _ in licenses.TEMPLATES for w in t.encode().split()})
    index = licenses.Index({w: rng.random() for w in common[: len(common) // 2]})
    some = 0
    for _ in range(250):
        words = []
        for _ in range(rng.randrange(1, 4)):
            _, t, _ = rng.choice(licenses.TEMPLATES)
            notice = t.encode().split()
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(notice))
                kind = rng.randrange(4)
                if kind == 0:
                    notice[k] = rng.choice(common)
                elif kind == 1:
                    notice.insert(k, b"dnl")
                elif kind == 2 and len(notice) > 3:
                    del notice[k]
                else:
                    notice = notice[:k] or notice
            words += [rng.choice([b"x", rng.choice(common)]) for _ in range(rng.randrange(0, 9))] + notice
        got, want = sorted(index.scan(words)), brute_places(words, licenses.TEMPLATES)
        assert got == want
        some += len(want)
    assert some > 100


def test_licence_query(spark):
    """The registered query, row by row, against a scan of every start."""
    got = {r["doc_id"]: tuple(r) for r in licenses.op3_license_scan(spark, SF).collect()}
    docs = plain(spark.read.parquet(f"{SF}/documents.parquet"))
    assert len(got) == len(docs)
    for i, t in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        base = {p: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p, _ in licenses.BASE}
        starts = sorted(k for x in base.values() for k in x)
        labels = {label for p, label in licenses.BASE if base[p]}
        places = brute_places([x.encode() for x in w], licenses.TEMPLATES)
        score = max([0.5 if labels else 0.0, *(x[3] for x in places)])
        assert got[i] == (i, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in places})), score)


def test_common_words_hide_no_place():
    """The rarest words stand elsewhere in the file; the notice has other words in their places."""
    model = licenses.TEMPLATES[4][1].split()
    index = licenses.Index({})
    rare = [w.decode() for w, _ in index.by_rarity[4] if w.decode() not in "permission is hereby granted free of charge"][:4]
    words = [*rare, *["x"] * 60, *("other" if w in rare else w for w in model)]
    assert "mit" in {p[0] for p in index.scan(licenses.words_of(" ".join(words)))}


def brute_lines(rows, least=20, least_docs=3):
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(WHITE))
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(low(x)) >= least:
                holders.setdefault(low(x), set()).add(-1 if i is None else i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(h := holders.get(low(x), ())) >= least_docs and max(h) != (-1 if i is None else i))]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    docs = wild(documents(spark), "ld_key", "ld_doc", "ld_text", "ld_keys", "ld_row", "line")
    want = brute_lines(plain(docs))
    got = lines.dedup(docs)
    assert got.columns == docs.columns
    assert ordered((i, t or "") for i, t in plain(got)) == ordered((i, t) for i, _, _, t in want)
    assert any(n for _, _, n, _ in want)
    for batches in (1, 7):
        assert ordered((i, t or "") for i, t in plain(lines.dedup(docs, batches=batches))) == ordered((i, t) for i, _, _, t in want)
    # Rows that share an id get their own keys only.
    own = [f"row {i} has a long line of its own" for i in range(50)]
    shared = spark.createDataFrame([(None, x) for x in own] + [(k, "\n".join(own)) for k in (1, 2)], "doc_id long, text string")
    assert sorted(len(r["ld_keys"]) for r in lines.drops(shared).collect()) == [1] * 50 + [50]
    assert lines.dedup(empty(spark)).count() == 0
    n = {r["doc_id"]: r["n_chars"] for r in got.collect()}
    assert n[6] == 3


def test_runs_are_levelled(spark):
    runs = lines.Runs(spark, fanout=2)
    for day in range(5):
        runs.add(spark.createDataFrame([(bytes([k]), 100 - day) for k in range(day, day + 3)], "ld_key binary, ld_doc long"), 3)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    got = {r["ld_key"][0]: (r["ld_n"], r["ld_last"]) for r in runs.rows().collect()}
    assert got[2] == (3, 100) and got[0] == (1, 100) and got[6] == (1, 96)


def brute_spans(rows):
    no = -(2**63)
    key = lambda i: no if i is None else i
    cut = [(i, t, u := spans.units(spans._raw(t)), list(spans.spans(u))) for i, t in rows]
    first = {}
    for i, _, _, s in cut:
        for _, _, k in s:
            first[k] = min(first.get(k, key(i)), key(i))
    out = []
    for i, t, u, s in cut:
        seen, gone = set(), set()
        for at, n, k in s:
            if k in seen or first[k] < key(i):
                gone |= set(range(at, at + n))
            seen.add(k)
        out.append((i, b"".join(x for j, x in enumerate(u) if j not in gone).decode() if gone else t))
    return out


def test_span_dedup(spark):
    docs = wild(documents(spark), "sp_doc", "sp_spans", "sp_row", "sp_text", "sp_text_2", "sp_g")
    got = spans.dedup(docs)
    assert got.columns == docs.columns
    assert ordered(plain(got)) == ordered(brute_spans(plain(docs)))
    by = dict(plain(got))
    assert PASSAGE in by[11] and PASSAGE[:40] not in by[12]
    assert spans.dedup(empty(spark)).count() == 0


def cut_sentences(t):
    """Sentences end at . ! ? before white space, and at line ends; long ones are cut every 12 words."""
    out, start, i = [], 0, 0
    while i < len(t):
        j = i
        while j < len(t) and t[j] in WHITE:
            j += 1
        if j > i and ((i and t[i - 1] in ".!?") or "\n" in t[i:j]):
            out.append(t[start:j])
            start = j
        i = max(j, i + 1)
    units = []
    for u in [*out, t[start:]]:
        words = re.findall(r"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", u)
        lead = u[: len(u) - sum(map(len, words))]
        units += [(lead if k == 0 else "") + "".join(words[k : k + 12]) for k in range(0, max(1, len(words)), 12)]
    return [u for u in units if u]


def brute_words(rows):
    """Units of which every word is in a run of 20 words that stands earlier, too, word by word."""
    split = [(i, cut_sentences(t), [w.lower() for w in t.split()]) for i, t in rows]
    runs = [[tuple(w[k : k + 20]) for k in range(len(w) - 19)] for _, _, w in split]
    first = {}
    for (i, _, _), r in zip(split, runs, strict=True):
        for x in r:
            first[x] = min(first.get(x, i), i)
    out = []
    for (i, u, _), r in zip(split, runs, strict=True):
        seen, gone, kept, at = set(), set(), [], 0
        for k, x in enumerate(r):
            if first[x] < i or x in seen:
                gone |= set(range(k, k + 20))
            seen.add(x)
        for piece in u:
            n = len(piece.split())
            if not n or not set(range(at, at + n)) <= gone:
                kept.append(piece)
            at += n
        out.append((i, "".join(kept)))
    return out


def pasted():
    """A passage of 60 words in 40 documents, after 0 to 39 words of the same sentence."""
    passage = " ".join(f"p{i}" + ("." if i % 17 == 16 else "") for i in range(60))
    return [(i, " ".join([*(f"a{i}x{k}" for k in range(i)), passage, *(f"b{i}x{k}" for k in range(40 - i))])) for i in range(40)] + [(50, "ü " * 30 + "end. " + passage[:200]), (51, "")]


@pytest.mark.parametrize("hot", [spans.HOT, 3])
def test_passages_in_the_middle_of_sentences(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    rows = pasted()
    got = plain(spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert ordered(got) == ordered(brute_words(rows))
    left = {i: sum(w.strip(".") in {f"p{k}" for k in range(60)} for w in t.split()) for i, t in got}
    assert left[0] == 60 and max(left[i] for i in range(1, 40)) <= 22


def test_units_are_the_text():
    for t in ["", "\n\n", "a. b? c!\n d", "x " * 100, "  lead. " + "y " * 40 + ".", "no end", "e.g. 3.5 é。\r\n"]:
        u = spans.units(t.encode())
        assert b"".join(u) == t.encode() and [x.decode() for x in u] == cut_sentences(t)
    long = " ".join(f"v{i}" for i in range(70))
    assert len(spans.units(long.encode())) == 6
    assert [n for _, n, _ in spans.spans(spans.units(long.encode()))] == [2] * 5


def test_digest_of_kept_lines(spark):
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(b"\n".join(lines.kept_lines(None, None, 20)[1])).hexdigest()
