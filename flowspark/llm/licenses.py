"""License scans over a positional index of rare licence words.

Templates are indexed by word: postings of (template, position). A first pass counts in how
many documents of the corpus each word of that bounded vocabulary occurs (its IDF). The scan
then takes, per file and template, the highest-IDF template words that the file holds, looks up
all their places, and intersects the template's postings by relative position: places that agree
on where the template would start, give or take SLACK words, vote for that start. So many words
are looked up that those left cannot make up LEAST_SCORE of the template without SPARE votes: no
place is missed, however common its words are. Starts of enough votes are verified: the template's
mandatory key phrases must stand where the template puts them, give or take SLACK words, and the
share of template words that stand in order, each within SLACK words of its place, is the score.
Of starts next to each other the best one is reported, the first of equals.

Null texts are empty; texts without words have no places, null first and last word, empty label
lists and score 0. Rows are scanned one by one, so repeated rows give repeated results. Only
`doc_id` and `text` are read. Ties in IDF go to the word first in byte order.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_rows, read_table

#: Fixed phrases whose places are counted, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (label, licence wording, mandatory key phrases); wording from the licences' own public notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software foundation", "gnu general public license")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related rights to this work", ("waived all copyright",)),
)
SLACK = 3
LEAST_SCORE = 0.6
#: Votes that a start needs at least, where the template's held words allow so many.
SPARE = 3

#: Digits, letters (lower-cased) and all non-ASCII bytes stay; every other byte ends a word.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Index:
    """Postings of the templates, with the corpus's IDF for their words."""

    def __init__(self, idf: dict[bytes, float], templates=TEMPLATES):
        self.templates = [(label, text.encode().split(), [p.encode().split() for p in phrases]) for label, text, phrases in templates]
        self.vocabulary = frozenset(w for _, words, _ in self.templates for w in words)
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _) in enumerate(self.templates):
            for q, w in enumerate(words):
                self.postings[w].append((t, q))
        rank = lambda w: (-idf.get(w, math.inf), w)
        self.by_rarity = [sorted(Counter(words).items(), key=lambda x: rank(x[0])) for _, words, _ in self.templates]
        self.phrase_at = [[(p, [q for q in range(len(words) - len(p) + 1) if words[q : q + len(p)] == p]) for p in phrases] for _, words, phrases in self.templates]

    def looked_up(self, present: frozenset[bytes] | set[bytes]) -> tuple[dict[bytes, set[int]], dict[int, int]]:
        """Words to look up, each with its templates, and the votes that a start of a template needs."""
        wanted: dict[bytes, set[int]] = defaultdict(set)
        votes = {}
        for t, rare in enumerate(self.by_rarity):
            need = least_words(len(self.templates[t][1]))
            held = [(w, n) for w, n in rare if w in present]
            left = sum(n for _, n in held)
            if left < need:
                continue
            for w, n in held:
                if need - left >= SPARE:
                    break
                wanted[w].add(t)
                left -= n
            votes[t] = max(1, need - left)
        return wanted, votes

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, number of words, score) of every verified template place."""
        present = self.vocabulary.intersection(words)
        wanted, need = self.looked_up(present) if present else ({}, {})
        if not need:
            return []
        votes: dict[int, Counter[int]] = defaultdict(Counter)
        for p, w in enumerate(words):
            if w in wanted:
                for t, q in self.postings[w]:
                    if t in wanted[w]:
                        votes[t][p - q] += 1
        found = []
        for t, cast in votes.items():
            near: Counter[int] = Counter()
            for start, n in cast.items():
                for d in range(-SLACK, SLACK + 1):
                    near[start + d] += n
            scored = [(s, x) for s in sorted(near) if near[s] >= need[t] and (x := self.score(words, t, s)) is not None]
            label, model, _ = self.templates[t]
            found += [(label, max(s, 0), len(model), x) for s, x in peaks(scored)]
        return found

    def score(self, words: list[bytes], t: int, start: int) -> float | None:
        """The score of a template's start, null where it is no place."""
        _, model, _ = self.templates[t]
        if not all(self._stands(words, start, p, qs) for p, qs in self.phrase_at[t]):
            return None
        same = in_order(words, model, start)
        return same / len(model) if same >= least_words(len(model)) else None

    @staticmethod
    def _stands(words: list[bytes], start: int, phrase: list[bytes], places: list[int]) -> bool:
        n = len(phrase)
        return any(words[at : at + n] == phrase for q in places for at in range(max(0, start + q - SLACK), start + q + SLACK + 1))


def least_words(n: int) -> int:
    """Words in place that make up LEAST_SCORE of n."""
    return math.ceil(n * LEAST_SCORE - 1e-9)


def in_order(words: list[bytes], model: list[bytes], start: int) -> int:
    """The most words of the model that stand in order, each within SLACK words of its place."""
    width = 2 * SLACK + 1
    best = [0] * (width + 1)  # best[d]: the most up to the model's last word, ending before start + q + d - SLACK
    for q, w in enumerate(model):
        # One word on, each place is one drift less.
        best = [*best[1:], best[-1]]
        row = best[:]
        for d in range(width):
            at = start + q + d - SLACK
            if 0 <= at < len(words) and words[at] == w:
                row[d + 1] = max(row[d + 1], best[d] + 1)
        for d in range(1, width + 1):
            row[d] = max(row[d], row[d - 1])
        best = row
    return best[-1]


def peaks(scored: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """Of (start, score) in order, the best of each run of starts at most SLACK apart."""
    out: list[tuple[int, float]] = []
    last = None
    for s, x in scored:
        if last is not None and s - last <= SLACK:
            out[-1] = max(out[-1], (s, x), key=lambda y: y[1])
        else:
            out.append((s, x))
        last = s
    return out


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """word, df over all documents, for the templates' vocabulary: at most its size in rows."""
    vocabulary = frozenset(w for _, text, _ in templates for w in text.encode().split())

    def run(cols: dict[str, list]) -> dict[str, list]:
        n: Counter[bytes] = Counter()
        for text in cols["text"]:
            n.update(vocabulary.intersection(words_of(text)))
        return {"word": [w.decode() for w in n], "df": list(n.values())}

    return map_rows(docs.select("text"), run, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


def build_index(docs: DataFrame, templates=TEMPLATES) -> Index:
    """The index with IDF over all of docs; what reaches the driver is bounded by the vocabulary."""
    n = docs.count()
    idf = {r["word"].encode(): math.log((1 + n) / (1 + r["df"])) for r in document_frequencies(docs, templates).collect()}
    return Index(idf, templates)


def base_places(words: list[bytes]) -> tuple[list[int], set[str]]:
    """Starts of the base phrases, and the labels found."""
    text = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in BASE:
        needle = b" " + phrase.encode() + b" "
        at, seen, passed = text.find(needle), 0, 0
        while at >= 0:
            passed += text.count(b" ", seen, at)
            seen = at
            starts.append(passed)
            labels.add(label)
            at = text.find(needle, at + 1)
    return starts, labels


def scan(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")}
        for text in cols["text"]:
            words = words_of(text)
            starts, base = base_places(words)
            places = sent.value.scan(words)
            out["n_words"].append(len(words))
            out["n_base"].append(len(starts))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | {p[0] for p in places})))
            out["score"].append(max([0.5 if base else 0.0, *(p[3] for p in places)]))
            out["places"].append([{"label": a, "word": b, "size": c} for a, b, c, _ in sorted(places)])
        return {"doc_id": cols["doc_id"]} | out

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {fields['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label: string, word: long, size: long>>")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, build_index(docs)).drop("places")
