"""The Merkle manifest against a recursive one in plain Python."""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from flowspark.llm import merkle

from .cases import SCHEMA, documents, empty, wild


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text) -> str:
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The last node, and for each node what stands left and right of it on the way up."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
    top, above = tree([h(*r) for r in runs])
    return top, [[("".join(r[:i]), "".join(r[i + 1 :])), *above[k]] for k, r in enumerate(runs) for i in range(len(r))]


def expected(rows, change):
    """(doc_id, leaf, subroot, root, proof digest, folded root) of each row."""
    by = defaultdict(list)
    for r in rows:
        by["0" if r["source"] is None else "1" + r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, change(r["text"])), r["doc_id"]))
    names = sorted(by, key=str.encode)
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in names}
    root, across = tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, across, strict=True):
        for x, inside in zip(sorted(by[s]), trees[s][1], strict=True):
            own = x[3]
            for left, right in inside + up:
                own = h(left, own, right)
            out.append((x[4], x[2], trees[s][0], root, h(*(a + b for a, b in inside + up)), own))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_levels", [1, 2, 3])
def test_against_plain_python(spark, block_levels):
    sizes = {"a": 1, "b": 16, "c": 17, "d": 300, "é": 33, "": 2, None: 20}
    rows = [(i if i % 7 else None, f"Text {i % 40}", "en", s, None if i % 3 else i) for s, n in sizes.items() for i in range(n)]
    rows += [(i, "Lone", None, f"s{i:02}", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(documents(spark))
    made = merkle.manifest(wild(docs.repartition(5), "grp", "pos", "leaf", "checked", "row"), F.lower("text"), block_levels).proofs().collect()
    mine = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], h(r["proof"]), r["folded_root"]) for r in made), key=str)
    assert mine == expected(docs.collect(), lambda t: t if t is None else t.lower())


def test_untouched_rows_lead_to_the_root(spark):
    docs = documents(spark)
    made = merkle.manifest(docs).proofs().collect()
    assert len(made) == docs.count() and all(r["folded_root"] == r["root"] for r in made)
    assert merkle.manifest(empty(spark)).proofs().count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "x", "en", "a", 1)], SCHEMA)).proofs().collect()
    assert [(r["leaf"], r["proof"]) for r in one] == [(one[0]["root"], "")]
