"""The quoting rule's orders against a plain automaton, and spans of captures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators import convert, validate

from .conftest import rows


def lived(targets, fills):
    """(seq, side, action, ticks, order_id) of one symbol."""
    out = []
    for i, side in enumerate(("bid", "ask")):
        open_, n = None, 0
        for seq, *want in targets:
            if open_ is not None and (seq, side) in fills:
                out.append((seq, side, "fill", open_, n))
                open_ = None
            if want[i] != open_:
                if open_ is not None:
                    out.append((seq, side, "cancel", open_, n))
                if want[i] is not None:
                    n += 1
                    out.append((seq, side, "submit", want[i], n))
                open_ = want[i]
    return out


@pytest.mark.parametrize("chunk", [3, 1 << 16])
def test_order_life(spark, monkeypatch, chunk):
    monkeypatch.setattr(convert, "CHUNK", chunk)
    rng = random.Random(chunk)
    targets, fills, want = [], [], []
    for symbol in "ab":
        own, filled = [], set()
        for seq in range(0, 120, 2):
            void = rng.random() < 0.1
            own.append((seq, None if void else rng.randint(1, 3), None if void else rng.randint(5, 7)))
            filled |= {(seq, s) for s in ("bid", "ask") if rng.random() < 0.15}
        targets += [(symbol, *t) for t in own]
        fills += [(symbol, *f) for f in filled] + [(symbol, *min(filled))]
        want += [(symbol, *x) for x in lived(own, filled)]
    life = convert.order_life(spark.createDataFrame(targets, "symbol string, seq long, bid_ticks long, ask_ticks long"), spark.createDataFrame(fills, "symbol string, seq long, side string"), ("symbol",))
    assert rows(life.select("symbol", "seq", "side", "action", "ticks", "order_id")) == sorted(want)
    for r in convert.order_counts(life, ("symbol",)).collect():
        n = {a: sum(x[0] == r["symbol"] and x[3] == a for x in want) for a in ("submit", "cancel", "fill")}
        assert (r["n_submitted"], r["n_canceled"], r["n_filled"]) == tuple(n.values())
        assert r["n_open"] == n["submit"] - n["cancel"] - n["fill"] >= 0


def test_short_captures_are_insufficient(spark):
    states = spark.createDataFrame([("a", 0), ("a", 1_799_000_000_000), ("b", 5), ("b", 5 + 1_800_000_000_000), ("c", 7)], "symbol string, ts_event_ns long")
    drawn = spark.createDataFrame([(s, "weak") for s in "abcd"], "symbol string, conclusion string")
    got = rows(validate.qualified(drawn, states, ("symbol",)).select("symbol", "span_s", "insufficient"))
    assert got == [("a", 1799.0, True), ("b", 1800.0, False), ("c", 0.0, True), ("d", 0.0, True)]
    assert validate.qualified(drawn, states.where(F.lit(False)), ("symbol",)).where("insufficient").count() == 4
