"""Documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG_LINE = "a line that many documents hold alike"
PASSAGE = "The old mill stood by the river for many years. Nobody had worked in it since the flood came down the valley. Its wheel was broken and its doors were shut."


def words(seed: int, n: int) -> str:
    x, out = seed + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("w" + str(x % 5000))
    return " ".join(out)


def documents(spark):
    base = words(3, 200)
    near = base.split()
    near[5] = "changed"
    rows = [
        (1, base, "en", "a"), (2, " ".join(near), "en", "a"), (3, base, "en", "b"), (3, base, "en", "b"), (4, None, "en", "a"), (5, "", None, None), (None, words(9, 40), "de", None), (None, None, None, "c"),
        (6, f"x\n{LONG_LINE}\ny", "en", "c"), (7, f"{LONG_LINE.upper()} \n{LONG_LINE}\nend", "en", "c"), (8, f"\t{LONG_LINE}\n\n", "en", "a"), (9, "short", "en", "b"), (10, "short", "en", "b"),
        (11, words(20, 30) + ". " + PASSAGE + " " + words(21, 30) + ".", "fr", "b"), (12, PASSAGE + " " + words(22, 20), "fr", "c"), (13, words(30, 6000), "en", "a"), (14, "été ÉTÉ 中文 😀 " * 12, "fr", "c"),
        (15, "Licensed under the Apache License, Version 2.0. All rights reserved.", "en", "a"), (16, "<|endoftext|> it's don't 's", "en", "b"),
    ]
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def wild(df, *names: str):
    """df with extra columns of names that an operator might use itself."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(n) for n in names})


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
