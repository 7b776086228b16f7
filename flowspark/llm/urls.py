"""URL filters by Bloom filter cascades.

A `Cascade` answers "is this key listed?" exactly for every key of the universe it was built
over, here all the keys that the corpus's own URLs can look up. Level 0 encodes the listed
keys; level 1 the universe's false positives at level 0; level 2 the listed keys that level 1
takes for false positives; and so on until a level has none. A lookup walks the levels until
one does not hold the key: no join, and only the levels' bits travel. Level 0 is the finer the
larger the universe is against the list, so that its false positives are about as many as listed
keys: all levels' size follows from the list. A long list is split by ranges of the key's hash
into cascades of levels of bloom.MAX_BITS at most; together they have MAX_BYTES at most, or the
list (of some forty million keys) is refused.

Null urls and urls without `://` have empty host and path, fit no rule and are blocked, as
nothing can be fetched from them. Rows are judged one by one: repeated rows get equal verdicts,
empty tables give empty results, and only `page_id` and `url` are read. Of two rules of equal
length that fit, the one with the longer host wins. Null keys of a list are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from ._common import read_table, remove, written, new_path

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Bytes of all levels of one list at most, as they are broadcast.
MAX_BYTES = 1 << 28
#: Words of a host (split at dots and hyphens) that the method's own list blocks.
LISTED_WORDS = ("casino", "escort", "pills", "porn", "spam", "viagra", "warez", "xxx")


class Cascade:
    """Levels of (bits, number of hashes, packed bits)."""

    def __init__(self, levels: list[bloom.Level]):
        self.levels = levels

    @property
    def n_bytes(self) -> int:
        return sum(bits.nbytes for _, _, bits in self.levels)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Membership of keys given by their two 64-bit hashes; exact within the universe."""
        out = np.full(len(h1), len(self.levels) % 2 == 1)
        alive = np.arange(len(h1))
        for i, level in enumerate(self.levels):
            held = bloom.holds(level, turned(h1[alive], i), turned(h2[alive], i))
            out[alive[~held]] = i % 2 == 1
            alive = alive[held]
        return out


def turned(h: np.ndarray, level: int) -> np.ndarray:
    """A hash's bits turned by the level, so that levels of one size don't repeat each other's errors."""
    by, u = np.uint64(11 * level % 64), h.view(np.uint64)
    return h if not by else ((u >> by) | (u << (np.uint64(64) - by))).view(np.int64)


def _turned(keys: DataFrame, level: int) -> DataFrame:
    """The same of the columns h1 and h2."""
    by = 11 * level % 64
    turn = lambda c: F.shiftrightunsigned(c, by).bitwiseOR(F.shiftleft(c, 64 - by)) if by else F.col(c)
    return keys.withColumns({c: turn(c) for c in ("h1", "h2")})


def hashes(key: Column, level_seed: int = 0) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(level_seed + 1), key)


class Ranges:
    """Cascades by ranges of the first hash."""

    def __init__(self, parts: list[Cascade]):
        self.parts = parts

    @property
    def n_bytes(self) -> int:
        return sum(p.n_bytes for p in self.parts)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        at = (h1.view(np.uint64) >> np.uint64(48)) * np.uint64(len(self.parts)) >> np.uint64(16)
        for i, part in enumerate(self.parts):
            mine = np.flatnonzero(at == i)
            if len(mine):
                out[mine] = part.contains(h1[mine], h2[mine])
        return out


def _level(keys: DataFrame, n: int, p: float, i: int) -> bloom.Level:
    return bloom.build(_turned(keys, i), bloom.n_bits(n, p), max(1, round(math.log2(1 / p))))


def build(universe: DataFrame, listed: DataFrame, max_bits: int | None = None) -> Ranges:
    """Cascades for the string column `key` of `listed`, exact over `key` of `universe`."""
    spark = universe.sparkSession
    h1, h2 = hashes(F.col("key"))
    path = new_path(spark, "cascade-listed")
    yes = written(listed.where("key is not null").select("key").distinct().select("key", h1.alias("h1"), h2.alias("h2")), "", path)
    n = yes.count()
    if not n:
        return Ranges([Cascade([])])
    keys = universe.where("key is not null").select("key", h1.alias("h1"), h2.alias("h2"))
    # Level 0 lets about as many of the universe's keys pass as there are listed ones.
    asked = keys.agg(F.approx_count_distinct("h1")).first()[0]
    first = max(2.0**-40, min(1 / 64, n / max(1, asked)))
    if (size := bloom.n_bits(n, first)) * 2 > MAX_BYTES * 8:
        raise OverflowError(f"{n} listed keys take {size} bits or more; the bound is {MAX_BYTES} bytes")
    n_parts = -(-size // (max_bits or bloom.MAX_BITS))
    made = []
    for r in range(n_parts):
        mine = F.shiftright(F.shiftrightunsigned("h1", 48) * n_parts, 16) == r
        made.append(_cascade(keys.where(mine) if n_parts > 1 else keys, yes.where(mine) if n_parts > 1 else yes, first))
    out = Ranges(made)
    if out.n_bytes > MAX_BYTES:
        raise OverflowError(f"cascades of {out.n_bytes} bytes; the bound is {MAX_BYTES}")
    remove(spark, path)
    return out


def _cascade(keys: DataFrame, yes: DataFrame, first: float, max_levels: int = 40) -> Cascade:
    spark = keys.sparkSession
    n = yes.count()
    if not n:
        return Cascade([])
    levels = [_level(yes, n, first, 0)]
    # The universe's false positives: only what level 0 holds is ever compared with the list.
    paths = [new_path(spark, "cascade-false")]
    held = _filtered(keys, levels[0], 0).distinct()
    members, others = yes, written(held.join(yes.select("key"), "key", "left_anti").select("key", "h1", "h2"), "", paths[0])
    while (n := others.count()) and len(levels) < max_levels:
        levels.append(_level(others, n, 1 / 4, len(levels)))
        paths.append(new_path(spark, "cascade-level"))
        left = written(_filtered(members, levels[-1], len(levels) - 1), "", paths[-1])
        members, others = others, left
    if n:
        raise RuntimeError("keys of equal hashes on both sides")
    remove(spark, *paths)
    return Cascade(levels)


def _filtered(keys: DataFrame, level: bloom.Level, i: int) -> DataFrame:
    """The rows whose key the level holds."""
    sent = keys.sparkSession.sparkContext.broadcast(level)
    at1, at2 = keys.columns.index("h1"), keys.columns.index("h2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(bloom.holds(sent.value, turned(np.asarray(b.column(at1)), i), turned(np.asarray(b.column(at2)), i))))

    return keys.mapInArrow(run, keys.schema)


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1) - at - 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def candidate_keys(host: Column, path: Column, rules: Iterable[str]) -> Column:
    """Every key of a url that could be a rule: its host's last labels and its path's prefixes,
    for the label counts and path lengths that rules have; longest key, then longest host, first."""
    shapes = {(h.count(".") + 1, len(r) - len(h)) for r in rules for h in [r.partition("/")[0]]}
    made = [
        F.when(
            (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= n) & (host != ""),
            F.struct(
                (F.length(F.substring_index(host, ".", -labels)) + n).alias("size"),
                F.length(F.substring_index(host, ".", -labels)).alias("host_size"),
                F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, n)).alias("key"),
            ),
        )
        for labels, n in sorted(shapes)
    ]
    return F.transform(F.reverse(F.array_sort(F.array_compact(F.array(*made)))), lambda x: x["key"])


def suffixes(host: Column, most: int) -> Column:
    """The host and its parent domains of at most `most` labels."""
    n = F.least(F.size(F.split(host, r"\.")), F.lit(most))
    return F.when((host != "") & (n > 0), F.transform(F.sequence(F.lit(1), n), lambda k: F.call_function("substring_index", host, F.lit("."), -k))).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, words: Iterable[str] = LISTED_WORDS, hosts: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each page. Where no rule fits, a page is blocked
    for a listed word of its host, or for its host or a parent domain in `hosts` (column `key`)."""
    spark = pages.sparkSession
    host, path = parsed(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("words", F.array_remove(F.array_distinct(F.split("host", r"[.\-]")), ""))
    frame = lambda keys: spark.createDataFrame([(k,) for k in sorted(keys)], "key string")
    over_keys, over_words = rows.select(F.explode("keys").alias("key")), rows.select(F.explode("words").alias("key"))
    built = {
        "allow": build(over_keys, frame(k for k, v in rules.items() if v == "allow")),
        "block": build(over_keys, frame(k for k, v in rules.items() if v == "block")),
        "words": build(over_words, frame(words)),
    }
    names = ["keys", "words"]
    if hosts is not None:
        most = hosts.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 0
        rows = rows.withColumn("hosts", suffixes(F.col("host"), most))
        built["hosts"] = build(rows.select(F.explode("hosts").alias("key")), hosts)
        names.append("hosts")
    cascades = spark.sparkContext.broadcast(built)
    for name in names:
        rows = rows.withColumns({
            f"{name}_1": F.transform(name, lambda x: hashes(x)[0]),
            f"{name}_2": F.transform(name, lambda x: hashes(x)[1]),
        })
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"page_id {fields['page_id']}, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cascades.value
        for b in batches:
            n = b.num_rows
            col = {x: b.column(i) for i, x in enumerate(b.schema.names)}
            row, hits = _hits(col, "keys", (at["allow"], at["block"]))
            listed = hits[0] | hits[1]
            first = np.full(n, -1)
            idx = np.flatnonzero(listed)[::-1]
            first[row[idx]] = idx  # the earliest, hence longest, key wins
            flat = col["keys"].flatten()
            rule = flat.take(pa.array(np.maximum(first, 0), mask=first < 0)) if len(flat) else pa.nulls(n, pa.string())
            blocked = np.zeros(n, bool)
            for name in names[1:]:
                where, (bad,) = _hits(col, name, (at[name],))
                blocked[where[bad]] = True
            blocked |= np.asarray(pc.equal(col["host"], ""))
            by_rule = first >= 0
            blocked[by_rule] = hits[1][first[by_rule]]
            verdict = pa.array(np.where(blocked, "block", "allow"), pa.string())
            yield pa.RecordBatch.from_arrays([col["page_id"], col["host"], col["path"], rule, verdict], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, schema)


def _hits(col: dict[str, pa.Array], name: str, cascades: tuple[Ranges, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    lists = col[f"{name}_1"]
    sizes = np.diff(np.asarray(lists.offsets))
    row = np.repeat(np.arange(len(lists)), sizes)
    h1, h2 = (np.asarray(col[f"{name}_{i}"].flatten()).astype(np.int64, copy=False) for i in (1, 2))
    return row, [c.contains(h1, h2) if len(h1) else np.zeros(0, bool) for c in cascades]


def membership(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """`keys` with a boolean column `listed`."""
    cascade = keys.sparkSession.sparkContext.broadcast(build(keys, listed))
    h1, h2 = hashes(F.col("key"))

    @F.pandas_udf("boolean")
    def held(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(cascade.value.contains(a.to_numpy(np.int64), b.to_numpy(np.int64)))

    return keys.withColumn("listed", held(h1, h2))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS hh FROM u),
p AS (SELECT page_id, translate(hh, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(hh) + 1), '^[^?#]*') AS path FROM h),
r(rule, rhost, rpath, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
        ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (SELECT p.page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
      FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath) GROUP BY p.page_id)
SELECT p.page_id, host, path, m.rule,
  CASE WHEN m.v IS NOT NULL THEN m.v WHEN host = '' THEN 'block'
       WHEN regexp_matches(host, '(^|[.-])(casino|escort|pills|porn|spam|viagra|warez|xxx)($|[.-])') THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
