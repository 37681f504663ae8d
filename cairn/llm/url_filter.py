"""URL filters by a Bloom filter cascade, in DataFrame functions only.

A list holds keys: a host and the beginning of a path. The corpus has a known
universe of keys, namely what its urls could be listed under: every suffix of a
host at a dot, with every beginning of the path that has the length of a listed
one. Level 1 encodes the listed keys; of the universe, the keys that level 1
takes for listed ones without cause are encoded in level 2; the listed keys that
level 2 takes in go to level 3, and so on until a level takes in nothing wrong.
Walking the levels then answers exactly for every key of the universe, and an
url is judged in its own row, without a join.

The first level is sized so that about as many wrong keys pass it as there are
listed ones; from then on each level halves what is left. A cascade thus takes a
few bytes a listed key, however large the corpus. A second cascade, of the
blocked keys over all listed ones, tells what a found rule says.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import materialize

#: Listed keys of one cascade: with some 30 bits each, its literals in the plan stay near 16 MB. Longer lists are judged in parts.
PART_KEYS = 1 << 22
#: Bits of one level at most, whatever is to be encoded.
MAX_BITS = 1 << 27
#: Levels after which building gives up; each halves what is left, so 64 are never reached but by a fault.
MAX_LEVELS = 64
#: Bits of one bitmap row, as bitmap_construct_agg has them.
ROW_BITS = 32768
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What lies between the first :// and /, ?, # or the end, A-Z lowered; "" without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    bitmap: bytes
    bits: int
    hashes: int
    seed: int

    def place(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed * 64 + i), key), F.lit(self.bits))

    def takes(self, key: Column) -> Column:
        """Whether all of the key's bits are set; the first that is not ends the test."""
        found = F.lit(True)
        for i in range(self.hashes):
            at = self.place(key, i)
            octet = F.conv(F.hex(F.substring(F.lit(self.bitmap), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            found = found & (F.getbit(octet, (at.bitwiseAND(F.lit(7))).cast("int")) == 1)
        return found


def encode(keys: DataFrame, n: int, seed: int, miss: float) -> Level:
    """A Bloom filter of n distinct keys that takes in a share `miss` of others, or more where MAX_BITS bind."""
    hashes = max(1, min(24, round(-math.log2(miss))))
    bits = max(8, min(MAX_BITS, math.ceil(n * -math.log2(miss) / math.log(2))))
    level = Level(b"", bits, hashes, seed)
    at = keys.select(F.explode(F.array(*[level.place(F.col("key"), i) for i in range(hashes)])).alias("at"))
    rows = at.groupBy((F.shiftright("at", 15)).alias("row")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(ROW_BITS - 1))).alias("bits"))
    bitmap = bytearray((bits + 7) // 8)
    for r in rows.toLocalIterator():
        lo = r["row"] * (ROW_BITS // 8)
        piece = bytes(r["bits"])[: len(bitmap) - lo]
        bitmap[lo : lo + len(piece)] = piece
    return Level(bytes(bitmap), bits, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is a listed one: exact, though each level errs."""
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.takes(key) & ~out
        return out


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of listed (key) over universe (key; repeats are fine, listed keys may be among them or not)."""
    listed = materialize(listed.select("key").where("key is not null").distinct(), "listed")
    n = listed.count()
    if not n:
        return Cascade(())
    universe = universe.select("key").where("key is not null")
    size = universe.agg(F.approx_count_distinct("key")).first()[0] or 1
    levels = [encode(listed, n, 0, min(0.5, n / size / math.sqrt(2)))]
    both = universe.where(levels[0].takes(F.col("key"))).select("key", F.lit(False).alias("of_list")).unionAll(listed.select("key", F.lit(True)))
    rest = materialize(both.groupBy("key").agg(F.max("of_list").alias("of_list")), "undecided")
    while True:
        listed_next = len(levels) % 2 == 0
        mine = F.col("of_list") if listed_next else ~F.col("of_list")
        left = rest.where(mine).count()
        if not left:
            return Cascade(tuple(levels))
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end: MAX_BITS is too small for these keys")
        levels.append(encode(rest.where(mine), left, len(levels), 0.5))
        rest = rest.where(mine | levels[-1].takes(F.col("key")))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts)).cast("int")


def _fits(listed: Cascade, part: int, parts: int) -> Callable[[Column], Column]:
    def fits(p: Column) -> Column:
        found = listed.holds(p["key"])
        return (_part(p["key"], parts) == part) & found if parts > 1 else found

    return fits


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", carry: tuple[str, ...] = ("page_id",), part_keys: int = PART_KEYS) -> DataFrame:
    """Each url's host, path, longest fitting rule and verdict.

    rules: host, path, verdict ("block", or anything else for allow). A rule fits
    its own host and all subdomains, if the url's path starts with the rule's; of
    several the longest (host and path together, in code points) wins, of equally
    long ones that with the longer host. A rule listed as both is a block rule. A-Z
    in rules' hosts are lowered; rules with a null or empty host fit nothing, a
    null path is an empty one, which fits every path. A url that no rule fits is
    not in the list: it gets `default`.

    A null url, or one without ://, has an empty host and path, and no rule.
    Repeated rows are judged each by itself; urls of any length are read whole
    (only suffixes and beginnings that some rule could have are looked up). An
    empty table of pages or rules is fine. Returns the carried columns, host,
    path, rule (null where none fits) and verdict; other columns of pages are left
    out, so their names cannot clash.
    """
    keys = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce(F.col("verdict") == "block", F.lit(False)).alias("blocks")).where("host is not null and host <> ''")
    keys = materialize(keys.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.", -1)).alias("labels"), F.char_length("path").alias("length"), "blocks"), "rules")
    shape = keys.agg(F.count("*").alias("n"), F.max("labels").alias("labels"), F.sort_array(F.collect_set("length")).alias("lengths")).first()
    parts = max(1, -(-shape["n"] // part_keys))
    rows = pages.select(*[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)], host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))

    # whole labels from the right, with the beginnings that have a listed length
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape["labels"] or 1))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    starts = F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in shape["lengths"]]) if shape["lengths"] else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(F.filter(suffixes, lambda s: s != ""), lambda s: F.transform(F.filter(starts, lambda p: p.isNotNull()), lambda p: F.struct(F.concat(s, p).alias("key"), F.char_length(s).alias("host_length")))))
    rows = rows.withColumn("_best", F.lit(None).cast("struct<length:int,host_length:int,key:string,blocks:boolean>"))
    for part in range(parts):
        here = keys.where(_part(F.col("key"), parts) == part) if parts > 1 else keys
        universe = rows.select(F.explode(pairs).alias("pair")).select("pair.key")
        universe = universe.where(_part(F.col("key"), parts) == part) if parts > 1 else universe
        listed = build(here, universe)
        blocked = build(here.where("blocks"), here)

        best = F.array_max(F.transform(F.filter(pairs, _fits(listed, part, parts)), lambda p: F.struct(F.char_length(p["key"]).alias("length"), p["host_length"].alias("host_length"), p["key"].alias("key"))))
        rows = rows.withColumn("_found", best)
        found = F.when(F.col("_found").isNotNull(), F.struct(F.col("_found.length").alias("length"), F.col("_found.host_length").alias("host_length"), F.col("_found.key").alias("key"), blocked.holds(F.col("_found.key")).alias("blocks")))
        rows = rows.withColumn("_best", F.greatest("_best", found)).drop("_found")
        rows = materialize(rows, "judged") if parts > 1 else rows
    verdict = F.when(F.col("_best").isNull(), F.lit(default)).otherwise(F.when(F.col("_best.blocks"), "block").otherwise("allow"))
    return rows.select(*[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)], "host", "path", F.col("_best.key").alias("rule"), verdict.alias("verdict"))
