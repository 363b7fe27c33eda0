"""URL filters by a Bloom filter cascade.

A block list of host keys is tested exactly, without a join. The universe is every key of the
corpus: the hosts of all urls and their parent domains, distinct. Level 0 of the cascade is a
Bloom filter of the listed keys that occur in the universe; level 1 holds the universe's other
keys that level 0 takes for listed; level 2 the listed ones that level 1 takes for unlisted; and
so on until a level errs for no key. The first level that doesn't hold a key decides: it is
listed if that level's number is odd. Over the universe this is exact.

All steps are DataFrame expressions: a level's bits come from a bitwise aggregate over word
numbers and are read as one binary literal. A filter has BITS_PER_KEY bits for each of its keys.
Level 0 holds only listed keys, and a later level only keys that the one before takes wrongly,
so all levels together take little more than one byte for each listed key that occurs in the
corpus, however large the corpus is: the block list, a parameter, bounds what is sent to executors.

Host and path of a url: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or
the end, with A-Z lower-cased; the path follows up to ``?``, ``#`` or the end. A null url, or one
without ``://``, has neither, and both are empty texts. Rules (host/path) come before the
list: a rule fits its host and all subdomains if the path starts with the rule's, and the
longest rule wins. Repeated rows are separate rows; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import sys
from array import array
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posthorn.plans.scratch import materialise

#: (verdict, host/path). Fixed values.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Domains that the query's block list names; each stands for all its subdomains. Fixed values.
LISTED = tuple(
    f"{name}.example.{end}" for name in ("adult-x", "casino-win", "cheap-pills", "spam-farm") for end in ("com", "net", "org")
)
BITS_PER_KEY = 8
HASHES = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest fitting rule as struct<verdict, rule>, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        h, p = rule.split("/", 1)
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def keys_of(host: Column) -> Column:
    """A host and its parent domains."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 32 bits for each four bytes, the highest bit of a word first."""

    number: int
    bits: bytes


def _places(key: Column, number: int, bits: int) -> Column:
    """The bit numbers of a key in a level: array<long>."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(number * HASHES + k), key), F.lit(bits)) for k in range(HASHES)))


def holds(level: Level, key: Column) -> Column:
    """Whether a level's filter holds a key."""
    words = F.lit(level.bits)

    def is_set(b: Column) -> Column:
        word = F.conv(F.hex(F.substring(words, F.shiftright(b, 5).cast("int") * 4 + 1, F.lit(4))), 16, 10).cast("long")
        return F.getbit(word, b.bitwiseAND(F.lit(31).cast("long")).cast("int")) == 1

    return F.forall(_places(key, level.number, 8 * len(level.bits)), is_set)


def _build(keys: DataFrame, number: int, count: int) -> Level:
    """The filter of the ``count`` distinct keys of ``keys``, from a bitwise aggregate."""
    n = -(-count * BITS_PER_KEY // 32)
    place = keys.select(F.explode(_places(F.col("key"), number, 32 * n)).alias("b"))
    rows = (
        place.groupBy(F.shiftright("b", 5).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("bits")).collect()
    )
    words = array("I", bytes(4 * n))
    for r in rows:
        words[r.w] = r.bits
    if sys.byteorder == "little":
        words.byteswap()
    return Level(number, words.tobytes())


def universe(hosts: DataFrame) -> DataFrame:
    """Every key of the distinct hosts of ``hosts``, written once."""
    distinct = hosts.select("host").distinct()
    return materialise(distinct.select(F.explode(keys_of(F.col("host"))).alias("key")).distinct(), "url-keys")


def cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """Levels that tell the ``listed`` keys from all others, exactly for every key of ``universe``."""
    present = materialise(universe.join(listed.select("key").distinct(), "key", "left_semi"), "url-listed")
    mine, others = present, universe.join(present, "key", "left_anti")
    levels: list[Level] = []
    count = mine.count()
    while count:
        level = _build(mine, len(levels), count)
        levels.append(level)
        mine, others = materialise(others.where(holds(level, F.col("key"))), "url-false"), mine
        count = mine.count()
    return levels


def is_listed(levels: list[Level], key: Column) -> Column:
    """Exact membership for keys of the universe."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~holds(level, key), F.lit(level.number % 2 == 1)).otherwise(out)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``listed`` (what the list says) of every url.

    ``listed`` has one column ``key``: hosts and domains to block, subdomains included.
    """
    parts = pages.select(pages[key].alias("id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    levels = cascade(universe(parts), listed)
    told = parts.withColumn("listed", F.exists(keys_of(F.col("host")), lambda k: is_listed(levels, k)))
    told = told.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fit.verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return told.select(F.col("id").alias(key), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "listed")


def listed_frame(spark: SparkSession, keys: tuple[str, ...] = LISTED) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")
