"""URL filters by Bloom filter cascades: exact membership of every key of a known universe, without joins.

Level 1 is a Bloom filter of the listed keys. Keys of the universe that it admits
wrongly go into level 2, listed keys that level 2 admits wrongly into level 3, and so
on until a level admits nothing wrongly. A key of the universe is listed if the first
level that rejects it is an even one, or if the last level admits it and is odd.

Filters are built with ``bit_or`` over 64-bit words: Spark reduces keys to words before
anything is shuffled, and a filter is a literal array in the expressions that use it.
Filters hold about ``MAX_BITS`` bits: a longer list is split by a hash of the key into as
many universes as it takes, each with a cascade of its own for the rows of its part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from duelframe.layout import c
from duelframe.session import materialised, remove_folder, shared_folder

#: Bits of a level that one part of the universe is planned for; with it the size of what is sent to the executors.
MAX_BITS = 1 << 21
#: Share of wrong admissions that a level above the first is built for.
LATER_RATE = 0.1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    salt: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def admits(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        out = F.lit(True)
        for p in _positions(key, self.salt, self.bits, self.hashes):
            word = F.element_at(words, (F.shiftright(p, 6) + 1).cast("int"))
            out = out & (_bit(word, p) == 1)
        return out


def _bit(word: Column, position: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, (position % 64).cast("int")).bitwiseAND(F.lit(1))


def _positions(key: Column, salt: int, bits: int, hashes: int) -> list[Column]:
    """Double hashing: ``hashes`` places below ``bits``."""
    first, step = (F.pmod(F.xxhash64(key, F.lit(2 * salt + i)), F.lit(bits)) for i in (0, 1))
    return [(first + step * F.lit(i)) % F.lit(bits) for i in range(hashes)]


def _bits(n: int, rate: float) -> int:
    return 64 * max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))


def _build(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A filter for ``n`` keys."""
    hashes, bits = max(1, round(-math.log2(rate))), _bits(n, rate)
    place = keys.select(F.explode(F.array(*_positions(F.col("key"), salt, bits, hashes))).alias("p"))
    word = place.select(F.shiftright("p", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int")).alias("b"))
    words = [0] * (bits // 64)
    for row in word.groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # at most bits / 64 rows
        words[row["w"]] = row["b"]
    return Level(salt, bits, hashes, tuple(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed. Null keys are not."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            level = self.levels[i - 1].admits(key)
            out = (level & out) if i % 2 else (~level | out)
        return key.isNotNull() & out  # a hash skips nulls, so they would be taken for some key


def _first_rate(n_all: int, n_listed: int) -> float:
    return min(0.5, max(n_listed, 1) / max(n_all - n_listed, 1))


def _sizes(universe: DataFrame) -> tuple[int, int]:
    return universe.agg(F.count(F.lit(1)), F.count(F.when(F.col("listed"), 1))).first()


def build_cascade(universe: DataFrame) -> Cascade:
    """A cascade over (``key``, ``listed``): every key once, none null. Its size follows the list; ``mark_listed`` splits long ones.

    Without listed keys the cascade is empty and contains nothing. The first level is
    built for as many wrong admissions as there are listed keys, so size follows the
    list and only the logarithm of the universe.
    """
    n_all, n_listed = _sizes(universe)
    if not n_listed:
        return Cascade(())
    levels: list[Level] = []
    inside, outside = universe.where("listed"), universe.where(~F.col("listed"))
    count, rate = n_listed, _first_rate(n_all, n_listed)
    while count:
        level = _build(inside, count, rate, len(levels) + 1)
        levels.append(level)
        # The wrongly admitted keys of the other side are the next level's keys.
        inside, outside = outside.where(level.admits(F.col("key"))), inside
        count, rate = inside.count(), LATER_RATE
    return Cascade(tuple(levels))


# --------------------------------------------------------------------------- urls and rules


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first ``://`` and the next ``/``, ``?`` or ``#``, ASCII letters lower-cased;
    path from there to ``?`` or ``#``. Both are empty without ``://`` or for a null url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _LOWER), F.regexp_extract(text, pattern, 2)


def rule_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Every key a rule for this url could have: each parent domain with each path prefix of a length that rules use."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths))]), lambda s: s.isNotNull()
    )
    return F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda s: F.concat(d, s))))


def _longest(keys: Column, member: Callable[[Column], Column]) -> Column:
    """The longest key that is a member, null if there is none."""
    found = F.filter(keys, member)
    return F.reduce(found, F.lit(None).cast("string"), lambda best, k: F.when(best.isNull() | (F.length(k) > F.length(best)), k).otherwise(best))


def _listed(keys: DataFrame, listed: Sequence[str]) -> DataFrame:
    """A universe of distinct keys marked with a short literal list."""
    return keys.select("key", F.col("key").isin(*listed).alias("listed") if listed else F.lit(False).alias("listed"))


def apply_rules(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``action``: the longest rule that fits, both null without one.

    The keys of the rules are encoded in two cascades, of the blocking and of the allowing
    ones, over all keys that the urls could match. Null urls fit no rule; repeated rows are
    judged one by one; an empty table gives an empty result.
    """
    host, path = url_parts(c(url))
    lengths = [len(r.path) for r in rules]
    parts = pages.select(c(key).alias("_k"), host.alias("host"), path.alias("path"))
    keyed = parts.withColumn("_keys", rule_keys(F.col("host"), F.col("path"), lengths) if rules else F.array().cast("array<string>"))
    universe = materialised(keyed.select(F.explode("_keys").alias("key")).distinct())
    by_action = {a: [r.key for r in rules if r.action == a] for a in ("block", "allow")}
    # A filter is smaller than the list of rules, which the caller holds.
    cascades = {a: build_cascade(_listed(universe, keys)) for a, keys in by_action.items()}
    block, allow = cascades["block"], cascades["allow"]
    rule = _longest(F.col("_keys"), lambda k: block.contains(k) | allow.contains(k))
    return keyed.withColumn("rule", rule).select(
        F.col("_k").alias(key),
        "host",
        "path",
        "rule",
        F.when(F.col("rule").isNull(), F.lit(None)).when(block.contains(F.col("rule")), "block").otherwise("allow").alias("action"),
    )


def mark_listed(df: DataFrame, column: str, universe: DataFrame, name: str = "listed") -> DataFrame:
    """Add boolean ``name``: whether ``column`` is a listed key of ``universe`` (``key``, ``listed``; keys distinct).

    Membership is read from cascades. Where the list needs more than ``MAX_BITS`` bits, keys and rows
    are stored in parts by a hash of the key; each part has a cascade and is read, marked and written by
    itself, so neither driver nor executors ever hold more than one. A null is not listed.
    """
    known = materialised(universe.where(F.col("key").isNotNull()))
    n_all, n_listed = _sizes(known)
    # Later levels hold about as many keys as the first.
    need = max(_bits(n_listed, _first_rate(n_all, n_listed)), _bits(n_listed, LATER_RATE))
    parts = math.ceil(need / MAX_BITS) if n_listed else 1
    if parts == 1:
        return df.withColumn(name, build_cascade(known).contains(c(column)))
    spark, folders = df.sparkSession, [shared_folder(df.sparkSession) for _ in range(3)]

    def part(key: Column) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts)), F.lit(0)).cast("int").alias("_part")

    known.select("*", part(F.col("key"))).write.partitionBy("_part").parquet(folders[0])
    df.select(F.struct(*[c(n) for n in df.columns]).alias("_row"), c(column).alias("_key"), part(c(column))).write.partitionBy("_part").parquet(folders[1])
    keys, rows = (spark.read.parquet(f) for f in folders[:2])
    for i in range(parts):
        cascade = build_cascade(keys.where(F.col("_part") == i).drop("_part"))
        marked = rows.where(F.col("_part") == i).select("_row", cascade.contains(F.col("_key")).alias("_in"))
        marked.write.mode("append").parquet(folders[2])
    for folder in folders[:2]:
        remove_folder(spark, folder)
    out = spark.read.parquet(folders[2])
    return out.select(*[F.col("_row").getField(n).alias(n) for n in df.columns], F.col("_in").alias(name))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` for every row of ``pages``.

    A url that a rule fits gets the verdict of the longest one. Any other is judged by its
    host: hosts with more blocked than allowed urls form the block list, encoded in a
    cascade over all hosts. Null urls have empty parts and the verdict of the empty host. Urls of any
    length are judged whole, repeated rows one by one; other columns are not looked at.
    """
    judged = apply_rules(pages, rules, key, url)
    balance = F.sum(F.when(F.col("action") == "block", 1).when(F.col("action") == "allow", -1).otherwise(0))
    hosts = judged.groupBy(F.col("host").alias("key")).agg((balance > 0).alias("listed"))
    marked = mark_listed(judged, "host", hosts)
    verdict = F.coalesce("action", F.when(F.col("listed"), "block").otherwise("allow"))
    return marked.select(c(key), "host", "path", "rule", verdict.alias("verdict"))
