"""URL filters by a Bloom filter cascade, evaluated by Spark's own expressions.

The first level holds the listed keys, the second those keys of the corpus that pass the first but are not listed, the third
the listed keys that pass the second, and so on until nothing passes. Over the keys that the cascade was built on, which are
all that the corpus can ask for, the answer is exact, and judging a url needs no join.
"""

from __future__ import annotations

import array
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import forget, written

#: Bits that a level may have, as its words travel in the plan: a longer list is split by a hash of the key.
MAX_BITS = 1 << 25
FIRST_RATE, RATE = 0.01, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*+)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*+([^?#]*+)", 1)


def _bits(n: int, rate: float) -> int:
    return max(64, 64 * math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))


@dataclass
class Level:
    bits: int
    hashes: int
    words: str  # the 64-bit words, comma-separated: folded into one array literal by the optimiser

    def _places(self, key: Column, salt: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(salt), F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column, salt: int) -> Column:
        """Whether all of a key's bits are set; the words are in the expression once, whatever the number of hashes."""
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")
        return F.forall(F.array(*self._places(key, salt)), lambda at: F.expr("bigint(1)").bitwiseAND(F.call_function("shiftright", F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int"))) == 1)

    @classmethod
    def over(cls, keys: DataFrame, n: int, rate: float, salt: int) -> Level:
        bits = _bits(n, rate)
        level = cls(bits, min(8, max(1, round(bits / max(n, 1) * math.log(2)))) if n else 1, "")
        at = keys.select(F.explode(F.array(*level._places(F.col("key"), salt))).alias("at"))
        words = at.groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("v"))
        # One row with at most MAX_BITS / 64 words.
        own = words.agg(F.collect_list("w").alias("w"), F.collect_list("v").alias("v")).first()
        held = array.array("q", bytes(bits // 8))
        for w, v in zip(own.w, own.v, strict=True):
            held[w] = v
        level.words = ",".join(map(str, held))
        return level


@dataclass
class Cascade:
    """The levels of the keys that have one value of a hash: a long list has a part for each."""

    parts: list[list[Level]]
    salt: int

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level that does not hold it decides."""
        out = None
        for p, levels in enumerate(self.parts):
            here = F.lit(len(levels) % 2 == 1)
            for i in range(len(levels) - 1, -1, -1):
                here = F.when(~levels[i].holds(key, self.salt + i), F.lit(i % 2 == 1)).otherwise(here)
            out = here if out is None else F.when(_part(key, self.salt, len(self.parts)) == p, here).otherwise(out)
        return out


def _part(key: Column, salt: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt), F.lit(-1)), F.lit(parts))


def build_cascade(listed: DataFrame, universe: DataFrame, salt: int = 0) -> Cascade:
    """The cascade of the keys in listed (key) over the keys in universe (key), which may repeat and may hold listed ones.

    The universe is read once for each part of the list: what passes the first level and is not listed is kept, distinct, and
    is small. Null keys are never listed. An empty list has one level that holds nothing.
    """
    yes = written(listed.where("key is not null").select("key").distinct(), "listed")
    n = yes.count()
    # Parts differ by some square roots of their keys: a tenth is left for that.
    parts = max(1, math.ceil(1.1 * _bits(n, FIRST_RATE) / MAX_BITS)) if _bits(n, FIRST_RATE) > MAX_BITS else 1
    if parts == 1:
        out = Cascade([_levels(yes, n, universe, salt)], salt)
    else:
        of = _part(F.col("key"), salt, parts)
        counts = {r.p: r["count"] for r in yes.groupBy(of.alias("p")).count().collect()}  # a row for each part
        out = Cascade([_levels(yes.where(of == p), counts.get(p, 0), universe.where(of == p), salt) for p in range(parts)], salt)
    forget(yes)
    return out


def _levels(yes: DataFrame, n: int, universe: DataFrame, salt: int) -> list[Level]:
    levels = [Level.over(yes, n, FIRST_RATE, salt)]
    first = universe.where(levels[0].holds(F.col("key"), salt)).select("key").distinct()
    inside, outside = yes, written(first.join(yes, "key", "left_anti"), "passing")
    own = [outside]
    # What the last level holds is `inside`; those of `outside` that pass it make the next level.
    while n := outside.count():
        if len(levels) > 60:
            raise ValueError("the cascade does not end")
        levels.append(Level.over(outside, n, RATE, salt + len(levels)))
        passing = written(inside.where(levels[-1].holds(F.col("key"), salt + len(levels) - 1)), "passing")
        own.append(passing)
        inside, outside = outside, passing
    for x in own:
        forget(x)
    return levels


def candidates(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """The keys that may list a url: suffixes of the host with so many labels, each with prefixes of the path of such lengths."""
    parts = F.split(host, r"\.")
    suffixes = F.array_compact(F.array(*[F.when(F.size(parts) >= n, F.substring_index(host, ".", -n)) for n in labels]))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def _shape(keys: Sequence[str]) -> tuple[list[int], list[int]]:
    hosts = [k.partition("/")[0] for k in keys]
    return sorted({h.count(".") + 1 for h in hosts}), sorted({len(k) - len(h) for k, h in zip(keys, hosts, strict=True)})


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]], blocked: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages (page_id, url).

    rules are (key, verdict), such as ("example.org/en/1", "block"): a host and a prefix of the path. A rule fits its host and
    all subdomains; the longest rule wins, of equally long ones that with the longer host. Without a rule the url is blocked
    if its host or a parent of it is in blocked (key, a host), else allowed. Null urls and urls without :// have an empty
    host and path and are allowed; hosts of any number of labels and urls of any length are judged whole. Each row of pages
    has its row, repeated ones too; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels, lengths = _shape([k for k, _ in rules])
    rows = rows.withColumn("__keys", candidates(F.col("host"), F.col("path"), labels, lengths))
    universe = rows.select(F.explode("__keys").alias("key"))
    chosen = []
    for i, verdict in enumerate(("allow", "block")):
        own = [k for k, v in rules if v == verdict]
        if own:
            chosen.append((verdict, build_cascade(_keys(spark, own), universe, 1000 * (i + 1))))

    def ranked(k: Column) -> Column:
        verdict = F.lit(None).cast("string")
        for name, cascade in chosen:
            verdict = F.when(cascade.has(k), F.lit(name)).otherwise(verdict)
        return F.struct(F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("host"), k.alias("key"), verdict.alias("verdict"))

    best = F.array_max(F.filter(F.transform("__keys", ranked), lambda x: x["verdict"].isNotNull()))
    rows = rows.withColumn("__rule", best)
    verdict = F.lit("allow")
    if blocked is not None:
        own = written(blocked.select(F.translate("key", _UPPER, _LOWER).alias("key")).distinct(), "blocked")
        counts = [r[0] for r in own.select((F.size(F.split("key", r"\."))).alias("n")).distinct().orderBy("n").collect()]
        if counts:
            hosts = candidates(F.col("host"), F.lit(""), counts, [0])
            cascade = build_cascade(own, rows.select(F.explode(hosts).alias("key")), 9000)
            verdict = F.when(F.exists(hosts, cascade.has), F.lit("block")).otherwise(F.lit("allow"))
        forget(own)
    return rows.select("page_id", "host", "path", F.col("__rule.key").alias("rule"), F.coalesce(F.col("__rule.verdict"), verdict).alias("verdict"))


def _keys(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
