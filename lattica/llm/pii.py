"""Personal data: base patterns, and contextual extraction that is bootstrapped from what they find. SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import forget, written

KINDS = ("email", "ip", "card", "phone", "context")
_S = r"\x20\x09-\x0D"
# Java forms of the base patterns. Runs are possessive and start where a run starts or the last match ended (\G), which finds
# the same matches without trying each character of a long run.
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run without white space that has four digits or an @. A unit is one, or the digit groups of a phone or card number.
TOKEN = rf"(?<![^{_S}])(?=(?:[^0-9{_S}]*+[0-9]){{4}}|[^@{_S}]*+@)[^{_S}]++"
UNIT = rf"{PHONE}|(?<![0-9])[0-9](?:[\x20-]?+[0-9]){{15,}}+|{TOKEN}"

#: What a pattern must have: distinct sure instances, and the share of its occurrences that are sure; the score of a sure instance.
MIN_SEEDS, MIN_PATTERN, MIN_INSTANCE = 5, 0.5, 0.8
#: Patterns that travel to all tasks; more are joined by a shuffle.
BROADCAST_PATTERNS = 100_000
#: Matches that are gathered before they are appended to those before them.
STEP = 64
_SPAN = "array<struct<kind:string,start:int,end:int>>"
_HIT = "struct<start:int,hit:string,before:string,after:string>"


def located(text: Column, pattern: str) -> Column:
    """Matches of pattern: start (in code points), hit, and what lies between it and the matches before and after it.

    What lies between matches gives their places. Matches are gathered by STEP, so that a text with many of them does not copy
    all that were found for each one more. The last gap has no hit; a hit is put out when the gap after it is known.
    """
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("hit"))
    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_HIT).alias("last"), F.array().cast(f"array<{_HIT}>").alias("now"), F.array().cast(f"array<array<{_HIT}>>").alias("done"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        last = acc["last"]
        closed = F.array(F.struct(last["start"].alias("start"), last["hit"].alias("hit"), last["before"].alias("before"), x["gap"].alias("after")))
        full = F.size(acc["now"]) >= STEP
        now = F.when(last["hit"].isNull(), acc["now"]).when(full, closed).otherwise(F.concat(acc["now"], closed))
        found = F.struct(start.alias("start"), x["hit"].alias("hit"), x["gap"].alias("before"), F.lit(None).cast("string").alias("after"))
        return F.struct((start + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"), found.alias("last"), now.alias("now"), F.when(full & last["hit"].isNotNull(), F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"))

    return F.aggregate(both, zero, add, lambda acc: F.concat(F.flatten(acc["done"]), acc["now"]))


def _spans(text: Column, pattern: str, kind: str, good, near: str) -> Column:
    """Spans (kind, start, end) of the matches of pattern that are good; texts without near have none."""
    found = F.filter(located(text, pattern), lambda x: good(x["hit"]))
    spans = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["hit"])).alias("end")))
    return F.when(text.rlike(near), spans).otherwise(F.array().cast(_SPAN))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))
    at = F.sequence(F.lit(1), F.length(d))
    total = F.aggregate(at, F.lit(0), lambda acc, i: acc + _luhn_digit(F.substring(d, i, F.lit(1)).cast("int"), i))
    return F.when(F.length(d).between(16, 19), total % 10 == 0).otherwise(False)


def _luhn_digit(v: Column, i: Column) -> Column:
    twice = v * 2
    return F.when(i % 2 == 1, v).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def _ip_part(x: Column) -> Column:
    short = F.ltrim(x, F.lit("0"))
    return F.when(F.length(short) <= 3, F.concat(F.lit("0"), short).cast("int") <= 255).otherwise(False)


def base_spans(text: Column) -> Column:
    """All base spans by kind and start."""
    return F.concat(
        _spans(text, EMAIL, "email", lambda x: F.lit(True), "@"),
        _spans(text, IP, "ip", lambda x: F.forall(F.split(x, r"\."), _ip_part), r"[0-9]\.[0-9]++\.[0-9]"),
        _spans(text, CARD, "card", _luhn, r"[0-9](?:[\x20-]?+[0-9]){15}"),
        _spans(text, PHONE, "phone", lambda x: F.length(_digits(x)).between(8, 15), r"\+[0-9]"),
    )


def _units(text: Column) -> Column:
    """Identifier-like units (start, end, token) with their patterns: the one and two words before and after them.

    A pattern is the words after a mark: <1, <2 before the unit, >1, >2 after it.
    """
    one, two = rf"\A[{_S}]*+([^{_S}]++)", rf"\A[{_S}]*+([^{_S}]++[{_S}]++[^{_S}]++)"

    def pattern(mark: str, words: Column) -> Column:
        return F.when(words != "", F.concat(F.lit(mark), F.regexp_replace(words, f"[{_S}]++", " ")))

    def unit(x: Column) -> Column:
        left, right = F.reverse(F.lower(x["before"])), F.lower(x["after"])
        patterns = F.array(*[pattern(m, w) for m, w in (("<1 ", F.reverse(F.regexp_extract(left, one, 1))), ("<2 ", F.reverse(F.regexp_extract(left, two, 1))), (">1 ", F.regexp_extract(right, one, 1)), (">2 ", F.regexp_extract(right, two, 1)))])
        short = F.ltrim(x["hit"], F.lit("([{<\"'"))
        start = x["start"] + F.length(x["hit"]) - F.length(short)
        token = F.rtrim(short, F.lit(".,;:!?)]}>\"'"))
        return F.struct(start.alias("start"), (start + F.length(token)).alias("end"), token.alias("token"), F.array_compact(patterns).alias("patterns"))

    walk = F.filter(F.transform(located(text, UNIT), unit), lambda u: u["token"] != "")
    return F.when(text.rlike("@|(?:[0-9][^0-9\\x20\\x09-\\x0D]*+){4}|\\+[0-9]|[0-9](?:[\\x20-]?+[0-9]){15}"), walk).otherwise(F.array().cast("array<struct<start:int,end:int,token:string,patterns:array<string>>>"))


def _occurrences(patterns: DataFrame, docs: DataFrame, few: bool) -> DataFrame:
    """(pattern, total): how often the words of each of patterns (pattern) stand in the corpus, whatever is around them.

    The corpus is read once; its words are counted before they are dealt, unless the patterns travel to them.
    """
    keys = patterns.select("pattern", F.substring("pattern", 4, 1 << 30).alias("words"))
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), f"[{_S}]++"), lambda w: w != "")
    w = docs.select(words.alias("w"))
    pairs = F.zip_with("w", F.slice(F.col("w"), 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    every = w.select(F.explode(F.concat("w", F.coalesce(F.filter(pairs, lambda x: x.isNotNull()), F.array().cast("array<string>")))).alias("words"))
    if few:
        total = every.join(F.broadcast(keys.select("words").distinct()), "words").groupBy("words").agg(F.count("*").alias("total"))
    else:
        total = every.groupBy("words").agg(F.count("*").alias("total")).join(keys.select("words").distinct(), "words")
    return keys.join(total, "words").select("pattern", "total")


def _discovered(found: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Spans (doc_id, h, start, end) of units that hold no base match but stand where confirmed patterns stand.

    Bootstrapping: units that hold base matches are the first sure instances. A pattern is confirmed once it stands next to
    MIN_SEEDS distinct sure instances and these make up MIN_PATTERN of all its occurrences in the corpus, whatever else stands
    there. A unit scores one less the product of what its confirmed patterns leave open; those that reach MIN_INSTANCE are
    sure in their turn and can confirm further patterns, until a round finds none.
    """
    at = found.where(F.size("units") > 0).select("doc_id", "h", F.explode("units").alias("u"))
    at = at.select("doc_id", "h", F.col("u.start").alias("start"), F.col("u.end").alias("end"), F.col("u.token").alias("token"), F.col("u.patterns").alias("patterns"), (F.size(base_spans(F.col("u.token"))) > 0).alias("seed"))
    at = written(at, "units").select("doc_id", "h", "start", "end", "token", "seed", F.explode("patterns").alias("pattern"))
    # Whatever is found on the way, only patterns with so many distinct instances, and others than seeds, can come to count.
    each = at.groupBy("pattern", "token").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    able = each.groupBy("pattern").agg(F.count("*").alias("k"), F.min("seed").alias("all"), F.sum("n").alias("instances")).where(f"k >= {MIN_SEEDS} and not all").select("pattern", "instances")
    able = written(able, "patterns")
    n = able.count()
    if not n:
        return None
    few = n <= BROADCAST_PATTERNS
    small = F.broadcast if few else lambda df: df
    total = written(_occurrences(able, docs, few).join(able, "pattern").select("pattern", F.greatest("total", "instances").alias("total")), "occurrences")
    edges = written(each.join(small(total.select("pattern")), "pattern"), "graph")
    sure = written(edges.where("seed").select("token").distinct(), "sure")
    size = sure.count()
    while True:
        p = edges.join(sure, "token", "left_semi").groupBy("pattern").agg(F.count("*").alias("k"), F.sum("n").alias("n")).where(f"k >= {MIN_SEEDS}")
        p = written(p.join(small(total), "pattern").select("pattern", (F.col("n") / F.col("total")).alias("p")).where(f"p >= {MIN_PATTERN}"), "confirmed")
        score = edges.where("not seed").join(small(p), "pattern").groupBy("token").agg((1.0 - F.exp(F.sum(F.log(F.greatest(1.0 - F.col("p"), F.lit(1e-6)))))).alias("score"))
        new = written(edges.where("seed").select("token").unionByName(score.where(f"score >= {MIN_INSTANCE}").select("token")).distinct(), "sure")
        last, size = size, new.count()
        forget(sure)
        sure = new
        if size == last:
            break
        forget(p)
    hit = edges.where("not seed").join(small(p), "pattern").join(sure, "token", "left_semi").select("pattern", "token")
    out = written(at.where("not seed").join(hit, ["pattern", "token"], "left_semi").select("doc_id", "h", "start", "end").distinct(), "discovered")
    for x in (able, total, edges, sure, p):
        forget(x)
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and pii for each row of docs (doc_id, text): arrays of spans (kind, start, end), by kind and then start.

    base has the matches of the base patterns, pii those and the identifiers that the bootstrapped contexts discover (kind
    context). Null texts are empty and have no spans; long texts are looked at whole, in time that grows with their length and
    matches; repeated rows and null ids keep their rows, and equal texts have equal spans; an empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))
    found = written(rows.select("doc_id", "h", base_spans(F.col("text")).alias("base"), _units(F.col("text")).alias("units")), "pii")
    more = _discovered(found, docs)
    if more is None or more.isEmpty():
        return found.select("doc_id", "base", F.col("base").alias("pii"))
    extra = more.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct(F.lit("context").alias("kind"), "start", "end"))).alias("extra"))
    both = found.alias("f").join(extra.alias("e"), F.col("f.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("f.h") == F.col("e.h")), "left")
    return both.select("f.doc_id", "f.base", F.concat("f.base", F.coalesce("e.extra", F.array().cast(_SPAN))).alias("pii"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
