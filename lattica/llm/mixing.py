"""Mixing sources to target weights by the cube method of balanced sampling."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, mix64, written

WEIGHTS, MAX_REPEAT = (5.0, 2.0, 1.0), 3
#: Units that a block of the flight holds, and units it may leave undecided for the next level or the landing.
BLOCK, LEFT = 4_000, 8
SEED = 41
#: Sources whose totals may be broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def source_targets(units: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row for each source (no_source, source): source_size, units, weight and target.

    Sources take the weights in turn, in the order of code points with null last, and share all words by weight. No target
    is above max_repeat times its source's size, the excess is shared again. Sources are ranked by ranges and their rows'
    places within them, and the fair share of a unit of weight is raised until no further source is at its limit: each round
    is one sum over all sources, so that no task holds them all.
    """
    s = units.groupBy("no_source", "source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"), F.count("*").alias("units"))
    # The lower 33 bits of the generated id count the rows of a partition, the upper ones are its number.
    s = s.repartitionByRange("no_source", "source").sortWithinPartitions("no_source", "source").withColumn("id", F.monotonically_increasing_id())
    s = written(s, "sources").withColumn("part", F.shiftright("id", 33)).withColumn("place", F.col("id").bitwiseAND((1 << 33) - 1))
    parts = s.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each partition of the shuffle.
    before = written(parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")), "parts")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = s.join(F.broadcast(before), "part").withColumn("weight", F.element_at(turn, ((F.col("before") + F.col("place")) % len(weights) + 1).cast("int")))
    s = s.select("no_source", "source", "source_size", "units", "weight", (F.col("source_size") * F.lit(float(max_repeat))).alias("most"))
    total, all_weights = s.agg(F.sum("source_size"), F.sum("weight")).first()
    share = (total or 0) / all_weights if all_weights else 0.0
    while True:
        full = F.col("most") < F.lit(share) * F.col("weight")
        taken, left = s.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        new = ((total or 0) - taken) / left if left else float("inf")
        if new <= share:
            break
        share = new
    return s.select("no_source", "source", "source_size", "units", "weight", F.least("most", F.lit(share) * F.col("weight")).alias("target"))


def flight(size: np.ndarray, pi: np.ndarray, seed: np.ndarray, left: int = LEFT) -> np.ndarray:
    """Probabilities after the flight: all but at most `left` of them are 0 or 1, and the sums of pi and of size * pi stay.

    Three undecided units at a time move along the null space of the two constraints until one of them is decided; the
    direction is random such that every unit keeps its expectation. Equal sizes leave a larger null space; two then move.
    """
    p = pi.astype(float).tolist()
    s = size.astype(float).tolist()
    r = (mix64(seed) >> np.uint64(11)).astype(float) / 2.0**53
    r = r.tolist()
    todo = [i for i in range(len(p)) if 0.0 < p[i] < 1.0]
    undecided = len(todo)
    queue = iter(todo)
    held: list[int] = list(itertools.islice(queue, 3))
    while len(held) == 3 and undecided > max(left, 2):
        a, b, c = held
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, d in zip(held, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if r[a] * (up + down) < down else -down
        kept = []
        for i, d in zip(held, u, strict=True):
            x = p[i] + step * d
            if x < 1e-9 or x > 1 - 1e-9:
                p[i] = float(round(x))
                undecided -= 1
            else:
                p[i] = x
                kept.append(i)
        r[kept[0] if kept else a] = (r[a] * 7919.0 + r[c] * 104729.0) % 1.0
        held = kept + list(itertools.islice(queue, 3 - len(kept)))
    return np.array(p)


def landing(size: np.ndarray, pi: np.ndarray, goal: float, units: int = LEFT + 5) -> np.ndarray:
    """Decide what the flight left: the choice whose words come nearest to goal, and then its units, the first of equals.

    Where the undecided units alone are too coarse, units of spread sizes that were decided are decided again with them.
    """
    todo = np.flatnonzero((pi > 0) & (pi < 1))
    if not len(todo):
        return pi
    rest = np.setdiff1d(np.argsort(size, kind="stable"), todo, assume_unique=True)
    rest = rest[np.argsort(size[rest], kind="stable")]
    more = max(0, min(units - len(todo), len(rest)))
    todo = np.concatenate([todo, rest[np.unique(np.linspace(0, len(rest) - 1, more).astype(int))] if more else rest[:0]])
    sure = pi.copy()
    sure[todo] = 0.0
    bits = (np.arange(1 << len(todo))[:, None] >> np.arange(len(todo))) & 1
    words = np.abs(size @ sure + bits @ size[todo] - goal) / max(float(size[todo].mean()), 1.0)
    sure[todo] = bits[int(np.argmin(words + 0.001 * np.abs(bits.sum(axis=1) - pi[todo].sum())))]
    return sure


def _level(units: DataFrame, blocks: int, last: bool, name: str) -> DataFrame:
    """One level: each (source, block) flies, and lands if it is the last level, when a source has one block."""
    names = units.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = mix64(pdf["h"].to_numpy(np.int64).view(np.uint64) ^ mix64(pdf["doc_id"].fillna(-1).to_numpy(np.int64).view(np.uint64)) ^ np.uint64(SEED))
        order = np.lexsort([pdf["doc_id"].fillna(-1), key])
        pdf, key = pdf.iloc[order], key[order]
        size = (pdf["size"] * pdf["c"]).to_numpy(float)
        before = pdf["pi"].to_numpy(float)
        pi = flight(size, before, key)
        pdf = pdf.assign(pi=landing(size, pi, float(size @ before)) if last else pi)
        return pdf[names]

    group = units.withColumn("block", F.floor(F.col("block") / blocks))
    return written(group.groupBy("no_source", "source", "block").applyInPandas(run, units.schema), name)


def _units(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("h"))
    return rows.groupBy("doc_id", "no_source", "source", "h").agg(F.max("size").alias("size"), F.count("*").alias("c"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """How often the mix takes each document: doc_id, h (a hash of the text), source, size, c, source_size, target and copies.

    Rows with the same id, source and text are one unit, whose c rows share a decision. A source that is to give r times its
    words gives every unit floor(r) times, and once more a balanced sample of the units with probability r - floor(r): its
    words and its units come to the expected sums but for the landing of at most LEFT units. Null texts are empty, a null
    source is a source of its own, null ids are kept. All is derived from hashes, so reruns agree. An empty table gives no
    rows; texts of any length are one unit; columns of other names are not read.
    """
    units = written(_units(docs), "units")
    targets = written(source_targets(units, weights, max_repeat), "targets")
    bound = targets.agg(F.count("*"), F.max("units")).first()
    few = F.broadcast(targets) if bound[0] <= BROADCAST_SOURCES else targets
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = units.join(few, ["no_source", "source"]).withColumn("r", F.least(ratio, F.lit(float(max_repeat)))).withColumn("whole", F.floor(F.col("r") + 1e-12))
    rows = rows.withColumn("pi", F.greatest(F.col("r") - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "h", F.lit(SEED)), F.ceil(F.col("units") / BLOCK)))
    # Written, so that the blocks of a source are dealt apart even where the join has dealt by source.
    fly = written(rows.select("doc_id", "no_source", "source", "h", "size", "c", "source_size", "target", "whole", "pi", "block"), "flight")
    still = (F.col("pi") > 1e-9) & (F.col("pi") < 1 - 1e-9)
    parts, blocks, most = [fly.where(~still)], 1, -(-(bound[1] or 0) // BLOCK)
    now = fly.where(still)
    while True:
        last = most <= 1
        now = _level(now, blocks, last, "flight")
        parts.append(now.where(~still))
        if last:
            break
        now, blocks = now.where(still), BLOCK // (2 * LEFT)
        most = -(-most // blocks)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    source = F.when(~F.col("no_source"), F.col("source"))
    return out.select("doc_id", "h", source.alias("source"), "size", "c", "source_size", "target", (F.col("whole") + F.round("pi")).cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as often as the mix takes it.

    Rows with the same id, source and text share a decision, whatever their other columns. Null and empty texts, null ids and
    null sources are as in mix_sources; an empty table stays empty.
    """
    d = mix_sources(docs, weights, max_repeat).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("source").alias("__s"), F.col("copies").alias("__n"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("__h")) & F.col("source").eqNullSafe(F.col("__s"))
    return docs.join(d, same).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[F.col(f"`{c}`") for c in docs.columns])
