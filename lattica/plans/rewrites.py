"""Distance joins by grid cells, as-of joins by one sort, greedy choices in rounds, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(df: DataFrame, coords: Sequence[str], size: float, spread: bool) -> DataFrame:
    """df with its grid cell, or with all cells around it."""
    for i, c in enumerate(coords):
        cell = F.floor(F.col(c) / size).cast("long")
        df = df.withColumn(f"__g{i}", F.explode(F.array(cell - 1, cell, cell + 1)) if spread else cell)
    return df


def within_distance(a: DataFrame, b: DataFrame, coords: Sequence[str], radius: float) -> DataFrame:
    """Pairs of rows (structs a and b) at most `radius` apart, by an equi-join on grid cells of that size."""
    keys = [f"__g{i}" for i in range(len(coords))]
    left = cells(a, coords, radius, True).select(F.struct(*[F.col(c) for c in a.columns]).alias("a"), *keys)
    right = cells(b, coords, radius, False).select(F.struct(*[F.col(c) for c in b.columns]).alias("b"), *keys)
    d2 = sum((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in coords)
    return left.join(right, keys).drop(*keys).where(F.sqrt(d2) <= radius)


def _level(*lengths: Column) -> Column:
    """The least power of two that is no shorter than any of the lengths, as its exponent."""
    return F.ceil(F.log2(F.greatest(*lengths, F.lit(1e-9)))).cast("int")


def meeting_boxes(a: DataFrame, b: DataFrame, low: Sequence[Column], high: Sequence[Column], low_b: Sequence[Column], high_b: Sequence[Column]) -> DataFrame:
    """Pairs of rows (structs a and b) whose boxes meet, whatever their sizes, by equi-joins on grids of several sizes.

    A box has the level of its longest side, and at most two cells for each axis on a grid of that size or a coarser one. The
    grids are those of b's levels and of a's: each pair meets on the grid of the larger box, in the cell of the lower corner of
    what the two share. Levels are powers of two, so there are few.
    """
    n = len(low)

    def sided(df: DataFrame, name: str, lo: Sequence[Column], hi: Sequence[Column]) -> DataFrame:
        cols = [c.alias(f"__{e}{i}") for e, x in (("l", lo), ("h", hi)) for i, c in enumerate(x)]
        return df.select(F.struct(*[F.col(c) for c in df.columns]).alias(name), *cols).withColumn("__own", _level(*[F.col(f"__h{i}") - F.col(f"__l{i}") for i in range(n)]))

    x, y = sided(a, "a", low, high), sided(b, "b", low_b, high_b)
    levels = x.select("__own").unionByName(y.select("__own")).distinct().agg(F.array_sort(F.collect_set("__own")).alias("__levels"))  # one row: the exponents of doubles

    def celled(df: DataFrame, own_only: bool, name: str) -> DataFrame:
        if own_only:
            df = df.withColumn("__g", F.col("__own"))
        else:
            df = df.join(F.broadcast(levels), F.lit(True)).withColumn("__g", F.explode(F.filter("__levels", lambda v: v >= F.col("__own")))).drop("__levels")
        for i in range(n):
            cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("__g"))).cast("long")
            df = df.withColumn(f"__c{i}", F.explode(F.sequence(cell(F.col(f"__l{i}")), cell(F.col(f"__h{i}")))))
        keys = ["__g", *[f"__c{i}" for i in range(n)]]
        return df.select(name, "__own", *keys, *[F.col(f"__{e}{i}").alias(f"__{name}{e}{i}") for e in "lh" for i in range(n)])

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        keys = ["__g", *[f"__c{i}" for i in range(n)]]
        both = left.drop("__own").join(right.drop("__own"), keys)
        for i in range(n):
            corner = F.greatest(f"__al{i}", f"__bl{i}")
            both = both.where((corner <= F.least(f"__ah{i}", f"__bh{i}")) & (F.floor(corner / F.pow(F.lit(2.0), F.col("__g"))) == F.col(f"__c{i}")))
        return both.select("a", "b")

    # b's level is the coarser one or the same; then a's alone.
    first = met(celled(x, False, "a"), celled(y, True, "b"))
    second = met(celled(x, True, "a"), celled(y, False, "b").where(F.col("__own") < F.col("__g")))
    return first.unionByName(second)


def prefix_sums(df: DataFrame, order: str, values: Sequence[str], blocks: int = 1024) -> DataFrame:
    """df with sum_<value> of each value over the rows at or below its own order: by blocks of the order's range, so that no task
    holds all rows. Rows of one order are one group."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    step = ((hi - lo) / blocks or 1.0) if lo is not None else 1.0
    b = df.withColumn("__b", F.floor((F.col(order) - F.lit(lo if lo is not None else 0)) / F.lit(float(step))))
    per = b.groupBy("__b").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    every = Window.orderBy("__b")  # a row for each block
    base = per.select("__b", *[(F.sum(f"__{v}").over(every) - F.col(f"__{v}")).alias(f"__{v}") for v in values])
    w = Window.partitionBy("__b").orderBy(order)
    out = b.join(F.broadcast(base), "__b")
    return out.select(*df.columns, *[(F.col(f"__{v}") + F.sum(v).over(w)).alias(f"sum_{v}") for v in values])


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, order: str, values: Sequence[str], following: bool = False) -> DataFrame:
    """left with the values of the last row of right at or before its time (or the first at or after it), by one sort per key."""
    marked = left.withColumn("__side", F.lit(1 if not following else 0)).withColumn("__v", F.lit(None).cast(right.select(F.struct(time, *values)).schema[0].dataType))
    kept = [c for c in left.columns if c not in (*by, time, order)]
    other = right.select(*by, F.col(time), F.col(order), F.lit(0 if not following else 1).alias("__side"), F.struct(time, *values).alias("__v"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in kept])
    both = marked.unionByName(other)
    w = Window.partitionBy(*by).orderBy(time, "__side", order)
    w = w.rowsBetween(Window.unboundedPreceding, 0) if not following else w.rowsBetween(0, Window.unboundedFollowing)
    pick = F.last("__v", ignorenulls=True) if not following else F.first("__v", ignorenulls=True)
    name = "next" if following else "prev"
    return both.withColumn("__p", pick.over(w)).where("__side = " + ("0" if following else "1")).select(*left.columns, F.col("__p").alias(name))


def kept_apart(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How rounds keep what they have: in the session's checkpoint folder, or cached where none is set (tests)."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return lambda d: d.checkpoint()
    return lambda d: d.cache()


def greedy_survivors(nodes: DataFrame, conflicts: DataFrame, checkpoint: bool = True) -> DataFrame:
    """Ids kept when they are taken in ascending order and each kept one drops the later ones that conflict (lo, hi) with it.

    In rounds: an undecided id whose lower conflicting ids are all dropped is kept, and drops its higher ones. A round is two
    joins on the undecided conflicts; there are as many as the longest chain of conflicts.
    """
    cut = kept_apart(nodes) if checkpoint else (lambda d: d)
    open_ = cut(conflicts.select("lo", "hi").distinct())
    dropped = nodes.select("id").limit(0)
    while True:
        # Lowest of all undecided ones around it: no lower id can drop it any more.
        blocked = open_.select(F.col("hi").alias("lo")).distinct()
        winners = open_.join(blocked, "lo", "left_anti").select("lo").distinct()
        losers = cut(open_.join(winners, "lo").select(F.col("hi").alias("id")).distinct())
        if losers.isEmpty():
            break
        dropped = dropped.unionByName(losers)
        rest = open_.join(losers.withColumnRenamed("id", "lo"), "lo", "left_anti").join(losers.withColumnRenamed("id", "hi"), "hi", "left_anti").join(winners, "lo", "left_anti")
        open_ = cut(rest.select("lo", "hi"))
    return nodes.join(dropped.distinct(), "id", "left_anti")


def greedy_pairs(pairs: DataFrame, left: str, right: str, order: Sequence[str]) -> DataFrame:
    """One-to-one choice among pairs in ascending order: a pair is taken if neither side is in one taken before it.

    In rounds: a pair that comes first for both its sides is taken, and all others of these sides go. The order tells all pairs
    apart. There are as many rounds as the longest chain of pairs that wait for one another; no task holds more than a share.
    """
    keep = kept_apart(pairs)
    key = F.struct(*order)
    open_, taken = keep(pairs), None
    while True:
        a = open_.groupBy(left).agg(F.min(key).alias("__a"))
        b = open_.groupBy(right).agg(F.min(key).alias("__b"))
        won = keep(open_.join(a, left).join(b, right).where((key == F.col("__a")) & (key == F.col("__b"))).select(*pairs.columns))
        if won.isEmpty():
            return taken if taken is not None else won
        taken = won if taken is None else taken.unionByName(won)
        open_ = keep(open_.join(won.select(left), left, "left_anti").join(won.select(right), right, "left_anti").select(*pairs.columns))


def taken_in_turn(pairs: DataFrame, by: str, left: str, right: str, order: Sequence[Column | str]) -> DataFrame:
    """One-to-one choice among the pairs of each group in ascending order: a pair is taken if neither side is in one of its group taken before it.

    By one sort of each group, in which a task reads the pairs once. It holds what is taken of both sides, not the pairs, and there
    are no rounds, however long the chain of pairs that wait for one another is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lefts, rights = None, set(), set()
        for batch in batches:
            won = []
            for i, (g, a, b) in enumerate(zip(*[batch[c].to_pylist() for c in (by, left, right)], strict=True)):
                if g != group:
                    group, lefts, rights = g, set(), set()
                if a not in lefts and b not in rights:
                    lefts.add(a)
                    rights.add(b)
                    won.append(i)
            yield batch.take(pa.array(won, pa.int64()))

    parts = 4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # groups may be few, and should not share a task
    return pairs.repartition(parts, by).sortWithinPartitions(by, *order).mapInArrow(run, pairs.schema)


def served_in_turn(pairs: DataFrame, left: str, right: str, order: Sequence[str]) -> DataFrame:
    """One-to-one choice in which each of left, in ascending order, takes the first free one of right by order.

    In rounds, all of left ask for their first choice, and each of right keeps the least that ever asked; the others ask for
    their next one. What is kept in the end is what taking turns would give.
    """
    keep = kept_apart(pairs)
    open_ = keep(pairs)
    while True:
        asked = open_.groupBy(left).agg(F.min_by(F.struct(*pairs.columns), F.struct(*order)).alias("p")).select("p.*")
        kept = asked.groupBy(right).agg(F.min(left).alias("__k"))
        refused = keep(asked.join(kept, right).where(F.col(left) != F.col("__k")).select(left, right))
        if refused.isEmpty():
            return asked
        open_ = keep(open_.join(refused, [left, right], "left_anti").select(*pairs.columns))


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) for every node: the least id that it reaches. Labels spread and jump to their own labels' labels each round."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = nodes.select("id", F.col("id").alias("component"))
    kept = kept_apart(nodes)
    both, labels = kept(both), kept(labels)
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("low"))
        new = labels.join(near, labels.id == near.a, "left").select("id", F.least("component", F.coalesce("low", "component")).alias("component"))
        jump = new.alias("n").join(new.select(F.col("id").alias("r"), F.col("component").alias("root")), F.col("n.component") == F.col("r")).select("id", F.col("root").alias("component"))
        jump = kept(jump)
        changed = jump.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        labels = jump
        if not changed:
            return labels


def quantile_of(values: Column, fraction: Column) -> Column:
    """The quantile of an array (sorted here) at a fraction that may differ by row."""
    from lattica.functions.vector import interpolated

    return interpolated(F.array_sort(values), fraction)
