"""Frames of videos: histograms, steps, quality, and a whole video's way from frames to samples.

Pixels are rows (video, idx, u, v, r, g, b); frames are rows (video, idx, ...).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import vector as X
from lattica.operators import sequences as S
from lattica.operators import voxels as V

#: Bins of hue and of saturation, brightness that counts as over- and underexposed, thresholds without signal.
BINS, BRIGHT, DARK, FIXED_HISTOGRAM, FIXED_EMBEDDING = 32, 250, 5, 0.5, 0.35


def gray(r: Column, g: Column, b: Column) -> Column:
    """Brightness from 0 to 255, whole numbers."""
    return F.round(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def histograms(pixels: DataFrame, by: Sequence[str] = ("video", "idx"), bins: int = BINS) -> DataFrame:
    """(by, bin, share): the joint histogram of hue and saturation of each frame; bins without pixels have no row."""
    h, s, _ = V.hsv(F.col("r"), F.col("g"), F.col("b"))
    at = lambda x: F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int")
    n = pixels.select(*by, (at(h) * bins + at(s)).alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    total = pixels.groupBy(*by).agg(F.count("*").alias("total"))
    return n.join(total, list(by)).select(*by, "bin", (F.col("n") / F.col("total")).alias("share"))


def histogram_steps(found: DataFrame, by: str = "video") -> DataFrame:
    """(by, idx, diff): the chi-square distance of each frame's histogram (by, idx, bin, share) to that of the next one.

    A bin of frame i meets frame i + 1 by an equal key; what is in neither is 0. The last frame has no step.
    """
    frames = found.select(by, "idx").distinct()
    here = found.select(by, "idx", "bin", F.col("share").alias("x"), F.lit(0.0).alias("y"))
    there = found.select(by, (F.col("idx") - 1).alias("idx"), "bin", F.lit(0.0).alias("x"), F.col("share").alias("y"))
    both = here.unionByName(there).groupBy(by, "idx", "bin").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    d = both.groupBy(by, "idx").agg((0.5 * F.sum((F.col("x") - F.col("y")) ** 2 / (F.col("x") + F.col("y")))).alias("diff"))
    last = frames.groupBy(by).agg(F.max("idx").alias("last"))
    return frames.join(d, [by, "idx"], "left").join(last, by).where("idx < last").select(by, "idx", F.coalesce("diff", F.lit(0.0)).alias("diff"))


def embedding_steps(frames: DataFrame, by: str = "video", feature: str = "e") -> DataFrame:
    """(by, idx, diff): one less the cosine of each frame's vector and the next one's."""
    w = Window.partitionBy(by).orderBy("idx")
    d = frames.select(by, "idx", feature, F.lead(feature).over(w).alias("__n")).where("__n is not null")
    return d.select(by, "idx", (1.0 - X.cosine(F.col(feature), F.col("__n"))).alias("diff"))


def thresholds(diffs: DataFrame, mode: str = "robust", by: str = "video", fixed: float = FIXED_HISTOGRAM) -> DataFrame:
    """(by, threshold) of steps: fixed, otsu, adaptive or robust. Videos whose steps say nothing get the fixed one."""
    if mode == "fixed":
        return diffs.select(by).distinct().withColumn("threshold", F.lit(fixed))
    ways = {"otsu": S.otsu_threshold, "adaptive": S.adaptive_threshold, "robust": S.robust_threshold}
    if mode not in ways:
        raise ValueError(f"no threshold is called {mode}")
    found = ways[mode](diffs, by)
    return diffs.select(by).distinct().join(found, by, "left").select(by, F.coalesce("threshold", F.lit(fixed)).alias("threshold"))


def quality_scores(pixels: DataFrame, by: Sequence[str] = ("video", "idx")) -> DataFrame:
    """Each frame's sharpness (the variance of its Laplacian, edges mirrored), contrast, over- and underexposed shares and shorter side.

    A pixel gives its brightness to its four neighbours and itself, so that the Laplacian is one sum by place.
    """
    p = pixels.select(*by, F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), gray(F.col("r"), F.col("g"), F.col("b")).cast("double").alias("y"))
    size = p.groupBy(*by).agg((F.max("u") + 1).alias("w"), (F.max("v") + 1).alias("h"), F.stddev_pop("y").alias("contrast"), F.avg((F.col("y") >= BRIGHT).cast("double")).alias("overexposed"), F.avg((F.col("y") <= DARK).cast("double")).alias("underexposed"))
    q = p.join(size.select(*by, "w", "h"), list(by))
    to = lambda u, v, f: F.struct(u.alias("u"), v.alias("v"), f.alias("f"))
    u, v, one = F.col("u"), F.col("v"), F.lit(1.0)
    # With edges mirrored about their pixels, the neighbour within stands for the one beyond: it counts twice.
    give = [to(u, v, F.lit(-4.0))]
    for du, dv in ((1, 0), (-1, 0), (0, 1), (0, -1)):
        side, n = (u + du, F.col("w")) if du else (v + dv, F.col("h"))
        edge = F.when((n > 1) & (side == (n - 1 if (du or dv) > 0 else F.lit(0))), 2.0).otherwise(one)
        ok = side.between(0, n - 1)
        give.append(F.when(ok, to(u + du, v + dv, edge)))
    lone = [F.when(F.col(n) == 1, to(u, v, F.lit(2.0))) for n in ("w", "h")]  # a side of one pixel mirrors onto itself
    lap = q.select(*by, "y", F.explode(F.array_compact(F.array(*give, *lone))).alias("g")).groupBy(*by, "g.u", "g.v").agg(F.sum(F.col("y") * F.col("g.f")).alias("l"))
    sharp = lap.groupBy(*by).agg(F.var_pop("l").alias("sharpness"))
    return size.join(sharp, list(by)).select(*by, "sharpness", "contrast", "overexposed", "underexposed", F.least("w", "h").alias("min_side"))


def quality_gates(scores: DataFrame, side: int = S.MIN_SIDE) -> DataFrame:
    """scores with reason: the first gate that a frame fails, empty if none."""
    return scores.withColumn("reason", S.quality_reason(F.col("sharpness"), F.col("contrast"), F.col("overexposed"), F.col("underexposed"), F.col("min_side"), side))


@dataclass
class Processed:
    """What became of videos: shots, the frames chosen and kept, and figures of each video."""

    shots: DataFrame
    chosen: DataFrame
    kept: DataFrame
    figures: DataFrame

    def to_dict(self) -> list[dict]:
        """The figures, a row for each video."""
        return [r.asDict() for r in self.figures.collect()]

    def summary(self) -> str:
        return "\n".join(f"video {d['video']}: {d['frames']} frames, {d['shots']} shots, {d['chosen']} chosen, {d['kept']} kept" for d in self.to_dict())


def processed(frames: DataFrame, budget: int = S.FRAMES, strategy: str = "adaptive", mode: str = "robust", side: int = S.MIN_SIDE, by: str = "video") -> Processed:
    """Videos from frames (by, idx, diff, hash, e, and the columns of quality_scores) to distinct samples: shots by their steps,
    frames by strategy, those that pass the quality gates, and of these the ones unlike an earlier one."""
    cuts = S.boundaries(frames.select(by, "idx", "diff"), by, thresholds(frames.where("diff is not null"), mode, by))
    shots = S.shots(frames.groupBy(by).agg(F.count("*").alias("n")), cuts, by)
    chosen = S.sample_frames(frames, shots, by, budget, strategy)
    gated = quality_gates(frames.join(chosen.select(by, "idx"), [by, "idx"], "left_semi"), side)
    same = S.distinct_frames(gated.where("reason = ''").select(by, "idx", "hash", "e"), by)
    reasons = gated.select(by, "idx", "reason").alias("g").join(same.alias("s"), [by, "idx"], "left").select(by, "idx", F.when(F.col("g.reason") != "", F.col("g.reason")).otherwise(F.coalesce("s.reason", F.lit(""))).alias("reason"))
    per = reasons.groupBy(by).agg(F.count("*").alias("chosen"), F.sum((F.col("reason") == "").cast("long")).alias("kept"), F.sum(F.col("reason").isin("hash", "embedding").cast("long")).alias("duplicates"))
    figures = frames.groupBy(by).agg(F.count("*").alias("frames")).join(shots.groupBy(by).agg(F.count("*").alias("shots")), by, "left").join(per, by, "left").fillna(0, ["shots", "chosen", "kept", "duplicates"])
    return Processed(shots, reasons, reasons.where("reason = ''").select(by, "idx"), figures)
