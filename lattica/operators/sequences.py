"""Ordered sequences: change points, shots, frame samples and frame quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import vector as X

#: Fixed values of shot detection: robust factor, quantile bounds, neighbours and ratio of peaks, gradual window and ratios, least length.
K_MAD, MAX_FRACTION, N_SIGNAL, MIN_FRACTION, PEAK_WINDOW, PEAK_RATIO = 6.0, 0.10, 4, 0.01, 5, 5.0
GRADUAL_WINDOW, GRADUAL_RATIO, GRADUAL_PROMINENCE, MIN_LENGTH = 5, 0.45, 2.0, 3
#: Fixed values of frame choice: frames, weights of motion and length; hash distance and cosine of equal frames.
FRAMES, W_MOTION, W_LENGTH, HASH_BITS, SAME_COSINE = 24, 0.6, 0.4, 6, 0.97
#: Fixed values of the quality gates: least side, sharpness and contrast, most of a frame that is over- or underexposed.
MIN_SIDE, MIN_SHARPNESS, MIN_CONTRAST, MAX_OVER, MAX_UNDER = 128, 30, 8, 0.35, 0.35


def _finite(c: str) -> Column:
    return F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))


def mad_threshold(diffs: DataFrame, by: str = "user_id", k: float = K_MAD) -> DataFrame:
    """(by, n, median, mad): the median of the differences and that of their distances from it, non-finite ones left out."""
    d = diffs.select(by, _finite("diff").alias("d")).where("d is not null")
    m = d.groupBy(by).agg(F.median("d").alias("med"), F.count("*").alias("n"))
    return d.join(m, by).groupBy(by, "n", "med").agg(F.median(F.abs(F.col("d") - F.col("med"))).alias("mad")).withColumn("limit", F.col("med") + F.lit(k * 1.4826) * F.col("mad"))


def robust_threshold(diffs: DataFrame, by: str = "user_id") -> DataFrame:
    """(by, threshold): the greater of the median's limit and the quantile that leaves out a share of 4 / n, between 0.01 and 0.10;
    twice the median where the differences hardly differ. The share depends on n, so ranks are interpolated."""
    t = mad_threshold(diffs, by)
    d = diffs.select(by, _finite("diff").alias("d")).where("d is not null").join(t, by)
    rank = F.row_number().over(Window.partitionBy(by).orderBy("d")) - 1
    share = F.least(F.lit(MAX_FRACTION), F.greatest(F.lit(MIN_FRACTION), N_SIGNAL / F.col("n")))
    d = d.withColumn("h", (F.col("n") - 1) * (1 - share)).withColumn("rank", rank)
    near = d.where((F.col("rank") == F.floor("h")) | (F.col("rank") == F.least(F.floor("h") + 1, F.col("n") - 1)))
    q = near.groupBy(by, "n", "med", "mad", "limit", "h").agg(F.min_by("d", "rank").alias("a"), F.max_by("d", "rank").alias("b"))
    quantile = F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))
    return q.select(by, F.when(F.col("mad") <= 1e-12, 2 * F.col("med")).otherwise(F.greatest("limit", quantile, F.lit(1e-9))).alias("threshold"))


def adaptive_threshold(diffs: DataFrame, by: str = "user_id", k: float = K_MAD) -> DataFrame:
    """(by, threshold): the median's limit alone; no row where the differences hardly differ."""
    return mad_threshold(diffs, by, k).where("mad > 1e-12").select(by, F.col("limit").alias("threshold"))


def otsu_threshold(diffs: DataFrame, by: str = "user_id", bins: int = 128) -> DataFrame:
    """(by, threshold): the upper edge of the bin of log10 differences that parts them best, the least of equals."""
    d = diffs.select(by, _finite("diff").alias("d")).where("d is not null").select(by, F.log10(F.greatest("d", F.lit(1e-9))).alias("l"))
    r = d.groupBy(by).agg(F.min("l").alias("lo"), F.max("l").alias("hi")).where("hi > lo")
    b = d.join(r, by).withColumn("bin", F.least(F.floor((F.col("l") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    g = b.groupBy(by, "lo", "hi", "bin").agg(F.count("*").alias("n"))
    w, every = Window.partitionBy(by).orderBy("bin"), Window.partitionBy(by)
    c = g.withColumn("w0", F.sum("n").over(w)).withColumn("all", F.sum("n").over(every)).withColumn("m0", F.sum(F.col("n") * F.col("bin")).over(w)).withColumn("m", F.sum(F.col("n") * F.col("bin")).over(every))
    c = c.where("w0 < all").withColumn("between", F.col("w0") * (F.col("all") - F.col("w0")) * F.pow(F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / (F.col("all") - F.col("w0")), F.lit(2.0)))
    best = c.groupBy(by, "lo", "hi").agg(F.max_by("bin", F.struct(F.round("between", 3), -F.col("bin"))).alias("bin"))
    return best.select(by, F.pow(F.lit(10.0), F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("threshold"))


def prominent(diffs: DataFrame, by: str = "user_id", window: int = PEAK_WINDOW, ratio: float = PEAK_RATIO, name: str = "prominent") -> DataFrame:
    """diffs with a flag: at least ratio times the median of the neighbours, itself left out; any positive one over a median of 0."""
    w = Window.partitionBy(by).orderBy("idx")
    around = F.array_sort(F.concat(F.collect_list("diff").over(w.rowsBetween(-window, -1)), F.collect_list("diff").over(w.rowsBetween(1, window))))
    d = diffs.withColumn("__near", around)
    base = X.interpolated(F.col("__near"), 0.5)
    return d.withColumn(name, F.when(F.size("__near") == 0, True).when(base <= 0, F.col("diff") > 0).otherwise(F.col("diff") >= ratio * base)).drop("__near")


def boundaries(diffs: DataFrame, by: str = "user_id", limits: DataFrame | None = None) -> DataFrame:
    """(by, idx, hard): where a step exceeds the threshold (by limits, else the robust one) as a peak, or a moving mean of five
    (zeros outside) does gradually and is moved to the greatest step around it."""
    t = robust_threshold(diffs, by) if limits is None else limits
    d = diffs.where("diff is not null").join(t, by)
    d = prominent(d, by)
    d = prominent(d, by, GRADUAL_WINDOW, GRADUAL_PROMINENCE, "gentle")
    w = Window.partitionBy(by).orderBy("idx")
    half = GRADUAL_WINDOW // 2
    d = d.withColumn("hard", (F.col("diff") >= F.col("threshold")) & F.col("prominent"))
    d = d.withColumn("soft", (F.sum("diff").over(w.rowsBetween(-half, half)) / GRADUAL_WINDOW >= GRADUAL_RATIO * F.col("threshold")) & ~F.col("hard") & F.col("gentle"))
    d = d.withColumn("peak", F.max_by("idx", F.struct("diff", -F.col("idx"))).over(w.rowsBetween(-half, half)))
    at = d.where("hard or soft").select(by, F.when(F.col("hard"), F.col("idx")).otherwise(F.col("peak")).alias("idx"), "hard")
    return at.groupBy(by, "idx").agg(F.max("hard").alias("hard"))


def islands(marks: DataFrame, by: str = "user_id", gap: int = 1, weight: str = "diff") -> DataFrame:
    """Runs of marks at most gap apart as one mark at their weighted centre, rounded."""
    w = Window.partitionBy(by).orderBy("idx")
    m = marks.withColumn("new", F.coalesce((F.col("idx") - F.lag("idx").over(w) > gap).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(w))
    return m.groupBy(by, "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"), F.rint(F.sum(F.col("idx") * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-12))).cast("long").alias("center"))


def shots(lengths: DataFrame, marks: DataFrame, by: str = "user_id", least: int = MIN_LENGTH) -> DataFrame:
    """(by, shot, start, end), half open: a mark counts if it is `least` frames after the last that counted, hard ones also near
    the start. The recurrence is one fold over the sorted marks of a video."""
    b = marks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((F.col("idx") + 1).alias("at"), "hard"))).alias("marks"))
    fold = F.aggregate("marks", F.array(F.lit(0).cast("long")), lambda acc, x: F.when((x["at"] - F.element_at(acc, -1) >= least) | ((F.size(acc) == 1) & x["hard"] & (x["at"] > 0)), F.concat(acc, F.array(x["at"]))).otherwise(acc))
    s = lengths.join(b, by, "left").select(by, "n", F.coalesce(fold, F.array(F.lit(0).cast("long"))).alias("starts"))
    s = s.where("n > 0").select(by, "n", F.posexplode("starts").alias("shot", "start")).where("start < n")
    end = F.coalesce(F.lead("start").over(Window.partitionBy(by).orderBy("start")), F.col("n"))
    return s.select(by, F.col("shot").cast("long").alias("shot"), "start", end.alias("end"))


def match_marks(predicted: list[int], truth: list[int], tolerance: int = 2) -> int:
    """True positives: each prediction in order takes the nearest free truth within the tolerance."""
    free, hits = sorted(truth), 0
    for p in sorted(predicted):
        near = min(free, key=lambda t: (abs(t - p), t), default=None)
        if near is not None and abs(near - p) <= tolerance:
            free.remove(near)
            hits += 1
    return hits


def boundary_scores(predicted: DataFrame, truth: DataFrame, by: str = "user_id", tolerance: int = 2) -> DataFrame:
    """tp, fp and fn of each video, one to one."""
    def run(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        key = (p if len(p) else t)[by].iloc[0]
        tp = match_marks(p["idx"].tolist(), t["idx"].tolist(), tolerance)
        return pd.DataFrame({by: [key], "tp": [tp], "fp": [len(p) - tp], "fn": [len(t) - tp]})

    return predicted.select(by, "idx").groupBy(by).cogroup(truth.select(F.col(by).alias(by), F.col("idx").alias("idx")).groupBy(by)).applyInPandas(run, f"{by} long, tp long, fp long, fn long")


def micro_scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return counts.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


# ---------------------------------------------------------------------------------------------------- samples


def allocate(weights: list[float], caps: list[int], budget: int, least: int = 1) -> list[int]:
    """Frames for each shot by weight, by largest remainders in rounds, none above its cap; they add up to the budget or to all."""
    caps = [max(int(c), 0) for c in caps]
    budget = min(budget, sum(caps))
    order = sorted(range(len(caps)), key=lambda i: (-weights[i], i))
    out = [0] * len(caps)
    left = budget
    for i in order:  # each shot its least, the heaviest first while frames last
        out[i] = min(least, caps[i], left)
        left -= out[i]
    while left > 0:
        open_ = [i for i in range(len(caps)) if out[i] < caps[i]]
        total = sum(weights[i] for i in open_)
        ideal = {i: left * (weights[i] / total if total > 0 else 1 / len(open_)) for i in open_}
        give = {i: min(int(ideal[i]), caps[i] - out[i]) for i in open_}
        rest = left - sum(give.values())
        for i in sorted(open_, key=lambda i: (-(ideal[i] - int(ideal[i])), i)):
            if rest and out[i] + give[i] < caps[i]:
                give[i] += 1
                rest -= 1
        for i, g in give.items():
            out[i] += g
        left = rest
    return out


def sample_frames(frames: DataFrame, found: DataFrame, by: str = "user_id", budget: int = FRAMES, strategy: str = "adaptive") -> DataFrame:
    """(by, idx, shot) of the frames chosen: uniform, thirds, keyframe or adaptive (quota by length and motion; in each shot the
    frames of most motion, one for each stretch of equal motion), filled to the budget by motion."""
    inside = frames.alias("f").join(found.alias("s"), by).where("idx >= start and idx < end").select(by, "idx", F.coalesce("diff", F.lit(0.0)).alias("motion"), "shot", "start", "end")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").reset_index(drop=True)
        n = len(pdf)
        k = min(budget, n)
        if strategy == "uniform":
            pick = np.unique(np.rint(np.linspace(0, n - 1, k)).astype(int))
        elif strategy == "thirds":
            pick = np.unique(np.concatenate([np.rint(g.index[0] + (len(g) - 1) * np.array([1 / 6, 0.5, 5 / 6])).astype(int) for _, g in pdf.groupby("shot")]))[:k]
        else:
            groups = [g for _, g in pdf.groupby("shot")]
            size = np.array([len(g) for g in groups], float)
            motion = np.array([g["motion"].mean() for g in groups])
            weight = (size / size.max()) ** W_LENGTH * (motion / max(motion.max(), 1e-12)) ** W_MOTION if strategy == "adaptive" else size
            quota = allocate(weight.tolist(), [len(g) for g in groups], k)
            chosen = []
            for g, q in zip(groups, quota, strict=True):
                if not q:
                    continue
                if strategy == "keyframe":
                    chosen += g.sort_values(["motion", "idx"], ascending=[False, True]).index[:q].tolist()
                    continue
                c = np.cumsum(g["motion"].to_numpy() + 1e-9)
                part = np.minimum((c / c[-1] * q - 1e-12).astype(int), q - 1)
                chosen += [g.index[np.flatnonzero(part == s)[np.argmax(g["motion"].to_numpy()[part == s])]] for s in np.unique(part)]
            pick = np.array(sorted(set(chosen)), int)
        if len(pick) < k:  # fill up by motion
            rest = pdf.drop(index=pick).sort_values(["motion", "idx"], ascending=[False, True]).index[: k - len(pick)]
            pick = np.concatenate([pick, rest.to_numpy()])
        return pdf.loc[np.sort(pick), [by, "idx", "shot"]]

    return inside.groupBy(by).applyInPandas(run, f"{by} long, idx long, shot long")


def gini(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, gini) of a non-negative value, by ranks."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(value))
    g = df.withColumn("__r", r).groupBy(by).agg(F.sum(F.col("__r") * F.col(value)).alias("rx"), F.sum(value).alias("s"), F.count("*").alias("n"))
    return g.select(by, F.when(F.col("s") > 0, 2 * F.col("rx") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0).alias("gini"))


def coverage(chosen: DataFrame, found: DataFrame, by: str = "user_id") -> DataFrame:
    """Share of shots with a frame, and evenness of frames over shots."""
    n = chosen.groupBy(by, "shot").agg(F.count("*").alias("n"))
    every = found.select(by, "shot").join(n, [by, "shot"], "left").fillna(0, ["n"])
    share = every.groupBy(by).agg(F.avg((F.col("n") > 0).cast("double")).alias("shot_coverage"), F.sum("n").alias("frames"))
    return share.join(gini(every, by, "n"), by).withColumn("evenness", 1 - F.col("gini"))


def distinct_frames(frames: DataFrame, by: str, bits: int = HASH_BITS, cosine: float = SAME_COSINE) -> DataFrame:
    """frames (by, idx, hash, e) with reason: "" for kept ones, "hash" or "embedding" for those like a kept earlier one."""
    schema = frames.select(by, "idx").schema.add("reason", "string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept_h: list[int] = []
        kept_e: list[np.ndarray] = []
        reasons = []
        pdf = pdf.sort_values("idx")
        for h, e in zip(pdf["hash"], pdf["e"], strict=True):
            e = np.asarray(e, float)
            e = e / max(np.linalg.norm(e), 1e-12)
            why = "hash" if any(((h ^ x) & 0xFFFFFFFFFFFFFFFF).bit_count() <= bits for x in kept_h) else "embedding" if any(float(e @ x) >= cosine for x in kept_e) else ""
            if not why:
                kept_h.append(h)
                kept_e.append(e)
            reasons.append(why)
        return pdf[[by, "idx"]].assign(reason=reasons)

    return frames.groupBy(by).applyInPandas(run, schema)


def quality_reason(sharpness: Column, contrast: Column, over: Column, under: Column, side: Column, least: int = MIN_SIDE) -> Column:
    """The first gate that a frame fails; empty if none."""
    return F.when(side < least, "resolution").when(sharpness < MIN_SHARPNESS, "blur").when(contrast < MIN_CONTRAST, "low_contrast").when(over > MAX_OVER, "overexposed").when(under > MAX_UNDER, "underexposed").otherwise("")


def gradient_hash(pixels: DataFrame, by: str, width: int = 9) -> DataFrame:
    """A bit for each pixel with a right neighbour: set if it is darker than that; bits in row order."""
    w = Window.partitionBy(by, "v").orderBy("u")
    d = pixels.withColumn("__n", F.lead("gray").over(w)).where("__n is not null")
    bit = F.when(F.col("gray") < F.col("__n"), F.expr(f"shiftleft(1L, cast(v * {width - 1} + u as int))")).otherwise(F.lit(0).cast("long"))
    return d.groupBy(by).agg(F.bit_or(bit).alias("hash"))


def frames_at(frames: DataFrame, wanted: DataFrame, by: str = "user_id") -> DataFrame:
    """The frames (by, idx, ...) with the numbers in wanted (by, idx); a number that a video lacks has no row."""
    return frames.join(wanted.select(by, "idx").distinct(), [by, "idx"], "left_semi")


def filled_forward(frames: DataFrame, by: str, value: str) -> DataFrame:
    """frames whose missing values take the last one before them."""
    return frames.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))


def sliding_latency(events: DataFrame, by: str, order: list[str], value: str, last: int = 50) -> DataFrame:
    """events with mean, median and 95th percentile of the last values, and the count so far."""
    w = Window.partitionBy(by).orderBy(*order)
    recent = F.array_sort(F.collect_list(value).over(w.rowsBetween(-(last - 1), 0)))
    out = events.withColumn("__r", recent).withColumn("count", F.row_number().over(w))
    mean = F.round(F.aggregate("__r", F.lit(0.0), lambda s, x: s + x), 2) / F.size("__r")  # values are given to two digits
    return out.withColumn("mean", mean).withColumn("p50", X.interpolated(F.col("__r"), 0.5)).withColumn("p95", X.interpolated(F.col("__r"), 0.95)).drop("__r")
