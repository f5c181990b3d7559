"""Synthetic rooms, their images, and videos with known cuts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import geometry as G

LABELS = ("cup", "table", "chair", "box", "bottle")


def rooms(spark: SparkSession, seeds: list[int], objects: int = 5, side: float = 4.0) -> DataFrame:
    """Boxes on the floor of a room for each seed, placed apart from one another."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for seed in pdf["seed"]:
            r = np.random.default_rng(int(seed))
            placed: list[tuple] = []
            for _ in range(200 * objects):
                if len(placed) == objects:
                    break
                h = r.uniform(0.1, 0.4, 3)
                x, y = r.uniform(-side / 2 + 0.4, side / 2 - 0.4, 2)
                if all(abs(x - p[0]) > h[0] + p[3] or abs(y - p[1]) > h[1] + p[4] for p in placed):
                    placed.append((x, y, h[2], *h))
            out += [(int(seed), i, LABELS[(seed + i) % len(LABELS)], *p[:3], *[p[a] - p[3 + a] for a in range(3)], *[p[a] + p[3 + a] for a in range(3)], 1.0) for i, p in enumerate(placed)]
        return pd.DataFrame(out, columns=["scene", "obj_id", "label", "cx", "cy", "cz", "x0", "y0", "z0", "x1", "y1", "z1", "conf"])

    seeds_df = spark.createDataFrame([(s,) for s in seeds], "seed long")
    return seeds_df.groupBy("seed").applyInPandas(run, "scene long, obj_id long, label string, cx double, cy double, cz double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, conf double")


def rendered(objects: DataFrame, width: int, height: int) -> DataFrame:
    """What each pixel of a panorama around the origin shows: the nearest box that its ray enters (u, v, obj_id, range).

    A box meets the pixels that the ball around it can cover, and no others: a range of rows, and of columns unless a pole or
    the origin is in the ball.
    """
    half = G.length([F.col(f"{k}1") - F.col(f"{k}0") for k in G.AXES]) / 2
    c = [(F.col(f"{k}0") + F.col(f"{k}1")) / 2 for k in G.AXES]
    o = objects.select("obj_id", *[f"{k}{i}" for k in G.AXES for i in (0, 1)], *[x.alias(f"__c{k}") for x, k in zip(c, G.AXES, strict=True)], half.alias("__h"))
    d = F.sqrt(sum(F.col(f"__c{k}") ** 2 for k in G.AXES))
    o = o.withColumn("__d", d).withColumn("__r", F.when(F.col("__d") <= F.col("__h") * 1.000001, math.pi).otherwise(F.asin(F.least(F.lit(1.0), F.col("__h") / F.col("__d"))) + 1e-6))
    el, az = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("__cz") / F.greatest("__d", F.lit(1e-12))))), F.atan2("__cy", "__cx")
    o = o.withColumn("__el", el).withColumn("__az", az)
    row = lambda e: F.floor((0.5 - e / math.pi) * height).cast("long")
    o = o.withColumn("v", F.explode(F.sequence(F.greatest(row(F.col("__el") + F.col("__r")), F.lit(0).cast("long")), F.least(row(F.col("__el") - F.col("__r")), F.lit(height - 1).cast("long")))))
    wide = F.abs(F.col("__el")) + F.col("__r") >= math.pi / 2 - 1e-6
    turn = F.when(~wide, F.asin(F.least(F.lit(1.0), F.sin("__r") / F.cos("__el"))) + 1e-6)
    column = lambda x: F.floor((x / (2 * math.pi) + 0.5) * width).cast("long")
    some = F.transform(F.sequence(column(F.col("__az") - turn), F.least(column(F.col("__az") + turn), column(F.col("__az") - turn) + width - 1)), lambda u: F.pmod(u, F.lit(width).cast("long")))
    hit = o.withColumn("u", F.explode(F.when(wide, F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).otherwise(some)))
    low, high = [], []
    for k, x in zip(G.AXES, G.equirect_direction(F.col("u"), F.col("v"), width, height), strict=True):
        safe = F.when(F.abs(x) < 1e-12, F.lit(1e-12)).otherwise(x)
        a, b = F.col(f"{k}0") / safe, F.col(f"{k}1") / safe
        low.append(F.least(a, b))
        high.append(F.greatest(a, b))
    hit = hit.withColumn("near", F.greatest(*low)).withColumn("far", F.least(*high)).where("near <= far and near > 0")
    return hit.groupBy("u", "v").agg(F.min_by(F.struct("obj_id", "near"), F.struct("near", "obj_id")).alias("h")).select("u", "v", "h.obj_id", F.col("h.near").alias("range"))


def shot_video(spark: SparkSession, lengths: tuple[int, ...] = (34, 5, 18, 4, 26, 7), video: int = 1) -> tuple[DataFrame, DataFrame]:
    """Differences of a video whose shots have these lengths, and its cuts."""
    rows, cuts, at = [], [], 0
    for i, n in enumerate(lengths):
        rows += [(video, at + j, 0.05 + 0.01 * ((at + j) * 7 % 5)) for j in range(n)]
        at += n
        if i < len(lengths) - 1:
            rows[-1] = (video, at - 1, 2.0 + 0.1 * i)
            cuts.append((video, at - 1))
    return spark.createDataFrame(rows[:-1], "user_id long, idx long, diff double"), spark.createDataFrame(cuts, "user_id long, idx long")


def video_pixels(spark: SparkSession, videos: int = 2, shots: int = 3, length: int = 6, side: int = 8, seed: int = 0) -> DataFrame:
    """Small videos (video, idx, u, v, r, g, b): each shot has a colour of its own, which its frames vary a little, by hashes."""
    px = spark.range(videos * shots * length * side * side)
    at = lambda n, m: F.floor(F.col("id") / n) % m
    p = px.select(at(side * side * length * shots, videos).alias("video"), at(side * side, shots * length).alias("idx"), (F.col("id") % side).cast("int").alias("u"), at(side, side).cast("int").alias("v"))
    shot = F.floor(F.col("idx") / length)
    tone = lambda c: F.pmod(F.xxhash64("video", shot, F.lit(c), F.lit(seed)), F.lit(200))
    near = lambda c: F.pmod(F.xxhash64("video", "idx", "u", "v", F.lit(c), F.lit(seed)), F.lit(9))
    return p.select("video", "idx", "u", "v", *[(tone(i) + near(i)).cast("int").alias(c) for i, c in enumerate("rgb")])


#: The camera of synthetic rooms: 160 x 120 pixels.
CAMERA = {"fx": 120.0, "fy": 120.0, "cx": 79.5, "cy": 59.5, "width": 160, "height": 120}


def truth_boxes(objects: DataFrame) -> DataFrame:
    """Boxes of a room as centre, full sizes and heading."""
    return objects.select("scene", "obj_id", "label", "cx", "cy", "cz", *[(F.col(f"{k}1") - F.col(f"{k}0")).alias(f"d{k}") for k in G.AXES], F.lit(0.0).alias("heading"))
