"""Depth from posed views by plane sweep: an array kernel for each reference view, in Arrow groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Planes of inverse depth, source views of one reference, side of the box that costs are averaged over, the share of
#: costs beyond which a pixel has no depth.
PLANES, SOURCES, BOX, WORST = 64, 8, 5, 0.85


def sampled_at(image: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Values between pixels, by the four around them; outside the image not a number."""
    h, w = image.shape
    ok = (u >= 0) & (u <= w - 1) & (v >= 0) & (v <= h - 1)
    u0, v0 = np.clip(np.floor(u), 0, max(w - 2, 0)).astype(int), np.clip(np.floor(v), 0, max(h - 2, 0)).astype(int)
    u1, v1 = np.minimum(u0 + 1, w - 1), np.minimum(v0 + 1, h - 1)
    a, b = np.clip(u - u0, 0, 1), np.clip(v - v0, 0, 1)
    out = image[v0, u0] * (1 - a) * (1 - b) + image[v0, u1] * a * (1 - b) + image[v1, u0] * (1 - a) * b + image[v1, u1] * a * b
    return np.where(ok, out, np.nan)


def box_mean(x: np.ndarray, side: int = BOX) -> np.ndarray:
    """Means over a box around each pixel, edges repeated, by sums of sums."""
    k = side // 2
    p = np.pad(x, k, mode="edge").cumsum(axis=0).cumsum(axis=1)
    p = np.pad(p, ((1, 0), (1, 0)))
    return (p[side:, side:] - p[:-side, side:] - p[side:, :-side] + p[:-side, :-side]) / side**2


def sweep(reference: np.ndarray, k: tuple[float, float, float, float], pose: np.ndarray, views: list[tuple[np.ndarray, np.ndarray]], near: float, far: float, planes: int = PLANES) -> np.ndarray:
    """Depths of a grey reference image by other views (image, 4 x 4 world-to-camera pose) with the same intrinsics (fx, fy, cx, cy).

    Each plane of equal inverse depth is seen by all views; the mean absolute difference, averaged over a box, is the cost of a
    pixel at it. The least cost counts, refined by the parabola through its neighbours; costs among the worst give no depth (0).
    """
    h, w = reference.shape
    fx, fy, cx, cy = k
    u, v = np.meshgrid(np.arange(w, dtype=float), np.arange(h, dtype=float))
    rays = np.stack([(u - cx) / fx, (v - cy) / fy, np.ones_like(u)], axis=-1)
    inverse = np.linspace(1.0 / far, 1.0 / near, planes)
    back = np.linalg.inv(pose)
    cost = np.full((planes, h, w), np.inf)
    for i, q in enumerate(inverse):
        world = (rays / q) @ back[:3, :3].T + back[:3, 3]
        total, seen = np.zeros((h, w)), np.zeros((h, w))
        for image, own in views:
            p = world @ own[:3, :3].T + own[:3, 3]
            front = p[..., 2] > 1e-6
            z = np.where(front, p[..., 2], 1.0)
            x = sampled_at(image, np.where(front, fx * p[..., 0] / z + cx, -1.0), np.where(front, fy * p[..., 1] / z + cy, -1.0))
            ok = ~np.isnan(x)
            total += np.where(ok, np.abs(x - reference), 0.0)
            seen += ok
        mean = np.where(seen > 0, total / np.maximum(seen, 1), 255.0)
        cost[i] = box_mean(mean)
    best = cost.argmin(axis=0)
    at = lambda d: np.take_along_axis(cost, np.clip(best + d, 0, planes - 1)[None], axis=0)[0]
    low, mid, high = at(-1), at(0), at(1)
    bend = low - 2 * mid + high
    inner = (best > 0) & (best < planes - 1) & (bend > 1e-12)
    shift = np.where(inner, 0.5 * (low - high) / np.where(inner, bend, 1.0), 0.0)
    step = inverse[1] - inverse[0] if planes > 1 else 0.0
    depth = 1.0 / (inverse[best] + np.clip(shift, -0.5, 0.5) * step)
    return np.where(mid <= np.quantile(mid, WORST), depth, 0.0)


def plane_sweep(frames: DataFrame, near: float = 0.3, far: float = 8.0, planes: int = PLANES, sources: int = SOURCES) -> DataFrame:
    """(scene, frame, u, v, m): depths of each frame of frames (scene, frame, width, height, gray: rows of brightness, fx, fy, cx, cy,
    pose: sixteen numbers, world to camera) from the `sources` frames whose centres are nearest to its own, itself left out.

    A reference and its sources are one group: the sources are chosen as (reference, source) pairs before any image travels.
    """
    pose = lambda i: F.get("pose", F.lit(i))
    centre = [-(sum(pose(4 * j + i) * pose(4 * j + 3) for j in range(3))) for i in range(3)]
    at = frames.select("scene", "frame", *[c.alias(f"c{i}") for i, c in enumerate(centre)])
    a, b = at.alias("a"), at.alias("b")
    d = F.sqrt(sum((F.col(f"a.c{i}") - F.col(f"b.c{i}")) ** 2 for i in range(3)))
    near_views = a.join(b, (F.col("a.scene") == F.col("b.scene")) & (F.col("a.frame") != F.col("b.frame"))).select("a.scene", F.col("a.frame").alias("reference"), F.col("b.frame").alias("frame"), d.alias("d"))
    chosen = near_views.groupBy("scene", "reference").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "frame"))), 1, sources).alias("s")).select("scene", "reference", F.explode("s.frame").alias("frame"))
    pairs = chosen.unionByName(frames.select("scene", F.col("frame").alias("reference"), "frame"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        image = lambda r: np.asarray(r.gray, float).reshape(int(r.height), int(r.width))
        matrix = lambda r: np.asarray(r.pose, float).reshape(4, 4)
        own = next(r for r in pdf.itertuples() if r.frame == r.reference)
        others = [(image(r), matrix(r)) for r in pdf.itertuples() if r.frame != r.reference]
        m = sweep(image(own), (own.fx, own.fy, own.cx, own.cy), matrix(own), others, near, far, planes) if others else np.zeros((int(own.height), int(own.width)))
        v, u = np.indices(m.shape)
        return pd.DataFrame({"scene": own.scene, "frame": own.reference, "u": u.ravel(), "v": v.ravel(), "m": m.ravel()})

    return frames.join(pairs, ["scene", "frame"]).groupBy("scene", "reference").applyInPandas(run, "scene long, frame long, u int, v int, m double")


def depth_coverage(depths: DataFrame) -> DataFrame:
    """Share of each frame's pixels that have a depth."""
    return depths.groupBy("scene", "frame").agg(F.avg((F.col("m") > 0).cast("double")).alias("coverage"))
