"""Perception as plug-ins: detectors, segmenters and encoders that run in Arrow batches, loaded once in each worker."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import geometry as G


class Stage(Protocol):
    """A stage takes rows as a pandas frame and returns rows of its schema; it may hold a model."""

    schema: str

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame: ...


REGISTRY: dict[str, dict[str, Callable[[], Stage]]] = {"detector": {}, "segmenter": {}, "encoder": {}}
FALLBACK = {"detector": "given", "segmenter": "box", "encoder": "mean_color"}


def register(kind: str, name: str):
    def add(factory):
        REGISTRY[kind][name] = factory
        return factory

    return add


def build(kind: str, name: str) -> Callable[[], Stage]:
    """The factory of a stage; one that is not known is replaced by the simplest, with a warning."""
    if name not in REGISTRY[kind]:
        warnings.warn(f"no {kind} is called {name}; {FALLBACK[kind]} is used", stacklevel=2)
        name = FALLBACK[kind]
    return REGISTRY[kind][name]


def run_stage(rows: DataFrame, factory: Callable[[], Stage]) -> DataFrame:
    """Rows through one stage: the factory is called once for each task, so that a model is loaded there and not shipped."""
    schema = factory().schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stage = factory()
        for b in batches:
            yield stage(b)

    return rows.mapInPandas(run, schema)


def pipeline(frames: DataFrame, detector: str = "given", segmenter: str = "box", encoder: str = "mean_color") -> DataFrame:
    for kind, name in (("detector", detector), ("segmenter", segmenter), ("encoder", encoder)):
        frames = run_stage(frames, build(kind, name))
    return frames


_FRAME = "frame_id long, width int, height int, pixels array<array<int>>"
_BOX = "label string, score double, x1 double, y1 double, x2 double, y2 double"


@register("detector", "given")
class GivenDetector:
    """Boxes that come with the frame, clipped to it; those under two pixels are dropped."""

    schema = f"{_FRAME}, {_BOX}"

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            for d in r.boxes if r.boxes is not None else []:
                x1, x2 = max(0.0, d["x1"]), min(float(r.width), d["x2"])
                y1, y2 = max(0.0, d["y1"]), min(float(r.height), d["y2"])
                if x2 - x1 >= 2 and y2 - y1 >= 2:
                    out.append((r.frame_id, r.width, r.height, r.pixels, d["label"], d["score"], x1, y1, x2, y2))
        return pd.DataFrame(out, columns=["frame_id", "width", "height", "pixels", "label", "score", "x1", "y1", "x2", "y2"])


@register("detector", "grid")
class GridDetector(GivenDetector):
    """Nine cells of the image, for frames about which nothing is known."""

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        cells = lambda r: [{"label": "object", "score": 0.1, "x1": r.width * i / 3, "x2": r.width * (i + 1) / 3, "y1": r.height * j / 3, "y2": r.height * (j + 1) / 3} for j in range(3) for i in range(3)]
        return super().__call__(rows.assign(boxes=[cells(r) for r in rows.itertuples()]))


@register("segmenter", "box")
class BoxSegmenter:
    """The pixels of a box, as their numbers: edges are rounded (halves to even) and clipped, the lower ones belong to it."""

    schema = f"{_FRAME}, {_BOX}, mask array<int>"

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        w, h = rows["width"].to_numpy(), rows["height"].to_numpy()
        edge = lambda c, most: np.clip(np.rint(rows[c].to_numpy(float)), 0, most).astype(int)
        sides = np.column_stack([edge("x1", w), edge("x2", w), edge("y1", h), edge("y2", h), w])
        return rows.assign(mask=[(np.arange(y1, y2)[:, None] * n + np.arange(x1, x2)[None, :]).ravel().tolist() for x1, x2, y1, y2, n in sides.tolist()])


@register("segmenter", "ellipse")
class EllipseSegmenter(BoxSegmenter):
    """Those pixels of a box whose centres lie in its ellipse: nearer to most things' outlines than the box."""

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = super().__call__(rows)
        masks = []
        for r in out.itertuples():
            at = np.asarray(r.mask, int)
            rx, ry = max((r.x2 - r.x1) / 2, 1e-6), max((r.y2 - r.y1) / 2, 1e-6)
            inside = ((at % r.width + 0.5 - (r.x1 + r.x2) / 2) / rx) ** 2 + ((at // r.width + 0.5 - (r.y1 + r.y2) / 2) / ry) ** 2 <= 1
            masks.append(at[inside].tolist())
        return out.assign(mask=masks)


@register("encoder", "mean_color")
class MeanColorEncoder:
    """The mean colour under the mask, as a vector of unit length."""

    schema = f"frame_id long, {_BOX}, area int, feature array<double>"

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            px = np.stack(r.pixels).astype(float)[np.asarray(r.mask, int)] if len(r.mask) else np.zeros((1, 3))
            mean = px.mean(axis=0)
            out.append((mean / (np.linalg.norm(mean) or 1.0)).tolist())
        keep = rows[["frame_id", "label", "score", "x1", "y1", "x2", "y2"]].reset_index(drop=True)
        return keep.assign(area=[len(m) for m in rows["mask"]], feature=out)


def box_area(prefix: str = "") -> Column:
    """The area of an image box, 0 if its sides cross."""
    c = lambda n: F.col(f"{prefix}{n}")
    return F.greatest(c("x2") - c("x1"), F.lit(0.0)) * F.greatest(c("y2") - c("y1"), F.lit(0.0))


def backprojected(detections: DataFrame, depth: DataFrame, fx: float, fy: float, cx: float, cy: float, r: list[Column], t: list[Column], low: float = 0.1, high: float = 8.0, most: int | None = 20_000, seed: int = 0) -> DataFrame:
    """World points (obs, x, y, z) of detections (obs, frame_id, x1..y2, mask or none) over depth images (frame_id, u, v, m).

    A mask is an array of pixel numbers with the image's width; without one the box counts, its edges rounded. A detection meets the
    rows of its image that it covers by an equal key, so that no pair is outside it. Invalid depths give no point; `most`, a
    semantic of the observation, keeps so many points of one, by the order of a hash.
    """
    valid = depth.where(G.valid_depth(F.col("m"), low, high))
    edge = lambda c: F.rint(c).cast("long")
    d = detections.select("obs", "frame_id", edge("x1").alias("__u0"), edge("x2").alias("__u1"), F.explode(F.when(edge("y2") > edge("y1"), F.sequence(edge("y1"), edge("y2") - 1)).otherwise(F.array().cast("array<long>"))).alias("v"), *(["mask", "width"] if "mask" in detections.columns else []))
    hit = d.join(valid.withColumn("v", F.col("v").cast("long")), ["frame_id", "v"]).where((F.col("u") >= F.col("__u0")) & (F.col("u") < F.col("__u1")))
    if "mask" in detections.columns:
        hit = hit.where(F.col("mask").isNull() | F.array_contains("mask", (F.col("v") * F.col("width") + F.col("u")).cast("int")))
    p = G.unproject(F.col("u"), F.col("v"), F.col("m"), fx, fy, cx, cy)
    w = G.inverse_transform(r, t, p)
    out = hit.select("obs", (F.col("v") * 1_000_000 + F.col("u")).alias("pt"), *[x.alias(k) for x, k in zip(w, G.AXES, strict=True)])
    if most is not None:
        from lattica.operators.panorama import sampled

        out = sampled(out, "obs", "pt", most, seed)
    return out.drop("pt")


def projected_boxes(objects: DataFrame, r: list[Column], t: list[Column], fx: float, fy: float, cx: float, cy: float, width: int, height: int) -> DataFrame:
    """Image boxes of objects: the hull of the corners in front of the camera, two at least, clipped, two pixels at least."""
    corner = G.yaw_corners([F.col(f"c{k}") for k in G.AXES], [F.col(f"{k}1") - F.col(f"{k}0") for k in G.AXES], F.lit(0.0))
    c = objects.select("obj_id", "label", F.explode(corner).alias("p"))
    p = G.transform(r, t, [F.col("p.x"), F.col("p.y"), F.col("p.z")])
    u, v, _ = G.project(p, fx, fy, cx, cy, width, height)
    b = c.select("obj_id", "label", u.alias("u"), v.alias("v")).where("u is not null").groupBy("obj_id", "label").agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.count("*").alias("n")).where("n >= 2")
    clip = lambda x, hi: F.greatest(F.least(F.col(x), F.lit(float(hi))), F.lit(0.0))
    b = b.select("obj_id", "label", clip("u0", width - 1).alias("x1"), clip("v0", height - 1).alias("y1"), clip("u1", width - 1).alias("x2"), clip("v1", height - 1).alias("y2"))
    return b.where("x2 - x1 >= 2 and y2 - y1 >= 2")
