"""Voxel feature fields, clusters, and tracks of objects."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import geometry as G
from lattica.plans import tiles
from lattica.plans.rewrites import connected, greedy_pairs, kept_apart, within_distance

#: Fixed values of the map: voxel size in metres, radius of association, least overlap, cluster reach and size.
SIZE, ASSOC_RADIUS, ASSOC_IOU, EPS, MIN_SAMPLES = 0.05, 0.60, 0.10, 0.08, 3


def keyed(points: DataFrame, size: float = SIZE) -> DataFrame:
    for k in G.AXES:
        points = points.withColumn(f"k{k}", G.voxel_key(F.col(k), size))
    return points


KEY = ("kx", "ky", "kz")


#: What each mode sums up for each dimension: s plain, sw weighted, m the greatest.
MODES = {"mean": ("s",), "confidence_weighted": ("sw",), "max": ("m",)}


def _kinds(mode: str | None) -> tuple[str, ...]:
    return ("s", "sw", "m") if mode is None else MODES[mode]


def fuse(points: DataFrame, size: float = SIZE, dims: int = 4, mode: str | None = None) -> DataFrame:
    """Per voxel: points, weight, and of each dimension the sums of the features and of the weighted features and their maxima,
    or what one mode needs of these.

    Sums and weights are kept apart, so that fields merge and reload exactly; means are taken by `finished`.
    """
    aggs = [F.count("*").alias("n"), F.sum("w").alias("weight")]
    for i in range(dims):
        x = F.get("e", F.lit(i))
        own = {"s": F.sum(x), "sw": F.sum(x * F.col("w")), "m": F.max(x)}
        aggs += [own[k].alias(f"{k}{i}") for k in _kinds(mode)]
    return keyed(points, size).groupBy(*KEY).agg(*aggs)


def merged(*fields: DataFrame, dims: int = 4, mode: str | None = None) -> DataFrame:
    """Several fields as one."""
    out = fields[0]
    for x in fields[1:]:
        out = out.unionByName(x)
    aggs = [F.sum("n").alias("n"), F.sum("weight").alias("weight")]
    for i in range(dims):
        aggs += [(F.max if k == "m" else F.sum)(f"{k}{i}").alias(f"{k}{i}") for k in _kinds(mode)]
    return out.groupBy(*KEY).agg(*aggs)


def added(field: DataFrame | None, batch: DataFrame, dims: int = 4, most: int | None = None) -> DataFrame:
    """A field with a batch's field added. With `most`, voxels that are new to a full field are left out, the first by key kept: a
    bound on what a robot remembers, not on what a query sees."""
    if field is None:
        field = batch.limit(0)
    both = merged(field, batch, dims=dims)
    if most is None:
        return both
    old = field.select(*KEY, F.lit(0).alias("__new"))
    ranked = both.join(old, list(KEY), "left").withColumn("__new", F.coalesce("__new", F.lit(1)))
    return ranked.orderBy("__new", *KEY).limit(max(most, 0)).drop("__new")


def first_labels(points: DataFrame, size: float = SIZE, order: str = "pt") -> DataFrame:
    """(voxel, label, n): the label of each voxel's first point of a batch, which stands for all n of its points."""
    return keyed(points, size).groupBy(*KEY).agg(F.min_by("label", order).alias("label"), F.count("*").alias("n"))


def observed(observations: DataFrame, points: DataFrame, mode: str = "mean") -> DataFrame:
    """points (obs, ...) with the vector e of their observation, and its score as weight w where the mode weighs, else 1."""
    w = F.col("score") if mode == "confidence_weighted" else F.lit(1.0)
    return points.join(observations.select("obs", "label", "e", w.alias("w")), "obs")


def finished(field: DataFrame, mode: str = "mean", dims: int = 4) -> DataFrame:
    """Features of each voxel by mean, max or confidence_weighted."""
    pick = {"mean": lambda i: F.col(f"s{i}") / F.col("n"), "max": lambda i: F.col(f"m{i}"), "confidence_weighted": lambda i: F.col(f"sw{i}") / F.greatest("weight", F.lit(1e-8))}[mode]
    return field.select(*KEY, "n", "weight", *[pick(i).alias(f"f{i}") for i in range(dims)])


def top_labels(points: DataFrame, k: int = 1, size: float = SIZE) -> DataFrame:
    """The k most frequent labels of each voxel, ties by label."""
    votes = keyed(points, size).groupBy(*KEY, "label").agg(F.count("*").alias("votes"))
    w = Window.partitionBy(*KEY).orderBy(F.desc("votes"), "label")
    return votes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bounds(points: DataFrame, size: float = SIZE) -> DataFrame:
    """Least and greatest voxel centres, zeros without points."""
    v = keyed(points, size)
    return v.agg(*[F.coalesce(f(G.voxel_center(F.col(f"k{k}"), size)), F.lit(0.0)).alias(f"{k}{i}") for k in G.AXES for i, f in enumerate((F.min, F.max))])


def dbscan(points: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(id, cluster) for points (id, x, y, z): the least core id of the cluster, -1 for noise.

    A point with min_samples points within eps, itself included, is a core; cores within eps are one cluster; other points
    join the least cluster that has a core within eps.

    Slabs of points meet in tiles, which return counts, the links that unite what they join, and the least clusters in reach
    of points that are no cores: no pair leaves its task.
    """
    keep = kept_apart(points)
    own = points.select("id", *[F.col(k).cast("double").alias(f"c{k}") for k in G.AXES]).where(tiles.finite("cx", "cy", "cz"))
    rows = keep(own.select(F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.col("id").isNotNull().alias("named"), "cx", "cy", "cz"))
    at = lambda t: tiles.arrays(t, ("cx", "cy", "cz"))
    named = lambda t: t["named"].to_numpy()

    def count(a: pa.Table, b: pa.Table, same: bool) -> pa.Table:
        n = sum((np.bincount(i, minlength=len(a)) for i, _ in tiles.near(at(a), at(b), eps)), np.zeros(len(a), np.int64))
        return pa.table({"a": a["id"].to_numpy()[named(a) & (n > 0)], "n": n[named(a) & (n > 0)]})

    counts = tiles.met(rows, "cx", "cx", eps, count, "a long, n long", tiles.SLAB)
    core = keep(counts.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select(F.col("a").alias("id")))
    cores = keep(rows.where("named").join(core, "id", "left_semi"))

    def unite(a: pa.Table, b: pa.Table, same: bool) -> pa.Table:
        ids = np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()])
        least = tiles.united(((i, j + len(a)) for i, j in tiles.near(at(a), at(b), eps)), len(ids))
        x, y = ids, ids[least]
        return pa.table({"a": np.minimum(x, y)[x != y], "b": np.maximum(x, y)[x != y]})

    links = tiles.met(cores, "cx", "cx", eps, unite, "a long, b long", tiles.SLAB, both_ways=False)
    comp = keep(connected(core, links.distinct()))
    marked = keep(rows.where("named").join(comp, "id", "left"))

    def reach(a: pa.Table, b: pa.Table, same: bool) -> pa.Table:
        a, b = a.filter(pc.is_null(a["component"])), b.filter(pc.is_valid(b["component"]))
        least, cluster, found = np.full(len(a), np.iinfo(np.int64).max), b["component"].to_numpy(), np.zeros(len(a), bool)
        for i, j in tiles.near(at(a), at(b), eps):
            np.minimum.at(least, i, cluster[j])
            found[i] = True
        return pa.table({"a": a["id"].to_numpy()[found], "cluster": least[found]})

    border = tiles.met(marked, "cx", "cx", eps, reach, "a long, cluster long", tiles.SLAB).groupBy("a").agg(F.min("cluster").alias("cluster"))
    p = points.select("id")
    return p.join(border, p.id == border.a, "left").join(comp.withColumnRenamed("component", "own"), "id", "left").select("id", F.coalesce("own", "cluster", F.lit(-1)).alias("cluster"))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in [0, 1), saturation and value in [0, 1] of colours from 0 to 255."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    safe = F.when(d == 0, 1.0).otherwise(d)
    h = F.when(d == 0, 0.0).when(hi == r, F.pmod((g - b) / safe, F.lit(6.0))).when(hi == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4) / 6.0
    return h, F.when(hi == 0, 0.0).otherwise(d / F.when(hi == 0, 1.0).otherwise(hi)), hi


def color_histogram(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Bins of each image: cells of a 2 x 2 grid by 8 hues, 4 saturations and 4 values, as shares of the cell's pixels."""
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    cell = F.least(F.floor(F.col("u") * 2 / width), F.lit(1)) + 2 * F.least(F.floor(F.col("v") * 2 / height), F.lit(1))
    of = lambda x, n: F.least(F.floor(x * n), F.lit(n - 1)).cast("int")
    bins = F.array(F.struct(F.lit("h").alias("kind"), of(h, 8).alias("bin")), F.struct(F.lit("s").alias("kind"), of(s, 4).alias("bin")), F.struct(F.lit("v").alias("kind"), of(v, 4).alias("bin")))
    flat = pixels.select("vec_id", cell.cast("int").alias("cell"), F.explode(bins).alias("b")).select("vec_id", "cell", "b.kind", "b.bin")
    counts = flat.groupBy("vec_id", "cell", "kind", "bin").agg(F.count("*").alias("n"))
    total = Window.partitionBy("vec_id", "cell", "kind")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(total))


def color_features(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(vec_id, dim, value): the 72 dimensions of each image region, as a unit vector.

    64 shares: of each cell of a 2 x 2 grid over the image, the pixels by 8 hues, 4 saturations and 4 values. Then the mean hue,
    the mean and deviation of saturation and of value, the aspect of the region's box (a tenth of it, 1 at most), its share of the
    image, and the height of its box's middle. pixels are the region's: (vec_id, u, v, r, g, b).
    """
    shares = color_histogram(pixels, width, height)
    at = F.when(F.col("kind") == "h", 0).when(F.col("kind") == "s", 8).otherwise(12)
    local = shares.select("vec_id", (F.col("cell") * 16 + at + F.col("bin")).cast("int").alias("dim"), F.col("share").alias("x"))
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    p = pixels.select("vec_id", "u", "v", h.alias("__h"), s.alias("__s"), v.alias("__v"))
    wide, high = F.max("u") - F.min("u") + 1, F.max("v") - F.min("v") + 1
    g = p.groupBy("vec_id").agg(
        F.avg("__h").alias("g0"), F.avg("__s").alias("g1"), F.stddev_pop("__s").alias("g2"), F.avg("__v").alias("g3"), F.stddev_pop("__v").alias("g4"),
        (F.least(wide / high, F.lit(10.0)) / 10).alias("g5"), (F.count("*") / F.lit(float(width * height))).alias("g6"), F.least(F.lit(1.0), (F.min("v") + F.max("v") + 1) / 2.0 / height).alias("g7"),
    )
    whole = g.select("vec_id", F.explode(F.array(*[F.struct(F.lit(64 + i).alias("dim"), F.col(f"g{i}").alias("x")) for i in range(8)])).alias("d")).select("vec_id", "d.dim", "d.x")
    every = local.unionByName(whole)
    n = every.groupBy("vec_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return every.join(n, "vec_id").select("vec_id", "dim", F.when(F.col("n") > 1e-8, F.col("x") / F.col("n")).otherwise(F.col("x")).alias("value"))


# ---------------------------------------------------------------------------------------------------- tracks


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of rows to columns with the least total cost, by shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        best, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = c[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = reduced < best[free]
            best[free[better]] = reduced[better]
            way[free[better]] = j0
            j1 = free[np.argmin(best[free])]
            delta = best[j1]
            u[owner[used]] += delta
            v[used] -= delta
            best[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in out)


def match_scores(centre: np.ndarray, box: np.ndarray, seen: np.ndarray, seen_box: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """How well each observation (rows) fits each track: by distance up to the radius, else by overlap; -1 if neither or labels do not fit."""
    d = np.linalg.norm(seen[:, None, :] - centre[None, :, :], axis=2)
    low, high = np.maximum(seen_box[:, None, :3], box[None, :, :3]), np.minimum(seen_box[:, None, 3:], box[None, :, 3:])
    inter = np.prod(np.maximum(high - low, 0.0), axis=2)
    union = np.prod(seen_box[:, 3:] - seen_box[:, :3], axis=1)[:, None] + np.prod(box[:, 3:] - box[:, :3], axis=1)[None, :] - inter
    overlap = np.where(union > 1e-12, inter / np.maximum(union, 1e-12), 0.0)
    score = np.where(d <= ASSOC_RADIUS, 1.0 - d / ASSOC_RADIUS, np.where(overlap >= ASSOC_IOU, overlap, -1.0))
    return np.where(fits, score, -1.0)


class _Tracks:
    """What is known of a scene's tracks: points' sums and counts, boxes, and votes for labels."""

    def __init__(self, fits: np.ndarray):
        self.fits, self.n = fits, 0
        self.sums, self.counts, self.boxes = np.zeros((0, 3)), np.zeros(0), np.zeros((0, 6))
        self.votes = np.zeros((0, len(fits)))

    def scores(self, centre: np.ndarray, box: np.ndarray, label: np.ndarray) -> np.ndarray:
        own = self.votes.argmax(axis=1) if self.n else np.zeros(0, int)
        return match_scores(self.sums / self.counts[:, None], self.boxes, centre, box, self.fits[label][:, own])

    def put(self, t: int | None, centre: np.ndarray, box: np.ndarray, label: int, n: float) -> int:
        if t is None:
            t, self.n = self.n, self.n + 1
            self.sums = np.vstack([self.sums, np.zeros(3)])
            self.counts = np.append(self.counts, 0.0)
            self.boxes = np.vstack([self.boxes, box])
            self.votes = np.vstack([self.votes, np.zeros(self.votes.shape[1])])
        self.sums[t] += centre * n
        self.counts[t] += n
        self.boxes[t] = np.concatenate([np.minimum(self.boxes[t, :3], box[:3]), np.maximum(self.boxes[t, 3:], box[3:])])
        self.votes[t, label] += n
        return t


def associate(frames: pd.DataFrame, one_to_one: bool = True, like: dict[str, frozenset[str]] | None = None) -> pd.DataFrame:
    """Track numbers of one scene's observations, frame by frame: a frame's best assignment, or the best track for each in turn.

    A track's label is that with most votes, the first by name of equals; like says which labels are as good as equal. Rows
    without n_points count as one point.
    """
    names = sorted(frames["label"].fillna("").unique())
    code = {x: i for i, x in enumerate(names)}
    fits = np.array([[a == b or not a or not b or b in (like or {}).get(a, ()) for b in names] for a in names], bool).reshape(len(names), len(names))
    tracks, out = _Tracks(fits), []
    for _, frame in frames.sort_values(["frame", "obj_id"]).groupby("frame", sort=True):
        centre, box = frame[["cx", "cy", "cz"]].to_numpy(float), frame[["x0", "y0", "z0", "x1", "y1", "z1"]].to_numpy(float)
        label = frame["label"].fillna("").map(code).to_numpy()
        n = frame["n_points"].to_numpy(float) if "n_points" in frame else np.ones(len(frame))
        if one_to_one:
            score = tracks.scores(centre, box, label)
            cost = np.hstack([np.where(score < 0, 1e6, -score), np.zeros((len(frame), len(frame)))])  # columns of no track at all
            pick, known = dict(hungarian(cost)), tracks.n
            to = [pick[i] if pick[i] < known and score[i, pick[i]] >= 0 else None for i in range(len(frame))]
        for i, obj in enumerate(frame["obj_id"]):
            if one_to_one:
                t = to[i]
            else:
                own = tracks.scores(centre[i : i + 1], box[i : i + 1], label[i : i + 1])[0]
                t = int(own.argmax()) if len(own) and own.max() >= 0 else None
            out.append((obj, tracks.put(t, centre[i], box[i], label[i], n[i])))
    return pd.DataFrame(out, columns=["obj_id", "track"])


def tracks(observations: DataFrame, one_to_one: bool = True, like: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """(scene, obj_id, track): frames of a scene are taken in order, scenes in parallel."""
    cols = ["scene", "frame", "obj_id", "label", "cx", "cy", "cz", "x0", "y0", "z0", "x1", "y1", "z1", *(["n_points"] if "n_points" in observations.columns else [])]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return associate(pdf, one_to_one, like).assign(scene=pdf["scene"].iloc[0])[["scene", "obj_id", "track"]]

    return observations.select(*cols).groupBy("scene").applyInPandas(run, "scene long, obj_id long, track long")


def same_label_matches(found: DataFrame, truth: DataFrame, reach: float = 2.0) -> DataFrame:
    """Pairs of the same label within reach, nearest first, each object and each truth once."""
    p = within_distance(found.select("label", "obj_id", "cx", "cy", "cz"), truth.select("label", "obj_id", "cx", "cy", "cz"), ("cx", "cy", "cz"), reach).where("a.label = b.label")
    flat = p.select(F.col("a.label").alias("label"), F.col("a.obj_id").alias("obj_id"), F.col("b.obj_id").alias("gt_id"), G.center_distance().alias("distance"))
    return greedy_pairs(flat, "obj_id", "gt_id", ["distance", "obj_id", "gt_id"])


def instance_quality(found: DataFrame, truth: DataFrame, reach: float = 2.0) -> DataFrame:
    """Claims of each truth, objects of its label within reach, and spurious objects that no truth of their label is within reach of."""
    p = within_distance(truth.select("label", "obj_id", "cx", "cy", "cz"), found.select("label", "obj_id", "cx", "cy", "cz"), ("cx", "cy", "cz"), reach).where("a.label = b.label")
    n = p.groupBy(F.col("a.obj_id").alias("gt_id")).agg(F.count("*").alias("claims"))
    every = truth.select(F.col("obj_id").alias("gt_id")).join(n, "gt_id", "left").fillna(0, ["claims"])
    spurious = found.join(p.select(F.col("b.obj_id").alias("obj_id")).distinct(), "obj_id", "left_anti").agg(F.count("*").alias("spurious"))
    out = every.agg(F.count("*").alias("n_gt"), F.sum((F.col("claims") == 0).cast("long")).alias("claims_0"), F.sum((F.col("claims") == 1).cast("long")).alias("claims_1"), F.sum((F.col("claims") >= 2).cast("long")).alias("claims_2"), F.avg(F.greatest(F.col("claims") - 1, F.lit(0))).alias("fragmentation"))
    return out.join(spurious, F.lit(True))
