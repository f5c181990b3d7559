"""Geometry on flat columns: metres, world z up, camera x right, y down, z forward, pixels (u, v)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: The thresholds of spatial relations, in metres or as ratios.
NEAR, ABOVE, INSIDE, AXIS, ADJACENT = 0.50, 0.10, 0.60, 0.15, 0.15


def _c(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}.{name}" if prefix else name)


def length(parts: Sequence[Column]) -> Column:
    return F.sqrt(sum(p * p for p in parts))


def center_distance(a: str = "a", b: str = "b") -> Column:
    return length([_c(a, f"c{k}") - _c(b, f"c{k}") for k in AXES])


def bbox_gap(a: str = "a", b: str = "b") -> Column:
    return length([F.greatest(F.lit(0.0), _c(a, f"{k}0") - _c(b, f"{k}1"), _c(b, f"{k}0") - _c(a, f"{k}1")) for k in AXES])


def containment(inner: str = "a", outer: str = "b") -> Column:
    """Share of the 27 lattice points of the inner box that lie in the outer one: a product over the axes."""
    out = F.lit(1.0)
    for k in AXES:
        lo, hi = F.least(_c(inner, f"{k}0"), _c(inner, f"{k}1")), F.greatest(_c(inner, f"{k}0"), _c(inner, f"{k}1"))
        hits = sum(p.between(_c(outer, f"{k}0"), _c(outer, f"{k}1")).cast("int") for p in (lo, (lo + hi) / 2, hi))
        out = out * hits / 3.0
    return out


def volume(a: str) -> Column:
    out = F.lit(1.0)
    for k in AXES:
        out = out * F.greatest(_c(a, f"{k}1") - _c(a, f"{k}0"), F.lit(0.0))
    return out


def iou(a: str = "a", b: str = "b") -> Column:
    """Overlap of two boxes along the axes; 0 where the union has no volume."""
    inter = F.lit(1.0)
    for k in AXES:
        inter = inter * F.greatest(F.least(_c(a, f"{k}1"), _c(b, f"{k}1")) - F.greatest(_c(a, f"{k}0"), _c(b, f"{k}0")), F.lit(0.0))
    union = volume(a) + volume(b) - inter
    return F.when(union <= 1e-12, 0.0).otherwise(inter / F.greatest(union, F.lit(1e-12)))


def contains_point(box: str, x: Column, y: Column, z: Column, margin: float = 0.0) -> Column:
    out = F.lit(True)
    for k, p in zip(AXES, (x, y, z), strict=True):
        out = out & p.between(_c(box, f"{k}0") - margin, _c(box, f"{k}1") + margin)
    return out


def relation(a: str = "a", b: str = "b") -> Column:
    """How a lies to b: inside, above, below, overlapping, near, left_of, right_of, in_front_of, behind or unknown."""
    delta = {k: _c(a, f"c{k}") - _c(b, f"c{k}") for k in AXES}
    size = lambda p, k: F.abs(_c(p, f"{k}1") - _c(p, f"{k}0"))
    n = {k: delta[k] / F.greatest((size(a, k) + size(b, k)) / 2, F.lit(1e-3)) for k in AXES}
    m = {k: F.abs(v) for k, v in n.items()}
    strength = F.greatest(*m.values())
    gap, d = bbox_gap(a, b), center_distance(a, b)
    close = F.when(d <= NEAR, "near").otherwise("unknown")
    vertical = (m["z"] > m["x"]) & (m["z"] > m["y"])  # the first axis wins a tie
    sideways = m["x"] >= m["y"]
    return (
        F.when(containment(a, b) >= INSIDE, "inside")
        .when(_c(a, "z0") >= _c(b, "z1") - 1e-9, "above")
        .when(_c(a, "z1") <= _c(b, "z0") + 1e-9, "below")
        .when(strength < AXIS, F.when(gap <= 1e-6, "overlapping").otherwise(close))
        .when(vertical, F.when(F.abs(delta["z"]) < ABOVE, close).when(n["z"] > 0, "above").otherwise("below"))
        .when(gap <= ADJACENT, "near")
        .when(sideways, F.when(n["x"] > 0, "right_of").otherwise("left_of"))
        .otherwise(F.when(n["y"] > 0, "in_front_of").otherwise("behind"))
    )


def voxel_key(x: Column, size: float, origin: float = 0.0) -> Column:
    """Index of the cell along one axis; negative coordinates go down."""
    if size <= 0:
        raise ValueError("voxel size must be positive")
    return F.floor((x - origin) / size).cast("long")


def voxel_center(k: Column, size: float, origin: float = 0.0) -> Column:
    return (k + 0.5) * size + origin


# ---- cameras: world to camera is p_cam = R p + t, with R as nine columns r0..r8 and t as t0..t2


def transform(r: Sequence[Column], t: Sequence[Column], p: Sequence[Column]) -> list[Column]:
    return [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3)]


def inverse_transform(r: Sequence[Column], t: Sequence[Column], p: Sequence[Column]) -> list[Column]:
    q = [p[i] - t[i] for i in range(3)]
    return [r[i] * q[0] + r[3 + i] * q[1] + r[6 + i] * q[2] for i in range(3)]


def camera_center(r: Sequence[Column], t: Sequence[Column]) -> list[Column]:
    return [-(r[i] * t[0] + r[3 + i] * t[1] + r[6 + i] * t[2]) for i in range(3)]


def compose(r1: Sequence, t1: Sequence, r2: Sequence, t2: Sequence) -> tuple[list, list]:
    """First pose 2, then pose 1."""
    r = [sum(r1[3 * i + k] * r2[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]
    return r, [sum(r1[3 * i + k] * t2[k] for k in range(3)) + t1[i] for i in range(3)]


def inverse_pose(r: Sequence[Column], t: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    return [r[3 * j + i] for i in range(3) for j in range(3)], camera_center(r, t)


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Rotation of a quaternion of any length; the identity for a zero one."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    ok = n > 1e-12
    x, y, z, w = (F.when(ok, q / n).otherwise(1.0 if i == 3 else 0.0) for i, q in enumerate((x, y, z, w)))
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def project(p: Sequence[Column], fx, fy, cx, cy, width: int, height: int) -> tuple[Column, Column, Column]:
    """u, v and whether a camera point is in the image; null u and v behind the camera."""
    front = p[2] > 1e-6
    u, v = F.when(front, fx * p[0] / p[2] + cx), F.when(front, fy * p[1] / p[2] + cy)
    inside = front & u.between(0, width - 1) & v.between(0, height - 1)
    return u, v, F.coalesce(inside, F.lit(False))


def in_frustum(p: Sequence[Column], fx, fy, cx, cy, width: int, height: int, margin: float = 0.0) -> Column:
    u, v = fx * p[0] / p[2] + cx, fy * p[1] / p[2] + cy
    return F.when(p[2] > 1e-6, u.between(-margin, width - 1 + margin) & v.between(-margin, height - 1 + margin)).otherwise(False)


def unproject(u: Column, v: Column, z: Column, fx, fy, cx, cy) -> list[Column]:
    return [(u - cx) * z / fx, (v - cy) * z / fy, z]


def raw_depth(raw: Column, scale: float, invalid: int | None = None) -> Column:
    bad = (raw == 0) if invalid is None else (raw == 0) | (raw == invalid)
    return F.when(bad, 0.0).otherwise(raw / scale)


def valid_depth(d: Column, low: float = 0.10, high: float = 8.00) -> Column:
    """Finite and strictly between the bounds."""
    return F.coalesce(~F.isnan(d) & (d > low) & (d < high), F.lit(False))


def ray(u: Column, v: Column, fx, fy, cx, cy) -> list[Column]:
    x, y = (u - cx) / fx, (v - cy) / fy
    n = F.sqrt(x * x + y * y + 1.0)
    return [x / n, y / n, 1.0 / n]


def equirect_pixel(x: Column, y: Column, z: Column, width: int, height: int) -> tuple[Column, Column]:
    """Column and row of a unit direction: azimuth wraps, elevation is clipped, row 0 looks up."""
    az, el = F.atan2(y, x), F.asin(F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0)))
    u = F.pmod(F.floor((az / (2 * math.pi) + 0.5) * width), F.lit(width))
    v = F.greatest(F.least(F.floor((0.5 - el / math.pi) * height), F.lit(height - 1)), F.lit(0))
    return u.cast("long"), v.cast("long")


def equirect_direction(u: Column, v: Column, width: int, height: int) -> list[Column]:
    az, el = ((u + 0.5) / width - 0.5) * (2 * math.pi), (0.5 - (v + 0.5) / height) * math.pi
    return [F.cos(el) * F.cos(az), F.cos(el) * F.sin(az), F.sin(el)]


def angle_weight(cos: Column, power: float = 2.0, least: float = 0.35) -> Column:
    return F.when(cos >= least, F.pow(cos, F.lit(power))).otherwise(0.0)


def yaw_corners(c: Sequence[Column], size: Sequence[Column], yaw: Column) -> Column:
    """The eight corners of a box with full sizes that is turned about z."""
    out = []
    for sx in (-0.5, 0.5):
        for sy in (-0.5, 0.5):
            for sz in (-0.5, 0.5):
                x, y = size[0] * sx, size[1] * sy
                out.append(F.struct((c[0] + x * F.cos(yaw) - y * F.sin(yaw)).alias("x"), (c[1] + x * F.sin(yaw) + y * F.cos(yaw)).alias("y"), (c[2] + size[2] * sz).alias("z")))
    return F.array(*out)


def surface_lattice(grid: int = 6) -> list[tuple[float, float, float]]:
    """Points on the faces of the unit box around the origin: grid * grid on each of six."""
    ticks = [i / (grid - 1) - 0.5 for i in range(grid)]
    out = []
    for axis in range(3):
        for side in (-0.5, 0.5):
            for a in ticks:
                for b in ticks:
                    p = [a, b]
                    p.insert(axis, side)
                    out.append(tuple(p))
    return out


def clip_polygon(subject: list[tuple[float, float]], clip: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a polygon inside a convex one that runs counter-clockwise."""
    for (ax, ay), (bx, by) in pairwise([*clip, clip[0]]):
        side = lambda p, ax=ax, ay=ay, bx=bx, by=by: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        out = []
        for p, q in pairwise([*subject, subject[0]] if subject else []):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        subject = out
    return subject


def polygon_area(p: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in pairwise([*p, p[0]]))) / 2 if len(p) > 2 else 0.0


def yaw_box_iou(a: Sequence[float], b: Sequence[float]) -> float:
    """Overlap of two boxes (centre, full sizes, yaw); 0 for fewer than six values."""
    if len(a) < 6 or len(b) < 6:
        return 0.0
    (a, b) = ([*x, 0.0][:7] for x in (a, b))

    def floor_plan(x: Sequence[float]) -> list[tuple[float, float]]:
        c, s = math.cos(x[6]), math.sin(x[6])
        return [(x[0] + dx * x[3] * c - dy * x[4] * s, x[1] + dx * x[3] * s + dy * x[4] * c) for dx, dy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))]

    high = min(a[2] + a[5] / 2, b[2] + b[5] / 2) - max(a[2] - a[5] / 2, b[2] - b[5] / 2)
    if high <= 0:
        return 0.0
    inter = polygon_area(clip_polygon(floor_plan(a), floor_plan(b))) * high
    union = a[3] * a[4] * a[5] + b[3] * b[4] * b[5] - inter
    return inter / union if union > 1e-12 else 0.0


def look_at(eye: Sequence[Column], target: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """The pose of a camera at eye that looks at target with world z up: x right, y down, z forward. The identity if the two are
    one point; where the view is vertical, x is to the right."""
    f = [b - a for a, b in zip(eye, target, strict=True)]
    n = length(f)
    same = n < 1e-9
    z = [x / F.when(same, 1.0).otherwise(n) for x in f]
    right = [z[1], -z[0], F.lit(0.0)]  # forward x up
    m = length(right[:2])
    steep = m < 1e-6
    x = [F.when(steep, F.lit(float(i == 0))).otherwise(r / F.when(steep, 1.0).otherwise(m)) for i, r in enumerate(right)]
    y = [z[1] * x[2] - z[2] * x[1], z[2] * x[0] - z[0] * x[2], z[0] * x[1] - z[1] * x[0]]
    r = [F.when(same, F.lit(float(i == j))).otherwise(row[j]) for i, row in enumerate((x, y, z)) for j in range(3)]
    t = [-(r[3 * i] * eye[0] + r[3 * i + 1] * eye[1] + r[3 * i + 2] * eye[2]) for i in range(3)]
    return r, t


def scaled_intrinsics(fx, fy, cx, cy, sx: float, sy: float):
    return fx * sx, fy * sy, cx * sx, cy * sy


def cropped_intrinsics(fx, fy, cx, cy, left: float, upper: float):
    return fx, fy, cx - left, cy - upper


def matrix_quaternion(m: Sequence[Column]) -> list[Column]:
    """x, y, z, w of a rotation, w not negative: by the greatest of the four, so that nothing small is divided by."""
    tr = m[0] + m[4] + m[8]
    parts = (tr, m[0] - m[4] - m[8], m[4] - m[0] - m[8], m[8] - m[0] - m[4])
    best = F.greatest(*parts)
    s = F.sqrt(best + 1.0) * 2
    w4 = [(m[7] - m[5]) / s, (m[2] - m[6]) / s, (m[3] - m[1]) / s, s / 4]
    x4 = [s / 4, (m[1] + m[3]) / s, (m[2] + m[6]) / s, (m[7] - m[5]) / s]
    y4 = [(m[1] + m[3]) / s, s / 4, (m[5] + m[7]) / s, (m[2] - m[6]) / s]
    z4 = [(m[2] + m[6]) / s, (m[5] + m[7]) / s, s / 4, (m[3] - m[1]) / s]
    out = [F.when(parts[0] >= best, a).when(parts[1] >= best, b).when(parts[2] >= best, c).otherwise(d) for a, b, c, d in zip(w4, x4, y4, z4, strict=True)]
    flip = F.when(out[3] < 0, -1.0).otherwise(1.0)
    return [q * flip for q in out]


def euler_matrix(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """Rotation about x, then y, then z."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr]


#: Axes of a body (x forward, y left, z up) seen by a camera (x right, y down, z forward).
OPTICAL = (0.0, -1.0, 0.0, 0.0, 0.0, -1.0, 1.0, 0.0, 0.0)


def odometry_pose(p: Sequence[Column], q: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """World-to-camera pose of a camera on a body at p with the rotation q (x, y, z, w)."""
    body = quaternion_matrix(*q)
    inv = [body[3 * j + i] for i in range(3) for j in range(3)]
    r = [sum(OPTICAL[3 * i + k] * inv[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]
    return r, [-(r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2]) for i in range(3)]


# ---- more ways to a pose, and pixels


def pixel_grid(spark, width: int, height: int):
    """(u, v) of every pixel of an image, row by row."""
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("u"), F.floor(F.col("id") / width).cast("int").alias("v"))


IDENTITY = tuple(1.0 if i % 4 == 0 else 0.0 for i in range(9))


def identity_pose() -> tuple[list[Column], list[Column]]:
    return [F.lit(x) for x in IDENTITY], [F.lit(0.0)] * 3


def pose_of_matrix(m: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """World-to-camera pose of a row-major 3 x 4 or 4 x 4 matrix."""
    if len(m) not in (12, 16):
        raise ValueError("a pose has 12 or 16 numbers")
    return [m[4 * i + j] for i in range(3) for j in range(3)], [m[4 * i + 3] for i in range(3)]


def matrix_of_pose(r: Sequence[Column], t: Sequence[Column]) -> list[Column]:
    """The row-major 4 x 4 matrix of a pose."""
    return [x for i in range(3) for x in (*r[3 * i : 3 * i + 3], t[i])] + [F.lit(0.0)] * 3 + [F.lit(1.0)]


def pose_of_camera_to_world(r: Sequence[Column], t: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """World-to-camera pose of one that takes the camera's points to the world."""
    return inverse_pose(r, t)


#: Axes of a depth scanner (x right, y forward, z up) seen by a camera (x right, y down, z forward).
SCANNER = (1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 1.0, 0.0)


def pose_of_tilt(tilt: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """World-to-camera pose of a scene whose tilt takes the scanner's axes to the world's: a camera at the origin."""
    inv = [tilt[3 * j + i] for i in range(3) for j in range(3)]
    return [sum(SCANNER[3 * i + k] * inv[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)], [F.lit(0.0)] * 3


def pose_from_json(rows: Column) -> Column:
    """r (nine) and t (three) of a pose written as 3 rows of 4 or, turned, 4 rows of 3; null if it is neither."""
    three = (F.size(rows) == 3) & F.forall(rows, lambda x: F.size(x) == 4)
    four = (F.size(rows) == 4) & F.forall(rows, lambda x: F.size(x) == 3)
    at = lambda i, j: F.when(three, F.get(F.get(rows, F.lit(i)), F.lit(j))).when(four, F.get(F.get(rows, F.lit(j)), F.lit(i)))
    return F.when(three | four, F.struct(F.array(*[at(i, j) for i in range(3) for j in range(3)]).alias("r"), F.array(*[at(i, 3) for i in range(3)]).alias("t")))


def turned_box_hit(o: Sequence[Column], d: Sequence[Column], c: Sequence[Column], size: Sequence[Column], yaw: Column) -> Column:
    """How far a ray from o along d is from the first face that it meets of a box turned about z; null if it misses."""
    cos, sin = F.cos(yaw), F.sin(yaw)
    p = [o[i] - c[i] for i in range(3)]
    p = [p[0] * cos + p[1] * sin, -p[0] * sin + p[1] * cos, p[2]]
    q = [d[0] * cos + d[1] * sin, -d[0] * sin + d[1] * cos, d[2]]
    low, high = [], []
    for i in range(3):
        safe = F.when(F.abs(q[i]) < 1e-12, F.lit(1e-12)).otherwise(q[i])
        a, b = (-size[i] / 2 - p[i]) / safe, (size[i] / 2 - p[i]) / safe
        low.append(F.least(a, b))
        high.append(F.greatest(a, b))
    near, far = F.greatest(*low), F.least(*high)
    return F.when((near <= far) & (far > 0), F.when(near > 0, near).otherwise(far))
