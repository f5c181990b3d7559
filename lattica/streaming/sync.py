"""Time: proximity joins of streams, poses as of a time, and stateful fusion of points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.rewrites import as_of

#: How far apart frames of one moment may be, and how old a pose may be, in seconds.
SLOP, MAX_AGE = 0.05, 0.5


def nearest_in_time(left: DataFrame, right: DataFrame, by: str, slop: float, t: str = "t", key: str = "id") -> DataFrame:
    """left with the nearest row of right (its key and time) within slop, ties to the earlier; rows without one are dropped.

    An equi-join on buckets of slop, each left row in its own and both next to it; streams call it on what a batch brings and
    the tail of the batch before it.
    """
    b = F.floor(F.col(t) / slop).cast("long")
    spread = left.withColumn("__b", F.explode(F.array(b - 1, b, b + 1)))
    other = right.select(by, F.col(t).alias("t_right"), F.col(key).alias("id_right"), F.floor(F.col(t) / slop).cast("long").alias("__b"))
    near = spread.join(other, [by, "__b"]).where(F.abs(F.col(t) - F.col("t_right")) <= slop).drop("__b")
    return near.groupBy(*left.columns).agg(F.min_by(F.struct("id_right", "t_right"), F.struct(F.abs(F.col(t) - F.col("t_right")).alias("d"), F.col("t_right"), F.col("id_right"))).alias("m")).select(*left.columns, "m.id_right", "m.t_right")


def synchronized(color: DataFrame, depth: DataFrame, info: DataFrame, by: str, slop: float = SLOP) -> DataFrame:
    """Colour rows (id, t) with the nearest depth and the nearest info, only where both are within slop."""
    one = nearest_in_time(color, depth, by, slop).withColumnRenamed("id_right", "depth_id").withColumnRenamed("t_right", "depth_t")
    return nearest_in_time(one, info, by, slop).withColumnRenamed("id_right", "info_id").withColumnRenamed("t_right", "info_t")


def interpolated_pose(frames: DataFrame, poses: DataFrame, by: str, t: str = "t", order: str = "id") -> DataFrame:
    """frames with a pose (px..pz, qx..qw) at their time: between the poses around it, clamped to the first and last.

    Positions are linear; rotations go the shorter way along the arc. Frames without any pose are dropped.
    """
    names = ["px", "py", "pz", "qx", "qy", "qz", "qw"]
    f = as_of(frames, poses, [by], t, order, names)
    f = as_of(f, poses, [by], t, order, names, following=True)
    f = f.withColumn("a", F.coalesce("prev", "next")).withColumn("b", F.coalesce("next", "prev")).where("a is not null")
    span = F.col(f"b.{t}") - F.col(f"a.{t}")
    f = f.withColumn("s", F.when(span > 1e-12, (F.col(t) - F.col(f"a.{t}")) / span).otherwise(0.0))
    dot = sum(F.col(f"a.{q}") * F.col(f"b.{q}") for q in names[3:])
    f = f.withColumn("dot", F.least(F.abs(dot), F.lit(1.0))).withColumn("sign", F.when(dot < 0, -1.0).otherwise(1.0)).withColumn("angle", F.acos("dot"))
    wide = F.sin("angle") > 1e-6
    wa = F.when(wide, F.sin((1 - F.col("s")) * F.col("angle")) / F.sin("angle")).otherwise(1 - F.col("s"))
    wb = F.when(wide, F.sin(F.col("s") * F.col("angle")) / F.sin("angle")).otherwise(F.col("s"))
    out = f.withColumn("wa", wa).withColumn("wb", wb)
    lin = [(F.col(f"a.{p}") + (F.col(f"b.{p}") - F.col(f"a.{p}")) * F.col("s")).alias(p) for p in names[:3]]
    rot = [(F.col("wa") * F.col(f"a.{q}") + F.col("wb") * F.col("sign") * F.col(f"b.{q}")).alias(q) for q in names[3:]]
    return out.select(*frames.columns, *lin, *rot)


def latest_pose(frames: DataFrame, poses: DataFrame, by: str, values: list[str], t: str = "t", order: str = "id", max_age: float = MAX_AGE) -> DataFrame:
    """frames with the last pose before them; null where it is older than max_age."""
    f = as_of(frames, poses, [by], t, order, values)
    fresh = F.col(t) - F.col(f"prev.{t}") <= max_age
    return f.select(*frames.columns, *[F.when(fresh, F.col(f"prev.{v}")).alias(v) for v in values])


# ---------------------------------------------------------------------------------------------------- running queries


def points_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream, so many at a time: a source that falls behind keeps its backlog on disk."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fused_stream(points: DataFrame, size: float = 0.5, dims: int = 4, mode: str | None = None) -> DataFrame:
    """The running field of a stream of points: the same sums as the batch, kept as state by voxel."""
    from lattica.operators.voxels import fuse

    return fuse(points, size, dims, mode)


def answered(questions: DataFrame, answer: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second"):
    """Answer a stream of questions against a table that is read anew for each batch."""
    return questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
