"""Indexes of captured scenes: boxes, depth and class images, label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.files import semantic_class, with_columns

#: Raw units per metre of the depth images, and the raw value that means none.
DEPTH_SCALES = {"default": 1000.0, "indoor": 10000.0, "panorama": 512.0}
NO_DEPTH = 65535


def index_boxes(scenes: DataFrame) -> DataFrame:
    """One row for each box of scenes (scene_id, boxes: label, center, basis, coeffs): full sizes, heading about z; boxes without
    a positive size are dropped, as are scenes without a calibration."""
    s = scenes.where("k is not null and size(k) = 9 and rtilt is not null")
    b = s.select("scene_id", F.posexplode("boxes").alias("i", "b"))
    size = [F.abs(F.get("b.coeffs", F.lit(i))) * 2 for i in range(3)]
    out = b.select("scene_id", "i", F.col("b.label").alias("label"), *[F.get("b.center", F.lit(i)).alias(f"c{k}") for i, k in enumerate("xyz")], *[x.alias(f"d{k}") for x, k in zip(size, "xyz", strict=True)], F.atan2(F.get("b.basis", F.lit(1)), F.get("b.basis", F.lit(0))).alias("heading"))
    return out.where("dx > 0 and dy > 0 and dz > 0")


#: Columns of a scene index.
INDEX = ["scene_id", "boxes", "start", "stop", "k", "rtilt"]


def load_index(spark, path: str) -> DataFrame:
    """A scene index that was written as Parquet; one that lacks a column is refused."""
    return with_columns(spark.read.parquet(path), INDEX)


def captured_depth(raw: Column, kind: str = "panorama") -> Column:
    """Metres of a raw depth of a kind of capture; 0 where there is none."""
    return F.when((raw == 0) | (raw == NO_DEPTH), 0.0).otherwise(raw / DEPTH_SCALES[kind])


def resized(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """The nearest pixels of images (frame, u, v, ...) at another size: each new pixel takes that under its centre. Intrinsics
    follow by geometry.scaled_intrinsics with to_width / width and to_height / height."""
    new = pixels.sparkSession.range(to_width * to_height).select((F.col("id") % to_width).cast("int").alias("__u"), F.floor(F.col("id") / to_width).cast("int").alias("__v"))
    new = new.select("__u", "__v", F.least(F.floor((F.col("__u") + 0.5) * width / to_width), F.lit(width - 1)).cast("int").alias("u"), F.least(F.floor((F.col("__v") + 0.5) * height / to_height), F.lit(height - 1)).cast("int").alias("v"))
    kept = [c for c in pixels.columns if c not in ("u", "v")]
    out = pixels.withColumns({"u": F.col("u").cast("int"), "v": F.col("v").cast("int")}).join(new, ["u", "v"])
    return out.select(*kept, F.col("__u").alias("u"), F.col("__v").alias("v"))


def box_slices(flat: DataFrame) -> DataFrame:
    """Boxes of each scene out of one flat array and its offsets: rows (scene_id, box)."""
    return flat.select("scene_id", F.explode(F.slice("boxes", F.col("start") + 1, F.col("stop") - F.col("start"))).alias("box"))


def label_histogram(boxes: DataFrame, k: int = 20) -> DataFrame:
    return boxes.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k)


def sampled_scenes(scenes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k scenes with boxes, by the order of a hash."""
    from lattica.functions.text import stable_hash

    return scenes.where("n_boxes > 0").orderBy(stable_hash(F.concat_ws("#", F.col("scene_id").cast("string"), F.lit(str(seed)))), "scene_id").limit(k)


def class_at(r: Column, g: Column, b: Column, names: Column) -> Column:
    """The class that a colour of a class image names: its 24 bits are an index; null beyond the list."""
    return semantic_class(F.get(names, (r * 65536 + g * 256 + b).cast("int")))


def class_name(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case, underscores for spaces, then its alias if there is one."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_")
    if not aliases:
        return low
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(table, low), low)


def of_classes(objects: DataFrame, wanted: list[str]) -> DataFrame:
    """Objects whose class holds a wanted name or is held by one; all of them if none is wanted."""
    names = [w.strip().lower() for w in wanted if w.strip()]
    if not names:
        return objects
    c = semantic_class(F.col("label"))
    return objects.where(F.exists(F.array(*[F.lit(n) for n in names]), lambda w: c.contains(w) | w.contains(c)))


def aligned_boxes(objects: DataFrame) -> DataFrame:
    """Boxes (centre, full sizes no less than 1e-6, heading 0) of corners that are finite."""
    ok = F.lit(True)
    for k in "xyz":
        for i in (0, 1):
            ok = ok & F.col(f"{k}{i}").isNotNull() & ~F.isnan(f"{k}{i}") & (F.abs(f"{k}{i}") < float("inf"))
    return objects.where(ok).select("obj_id", "label", *[((F.col(f"{k}0") + F.col(f"{k}1")) / 2).alias(f"c{k}") for k in "xyz"], *[F.greatest(F.col(f"{k}1") - F.col(f"{k}0"), F.lit(1e-6)).alias(f"d{k}") for k in "xyz"], F.lit(0.0).alias("heading"))


def coco(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Categories, numbered from 1 by name, and annotations as JSON lines of accepted labels (frame_id, label, score, box)."""
    ok = labels.where("reason = ''")
    names = ok.select("label").distinct()
    categories = names.select(F.dense_rank().over(Window.orderBy("label")).alias("id"), F.col("label").alias("name"))  # class names
    a = ok.join(F.broadcast(categories), F.col("label") == F.col("name"))
    box = F.array(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return categories, a.select(F.to_json(F.struct(F.col("frame_id").alias("image_id"), F.col("id").alias("category_id"), box.alias("bbox"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), "score")).alias("line"))


def boxes3d(labels: DataFrame) -> DataFrame:
    """Accepted labels (frame_id, label, score, c, sizes) as JSON lines of boxes in space."""
    ok = labels.where("reason = ''")
    return ok.select(F.to_json(F.struct("frame_id", "label", "score", F.array(*[F.col(f"c{k}") for k in "xyz"]).alias("center"), F.array(*[F.col(f"{k}1") - F.col(f"{k}0") for k in "xyz"]).alias("size"))).alias("line"))


def review(labels: DataFrame, below: float = 0.5) -> DataFrame:
    """What a person should look at: refused labels with their reason, and accepted ones that are unsure, the least sure first."""
    why = F.when(F.col("reason") != "", F.col("reason")).when(F.col("score") < below, "unsure")
    return labels.withColumn("why", why).where("why is not null").orderBy("score", "frame_id", "label").select(F.to_json(F.struct("frame_id", "label", "score", "why")).alias("line"))


def write_labels(labels: DataFrame, path: str) -> None:
    """The four outputs of an automatic labelling: categories, annotations, boxes in space where there are any, and what to review."""
    categories, annotations = coco(labels)
    categories.orderBy("id").write.mode("overwrite").json(f"{path}/categories")
    annotations.write.mode("overwrite").text(f"{path}/annotations")
    if {"cx", "x0", "x1"} <= set(labels.columns):
        boxes3d(labels).write.mode("overwrite").text(f"{path}/boxes3d")
    review(labels).write.mode("overwrite").text(f"{path}/review")


def frames_per_capture(locations: DataFrame) -> DataFrame:
    n = F.size("frames")
    return locations.agg(F.min(n).alias("least"), F.median(n).alias("median"), F.max(n).alias("most"), F.count("*").alias("captures"))


def picked_frames(frames: DataFrame, by: str, k: int) -> DataFrame:
    """k frames of each capture at even distances, the first and last among them, halves rounded to even."""
    w = Window.partitionBy(by)
    f = frames.withColumn("__i", F.row_number().over(w.orderBy("frame")) - 1).withColumn("__n", F.count("*").over(w))
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.rint(j * (F.col("__n") - 1) / max(k - 1, 1)).cast("int"))
    return f.where((F.col("__n") <= k) | F.array_contains(at, F.col("__i"))).drop("__i", "__n")
