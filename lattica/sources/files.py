"""Captions of videos, names of captured frames, gold sets, synthetic data and saved maps."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"camera_([0-9a-f]{32})_(.+)_frame_(\w+)_domain_(\w+)\.(\w+)$"


def clip_captions(spark: SparkSession, path: str) -> DataFrame:
    """Captions of a JSON file with `videos` and `sentences`: each spans its clip; videos without one have a null text."""
    videos = "array<struct<video_id:string,category:int,`start time`:double,`end time`:double,url:string>>"
    doc = spark.read.schema(f"videos {videos}, sentences array<struct<video_id:string,caption:string,sen_id:long>>").option("multiLine", True).json(path)
    v = doc.select(F.explode("videos").alias("v")).select("v.video_id", "v.category", (F.col("v.end time") - F.col("v.start time")).alias("duration"))
    s = doc.select(F.explode("sentences").alias("s")).select(F.col("s.video_id").alias("id"), F.col("s.caption").alias("text"), F.col("s.sen_id").alias("ord"))
    return v.join(s, F.col("video_id") == F.col("id"), "left").select("video_id", "category", "duration", "text", "ord", F.lit(0.0).alias("start"), F.col("duration").alias("end"))


def clip_captions_zip(spark: SparkSession, path: str) -> DataFrame:
    """The same of the first JSON file, by name, in a zip archive, which is read as bytes by whatever store holds it."""
    import io
    import zipfile

    raw = spark.read.format("binaryFile").load(path).select("content").first()
    with zipfile.ZipFile(io.BytesIO(bytes(raw.content))) as z:
        names = sorted(n for n in z.namelist() if n.endswith(".json"))
        if not names:
            raise ValueError(f"{path} holds no JSON file")
        doc = json.loads(z.read(names[0]))
    v = spark.createDataFrame([(x["video_id"], x.get("category"), float(x.get("end time", 0)) - float(x.get("start time", 0))) for x in doc["videos"]], "video_id string, category int, duration double")
    s = spark.createDataFrame([(x["video_id"], x["caption"], x.get("sen_id")) for x in doc["sentences"]], "id string, text string, ord long")
    return v.join(s, F.col("video_id") == F.col("id"), "left").select("video_id", "category", "duration", "text", "ord", F.lit(0.0).alias("start"), F.col("duration").alias("end"))


def with_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """df, if it has all required columns; else an error that names those it lacks."""
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df


def timed_captions(spark: SparkSession, path: str) -> DataFrame:
    """Captions of a JSON file with `database`: sentences and time stamps by position, the whole video where one is missing."""
    entry = "struct<duration:double,timestamps:array<array<double>>,sentences:array<string>>"
    doc = spark.read.schema(f"database map<string,{entry}>").option("multiLine", True).json(path)
    v = doc.select(F.explode("database").alias("video_id", "e")).select("video_id", "e.duration", "e.timestamps", F.posexplode("e.sentences").alias("ord", "text"))
    span = F.get("timestamps", F.col("ord"))
    return v.select("video_id", "duration", "ord", "text", F.coalesce(F.get(span, F.lit(0)), F.lit(0.0)).alias("start"), F.coalesce(F.get(span, F.lit(1)), "duration").alias("end"))


def synthetic_captions(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n videos with three captions each, made of a hash."""
    words = F.array(*[F.lit(w) for w in ("a", "dog", "cat", "man", "runs", "sits", "cooks", "on", "the", "road", "table", "slowly")])
    ids = spark.range(n).withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(2))))
    pick = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.col("ord"), i, F.lit(seed)), F.lit(12)) + 1).cast("int")))
    return ids.select(F.format_string("synthetic%d", "id").alias("video_id"), "ord", F.array_join(pick, " ").alias("text"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(150)) + 1).cast("double").alias("duration"))


_SOURCES: dict[str, Callable[..., DataFrame]] = {"clips": clip_captions, "clips_zip": clip_captions_zip, "timed": timed_captions, "synthetic": synthetic_captions}


def build_source(name: str) -> Callable[..., DataFrame]:
    if name not in _SOURCES:
        raise ValueError(f"no source is called {name}; there are {', '.join(sorted(_SOURCES))}")
    return _SOURCES[name]


def name_parts(paths: DataFrame) -> DataFrame:
    """Capture, room, frame and kind of image of each path that is named so."""
    at = lambda i: F.regexp_extract("path", NAME, i)
    return paths.where(F.col("path").rlike(NAME)).select("path", at(1).alias("uuid"), at(2).alias("room"), at(3).alias("frame"), at(4).alias("modality"))


def locations(paths: DataFrame) -> DataFrame:
    """Captures with their numbered frames in order."""
    p = name_parts(paths).where(F.col("frame").rlike(r"^\d+$"))
    return p.groupBy("uuid", "room").agg(F.array_sort(F.collect_set(F.col("frame").cast("int"))).alias("frames"))


def select_location(found: DataFrame, prefix: str | None = None, room: str | None = None, index: int = 0, least: int = 1) -> DataFrame:
    """One capture with enough frames: the first by uuid prefix, or the index-th by frames among those of a room."""
    ok = found.where(F.size("frames") >= least)
    if prefix:
        ok = ok.where(F.col("uuid").startswith(prefix)).orderBy("uuid")
    else:
        if room:
            ok = ok.where((F.col("room") == room) | F.col("room").startswith(room + "_"))
        ok = ok.orderBy(F.desc(F.size("frames")), "uuid").offset(index)
    one = ok.limit(1)
    if one.isEmpty():
        raise ValueError(f"no capture with {least} frames fits")
    return one


def semantic_class(name: Column) -> Column:
    """A class without the number of its instance."""
    return F.regexp_replace(F.lower(name), r"[-_]?\d+$", "")


def save_goldset(gold: Mapping[str, list[int]], notes: Mapping[str, object], path: str) -> None:
    with open(path, "w") as f:
        json.dump({**{k if k.startswith("_") else f"_{k}": v for k, v in notes.items()}, **gold}, f)


def load_goldset(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, idx) of a gold set; names that start with an underscore are notes."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    e = doc.select(F.explode("m").alias("video_id", "v")).where(~F.col("video_id").startswith("_"))
    return e.select("video_id", F.explode(F.from_json("v", "array<long>")).alias("idx"))


def save_map(field: DataFrame, objects: DataFrame, meta: Mapping[str, object], path: str) -> None:
    """A map as two tables and a line of JSON; sums and weights of voxels are kept apart."""
    field.write.mode("overwrite").parquet(f"{path}/voxels")
    objects.write.mode("overwrite").parquet(f"{path}/objects")
    field.sparkSession.createDataFrame([(json.dumps(dict(meta)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    return spark.read.parquet(f"{path}/voxels"), spark.read.parquet(f"{path}/objects"), json.loads(spark.read.text(f"{path}/meta").first().value)
