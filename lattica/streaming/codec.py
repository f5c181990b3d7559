"""Messages of frames, maps and answers as JSON, and clocks of seconds and nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME = "struct<frame_id:string,timestamp:double,width:int,height:int,fx:double,fy:double,cx:double,cy:double,image:string>"


def seconds(sec: Column, nanosec: Column) -> Column:
    return sec + nanosec * 1e-9


def stamp(t: Column) -> Column:
    """Whole seconds and nanoseconds, the latter carried over when they round up to a second."""
    sec = F.floor(t)
    nanos = F.round((t - sec) * 1e9).cast("long")
    full = nanos >= 1_000_000_000
    return F.struct(F.when(full, sec + 1).otherwise(sec).cast("long").alias("sec"), F.when(full, nanos - 1_000_000_000).otherwise(nanos).alias("nanosec"))


def encode(df: DataFrame, name: str = "message") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def decode(df: DataFrame, schema: str, name: str = "message") -> DataFrame:
    """Parsed messages; one that is no JSON object has its text in `raw` and nulls elsewhere."""
    parsed = df.select(F.col(name), F.from_json(name, f"{schema}, _corrupt string" if not schema.startswith("struct") else schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("m"))
    return parsed.select("m.*", F.when(F.col("m._corrupt").isNotNull(), F.col(name)).alias("raw")).drop("_corrupt")


def intrinsics(k: Column) -> Column:
    """fx, fy, cx, cy of a row-major 3 x 3 matrix."""
    return F.struct(F.get(k, F.lit(0)).alias("fx"), F.get(k, F.lit(4)).alias("fy"), F.get(k, F.lit(2)).alias("cx"), F.get(k, F.lit(5)).alias("cy"))


def capped_map(objects: DataFrame, most: int = 200) -> DataFrame:
    """The most confident objects of a map as one message."""
    top = objects.orderBy(F.desc("conf"), "obj_id").limit(most)
    return top.agg(F.to_json(F.sort_array(F.collect_list(F.struct("obj_id", "label", "cx", "cy", "cz", "conf")))).alias("message"), F.count("*").alias("n"))
