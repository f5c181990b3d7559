"""Views that bind the operators to the tables at hand, each with the same definition as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def _e(i: int) -> Column:
    return F.get("e", F.lit(i - 1))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes: centre c, corners 0 and 1 on each axis, a label and a confidence."""
    v = _vectors(spark, sf_dir)
    cols = [F.col("vec_id").alias("obj_id"), F.concat(F.lit("class"), F.col("label").cast("string")).alias("label")]
    for k, i in (("x", 1), ("y", 2), ("z", 3)):
        half = F.lit(0.05) + F.abs(_e(i + 3))
        cols += [(_e(i) * 8).alias(f"c{k}"), (_e(i) * 8 - half).alias(f"{k}0"), (_e(i) * 8 + half).alias(f"{k}1")]
    return v.select(*cols, F.least(F.lit(1.0), 0.5 + F.abs(_e(7))).alias("conf"), "e")


OBJECTS = "objects as (select vec_id as obj_id, 'class' || label as label, " + ", ".join(f"8*e[{i}] as c{k}, 8*e[{i}] - (0.05 + abs(e[{i + 3}])) as {k}0, 8*e[{i}] + (0.05 + abs(e[{i + 3}])) as {k}1" for k, i in (("x", 1), ("y", 2), ("z", 3))) + ", least(1.0::double, 0.5 + abs(e[7])) as conf, e from (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty points of each vector: x, y, z, a weight, a label, the frame and the point's order."""
    v = _vectors(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")
    at = lambda i: (F.get("e", F.col("k") * 3 + i) * 8)
    return v.select("vec_id", "label", "e", k).select(
        (F.col("vec_id") * 20 + F.col("k")).alias("pt"), "vec_id", F.concat(F.lit("class"), F.col("label").cast("string")).alias("label"), (F.col("vec_id") % 8).alias("frame"), "k",
        at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), (0.5 + F.abs(_e(64))).alias("w"), "e",
    )


POINTS = "points as (select vec_id*20 + k as pt, vec_id, 'class' || label as label, vec_id % 8 as frame, k, 8*e[3*k+1] as x, 8*e[3*k+2] as y, 8*e[3*k+3] as z, 0.5 + abs(e[64]) as w, e from (select vec_id, label, list_transform(embedding, lambda x: x::double) as e, unnest(range(0, 20)) as k from embeddings))"


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("video_id"), F.col("lang").alias("category"), "text", "n_chars")


CAPTIONS = "captions as (select doc_id as ord, source as video_id, lang as category, text, n_chars from documents)"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each user in order, with the step to the next one: null for the last."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type", (F.row_number().over(w) - 1).alias("idx"), F.lead("value").over(w).alias("next"))
    return d.withColumn("diff", F.abs(F.col("next") - F.col("value"))).drop("next")


SIGNAL = "signal as (select user_id, event_id, ts, value, event_type, row_number() over w - 1 as idx, abs(lead(value) over w - value) as diff from events window w as (partition by user_id order by ts, event_id))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A depth image of 5 x 4 pixels for each vector, with raw depths and colours."""
    p = points(spark, sf_dir)
    return p.select("vec_id", (F.col("k") % 5).alias("u"), F.floor(F.col("k") / 5).cast("int").alias("v"), F.floor(F.abs(F.col("x")) * 1000).cast("int").alias("raw"), *[F.pmod(F.floor(F.abs(F.col(c)) * 997), F.lit(256)).cast("int").alias(n) for n, c in (("r", "x"), ("g", "y"), ("b", "z"))])


PIXELS = POINTS + ", pixels as (select vec_id, k % 5 as u, k // 5 as v, floor(abs(x)*1000)::int as raw, floor(abs(x)*997)::bigint % 256 as r, floor(abs(y)*997)::bigint % 256 as g, floor(abs(z)*997)::bigint % 256 as b from points)"
