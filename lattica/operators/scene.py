"""A map of a scene as a bundle of tables, and what can be asked of it."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import geometry as G
from lattica.functions.kernels import nearest_in_turn
from lattica.operators import language as L
from lattica.operators import mapping as M
from lattica.operators import replies as R
from lattica.operators import spatial as S
from lattica.operators import voxels as V
from lattica.plans.rewrites import served_in_turn, within_distance
from lattica.plans.tiles import finite
from lattica.sources import files


@dataclass
class SceneMap:
    """Objects, voxels and notes. Every method is a lazy DataFrame but answer(), which reads one question on the driver."""

    objects: DataFrame
    voxels: DataFrame | None = None
    meta: dict[str, Any] = field(default_factory=dict)
    attached: DataFrame | None = None  # (kx, ky, kz, obj_id)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SceneMap:
        voxels, objects, meta = files.load_map(spark, path)
        return cls(objects, voxels, meta)

    def save(self, path: str) -> None:
        if self.voxels is None:
            raise ValueError("a map without voxels is not saved")
        files.save_map(self.voxels, self.objects, self.meta, path)

    def labels(self) -> DataFrame:
        return L.answer_describe(self.objects)

    def near(self, point: tuple[float, float, float], radius: float | None = None, k: int | None = None) -> DataFrame:
        return S.near(self.objects, point, radius, k)

    def query_text(self, text: str, k: int = 5, threshold: float = L.LEXICAL, level: str = "auto", embedding: L.TextMatcher | None = None) -> DataFrame:
        """Objects and voxels that fit a text, best first: (level, obj_id, kx, ky, kz, label, score, rank).

        auto asks the objects, and the voxels if no object is accepted; object and voxel ask one of them. Voxels of accepted
        objects are left out. embedding scores vectors against the text; without one only names count.
        """
        objects = self._scored(self.objects, text, embedding)
        found = L.ranked(objects, k, threshold, embedding.threshold if embedding else 2.0).select(F.lit("object").alias("level"), "obj_id", *[F.lit(None).cast("long").alias(c) for c in V.KEY], "label", "score", "rank")
        if level == "object" or self.voxels is None:
            return found.where(F.lit(level != "voxel"))
        voxels = L.ranked(self._scored(self._labelled_voxels(), text, embedding).withColumn("conf", F.lit(1.0)).withColumn("obj_id", F.xxhash64(*V.KEY)), 1 << 30, threshold, embedding.threshold if embedding else 2.0)
        if level == "auto":
            none = found.agg(F.count("*").alias("hits")).where("hits = 0").select(F.lit(True).alias("none"))
            voxels = voxels.join(F.broadcast(none), F.lit(True)).drop("none")  # one row or none
        elif self.attached is not None:
            taken = self.attached.join(found.select("obj_id"), "obj_id", "left_semi").select(*V.KEY)
            voxels = voxels.join(taken, list(V.KEY), "left_anti")
        voxels = voxels.orderBy(F.desc("score"), *V.KEY).limit(k)
        order = Window.orderBy(F.desc("score"), *V.KEY)  # k rows at most
        voxels = voxels.select(F.lit("voxel").alias("level"), F.lit(None).cast("long").alias("obj_id"), *V.KEY, "label", "score", F.row_number().over(order).alias("rank"))
        return voxels if level == "voxel" else found.unionByName(voxels)

    def _labelled_voxels(self) -> DataFrame:
        if "label" not in self.voxels.columns:
            raise ValueError("these voxels have no labels: join voxels.top_labels to them")
        return self.voxels

    def _scored(self, rows: DataFrame, text: str, embedding: L.TextMatcher | None) -> DataFrame:
        spark = rows.sparkSession
        lex = L.lexical(spark.createDataFrame([(text,)], "query string"), rows.select("label").distinct())
        score = embedding.score(F.col("e"), text) if embedding else F.lit(0.0)
        return rows.join(lex, "label").withColumn("embedding", score)

    def relations(self, max_distance: float = S.MAX_DISTANCE) -> DataFrame:
        return S.relations(self.objects, max_distance)

    def vocabulary(self) -> list[str]:
        """The class names of the map. Questions are parsed on the driver against all of them: they are a detector's vocabulary."""
        return sorted(r[0] for r in self.objects.select("label").distinct().collect())

    def answer(self, question: str, k: int = 5) -> tuple[L.Intent, DataFrame]:
        """What a question asks for, and the rows that answer it; no rows if its subject is not in the map."""
        i = L.parse_question(question, self.vocabulary())
        robot = tuple(self.meta.get("robot_position", (0.0, 0.0, 0.0)))
        own = self.objects.where(F.lower("label") == (i.subject or "").lower())
        if i.kind in ("distance", "relation") and i.other:
            found = L.answer_distance(self.objects, i.subject, i.other)
            near = F.lit(i.relation in ("near", "overlapping")) & F.col("relation").isin("near", "overlapping")
            return i, found if i.kind == "distance" else found.withColumn("holds", F.lit(i.relation is None) | (F.col("relation") == F.lit(i.relation or "")) | near)
        if i.kind == "list_on" and i.subject:
            return i, L.answer_on(self.objects, i.subject)
        if i.kind == "count":
            return i, own.agg(F.count("*").alias("n"))
        if i.kind == "nearest":
            return i, S.near(own if i.subject else self.objects, robot, k=k)
        if i.kind in ("locate", "relation", "distance"):
            return i, S.near(L.best_of(self.objects, i.subject or ""), robot, k=1)
        return i, self.labels()

    def reply(self, question: str, k: int = 5) -> R.Reply:
        """An answer in words, with the rows that it rests on. A subject that the map does not have is named as such, and no
        question raises."""
        vocabulary = self.vocabulary()
        try:
            intent, rows = self.answer(question, k)
            missing = R.missing_subject(question, intent, vocabulary)
            found = [] if missing else [r.asDict() for r in rows.limit(max(k, 10)).collect()]
            return R.reply(question, intent, found, missing, vocabulary)
        except Exception as e:  # one question must not end a session
            return R.Reply(question, "error", "I could not make sense of that question.", [], 0.0, {"error": str(e)[:200]})


def _served(objects: DataFrame, truth: DataFrame, reach: float) -> DataFrame:
    """map_localization() where ids are in several rows, or null: by pairs, whose number grows with the square of what is in reach."""
    p = within_distance(objects, truth, ("cx", "cy", "cz"), reach).where("a.label = b.label")
    flat = p.select(F.col("a.label").alias("label"), F.col("a.obj_id").alias("obj_id"), F.col("b.obj_id").alias("gt_id"), G.center_distance().alias("distance"))
    return served_in_turn(flat, "obj_id", "gt_id", ["distance", "gt_id"])


def map_localization(objects: DataFrame, truth: DataFrame, reach: float = 2.0) -> DataFrame:
    """Objects in order, each with the nearest truth of its label that is free: (label, obj_id, gt_id, distance).

    A label is one task, which holds its centres and short lists of choices, but no pairs.
    """
    names = ["label", "obj_id", "cx", "cy", "cz"]
    o, t = objects.select(*names), truth.select(*names)
    named = o.select("obj_id", F.lit(0).alias("s")).unionByName(t.select("obj_id", F.lit(1).alias("s")))
    if not named.groupBy("s", "obj_id").count().where("count > 1 or obj_id is null").isEmpty():
        return _served(o, t, reach)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("obj_id"), b.sort_by("obj_id")
        x, y = (np.column_stack([v[k].to_numpy() for k in names[2:]]) for v in (a, b))
        got, distance = nearest_in_turn(x, y, reach)
        i = np.flatnonzero(got >= 0)
        return pa.table({"label": a["label"].take(pa.array(i)), "obj_id": a["obj_id"].take(pa.array(i)), "gt_id": b["obj_id"].take(pa.array(got[i])), "distance": distance[i]})

    fit = lambda df: df.where(finite("cx", "cy", "cz") & F.col("label").isNotNull()).select(F.col("label").alias("label"), F.col("obj_id").alias("obj_id"), *[F.col(k).cast("double").alias(k) for k in names[2:]])
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"label {kind(o, 'label')}, obj_id {kind(o, 'obj_id')}, gt_id {kind(t, 'obj_id')}, distance double"
    return fit(o).groupBy("label").cogroup(fit(t).groupBy("label")).applyInArrow(run, schema)


def built(observations: DataFrame, points: DataFrame, size: float = V.SIZE, **options: Any) -> SceneMap:
    """A map of instances: see mapping.build. Its meta says what was dropped, and the number of objects and observations."""
    b = M.build(observations, points, size, **options)
    drops = {r["reason"] or "kept": r["n"] for r in b.drops.collect()}  # three reasons at most
    counts = b.attached.groupBy("obj_id").agg(F.count("*").alias("num_voxels"))
    objects = b.objects.join(counts, "obj_id", "left").fillna(0, ["num_voxels"])
    return SceneMap(objects, b.voxels, {"voxel_size": size, "drops": drops}, b.attached)
