"""Cases that the second review found."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lattica.functions import geometry as G
from lattica.functions import kernels as K
from lattica.functions import vector as X
from lattica.operators import corpus as C
from lattica.operators import language as L
from lattica.operators import policy
from lattica.operators import reward as R
from lattica.operators import spatial as S
from lattica.plans import tiles
from lattica.queries import evaluation as EQ
from lattica.queries import language as LQ


def test_words_end_at_ascii(spark):
    """Letters beyond ASCII end a word in SQL's expressions, as F9 found."""
    d = spark.createDataFrame([("Noñasción",), ("éyes",), ("know",), ("no_",), ("aren't",), ("İSN'T",)], "t string")
    assert [r[0] for r in d.select(R.yes_no(F.col("t"))).collect()] == [False, True, None, None, False, False]


def test_scores_of_odd_vectors(spark):
    """Blocks of arrays score as columns do, vectors that are null, hold nulls or are of another size as well (F1)."""
    o = [(1, [1.0, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [1.0, 2.0, 3.0]), (None, [0.3, 0.4]), (7, [float("nan"), 1.0])]
    rows = spark.createDataFrame(o, "obj_id long, e array<double>")
    asked = rows.where("obj_id in (1, 4, 7)").select(F.col("obj_id").alias("q_id"), F.col("e").alias("qe"))
    nulls = spark.createDataFrame([([0.2, 1.0], [1.0, 0.1])], "n0 array<double>, n1 array<double>")
    got = L.scored(rows, asked, nulls, 0.05)
    assert got.columns == ["q_id", "obj_id", "cosine", "score", "logistic"]
    c = X.cosine(F.col("e"), F.col("qe"))
    score = L.embedding_score(F.col("e"), F.col("qe"), [F.col("n0"), F.col("n1")], 0.05)
    want = rows.crossJoin(asked).crossJoin(nulls).select("q_id", "obj_id", F.round(c, 6), F.round(score, 6), F.round(X.logistic(c, 10.0, -5.0), 6))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_rounded(spark):
    x = [0.0000005, 0.0000015, -0.0000005, 1.0000005, 2.5e-7, 123456.1234565, -0.0, float("inf"), -1e-9, 0.1234565]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", 6)).collect()]
    assert K.rounded(np.array(x)).tolist() == want


def test_only_asked_objects_are_scored(spark, sf_dir):
    """a search scores the three objects that it asks for, not every fiftieth."""
    plan = LQ._scored(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    assert {r[0] for r in LQ._scored(spark, sf_dir).select("q_id").distinct().collect()} == {50, 100, 150}


def test_recall_scores_only_asked_objects(spark, sf_dir):
    """the ranking behind the recall meets three queries; every fiftieth object was scored before."""
    plan = EQ.query_recall(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def _boxes(spark, n=300, seed=3):
    r = random.Random(seed)
    rows = [(i, f"c{r.randrange(4)}", *(c := [r.gauss(0, 0.7) for _ in range(3)]), *[x - 0.3 * r.random() for x in c], *[x + 0.3 * r.random() for x in c]) for i in range(n)]
    return spark.createDataFrame(rows, "obj_id long, label string, cx double, cy double, cz double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")


def test_first_relations_pair_few(spark):
    """F6, F8: the first by their ids come from the least subjects; all others were paired before."""
    o = _boxes(spark)
    few = S.first_relations(o, 5, 0.5, same_label=False, where="relation <> 'unknown'")
    assert 0 < few.select("subject_id").distinct().count() <= 64
    want = S.relations(o, 0.5, same_label=False).where("relation <> 'unknown'").orderBy("subject_id", "object_id").limit(5).collect()
    assert few.orderBy("subject_id", "object_id").limit(5).collect() == want
    apart = o.withColumn("cx", F.col("obj_id") * 10.0).withColumn("cx", F.when(F.col("obj_id") == 299, 2980.0).otherwise(F.col("cx")))
    assert [tuple(x)[:1] for x in S.first_relations(apart, 5, 3.0).select("subject_id").orderBy("subject_id").collect()] == [(298,), (299,)]


def test_policy_samples_pair_few(spark):
    """F8: each task's first samples are those of all pairs."""
    o = _boxes(spark)
    got = policy.samples(o, 7, 0.5).where("task = 'relation'").orderBy("subject_id", "object_id").select("subject_id", "object_id", "truth").collect()
    want = S.relations(o, 0.5, same_label=False).where("relation <> 'unknown'").orderBy("subject_id", "object_id").limit(7).select("subject_id", "object_id", (F.col("subject_id") % 2 == 1).alias("truth")).collect()
    assert got == want and len(got) == 7


def test_tiles_are_as_columns(spark, monkeypatch):
    """slabs that meet in tiles give what columns give, with odd objects, copies and many slabs."""
    monkeypatch.setattr(tiles, "SLAB", 40)
    monkeypatch.setattr(tiles, "ROWS", 40)
    o = _boxes(spark).withColumn("x1", F.when(F.col("obj_id") == 5, F.lit(None)).otherwise(F.col("x1"))).withColumn("z0", F.when(F.col("obj_id") == 6, F.lit(float("nan"))).otherwise(F.col("z0")))
    o = o.unionByName(o.where("obj_id < 150").withColumn("obj_id", F.col("obj_id") + 1000)).unionByName(o.where("obj_id = 9").withColumns({"obj_id": F.lit(None).cast("long"), "label": F.lit(None).cast("string")})).cache()
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    rel = S.relations(o, 0.6)
    names = ["subject_id", "subject", "relation", "object_id", "object"]
    assert key(S.related_pairs(o, 0.6).collect()) == key(rel.select(*names, *[F.round(c, 6) for c in ("distance", "gap", "containment")]).collect())
    want = S.find_relations(S.relations(o, 0.6, same_label=False), "Above").groupBy("subject", "object").agg(F.count("*"), F.min("distance")).collect()
    assert key(S.count_relations(o, "Above", 0.6).collect()) == key(want) and want
    x, y = o.where("obj_id not in (5, 6, 1005, 1006)").alias("a"), o.where("obj_id not in (5, 6, 1005, 1006)").alias("b")
    pairs = x.join(y, F.col("a.obj_id") < F.col("b.obj_id")).select(F.col("a.obj_id").alias("a"), F.col("b.obj_id").alias("b"), G.iou().alias("iou")).where("iou >= 0.1").collect()
    assert key(S.overlaps(o, 0.1).collect()) == key(pairs) and pairs


def test_overlaps_meet_once(spark, monkeypatch):
    """two slabs meet once, whatever the sizes of their boxes, and no pair comes twice."""
    monkeypatch.setattr(tiles, "SLAB", 25)
    o = _boxes(spark, 120).withColumn("x1", F.when(F.col("obj_id") == 3, 9.0).otherwise(F.col("x1")))
    got = [(r.a, r.b) for r in S.overlaps(o, 1e-6).collect()]
    assert len(got) == len(set(got)) > 0 and all(a < b for a, b in got) and any(3 in p for p in got)
    assert S.overlaps(o.limit(0), 0.1).count() == 0


def test_bands_keep_no_word_sets(spark, monkeypatch):
    """a caption's word set was kept once for each of its 32 bands."""
    kept = []
    monkeypatch.setattr(C, "kept_apart", lambda df: lambda d: kept.append(d.columns) or d.cache())
    words = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(0, words), (1, words + " x"), (2, "a b c d e f")], "ord long, cleaned string")
    assert sorted(r.ord for r in C.near_duplicates(d).collect()) == [0, 2]
    assert any("band" in c for c in kept) and not any({"band", "ws"} <= set(c) for c in kept)
