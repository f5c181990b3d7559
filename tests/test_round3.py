"""What the third round found: each test fails on the code before its finding's commit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import kernels as K
from lattica.functions import vector as X
from lattica.llm import minhash as H
from lattica.operators import language as L
from lattica.operators import policy, scene
from lattica.operators import spatial as S
from lattica.operators import voxels as V
from lattica.plans import tiles
from lattica.queries import language as LQ


def _rows(spark, n, seed, ids=None, labels=3, spread=1.0):
    r = random.Random(seed)
    rows = [(ids(i) if ids else i, f"c{r.randrange(labels)}", *[r.gauss(0, spread) for _ in range(3)]) for i in range(n)]
    return spark.createDataFrame(rows, "obj_id long, label string, cx double, cy double, cz double")


@pytest.mark.parametrize("n,m,reach,grid", [(400, 400, 0.9, 0), (300, 90, 5.0, 0), (90, 300, 0.3, 0), (300, 300, 2.0, 3), (5, 0, 1.0, 0), (0, 5, 1.0, 0), (50, 50, 0.0, 2)])
def test_nearest_in_turn(n, m, reach, grid):
    """short lists and refusals give what turns give, with ties, crowds and lists that run out."""
    r = np.random.default_rng(n + m)
    a, b = (r.integers(0, grid, (k, 3)).astype(float) if grid else r.normal(size=(k, 3)) for k in (n, m))
    free, want = set(range(m)), []
    for x in a:
        near = [(float(np.sqrt((x[0] - b[j][0]) ** 2 + (x[1] - b[j][1]) ** 2 + (x[2] - b[j][2]) ** 2)), j) for j in sorted(free)]
        d, j = min([p for p in near if p[0] <= reach], default=(None, -1))
        free.discard(j)
        want.append(j)
    got, distance = K.nearest_in_turn(a, b, reach)
    assert got.tolist() == want and (distance[got >= 0] <= reach).all()


def test_localization_builds_no_pairs(spark, monkeypatch):
    """all pairs of a label in reach were kept in each round; ids in several rows still go by pairs."""
    o, t = _rows(spark, 200, 1), _rows(spark, 200, 2)
    t = t.unionByName(t.limit(1).withColumns({"obj_id": F.lit(900).cast("long"), "cx": F.lit(float("nan"))}))
    key = lambda df: sorted((r.label, r.obj_id, r.gt_id, round(r.distance, 9)) for r in df.collect())
    want = key(scene._served(o, t, 0.8))
    twice = o.unionByName(o.limit(3).withColumn("cx", F.col("cx") + 0.1))
    assert key(scene.map_localization(twice, t, 0.8)) == key(scene._served(twice, t, 0.8))
    monkeypatch.setattr(scene, "within_distance", None)
    assert key(scene.map_localization(o, t, 0.8)) == want and len(want) > 50


def test_cosines_are_as_columns(spark):
    """cosines by arrays are those of columns to the last bit, for odd vectors too."""
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(9)], [r.gauss(0, 1) for _ in range(9)]) for i in range(50)]
    odd = [(50, None, [1.0]), (51, [1.0, None], [1.0, 2.0]), (52, [1.0], [1.0, 2.0]), (53, [], []), (54, [0.0, 0.0], [0.0, 1.0]), (55, [float("nan"), 1.0], [1.0, 1.0]), (56, [float("inf")], [1.0]), (57, [1e-9], [2e-9])]
    for d in (spark.createDataFrame(x, "id long, a array<double>, b array<double>") for x in (rows, rows + odd)):
        want = d.select("id", X.cosine(F.col("a"), F.col("b")).alias("c")).collect()
        got = L.with_cosines(d, {"c": ("a", "b")})
        assert got.columns == ["id", "c"] and sorted(map(str, got.collect())) == sorted(map(str, want))


def test_recall_scores_by_arrays(spark, sf_dir):
    """a score was an expression over arrays, which each condition on it computed again."""
    plan = LQ._scored(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


def test_samples_find_relations_once(spark, monkeypatch):
    """F8: the relations were found anew for each task, and once more to count them."""
    o = _rows(spark, 150, 8, spread=0.5).withColumns({f"{k}{i}": F.col(f"c{k}") + (2 * i - 1) * 0.1 for k in "xyz" for i in (0, 1)})
    rel = S.first_relations(o, 7, 0.5)
    assert rel.count() == 7 and "Join" not in rel._jdf.queryExecution().withCachedData().toString()
    plan = policy.samples(o, 7, 0.5)._jdf.queryExecution().withCachedData().toString()
    assert "Join" not in plan
    got = policy.samples(o, 7, 0.5).where("task = 'locate'").orderBy("subject_id").select("subject_id").collect()
    assert [r[0] for r in got] == list(range(7))


def test_copies_of_a_bucket_meet_only_others(spark, monkeypatch):
    """op2: each member of a large bucket went to all its blocks, though most were in one component."""
    monkeypatch.setattr(H, "BLOCK", 16)
    rows, links = spark.sparkContext.accumulator(0), H._tile_links

    def counted(t):
        rows.add(len(t))
        return links(t)

    monkeypatch.setattr(H, "_tile_links", counted)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"x{i}y{j}" for j in range(5 if i < 60 else 60)) for i in range(66)]
    got = H.near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(i, 0 if i < 60 else i) for i in range(66)]
    assert 0 < rows.value <= 6 * H.SKETCHES


def test_clusters_build_no_pairs(spark, monkeypatch):
    """all pairs in reach were built; slabs that meet in tiles give the same clusters, with odd points and copies."""
    p = _rows(spark, 300, 4).select(F.col("obj_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    p = p.unionByName(p.where("id < 4")).unionByName(spark.createDataFrame([(None, 0.0, 0.0, 0.0), (900, float("nan"), 0.0, 0.0), (901, None, 0.0, 0.0)], "id long, x double, y double, z double"))
    rows = p.collect()
    ok = [r for r in rows if r.x is not None and r.x == r.x]
    near = lambda a, b: ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) ** 0.5 <= 0.45
    reach, by = {}, {}
    for a in ok:
        if a.id is not None:
            own = [b for b in ok if near(a, b)]
            reach[a.id] = reach.get(a.id, 0) + len(own)
            by.setdefault(a.id, set()).update(b.id for b in own)
    core = {i for i, n in reach.items() if n >= 5}
    label = {i: i for i in core}
    for _ in range(len(core)):
        new = {i: min(label[j] for j in by[i] & core) for i in core}
        if new == label:
            break
        label = new
    want = sorted((str(r.id), label.get(r.id, min((label[j] for j in by.get(r.id, set()) & core), default=-1))) for r in rows)
    monkeypatch.setattr(tiles, "SLAB", 40)
    monkeypatch.setattr(V, "within_distance", None)
    got = sorted((str(r.id), r.cluster) for r in V.dbscan(p, 0.45, 5).collect())
    assert got == want and len({c for _, c in got}) > 3


def test_tiles_look_at_few(monkeypatch):
    """rows looked for pairs along one axis only, in a layer of all others."""
    r = np.random.default_rng(2)
    c = r.random((1000, 3)) * [0.1, 10, 10]
    t = {f"c{k}": c[:, i] for i, k in enumerate("xyz")} | {f"{k}{e}": c[:, i] + (2 * e - 1) * 0.2 for i, k in enumerate("xyz") for e in (0, 1)}
    seen, nonzero = [], np.nonzero
    for pairs, close in ((tiles.near(t, t, 0.4), lambda a, b: np.sqrt(((a - b) ** 2).sum()) <= 0.4), (tiles.meeting(t, t), lambda a, b: (np.abs(a - b) < 0.4).all())):
        seen.clear()
        with monkeypatch.context() as m:
            m.setattr(tiles.np, "nonzero", lambda x: seen.append(x.size if x.ndim == 2 else 0) or nonzero(x))
            got = sorted(p for i, j in pairs for p in zip(i.tolist(), j.tolist(), strict=True))
        assert 0 < sum(seen) < 80_000
        assert got == [(i, j) for i in range(1000) for j in np.flatnonzero(np.abs(c[:, 1] - c[i, 1]) < 0.41).tolist() if close(c[i], c[j])]
