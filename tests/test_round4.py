"""What the fourth round found: each test fails on the code before its finding's commit."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lattica.llm import minhash as H
from lattica.operators import mapping
from lattica.operators import spatial as S
from lattica.operators import voxels as V
from lattica.plans import tiles


def _join_rows(spark, keys, run):
    """Rows that inner joins on these keys make while run() runs."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    known, total = store.executionsCount(), 0
    run()
    bus.waitUntilEmpty()
    found = store.executionsList()
    for i in range(known, found.size()):
        n = found.apply(i).executionId()
        nodes, values = store.planGraph(n).allNodes(), store.executionMetrics(n)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if re.search("Join", node.name()) and re.sub(r"#\d+L?", "", node.desc()).split(" ", 1)[-1].startswith(keys):
                for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_members_of_large_buckets_are_joined_once(spark, monkeypatch):
    """op2_order_minhash, pipeline: a member of a large bucket met the row of its bucket anew for each use of it."""
    monkeypatch.setattr(H, "SMALL", 4)
    r = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = [(d, " ".join(passage + [f"w{r.randrange(10**6)}" for _ in range(60)])) for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members = H.sketch_rows(docs).selectExpr("posexplode(sketch) as (band, key)").groupBy("band", "key").count().where("count > 1").agg({"count": "sum"}).first()[0]
    rows = _join_rows(spark, "[band, key], [band, key], Inner", lambda: H.near_duplicate_classes(docs).collect())
    assert members > 1000 and members < rows <= 4 * members


def test_rows_meet_few_slabs(spark):
    """what a table of any size sends to tiles was its rows times its slabs, which grew with it."""
    n = 3000
    rows = spark.createDataFrame([(i, i * 7919 % n / n) for i in range(n)], "id long, cx double").cache()
    sent = lambda a, b, same: pa.table({"n": [len(a) + len(b)], "pairs": [len(a) * len(b)]})
    got = tiles.met(rows, "cx", "cx", 2.0, sent, "n long, pairs long", 40).agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).first()
    assert got.pairs == n * n and got.n <= 2 * n * 2 * tiles.SLABS


def test_members_are_found_once(spark):
    """F13 cluster_objects: the tiles of border points ran for the votes and again for the boxes."""
    r = np.random.default_rng(5)
    p = spark.createDataFrame([(i, *map(float, r.normal(size=3)), 1, "c") for i in range(60)], "id long, x double, y double, z double, n long, label string")
    out = mapping.cluster_objects(p, V.dbscan(p.select("id", "x", "y", "z"), 0.8, 4))
    assert "FlatMap" not in out._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0] and out.count() >= 1


def test_relations_leave_a_tile_in_batches(spark, monkeypatch):
    """F14 spatial_relations: a tile held all its pairs at once."""
    held = {}
    monkeypatch.setattr(tiles, "met", lambda rows, low, high, reach, run, *more: held.update(run=run, rows=rows) or rows)
    r = np.random.default_rng(6)
    rows = [(i, "c", *map(float, c), *map(float, c - 0.1), *map(float, c + 0.1)) for i, c in enumerate(r.normal(size=(400, 3)))]
    S.related_pairs(spark.createDataFrame(rows, "obj_id long, label string, " + ", ".join(f"{c} double" for c in tiles.NUMBERS)), 9.0)
    t = held["rows"].toArrow()
    monkeypatch.setattr(tiles, "HELD", 1000)
    out = held["run"](t, t, True)
    assert not isinstance(out, pa.Table)
    sizes = [len(x) for x in out]
    assert sum(sizes) > 100_000 and max(sizes) <= 1000 + tiles.ASKING * len(t)
