"""Cases of stereo depth, nodes, matchings, sources, the command line and small helpers."""

from __future__ import annotations

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import geometry as G
from lattica.operators import language as L
from lattica.operators import sequences as S
from lattica.operators import stereo, video, voxels
from lattica.plans import rewrites
from lattica.sources import files, scenes, synthetic
from lattica.streaming import node


def test_greedy_pairs_and_turns(spark):
    r = random.Random(4)
    rows = list({(r.randrange(40), r.randrange(40)): round(r.random(), 2) for _ in range(400)}.items())
    pairs = spark.createDataFrame([(a, b, d) for (a, b), d in rows], "a long, b long, d double")
    used, want = set(), []
    for d, a, b in sorted((d, a, b) for (a, b), d in rows):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            want.append((a, b))
    assert sorted((x.a, x.b) for x in rewrites.greedy_pairs(pairs, "a", "b", ["d", "a", "b"]).collect()) == sorted(want)
    free, turns = set(range(40)), []
    for a in range(40):
        near = sorted((d, b) for (x, b), d in rows if x == a and b in free)
        if near:
            free.remove(near[0][1])
            turns.append((a, near[0][1]))
    assert sorted((x.a, x.b) for x in rewrites.served_in_turn(pairs, "a", "b", ["d", "b"]).collect()) == turns
    assert rewrites.greedy_pairs(pairs.limit(0), "a", "b", ["d", "a", "b"]).count() == 0


def test_plane_sweep_finds_a_plane(spark):
    """A textured plane two metres away, seen by three cameras side by side."""
    w, h, k = 48, 32, (40.0, 40.0, 23.5, 15.5)
    texture = np.random.default_rng(2).uniform(0, 255, (400, 400))

    def seen(x0: float) -> np.ndarray:
        u, v = np.meshgrid(np.arange(w, dtype=float), np.arange(h, dtype=float))
        x, y = (u - k[2]) / k[0] * 2.0 + x0, (v - k[3]) / k[1] * 2.0
        return stereo.sampled_at(texture, 200 + x * 20, 200 + y * 20)

    rows = []
    for i, x0 in enumerate((0.0, 0.2, -0.2)):
        pose = np.eye(4)
        pose[0, 3] = -x0
        rows.append((1, i, w, h, seen(x0).ravel().tolist(), *k, pose.ravel().tolist()))
    frames = spark.createDataFrame(rows, "scene long, frame long, width int, height int, gray array<double>, fx double, fy double, cx double, cy double, pose array<double>")
    d = stereo.plane_sweep(frames, 0.5, 8.0, 48).where("frame = 0").toPandas()
    inner = d[(d.u > 8) & (d.u < 40) & (d.m > 0)]
    assert len(d) == w * h and len(inner) > 300 and abs(inner.m.median() - 2.0) < 0.1 and (abs(inner.m - 2.0) < 0.3).mean() > 0.9
    assert stereo.depth_coverage(stereo.plane_sweep(frames.limit(1))).first().coverage == 0.0
    assert np.allclose(stereo.box_mean(np.ones((4, 6))), 1.0)


def test_mapping_node(spark, tmp_path):
    from tests.test_operators import _chairs

    seen, points = _chairs(spark)
    n = node.MappingNode(spark, str(tmp_path), every=2, options={"size": 0.2, "least_score": 0.3})
    assert n.map.last() is None
    for b in range(4):
        n.process(seen.where(F.col("frame") == b), points, b)
    assert n.frames == 4 and n.published == 2 and n.latency.summary()["count"] == 2
    assert sorted(r.label for r in n.map.last().collect()) == ["chair", "chair", "table"]
    n.process(seen.where("frame = 3"), points, 3)  # delivered again
    n.publish()
    assert max(r.n_observations for r in n.map.last().collect()) == 4 and node.POLICIES["state"]["latched"]
    late = node.MappingNode(spark, str(tmp_path / "late"), every=100, shed=1, options={"size": 0.2})
    late.process(seen, points, 0)
    assert late.frames == 1


def test_fields_grow_to_a_bound(spark):
    p = spark.createDataFrame([(i, 0.1 * i, 0.0, 0.0, 1.0, [1.0 * i, 0.0, 0.0, 0.0], f"l{i % 3}") for i in range(6)], "pt long, x double, y double, z double, w double, e array<double>, label string")
    field = voxels.added(None, voxels.fuse(p.where("pt < 3"), 0.1))
    assert field.count() == 3 and voxels.added(field, voxels.fuse(p, 0.1)).agg(F.sum("n")).first()[0] == 9
    full = voxels.added(field, voxels.fuse(p, 0.1), most=4)
    assert full.count() == 4 and full.agg(F.sum("n")).first()[0] == 7
    assert voxels.first_labels(p, 1.0).first().label == "l0"
    o = spark.createDataFrame([(1, "a", 0.5, [1.0])], "obs long, label string, score double, e array<double>")
    q = spark.createDataFrame([(1, 0.0)], "obs long, x double")
    assert voxels.observed(o, q).first().w == 1.0 and voxels.observed(o, q, "confidence_weighted").first().w == 0.5


def test_sources(spark, tmp_path):
    doc = {"videos": [{"video_id": "v1", "category": 3, "start time": 1.0, "end time": 4.0}, {"video_id": "v2"}], "sentences": [{"video_id": "v1", "caption": "a dog", "sen_id": 7}]}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("notes.txt", "x")
        z.writestr("b.json", json.dumps(doc))
    got = {r.video_id: r for r in files.build_source("clips_zip")(spark, str(tmp_path / "a.zip")).collect()}
    assert got["v1"].duration == 3.0 and got["v1"].text == "a dog" and got["v2"].text is None
    with pytest.raises(ValueError):
        files.with_columns(spark.range(1), ["id", "boxes"])
    spark.range(1).write.parquet(str(tmp_path / "index"))
    with pytest.raises(ValueError):
        scenes.load_index(spark, str(tmp_path / "index"))
    raw = spark.createDataFrame([(0,), (65535,), (512,)], "raw int").select(scenes.captured_depth(F.col("raw")).alias("m")).collect()
    assert [r.m for r in raw] == [0.0, 0.0, 1.0]
    px = G.pixel_grid(spark, 4, 2).withColumn("frame", F.lit(1)).withColumn("c", F.col("u") + 10 * F.col("v"))
    small = {(r.u, r.v): r.c for r in scenes.resized(px, 4, 2, 2, 1).collect()}
    assert small == {(0, 0): 11, (1, 0): 13} and scenes.resized(px, 4, 2, 8, 4).count() == 32
    rows = spark.createDataFrame([(1, "a", 0.9, ""), (2, "a", 0.4, ""), (3, "b", 0.1, "low_score")], "frame_id long, label string, score double, reason string")
    assert [json.loads(r.line)["why"] for r in scenes.review(rows).collect()] == ["low_score", "unsure"]
    v = synthetic.video_pixels(spark, 1, 3, 6)
    cuts = video.histogram_steps(video.histograms(v))
    assert sorted(r.idx for r in cuts.orderBy(F.desc("diff")).limit(2).collect()) == [5, 11] and S.frames_at(cuts.withColumnRenamed("video", "user_id"), spark.createDataFrame([(0, 5), (0, 99)], "user_id long, idx long")).count() == 1


def test_poses(spark):
    rows = [[1.0, 0.0, 0.0, 5.0], [0.0, 1.0, 0.0, 6.0], [0.0, 0.0, 1.0, 7.0]]
    turned = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [5.0, 6.0, 7.0]]
    got = [r.p for r in spark.createDataFrame([(rows,), (turned,), ([[1.0]],)], "m array<array<double>>").select(G.pose_from_json(F.col("m")).alias("p")).collect()]
    assert got[0] == got[1] and got[0].t == [5.0, 6.0, 7.0] and got[0].r == list(G.IDENTITY) and got[2] is None
    one = spark.range(1)
    m = [F.lit(float(x)) for x in (0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3)]
    r, t = G.pose_of_matrix(m)
    back = one.select(*[x.alias(f"m{i}") for i, x in enumerate(G.matrix_of_pose(*G.pose_of_camera_to_world(*G.pose_of_camera_to_world(r, t))))]).first()
    assert list(back) == [0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1]
    with pytest.raises(ValueError):
        G.pose_of_matrix(m[:9])
    tilt, _ = G.pose_of_tilt([F.lit(x) for x in G.IDENTITY])
    assert list(one.select(*[x.alias(f"r{i}") for i, x in enumerate(tilt)]).first()) == list(G.SCANNER)
    hit = lambda yaw, d: one.select(G.turned_box_hit([F.lit(0.0)] * 3, [F.lit(x) for x in d], [F.lit(x) for x in (5.0, 0.0, 0.0)], [F.lit(x) for x in (2.0, 4.0, 2.0)], F.lit(yaw)).alias("h")).first().h
    assert hit(0.0, (1.0, 0.0, 0.0)) == pytest.approx(4.0) and hit(np.pi / 2, (1.0, 0.0, 0.0)) == pytest.approx(3.0) and hit(0.0, (0.0, 1.0, 0.0)) is None


def test_overlaps_of_turned_boxes():
    from lattica.operators.metrics import yaw_ious

    r = np.random.default_rng(9)
    a = np.column_stack([r.uniform(-1, 1, (400, 3)), r.uniform(0.2, 2, (400, 3)), r.uniform(-4, 4, 400)])
    b = np.column_stack([r.uniform(-1, 1, (400, 3)), r.uniform(0.2, 2, (400, 3)), r.uniform(-4, 4, 400)])
    b[:20] = a[:20]
    b[20:40, :6], b[20:40, 6] = a[20:40, :6], a[20:40, 6] + np.pi
    b[40:60, 3:] = a[40:60, 3:]
    got = yaw_ious(a, b)
    assert np.allclose(got, [G.yaw_box_iou(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)], atol=1e-9) and np.allclose(got[:40], 1.0)
    assert len(yaw_ious(a[:0], b[:0])) == 0


def test_lexical_in_blocks(spark, monkeypatch):
    q = spark.createDataFrame([("mug",), ("couch",)], "query string")
    labels = spark.createDataFrame([(x,) for x in ("cup", "sofa", "lamp")], "label string")
    want = sorted(L.lexical(q, labels).collect())
    monkeypatch.setattr(L, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, L.lexical(q, labels).collect())) == sorted(map(tuple, want)) and len(want) == 6


def test_scores_and_answers(spark):
    s = spark.createDataFrame([("q", "a", 1.0, 10), ("q", "b", 1.0, 5), ("q", "c", 0.5, 0)], "query string, label string, lexical double, count int")
    assert [round(r.lexical, 3) for r in L.counted(s).orderBy("label").collect()] == [1.0, 0.95, 0.45]
    d = spark.createDataFrame([("cup",), ("zebra",)], "label string")
    assert [r.label for r in L.prompted(d, spark.createDataFrame([("mug",), ("lamp",)], "query string")).collect()] == ["cup"]
    with pytest.raises(ValueError):
        L.ENCODERS["color_hist"].checked(spark.createDataFrame([([1.0],)], "e array<double>"))
    rule, model = {"answer": "2 m", "distances": {"a-b": 2.0}, "confidence": 0.9, "targets": ["a"]}, {"answer": "three", "targets": ["ghost"], "distances": {"a-b": 3.0}}
    assert L.hybrid_answer(rule, model, {"a"})["by"] == "rule" and L.hybrid_answer(rule, model, {"a"})["invented"] == ["ghost"]
    both = L.hybrid_answer(rule, {**model, "targets": ["A", "ghost"]}, {"a"})
    assert both["by"] == "model" and both["targets"] == ["A"] and both["distances"] == {"a-b": 2.0}


def test_command_line(spark, tmp_path, capsys):
    from lattica.__main__ import main
    from tests.test_operators import _chairs

    seen, points = _chairs(spark)
    seen.write.parquet(str(tmp_path / "seen"))
    points.write.parquet(str(tmp_path / "points"))
    assert main(["check"]) == 0 and main(["backends"]) == 0 and main(["run", "nothing", "--data", "x"]) == 2
    assert main(["map", str(tmp_path / "seen"), str(tmp_path / "points"), str(tmp_path / "map"), "--voxel-size", "0.2"]) == 0
    assert main(["query", str(tmp_path / "map"), "seat"]) == 0 and main(["demo"]) == 0
    assert main(["bench", "answer_count", "--data", "/root/testdata/sf0.001"]) == 0
    out = capsys.readouterr().out
    assert "pyspark: there" in out and "segmenter: box" in out and "chair" in out and "answer_count" in out
    spark.createDataFrame([(1, "a", 0.9, 0.0, 0.0, 2.0, 2.0, "")], "frame_id long, label string, score double, x1 double, y1 double, x2 double, y2 double, reason string").write.parquet(str(tmp_path / "labels"))
    assert main(["label", str(tmp_path / "labels"), str(tmp_path / "out")]) == 0 and spark.read.text(str(tmp_path / "out/annotations")).count() == 1
