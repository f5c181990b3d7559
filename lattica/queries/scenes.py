"""Queries over maps as a whole, rendered rooms and perception."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import geometry as G
from lattica.operators import language as L
from lattica.operators import mapping, panorama
from lattica.operators import perception as P
from lattica.operators import policy, scene
from lattica.queries import language as Q
from lattica.queries import spatial as S
from lattica.sources import scenes, synthetic, views

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]

_SAFE = "(case when abs({d}) < 1e-12 then 1e-12 else {d} end)"
_SLAB = lambda f, g: f + "(" + ", ".join(f"{g}({k}0/{_SAFE.format(d='d' + k)}, {k}1/{_SAFE.format(d='d' + k)})" for k in "xyz") + ")"


@query(f"""with {views.OBJECTS}, px as (select i % 64 as u, i // 64 as v, ((i % 64 + 0.5::double)/64-0.5)*2*pi() as az, (0.5-(i // 64 + 0.5::double)/32)*pi() as el from range(64*32) t(i)), rays as (select u, v, cos(el)*cos(az) as dx, cos(el)*sin(az) as dy, sin(el) as dz from px),
    h as (select u, v, obj_id, {_SLAB('greatest', 'least')} as near, {_SLAB('least', 'greatest')} as far from rays, objects) select u, v, arg_min(obj_id, row(near, obj_id)) as obj_id, round(min(near),6) as range from h where near <= far and near > 0 group by u, v""")
def rendered_room(spark, sf_dir):
    return synthetic.rendered(views.objects(spark, sf_dir), 64, 32).select("u", "v", "obj_id", *r6("range"))


_CORNER = "c as (select obj_id, label, cx+(x1-x0)*sx as x, cy+(y1-y0)*sy as y, cz+(z1-z0)*sz as z from objects, (values (-0.5),(0.5)) a(sx), (values (-0.5),(0.5)) b(sy), (values (-0.5),(0.5)) d(sz)), cam as (select obj_id, label, x as px, -z + 0.5 as py, y + 6.0 as pz from c)"


@query(f"""with {views.OBJECTS}, {_CORNER}, uv as (select obj_id, label, 120.0::double*px/pz+79.5 as u, 120.0::double*py/pz+59.5 as v from cam where pz > 1e-6), b as (select obj_id, label, min(u) as u0, max(u) as u1, min(v) as v0, max(v) as v1 from uv group by all having count(*) >= 2),
    q as (select obj_id, label, greatest(least(u0,159.0),0.0) as x1, greatest(least(v0,119.0),0.0) as y1, greatest(least(u1,159.0),0.0) as x2, greatest(least(v1,119.0),0.0) as y2 from b) select obj_id, label, round(x1,6) as x1, round(y1,6) as y1, round(x2,6) as x2, round(y2,6) as y2 from q where x2-x1 >= 2 and y2-y1 >= 2""")
def projected_boxes(spark, sf_dir):
    r, t = [F.lit(x) for x in S._ROT], [F.lit(x) for x in S._POS]
    return P.projected_boxes(views.objects(spark, sf_dir), r, t, **S._CAM, width=160, height=120).select("obj_id", "label", *r6("x1", "y1", "x2", "y2"))


@query(f"with {views.PIXELS}, m as (select vec_id, avg(r) as r, avg(g) as g, avg(b) as b from pixels group by vec_id) select vec_id as frame_id, 'object' as label, 20 as area, round(coalesce(r/nullif(sqrt(r*r+g*g+b*b),0),0),6) as red from m")
def perceived(spark, sf_dir):
    p = views.pixels(spark, sf_dir)
    image = p.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct((F.col("v") * 5 + F.col("u")).alias("at"), F.array("r", "g", "b").alias("c")))).alias("px"))
    box = F.struct(F.lit("object").alias("label"), F.lit(0.9).cast("double").alias("score"), F.lit(0.0).cast("double").alias("x1"), F.lit(0.0).cast("double").alias("y1"), F.lit(5.0).cast("double").alias("x2"), F.lit(4.0).cast("double").alias("y2"))
    frames = image.select(F.col("vec_id").alias("frame_id"), F.lit(5).alias("width"), F.lit(4).alias("height"), F.transform("px", lambda x: x["c"]).alias("pixels"), F.array(box).alias("boxes"))
    return P.pipeline(frames).select("frame_id", "label", "area", F.round(F.get("feature", F.lit(0)), 6).alias("red"))


def _seen(spark, sf_dir):
    """Observations of five scenes, fifty vectors to a frame, with the twenty points of each within its box."""
    o = views.objects(spark, sf_dir)
    at = lambda k, i: F.col(f"c{k}") + (F.get("e", F.col("i") * 3 + i) * 8 - F.col(f"c{k}")) * 0.05
    points = o.select(F.col("obj_id").alias("obs"), "e", "cx", "cy", "cz", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select("obs", *[at(k, i).alias(k) for i, k in enumerate(G.AXES)])
    seen = o.select((F.col("obj_id") % 5).alias("scene"), F.floor(F.col("obj_id") / 50).alias("frame"), F.col("obj_id").alias("obs"), "label", F.col("conf").alias("score"), "e")
    return seen, points


@query()
def built_map(spark, sf_dir):
    b = scene.built(*_seen(spark, sf_dir), 0.5, least_score=0.55)
    return b.objects.select("obj_id", "scene", "track", "label", "n_observations", "n_points", *r6("cx", "cy", "cz", "conf", "purity"))


@query(f"with {Q._NAMED}, {Q._LEXICAL}, s as (select obj_id, label, lexical * (0.92+0.08*conf) as score from named join lex using (label) where query = 'couch' and lexical >= 0.5) select obj_id, label, round(score,6) as score, rn as rank from (select *, row_number() over (order by score desc, obj_id) as rn from s) where rn <= 5")
def map_text_query(spark, sf_dir):
    r = scene.SceneMap(Q.named_objects(spark, sf_dir)).query_text("couch", 5)
    return r.select("obj_id", "label", *r6("score"), F.col("rank").cast("long").alias("rank"))


@query()
def map_localization(spark, sf_dir):
    o = views.objects(spark, sf_dir)
    return scene.map_localization(o.where("obj_id % 2 = 0"), o.where("obj_id % 2 = 1"), 0.8).select("label", "obj_id", "gt_id", *r6("distance"))


@query()
def frame_merges(spark, sf_dir):
    seen, points = _seen(spark, sf_dir)
    return mapping.merged_in_frame(mapping.boxed(seen, points), 0.05)


_RELATED = S._PAIRS.replace(views.OBJECTS, Q._NAMED).replace("from objects a join objects b", "from named a join named b").replace("distance <= 0.8", "distance <= 0.5 and subject <> object")


@query(f"""with {_RELATED}, rl as (select * from related where relation <> 'unknown'), every as (select 'relation' as task, subject_id, object_id, subject, object, case when subject_id % 2 = 1 then relation when relation = 'above' then 'below' else 'above' end as asked, subject_id % 2 = 1 as truth, distance from rl
    union all select 'distance', subject_id, object_id, subject, object, null, null, distance from rl union all select 'locate', obj_id, null, label, null, null, null, null from named)
    select task, subject_id, object_id, subject, object, asked, truth, round(distance,6) as distance from (select *, row_number() over (partition by task order by subject_id nulls first, object_id nulls first) as rn from every) where rn <= 20""")
def policy_samples(spark, sf_dir):
    return policy.samples(Q.named_objects(spark, sf_dir), 20, 0.5).select("task", "subject_id", "object_id", "subject", "object", "asked", "truth", *r6("distance"))


@query()
def synthetic_rooms(spark, sf_dir):
    return synthetic.rooms(spark, [7, 11]).select("scene", "obj_id", "label", *r6("cx", "cy", "cz"))


_FWD = "f as (select obj_id, cx/n as fx, cy/n as fy, cz/n as fz, sqrt(cx*cx+cy*cy)/n as m from (select *, sqrt(cx*cx+cy*cy+cz*cz) as n from objects) where n > 1e-9)"


@query(f"with {views.OBJECTS}, {_FWD} select obj_id, round(fy/m,6) as r0, round(-fx/m,6) as r1, round(fz*fx/m,6) as r3, round(fz*fy/m,6) as r4, round(-(fx*fx+fy*fy)/m,6) as r5, round(fx,6) as r6 from f")
def look_at_poses(spark, sf_dir):
    r, _ = G.look_at([F.lit(0.0)] * 3, [F.col(f"c{k}") for k in G.AXES])
    return views.objects(spark, sf_dir).select("obj_id", *[F.round(r[i], 6).alias(f"r{i}") for i in (0, 1, 3, 4, 5, 6)])


@query(f"with {views.OBJECTS}, q as (select obj_id, e[1] as x, e[2] as y, e[3] as z, e[4] as w, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]+e[4]*e[4]) * (case when e[4] < 0 then -1 else 1 end) as n from objects) select obj_id, round(x/n,6) as x, round(y/n,6) as y, round(z/n,6) as z, round(w/n,6) as w from q")
def rotation_quaternions(spark, sf_dir):
    q = G.matrix_quaternion(G.quaternion_matrix(*[F.get("e", F.lit(i)) for i in range(4)]))
    return views.objects(spark, sf_dir).select("obj_id", *[F.round(c, 6).alias(n) for c, n in zip(q, "xyzw", strict=True)])


@query(f"with {views.OBJECTS}, o as (select label || '-' || obj_id as label from objects), c as (select regexp_replace(lower(label), '[-_]?[0-9]+$', '') as c from o) select c as class, count(*) as n from c where c like '%class3%' or 'class3' like '%' || c || '%' group by c")
def class_counts(spark, sf_dir):
    o = views.objects(spark, sf_dir).withColumn("label", F.concat_ws("-", "label", F.col("obj_id").cast("string")))
    return scenes.of_classes(o, ["class3"]).groupBy(scenes.semantic_class(F.col("label")).alias("class")).agg(F.count("*").alias("n"))


_BOXES2D = "b as (select obj_id as frame_id, label, conf as score, 10+abs(cx) as x1, 20+abs(cy) as y1, 10+abs(cx)+x1-x0 as x2, 20+abs(cy)+y1-y0 as y2, case when obj_id % 3 = 0 then 'low_score' else '' end as reason from objects)"


def _labels2d(spark, sf_dir):
    o = views.objects(spark, sf_dir)
    x, y = 10 + F.abs("cx"), 20 + F.abs("cy")
    return o.select(F.col("obj_id").alias("frame_id"), "label", F.col("conf").alias("score"), x.alias("x1"), y.alias("y1"), (x + F.col("x1") - F.col("x0")).alias("x2"), (y + F.col("y1") - F.col("y0")).alias("y2"), F.when(F.col("obj_id") % 3 == 0, "low_score").otherwise("").alias("reason"))


@query(f"with {views.OBJECTS}, {_BOXES2D.replace('x1-x0', 'objects.x1-objects.x0').replace('y1-y0', 'objects.y1-objects.y0')} select label as name, dense_rank() over (order by label)::int as id from (select distinct label from b where reason = '')")
def label_categories(spark, sf_dir):
    return scenes.coco(_labels2d(spark, sf_dir))[0]


@query(f"with {views.OBJECTS}, {_BOXES2D.replace('x1-x0', 'objects.x1-objects.x0').replace('y1-y0', 'objects.y1-objects.y0')}, c as (select label, row_number() over (order by label) as id from (select distinct label from b where reason = '')) select frame_id as image_id, id::int as category_id, round(x1,6) as x, round(y1,6) as y, round(x2-x1,6) as w, round(y2-y1,6) as h, round((x2-x1)*(y2-y1),6) as area, round(score,6) as score from b join c using (label) where reason = ''")
def label_annotations(spark, sf_dir):
    """The lines of the file, read back."""
    a = scenes.coco(_labels2d(spark, sf_dir))[1].select(F.from_json("line", "image_id long, category_id int, bbox array<double>, area double, score double").alias("a"))
    return a.select("a.image_id", "a.category_id", *[F.round(F.get("a.bbox", F.lit(i)), 6).alias(n) for i, n in enumerate("xywh")], F.round("a.area", 6).alias("area"), F.round("a.score", 6).alias("score"))


@query(f"with {views.OBJECTS}, f as (select obj_id % 10 as capture, obj_id as frame, row_number() over (partition by obj_id % 10 order by obj_id) - 1 as i, count(*) over (partition by obj_id % 10) as n from objects), p as (select n, round_even(j*(n-1)/6.0::double, 0)::bigint as i from (select distinct n from f), range(7) t(j)) select capture, frame from f where n <= 7 or (n, i) in (select (n, i) from p)")
def picked_frames(spark, sf_dir):
    f = views.objects(spark, sf_dir).select((F.col("obj_id") % 10).alias("capture"), F.col("obj_id").alias("frame"))
    return scenes.picked_frames(f, "capture", 7)


@query(f"""with {views.OBJECTS}, {S._LATTICE}, o as (select * from objects where not (0.0 between x0 and x1 and -6.0 between y0 and y1 and 0.5 between z0 and z1)),
    p as (select obj_id, cx+(x1-x0)*sx as px, -(cz+(z1-z0)*sz) + 0.5 as py, cy+(y1-y0)*sy + 6.0 as pz from o, lat), q as (select obj_id, pz, case when pz > 1e-6 then 120.0::double*px/pz+79.5 end as u, case when pz > 1e-6 then 120.0::double*py/pz+59.5 end as v from p),
    k as (select *, coalesce(u between 0 and 159 and v between 0 and 119 and 6.0 >= pz - greatest(0.30, abs(pz)*0.10), false) as shown from q)
    select obj_id, round(avg(shown::int),6) as visible, round(quantile_cont(pz, 0.5) filter (pz > 1e-6),6) as range, greatest(least(floor(min(u)),159),0)::bigint as x1, greatest(least(floor(min(v)),119),0)::bigint as y1, greatest(least(floor(max(u)),159),0)::bigint as x2, greatest(least(floor(max(v)),119),0)::bigint as y2 from k group by obj_id having count(*) filter (pz > 1e-6) >= 4""")
def box_frames(spark, sf_dir):
    r, t = [F.lit(x) for x in S._ROT], [F.lit(x) for x in S._POS]
    depth = spark.range(160 * 120).select((F.col("id") % 160).cast("int").alias("u"), F.floor(F.col("id") / 160).cast("int").alias("v"), F.lit(6.0).alias("m"))
    return panorama.boxes_in_frame(views.objects(spark, sf_dir), depth, r, t, **S._CAM, width=160, height=120).select("obj_id", *r6("visible", "range"), *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"with {Q._ALIAS}, q(query) as (values {', '.join(f'({chr(39)}{x}{chr(39)})' for x in Q.ASKED)}), c as ({Q._CONCEPTS.format(src='(select query as t from q)')}) select t as query, case when (regexp_matches(t, '[一-鿿]') or len(string_split(t, ' ')) <= 2) and len(coalesce(c, [])) > 0 then list_sort(list_transform(c, lambda x: lpad(length(x)::varchar, 4, '0') || x))[1][5:] else t end as english from c")
def english_queries(spark, sf_dir):
    return L.to_english(Q._asked(spark))


@query(f"with {views.OBJECTS}, {_BOXES2D.replace('x1-x0', 'objects.x1-objects.x0').replace('y1-y0', 'objects.y1-objects.y0')}, v as (select *, unnest([1.0::double, 1.2, 1.5]) as scale from b), h as (select *, greatest(x2-x1, y2-y1)*scale/2 as half, (x1+x2)/2 as mx, (y1+y2)/2 as my from v) select frame_id, scale, round(greatest(least(mx-half,12.0),0.0),6) as vx1, round(greatest(least(my-half,22.0),0.0),6) as vy1, round(greatest(least(mx+half,12.0),0.0),6) as vx2, round(greatest(least(my+half,22.0),0.0),6) as vy2 from h")
def region_views(spark, sf_dir):
    return L.region_views(_labels2d(spark, sf_dir), 12, 22).select("frame_id", F.col("scale").cast("double").alias("scale"), *r6("vx1", "vy1", "vx2", "vy2"))


@query(f"with {views.OBJECTS}, u as (select label, obj_id, e, sqrt({Q._DOT('e', 'e')}) as n from objects), p as (select label, i, avg(e[i+1]/n) as x from u, range(64) t(i) group by label, i), s as (select label, sqrt(sum(x*x)) as n from p group by label) select label, round(p.x/s.n,6) as first from p join s using (label) where i = 0")
def text_ensembles(spark, sf_dir):
    return L.ensemble(views.objects(spark, sf_dir), "label").select("label", F.round(F.get("e", F.lit(0)), 6).alias("first"))
