"""Queries over times, poses and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import voxels as V
from lattica.sources import views
from lattica.streaming import codec, sync

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


def _events(spark, sf_dir, kind):
    e = views.table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select("user_id", F.col("event_id").alias("id"), t.alias("t"), "value")


def _ev(kind: str, name: str) -> str:
    return f"{name} as (select user_id, event_id as id, epoch_us(ts)/1e6::double as t, value from events where event_type = '{kind}')"


def _nearest(left: str, right: str, slop: int, out: str) -> str:
    return f"{out} as (select l.user_id, l.id, any_value(l.t) as t, arg_min(r.id, row(abs(l.t-r.t), r.t, r.id)) as id_right from {left} l join {right} r on l.user_id = r.user_id and abs(l.t-r.t) <= {slop} group by l.user_id, l.id)"


@query(f"with {_ev('click', 'c')}, {_ev('view', 'v')}, {_ev('purchase', 'p')}, {_nearest('c', 'v', 7200, 'one')}, {_nearest('one', 'p', 7200, 'two')} select two.user_id, two.id, one.id_right as depth_id, two.id_right as info_id from two join one using (user_id, id)")
def synchronized(spark, sf_dir):
    c, v, p = (_events(spark, sf_dir, k) for k in ("click", "view", "purchase"))
    return sync.synchronized(c.drop("value"), v, p, "user_id", 7200.0).select("user_id", "id", "depth_id", "info_id")


@query(f"with {_ev('click', 'c')}, {_ev('view', 'v')}, a as (select c.*, v.t as vt, v.value as vv from c asof left join v on c.user_id = v.user_id and c.t >= v.t) select user_id, id, case when t - vt <= 21600 then round(vv, 6) end as pose from a")
def latest_pose(spark, sf_dir):
    c, v = _events(spark, sf_dir, "click"), _events(spark, sf_dir, "view").withColumnRenamed("value", "pose")
    return sync.latest_pose(c.drop("value"), v, "user_id", ["pose"], max_age=21600.0).select("user_id", "id", *r6("pose"))


_POSE = f"""{_ev('click', 'c')}, {_ev('view', 'v')}, a as (select c.user_id, c.id, c.t, v.t as t0, v.value as v0 from c asof left join v on c.user_id = v.user_id and c.t >= v.t), b as (select c.user_id, c.id, v.t as t1, v.value as v1 from c asof left join v on c.user_id = v.user_id and c.t <= v.t),
    j as (select user_id, id, t, coalesce(t0,t1) as t0, coalesce(v0,v1) as v0, coalesce(t1,t0) as t1, coalesce(v1,v0) as v1 from a join b using (user_id, id) where t0 is not null or t1 is not null), w as (select *, case when t1-t0 > 1e-12 then (t-t0)/(t1-t0) else 0 end as s from j)"""


@query(f"with {_POSE} select user_id, id, round(v0+(v1-v0)*s, 5) as px, round(sin((1-s)*abs(v1-v0)/200)/sin(abs(v1-v0)/200)*sin(v0/200) + sin(s*abs(v1-v0)/200)/sin(abs(v1-v0)/200)*sin(v1/200), 5) as qz from w where abs(v1-v0) between 1 and 300")
def interpolated_pose(spark, sf_dir):
    """Rotations about z by value / 100: half angles are value / 200."""
    c = _events(spark, sf_dir, "click").drop("value")
    v = _events(spark, sf_dir, "view")
    poses = v.select("user_id", "id", "t", F.col("value").alias("px"), F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(F.col("value") / 200).alias("qz"), F.cos(F.col("value") / 200).alias("qw"))
    both = sync.interpolated_pose(c, poses, "user_id")
    from lattica.plans.rewrites import as_of

    f = as_of(as_of(c, v, ["user_id"], "t", "id", ["value"]), v, ["user_id"], "t", "id", ["value"], following=True)
    apart = f.where(F.abs(F.coalesce("prev.value", "next.value") - F.coalesce("next.value", "prev.value")).between(1, 300)).select("user_id", "id")
    return both.join(apart, ["user_id", "id"]).select("user_id", "id", F.round("px", 5).alias("px"), F.round("qz", 5).alias("qz"))


@query("select event_id, epoch_us(ts) // 1000000 as sec, (epoch_us(ts) % 1000000) * 1000 as nanosec from events")
def event_stamps(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", (F.floor(us / 1_000_000)).alias("sec"), (us % 1_000_000 * 1000).alias("nanosec"))


@query("select event_id, user_id, round(value, 6) as value, try_cast(json_extract(props, '$.k') as bigint) as k from events")
def decoded_messages(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return codec.decode(codec.encode(e), "event_id long, user_id long, value double, k long").select("event_id", "user_id", *r6("value"), "k")


@query(f"with {views.OBJECTS}, t as (select obj_id, label, cx, cy, cz, conf from objects order by conf desc, obj_id limit 200) select (select count(*) from t) as n, obj_id, label, round(cx,6) as cx, round(cy,6) as cy, round(cz,6) as cz, round(conf,6) as conf from t")
def map_message(spark, sf_dir):
    """The message, read back."""
    m = codec.capped_map(views.objects(spark, sf_dir))
    o = m.select("n", F.explode(F.from_json("message", "array<struct<obj_id:long,label:string,cx:double,cy:double,cz:double,conf:double>>")).alias("o"))
    return o.select("n", "o.obj_id", "o.label", *[F.round(f"o.{c}", 6).alias(c) for c in ("cx", "cy", "cz", "conf")])


@query()
def streamed_field(spark, sf_dir):
    """The field of a stream of embeddings files, run to its end: equal to voxel_mean of the batch."""
    import uuid

    raw = spark.readStream.schema("vec_id long, embedding array<float>, label int").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/embeddings.parquet*")
    k = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")
    v = raw.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), k)
    at = lambda i: F.get("e", F.col("k") * 3 + i) * 8
    p = v.select("vec_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), (0.5 + F.abs(F.get("e", F.lit(63)))).alias("w"), "e")
    root = f"{_folder(spark)}/field-{uuid.uuid4().hex}"

    def keep(batch, number: int) -> None:
        """Every batch writes the whole field of what was read so far; the last one counts."""
        batch.write.mode("overwrite").parquet(f"{root}/{number}")

    q = sync.fused_stream(p, dims=_spatial._DIMS, mode="mean").writeStream.outputMode("complete").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return V.finished(spark.read.parquet(f"{root}/{last}"), "mean", _spatial._DIMS).select(*V.KEY, "n", *r6("weight", *[f"f{i}" for i in range(_spatial._DIMS)]))


def _folder(spark) -> str:
    """The folder that driver and executors share, or one of our own where none is set (tests)."""
    import tempfile

    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="lattica-")


from lattica.queries import spatial as _spatial  # noqa: E402

ORACLE_SQL["streamed_field"] = _spatial.ORACLE_SQL["voxel_mean"]
