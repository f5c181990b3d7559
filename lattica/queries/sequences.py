"""Queries over ordered events as frames of a video."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import vector as X
from lattica.operators import sequences as S
from lattica.operators import video as VD
from lattica.sources import views

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]
_D = f"{views.SIGNAL}, d as (select * from signal where diff is not null)"
_MAD = f"{_D}, m as (select user_id, median(diff) as med, count(*) as n from d group by user_id), mm as (select user_id, n, med, median(abs(diff-med)) as mad from d join m using (user_id) group by all)"
_FRAC = "least(0.10, greatest(0.01, 4.0::double/n))"
_ROB = f"""{_MAD}, rk as (select user_id, diff, row_number() over (partition by user_id order by diff) - 1 as rank, n, med, mad, (n-1)*(1-{_FRAC}) as h from d join mm using (user_id)),
    q as (select user_id, any_value(med) as med, any_value(mad) as mad, any_value(h) as h, min(diff) as a, max(diff) as b from rk where rank = floor(h) or rank = least(floor(h)+1, n-1) group by user_id),
    thr as (select user_id, case when mad <= 1e-12 then 2*med else greatest(med + 6*1.4826*mad, a + (b-a)*(h-floor(h)), 1e-9) end as threshold from q)"""


def _near(k: int) -> str:
    return f"list_sort(list_concat(list(diff) over (partition by user_id order by idx rows between {k} preceding and 1 preceding), list(diff) over (partition by user_id order by idx rows between 1 following and {k} following)))"


_MED = "(case when len(nb) % 2 = 1 then nb[len(nb)//2+1] else (nb[len(nb)//2]+nb[len(nb)//2+1])/2 end)"
_PROM = lambda r: f"(case when coalesce(len(nb),0) = 0 then true when {_MED} <= 0 then diff > 0 else diff >= {r}*{_MED} end)"
_PK = f"{_ROB}, nb1 as (select d.*, {_near(5)} as nb from d), p1 as (select user_id, idx, diff, {_PROM(5)} as prominent, {_PROM(2)} as gentle from nb1)"
_BOUND = f"""{_PK}, b1 as (select *, diff >= threshold and prominent as hard, sum(diff) over w / 5 >= 0.45*threshold and not (diff >= threshold and prominent) and gentle as soft, arg_max(idx, row(diff, -idx)) over w as peak from p1 join thr using (user_id) window w as (partition by user_id order by idx rows between 2 preceding and 2 following)),
    marks as (select user_id, case when hard then idx else peak end as idx, bool_or(hard) as hard from b1 where hard or soft group by all)"""
_BOUND = _BOUND.replace("select user_id, case when hard then idx else peak end as idx, bool_or(hard) as hard from b1 where hard or soft group by all", "select user_id, here as idx, bool_or(hard) as hard from (select user_id, case when hard then idx else peak end as here, hard from b1 where hard or soft) group by user_id, here")


def _signal(spark, sf_dir):
    return views.signal(spark, sf_dir)


@query(f"with {views.SIGNAL} select user_id, idx, round(diff,6) as diff from signal")
def frame_differences(spark, sf_dir):
    return _signal(spark, sf_dir).select("user_id", "idx", *r6("diff"))


@query(f"with {_MAD} select user_id, n, round(med,6) as med, round(mad,6) as mad, round(med + 6*1.4826*mad, 6) as \"limit\" from mm")
def mad_thresholds(spark, sf_dir):
    return S.mad_threshold(_signal(spark, sf_dir)).select("user_id", "n", *r6("med", "mad", "limit"))


@query(f"with {_ROB} select user_id, round(threshold,6) as threshold from thr")
def robust_thresholds(spark, sf_dir):
    return S.robust_threshold(_signal(spark, sf_dir)).select("user_id", *r6("threshold"))


@query(f"""with {_D}, l as (select user_id, log10(greatest(diff, 1e-9)) as l from d), r as (select user_id, min(l) as lo, max(l) as hi from l group by user_id having max(l) > min(l)), b as (select user_id, lo, hi, least(floor((l-lo)/(hi-lo)*128), 127)::bigint as bin from l join r using (user_id)),
    g as (select user_id, lo, hi, bin, count(*) as n from b group by all), c as (select *, sum(n) over w as w0, sum(n) over (partition by user_id) as al, sum(n*bin) over w as m0, sum(n*bin) over (partition by user_id) as m from g window w as (partition by user_id order by bin)),
    s as (select *, w0::double*(al-w0)*pow(m0::double/w0-(m-m0)::double/(al-w0),2) as bt from c where w0 < al), best as (select user_id, lo, hi, arg_max(bin, row(round(bt,3), -bin)) as bin from s group by all) select user_id, round(pow(10.0::double, lo+(bin+1)*(hi-lo)/128),6) as threshold from best""")
def otsu_thresholds(spark, sf_dir):
    return S.otsu_threshold(_signal(spark, sf_dir)).select("user_id", *r6("threshold"))


@query(f"with {_PK} select user_id, idx, prominent from p1")
def peaks(spark, sf_dir):
    return S.prominent(_signal(spark, sf_dir).where("diff is not null")).select("user_id", "idx", "prominent")


@query(f"with {_BOUND} select user_id, idx, hard from marks")
def boundaries(spark, sf_dir):
    return S.boundaries(_signal(spark, sf_dir))


@query(f"""with {_D}, hi as (select user_id, idx, diff from d where diff > 20), f as (select *, case when idx - lag(idx) over w <= 2 then 0 else 1 end as new from hi window w as (partition by user_id order by idx)), i as (select *, sum(new) over (partition by user_id order by idx) as island from f)
    select user_id, min(idx) as first, max(idx) as last, count(*) as n, round_even(sum(idx*diff)/greatest(sum(diff),1e-12), 0)::bigint as center from i group by user_id, island""")
def mark_islands(spark, sf_dir):
    return S.islands(_signal(spark, sf_dir).where("diff > 20"), gap=2).select("user_id", "first", "last", "n", "center")


def _shots(spark, sf_dir):
    s = _signal(spark, sf_dir)
    return s, S.shots(s.groupBy("user_id").agg(F.count("*").alias("n")), S.boundaries(s))


_STARTS = f"""with recursive {_BOUND.removeprefix("with ")}, mk as (select user_id, idx + 1 as pos, hard from marks), st(user_id, pos) as (select distinct user_id, 0::bigint from signal union all
    select s.user_id, min(m.pos) from st s join mk m on m.user_id = s.user_id and m.pos > s.pos and (m.pos - s.pos >= 3 or (s.pos = 0 and m.hard)) group by s.user_id, s.pos),
    nn as (select user_id, count(*) as n from signal group by user_id), ss as (select user_id, st.pos as start, nn.n from st join nn using (user_id) where st.pos < nn.n)"""


@query(f'{_STARTS} select user_id, row_number() over w - 1 as shot, start, coalesce(lead(start) over w, n) as "end" from ss window w as (partition by user_id order by start)')
def shots(spark, sf_dir):
    return _shots(spark, sf_dir)[1]


@query()
def boundary_scores(spark, sf_dir):
    s = _signal(spark, sf_dir)
    truth = s.where("event_type = 'purchase' and diff is not null").select("user_id", "idx")
    return S.micro_scores(S.boundary_scores(S.boundaries(s), truth)).select("tp", "fp", "fn", *r6("precision", "recall", "f1"))


@query()
def sampled_frames(spark, sf_dir):
    s, found = _shots(spark, sf_dir)
    return S.sample_frames(s, found)


@query()
def sampled_frames_uniform(spark, sf_dir):
    s, found = _shots(spark, sf_dir)
    return S.sample_frames(s, found, strategy="uniform")


@query()
def sample_coverage(spark, sf_dir):
    s, found = _shots(spark, sf_dir)
    return S.coverage(S.sample_frames(s, found), found).select("user_id", "frames", *r6("shot_coverage", "evenness"))


_HS = f"""{views.PIXELS}, q as (select *, greatest(rr,gg,bb) as hi, least(rr,gg,bb) as lo from (select *, r/255.0::double as rr, g/255.0::double as gg, b/255.0::double as bb from pixels)),
    hs as (select vec_id % 20 as video, vec_id // 20 as idx, case when hi = lo then 0.0 when hi = rr then (((gg-bb)/(hi-lo)) - 6*floor(((gg-bb)/(hi-lo))/6)) when hi = gg then (bb-rr)/(hi-lo)+2 else (rr-gg)/(hi-lo)+4 end / 6.0::double as h, case when hi = 0 then 0.0 else (hi-lo)/hi end as s from q),
    bins as (select video, idx, least(floor(h*32),31)::int*32 + least(floor(s*32),31)::int as bin from hs), hist as (select video, idx, bin, count(*)/20.0::double as share from bins group by all)"""


def _video_pixels(spark, sf_dir):
    return views.pixels(spark, sf_dir).withColumn("video", F.col("vec_id") % 20).withColumn("idx", F.floor(F.col("vec_id") / 20))


@query(f"with {_HS} select video, idx, bin, round(share,6) as share from hist")
def frame_histograms(spark, sf_dir):
    return VD.histograms(_video_pixels(spark, sf_dir)).select("video", "idx", "bin", *r6("share"))


@query(f"with {_HS}, f as (select distinct video, idx from hist), d as (select video, idx, sum((x-y)*(x-y)/(x+y))/2 as diff from (select video, idx, bin, sum(x) as x, sum(y) as y from (select video, idx, bin, share as x, 0.0::double as y from hist union all select video, idx-1, bin, 0.0, share from hist) group by all) group by video, idx) select video, idx, round(coalesce(diff,0),6) as diff from f left join d using (video, idx) where exists (select 1 from f g where g.video = f.video and g.idx > f.idx)")
def histogram_steps(spark, sf_dir):
    return VD.histogram_steps(VD.histograms(_video_pixels(spark, sf_dir))).select("video", "idx", *r6("diff"))


_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]*p[2]))"


@query(f"with {views.OBJECTS}, f as (select obj_id % 20 as video, obj_id // 20 as idx, e, lead(e) over (partition by obj_id % 20 order by obj_id // 20) as n from objects) select video, idx, round(1 - {_DOT('e', 'n')}/greatest(sqrt({_DOT('e', 'e')})*sqrt({_DOT('n', 'n')}), 1e-12), 6) as diff from f where n is not null")
def embedding_steps(spark, sf_dir):
    o = views.objects(spark, sf_dir).select((F.col("obj_id") % 20).alias("video"), F.floor(F.col("obj_id") / 20).alias("idx"), "e")
    return VD.embedding_steps(o).select("video", "idx", *r6("diff"))


_GRAYS = f"""{views.PIXELS}, gr as (select vec_id, u::int as u, v::int as v, round(0.299::double*r+0.587::double*g+0.114::double*b)::int as y from pixels),
    lp as (select a.vec_id, 4.0::double*0 + (select sum(b.y) from gr b where b.vec_id = a.vec_id and b.v = a.v and b.u = case when a.u = 0 then 1 else a.u - 1 end) + (select sum(b.y) from gr b where b.vec_id = a.vec_id and b.v = a.v and b.u = case when a.u = 4 then 3 else a.u + 1 end)
      + (select sum(b.y) from gr b where b.vec_id = a.vec_id and b.u = a.u and b.v = case when a.v = 0 then 1 else a.v - 1 end) + (select sum(b.y) from gr b where b.vec_id = a.vec_id and b.u = a.u and b.v = case when a.v = 3 then 2 else a.v + 1 end) - 4*a.y as l from gr a)"""


@query(f"with {_GRAYS}, k as (select vec_id, var_pop(l) as sharpness from lp group by vec_id) select vec_id, round(sharpness,4) as sharpness, round(stddev_pop(y),6) as contrast, round(avg((y>=250)::int),6) as overexposed, round(avg((y<=5)::int),6) as underexposed, 4 as min_side from gr join k using (vec_id) group by vec_id, sharpness")
def frame_quality(spark, sf_dir):
    q = VD.quality_scores(views.pixels(spark, sf_dir), ["vec_id"])
    return q.select("vec_id", F.round("sharpness", 4).alias("sharpness"), *r6("contrast", "overexposed", "underexposed"), "min_side")


@query()
def processed_videos(spark, sf_dir):
    p = _video_pixels(spark, sf_dir)
    quality = VD.quality_scores(p)
    hashes = S.gradient_hash(p.withColumn("gray", VD.gray(F.col("r"), F.col("g"), F.col("b"))).withColumn("key", F.struct("video", "idx")), "key", width=5).select("key.*", "hash")
    e = views.objects(spark, sf_dir).select((F.col("obj_id") % 20).alias("video"), F.floor(F.col("obj_id") / 20).alias("idx"), "e")
    steps = VD.histogram_steps(VD.histograms(p))
    frames = quality.join(hashes, ["video", "idx"]).join(e, ["video", "idx"]).join(steps, ["video", "idx"], "left")
    return VD.processed(frames, budget=12, side=2).figures.select("video", "frames", "shots", "chosen", "kept", "duplicates")


@query(f"with {views.SIGNAL}, r as (select user_id, value, row_number() over (partition by user_id order by value) as r from signal) select user_id, round(2*sum(r*value)/(count(*)*sum(value))-(count(*)+1)::double/count(*),6) as gini from r group by user_id")
def value_gini(spark, sf_dir):
    return S.gini(_signal(spark, sf_dir), "user_id", "value").select("user_id", *r6("gini"))


_GRAY = f"{views.PIXELS}, g as (select vec_id, u, v, r+g+b as gray, lead(r+g+b) over (partition by vec_id, v order by u) as nx from pixels), h as (select vec_id, bit_or(case when gray < nx then 1::bigint << (v*4+u)::int else 0::bigint end) as hash from g where nx is not null group by vec_id)"


def _hashes(spark, sf_dir):
    p = views.pixels(spark, sf_dir).withColumn("gray", F.col("r") + F.col("g") + F.col("b"))
    return S.gradient_hash(p, "vec_id", width=5)


@query(f"with {_GRAY} select vec_id, hash from h")
def gradient_hashes(spark, sf_dir):
    return _hashes(spark, sf_dir)


@query(f"with {_GRAY} select a.vec_id as a, b.vec_id as b, bit_count(xor(a.hash, b.hash))::int as bits from h a join h b on b.vec_id = a.vec_id + 1")
def hash_distances(spark, sf_dir):
    h = _hashes(spark, sf_dir)
    a, b = h.alias("a"), h.alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), X.hamming(F.col("a.hash"), F.col("b.hash")).cast("int").alias("bits"))


@query()
def distinct_frames(spark, sf_dir):
    e = views.objects(spark, sf_dir).select(F.col("obj_id").alias("vec_id"), "e").join(_hashes(spark, sf_dir), "vec_id")
    return S.distinct_frames(e.select((F.col("vec_id") % 50).alias("video"), F.col("vec_id").alias("idx"), "hash", "e"), "video", bits=2)


@query(f"with {views.PIXELS}, s as (select vec_id, stddev_pop(r+g+b) as contrast, avg((r+g+b > 600)::int) as over, avg((r+g+b < 150)::int) as under, var_pop(r-g)/50 as sharp, 100 + vec_id % 60 as side from pixels group by vec_id) select case when side < 128 then 'resolution' when sharp < 30 then 'blur' when contrast < 8 then 'low_contrast' when over > 0.35 then 'overexposed' when under > 0.35 then 'underexposed' else '' end as reason, count(*) as n from s group by 1")
def quality_reasons(spark, sf_dir):
    gray = F.col("r") + F.col("g") + F.col("b")
    s = views.pixels(spark, sf_dir).groupBy("vec_id").agg(F.stddev_pop(gray).alias("contrast"), F.avg((gray > 600).cast("int")).alias("over"), F.avg((gray < 150).cast("int")).alias("under"), (F.var_pop(F.col("r") - F.col("g")) / 50).alias("sharp"))
    reason = S.quality_reason(F.col("sharp"), F.col("contrast"), F.col("over"), F.col("under"), 100 + F.col("vec_id") % 60)
    return s.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"with {views.SIGNAL} select user_id, idx, round(last_value(case when idx % 3 = 0 then value end ignore nulls) over (partition by user_id order by idx rows unbounded preceding),6) as filled from signal")
def filled_values(spark, sf_dir):
    s = _signal(spark, sf_dir).withColumn("filled", F.when(F.col("idx") % 3 == 0, F.col("value")))
    return S.filled_forward(s, "user_id", "filled").select("user_id", "idx", *r6("filled"))


@query(f"with {views.SIGNAL}, l as (select user_id, idx, list(value) over (partition by user_id order by idx rows between 49 preceding and current row) as r from signal) select user_id, idx, idx + 1 as count, round(round(list_sum(r),2)/len(r),6) as mean, round(list_aggregate(r, 'quantile_cont', 0.5),6) as p50, round(list_aggregate(r, 'quantile_cont', 0.95),6) as p95 from l")
def sliding_latency(spark, sf_dir):
    s = S.sliding_latency(_signal(spark, sf_dir), "user_id", ["idx"], "value")
    return s.select("user_id", "idx", F.col("count").cast("long").alias("count"), *r6("mean", "p50", "p95"))
