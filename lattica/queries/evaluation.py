"""Queries that score predictions, answers and policies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lattica.functions import geometry as G
from lattica.functions import text as T
from lattica.operators import metrics as M
from lattica.operators import reports as RP
from lattica.operators import reward as R
from lattica.operators import spatial as S
from lattica.queries import language as Q
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


def _scored(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id")
    return d.select((F.length(F.regexp_replace("text", "[^a-zA-Z ]", "")) * 1000 / F.greatest(F.length("text"), F.lit(1))).cast("int").alias("score"), (F.col("quality") == 1).alias("positive"))


_SC = "sc as (select floor(length(regexp_replace(text, '[^a-zA-Z ]', '', 'g')) * 1000 / greatest(length(text), 1))::int as score, quality = 1 as positive from documents join labels using (doc_id)), g as (select score, sum(positive::int) as p, sum((not positive)::int) as n from sc group by score)"


@query(f"with {_SC}, w as (select p, n, p*(coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) + n/2.0::double) as won from g) select sum(p)::bigint as positives, sum(n)::bigint as negatives, round(sum(won)/(sum(p)*sum(n)),6) as auc from w")
def quality_auc(spark, sf_dir):
    return M.auc(_scored(spark, sf_dir)).select("positives", "negatives", *r6("auc"))


@query(f"with {_SC}, t(threshold) as (values (500.0::double),(700.0),(800.0),(900.0),(950.0)) select threshold, round(avg((score >= threshold)::int) filter (positive),6) as hit, round(avg((score < threshold)::int) filter (not positive),6) as reject, round(avg((score >= threshold)::int) filter (positive) * avg((score < threshold)::int) filter (not positive),6) as balanced from sc, t group by threshold")
def accept_sweep(spark, sf_dir):
    return M.accept_sweep(_scored(spark, sf_dir), [500, 700, 800, 900, 950]).select("threshold", *r6("hit", "reject", "balanced"))


def _placed(a, b):
    """Even ids are predictions, odd ones truths, in scenes by the lesser one; remainders as in SQL."""
    return np.fmod(a, 2) != np.fmod(b, 2), np.fmod(a, 7), np.fmod(a, 2) == 0


@query()
def detection_scores(spark, sf_dir):
    n = views.table(spark, sf_dir, "embeddings").count() // 2
    return M.detection_scores(S.matched_overlaps(views.objects(spark, sf_dir), 0.1, _placed), n, n).select("tp", *r6("precision", "recall", "f1", "mean_iou"))


@query()
def yaw_overlaps(spark, sf_dir):
    o = views.objects(spark, sf_dir)
    box = F.array(*[F.col(f"c{k}") for k in G.AXES], *[F.col(f"{k}1") - F.col(f"{k}0") for k in G.AXES], F.get("e", F.lit(7)) * 10)
    slim = o.select("obj_id", box.alias("box"), "cx", "cy", "cz")
    p = S.within_distance(slim, slim, ("cx", "cy", "cz"), 0.5).where("a.obj_id < b.obj_id")
    return p.select(F.col("a.obj_id").alias("a"), F.col("b.obj_id").alias("b"), F.round(M.yaw_iou(F.col("a.box"), F.col("b.box")), 6).alias("iou"))


@query(f"with {views.OBJECTS}, d as (select sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz)) as error from objects a join objects b on b.obj_id = a.obj_id + 1) select count(*) as n, round(avg(error),6) as mean, round(quantile_cont(error,0.5),6) as median, round(quantile_cont(error,0.9),6) as p90, round(min(error),6) as least, round(max(error),6) as most, round(avg((error<=0.25)::int),6) as within_25, round(avg((error<=0.5)::int),6) as within_50 from d")
def localization_errors(spark, sf_dir):
    o = views.objects(spark, sf_dir)
    p = o.alias("a").join(o.alias("b"), F.col("b.obj_id") == F.col("a.obj_id") + 1)
    return M.localization(p.select(G.center_distance().alias("error"))).select("n", *r6("mean", "median", "p90", "least", "most", "within_25", "within_50"))


_DETECTED = f"{views.OBJECTS}, det as (select label, conf - 0.3 as score, obj_id % 60 as n_points, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)+(z1-z0)*(z1-z0)) as diagonal from objects), sz(label, low, high) as (values ('class1', 0.5::double, 0.2::double), ('class2', 2.5, 0.6), ('class3', 0.2, 0.3))"


@query(f"with {_DETECTED}, l as (select det.*, case when score < 0.3 then 'low_score' when n_points < 20 then 'few_points' when diagonal < 0.2*coalesce(low,0) or diagonal > 3*coalesce(high,'infinity'::double) then 'implausible_size' else '' end as reason from det left join sz using (label)) select label, count(*) as n, sum((reason='')::bigint)::bigint as accepted, round(avg(score) filter (reason=''),6) as mean_score, sum((reason='low_score')::bigint)::bigint as low_score, sum((reason='few_points')::bigint)::bigint as few_points, sum((reason='implausible_size')::bigint)::bigint as implausible_size from l group by label")
def label_report(spark, sf_dir):
    o = views.objects(spark, sf_dir)
    det = o.select("label", (F.col("conf") - 0.3).alias("score"), (F.col("obj_id") % 60).alias("n_points"), G.length([F.col(f"{k}1") - F.col(f"{k}0") for k in G.AXES]).alias("diagonal"))
    sizes = spark.createDataFrame([("class1", 0.5, 0.2), ("class2", 2.5, 0.6), ("class3", 0.2, 0.3)], "label string, low double, high double")
    return RP.label_report(RP.labelled(det, sizes)).select("label", "n", "accepted", *r6("mean_score"), "low_score", "few_points", "implausible_size")


@query("with a as (select unnest([case conv_id % 3 when 0 then 'locate' when 1 then 'count' else 'relation' end, 'all']) as intent, case when turn % 4 = 0 then null else length(text) % 2 = 0 end as ok from conversations) select intent, count(*) as asked, count(ok) as judged, coalesce(sum(ok::int),0)::bigint as right, round(avg(ok::int),6) as accuracy from a group by intent")
def intent_accuracy(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    intent = F.element_at(F.array(F.lit("locate"), F.lit("count"), F.lit("relation")), (F.col("conv_id") % 3 + 1).cast("int"))
    return RP.accuracy_by_intent(c.select(intent.alias("intent"), F.when(F.col("turn") % 4 != 0, F.length("text") % 2 == 0).alias("ok"))).select("intent", "asked", "judged", "right", *r6("accuracy"))


@query(f"with {views.OBJECTS}, m as (select label, median(cx) as mx, median(cy) as my, median(cz) as mz, count(*) as n from objects group by label), d as (select obj_id, label, n, sqrt((cx-mx)*(cx-mx)+(cy-my)*(cy-my)+(cz-mz)*(cz-mz)) as distance from objects join m using (label)) select obj_id, label, round(distance,6) as distance from d where n >= 3 and distance > 1.5")
def label_suspects(spark, sf_dir):
    return M.suspects(views.objects(spark, sf_dir), reach=1.5).select("obj_id", "label", *r6("distance"))


@query(f"with {views.OBJECTS}, d as (select conf - 0.5 as score, obj_id % 60 as points, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)+(z1-z0)*(z1-z0)) as diagonal from objects) select case when score < 0.3*0.2 then 'low_score' when points < 20 then 'few_points' when diagonal < 0.2*2.0 or diagonal > 3*0.25 then 'implausible_size' else '' end as reason, count(*) as n from d group by 1")
def label_reasons(spark, sf_dir):
    o = views.objects(spark, sf_dir)
    diagonal = G.length([F.col(f"{k}1") - F.col(f"{k}0") for k in G.AXES])
    reason = M.label_reason((F.col("conf") - 0.5) / 0.2, F.col("obj_id") % 60, diagonal, F.lit(2.0), F.lit(0.25))
    return o.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("with v as (select unnest([{'name': 'l_quantity', 'x': l_quantity}, {'name': 'l_discount', 'x': l_discount}, {'name': 'l_tax', 'x': case when l_linenumber = 1 then null else l_tax end}]) as v from lineitem) select v.name as name, round(avg(v.x),6) as mean from v group by 1")
def column_means(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_tax")))
    return M.column_means(li, ["l_quantity", "l_discount", "l_tax"]).select("name", *r6("mean"))


@query(Q._HYBRID.replace("select query, obj_id, label, round(score,6) as score, round(fused,6) as fused, rn as rank from (select *, row_number() over (partition by query order by score desc, obj_id) as rn from rk where score > 0) where rn <= 5", ", r as (select *, row_number() over (partition by query order by score desc, obj_id) as rn from rk where score > 0), f as (select query, min(rn) filter (obj_id % 3 = 0) as r from r where rn <= 20 group by query) select count(*) as queries, round(avg(coalesce(r <= 1, false)::int),6) as recall_1, round(avg(coalesce(r <= 3, false)::int),6) as recall_3, round(avg(coalesce(1.0::double/r, 0)),6) as mrr, median(r)::double as median_rank from f"))
def query_recall(spark, sf_dir):
    from lattica.operators import language as L

    r = L.ranked(Q._scored(spark, sf_dir), 20, t_embedding=0.9).withColumn("hit", F.col("obj_id") % 3 == 0)
    return M.recall_at(r).select("queries", *r6("recall_1", "recall_3", "mrr"), "median_rank")


@query(f"""with {views.OBJECTS}, ring as (select ((floor((atan2(cy,cx)/(2*pi())+0.5)*36)::bigint % 36)+36)%36 as col, avg(sqrt(cx*cx+cy*cy)) as value from objects group by 1), b as (select (col+29)%36 as col, value + 0.01*(col%3) as value from ring),
    c as (select s.shift, corr(a.value, b.value) as corr from range(36) s(shift), b join ring a on a.col = (b.col+s.shift)%36 group by s.shift) select shift, round(corr,6) as corr from c order by round(corr,9) desc, shift limit 1""")
def azimuth_shift(spark, sf_dir):
    o = views.objects(spark, sf_dir)
    col = F.pmod(F.floor((F.atan2("cy", "cx") / (2 * 3.141592653589793) + 0.5) * 36), F.lit(36))
    ring = o.groupBy(col.alias("col")).agg(F.avg(F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy"))).alias("value"))
    b = ring.select(((F.col("col") + 29) % 36).alias("col"), (F.col("value") + 0.01 * (F.col("col") % 3)).alias("value"))
    return M.azimuth_shift(ring, b, 36).select("shift", *r6("corr"))


# ---------------------------------------------------------------------------------------------------- rewards

_ANS = """ans as (select conv_id as "group", turn, text, case conv_id % 4 when 0 then 'relation' when 1 then 'distance' when 2 then 'locate' else 'list_on' end as task, length(text) % 17 / 8.0::double as error, length(text) % 2 = 0 as rightish,
    list_distinct(string_split(lower(text), ' ')[1:4]) as found, list_distinct(string_split(lower(text), ' ')[2:6]) as truth, len(string_split(text, ' ')) as tokens, length(text) > 5 as parsed, length(text) % 3 <> 0 as formatted from conversations),
    cor as (select *, case task when 'relation' then rightish::int::double when 'distance' then exp(-error/0.5) when 'locate' then exp(-error/1.0) else least(1.0, case when len(found)+len(truth) > 0 then 2.0::double*len(list_intersect(found, truth))/(len(found)+len(truth)) else 1.0 end + case when len(found) = len(truth) then 0.2 else 0 end) end as correct from ans),
    rew as (select *, case when parsed then 0.2*formatted::int + 1.0*correct + 0.05*(-least(1.0, greatest(tokens-48,0)/48.0::double)) else 0.0 end as reward from cor)"""


def _answers(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "group")
    task = F.element_at(F.array(*[F.lit(x) for x in ("relation", "distance", "locate", "list_on")]), (F.col("group") % 4 + 1).cast("int"))
    w = F.split(F.lower("text"), " ")
    c = c.select("group", "turn", "text", task.alias("task"), (F.length("text") % 17 / 8.0).alias("error"), (F.length("text") % 2 == 0).alias("right"), F.array_distinct(F.slice(w, 1, 4)).alias("found"), F.array_distinct(F.slice(w, 2, 5)).alias("truth"), F.size(F.split("text", " ")).alias("tokens"), (F.length("text") > 5).alias("parsed"), (F.length("text") % 3 != 0).alias("formatted"))
    c = c.withColumn("correct", R.correctness(F.col("task"), F.col("error"), F.col("right"), F.col("found"), F.col("truth")))
    return c.withColumn("reward", R.reward(F.col("parsed"), F.col("formatted"), F.col("correct"), F.col("tokens")))


@query(f'with {_ANS} select "group", turn, task, round(correct,6) as correct, round(reward,6) as reward from rew')
def rewards(spark, sf_dir):
    return _answers(spark, sf_dir).select("group", "turn", "task", *r6("correct", "reward"))


@query(f"with {_ANS} select count(*) as n, round(avg(reward),6) as mean, round(stddev_pop(reward),6) as std, round(min(reward),6) as least, round(max(reward),6) as most, round(avg(formatted::int),6) as format_rate, round(avg((reward>0)::int),6) as nonzero_rate from rew")
def reward_stats(spark, sf_dir):
    return R.reward_stats(_answers(spark, sf_dir)).select("n", *r6("mean", "std", "least", "most", "format_rate", "nonzero_rate"))


_ADV = f'{_ANS}, adv as (select *, stddev_pop(reward) over (partition by "group") < 1e-4 as degenerate, case when stddev_pop(reward) over (partition by "group") < 1e-4 then 0.0 else (reward - avg(reward) over (partition by "group"))/(stddev_pop(reward) over (partition by "group")+1e-4) end as advantage from rew)'


@query(f'with {_ADV} select "group", turn, degenerate, round(advantage,5) as advantage from adv')
def advantages(spark, sf_dir):
    return R.advantages(_answers(spark, sf_dir)).select("group", "turn", "degenerate", F.round("advantage", 5).alias("advantage"))


_TOK = f"""{_ADV}, tok as (select "group"*100 + turn as seq, -(abs(sin(i*1.7+turn))+0.1) as new, -(abs(sin(i*1.7+turn+0.2))+0.1) as old, -(abs(sin(i*1.7+turn-0.3))+0.1) as ref, advantage from adv, range(6) t(i)),
    k as (select *, exp(ref-new)-1-(ref-new) as kl from tok)"""
_LOSS = "select count(*) as n, round(-avg(s),6) as policy, round(avg(kl),6) as kl, round(-avg(s)+0.01*avg(kl),6) as loss, round(-avg(new),6) as entropy, round(avg((r < 0.8 or r > 1.28)::int),6) as clip_fraction, round(avg((advantage=0)::int),6) as zero_advantage, round(avg(r),6) as mean_ratio from (select *, least(r*advantage, greatest(least(r,1.28),0.8)*advantage) as s from r)"


def _tokens(spark, sf_dir):
    a = R.advantages(_answers(spark, sf_dir)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5))))
    lp = lambda x: -(F.abs(F.sin(F.col("i") * 1.7 + F.col("turn") + x)) + 0.1)
    return a.select((F.col("group") * 100 + F.col("turn")).alias("seq"), lp(0.0).alias("new"), lp(0.2).alias("old"), lp(-0.3).alias("ref"), "advantage")


_LOSS_COLS = ("policy", "kl", "loss", "entropy", "clip_fraction", "zero_advantage", "mean_ratio")


@query(f"with {_TOK}, r as (select *, exp(greatest(least(new-old,20),-20)) as r from k) {_LOSS}")
def policy_loss(spark, sf_dir):
    return R.policy_loss(_tokens(spark, sf_dir)).select("n", *r6(*_LOSS_COLS))


@query(f"with {_TOK}, sq as (select seq, avg(new) as new, avg(old) as old, avg(kl) as kl, max(advantage) as advantage from k group by seq), r as (select *, exp(greatest(least(new-old,20),-20)) as r from sq) {_LOSS}")
def policy_loss_by_sequence(spark, sf_dir):
    return R.policy_loss(_tokens(spark, sf_dir), "sequence").select("n", *r6(*_LOSS_COLS))


@query("with s as (select date_trunc('day', ts) as step, avg(value) as reward from events group by 1), i as (select *, row_number() over (order by step) - 1 as i, count(*) over () as n from s) select round(avg(reward) filter (i < n//2),6) as first, round(avg(reward) filter (i >= n//2),6) as second, round(avg(reward) filter (i >= n//2) - avg(reward) filter (i < n//2),6) as gain from i")
def training_halves(spark, sf_dir):
    s = views.table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("step")).agg(F.avg("value").alias("reward"))
    return R.halves(s).select(*r6("first", "second", "gain"))


@query("select conv_id, turn, len(regexp_extract_all(text, '-?\\d+(?:\\.\\d+)?')) as n, case when regexp_matches(lower(text), '\\b(no|not|isn''t|aren''t|false)\\b|不|没') then false when regexp_matches(lower(text), '\\b(yes|true|correct)\\b|是|对') then true end as yes from conversations")
def answer_numbers(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.size(R.numbers(F.col("text"))).cast("long").alias("n"), R.yes_no(F.col("text")).alias("yes"))


_RELATED = Q._spatial()._PAIRS.replace(views.OBJECTS, Q._NAMED).replace("from objects a join objects b", "from named a join named b").replace("distance <= 0.8", "distance <= 0.5 and subject <> object")


@query(f"""with {_RELATED}, f as (select * from (select *, row_number() over (partition by relation order by subject_id, object_id) as rn from related) where rn <= 20 and relation <> 'unknown'), a as (select *, case when rn % 2 = 0 then relation when relation = 'above' then 'below' else 'above' end as asked from f)
    select subject_id, object_id, 'Is the ' || subject || ' ' || asked || ' the ' || object || '?' as question, case when asked = relation then 'yes' else 'no' end as answer from a""")
def spatial_questions(spark, sf_dir):
    from pyspark.sql import Window

    found = S.relations(Q.named_objects(spark, sf_dir), 0.5, same_label=False)
    w = Window.partitionBy("relation").orderBy("subject_id", "object_id")
    f = found.withColumn("rn", F.row_number().over(w)).where("rn <= 20 and relation <> 'unknown'")
    turned = F.when(F.col("rn") % 2 == 0, F.col("relation")).otherwise(F.when(F.col("relation") == "above", "below").otherwise("above"))
    asked = f.withColumn("asked", turned)
    return asked.select("subject_id", "object_id", F.format_string("Is the %s %s the %s?", "subject", "asked", "object").alias("question"), F.when(F.col("asked") == F.col("relation"), "yes").otherwise("no").alias("answer"))


@query()
def json_answers(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Sure: ```json\n"), "props", F.lit("\n``` done")).alias("text"))
    return e.select("event_id", F.get_json_object(T.extract_json(F.col("text")), "$.k").cast("long").alias("k"))


ORACLE_SQL["json_answers"] = "select event_id, json_extract(props, '$.k')::bigint as k from events"
