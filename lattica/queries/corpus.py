"""Queries over captions, their mixture and their shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import corpus as C
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

_RUNS = "regexp_replace({}, '[\u200b\u200c\u200d\ufeff]', ' ', 'g')"
for _m, _p in (("!", "!"), ("?", "\\?"), (".", "\\."), (",", ","), (";", ";"), (":", ":")):
    _RUNS = f"regexp_replace({_RUNS}, '{_p}{{3,}}', '{_m}', 'g')"
_SQUEEZED = "trim(regexp_replace(" + _RUNS.replace("{}", "regexp_replace(text, '<[^>]+>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"
_LONG = "when len(ws) > 60 then 'too_long'"
_CLEAN = f"""{views.CAPTIONS}, t1 as (select ord, video_id, category, n_chars, {_SQUEEZED} as cleaned from captions),
    t2 as (select *, case when cleaned = '' then [] else string_split(cleaned, ' ') end as ws, regexp_extract_all(cleaned, '[A-Za-z'']+') as lt, length(regexp_replace(cleaned, '[\\x00-\\x7f]', '', 'g')) as na from t1),
    clean as (select ord, video_id, category, n_chars, cleaned, len(ws) as tokens, case when regexp_matches(cleaned, '(?i)https?://|www\\.') then 'url' when len(ws) < 3 then 'too_short' {_LONG} when cleaned = '' then 'empty'
        when na::double / greatest(length(cleaned), 1) > 0.15 then 'non_ascii' when coalesce(list_sum(list_transform(lt, lambda x: length(x))), 0) < 6 then 'no_alpha'
        when 1 - len(list_distinct(list_transform(lt, lambda x: lower(x))))::double / greatest(len(lt), 1) > 0.5 then 'degenerate_repeat' else '' end as drop_reason from t2),
    kept as (select * from clean where drop_reason = '')"""
#: Documents stand for captions of any length: all other gates hold.
_ANY = _CLEAN.replace(_LONG, "")


def _clean(spark, sf_dir):
    return C.cleaned(views.captions(spark, sf_dir), full=False)


def _kept(spark, sf_dir):
    return C.cleaned(views.captions(spark, sf_dir), full=False, most=None).where("drop_reason = ''")


@query(f"with {_CLEAN} select ord, tokens, drop_reason from clean")
def cleaned_captions(spark, sf_dir):
    return _clean(spark, sf_dir).select("ord", "tokens", "drop_reason")


@query(f"with {_CLEAN} select drop_reason, count(*) as n from clean group by drop_reason")
def drop_reasons(spark, sf_dir):
    return _clean(spark, sf_dir).groupBy("drop_reason").agg(F.count("*").alias("n"))


# The tables hold neither references nor compatibility characters, so that SQL, which has no form for these, says the same.
@query(f"with {_CLEAN} select ord, tokens, drop_reason, md5(cleaned) as cleaned from clean")
def cleaned_captions_full(spark, sf_dir):
    return C.cleaned(views.captions(spark, sf_dir)).select("ord", "tokens", "drop_reason", F.md5("cleaned").alias("cleaned"))


@query(f"with {_ANY} select ord, row_number() over (partition by lower(cleaned) order by ord) > 1 as exact from kept")
def exact_duplicates(spark, sf_dir):
    return C.exact_duplicates(_kept(spark, sf_dir)).select("ord", "exact")


@query(f"with {_ANY} select ord, row_number() over (partition by lower(cleaned), video_id order by ord) > 1 as exact from kept")
def exact_duplicates_per_video(spark, sf_dir):
    return C.exact_duplicates(_kept(spark, sf_dir), per_video=True).select("ord", "exact")


@query(f"with {_ANY} select ord, row_number() over (partition by array_to_string(list_sort(list_distinct(string_split(lower(cleaned), ' '))), ' ') order by ord) > 1 as wordset from kept")
def wordset_duplicates(spark, sf_dir):
    return C.wordset_duplicates(_kept(spark, sf_dir)).select("ord", "wordset")


@query(f"with {_ANY} select md5(lower(cleaned)) as text, count(distinct video_id) as videos, count(*) as copies from kept group by lower(cleaned) having count(distinct video_id) >= 3")
def caption_templates(spark, sf_dir):
    return C.templates(_kept(spark, sf_dir)).select(F.md5("text").alias("text"), "videos", "copies")


@query()
def near_duplicate_captions(spark, sf_dir):
    return C.near_duplicates(_kept(spark, sf_dir))


@query(f"""with {_ANY}, w as (select unnest(regexp_extract_all(lower(cleaned), '[A-Za-z'']+')) as word from kept), v as (select video_id, count(*) as c from kept group by video_id)
    select (select count(*) from kept) as captions, (select sum(tokens)::bigint from kept) as tokens, (select quantile_cont(tokens, 0.1) from kept) as p10, (select quantile_cont(tokens, 0.5) from kept) as p50, (select quantile_cont(tokens, 0.9) from kept) as p90,
    (select count(*) from w) as words, (select count(distinct word) from w) as vocabulary, (select min(c) from v) as least, (select round(avg(c),6) from v) as mean, (select max(c) from v) as most, round((select count(distinct word) from w)::double / (select count(*) from w), 6) as ttr""")
def caption_stats(spark, sf_dir):
    return C.caption_stats(_kept(spark, sf_dir)).select("captions", "tokens", "p10", "p50", "p90", "words", "vocabulary", "least", *r6("mean"), "most", *r6("ttr"))


@query(f"with {_ANY}, w as (select unnest(regexp_extract_all(lower(cleaned), '[A-Za-z'']+')) as word from kept) select word, count(*) as n from w group by word order by n desc, word limit 15")
def top_words(spark, sf_dir):
    return C.top_words(_kept(spark, sf_dir))


_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]*p[2]))"


@query(f"""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), p as (select {_DOT('a.e', 'b.e')} / greatest(sqrt({_DOT('a.e', 'a.e')})*sqrt({_DOT('b.e', 'b.e')}), 1e-12) as s from v a join v b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0)
    select true as performed, count(*) as n, round(avg(s),6) as mean, round(quantile_cont(s,0.5),6) as median, round(avg((s < 0.2)::int),6) as low from p""")
def caption_alignment(spark, sf_dir):
    """Even vectors stand for captions, the odd ones after them for their frames."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    a = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.col("e").alias("a"))
    b = e.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("id"), F.col("e").alias("b"))
    return C.alignment(spark, a.join(b, "id")).select("performed", "n", *r6("mean", "median", "low"))


def _samples(spark, sf_dir):
    k = _kept(spark, sf_dir)
    return k.select("ord", F.col("category").alias("group"), "video_id", "tokens", (F.col("n_chars") % 24).alias("frames_kept"), (F.col("n_chars") / 20).alias("duration"))


_SAMPLES = f"{_ANY}, samples as (select ord, category as \"group\", video_id, tokens, n_chars % 24 as frames_kept, n_chars / 20 as duration from kept)"


@query(f"with {_SAMPLES} select case when duration < 15 then '<15s' when duration < 30 then '15-30s' when duration < 60 then '30-60s' when duration < 120 then '60-120s' else '>120s' end as bucket, count(*) as n from samples group by 1")
def duration_buckets(spark, sf_dir):
    return _samples(spark, sf_dir).groupBy(T.duration_bucket(F.col("duration")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"with {_SAMPLES} select sum(tokens)::bigint as total, round(avg(tokens),6) as mean, quantile_cont(tokens,0.5) as median, round(quantile_cont(tokens,0.95),6) as p95, round(avg(frames_kept),6) as mean_frames from samples")
def token_budget(spark, sf_dir):
    return C.token_budget(_samples(spark, sf_dir)).select("total", *r6("mean"), "median", *r6("p95", "mean_frames"))


@query()
def mixture(spark, sf_dir):
    return C.mixture(_samples(spark, sf_dir), 500).select("ord", "group", "turn")


_H = "('0x' || substr(md5(ord::varchar || '#0'), 1, 15))::bigint"


@query(f"with {_SAMPLES}, r as (select ord, tokens, sum(tokens) over (order by {_H}, ord rows unbounded preceding) as run from samples) select ord, tokens from r where run <= 20000")
def token_budget_sample(spark, sf_dir):
    return C.within_token_budget(_samples(spark, sf_dir), 20000).select("ord", "tokens")


@query(f"with {_SAMPLES}, s as (select tokens, to_json({{'ord': ord, 'group': samples.\"group\", 'tokens': tokens, 'frames_kept': frames_kept}}) as line, (row_number() over (order by ord) - 1) // 100 as shard from samples) select shard, count(*) as n, sum(tokens)::bigint as tokens, sum(strlen(line) + 1)::bigint as bytes from s group by shard")
def shard_manifest(spark, sf_dir):
    return C.manifest(C.sharded(_samples(spark, sf_dir).select("ord", "group", "tokens", "frames_kept"), 100))


_ERR = "case when o_orderpriority = '1-URGENT' then 'decode_failed' when o_totalprice < 20000 then 'open_failed' else '' end"
_RUNS_SQL = f"videos as (select o_orderkey as video_id, {_ERR} as error, count(*) as frames, sum((l_returnflag = 'N')::bigint)::bigint as kept, sum(l_linenumber)::bigint as captions, sum(case when l_discount < 0.05 then l_linenumber else 0 end)::bigint as captions_kept from orders join lineitem on o_orderkey = l_orderkey group by all)"


def _runs(spark, sf_dir):
    o, li = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "lineitem")
    error = F.when(F.col("o_orderpriority") == "1-URGENT", "decode_failed").when(F.col("o_totalprice") < 20000, "open_failed").otherwise("")
    per = li.groupBy("l_orderkey").agg(F.count("*").alias("frames"), F.sum((F.col("l_returnflag") == "N").cast("long")).alias("kept"), F.sum("l_linenumber").alias("captions"), F.sum(F.when(F.col("l_discount") < 0.05, F.col("l_linenumber")).otherwise(0)).alias("captions_kept"))
    return o.select(F.col("o_orderkey").alias("video_id"), error.alias("error")).join(per, F.col("video_id") == F.col("l_orderkey")).drop("l_orderkey")


@query(f"with {_RUNS_SQL} select count(*) as videos, sum((error='')::bigint)::bigint as ok, sum(frames) filter (error='')::bigint as frames, sum(kept) filter (error='')::bigint as frames_kept, sum(captions) filter (error='')::bigint as captions, sum(captions_kept) filter (error='')::bigint as captions_kept, round(sum(kept) filter (error='')::double/sum(frames) filter (error=''),6) as frame_ratio, round(sum(captions_kept) filter (error='')::double/sum(captions) filter (error=''),6) as caption_ratio from videos")
def funnel(spark, sf_dir):
    return C.funnel(_runs(spark, sf_dir)).select("videos", "ok", "frames", "frames_kept", "captions", "captions_kept", *r6("frame_ratio", "caption_ratio"))


@query(f"with {_RUNS_SQL} select error, count(*) as n from videos where error <> '' group by error")
def failures(spark, sf_dir):
    return C.failures(_runs(spark, sf_dir))


@query("with d as (select o_orderkey, case when o_orderstatus = 'F' then '' else 'x' end as error from orders where o_orderkey % 3 = 0) select o_orderkey as video_id from orders where o_orderkey not in (select o_orderkey from d where error = '')")
def resumed(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), "o_orderstatus")
    done = o.where("video_id % 3 = 0").withColumn("error", F.when(F.col("o_orderstatus") == "F", "").otherwise("x"))
    return C.remaining(o, done).select("video_id")
