"""Queries in words, and answers to questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.functions import vector as X
from lattica.operators import language as L
from lattica.operators import spatial as S
from lattica.operators import voxels as V
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

#: What the ten labels of the objects are called.
NAMES = ("cup", "bottle", "table", "desk", "chair", "sofa", "monitor", "book", "lamp", "plant")
ASKED = ("mug", "a water bottle on it", "书桌", "couch", "tabel", "notebook", "flower vase", "airplane")
_NAME_SQL = "(values " + ", ".join(f"('class{i}', '{n}')" for i, n in enumerate(NAMES)) + ")"
_ALIAS_SQL = "(values " + ", ".join("('{}', '{}')".format(a.replace("'", "''"), c) for a, c in sorted({(a.lower(), c) for c, names in L.ALIASES.items() for a in (c, *names)})) + ")"
_NAMED = f"{views.OBJECTS}, names(label, name) as {_NAME_SQL}, named as (select objects.* exclude (label), name as label from objects join names using (label))"
_ALIAS = f"aliases(alias, concept) as {_ALIAS_SQL}"
_BIGRAM = "case when length({s}) = 0 then [] else list_distinct(list_transform(range(1, greatest(length({s})-1, 1)+1), lambda i: substr({s}, i, 2))) end"


def _bigrams(x: str) -> str:
    return _BIGRAM.format(s=f"replace({x}, ' ', '')")


_CONCEPTS = "select t, list_sort(list(distinct concept) filter (concept is not null)) as c from {src} left join aliases on t = alias or list_contains(string_split(t, ' '), alias) or (length(alias) >= 2 and contains(t, alias)) group by t"
_LEXICAL = f"""{_ALIAS}, q(query) as (values {", ".join(f"('{x}')" for x in ASKED)}), l(label) as (values {", ".join(f"('{x}')" for x in NAMES)}),
    qc as ({_CONCEPTS.format(src="(select query as t from q)")}), lc as ({_CONCEPTS.format(src="(select label as t from l)")}),
    lex as (select qc.t as query, lc.t as label, case when list_has_any(coalesce(qc.c, []), coalesce(lc.c, [])) then 1.0::double when contains(qc.t, lc.t) or contains(lc.t, qc.t) then 0.85
        else least(0.8, 1.6 * coalesce(len(list_intersect({_bigrams("qc.t")}, {_bigrams("lc.t")}))::double / nullif(len(list_distinct(list_concat({_bigrams("qc.t")}, {_bigrams("lc.t")}))), 0), 0)) end as lexical from qc, lc)"""


def named_objects(spark, sf_dir):
    label = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.substring("label", 6, 2).cast("int") + 1)
    return views.objects(spark, sf_dir).withColumn("label", label)


def _asked(spark):
    return spark.createDataFrame([(x,) for x in ASKED], "query string")


def _labels(spark):
    return spark.createDataFrame([(x,) for x in NAMES], "label string")


@query(f"with {_ALIAS}, q(query) as (values {', '.join(f'({chr(39)}{x}{chr(39)})' for x in ASKED)}), c as ({_CONCEPTS.format(src='(select query as t from q)')}) select t as query, coalesce(array_to_string(c, ','), '') as concepts from c")
def query_concepts(spark, sf_dir):
    return L.concepts(_asked(spark), "query").select("query", F.array_join("concepts", ",").alias("concepts"))


@query(f"with {_LEXICAL} select query, label, round(lexical,6) as lexical from lex")
def lexical_scores(spark, sf_dir):
    return L.lexical(_asked(spark), _labels(spark)).select("query", "label", *r6("lexical"))


_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]*p[2]))"
_COS = lambda a, b: f"({_DOT(a, b)} / greatest(sqrt({_DOT(a, a)})*sqrt({_DOT(b, b)}), 1e-12))"
_PROBES = f"pr as (select obj_id as q_id, e as qe from objects where obj_id % 50 = 0), nu as (select (select e from objects where obj_id = 100) as n1, (select e from objects where obj_id = 101) as n2)"
_EMB = f"{_PROBES}, es as (select q_id, obj_id, {_COS('e', 'qe')} as cq, greatest({_COS('e', 'n1')}, {_COS('e', 'n2')}) as cn from objects, pr, nu)"


def _asking(spark, sf_dir):
    """The stated queries of a search, every fiftieth object, and the two objects that stand for the null texts."""
    o = views.objects(spark, sf_dir)
    nulls = [o.where(f"obj_id = {i}").select(F.col("e").alias(n)) for i, n in ((100, "n0"), (101, "n1"))]
    return o.where("obj_id % 50 = 0").select(F.col("obj_id").alias("q_id"), F.col("e").alias("qe")), nulls[0].join(nulls[1], F.lit(True))


@query(f"with {views.OBJECTS}, {_EMB} select q_id, obj_id, round(cq,6) as cosine, round(1/(1+exp((cn-cq)/0.05)),6) as score, round(1/(1+exp(-(10*cq-5))),6) as logistic from es")
def embedding_scores(spark, sf_dir):
    return L.scored(views.objects(spark, sf_dir), *_asking(spark, sf_dir), 0.05)


_HYBRID = f"""with {_NAMED}, {_LEXICAL}, {_PROBES}, ask(query, q_id) as (values ('mug', 50), ('couch', 100), ('书桌', 150)),
    sc as (select query, named.obj_id, named.label, conf, lexical, 1/(1+exp((greatest({_COS('e', 'n1')},{_COS('e', 'n2')})-{_COS('e', 'qe')})/0.05)) as emb from named join lex using (label) join ask using (query) join pr using (q_id), nu),
    rk as (select *, case when lexical >= 0.5 and emb >= 0.9 then greatest(lexical, emb) when lexical >= 0.5 then lexical else emb end * (0.92+0.08*conf) as score, greatest((0.4*lexical+0.6*emb)/(0.4+0.6), 0.95*greatest(lexical, emb)) as fused from sc where lexical >= 0.5 or emb >= 0.9)
    select query, obj_id, label, round(score,6) as score, round(fused,6) as fused, rn as rank from (select *, row_number() over (partition by query order by score desc, obj_id) as rn from rk where score > 0) where rn <= 5"""


def _scored(spark, sf_dir):
    ask = spark.createDataFrame([("mug", 50), ("couch", 100), ("书桌", 150)], "query string, q_id long")
    lex = L.lexical(_asked(spark), _labels(spark)).join(ask, "query")
    probe, nulls = _asking(spark, sf_dir)
    # Only the three that are asked for are scored, against all objects.
    probe = probe.join(F.broadcast(ask.select("q_id")), "q_id", "left_semi").join(F.broadcast(nulls), F.lit(True))
    both = L.blocked(named_objects(spark, sf_dir).select("obj_id", "label", "conf", "e"), probe).withColumn("fits", F.size("e") == F.size("qe"))
    both = L.with_cosines(both, {"c": ("e", "qe"), "c0": ("e", "n0"), "c1": ("e", "n1")})
    embedding = F.when(F.col("fits"), X.two_way(F.col("c"), F.greatest("c0", "c1"), 0.05)).otherwise(0.0)
    return both.withColumn("embedding", embedding).drop("fits", "c", "c0", "c1").join(F.broadcast(lex), ["q_id", "label"])


@query(_HYBRID)
def query_objects(spark, sf_dir):
    r = L.ranked(_scored(spark, sf_dir), 5, t_embedding=0.9)
    return r.select("query", "obj_id", "label", *r6("score"), F.round(L.fused(F.col("lexical"), F.col("embedding")), 6).alias("fused"), F.col("rank").cast("long").alias("rank"))


@query(f"with {views.POINTS}, k as (select distinct floor(x/0.5)::bigint as kx, floor(y/0.5)::bigint as ky, floor(z/0.5)::bigint as kz, label from points), hit as (select distinct kx, ky, kz from k where label = 'class3') select label, count(*) as n from k where (kx, ky, kz) not in (select (kx, ky, kz) from hit) group by label")
def uncovered_voxels(spark, sf_dir):
    v = V.keyed(views.points(spark, sf_dir), 0.5).select(*V.KEY, "label").distinct()
    covered = v.where("label = 'class3'").select(*V.KEY)
    return v.join(covered, list(V.KEY), "left_anti").groupBy("label").agg(F.count("*").alias("n"))


_CAL = f"""{views.OBJECTS}, u as (select label, e, sqrt({_DOT('e', 'e')}) as n from objects), d as (select label, i, avg(e[i+1]/n) as x from u, range(64) t(i) group by label, i), pr as (select label as ql, list(x order by i) as qe from d group by label),
    sc as (select round({_COS('e', 'qe')}, 6) as score, label = ql as positive from objects, pr),
    g as (select score, sum(positive::int)::double as p, sum((not positive)::int)::double as n from sc group by score), c as (select score, sum(p) over (order by score desc) / sum(p) over () as tpr, 1 - sum(n) over (order by score desc) / sum(n) over () as tnr from g)"""


@query(f"with {_CAL} select score as threshold, round((tpr+tnr)/2, 6) as balanced from c where score > 0 order by round(tpr+tnr, 9) desc, score desc limit 1")
def calibrated_threshold(spark, sf_dir):
    o = views.objects(spark, sf_dir)
    probes = L.ensemble(o, "label").select(F.col("label").alias("ql"), F.col("e").alias("qe"))
    s = L.blocked(o, probes)
    return L.calibrated_threshold(s.select(F.round(X.cosine(F.col("e"), F.col("qe")), 6).alias("score"), (F.col("label") == F.col("ql")).alias("positive"))).select("threshold", *r6("balanced"))


@query(f"with {_LEXICAL}, b as (select query, arg_max(label, row(lexical, -ascii(label), label)) as label, max(lexical) as s from lex group by query) select query, case when s >= 0.5 then label end as label, round(s,6) as score from b")
def canonical_labels(spark, sf_dir):
    lex = L.lexical(_asked(spark), _labels(spark))
    best = lex.groupBy("query").agg(F.max_by("label", F.struct("lexical", -F.ascii("label"), "label")).alias("label"), F.max("lexical").alias("s"))
    return best.select("query", F.when(F.col("s") >= L.LEXICAL, F.col("label")).alias("label"), F.round("s", 6).alias("score"))


QUESTIONS = ("how far is the cup from the couch", "what is on the table", "how many chairs are there", "which lamp is nearest to me", "is the book above the desk", "where is the plant", "where is the airplane", "describe the room", "桌子在哪里")


@query()
def question_intents(spark, sf_dir):
    return L.intents(spark.createDataFrame([(q,) for q in QUESTIONS], "question string"), list(NAMES))


_BEST = lambda label, t: f"{t} as (select * from named where label = '{label}' order by conf desc, obj_id limit 1)"


def _spatial():
    from lattica.queries import spatial

    return spatial


@query(f"with {_NAMED}, {_BEST('cup', 'a')}, {_BEST('sofa', 'b')} select a.obj_id as a_id, b.obj_id as b_id, round(sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz)),6) as distance from a, b")
def answer_distance(spark, sf_dir):
    return L.answer_distance(named_objects(spark, sf_dir), "cup", "sofa").select("a_id", "b_id", *r6("distance"))


@query(f"""with {_NAMED}, {_BEST('table', 'a')}, c as (select o.obj_id, o.label, sqrt((o.cx-a.cx)*(o.cx-a.cx)+(o.cy-a.cy)*(o.cy-a.cy)+(o.cz-a.cz)*(o.cz-a.cz)) as distance, o.cx between a.x0-0.05 and a.x1+0.05 and o.cy between a.y0-0.05 and a.y1+0.05 and o.cz between a.z0-0.05 and a.z1+0.05 as inside from named o, a where o.obj_id <> a.obj_id)
    select obj_id, label, round(distance,6) as distance from c where inside or (distance <= 0.6 and not (select bool_or(inside) from c))""")
def answer_on(spark, sf_dir):
    return L.answer_on(named_objects(spark, sf_dir), "table").select("obj_id", "label", *r6("distance"))


@query(f"with {_NAMED} select label, count(*) as n from named group by label")
def answer_describe(spark, sf_dir):
    return L.answer_describe(named_objects(spark, sf_dir))


@query(f"with {_NAMED} select count(*) as n from named where label = 'chair'")
def answer_count(spark, sf_dir):
    return named_objects(spark, sf_dir).where("label = 'chair'").agg(F.count("*").alias("n"))


@query(f"with {_NAMED} select obj_id, round(sqrt(cx*cx+cy*cy+cz*cz),6) as distance from named where label = 'lamp' order by sqrt(cx*cx+cy*cy+cz*cz), obj_id limit 5")
def answer_nearest(spark, sf_dir):
    return S.near(named_objects(spark, sf_dir).where("label = 'lamp'"), (0.0, 0.0, 0.0), k=5).select("obj_id", *r6("distance"))


@query(f"with {_NAMED} select obj_id, round(sqrt(cx*cx+cy*cy+cz*cz),6) as distance, round(conf,6) as conf from named where label = 'plant' order by named.conf desc, obj_id limit 1")
def answer_locate(spark, sf_dir):
    return L.best_of(named_objects(spark, sf_dir), "plant").select("obj_id", F.round(S.distance_to(0.0, 0.0, 0.0), 6).alias("distance"), *r6("conf"))


@query(f"select conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as q, len({_bigrams(chr(39) + 'x' + chr(39))})::int as one from conversations")
def normalized_questions(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.query_text(F.col("text")).alias("q"), F.size(T.bigrams(F.lit("x"))).alias("one"))
