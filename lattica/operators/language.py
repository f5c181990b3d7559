"""Queries in words against labelled objects: lexical and embedding scores, their fusion, and answers by rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import geometry as G
from lattica.functions import kernels as K
from lattica.functions import text as T
from lattica.functions import vector as X
from lattica.plans.rewrites import prefix_sums

#: Names that users give to concepts.
ALIASES = {
    "cup": ["杯子", "水杯", "茶杯", "马克杯", "mug", "glass", "tumbler", "咖啡杯"],
    "bottle": ["瓶子", "水瓶", "饮料瓶", "保温杯", "water bottle", "flask"],
    "table": ["桌子", "餐桌", "桌面", "桌", "desk", "dining table", "countertop", "台面"],
    "desk": ["书桌", "办公桌", "写字台", "工作台", "桌子", "桌", "desk table"],
    "chair": ["椅子", "凳子", "座椅", "seat", "stool", "armchair"],
    "sofa": ["沙发", "couch", "settee"],
    "bed": ["床", "床铺", "cot"],
    "door": ["门", "房门", "门口", "doorway", "gate"],
    "window": ["窗户", "窗", "玻璃窗", "windshield"],
    "wall": ["墙", "墙壁", "墙面"],
    "floor": ["地面", "地板", "地上"],
    "ceiling": ["天花板", "顶棚"],
    "monitor": ["显示器", "屏幕", "显示屏", "电脑屏幕", "screen", "display", "tv", "电视"],
    "laptop": ["笔记本电脑", "笔记本", "电脑", "computer", "notebook pc"],
    "keyboard": ["键盘"],
    "mouse": ["鼠标"],
    "phone": ["手机", "电话", "mobile phone", "cellphone", "smartphone"],
    "book": ["书", "书本", "书籍", "notebook", "magazine"],
    "box": ["盒子", "箱子", "纸箱", "carton", "container", "收纳箱"],
    "bag": ["包", "背包", "书包", "手提包", "backpack", "handbag", "luggage"],
    "basket": ["篮子", "筐", "篓子"],
    "trash can": ["垃圾桶", "垃圾箱", "bin", "trash", "garbage can", "rubbish bin"],
    "lamp": ["灯", "台灯", "吊灯", "light", "lighting"],
    "plant": ["植物", "盆栽", "绿植", "flower", "vase", "花瓶"],
    "picture": ["画", "照片", "相框", "painting", "photo", "frame"],
    "clock": ["钟", "时钟", "挂钟", "watch", "时钟表"],
    "refrigerator": ["冰箱", "fridge", "freezer"],
    "sink": ["水槽", "洗手池", "洗碗池", "basin", "washbasin"],
    "toilet": ["马桶", "厕所", "卫生间", "restroom", "wc"],
    "microwave": ["微波炉", "oven", "烤箱"],
    "person": ["人", "行人", "人员", "人类", "human", "people", "man", "woman", "pedestrian"],
    "cat": ["猫", "猫咪", "kitten"],
    "dog": ["狗", "狗狗", "puppy"],
    "food": ["食物", "吃的东西", "meal", "dish"],
    "towel": ["毛巾", "抹布", "cloth"],
    "shelf": ["架子", "置物架", "书架", "搁板", "bookcase", "rack"],
    "cabinet": ["柜子", "橱柜", "衣柜", "storage cabinet", "cupboard", "wardrobe"],
    "pillow": ["枕头", "cushion"],
    "curtain": ["窗帘", "帘子"],
    "sign": ["标志", "指示牌", "标识", "signage", "label"],
    "cart": ["推车", "小车", "trolley", "truck"],
    "robot": ["机器人"],
    "elevator": ["电梯", "lift"],
    "stairs": ["楼梯", "台阶", "staircase"],
}
#: Words that tell what a question asks for.
KEYWORDS = {
    "distance": ("多远", "距离", "有多远", "离得远", "how far", "distance"),
    "list_on": ("有什么", "有哪些", "有什么东西", "what is on", "what's on", "what is in", "list", "列一下"),
    "count": ("几个", "有多少", "多少个", "数量", "how many", "count"),
    "nearest": ("最近", "离我最近", "最近的", "closest", "nearest", "nearest to me"),
    "locate": ("在哪", "在哪里", "位置", "什么地方", "哪儿", "哪里", "where is", "where's", "where are", "locate", "find"),
}
#: Words that tell which relation a question asks for.
RELATION_WORDS = {
    "above": ("上面", "上方", "上边", "之上", "on top", "above", "over"),
    "below": ("下面", "下方", "下边", "之下", "under", "below", "beneath"),
    "left_of": ("左边", "左侧", "左面", "left of", "to the left"),
    "right_of": ("右边", "右侧", "右面", "right of", "to the right"),
    "in_front_of": ("前面", "前方", "前边", "in front", "ahead"),
    "behind": ("后面", "后方", "后边", "behind", "back of"),
    "inside": ("里面", "内部", "之中", "inside", "within", "in the"),
    "near": ("旁边", "附近", "边上", "旁边", "next to", "beside", "near"),
}
#: Thresholds and weights of the two scores, the boost by confidence, and the temperature of null texts.
LEXICAL, W_LEXICAL, W_EMBEDDING, FLOOR, KEEP, BOOST, TEMPERATURE = 0.5, 0.4, 0.6, 0.95, 0.92, 0.08, 0.01


#: Labels that may be broadcast.
BROADCAST_LABELS = 100_000


def alias_table(spark: SparkSession) -> DataFrame:
    """(alias, concept): every name, the concept's own among them; one name may mean several concepts."""
    rows = sorted({(a.lower(), c) for c, names in ALIASES.items() for a in (c, *names)})
    return spark.createDataFrame(rows, "alias string, concept string")


def concepts(texts: DataFrame, column: str = "text") -> DataFrame:
    """Each text with the sorted concepts whose names it holds: as a whole, as one of its words, or anywhere within it
    (names of one letter only as a word)."""
    aliases = F.broadcast(alias_table(texts.sparkSession))  # the lexicon: two hundred rows
    t = T.query_text(F.col(column))
    hit = (t == F.col("alias")) | F.array_contains(F.split(t, " "), F.col("alias")) | ((F.length("alias") >= 2) & t.contains(F.col("alias")))
    found = texts.join(aliases, hit, "left")
    return found.groupBy(*texts.columns).agg(F.array_sort(F.collect_set("concept")).alias("concepts"))


def lexical(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(query, label, lexical) for every query and label. A vocabulary of up to BROADCAST_LABELS travels to the queries; a longer
    one is met in blocks."""
    q, x = concepts(queries, "query").withColumnRenamed("concepts", "cq"), concepts(labels, "label").withColumnRenamed("concepts", "cl")
    both = q.join(F.broadcast(x), F.lit(True)) if x.count() <= BROADCAST_LABELS else blocked(x, q)
    return both.select("query", "label", T.lexical_score(F.col("query"), F.col("label"), F.arrays_overlap("cq", "cl")).alias("lexical"))


def counted(scored: DataFrame, count: str = "count") -> DataFrame:
    """Lexical scores (query, lexical, ...) that favour what was seen often: times 0.9 to 1 by the count over the query's greatest."""
    most = scored.groupBy("query").agg(F.max(count).alias("__most"))
    share = F.col(count) / F.greatest(F.col("__most"), F.lit(1))
    return scored.join(most, "query").withColumn("lexical", F.col("lexical") * (0.9 + 0.1 * share)).drop("__most")


def prompted(detections: DataFrame, prompts: DataFrame, least: float = 0.5) -> DataFrame:
    """Detections (label, ...) of a fixed vocabulary that any of the prompts (query) means."""
    fit = lexical(prompts.select("query"), detections.select("label").distinct()).where(F.col("lexical") > least)
    return detections.join(fit.select("label").distinct(), "label", "left_semi")


@dataclass(frozen=True)
class Encoder:
    """What an encoder declares: its dimensions, whether its scores are calibrated, and thresholds with and without names beside it."""

    name: str
    dim: int
    calibrated: bool = False
    hybrid: float = 0.5
    standalone: float = 0.5

    def checked(self, vectors: DataFrame, feature: str = "e") -> DataFrame:
        """vectors, if all have the encoder's dimensions."""
        bad = vectors.where(F.size(feature) != self.dim).limit(1).count()
        if bad:
            raise ValueError(f"{self.name} has {self.dim} dimensions, the vectors have not")
        return vectors


#: What encoders of these kinds declare.
ENCODERS = {"siglip": Encoder("siglip", 768, True, 0.02, 5e-4), "clip": Encoder("clip", 512, False, 0.9, 0.9), "color_hist": Encoder("color_hist", 72)}


def embedding_score(feature: Column, query: Column, nulls: list[Column], temperature: float = TEMPERATURE) -> Column:
    """The query's share against the best null text; 0 if dimensions differ."""
    best = F.greatest(*[X.cosine(feature, n) for n in nulls]) if len(nulls) > 1 else X.cosine(feature, nulls[0])
    return F.when(F.size(feature) == F.size(query), X.two_way(X.cosine(feature, query), best, temperature)).otherwise(0.0)


def with_cosines(df: DataFrame, of: dict[str, tuple[str, str]]) -> DataFrame:
    """df with the cosine of two columns of vectors for each name, by arrays, and without these columns."""
    vectors = list(dict.fromkeys(c for pair in of.values() for c in pair))
    kept = [c for c in df.columns if c not in vectors]

    def whole(c: pa.Array) -> np.ndarray | None:
        n = len(c)
        flat = c.flatten()
        if not n or c.null_count or flat.null_count or len(flat) % n or (np.diff(c.offsets.to_numpy()) != len(flat) // n).any():
            return None
        return flat.to_numpy(zero_copy_only=False).reshape(n, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: whole(b.column(c)) for c in vectors}
            found = []
            for x, y in of.values():
                fit = at[x] is not None and at[y] is not None and at[x].shape == at[y].shape
                found.append(pa.array(K.paired_cosines(at[x], at[y]) if fit else K.row_cosines(b.column(x).to_pylist(), b.column(y).to_pylist()), pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *found], [*kept, *of])

    own = df.select(*kept, *[F.col(c).cast("array<double>").alias(c) for c in vectors])
    return own.mapInArrow(run, ", ".join([*[f"{c} {df.schema[c].dataType.simpleString()}" for c in kept], *[f"{c} double" for c in of]]))


@dataclass
class TextMatcher:
    """Scores vectors against texts: encode turns a text into a vector, nulls are the vectors of texts about nothing.

    threshold is what its encoder declares for accepting a match; calibrate it with calibrated_threshold().
    """

    encode: Callable[[str], Sequence[float]]
    nulls: Sequence[Sequence[float]]
    threshold: float = 0.5
    temperature: float = TEMPERATURE

    def score(self, feature: Column, text: str) -> Column:
        vector = lambda x: F.array(*[F.lit(float(v)) for v in x])
        return embedding_score(feature, vector(self.encode(text)), [vector(n) for n in self.nulls], self.temperature)


#: The threshold that encoders of a kind declare until they are calibrated.
SUGGESTED = {"siglip": 0.02, "clip": 0.9, "color_hist": 0.5}


def suggested_threshold(encoder: str, calibrated: float | None = None) -> float:
    """The calibrated threshold if there is one, else what encoders of this kind declare, else 0.5."""
    if calibrated is not None:
        return calibrated
    return next((t for kind, t in SUGGESTED.items() if kind in encoder.lower()), 0.5)


def fused(lexical_score: Column, embedding: Column) -> Column:
    mean = (W_LEXICAL * lexical_score + W_EMBEDDING * embedding) / (W_LEXICAL + W_EMBEDDING)
    return F.greatest(mean, FLOOR * F.greatest(lexical_score, embedding))


def ranked(scored: DataFrame, k: int, t_lexical: float = LEXICAL, t_embedding: float = 0.5) -> DataFrame:
    """Objects that either score accepts, by the score that does (both: the greater), times a boost by confidence; ties by id."""
    lex, emb = F.col("lexical") >= t_lexical, F.col("embedding") >= t_embedding
    score = F.when(lex & emb, F.greatest("lexical", "embedding")).when(lex, F.col("lexical")).otherwise(F.col("embedding"))
    out = scored.where(lex | emb).withColumn("score", score * (KEEP + BOOST * F.col("conf"))).where("score > 0")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "obj_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def calibrated_threshold(scores: DataFrame) -> DataFrame:
    """The greatest positive score at which true-positive plus true-negative rate is best, over rows (score, positive)."""
    per = scores.groupBy("score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("n"))
    down = prefix_sums(per.withColumn("down", -F.col("score")), "down", ["p", "n"])
    total = per.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    c = down.join(F.broadcast(total), F.lit(True)).where("score > 0").select("score", (F.col("sum_p") / F.col("all_p")).alias("tpr"), (1 - F.col("sum_n") / F.col("all_n")).alias("tnr"))
    return c.agg(F.max_by(F.struct("score", "tpr", "tnr"), F.struct(F.round(F.col("tpr") + F.col("tnr"), 9), "score")).alias("b")).select(F.col("b.score").alias("threshold"), ((F.col("b.tpr") + F.col("b.tnr")) / 2).alias("balanced"))


def blocked(rows: DataFrame, queries: DataFrame, block: int = 256) -> DataFrame:
    """Every row with every stated query: the queries are dealt to blocks of about `block`, each row goes to each block.

    Neither side is broadcast; a task holds one block of queries at a time and any share of the rows.
    """
    blocks = max(1, -(-queries.count() // block))
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism // blocks)
    slots = F.sequence(F.lit(0), F.lit(blocks - 1))
    r = rows.withColumn("__block", F.explode(slots)).withColumn("__part", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if c in ("obj_id", "label")]), F.lit(parts)))
    q = queries.withColumn("__block", F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)).cast("int")).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return r.join(q, ["__block", "__part"]).drop("__block", "__part")


#: Rows and queries of a block that a task scores at a time.
ROWS, ASKED = 4096, 256


def _whole(e: Column, size: int) -> Column:
    return F.coalesce((F.size(e) == size) & ~F.exists(e, lambda x: x.isNull()), F.lit(False))


def scored(rows: DataFrame, queries: DataFrame, nulls: DataFrame, temperature: float = TEMPERATURE, scale: float = 10.0, bias: float = -5.0) -> DataFrame:
    """(q_id, obj_id, cosine, score, logistic), of six digits, for every row (obj_id, e) and query (q_id, qe).

    nulls (n0, n1) are the vectors of texts about nothing. Blocks of rows meet blocks of queries, and each meeting is one step
    over arrays. Vectors and ids that are null, and vectors with
    null components or another size than the rest, go by column expressions.
    """
    best = F.greatest(X.cosine(F.col("e"), F.col("n0")), X.cosine(F.col("e"), F.col("n1")))
    o = rows.select("obj_id", "e").join(F.broadcast(nulls), F.lit(True)).select("obj_id", "e", best.alias("cn"))
    q = queries.select("q_id", "qe")
    size = q.agg(F.max(F.size("qe"))).first()[0]
    size = -1 if size is None else size
    n, m = rows.count(), q.count()
    fit_o, fit_q = _whole(F.col("e"), size) & F.col("cn").isNotNull() & F.col("obj_id").isNotNull(), _whole(F.col("qe"), size) & F.col("q_id").isNotNull()
    parts, blocks = max(1, -(-n // ROWS)), max(1, -(-m // ASKED))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        vectors = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        if not len(a) or not len(b):
            return pa.table({"q_id": pa.array([], pa.int64()), "obj_id": pa.array([], pa.int64())} | {c: pa.array([], pa.float64()) for c in ("cosine", "score", "logistic")})
        cos, cn = K.cosines(vectors(a, "e"), vectors(b, "qe")).ravel(), np.repeat(a["cn"].to_numpy(), len(b))
        with np.errstate(over="ignore"):
            score, curve = 1.0 / (1.0 + np.exp((cn - cos) / temperature)), 1.0 / (1.0 + np.exp(-(cos * scale + bias)))
        q_id, obj = np.tile(b["q_id"].to_numpy(), len(a)), np.repeat(a["obj_id"].to_numpy(), len(b))
        return pa.table({"q_id": q_id, "obj_id": obj, "cosine": K.rounded(cos), "score": K.rounded(score), "logistic": K.rounded(curve)})

    x = o.where(fit_o).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("obj_id"), F.lit(parts)).cast("int").alias("p"), F.col("obj_id").cast("long").alias("obj_id"), "e", "cn")
    y = q.where(fit_q).select(F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), F.col("q_id").cast("long").alias("q_id"), "qe")
    out = x.groupBy("b", "p").cogroup(y.groupBy("b", "p")).applyInArrow(run, "q_id long, obj_id long, cosine double, score double, logistic double")
    odd_o, odd_q = o.where(~fit_o), q.where(~fit_q)
    if odd_o.isEmpty() and odd_q.isEmpty():
        return out
    by_columns = blocked(odd_o, q).unionByName(blocked(o.where(fit_o), odd_q))
    c = X.cosine(F.col("e"), F.col("qe"))
    score = F.when(F.size("e") == F.size("qe"), X.two_way(c, F.col("cn"), temperature)).otherwise(0.0)
    return out.unionByName(by_columns.select("q_id", "obj_id", F.round(c, 6).alias("cosine"), F.round(score, 6).alias("score"), F.round(X.logistic(c, scale, bias), 6).alias("logistic")))


# ---------------------------------------------------------------------------------------------------- questions


@dataclass
class Intent:
    kind: str
    relation: str | None
    subject: str | None
    other: str | None


def mentions(question: str, labels: list[str]) -> list[str]:
    """Names in a question, longest first and without overlap, in the order in which they stand, each once."""
    low = question.lower()
    names = sorted({a.lower() for c, x in ALIASES.items() for a in (c, *x)} | {x.lower() for x in labels}, key=lambda x: (-len(x), x))
    taken, found = [False] * len(low), []
    for name in names:
        at = low.find(name) if len(name) > 1 or ord(name[0]) > 127 else -1
        while at >= 0:
            if not any(taken[at : at + len(name)]):
                taken[at : at + len(name)] = [True] * len(name)
                found.append((at, name))
            at = low.find(name, at + 1)
    return list(dict.fromkeys(n for _, n in sorted(found)))


def parse_question(question: str | None, labels: list[str]) -> Intent:
    """What is asked: distance, list_on, count, nearest, relation, locate or describe, in this order of precedence."""
    low = (question or "").lower()
    own = mentions(question or "", labels)
    has = {k: any(w in low for w in words) for k, words in KEYWORDS.items()}
    rel = next((r for r, words in RELATION_WORDS.items() if any(w in low for w in words)), None)
    known = {x.lower() for x in labels}
    match = [x for m in own for x in ([m] if m in known else sorted(c for c, a in ALIASES.items() if m in (c, *[y.lower() for y in a]) and c in known))]
    kinds = (("distance", has["distance"] and len(own) >= 2), ("list_on", has["list_on"] and own), ("count", has["count"] and own), ("nearest", has["nearest"]), ("relation", rel and own), ("locate", own or has["locate"]))
    kind = next((k for k, yes in kinds if yes), "describe")
    names = list(dict.fromkeys(match)) or own
    return Intent(kind, rel, names[0] if names else None, names[1] if len(names) > 1 else None)


def intents(questions: DataFrame, labels: list[str], column: str = "question") -> DataFrame:
    def parsed(q: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vars(parse_question(x, labels)) for x in q], columns=["kind", "relation", "subject", "other"])

    udf = F.pandas_udf(parsed, "struct<kind:string,relation:string,subject:string,other:string>")
    return questions.withColumn("i", udf(F.col(column))).select(*questions.columns, "i.*")


def best_of(objects: DataFrame, label: str) -> DataFrame:
    """The most confident object of a label, ties by id."""
    return objects.where(F.lower("label") == label.lower()).orderBy(F.desc("conf"), "obj_id").limit(1)


def answer_distance(objects: DataFrame, first: str, second: str) -> DataFrame:
    a, b = best_of(objects, first).alias("a"), best_of(objects, second).alias("b")
    return a.join(b, F.lit(True)).select(F.col("a.obj_id").alias("a_id"), F.col("b.obj_id").alias("b_id"), G.center_distance().alias("distance"), G.bbox_gap().alias("gap"), G.relation().alias("relation"))


def answer_on(objects: DataFrame, anchor: str, margin: float = 0.05, reach: float = 0.6) -> DataFrame:
    """Objects whose centre is in the anchor's box and margin; if there are none, those within reach of its centre."""
    a = best_of(objects, anchor).select(F.struct("obj_id", "cx", "cy", "cz", "x0", "x1", "y0", "y1", "z0", "z1").alias("a"))
    both = objects.join(a, F.col("obj_id") != F.col("a.obj_id")).withColumn("distance", G.length([F.col(f"c{k}") - F.col(f"a.c{k}") for k in G.AXES]))
    both = both.withColumn("inside", G.contains_point("a", F.col("cx"), F.col("cy"), F.col("cz"), margin))
    any_in = F.max("inside").over(Window.partitionBy("a.obj_id"))
    return both.where(F.col("inside") | (F.col("distance") <= reach)).withColumn("__any", any_in).where(F.col("inside") | ~F.col("__any")).select("obj_id", "label", "distance")


def answer_describe(objects: DataFrame) -> DataFrame:
    return objects.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def to_english(queries: DataFrame, column: str = "query") -> DataFrame:
    """queries with english: the shortest concept (then the first by name) of a text in Chinese or of one or two words, else the text."""
    c = concepts(queries, column)
    short = F.array_min(F.transform("concepts", lambda x: F.struct(F.length(x).alias("n"), x.alias("c"))))["c"]
    brief = F.col(column).rlike(r"[一-鿿]") | (F.size(F.split(T.query_text(F.col(column)), " ")) <= 2)
    return c.withColumn("english", F.when(brief & (F.size("concepts") > 0), short).otherwise(F.col(column))).drop("concepts")


def ensemble(vectors: DataFrame, by: str = "query", feature: str = "e") -> DataFrame:
    """One unit vector for each query: the mean of the unit vectors of its phrasings."""
    parts = vectors.select(by, F.posexplode(X.unit(F.col(feature))).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select(by, X.unit(F.transform("p", lambda s: s["x"])).alias(feature))


def region_views(boxes: DataFrame, width: int, height: int, scales: tuple[float, ...] = (1.0, 1.2, 1.5)) -> DataFrame:
    """Square crops around boxes (x1, y1, x2, y2) at several scales, clipped to the image: one row for each view."""
    view = F.explode(F.array(*[F.lit(s) for s in scales])).alias("scale")
    b = boxes.select("*", view)
    half = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * F.col("scale") / 2
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    clip = lambda x, hi: F.greatest(F.least(x, F.lit(float(hi))), F.lit(0.0))
    return b.withColumn("vx1", clip(mx - half, width)).withColumn("vy1", clip(my - half, height)).withColumn("vx2", clip(mx + half, width)).withColumn("vy2", clip(my + half, height))


def grounded(targets: DataFrame, objects: DataFrame) -> DataFrame:
    """Targets (label) that a model named and the map has: others are taken for invented."""
    return targets.join(objects.select(F.lower("label").alias("__l")).distinct(), F.lower("label") == F.col("__l"), "left_semi")


def hybrid_answer(rule: dict | None, model: dict | None, known: set[str]) -> dict:
    """One answer of a rule engine's and a model's: targets that the map lacks are dropped, the rule's distances stand, the model's
    words stand where it named something that is there, and the rule answers where the model is silent or invents all it names."""
    names = {x.lower() for x in known}
    targets = [t for t in (model or {}).get("targets", []) if str(t).lower() in names]
    invented = [t for t in (model or {}).get("targets", []) if str(t).lower() not in names]
    use_model = bool(model and model.get("answer")) and (bool(targets) or not invented)
    base = model if use_model else rule or {"answer": "", "confidence": 0.0}
    return {"answer": base.get("answer", ""), "targets": targets if use_model else (rule or {}).get("targets", []), "distances": {**(model or {}).get("distances", {}), **(rule or {}).get("distances", {})}, "confidence": base.get("confidence", 0.0), "invented": invented, "by": "model" if use_model else "rule"}
