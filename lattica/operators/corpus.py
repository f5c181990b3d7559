"""Caption corpora: cleaning, duplicates, statistics, mixtures, shards and run reports."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.functions import vector as X
from lattica.plans.rewrites import greedy_survivors, kept_apart

#: Least overlap of near duplicates, videos of a template, mixture exponent, caps.
NEAR, TEMPLATE, ALPHA, CAP, REUSE, SHARD = 0.80, 3, 0.5, 0.25, 3, 2000
#: Hash functions and bands: two sets with an overlap of 0.8 share a band but for odds of (1 - 0.8**4)**32, less than 1 in 10**7.
PERMUTATIONS, BANDS = 128, 32
#: Cosines below this count as badly aligned.
LOW_ALIGNMENT = 0.2


def cleaned(captions: DataFrame, full: bool = True, most: int | None = T.MAX_WORDS) -> DataFrame:
    """captions with cleaned, tokens and drop_reason ("" if kept); full also decodes references and compatibility characters.

    most: words that a caption may have, None for any number. Each is computed once for a row: a filter on the result would
    otherwise be pushed below and have the expressions evaluated again, which explode() of one element prevents.
    """
    t = T.normalized_caption(F.col("text")) if full else T.plain_caption(F.col("text"))
    out = captions.select("*", F.explode(F.array(F.coalesce(t, F.lit("")))).alias("cleaned"))
    judged = F.struct(T.word_count(F.col("cleaned")).cast("long").alias("tokens"), T.caption_reason(F.col("cleaned"), most).alias("drop_reason"))
    return out.select("*", F.explode(F.array(judged)).alias("__j")).select(*captions.columns, "cleaned", "__j.tokens", "__j.drop_reason")


def _first(kept: DataFrame, key: Column, flag: str, per_video: bool) -> DataFrame:
    """(ord, flag): whether an earlier caption has the same key. Digests are kept apart, counted where they are and joined back, so
    that texts do not travel, and a key that many captions have is no one task's."""
    keys = ["k", *(["video_id"] if per_video else [])]
    slim = kept_apart(kept)(kept.select("ord", "video_id", F.sha2(key.cast("binary"), 256).alias("k")))
    first = slim.groupBy(*keys).agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys]
    return slim.alias("s").join(first.alias("f"), same, "left").select("s.ord", F.coalesce(F.col("s.ord") > F.col("f.first"), F.lit(False)).alias(flag))


def exact_duplicates(kept: DataFrame, per_video: bool = False) -> DataFrame:
    """(ord, exact): an earlier caption has the same text, case aside; of the same video if per_video."""
    return _first(kept, F.lower("cleaned"), "exact", per_video)


def wordset_duplicates(kept: DataFrame, per_video: bool = False) -> DataFrame:
    """(ord, wordset): an earlier caption has the same set of words."""
    return _first(kept, T.word_set(F.col("cleaned")), "wordset", per_video)


def templates(kept: DataFrame, videos: int = TEMPLATE) -> DataFrame:
    """Texts (by a digest and one of them) that stand in at least so many videos; to be found before duplicates are dropped."""
    slim = kept.select(F.sha2(F.lower("cleaned").cast("binary"), 256).alias("k"), "video_id", "ord", F.lower("cleaned").alias("text"))
    per = slim.groupBy("k", "video_id").agg(F.count("*").alias("n"), F.min_by("text", "ord").alias("text"), F.min("ord").alias("ord"))
    return per.groupBy("k").agg(F.min_by("text", "ord").alias("text"), F.count("video_id").alias("videos"), F.sum("n").alias("copies")).where(F.col("videos") >= videos).select("text", "videos", "copies")


def minhash_bands(sets: DataFrame, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """(ord, band) for each band of the MinHash signature of each word set (ord, ws): one aggregate over the exploded words,
    with partial minima before the shuffle."""
    h = sets.select("ord", F.explode("ws").alias("w")).select("ord", F.xxhash64("w").alias("h"))
    sig = h.groupBy("ord").agg(*[F.min(F.xxhash64("h", F.lit(p))).alias(f"m{p}") for p in range(permutations)])
    rows = permutations // bands
    keys = [F.xxhash64(*[f"m{b * rows + i}" for i in range(rows)], F.lit(b)) for b in range(bands)]
    return sig.select("ord", F.explode(F.array(*keys)).alias("band"))


def near_duplicates(kept: DataFrame, least: float = NEAR) -> DataFrame:
    """Orders of the captions that stay: taken by order, each kept one drops later ones whose word sets overlap enough.

    Captions with one word set are one member of a bucket; the least of them speaks for them. Candidates share a band of the
    signature, and buckets meet their members pair by pair within a split of the bucket by length.
    """
    d = kept.select("ord", F.array_sort(F.array_distinct(T.words(F.lower("cleaned")))).alias("ws"))
    sets = d.groupBy(F.array_join("ws", " ").alias("key")).agg(F.min("ord").alias("ord"), F.first("ws").alias("ws"))
    sets = sets.where(F.size("ws") > 0).withColumn("n", F.size("ws"))
    keep = kept_apart(sets)
    sets = keep(sets)
    b = keep(minhash_bands(sets).join(sets.select("ord", "n"), "ord"))
    x, y = b.alias("x"), b.alias("y")
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.ord") < F.col("y.ord")) & (F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n")))
    # Word sets travel once for a pair, not once for a band.
    pairs = pairs.select(F.col("x.ord").alias("lo"), F.col("y.ord").alias("hi")).distinct()
    pairs = pairs.join(sets.select(F.col("ord").alias("lo"), F.col("ws").alias("__x")), "lo").join(sets.select(F.col("ord").alias("hi"), F.col("ws").alias("__y")), "hi")
    pairs = pairs.where(T.jaccard(F.col("__x"), F.col("__y"), 1.0) >= least).select("lo", "hi")
    return greedy_survivors(sets.select(F.col("ord").alias("id")), pairs).select(F.col("id").alias("ord"))


def caption_stats(kept: DataFrame) -> DataFrame:
    """One row of figures, from one pass: words, videos and lengths are counted together, and the counts summed up."""
    part = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    words = F.transform(T.letters(F.lower("cleaned")), lambda w: part("word", w))
    parts = F.explode(F.concat(F.array(part("tokens", F.col("tokens").cast("string")), part("video", F.col("video_id").cast("string"))), words)).alias("p")
    c = kept.select(parts).groupBy("p.kind", "p.key").agg(F.count("*").alias("n"))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    n, tokens = F.col("n"), F.when(F.col("kind") == "tokens", F.col("key")).cast("long")
    p = F.call_function("percentile", tokens, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), n)
    out = c.agg(
        F.coalesce(F.sum(of("tokens", n)), F.lit(0)).alias("captions"), F.sum(tokens * n).alias("tokens"), p.alias("p"), F.coalesce(F.sum(of("word", n)), F.lit(0)).alias("words"), F.count(of("word", n)).alias("vocabulary"),
        F.min(of("video", n)).alias("least"), F.avg(of("video", n)).alias("mean"), F.max(of("video", n)).alias("most"),
    )
    return out.select("captions", "tokens", *[F.get("p", F.lit(i)).alias(x) for i, x in enumerate(("p10", "p50", "p90"))], "words", "vocabulary", "least", "mean", "most", (F.col("vocabulary") / F.greatest("words", F.lit(1))).alias("ttr"))


def top_words(kept: DataFrame, k: int = 15) -> DataFrame:
    w = kept.select(F.explode(T.letters(F.lower("cleaned"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def alignment(spark: SparkSession, pairs: DataFrame | None = None) -> DataFrame:
    """Summary of the cosines of caption and frame vectors (a, b), or one row that says that there was no encoder for them."""
    if pairs is None:
        return spark.sql("select false as performed, bigint(0) as n, cast(null as double) as mean, cast(null as double) as median, cast(null as double) as low")
    c = pairs.select(X.cosine(F.col("a"), F.col("b")).alias("s"))
    return c.agg(F.lit(True).alias("performed"), F.count("*").alias("n"), F.avg("s").alias("mean"), F.percentile("s", 0.5).alias("median"), F.avg((F.col("s") < LOW_ALIGNMENT).cast("double")).alias("low"))


# ---------------------------------------------------------------------------------------------------- mixtures


def mixture_ratios(counts: Mapping[str, int], alpha: float = ALPHA, cap: float = CAP) -> dict[str, float]:
    """Shares of groups by count to the power alpha, none above cap as far as there are groups enough.

    The groups with the greatest weights are at the cap: as many of them as leave the others a fair share below it.
    """
    weight = {g: float(n) ** alpha if n > 0 else 0.0 for g, n in counts.items()}
    order = sorted((g for g in weight if weight[g] > 0), key=lambda g: (-weight[g], g))
    if not order:
        return dict.fromkeys(weight, 0.0) if weight else {}
    if cap * len(order) <= 1.0:
        return {g: 1.0 / len(order) if weight[g] else 0.0 for g in weight}
    rest, capped = sum(weight[g] for g in order), 0
    while capped < len(order) and (1.0 - cap * capped) * weight[order[capped]] / rest > cap:
        rest -= weight[order[capped]]
        capped += 1
    top = set(order[:capped])
    return {g: cap if g in top else (1.0 - cap * capped) * weight[g] / rest for g in weight}


def mixture_quota(counts: Mapping[str, int], budget: int, alpha: float = ALPHA, cap: float = CAP, reuse: float = REUSE) -> dict[str, int]:
    """Samples to take from each group: its share of the budget, no more than reuse times its samples; what a group cannot give
    goes to the others while they can."""
    ratio = mixture_ratios(counts, alpha, cap)
    most = {g: math.floor(n * reuse) for g, n in counts.items()}
    take = {g: min(round(r * budget), most[g]) for g, r in ratio.items()}
    for _ in range(50):
        short = budget - sum(take.values())
        if short == 0:
            break
        order = sorted(take, key=lambda g: (-ratio[g], g))
        able = [g for g in order if (take[g] < most[g] if short > 0 else take[g] > 0)]
        if not able:
            break
        step = max(1, abs(short) // len(able))
        for g in able:
            if short == 0:
                break
            move = min(step, abs(short), most[g] - take[g] if short > 0 else take[g])
            take[g] += move if short > 0 else -move
            short = budget - sum(take.values())
    return take


def mixture(samples: DataFrame, budget: int, seed: int = 0, alpha: float = ALPHA, cap: float = CAP, reuse: float = REUSE, group: str = "group", key: str = "ord") -> DataFrame:
    """samples of the mixture, each with its turn: groups give their quota by the order of a hash, and again from the start.

    Counts of groups reach the driver (few rows); samples do not. Every sample of a group is taken before any is taken twice.
    """
    counts = {r[group]: r["n"] for r in samples.groupBy(group).agg(F.count("*").alias("n")).collect()}
    quota = mixture_quota(counts, budget, alpha, cap, reuse)
    q = samples.sparkSession.createDataFrame([(g, n, counts[g]) for g, n in quota.items() if n > 0], f"{group} string, quota long, size long")
    turns = samples.join(F.broadcast(q), group).withColumn("turn", F.explode(F.sequence(F.lit(1), F.ceil(F.col("quota") / F.col("size")).cast("int"))))
    w = Window.partitionBy(group).orderBy("turn", T.stable_hash(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return turns.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= F.col("quota")).drop("__rn", "quota", "size")


def within_token_budget(samples: DataFrame, budget: int, seed: int = 0, key: str = "ord") -> DataFrame:
    """Samples in the order of a hash while their tokens fit the budget: prefix sums by blocks of the hash, so that no task holds all."""
    h = samples.withColumn("__h", T.stable_hash(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("__b", F.shiftright("__h", 50))
    per = h.groupBy("__b").agg(F.sum("tokens").alias("s"))
    base = per.select("__b", (F.sum("s").over(Window.orderBy("__b")) - F.col("s")).alias("before"))  # 1024 blocks at most
    w = Window.partitionBy("__b").orderBy("__h", key)
    return h.join(F.broadcast(base), "__b").withColumn("__run", F.col("before") + F.sum("tokens").over(w)).where(F.col("__run") <= budget).select(*samples.columns)


def token_budget(samples: DataFrame) -> DataFrame:
    return samples.agg(F.sum("tokens").alias("total"), F.avg("tokens").alias("mean"), F.percentile("tokens", 0.5).alias("median"), F.percentile("tokens", 0.95).alias("p95"), F.avg("frames_kept").alias("mean_frames"))


def sharded(samples: DataFrame, size: int = SHARD, key: str = "ord") -> DataFrame:
    """samples with shard and place: consecutive runs of `size` by key.

    Ranges of the key, as many as the shuffle has partitions and as even as its sample allows, are numbered apart and then offset.
    """
    ranged = samples.repartitionByRange(key).sortWithinPartitions(key).withColumn("__id", F.monotonically_increasing_id())
    kept = kept_apart(samples)(ranged)
    own = kept.withColumn("__b", F.shiftright("__id", 33)).withColumn("__rn", F.col("__id").bitwiseAND((1 << 33) - 1))
    per = own.groupBy("__b").agg(F.count("*").alias("n"))
    base = per.select("__b", (F.sum("n").over(Window.orderBy("__b")) - F.col("n")).alias("__before"))  # a row for each partition
    out = own.join(F.broadcast(base), "__b").withColumn("__at", F.col("__before") + F.col("__rn"))
    return out.withColumn("shard", F.floor(F.col("__at") / size)).withColumn("place", F.col("__at") % size).select(*samples.columns, "shard", "place")


def manifest(shards: DataFrame, preview: int = 0) -> DataFrame:
    """Rows, tokens and bytes (of a row as JSON with its line end) of each shard; with preview, its first rows as JSON."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in shards.columns if c not in ("shard", "place")]))
    rows = shards.select("shard", "place", "tokens", line.alias("line"))
    aggs = [F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum(F.octet_length("line") + 1).alias("bytes")]
    if preview:
        first = F.when(F.col("place") < preview, F.struct("place", "line"))
        aggs.append(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["line"]).alias("preview"))
    return rows.groupBy("shard").agg(*aggs)


def write_shards(shards: DataFrame, path: str, preview: int = 0) -> None:
    """One folder of JSON lines for each shard, and the manifest."""
    shards.repartition("shard").sortWithinPartitions("shard", "place").write.mode("overwrite").partitionBy("shard").json(f"{path}/shards")
    manifest(shards, preview).orderBy("shard").write.mode("overwrite").json(f"{path}/manifest")


# ---------------------------------------------------------------------------------------------------- runs


def remaining(videos: DataFrame, done: DataFrame) -> DataFrame:
    """Videos to process: not done yet, or done with an error."""
    return videos.join(done.where("coalesce(error, '') = ''").select("video_id").distinct(), "video_id", "left_anti")


def funnel(videos: DataFrame) -> DataFrame:
    """Sums and ratios over videos (error, frames, kept, captions, captions_kept) without an error; ratios are null without a base."""
    ok = F.col("error") == ""
    total = lambda c: F.sum(F.when(ok, F.col(c)).otherwise(0))
    return videos.agg(
        F.count("*").alias("videos"), F.sum(ok.cast("long")).alias("ok"), total("frames").alias("frames"), total("kept").alias("frames_kept"), total("captions").alias("captions"), total("captions_kept").alias("captions_kept"),
        F.try_divide(total("kept"), total("frames")).alias("frame_ratio"), F.try_divide(total("captions_kept"), total("captions")).alias("caption_ratio"),
    )


def failures(videos: DataFrame) -> DataFrame:
    return videos.where("error <> ''").groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error")


def datacard(sections: Mapping[str, Mapping[str, object]], not_done: list[str]) -> str:
    """A report in Markdown: numbered sections of figures, and what was not done."""
    lines = ["# Data card", ""]
    for i, (title, figures) in enumerate(sections.items(), 1):
        lines += [f"## {i}. {title}", ""] + [f"- {k}: {json.dumps(v) if isinstance(v, (dict, list)) else v}" for k, v in figures.items()] + [""]
    return "\n".join([*lines, f"## {len(sections) + 1}. Not done", "", *[f"- {x}" for x in not_done], ""])
