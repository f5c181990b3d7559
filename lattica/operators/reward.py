"""Rewards that can be checked, group advantages and the policy loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scales of errors, weights of the parts, soft limit of length, clips and weight of the penalty.
TAU_DISTANCE, TAU_LOCATE, W_FORMAT, W_CORRECT, W_LENGTH, LIMIT = 0.5, 1.0, 0.2, 1.0, 0.05, 48
CLIP_LOW, CLIP_HIGH, BETA, EPS = 0.2, 0.28, 0.01, 1e-4


def correctness(task: Column, error: Column, right: Column, found: Column, truth: Column) -> Column:
    """relation: right or not; distance and locate: an exponential of the error; list_on: F1 of the sets, 0.2 more for the right count."""
    hits = F.size(F.array_intersect(found, truth))
    total = F.size(found) + F.size(truth)
    f1 = F.when(total > 0, 2 * hits / F.greatest(total, F.lit(1))).otherwise(1.0)
    bonus = F.when(F.size(found) == F.size(truth), 0.2).otherwise(0.0)
    return (
        F.when(task == "relation", right.cast("double")).when(task == "distance", F.exp(-error / TAU_DISTANCE)).when(task == "locate", F.exp(-error / TAU_LOCATE))
        .when(task == "list_on", F.least(F.lit(1.0), f1 + bonus)).otherwise(0.0)
    )


def length_penalty(tokens: Column) -> Column:
    return -F.least(F.lit(1.0), F.greatest(tokens - LIMIT, F.lit(0)) / LIMIT)


def reward(parsed: Column, formatted: Column, correct: Column, tokens: Column) -> Column:
    """0 for an answer that cannot be read."""
    return F.when(parsed, W_FORMAT * formatted.cast("double") + W_CORRECT * correct + W_LENGTH * length_penalty(tokens)).otherwise(0.0)


def reward_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg("reward").alias("mean"), F.stddev_pop("reward").alias("std"), F.min("reward").alias("least"), F.max("reward").alias("most"), F.avg(F.col("formatted").cast("double")).alias("format_rate"), F.avg((F.col("reward") > 0).cast("double")).alias("nonzero_rate"))


def advantages(rows: DataFrame, group: str = "group") -> DataFrame:
    """rows with advantage and degenerate: the reward less the group's mean over its deviation; zero where all are equal."""
    w = Window.partitionBy(group)
    sd = F.stddev_pop("reward").over(w)
    return rows.withColumn("degenerate", sd < EPS).withColumn("advantage", F.when(sd < EPS, 0.0).otherwise((F.col("reward") - F.avg("reward").over(w)) / (sd + EPS)))


def ratio(new: Column, old: Column) -> Column:
    return F.exp(F.greatest(F.least(new - old, F.lit(20.0)), F.lit(-20.0)))


def surrogate(r: Column, advantage: Column) -> Column:
    return F.least(r * advantage, F.greatest(F.least(r, F.lit(1 + CLIP_HIGH)), F.lit(1 - CLIP_LOW)) * advantage)


def kl(new: Column, ref: Column, kind: str = "k3") -> Column:
    d = ref - new
    return {"k1": -d, "k2": d * d / 2, "k3": F.exp(d) - 1 - d}[kind]


def policy_loss(tokens: DataFrame, level: str = "token") -> DataFrame:
    """The loss and its diagnostics over rows (seq, new, old, ref, advantage): the mean over tokens, or over sequences with
    length-normalised ratios."""
    t = tokens.withColumn("kl", kl(F.col("new"), F.col("ref")))
    if level == "sequence":
        t = t.groupBy("seq").agg(F.avg("new").alias("new"), F.avg("old").alias("old"), F.avg("kl").alias("kl"), F.max("advantage").alias("advantage"))
    t = t.withColumn("r", ratio(F.col("new"), F.col("old")))
    clipped = (F.col("r") < 1 - CLIP_LOW) | (F.col("r") > 1 + CLIP_HIGH)
    policy = -F.avg(surrogate(F.col("r"), F.col("advantage")))
    return t.agg(F.count("*").alias("n"), policy.alias("policy"), F.avg("kl").alias("kl"), (policy + BETA * F.avg("kl")).alias("loss"), (-F.avg("new")).alias("entropy"), F.avg(clipped.cast("double")).alias("clip_fraction"), F.avg((F.col("advantage") == 0).cast("double")).alias("zero_advantage"), F.avg("r").alias("mean_ratio"))


def halves(steps: DataFrame, order: str = "step", value: str = "reward") -> DataFrame:
    """Means of the first and second half of a history, and their difference."""
    n = steps.count()
    h = steps.withColumn("__i", F.row_number().over(Window.orderBy(order)) - 1)  # one row for each training step
    first = F.avg(F.when(F.col("__i") < n // 2, F.col(value)))
    second = F.avg(F.when(F.col("__i") >= n // 2, F.col(value)))
    return h.agg(first.alias("first"), second.alias("second"), (second - first).alias("gain"))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


#: An end of a word by ASCII letters, digits and _ alone, as in SQL's expressions: Java's own \\b also counts other letters.
_START, _END = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def yes_no(text: Column) -> Column:
    """False if the text denies, else true if it affirms, else null: denial is looked for first."""
    low = F.lower(F.translate(text, "\u0130", "i"))  # which SQL lowers to one letter
    says = lambda words, signs: low.rlike(f"{_START}({words}){_END}|{signs}")
    return F.when(says("no|not|isn't|aren't|false", "不|没"), False).when(says("yes|true|correct", "是|对"), True)
