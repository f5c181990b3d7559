"""Samples with answers that can be checked, a policy made for tests, and its training loop."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import reward as R
from lattica.operators import spatial as S


class Policy(Protocol):
    def generate(self, prompts: list[str], group: int, step: int) -> pd.DataFrame: ...

    def update(self, loss: float) -> None: ...


def samples(objects: DataFrame, cap: int = 20, reach: float = S.MAX_DISTANCE) -> DataFrame:
    """Questions about a map with their truths: relations (as many that do not hold), distances and places, at most cap each."""
    # Each task takes its first samples from the first relations, which are found once.
    rel = S.first_relations(objects, cap, reach, same_label=False, where="relation <> 'unknown'")
    w = Window.partitionBy("task").orderBy("subject_id", "object_id")
    held = rel.select(F.lit("relation").alias("task"), "subject_id", "object_id", "subject", "object", F.col("relation").alias("asked"), F.lit(True).alias("truth"), "distance")
    turned = held.withColumn("asked", F.when(F.col("asked") == "above", "below").otherwise("above")).withColumn("truth", F.lit(False)).where("subject_id % 2 <> 1")
    far = rel.select(F.lit("distance").alias("task"), "subject_id", "object_id", "subject", "object", F.lit(None).cast("string").alias("asked"), F.lit(None).cast("boolean").alias("truth"), "distance")
    place = objects.orderBy("obj_id").limit(cap).select(F.lit("locate").alias("task"), F.col("obj_id").alias("subject_id"), F.lit(None).cast("long").alias("object_id"), F.col("label").alias("subject"), F.lit(None).cast("string").alias("object"), F.lit(None).cast("string").alias("asked"), F.lit(None).cast("boolean").alias("truth"), F.lit(None).cast("double").alias("distance"))
    both = held.where("subject_id % 2 = 1").unionByName(turned).unionByName(far).unionByName(place)
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn")


class NoisyPolicy:
    """Answers distances with an error that shrinks as it is trained."""

    def __init__(self, seed: int = 0, skill: float = 0.2):
        self.rng, self.skill = np.random.default_rng(seed), skill

    def generate(self, prompts: list[str], group: int, step: int) -> pd.DataFrame:
        rows = []
        for i, p in enumerate(prompts):
            for g in range(group):
                error = abs(self.rng.normal(0, 1.2 - self.skill))
                lp = float(-self.rng.uniform(0.1, 1.0))
                rows.append((f"{step}/{i}", g, p, error, 12 + g, lp))
        return pd.DataFrame(rows, columns=["group", "turn", "prompt", "error", "tokens", "old"])

    def update(self, loss: float) -> None:
        self.skill = min(1.0, self.skill + 0.04)


def train(spark, policy: Policy, prompts: list[str], steps: int = 5, group: int = 4) -> DataFrame:
    """The history of a training run: (step, reward, loss, degenerate). Scores and losses are DataFrame aggregates."""
    history = []
    for step in range(steps):
        rows = spark.createDataFrame(policy.generate(prompts, group, step))
        c = R.correctness(F.lit("distance"), F.col("error"), F.lit(True), F.array().cast("array<string>"), F.array().cast("array<string>"))
        scored = R.advantages(rows.withColumn("reward", R.reward(F.lit(True), F.lit(True), c, F.col("tokens"))))
        tok = scored.select(F.xxhash64("group", "turn").alias("seq"), F.col("old").alias("new"), "old", F.col("old").alias("ref"), "advantage", "reward", "degenerate")
        loss = R.policy_loss(tok).first()
        m = tok.agg(F.avg("reward").alias("r"), F.avg(F.col("degenerate").cast("double")).alias("d")).first()
        policy.update(loss.loss)
        history.append((step, m.r, loss.loss, m.d))
    return spark.createDataFrame(history, "step int, reward double, loss double, degenerate double")
