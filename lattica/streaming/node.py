"""A mapping node: synchronised frames go into a map batch by batch, which is published every so many frames.

Sensors may lose messages, states may not: what is published is a table that late readers read the last version of.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import mapping
from lattica.streaming.control import Latency, newest

#: How many messages of a kind of topic wait, and whether the last one is kept for those who come late.
POLICIES = {"sensor": {"depth": 2, "reliable": False, "latched": False}, "state": {"depth": 1, "reliable": True, "latched": True}, "query": {"depth": 10, "reliable": True, "latched": False}}


@dataclass
class Latched:
    """The last version of a table under a folder: versions are written whole and named by one pointer, so that a reader never
    sees half of one."""

    spark: SparkSession
    path: str
    version: int = -1

    def publish(self, df: DataFrame) -> None:
        self.version += 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{self.version}")
        self.spark.createDataFrame([(self.version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def last(self) -> DataFrame | None:
        """What a late reader sees; None before anything was published."""
        try:
            v = self.spark.read.schema("version long").parquet(f"{self.path}/versions").agg(F.max("version")).first()[0]
        except Exception:  # no such folder yet
            return None
        return None if v is None else self.spark.read.parquet(f"{self.path}/v{v}")


@dataclass
class MappingNode:
    """Takes micro-batches of observations and their points, keeps them as tables, and publishes the map every `every` frames.

    Use process as the function of foreachBatch; a batch that a restart delivers again replaces what it wrote before.
    """

    spark: SparkSession
    path: str
    every: int = 10
    shed: int | None = None
    options: dict[str, Any] = field(default_factory=dict)
    latency: Latency = field(default_factory=Latency)
    frames: int = 0
    published: int = 0

    def __post_init__(self) -> None:
        self.map = Latched(self.spark, f"{self.path}/map")

    def process(self, observations: DataFrame, points: DataFrame, batch: int) -> None:
        """One micro-batch. With shed, only so many of the newest frames of each scene count, as a sensor's queue would have it."""
        if self.shed is not None:
            recent = newest(observations.select("scene", "frame").distinct(), "scene", ["frame"], self.shed)
            observations = observations.join(recent, ["scene", "frame"], "left_semi")
        observations.write.mode("overwrite").parquet(f"{self.path}/observations/batch={batch}")
        points.join(observations.select("obs"), "obs", "left_semi").write.mode("overwrite").parquet(f"{self.path}/points/batch={batch}")
        self.frames += observations.select("scene", "frame").distinct().count()
        if self.frames // self.every > self.published:
            self.published = self.frames // self.every
            self.publish()

    def publish(self) -> None:
        import time

        start = time.monotonic()
        seen, points = (self.spark.read.parquet(f"{self.path}/{x}").drop("batch") for x in ("observations", "points"))
        self.map.publish(mapping.build(seen, points, **self.options).objects)
        self.latency.add((time.monotonic() - start) * 1000)

    def as_batch(self, points: DataFrame) -> Callable[[DataFrame, int], None]:
        """The function for foreachBatch over a stream of observations whose points are in a table."""
        return lambda df, n: self.process(df, points, n)
