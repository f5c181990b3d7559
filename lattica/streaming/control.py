"""Load shedding, latency and settings that may change while a stream runs."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class DropOldest:
    """A bounded queue between a fast and a slow query: a full one drops its oldest entry and counts it."""

    def __init__(self, most: int = 4):
        self.queue: deque = deque()
        self.most, self.dropped = most, 0

    def put(self, item: Any) -> None:
        if len(self.queue) >= self.most:
            self.queue.popleft()
            self.dropped += 1
        self.queue.append(item)

    def take(self) -> Any | None:
        return self.queue.popleft() if self.queue else None


def newest(batch: DataFrame, by: str, order: list[str], most: int = 4) -> DataFrame:
    """The newest rows of each key of a micro-batch: shedding where the source cannot be slowed."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return batch.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most).drop("__rn")


class Latency:
    """Figures of the last values, and how many there were."""

    def __init__(self, last: int = 50):
        self.values: deque[float] = deque(maxlen=last)
        self.count = 0

    def add(self, milliseconds: float) -> None:
        self.values.append(milliseconds)
        self.count += 1

    def summary(self) -> dict[str, float]:
        v = sorted(self.values)
        if not v:
            return {"count": 0}

        def at(p: float) -> float:
            h = (len(v) - 1) * p
            i = int(h)
            return v[i] + (v[min(i + 1, len(v) - 1)] - v[i]) * (h - i)

        mean = sum(v) / len(v)
        return {"count": self.count, "mean": mean, "p50": at(0.5), "p95": at(0.95), "min": v[0], "max": v[-1], "hz": 1000 / mean if mean > 0 else 0.0}


#: Settings that a running stream takes over; others need a restart.
HOT = frozenset({"query.top_k", "query.lexical", "mapping.conf_threshold", "stream.publish_every"})


def plan_update(changes: Mapping[str, Any], known: Mapping[str, Any]) -> tuple[dict[str, Any], str]:
    """The changes to apply and why they are refused: one that is unknown or needs a restart refuses them all."""
    for name in changes:
        if name not in known:
            return {}, f"{name} is not known"
        if name not in HOT and changes[name] != known[name]:
            return {}, f"{name} needs a restart"
    return {k: v for k, v in changes.items() if v != known[k]}, ""
