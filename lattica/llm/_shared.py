"""Storage, hashing and graph helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str, rows: int | None = None, few: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    rows: how many rows a batch for Python has at most while it is written, where rows are long; the session's own setting is
    put back. few: what many tasks make is likely to be small, and goes through a shuffle to as few files as its size asks for.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if few else df
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    usual = spark.conf.get(_BATCH)
    if rows:
        spark.conf.set(_BATCH, str(min(rows, int(usual) if int(usual) > 0 else rows)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, usual)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete a table of written() that no later step reads."""
    path = getattr(df, "_lattica_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # the JVM may be gone at exit
                return


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix of an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: Links, counted, that one task of an executor may hold; sixteen bytes each. More go through rounds of joins.
FEW_LINKS = 250_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all links of a task."""
    rows = [np.column_stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)]) for b in batches]
    if not rows:
        return
    ids, flat = np.unique(np.concatenate(rows), return_inverse=True)
    pairs = flat.reshape(-1, 2)
    label = np.arange(len(ids))
    while True:
        low = label[pairs].min(axis=1)
        new = label.copy()
        np.minimum.at(new, label[pairs[:, 0]], low)
        np.minimum.at(new, label[pairs[:, 1]], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["id", "component"])


def components(links: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Connected components of links (a, b): one row (id, component) for each id in a link, component the smallest id.

    kept: links are read from tables and need not be written first.

    Up to FEW_LINKS of them, by their count, are united by one task. More take large-star and small-star rounds, each written
    to the shared folder: a round is a pair of pre-aggregated minima and joins on them, so that no node's neighbours are
    gathered in one task. Nothing but two figures reaches the driver.
    """
    links = links.where("a <> b").select("a", "b")
    links = links if kept else written(links, f"{name}-links", few=True)
    if links.count() <= FEW_LINKS:
        return links.coalesce(1).mapInArrow(_united, "id long, component long")
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        mid = written(large, f"{name}-large")
        least = mid.groupBy("a").agg(F.min("b").alias("m"))
        small = mid.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = written(small, f"{name}-small")
        forget(mid)
        forget(edges)
        edges = new
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            break
        last = state
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return out.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
