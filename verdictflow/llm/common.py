"""Helpers that the corpus operators share: bounded caches, checkpoints, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TwoGenerationCache(dict):
    """A dict that computes missing values and forgets old ones.

    At most 2 * `limit` entries are held: when the young generation is full it becomes the old one, whose
    entries are taken over again as they are asked for. Values never depend on what is cached.
    """

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


_HELD: dict[str, Callable[[], None]] = {}


def alone(name: str, clear: Callable[[], None]) -> None:
    """Called where an operator's work in a worker begins: what other operators hold in this worker is let go, as workers outlive stages. `clear` lets go of the operator's own.

    It is a function of a module: what a function within a function names itself, a dict or a method of one, reaches the worker as a copy, and clearing that clears nothing.
    """
    others = [c for n, c in _HELD.items() if n != name]
    _HELD.clear()
    _HELD[name] = clear
    for c in others:
        c()
    if others:
        release()


def release() -> None:
    """Hand free memory back to the system: Arrow's, which keeps what it has freed in a pool of its own, and the C library's, where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` whose texts in `column` come to about `most` bytes, or of one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir. Only a local session without one (tests) takes a folder of this machine, removed when Python ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared checkpoint folder, so that later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of rows (a, b, low): edges between a and b, and nodes a with their values; the least value of what a node reaches, by union-find."""
    above: dict[int, int] = {}
    low: dict[int, int] = {}

    def root(n: int) -> int:
        while above.setdefault(n, n) != n:
            above[n] = above[above[n]]
            n = above[n]
        return n

    for batch in batches:
        for a, b, value in zip(*(c.to_pylist() for c in batch.columns)):
            if value is None:
                above[root(a)] = root(b)
            else:
                low[a] = value
    least: dict[int, int] = {}
    for n, value in low.items():
        r = root(n)
        least[r] = min(value, least.get(r, value))
    yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int64()), pa.array([least[root(n)] for n in low], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, values: DataFrame | None = None, few: int = 200_000) -> DataFrame:
    """(node, component): the smallest value among the nodes that each node of `edges` (a, b) reaches. `values` (node, low) names them; without, a node is its own value. All are integers.

    A round contracts: every node goes over to that of its neighbours and itself which has the least hash of the round, so edges stay edges or vanish, and components stay apart.
    As the hashes are new in each round, a part of the nodes vanishes whatever the shape, so chains settle in rounds that grow with the logarithm of their length; there is no
    limit on rounds. Once at most `few` distinct edges are left, one task joins them. Every round is written to the checkpoint folder; the driver sees counts only. The joins
    are on tables with one row per node, so the rows of a node of any degree may be split between tasks. Self-links give a node its own component; nulls are ignored.
    """
    edges = edges.where("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct()
    known = nodes.join(values.select("node", "low"), "node", "left") if values is not None else nodes.withColumn("low", F.col("node"))
    level = cut(known.select("node", F.coalesce("low", "node").alias("low")))  # low: the least value of the first nodes that became this one
    left, moves = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), []
    while (n := left.count()) > few:
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("h"), F.col(c).alias("node"))
        offers = left.select(F.col("a").alias("node"), rank("b").alias("r")).union(left.select(F.col("b"), rank("a"))).union(level.select("node", rank("node")))
        moves.append(cut(offers.groupBy("node").agg(F.min("r").alias("r")).select("node", F.col("r.node").alias("next"))))
        level = cut(level.join(moves[-1], "node").groupBy(F.col("next").alias("node")).agg(F.min("low").alias("low")))
        to = lambda c: moves[-1].select(F.col("node").alias(c), F.col("next").alias(f"{c}_"))
        moved = left.join(to("a"), "a").join(to("b"), "b").where("a_ != b_")
        left = cut(moved.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")).distinct())
    if n:
        none = F.lit(None).cast("long")
        ends = left.select("a").union(left.select("b")).distinct().withColumnRenamed("a", "node")
        rows = left.select("a", "b", none.alias("low")).union(level.join(ends, "node", "left_semi").select("node", none, "low"))
        level = level.join(rows.repartition(1).mapInArrow(_joined, "node long, component long"), "node", "left")
        level = cut(level.select("node", F.coalesce("component", "low").alias("component")))
    else:
        level = level.withColumnRenamed("low", "component")
    for move in reversed(moves):
        level = cut(move.join(level.withColumnRenamed("node", "next"), "next").select("node", "component"))
    return level
