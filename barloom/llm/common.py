"""What the operators share: shared storage, row keys, fixed-size filters, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.words import U64, mix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session, as in tests,
    may leave it unset and gets a temporary folder; anywhere else executors could not
    read each other's files, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
    return sc.getCheckpointDir()


#: Setting under which Spark deletes a job's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, fixes the rows if a task is run again, and gives the planner
    true sizes, so that it broadcasts only what is below its own threshold.  The job's
    shuffle files go when it ends, and not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barloom-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what :func:`saved` wrote, once nothing lazy reads it any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


# A fixed-size bitmap of 64-bit hashes: a filter in front of a join, never a decision.

BITMAP_BITS = 25


def bitmap_of(hashes: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap with one bit per hash, as 2**bits / 64 words: 4 MB whatever the input.

    Words are OR-ed on the executors; the driver gets at most 2**(bits - 6) rows.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        hashes.where(F.col(column).isNotNull())
        .select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(U64)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & U64(len(bitmap) * 64 - 1)
    return (bitmap[slot >> U64(6)] >> (slot & U64(63))) & U64(1) == U64(1)


def winnow(hashes: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Positions in ``hashes`` that are the minimum of some run of ``width``.

    ``counts`` says how many hashes each document has; runs stay inside a document.
    Two documents that share a run keep the same position of it (leftmost minimum).
    """
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    best = np.arange(len(hashes) - width + 1)
    least = hashes[: len(best)].copy()
    for k in range(1, width):
        other = hashes[k : k + len(best)]
        lower = other < least
        least[lower] = other[lower]
        best[lower] = np.flatnonzero(lower) + k
    first = np.cumsum(counts) - counts
    runs = np.maximum(counts - (width - 1), 0)
    total = int(runs.sum())
    if not total:
        return np.zeros(0, np.int64)
    starts = np.arange(total) + np.repeat(first - (np.cumsum(runs) - runs), runs)
    return np.unique(best[starts])


def spread(seed: int) -> np.uint64:
    """A 64-bit constant for a small number."""
    return mix(np.array([seed + 0x51ED2701], dtype=U64))[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node that has an edge.

    ``edges`` has columns u and v of one orderable type (also a struct).  Returns node
    and component.  Alternates large-star and small-star steps (Kiveris et al. 2014):
    each is a grouped minimum, combined before the shuffle, joined back to the edges.
    Every round is written to the shared folder and deleted after the next; it stops
    when the edges stay the same, after rounds in the order of log(nodes) ** 2 at most.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = saved(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    before, after = None, _summary(edges)
    while after != before and after["n"]:
        near = both(edges)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        old, edges = edges, saved(small.select("e.u", "e.v").where("u <> v").distinct())
        release(old)
        before, after = after, _summary(edges)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _summary(edges: DataFrame):
    """Number of edges and sums of two hashes of them."""
    return edges.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]).first()
