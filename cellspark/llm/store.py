"""Intermediate tables in the shared folder, and helpers common to the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where it is unset and all runs on one machine (tests) a temporary folder stands in.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than reading files again.
    """
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Spark deletes a finished shuffle's files once the driver collects its plan as garbage
    df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed = path
    return out


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def discard(*stashed: DataFrame) -> None:
    """Delete tables made by ``stash`` that nothing reads any more."""
    for df in stashed:
        files, at = _file_system(df.sparkSession, df.stashed)
        files.delete(at, True)


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of ``links`` (a, b: long): rows (id, component).

    Alternating large-star and small-star steps: each round moves edges towards
    the smallest id of a component, so that the number of rounds follows the
    logarithm of the longest path.  A node's neighbours are never gathered: both
    steps are a minimum (combined before the shuffle) and a join.  ``component``
    is the smallest reachable id; ids without links do not appear.
    """
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.isEmpty():
        return edges.toDF("id", "component")
    before = None
    for _ in range(rounds):
        # minima are tables of their own: joined to an aggregate in the same stage, a node of many edges could not be split
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stash(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: link what is smaller than u, and u, to the smallest neighbour
        least = stash(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        after = stash(small.select("e.*").where("u <> v").distinct())
        discard(edges, low, large, least)
        edges = after
        now = edges.agg(F.count("*"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    done = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return done.union(roots)
