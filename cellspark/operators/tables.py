"""Tables written between the steps of an operator, and joins whose keys may be NULL."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; on one machine a temporary one where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: worked out once, whatever reads it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_on(left: DataFrame, right: DataFrame, keys: list[str] | tuple[str, ...], how: str = "inner") -> DataFrame:
    """A join in which NULL keys meet; without keys ``right`` has one row, which every row gets."""
    if not keys:
        return left.crossJoin(right)
    names = {k: f"__right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    condition = reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[n]) for k, n in names.items()))
    return left.join(right, condition, how).drop(*names.values())
