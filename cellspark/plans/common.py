"""What all registered queries share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines agree in the last bits."""
    return df.withColumns({c: F.round(c, digits) for c, k in df.dtypes if k == "double"})


def scratch(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads again, in the folder that all executors share."""
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"
