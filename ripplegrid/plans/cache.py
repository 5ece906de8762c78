"""A read-through cache of results as Parquet, keyed by data and every parameter."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_through(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows under the key, made and written first if they aren't there. A result counts as there once its writer has committed it."""
    path = f"{folder.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        make().write.mode("overwrite").parquet(path)
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # an empty result has no file with a schema
        return make().limit(0)
