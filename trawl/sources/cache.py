"""Results kept by what made them: the folder's name holds a digest of the parameters, so a change never reads stale data."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def cached(spark: SparkSession, root: str, name: str, parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The kept result for these parameters, else make() written and read back."""
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/{name}-{key}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        # a write that died may have left a folder without data
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
