"""Python over Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def over_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 1000, size: int = 16 << 20) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in a session whose Arrow batches have at most ``rows`` rows and about ``size`` bytes, as texts may be
    of any length. Smaller settings of the session stay."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if int(conf.get(key).removesuffix("b")) not in range(1, most + 1):
            conf.set(key, str(most))
    return df.mapInArrow(run, schema)
