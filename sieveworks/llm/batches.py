"""How many rows cross to Python at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of an Arrow batch; with long texts Spark's own default of 10,000 takes hundreds of MB in the JVM and in Python.
BATCH_ROWS = 2000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches were limited to :data:`BATCH_ROWS` rows; a smaller limit stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_SETTING)) <= BATCH_ROWS:
        conf.set(_SETTING, BATCH_ROWS)
    return df
