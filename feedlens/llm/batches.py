"""Size of the batches that reach Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """The same rows; the session's Arrow batches get at most ``rows`` rows from now on.

    Spark's own limit of 10,000 rows is meant for narrow rows. As whole texts they take tens of
    megabytes, several times over, in the executor and in each of its Python workers.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS)) <= rows:
        conf.set(_ROWS, str(rows))
    return df
