"""Cutting lineage where one aggregated DataFrame feeds several passes
(a total and a top-k, a sample and a window): ``checkpoint()`` writes it once
to the shared folder named by ``spark.checkpoint.dir`` (``session.configure``
sets a folder only where the session has none), so later passes read it
instead of recomputing the joins behind it, and a lost executor does not
send Spark back through that lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    return df.checkpoint(eager=True)
