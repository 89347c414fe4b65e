"""The same record functions on streams: they are expressions over one row, so a streaming DataFrame takes them as is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamill.functions.decisions import evaluate


def observed(stream: DataFrame, wanted: str, status_col: str = "status") -> DataFrame:
    """A stream of observations of machines with how each stands to the wanted state."""
    return stream.withColumn("outcome", evaluate(F.lit("status"), F.lit(wanted), F.when(F.lower(F.col(status_col)) == "error", "error"), F.col(status_col), F.col(status_col).isNull()))
