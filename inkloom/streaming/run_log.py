"""The request intake as a stream.

Requests reach the service one after another, so the same column rules also run on a
streaming DataFrame. Validation keeps no state, and the file sink commits each micro-batch
once, so the log has every accepted run exactly once after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkloom.operators.intake import run_records, validate_requests


def stream_rejects(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rejected requests with code and reason."""
    rejects = validate_requests(requests).filter(F.col("reject_code").isNotNull())
    return (rejects.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_run_log(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished runs appended to the log."""
    return (run_records(runs).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
