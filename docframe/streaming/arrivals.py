"""Arriving files as streams: each file is parsed once, on its own, so a stream keeps no state but its progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docframe.runtime import scratch_dir
from docframe.sources import rtf as R


def event_stream(spark: SparkSession, path: str, glob: str = "*.rtf", want: set[str] | None = None) -> DataFrame:
    """Events of files as they arrive. The views of ``docframe.sources.rtf`` that neither join nor group (documents,
    fonts, colours, paragraphs, runs, images, diagnostics, texts) apply to it as they are."""
    return R.parse(R.read_stream(spark, path, glob), want=want)


def keep_arrivals(
    spark: SparkSession, path: str, out: str, name: str, view: Callable[[DataFrame], DataFrame] = lambda events: events,
    glob: str = "*.rtf", want: set[str] | None = None, every: str | None = None,
) -> StreamingQuery:
    """Append ``view`` of arriving files to a Parquet table at ``out``.

    Without ``every`` the query takes what is there and ends; else it looks again at that interval. Progress is kept
    under ``name`` in the shared folder: a query that is started again takes new files only, and the sink's own log
    keeps a batch that ran twice from being read twice.
    """
    when = {"processingTime": every} if every else {"availableNow": True}
    rows = view(event_stream(spark, path, glob, want))
    progress = f"{scratch_dir(spark)}/arrivals-{name}"
    return rows.writeStream.format("parquet").option("checkpointLocation", progress).option("path", out).outputMode("append").trigger(**when).start()
