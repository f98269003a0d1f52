"""Continuous screening of newly arrived CVs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shortlist.plans.screening import screen_texts
from shortlist.sources.files import file_texts, stream_cv_files


def stream_ingest(
    texts: DataFrame,
    read_reqs: Callable[[], DataFrame],
    sink: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Screen each micro-batch of CV texts and append the rows to `sink`.

    Requirements are read anew per batch, so edits take effect. A batch writes its own folder and
    overwrites it when repeated after a failure, so no CV is stored twice. A file that cannot be
    read or parsed becomes a failed row; it never stops the stream.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        screen_texts(batch, read_reqs()).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        texts.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_files(
    spark: SparkSession,
    folder: str,
    read_reqs: Callable[[], DataFrame],
    sink: str,
    checkpoint: str,
    decoders: dict[str, Callable[[bytes], str]] | None = None,
    trigger: dict | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Screen files as they arrive in the jobs' folders under `folder`. Each file gives one row; one that
    cannot be read gives a failed row with the reason."""
    texts = file_texts(stream_cv_files(spark, folder, files_per_batch), decoders)
    return stream_ingest(texts, read_reqs, sink, checkpoint, trigger)
