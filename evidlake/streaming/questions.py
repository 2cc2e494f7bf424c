"""Questions as a stream against stored chunks.

Each micro-batch runs the same pipeline as a batch job; its answers replace the
folder of its batch number, so a batch that is run again after a failure writes
the same answers once. No state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import pipeline, providers
from ..session import scratch


def answer_stream(questions: DataFrame, chunks: DataFrame, settings: pipeline.Settings, out: str, checkpoint: str, answerer: providers.Answerer | None = None, once: bool = False) -> StreamingQuery:
    """Starts the stream; ``questions`` has query_id, question, example_id. Empty batches write nothing."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates(["query_id"])
        if not batch.isEmpty():
            with scratch():  # a stream goes on; what a batch wrote on the way goes with it
                pipeline.answer(batch, chunks, settings, answerer).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
