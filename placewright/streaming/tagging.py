"""Tagging of mentions that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from placewright.plans.gazetteer import Gazetteer
from placewright.plans.tagging import tag
from placewright.scratch import removed_after, written


def tag_stream(
    mentions: DataFrame,
    gazetteer: Gazetteer,
    path: str,
    checkpoint: str,
    *,
    trigger: dict | None = None,
    **tag_options,
) -> StreamingQuery:
    """Start a query that tags a stream of mentions and writes Parquet below ``path``.

    Each micro-batch is tagged like a table, in any mode. Mentions are independent of each other, so no
    state or watermark is kept. A batch is read from its source once, replaces its own folder, which makes a
    repeated batch harmless, and leaves no other table behind. The gazetteer should be a saved one: others are
    made anew from their files in every batch.
    """
    # what is known of the whole gazetteer outlives the batches
    gazetteer.longest_term()
    if tag_options.get("mode") == "fuzzy":
        gazetteer.gram_counts()

    def write(batch: DataFrame, batch_id: int) -> None:
        with removed_after(batch.sparkSession):
            tagged = tag(written(batch), gazetteer, **tag_options)
            tagged.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = mentions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
