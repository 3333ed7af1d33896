"""Incremental load: new triple files in a folder are typed and appended to a store as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.triples import BUCKETS, from_lexical, write_store
from ..sources.tsv import accepted, fill_ids, parse


def triple_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """tid, s, p, o of lines of files that appear in a folder; a line without an id keeps a null one."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return accepted(parse(reader.text(folder)))


def append_to_store(stream: DataFrame, path: str, checkpoint: str, skeleton: str = "<triple_id_", buckets: int = BUCKETS) -> StreamingQuery:
    """Append the stream's triples to the Parquet store at path.

    Each batch is a folder of its own in the layout of the store, written over if the batch is repeated, so a restart neither loses
    nor doubles triples; queries over the store see it beside what was loaded.  Ids are counted within a batch, under the skeleton and the batch's number.
    """

    def write(batch: DataFrame, number: int) -> None:
        named = fill_ids(batch, f"{skeleton}{number}_")
        write_store(from_lexical(named), path, buckets, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
