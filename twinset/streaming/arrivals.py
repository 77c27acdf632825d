"""Keeping an index up to date from a stream of file signatures, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import index


def newest(rows: DataFrame) -> DataFrame:
    """One row per path: that with the latest time."""
    return rows.groupBy("path").agg(F.max_by(F.struct(*index.SIGNATURE[1:]), "mtime_ns").alias("s")).select("path", "s.*")


def maintain(stream: DataFrame, read, write) -> DataStreamWriter:
    """A writer that merges each batch of (path, digest, mtime_ns, ec_id) into the index: read() gives the index so far,
    write(df) replaces it. Start it with a checkpoint location; a batch that is run again gives the same index."""

    def merge(batch: DataFrame, _: int) -> None:
        write(index.upsert(read(), newest(batch)))

    return stream.writeStream.foreachBatch(merge)
