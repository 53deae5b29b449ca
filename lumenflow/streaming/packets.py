"""Packet streams with Structured Streaming: sources, rescaling, windows, and a reordering buffer.

The same Column functions serve batch and stream. State is bounded: a window leaves by the
watermark, and the buffer of a stream holds at most ``most`` rows between batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package


def packet_source(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files: int = 64) -> DataFrame:
    """A stream of the Parquet files of a folder, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)


def window_counts(packets: DataFrame, ts: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Packets of each key in windows of time; rows later than ``late`` are left out by the watermark."""
    return packets.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("packets")).select(F.col("window.start").alias("start"), *keys, "packets")


def first_seen(packets: DataFrame, ts: str, key: str, late: str) -> DataFrame:
    """Each key once: repeats within the watermark are dropped."""
    return packets.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def reorder(packets: DataFrame, stream: str, pos: str, most: int) -> DataFrame:
    """Rows (stream, pos) in rising order of ``pos`` within a stream once more than ``most`` wait.

    A row with a null position ends its stream: what waits goes out in order. A row that comes after
    a later one has gone out still goes out, marked ``late``.
    """

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, gone = state.get if state.exists else ([], None)
        waiting, ended = list(waiting), False
        for b in batches:
            ended |= bool(b[pos].isna().any())
            waiting += b[pos].dropna().astype("int64").tolist()
        waiting.sort()
        cut = len(waiting) if ended else max(0, len(waiting) - most)
        out = waiting[:cut]
        late = [gone is not None and x < gone for x in out]
        if out:
            gone = max(out[-1], gone) if gone is not None else out[-1]
        state.remove() if ended else state.update((waiting[cut:], gone))
        if out:
            yield pd.DataFrame({stream: [key[0]] * len(out), pos: out, "late": late})

    kind = packets.schema[stream].dataType.simpleString()
    two = packets.select(stream, F.col(pos).cast("bigint").alias(pos))
    return two.groupBy(stream).applyInPandasWithState(run, f"{stream} {kind}, {pos} bigint, late boolean", "waiting array<bigint>, gone bigint", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is and read back what it wrote.

    In ``update`` mode each batch writes only the rows that changed, under its own number (a batch that
    is run again replaces its rows), and of rows with equal ``keys`` the last batch's counts.
    """
    spark = stream.sparkSession
    schema = stream.schema
    if mode == "update":
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"))
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        rest = [c for c in schema.names if c not in keys]
        rows = spark.read.schema(schema.add("batch", "long")).parquet(path)
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(path)
