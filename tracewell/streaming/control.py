"""Streams under control: progress, loads that a later one supersedes, and rows that are enriched later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources.sinks import upsert


class Progress(StreamingQueryListener):
    """Calls ``tell`` with the number of rows so far, whenever that has passed another multiple of ``every``."""

    def __init__(self, tell: Callable[[int], None], every: int = 5):
        self.tell, self.every, self.done = tell, every, 0

    def onQueryStarted(self, event) -> None:
        self.done = 0

    def onQueryProgress(self, event) -> None:
        before, self.done = self.done, self.done + event.progress.numInputRows
        if self.done // self.every > before // self.every:
            self.tell(self.done)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class Loads:
    """Streams by name, of which the latest runs: starting one stops its predecessor first."""

    def __init__(self):
        self.running: dict[str, StreamingQuery] = {}

    def start(self, name: str, begin: Callable[[], StreamingQuery]) -> StreamingQuery:
        self.cancel(name)
        self.running[name] = begin()
        return self.running[name]

    def cancel(self, name: str) -> bool:
        """Stops the named stream; whether there was one."""
        query = self.running.pop(name, None)
        if query is not None:
            query.stop()
        return query is not None


def write_batches(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch as a folder of its own, written anew if it is repeated; :func:`current_rows` merges them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def current_rows(spark: SparkSession, folder: str, schema: T.StructType, key: str, version: str) -> DataFrame:
    """One row for each key, the latest version of all batches: a row without findings until its findings came."""
    written = spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).parquet(folder).drop("batch")
    return upsert(written, written.where(F.lit(False)), key, version)
