"""Reload a catalog when its folder changes: databases that come, are replaced, or go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import names
from ..sources.store import Catalog


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of (language_code, date_code) of each database that is published: what its mark says.

    A database that is published anew has a mark of another file name, so it
    arrives again.
    """
    marks = spark.readStream.schema("value string").text(f"{folder.rstrip('/')}/wp-*/complete")
    return marks.select(*names.database_parts(F.col("value"))).where("language_code is not null")


def watch(catalog: Catalog, checkpoint: str, changed: Callable[[list], None] = lambda found: None, seconds: int | None = 5) -> StreamingQuery:
    """Refresh the catalog whenever databases came, were replaced or went.

    A stream of files can't show what is gone, so every ``seconds`` a clock's
    batch compares the folder with what it last saw; before the first of them,
    that is the folder at the call.  If ``seconds`` is None, the stream of
    arrivals runs once over what is there.
    """
    seen = [catalog.state()]

    def reload() -> None:
        changed(catalog.refresh().list())

    def compare(batch: DataFrame, _: int) -> None:
        now = catalog.state()
        if now != seen[0]:
            reload()
            seen[0] = now

    def arrived(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            reload()

    if seconds is None:
        return arrivals(catalog.spark, catalog.folder).writeStream.foreachBatch(arrived).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    clock = catalog.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
