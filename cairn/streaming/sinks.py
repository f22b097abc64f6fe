"""Where streams end: tables that take a batch once, and the count of what came too late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def into(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch, in append or update mode: a batch's rows in a folder of its number, which a repeated batch replaces.

    So a batch that was written but not yet committed when a query stopped is there once after its restart.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return keep


def appended(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All rows of an append-mode stream that ends in `into`."""
    read = spark.read.schema(schema) if schema else spark.read
    return read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def updated(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Of an update-mode stream that ends in `into`, each key's row of the last batch that has one."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    order = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth", "batch")


class LateCounter(StreamingQueryListener):
    """Counts, by query (its name, else its id), the rows that a watermark dropped; to be added to spark.streams."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        name = event.progress.name or str(event.progress.id)
        late = sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
        self.dropped[name] = self.dropped.get(name, 0) + late

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
