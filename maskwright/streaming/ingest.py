"""Documents as they arrive: the same operators on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwright.operators import candidates as C
from maskwright.plans.deidentify import deidentified


def read_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def candidate_counts(events: DataFrame, time: str, text: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Candidates by entity and window of time, with a watermark for what comes late."""
    rows = events.withWatermark(time, late).select(time, F.explode(C.recognized(F.col(text))).alias("s"))
    counts = rows.groupBy(F.window(time, window).alias("w"), F.col("s.entity").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "entity", "n")


def deidentify_stream(docs: DataFrame, out: str, checkpoint: str, seed: int = 1):
    """Write each batch of ``docs(doc_id, text)`` de-identified to Parquet, exactly once; returns the query.

    A copied batch that is tried again overwrites its own folder.
    """

    def put(batch: DataFrame, number: int) -> None:
        deidentified(batch, seed).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
