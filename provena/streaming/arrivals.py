"""Files that keep arriving: metadata checks and verdicts for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provena.operators.verdict import reports
from provena.plans.report import Relations, all_checks
from provena.sources.files import DOCUMENTS, exif, extension, pdf_meta


def arrivals(spark: SparkSession, path: str, allowed: tuple[str, ...] = DOCUMENTS) -> DataFrame:
    """A stream of (doc_id, file, ext, content) of files as they appear below a path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    df = spark.readStream.format("binaryFile").schema(schema).load(path).withColumn("ext", extension(F.col("path")))
    return df.where(F.col("ext").isin(*allowed)).select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("file"), "ext", "content")


def report_arrivals(files: DataFrame, sink: str, checkpoint: str, relations: Callable[[DataFrame], Relations] | None = None) -> StreamingQuery:
    """Write a report of each new file below ``sink``, a folder for each batch, so a batch that runs again replaces its own.

    ``relations`` makes the relations of a batch's files, with providers for instance; without it
    the checks are those on metadata.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        known = relations(batch) if relations else Relations(pdf_meta=pdf_meta(batch), exif=exif(batch))
        out = reports(all_checks(known), batch.select("doc_id", "file"), known.errors)
        out.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{sink}/batch={number}")
        batch.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
