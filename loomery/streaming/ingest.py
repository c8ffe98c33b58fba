"""Extension: files taken in as they come.  The batch operators do the work; the stream only says which files are new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomery.operators.artifacts import exists, new_files
from loomery.sources.pdf import extracted


def stream_pdfs(spark: SparkSession, source: str, out: str, checkpoint: str) -> StreamingQuery:
    """Extracts the PDF files that arrive under source into the table at out, each content once; ends when it has caught up."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.pdf").schema("path string, modificationTime timestamp, length long, content binary").load(source)

    def add(batch: DataFrame, _: int) -> None:
        rows = extracted(batch).dropDuplicates(["sha256"])
        if exists(spark, out):
            rows = new_files(rows, spark.read.parquet(out))
        rows.write.mode("append").parquet(out)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
