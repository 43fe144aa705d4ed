"""New region files as a stream: an incremental form of the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelith.sources.anvil import ScanOptions, decode_regions

_FILE = "path string, modificationTime timestamp, length long, content binary"


def region_stream(spark: SparkSession, folder: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Streaming chunks of the region files that appear in a folder."""
    files = spark.readStream.schema(_FILE).format("binaryFile").option("pathGlobFilter", "r.*.*.mca").load(folder)
    return decode_regions(files, options)


def update_chunks(spark: SparkSession, folder: str, out: str, checkpoint: str, options: ScanOptions = ScanOptions()) -> None:
    """Appends the chunks of files not seen yet to the Parquet table out, then ends."""
    stream = region_stream(spark, folder, options)
    done = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done.awaitTermination()
