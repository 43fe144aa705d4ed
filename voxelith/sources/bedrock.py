"""Chunk heights from key-value records: 9-byte keys ending in 0x2B, heights as 16-bit numbers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.sources.anvil import CHUNKS

TAG = 0x2B
HEIGHT_BYTES = 512


def decode_records(records: DataFrame) -> DataFrame:
    """chunks(cx, cz, h) of records (key, value); other keys and short values are left out."""
    wanted = records.where(
        (F.length("key") == 9) & (F.substring("key", 9, 1) == F.lit(bytes([TAG]))) & (F.length("value") >= HEIGHT_BYTES)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (*struct.unpack("<ii", key[:8]), list(struct.unpack("<256h", value[:HEIGHT_BYTES])))
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int32()))],
                ["cx", "cz", "h"],
            )

    return wanted.select("key", "value").mapInArrow(run, CHUNKS)


def open_database(spark: SparkSession, folder: str) -> DataFrame:
    """records(key, value) of a LevelDB folder, read in one task; needs the plyvel package there."""
    one = spark.range(1, numPartitions=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            import plyvel
        except ImportError as missing:
            raise ImportError("reading a LevelDB folder needs the plyvel package on the executors") from missing
        for _ in batches:
            database = plyvel.DB(folder)
            try:
                rows = []
                for key, value in database:
                    if len(key) == 9 and key[8] == TAG:
                        rows.append((bytes(key), bytes(value)))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["key", "value"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["key", "value"])
            finally:
                database.close()

    return one.mapInArrow(run, "key binary, value binary")
