"""Helpers shared by the corpus operators: shared storage, words, grouped streams."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word, U+0020 and U+0009 to U+000D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_PATTERN = "[ \\t-\\r]+"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Slots of the bitmap that spares unneeded rows a shuffle: at most 2**18 rows of 64 bits.
SLOT_BITS = 18

#: The tables that the enclosing temporary() removes when it ends.
_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent, which only a local master allows, a temporary folder
    takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if getattr(shared_dir, "local", None) is None:
        shared_dir.local = tempfile.mkdtemp(prefix="voxelith-")
    return f"file://{shared_dir.local}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back: cuts the lineage,
    survives lost executors, and later readers prune its columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # Only this write reads its shuffles: their files go when it ends, not when the driver happens to collect garbage.
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        # The fastest level: such tables are written once and read once or twice.
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    if _written.get() is not None:
        _written.get().append(stored)
    return stored


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables that materialize returned. No frame that reads them may be used any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextlib.contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes every table that is materialized inside when it ends, but for those that go through the function it gives.

    What is kept passes on to the temporary() around it, if any.
    """
    written: list[DataFrame] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.stored_at)
        return df

    token = _written.set(written)
    try:
        yield keep
    finally:
        _written.reset(token)
        discard(*[df for df in written if df.stored_at not in kept])
        if _written.get() is not None:
            _written.get().extend(df for df in written if df.stored_at in kept)


def _plain(plan) -> bool:
    """Whether a logical plan is a scan of files, cut to columns and rows at most."""
    if plan.nodeName() not in ("Project", "Filter", "LogicalRelation", "Relation parquet", "Relation", "SubqueryAlias"):
        return False
    children = plan.children()
    return all(_plain(children.apply(i)) for i in range(children.size()))


def numbered(docs: DataFrame, name: str = "__row") -> DataFrame:
    """docs with a number for each row that is the same whenever the frame is read.

    Rows are numbered by their place in the scan of files. Whatever else docs may be, such as
    the outcome of a shuffle, is written to files first.
    """
    if not _plain(docs._jdf.queryExecution().optimizedPlan()):
        docs = materialize(docs, "numbered")
    return docs.withColumn(name, F.monotonically_increasing_id())


def slots(ids: DataFrame) -> DataFrame:
    """A bitmap over the hashes h of ids: slot and bits, at most 2**SLOT_BITS rows."""
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    return ids.groupBy(slot_of("h").alias("slot")).agg(F.bit_or(bit).alias("bits"))


def slot_of(h: str) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with __maybe: false only if their __row is not among those of ids. The bitmap's size is bounded."""
    hashed = ids.select(F.xxhash64("__row").alias("h"))
    return (
        rows.withColumn("h", F.xxhash64("__row")).withColumn("slot", slot_of("h"))
        .join(F.broadcast(slots(hashed)), "slot", "left")
        .withColumn("__maybe", F.coalesce(F.expr("shiftright(bits, cast(h & 63 as int)) & 1L") == 1, F.lit(False)))
        .drop("h", "slot", "bits")
    )


def word_array(text: Column) -> Column:
    """The words of a text, ``[^\\x20\\x09-\\x0D]+``; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN))


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once.

    A filter over a costly column is pushed below it and repeats its expression, inside
    lambdas once for each element; it stops at the generator that is put here.
    """
    whole = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("__pin")
    return df.select("*", whole).select("*", "__pin.*").drop("__pin")


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def map_groups(
    df: DataFrame,
    keys: list[str],
    kernel: Callable[[pa.Table], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """Streams whole groups of equal keys through kernel, many small groups at a call.

    Rows are hash-partitioned and sorted by the keys, then each task cuts its stream at
    group borders. A call gets the complete rows of one or more groups; what a task holds
    is one Arrow batch and one group, so callers bound the size of a group, not the
    number of groups. ``groupBy().applyInPandas`` would pay a call for each tiny group.
    """
    n = partitions_for(df.sparkSession)
    placed = df.repartition(n, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            marks = group_starts([batch.column(batch.schema.get_field_index(k)) for k in keys])
            first = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
            if held and first != last:
                yield from kernel(pa.Table.from_batches(held))
                held = []
            cut = int(marks[-1])
            if cut > 0 or held:
                whole = batch.slice(0, cut) if cut else None
                if whole is not None:
                    yield from kernel(pa.Table.from_batches([*held, whole]))
                    held = []
            held.append(batch.slice(cut))
            last = tuple(batch.column(batch.schema.get_field_index(k))[batch.num_rows - 1].as_py() for k in keys)
        if held:
            yield from kernel(pa.Table.from_batches(held))

    return placed.mapInArrow(run, schema)


def group_starts(columns: list[pa.Array]) -> np.ndarray:
    """Positions at which a run of equal keys starts in sorted integer columns."""
    n = len(columns[0])
    change = np.zeros(n, dtype=bool)
    if n:
        change[0] = True
    for column in columns:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        values = column.fill_null(0).to_numpy(zero_copy_only=False)
        change[1:] |= values[1:] != values[:-1]
        if column.null_count:
            nulls = column.is_null().to_numpy(zero_copy_only=False)
            change[1:] |= nulls[1:] != nulls[:-1]
    return np.flatnonzero(change)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer over uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a slice has at most about most_bytes of text, one row at least."""
    index = batch.schema.get_field_index(column)
    sizes = pa.compute.binary_length(batch.column(index)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes + 64) // most_bytes
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(start, end - start)
