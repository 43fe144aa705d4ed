"""Near-duplicate embeddings through a pivot-permutation index.

Vectors are described by their nearest reference points in order. Inverted lists hold the
vectors under each unordered pair of their PREFIX nearest pivots, so that two vectors meet
in a list exactly if they share two pivots or more. What meets is verified by cosine in
double precision and spans components; then every pair inside a component is verified, so
link counts are exact for all that is connected. Equal vectors are one row with a count.
Lists and components of any size are cut into pairs of blocks.

The pivots are a sample of at most MAX_PIVOTS vectors, 2 * sqrt(n) of them; every vector is
indexed. recall() measures the index against brute force for a set of queries.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, as do vectors of different length. Repeated rows are vectors of their own. A null
vec_id counts as the largest. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm.common import materialize, table
from voxelith.llm.links import blobs, bucket_edges, component_links, connected_components

MAX_PIVOTS = 4096
#: Nearest pivots that describe a vector in the lists; PREFIX * (PREFIX - 1) / 2 lists each.
PREFIX = 7
#: Independent pivot sets.
TABLES = 2
THRESHOLD = 0.95


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (__row, vec_id, id) and classes (id, vec_id, copies, dim, blob) of equal vectors.

    id is the __row of one of the class; it is null for vectors that link with nothing.
    """
    rows = materialize(
        vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x")), "vectors"
    ).withColumn("__row", F.monotonically_increasing_id())
    good = (
        F.col("x").isNotNull()
        & (F.size("x") > 0)
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists("x", lambda v: v != 0)
    )
    fine = rows.where(F.coalesce(good, F.lit(False))).withColumns({"h": F.xxhash64("x"), "g": F.xxhash64("x", F.lit(1))})
    classes = fine.groupBy("h", "g").agg(
        F.min("__row").alias("id"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x")
    )
    classes = materialize(classes, "vector-classes")
    members = rows.select("__row", "vec_id").join(
        fine.select("__row", "h", "g").join(classes.select("h", "g", "id"), ["h", "g"]).select("__row", "id"), "__row", "left"
    )
    return members, classes.select("id", "vec_id", "copies", F.size("x").alias("dim"), "x")


def _pivots(classes: DataFrame, seed: int) -> np.ndarray | None:
    """A bounded sample of vectors of the commonest length, by hash."""
    common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return None
    n = int(min(MAX_PIVOTS, max(16, 2 * np.sqrt(common["count"]))))
    sample = classes.where(F.col("dim") == common["dim"]).orderBy(F.xxhash64("x", F.lit(seed)), "id").limit(n).select("x").collect()
    return _unit(np.array([r.x for r in sample], dtype=np.float64))


def pivot_lists(classes: DataFrame, pivots: np.ndarray, table: int, prefix: int = PREFIX) -> DataFrame:
    """The postings (key, id) of every vector under its pairs of nearest pivots.

    Vectors of another length than the pivots' meet in one list for each length.
    """
    held = classes.sparkSession.sparkContext.broadcast(pivots)
    prefix = min(prefix, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = held.value
        p, dim = points.shape
        for batch in batches:
            ids = batch.column(0).to_numpy()
            size = batch.column(1).to_numpy()
            other = np.flatnonzero(size != dim)
            same = np.flatnonzero(size == dim)
            keys, owners = [-1 - size[other].astype(np.int64)], [ids[other]]
            if len(same):
                x = np.array(batch.column(2).take(pa.array(same)).to_pylist(), dtype=np.float64)
                order = np.argsort(-(_unit(x) @ points.T), axis=1, kind="stable")[:, :prefix].astype(np.int64)
                for i in range(prefix):
                    for j in range(i + 1, prefix):
                        low, high = np.minimum(order[:, i], order[:, j]), np.maximum(order[:, i], order[:, j])
                        keys.append((table * p + low) * p + high)
                        owners.append(ids[same])
                if prefix == 1:
                    keys.append(order[:, 0])
                    owners.append(ids[same])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["key", "id"])

    return classes.select("id", "dim", "x").mapInArrow(run, "key long, id long")


def _packed(classes: DataFrame) -> DataFrame:
    """id and blob, the unit vector in doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [_unit(np.array([v], dtype=np.float64)).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["id", "blob"])

    return classes.select("id", "x").mapInArrow(run, "id long, blob binary")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    members, classes = vector_classes(vectors)
    payload = materialize(_packed(classes), "vector-units")
    edges = None
    for t in range(tables):
        pivots = _pivots(classes, t)
        if pivots is not None:
            found = pivot_lists(classes, pivots, t)
            edges = found if edges is None else edges.unionByName(found)
    if edges is None:
        blank = F.lit(None).cast("long")
        found, links = members.select(blank.alias("id"), blank.alias("component")).limit(0), members.select(blank.alias("id"), blank.alias("links")).limit(0)
    else:
        def near_in(rows: pa.Table):
            x = blobs(rows.column("blob"), "f8")
            return lambda i, js: x[js] @ x[i] >= threshold

        def matrix_in(rows: pa.Table) -> np.ndarray:
            x = blobs(rows.column("blob"), "f8")
            return x @ x.T >= threshold

        found = materialize(connected_components(bucket_edges(edges, payload, near_in)), "vector-components")
        inside = found.join(payload, "id").join(classes.select("id", "copies"), "id").withColumnRenamed("component", "key")
        links = component_links(inside, matrix_in).where("to is null").groupBy("id").agg(F.sum("links").alias("links"))
    whole = (
        classes.select("id", "vec_id", "copies").join(found, "id", "left").join(links, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    )
    whole = materialize(whole, "vector-links")
    names = whole.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    per_class = whole.join(names, "component").select("id", "links", "component_id")
    return members.join(per_class, "id", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def recall(vectors: DataFrame, threshold: float = THRESHOLD) -> float:
    """The share of links that the lists retrieve for queries with vec_id divisible by 100,
    against all rows by brute force.

    A measurement of the index: the queries, a hundredth of the vectors, go to every task.
    Vectors of another length than the commonest take no part.
    """
    _, classes = vector_classes(vectors)
    common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return 1.0
    classes = classes.where(F.col("dim") == common["dim"])
    tables = [(t, _pivots(classes, t)) for t in range(TABLES)]
    keys = None
    for t, pivots in tables:
        found = pivot_lists(classes, pivots, t)
        keys = found if keys is None else keys.unionByName(found)
    units = _packed(classes)
    queries = classes.where("vec_id % 100 = 0").select("id").join(units, "id")
    names = [r.id for r in queries.select("id").collect()]
    matrix = np.stack([np.frombuffer(r.blob) for r in queries.select("blob").collect()]) if names else np.zeros((0, 1))
    held = classes.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, x = held.value
        for batch in batches:
            if not batch.num_rows or not q:
                continue
            y = np.stack([np.frombuffer(b) for b in batch.column(1).to_pylist()])
            i, j = np.nonzero(x @ y.T >= threshold)
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(q)[i], pa.int64()), pa.array(ids[j])], ["q", "id"])

    truth = units.mapInArrow(run, "q long, id long").where("q <> id")
    left, right = keys.select("key", F.col("id").alias("q")), keys.select("key", "id")
    got = left.join(truth, "q").join(right, ["key", "id"]).select("q", "id").distinct()
    total = truth.count()
    return got.count() / total if total else 1.0


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
