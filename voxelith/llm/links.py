"""Links between rows: blocks of large buckets, spanning edges, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelith.llm.common import discard, group_starts, map_groups, materialize

#: Rows of one bucket that a task compares with each other; larger buckets are cut into
#: blocks of so many, and every pair of blocks is compared, each in a call of its own.
BLOCK_ROWS = 1024
BLOCK_BYTES = 32 << 20


def connected_components(edges: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of every id in edges (a, b), both long.

    Alternates large-star and small-star steps until the edges stay as they are. Both steps
    are aggregations and joins; a node with very many links is pre-aggregated before its
    minimum is shuffled, and the join splits it.
    """
    state = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    print_ = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = state.agg(F.count(F.lit(1)), print_).first()
    while before[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # After the large star every remaining link points down; the small star follows it.
        large = materialize(large.where("u <> v"), "edges")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(state, large)
        state = after
        now = state.agg(F.count(F.lit(1)), print_).first()
        if now == before:
            break
        before = now
    roots = state.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def blocked(rows: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """The rows of buckets with two rows or more, dealt over pairs of blocks.

    rows: key, id and more. Adds block, lo and hi; the rows of one (key, lo, hi) are at most
    about two blocks, and every pair of rows of a bucket meets in (lo, hi) of their blocks.
    """
    size = F.count(F.lit(1)) / BLOCK_ROWS
    if weight is not None:
        size = F.greatest(size, F.sum(weight) / BLOCK_BYTES)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.ceil(size).cast("int").alias("__blocks"))
    many = rows.join(counts.where("__n > 1").select(key, "__blocks"), key)
    dealt = many.withColumn("block", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int"))
    return (
        dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        .withColumn("lo", F.least("block", "__other"))
        .withColumn("hi", F.greatest("block", "__other"))
        .drop("__other", "__blocks")
    )


def _groups(rows: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    starts = group_starts([rows.column(k) for k in keys])
    yield from zip(starts, [*starts[1:], rows.num_rows], strict=True)


def blobs(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """Equal-sized binary values as the rows of a matrix."""
    whole = column.combine_chunks()
    raw = b"".join(whole.to_pylist())
    return np.frombuffer(raw, dtype=dtype).reshape(len(whole), -1)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph near; near(i, others) gives a mask.

    Each node is compared with the nodes not reached yet, so a tight group of any size costs
    one comparison a row and loose rows cost all of theirs.
    """
    edges: list[tuple[int, int]] = []
    open_ = np.arange(n)
    while len(open_) > 1:
        frontier = [int(open_[0])]
        open_ = open_[1:]
        while frontier and len(open_):
            i = frontier.pop()
            hit = near(i, open_)
            found = open_[hit]
            open_ = open_[~hit]
            edges += [(i, int(j)) for j in found]
            frontier += found.tolist()
    return edges


def bucket_edges(
    postings: DataFrame, payload: DataFrame, near_in: Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]]
) -> DataFrame:
    """Spanning edges (a, b) of what is near inside the buckets of postings (key, id).

    payload: id, blob. near_in turns the rows of one block pair into the test for forest().
    """
    rows = blocked(postings, "key").join(payload, "id").select("key", "lo", "hi", "id", "blob")

    def kernel(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows.column("id").to_numpy()
        a, b = [], []
        for start, end in _groups(rows, ["key", "lo", "hi"]):
            if end - start > 1:
                own = ids[start:end]
                for i, j in forest(end - start, near_in(rows.slice(start, end - start))):
                    a.append(own[i])
                    b.append(own[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_groups(rows, ["key", "lo", "hi"], kernel, "a long, b long").distinct()


def component_links(
    members: DataFrame,
    matrix_in: Callable[[pa.Table], np.ndarray],
    weight: Column | None = None,
) -> DataFrame:
    """Exact links inside components: members (key, id, copies, blob) to (id, links, to).

    matrix_in gives the boolean matrix of links between the rows of one block pair. Every
    pair of different rows of a component is looked at once. links counts the copies that
    stand on the other side; to lists an id of a linked row, enough of them to span what is
    connected. A row of copies links with its other copies, which the caller adds.
    """
    rows = blocked(members, "key", weight).select("key", "lo", "hi", "block", "id", "copies", "blob")

    def kernel(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows.column("id").to_numpy()
        copies = rows.column("copies").to_numpy()
        block, lo, hi = (rows.column(c).to_numpy() for c in ("block", "lo", "hi"))
        out: list[tuple[int, int, int | None]] = []
        for start, end in _groups(rows, ["key", "lo", "hi"]):
            n = end - start
            if n < 2:
                continue
            linked = matrix_in(rows.slice(start, n))
            np.fill_diagonal(linked, False)
            if lo[start] != hi[start]:
                left = block[start:end] == lo[start]
                linked &= left[:, None] != left[None, :]
            links = linked @ copies[start:end].astype(np.float64)
            out += [(int(ids[start + i]), int(links[i]), None) for i in np.flatnonzero(links)]
            out += [(int(ids[start + i]), 0, int(ids[start + j])) for i, j in forest(n, lambda i, js, m=linked: m[i, js])]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["id", "links", "to"]
            )

    return map_groups(rows, ["key", "lo", "hi"], kernel, "id long, links long, to long")
