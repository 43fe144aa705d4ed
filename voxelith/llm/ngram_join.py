"""N-gram Jaccard join by chosen paths.

A document is its set of five-word shingles. Sets are embedded as 64 minhash values, of
which two documents share as large a part as their Jaccard similarity. A run splits the
documents recursively: at each node every shared value is sampled with chance
1 / (threshold * 64), by a hash of the node's path and the value, and a document goes to
the child of each sampled value it has. Dissimilar documents part after a level or two; nodes
that are still large are split further. Runs are repeated until a pair at the threshold is met with the
target recall even in the deepest leaves. The sampling is a function of path and value alone, so a
document finds its nodes on its own.

Leaves are compared by brute force, large ones in pairs of blocks; pairs whose minhash
values agree well enough span candidate groups. Inside a group every pair is then compared
exactly on the whole shingle sets, so a link is never reported wrongly, and none is lost
between documents that any chain of candidates connects.

Documents of equal word sequence are one class with a count. Null, empty and blank texts
have no shingles and link with nothing. A text of one to four words is one shingle.
Repeated rows are documents of their own and copies of each other. A null doc_id counts as
the largest. An empty table gives an empty result. Other columns are kept by keep_one and
ignored elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm.common import materialize, mix64, numbered, table, temporary, text_slices
from voxelith.llm.links import blobs, bucket_edges, component_links, connected_components
from voxelith.llm.shingles import minhash, shingled

WORDS = 5
THRESHOLD = 0.8
COORDINATES = 64
#: Levels of every run, and at most; leaves of more classes than LEAF_ROWS are split down to MAX_DEPTH.
DEPTH = 2
MAX_DEPTH = 4
LEAF_ROWS = 1024
#: The chance with which a pair at the threshold is met in some run, even in leaves of MAX_DEPTH: 13 runs.
RECALL = 0.99
#: Pairs with a minhash estimate of so much less than the threshold are candidates.
SLACK = 0.2


def _sketch(docs: DataFrame) -> DataFrame:
    """__row, h, g (hash of the word sequence), n (shingles, repeats included) and signature."""
    schema = "__row long, h long, g long, n long, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                found = shingled(batch.column(1), WORDS)
                marks = minhash(found, COORDINATES)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(found.sequence[:, 0].view(np.int64)),
                        pa.array(found.sequence[:, 1].view(np.int64)),
                        pa.array(np.diff(found.bounds)),
                        pa.array([m.tobytes() for m in marks], pa.binary()),
                    ],
                    ["__row", "h", "g", "n", "signature"],
                )

    return docs.select("__row", "text").mapInArrow(run, schema)


def survival(depth: int) -> float:
    """The chance that a pair at the threshold still shares a node of a run after so many levels.

    The nodes that it shares have one shared child on average, near enough by Poisson's law.
    """
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return q


def runs_for(recall: float, depth: int = MAX_DEPTH) -> int:
    """Runs that bring together a pair at the threshold with this chance, in leaves of this depth."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def _tokens(marks: np.ndarray) -> np.ndarray:
    """64-bit names of signature values, each with its coordinate."""
    place = np.arange(COORDINATES, dtype=np.uint64) * np.uint64(256)
    return mix64(place + marks + np.uint64(0x5851F42D4C957F2D))


def _children(path: np.ndarray, owner: np.ndarray, tokens: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The next level of nodes (path, owner): a child for each value that the node samples of its owner's."""
    child = mix64(path[:, None] ^ tokens[owner])
    at, which = np.nonzero(child < limit)
    return mix64(child[at, which] + np.uint64(1)), owner[at]


def _descend(nodes: DataFrame, threshold: float, levels: int, runs: int = 0) -> DataFrame:
    """The nodes (key, id) that many levels below nodes (key, id, signature), or below the roots of so many
    runs, which need no key."""
    limit = np.uint64(int(2**64 / (threshold * COORDINATES)))
    roots = mix64(np.arange(1, runs + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                ids = batch.column(0).to_numpy()
                tokens = _tokens(blobs(pa.chunked_array([batch.column(1)]), "u1"))
                starts = [np.full(len(ids), r) for r in roots] if runs else [batch.column(2).to_numpy().view(np.uint64)]
                keys, owners = [], []
                for path in starts:
                    owner = np.arange(len(ids))
                    for _ in range(levels):
                        path, owner = _children(path, owner, tokens, limit)
                    keys.append(path.view(np.int64))
                    owners.append(ids[owner])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["key", "id"])

    return nodes.select("id", "signature", *[] if runs else ["key"]).mapInArrow(run, "key long, id long").distinct()


def chosen_paths(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The leaves (key, id) of each class (id, signature).

    Leaves of more than LEAF_ROWS classes are split again, level by level, down to MAX_DEPTH; those that
    are larger even then hold classes that are alike, and are compared in blocks.
    """
    leaves = materialize(_descend(classes, threshold, DEPTH, runs_for(recall)), "join-leaves")
    done = None
    for _ in range(DEPTH, MAX_DEPTH):
        large = materialize(leaves.groupBy("key").count().where(F.col("count") > LEAF_ROWS).select("key"), "join-large")
        if large.isEmpty():
            break
        small = leaves.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        open_ = leaves.join(large, "key", "left_semi").join(classes.select("id", "signature"), "id")
        leaves = materialize(_descend(open_, threshold, 1), "join-leaves")
    return leaves if done is None else done.unionByName(leaves)


def _sets(docs: DataFrame) -> DataFrame:
    """id and blob, the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                found = shingled(batch.column(1), WORDS)
                sets = [np.unique(found.values[a:b]).tobytes() for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "blob"])

    return docs.select("id", "text").mapInArrow(run, "id long, blob binary")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections, by products of slices of the incidence matrix."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    run = np.cumsum(fresh) - 1
    shared = np.bincount(run)[run] > 1
    owner, run = owner[shared], run[shared]
    common = np.zeros((n, n))
    if len(run):
        run = np.cumsum(np.concatenate([[True], run[1:] != run[:-1]])) - 1
        step = max(256, (8 << 20) // n)
        for low in range(0, int(run[-1]) + 1, step):
            a, b = np.searchsorted(run, [low, low + step])
            part = np.zeros((n, min(step, int(run[-1]) + 1 - low)), dtype=np.float32)
            part[owner[a:b], run[a:b] - low] = 1
            common += part @ part.T
    return common


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """__row, id (class), n_links and component (an id) of every row of docs (__row, doc_id, text)."""
    sketch = materialize(_sketch(docs), "join-sketch")
    classes = sketch.where("n > 0").groupBy("h", "g").agg(
        F.min("__row").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature")
    )
    classes = materialize(classes, "join-classes")
    payload = classes.select("id", F.col("signature").alias("blob"))
    least = int(np.ceil((threshold - SLACK) * COORDINATES))

    def near_in(rows: pa.Table):
        marks = blobs(rows.column("blob"), "u1")
        return lambda i, js: (marks[js] == marks[i]).sum(axis=1) >= least

    edges = bucket_edges(chosen_paths(classes, threshold, recall), payload, near_in)
    groups = materialize(connected_components(edges), "join-groups")
    texts = docs.select(F.col("__row").alias("id"), "text").join(groups.select("id"), "id")
    members = (
        materialize(_sets(texts), "join-sets").join(groups.withColumnRenamed("component", "key"), "id")
        .join(classes.select("id", "copies"), "id")
    )

    # In whole numbers: |A and B| * 10 >= 8 * |A or B|, for a threshold of 0.8.
    top = round(threshold * 1000)

    def matrix_in(rows: pa.Table) -> np.ndarray:
        sets = [np.frombuffer(b, dtype=np.uint64) for b in rows.column("blob").to_pylist()]
        size = np.array([len(s) for s in sets])
        common = _overlaps(sets)
        return common * 1000 >= top * (size[:, None] + size[None, :] - common)

    found = materialize(component_links(members, matrix_in, F.length("blob")), "join-links")
    links = found.where("to is null").groupBy("id").agg(F.sum("links").alias("links"))
    exact = connected_components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    whole = (
        classes.select("id", "h", "g", "copies").join(links, "id", "left").join(exact, "id", "left")
        .select(
            "id", "h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    return sketch.select("__row", "h", "g", (F.col("n") > 0).alias("__some")).join(
        whole.withColumn("__some", F.lit(True)), ["h", "g", "__some"], "left"
    ).select("__row", "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "__row").alias("component"))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, copy_id and kept for every document.

    class_id is the smallest doc_id reachable over links, copy_id that of the same word
    sequence; n_links counts other documents at the threshold or above. kept marks one row
    of each class.
    """
    rows = numbered(docs.select("doc_id", "text"))
    with temporary() as keep:
        found = keep(materialize(jaccard_classes(rows, threshold, recall).join(rows.select("__row", "doc_id"), "__row"), "join-rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__row"))
    copies = found.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("copy_id"))
    heads = found.groupBy("component").agg(first.alias("head"))
    return (
        found.join(heads, "component").join(copies, "id", "left")
        .select(
            "doc_id", F.col("head.doc_id").alias("class_id"), F.col("n_links").cast("long").alias("n_links"),
            F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
            (F.col("head.__row") == F.col("__row")).alias("kept"),
        )
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One document of each class, the one of the smallest doc_id, with its columns."""
    rows = numbered(docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("__whole")))
    with temporary() as keep:
        found = jaccard_classes(rows.select("__row", "text"), threshold, recall)
        found = keep(materialize(found.select("__row", "component").join(rows.select("__row", "doc_id"), "__row"), "join-rows"))
    heads = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__row")).alias("h"))
    return rows.join(heads.select(F.col("h.__row").alias("__row")), "__row").select("__whole.*")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
