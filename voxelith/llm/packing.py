"""Best-fit packing of tokenized documents into fixed-length training sequences.

A piece is a vector (tokens, one document, squared length as attention cost). Open bins
hold the residual of each capacity. Pieces go in order of falling norm to the feasible bin
whose residual fits best: least weighted residual norm after placement, or the largest
weighted dot-product of residual and piece. No constraint is ever exceeded.

Pieces are spread over groups of bounded size by a hash of their place, each group is
packed on its own, so no task sees more than one group at a time. Group borders cost at
most the last, partly filled bins of each group.

Null texts count as empty; an empty text still has its end token. Repeated rows are packed
each by themselves. Ties between bins go to the earlier bin. An empty table gives no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm.common import map_groups, materialize, table
from voxelith.llm.tokenizing import BYTE_BPE, encoder

#: Rows that one task packs together; a bound on memory, not on the input.
GROUP_ROWS = 40_000


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold. None: as much as the tokens allow."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array(
            [self.tokens, self.tokens if self.documents is None else self.documents, self.tokens**2 if self.attention is None else self.attention], dtype=np.float64
        )


@dataclass(frozen=True)
class Fit:
    """How a bin is chosen: "norm" (least residual) or "dot", with a weight per capacity."""

    score: str = "norm"
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)


def pieces(
    docs: DataFrame, tokenizer: str = BYTE_BPE, max_tokens: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Cuts each tokenized document into pieces of max_tokens; only the first may be shorter.

    Columns: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
        + [("ids", pa.list_(pa.int32()))] * with_ids
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                first = len(ids) % max_tokens or max_tokens
                begin = 0
                for k, end in enumerate(range(first, len(ids) + 1, max_tokens)):
                    cut = ids[begin:end]
                    rows.append((doc_id, k, begin, end - begin, zlib.crc32(cut.tobytes())) + (((cut.astype("i4")),) * with_ids))
                    begin = end
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: Capacity, fit: Fit = Fit()) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and the bins' number of pieces so far: (bin, offset)."""
    cap = capacity.vector()
    weights = np.array(fit.weights)
    lengths = np.asarray(lengths, dtype=np.int64)
    size = np.stack([lengths, np.ones_like(lengths), lengths**2], axis=1).astype(np.float64)
    if (size > cap).any():
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    order = np.lexsort((np.arange(len(lengths)), -((size / cap) ** 2 @ weights)))
    smallest = lengths.min(initial=capacity.tokens)
    left = np.empty((len(lengths), 3))
    name = np.empty(len(lengths), dtype=np.int64)
    bin_of = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    live = opened = 0
    for i in order:
        need = size[i]
        best = -1
        if live:
            rest = left[:live]
            ok = rest[:, 0] >= need[0]
            ok &= rest[:, 1] >= need[1]
            ok &= rest[:, 2] >= need[2]
            found = np.flatnonzero(ok)
            if len(found):
                if fit.score == "dot":
                    best = found[np.argmax((rest[found] / cap) @ (weights * need / cap))]
                else:
                    best = found[np.argmin((((rest[found] - need) / cap) ** 2) @ weights)]
        if best < 0:
            best, live = live, live + 1
            left[best], name[best] = cap, opened
            opened += 1
        bin_of[i], offset[i] = name[best], capacity.tokens - left[best, 0]
        left[best] -= need
        if left[best, 0] < smallest or left[best, 1] < 1:
            live -= 1
            left[best], name[best] = left[live], name[live]
    return bin_of, offset


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), fit: Fit = Fit(), group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Pieces that fill a sequence by themselves go straight to one.
    """
    cut = materialize(pieces, "pieces").withColumn("__row", F.monotonically_increasing_id())
    alone = F.col("length") >= capacity.tokens
    n = cut.where(~alone).count()
    groups = max(1, -(-n // group_rows))
    loose = cut.where(~alone).withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
         ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    )

    def kernel(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group = rows.column("__group").to_numpy()
        for g in np.unique(group):
            own = rows.filter(pa.array(group == g)).sort_by("__row")
            bins, offset = best_fit(own.column("length").to_numpy(), capacity, fit)
            own = own.select(arrow.names[:5])
            own = own.append_column("sequence_id", pa.array((int(g) << 32) + bins)).append_column("offset", pa.array(offset))
            yield from own.cast(arrow).combine_chunks().to_batches()

    columns = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = map_groups(loose.select("__group", "__row", *arrow.names[:5]), ["__group"], kernel, columns)
    single = cut.where(alone).select(*arrow.names[:5], (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(single)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str = BYTE_BPE, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the span of each piece."""
    cut = pieces(docs, tokenizer, max_tokens, end_id, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").distinct()
    part = F.struct("offset", "length", "doc_id", "piece", "ids")
    keys = (F.col("p.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("p.piece") == F.col("c.piece")) & (F.col("p.ids_crc32") == F.col("c.ids_crc32"))
    joined = placed.alias("p").join(cut.alias("c"), keys).select("p.*", "c.ids")
    return (
        joined.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(part)).alias("parts"))
        .select(
            "sequence_id",
            F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
            F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("spans"),
        )
    )


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity(), fit: Fit = Fit(), tokenizer: str = BYTE_BPE) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity.tokens), capacity, fit)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
