"""Hidden Markov language model with scores of whole texts.

Tokens are the lower-cased (A-Z) words of a text and one end. The chain of latent states
emits word classes and a class emits its words: P(w | state) = P(class | state) *
P(w | class). Every word that makes up 1 / FREQUENT of the training tokens or more is a class
of its own, which bounds their number; the others share classes by their endings. Within a
class words have add-one estimates from exact counts over all training texts, with one
place for words never seen, so that the model is a proper distribution over texts.

Counting: each block of texts is reduced to local ids and one row for each distinct word;
the rows meet by word, whose total goes back to the blocks. No vocabulary is ever held in
one place. Training: Baum-Welch counts are summed inside tasks and then across them, by
slices. Scoring: the scaled forward recursion over the whole text, exact for any length.

The first guess of the states comes from a mixture that is fitted to every training text, as
bags of classes; the passes that train the states cover every training text too.

Words are counted by a 64-bit key (class of the ending and a hash); of v words, two meet
with a chance below v * v / 2**54. Null texts count as empty; empty texts are their end.
Texts with a null doc_id are training texts. Repeated rows count each. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm.common import group_starts, map_groups, materialize, table

STATES = 8
#: Passes of Baum-Welch over all training texts.
PASSES = 2
#: A word with at least a part in so many of the training tokens is its own class.
FREQUENT = 4096
ENDINGS = 2048
#: Classes: endings, then frequent words, then the end of a text.
END = ENDINGS + FREQUENT
CLASSES = END + 1
#: Bytes of text that share one local vocabulary.
BLOCK_BYTES = 32 << 20
#: Steps of the mixture that the states start from; they end when one gains less than this (natural log) a token.
INITIAL_STEPS = 12
INITIAL_GAIN = 1e-3
#: Numbers in the sketch of a text, and entries of the counts of texts that share a row.
SKETCH = 32
BAG_CELLS = 250_000
#: Numbers in the tables of one batch of sequences.
CELLS = 4_000_000
SEED = 5
SMOOTH = 0.05


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def word_key(word: bytes) -> int:
    """Class of the ending in the top 11 bits, hash of the word below."""
    ending = xxhash.xxh3_64_intdigest(word[-3:]) % ENDINGS
    return (ending << 53) | (xxhash.xxh3_64_intdigest(word) >> 11)


def _pack(ids: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, compressed."""
    ids = np.ascontiguousarray(ids, dtype="<u8")
    planes = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
    body = np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(data: bytes) -> np.ndarray:
    planes = data[0]
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(planes, -1)
    out = np.zeros((body.shape[1], 8), dtype=np.uint8)
    out[:, :planes] = body.T
    return out.view("<u8").ravel()


def text_blocks(docs: DataFrame) -> DataFrame:
    """Texts as local word ids, and a header for each block with its words' keys and counts.

    Text rows: block, doc_id, held, n (words), ids. Header rows: block, keys, counts (in
    training texts), texts and tokens (of training texts).
    """
    arrow = pa.schema(
        [("block", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("n", pa.int64()), ("ids", pa.binary()),
         ("keys", pa.binary()), ("counts", pa.binary()), ("texts", pa.int64()), ("tokens", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        words, rows, size = _Vocabulary(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal words, rows, size, made
            block = (task << 24) + made
            made += 1
            whole = np.concatenate([r[2] for r in rows])
            order = np.argsort(-np.bincount(whole, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), dtype=np.uint64)
            rank[order] = np.arange(len(words), dtype=np.uint64)
            learn = [r[2] for r in rows if not r[1]]
            counts = np.bincount(np.concatenate(learn) if learn else whole[:0], minlength=len(words))[order]
            names = list(words)
            keys = np.array([word_key(names[i]) for i in order], dtype=np.uint64)
            for i in range(0, len(rows), 1024):
                part = rows[i : i + 1024]
                n = [len(r[2]) for r in part]
                none = [None] * len(part)
                columns = [[block] * len(part), [r[0] for r in part], [r[1] for r in part], n, [_pack(rank[r[2]]) for r in part], none, none, none, none]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            head = [block, None, None, None, None, keys.tobytes(), _pack(counts), len(learn), sum(len(x) + 1 for x in learn)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(head, arrow, strict=True)], schema=arrow)
            words, rows, size = _Vocabulary(), [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode().lower()
                found = data.split()
                rows.append((doc_id, held_out(doc_id), np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=len(found))))
                size += len(data) + 64
                if size >= BLOCK_BYTES:
                    yield from flush()
        if rows:
            yield from flush()

    schema = "block long, doc_id long, held boolean, n long, ids binary, keys binary, counts binary, texts long, tokens long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def word_totals(blocks: DataFrame, tokens: int) -> DataFrame:
    """Each word's total over all blocks, sent back to the blocks that have it.

    Rows of three kinds: block, keys, counts (some words of a block); ending, n, v (tokens and
    distinct words of that ending which aren't frequent); key, n (a frequent word).
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, counts in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                keys, counts = np.frombuffer(keys, dtype=np.int64), _unpack(counts).astype(np.int64)
                for i in range(0, len(keys), 100_000):
                    some = keys[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some), pa.array(np.full(len(some), block)), pa.array(counts[i : i + 100_000])], ["key", "block", "c"]
                    )

    rows = blocks.where("keys is not null").select("block", "keys", "counts").mapInArrow(spread, "key long, block long, c long")
    arrow = pa.schema(
        [("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("ending", pa.int32()), ("key", pa.int64()),
         ("n", pa.int64()), ("v", pa.int64())]
    )

    def meet(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = group_starts([rows.column("key")])
        key = rows.column("key").to_numpy()
        total = np.add.reduceat(rows.column("c").to_numpy(), starts)
        size = np.diff(np.append(starts, len(key)))
        out = []
        names = key[starts]
        often = total * FREQUENT >= tokens
        seen = (total > 0) & ~often
        endings, at = np.unique((names.view(np.uint64) >> np.uint64(53)).astype(np.int64)[seen], return_inverse=True)
        n = np.bincount(at, weights=total[seen], minlength=len(endings)).astype(np.int64)
        v = np.bincount(at, minlength=len(endings))
        out += [(None, None, None, int(e), None, int(a), int(b)) for e, a, b in zip(endings, n, v, strict=True)]
        out += [(None, None, None, None, int(k), int(t), None) for k, t in zip(names[often], total[often], strict=True)]
        every = np.repeat(total, size)
        block = rows.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        block, key, every = block[order], key[order], every[order]
        cuts = group_starts([pa.array(block)])
        for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True):
            out.append((int(block[a]), key[a:b].tobytes(), _pack(every[a:b]), None, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return map_groups(rows, ["key"], meet, "block long, keys binary, counts binary, ending int, key long, n long, v long")


@dataclass(frozen=True)
class Words:
    """Bounded facts of the corpus: totals, frequent words, and sums by ending."""

    tokens: int
    distinct: int
    texts: int
    frequent: np.ndarray
    ending_tokens: np.ndarray
    ending_words: np.ndarray


def facts(blocks: DataFrame, totals: DataFrame) -> Words:
    sums = blocks.agg(F.sum("tokens"), F.sum("texts")).first()
    tokens, texts = int(sums[0] or 0), int(sums[1] or 0)
    n, v = np.zeros(ENDINGS, dtype=np.int64), np.zeros(ENDINGS, dtype=np.int64)
    for r in totals.where("ending is not null").groupBy("ending").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r.ending], v[r.ending] = r.n, r.v
    frequent = np.sort(np.array([r.key for r in totals.where("key is not null").select("key").collect()], dtype=np.int64))
    distinct = int(v.sum()) + len(frequent) + (texts > 0)
    return Words(tokens, distinct, texts, frequent, n, v)


def encode(blocks: DataFrame, totals: DataFrame, words: Words) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, inner (log10 of words given their
    classes) and classes (packed, the end included) of every text."""
    left = blocks.select("block", "doc_id", "held", "n", "ids", "keys", F.expr("cast(null as binary)").alias("counts"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("held", "boolean"), ("n", "long"), ("ids", "binary"))]
    right = totals.where("block is not null").select("block", *none, "keys", "counts")
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
         ("base_score", pa.float64()), ("inner", pa.float64()), ("classes", pa.binary())]
    )

    def meet(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = group_starts([rows.column("block")])
        for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            group = rows.slice(a, b - a)
            is_text = group.column("ids").is_valid()
            rest = group.filter(pa.compute.invert(is_text))
            is_total = rest.column("counts").is_valid()
            names = np.frombuffer(rest.filter(pa.compute.invert(is_total)).column("keys")[0].as_py(), dtype=np.int64)
            found = rest.filter(is_total)
            keys = np.frombuffer(b"".join(found.column("keys").to_pylist()), dtype=np.int64)
            counts = np.concatenate([_unpack(c) for c in found.column("counts").to_pylist()] or [np.zeros(0, np.uint64)])
            order = np.argsort(keys)
            # Two words of a block with one key are two rows with one total.
            c = counts[order][np.searchsorted(keys[order], names)].astype(np.float64) if len(names) else np.zeros(0)
            ending = (names.view(np.uint64) >> np.uint64(53)).astype(np.int64)
            place = np.searchsorted(words.frequent, names)
            often = np.zeros(len(names), dtype=bool)
            if len(words.frequent):
                often = words.frequent[np.minimum(place, len(words.frequent) - 1)] == names
            cls = np.where(often, ENDINGS + place, ending)
            given = (c + 1) / (words.ending_tokens[ending] + words.ending_words[ending] + 1)
            inner = np.where(often, 0.0, np.log10(given))
            base = np.log10((c + 1) / (words.tokens + words.distinct + 1))
            end_base = float(np.log10((words.texts + 1) / (words.tokens + words.distinct + 1)))
            texts = group.filter(is_text).select(["doc_id", "held", "ids"])
            for i in range(0, texts.num_rows, 1024):
                out = []
                part = texts.slice(i, 1024)
                for doc_id, held, ids in zip(*[part.column(k).to_pylist() for k in range(3)], strict=True):
                    ids = _unpack(ids).astype(np.int64)
                    out.append(
                        (doc_id, held, len(ids) + 1, int((c[ids] > 0).sum()) + (words.texts > 0), float(base[ids].sum()) + end_base,
                         float(inner[ids].sum()), _pack(np.append(cls[ids], END)))
                    )
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inner double, classes binary"
    return map_groups(left.unionByName(right), ["block"], meet, schema)


@dataclass(frozen=True)
class Chain:
    """The trained states: first (k), moves (k, k) and emits (classes, k)."""

    first: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


def _sheets(sequences: list[np.ndarray], states: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of sequences of similar length: their places, a (time, sequence) table, and how
    many sequences still run at each time."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        longest = lengths[order[at]]
        width = int(max(1, min(512, CELLS // (longest * states))))
        own = order[at : at + width]
        table = np.zeros((longest, len(own)), dtype=np.int64)
        for j, i in enumerate(own):
            table[: lengths[i], j] = sequences[i]
        running = np.searchsorted(-lengths[own], -np.arange(longest), side="left")
        yield own, table, running
        at += width


def _forward(
    chain: Chain, table: np.ndarray, running: np.ndarray, keep: bool, before: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray]:
    """Log10 likelihoods by the scaled forward recursion; with keep also the scaled forward table and
    the scales; and the last forward row. before is that of the time before the table's first."""
    times, width = table.shape
    k = len(chain.first)
    log = np.zeros(width)
    scales = np.ones((times, width)) if keep else None
    alphas = np.zeros((times, width, k)) if keep else None
    a = before
    for t in range(times):
        n = running[t]
        a = chain.first * chain.emits[table[t]] if a is None else (a[:n] @ chain.moves) * chain.emits[table[t, :n]]
        s = a.sum(axis=1)
        a /= s[:, None]
        log[:n] += np.log10(s)
        if keep:
            alphas[t, :n], scales[t, :n] = a, s
    return log, alphas, scales, a


def baum_welch_counts(chain: Chain, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected first states, moves and emissions of the sequences.

    Sequences are walked in stretches of about CELLS numbers: forward once, keeping the row before each
    stretch, and backward with each stretch's forward rows made again. So memory doesn't follow the length.
    """
    k = len(chain.first)
    first, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
    for _, table, running in _sheets(sequences, k):
        times, width = table.shape
        size = max(1, CELLS // (width * k))
        starts = range(0, times, size)
        before: list[np.ndarray | None] = [None]
        for s in starts[:-1]:
            before.append(_forward(chain, table[s : s + size], running[s : s + size], False, before[-1])[3])
        b = np.ones((width, k))
        for s, start in zip(reversed(starts), reversed(before), strict=True):
            part = table[s : s + size]
            _, alphas, scales, _ = _forward(chain, part, running[s : s + size], True, start)
            for t in range(len(part) - 1, -1, -1):
                n = running[s + t]
                alphas[t, :n] *= b[:n]
                earlier = alphas[t - 1] if t else start
                if earlier is not None:
                    w = chain.emits[part[t, :n]] * b[:n] / scales[t, :n, None]
                    moves += earlier[:n].T @ w
                    b[:n] = w @ chain.moves.T
            if s == 0:
                first += alphas[0].sum(axis=0)
            live = np.arange(width)[None, :] < running[s : s + size, None]
            seen, weight = part[live], alphas[live]
            for j in range(k):
                emits[:, j] += np.bincount(seen, weights=weight[:, j], minlength=CLASSES)
    return first, moves * chain.moves, emits


def estimate(first: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Chain:
    """Smoothed estimates from counts; every class keeps a chance in every state."""
    k = len(first)
    overall = (emits.sum(axis=1) + 1) / (emits.sum() + CLASSES)
    emits = emits + SMOOTH * overall[:, None] * CLASSES / 10
    return Chain(
        (first + 1) / (first.sum() + k),
        (moves + 1) / (moves.sum(axis=1, keepdims=True) + k),
        emits / emits.sum(axis=0),
    )


def text_bags(coded: DataFrame) -> DataFrame:
    """The training texts as counts of their classes, many texts a row: sizes (entries of each text), classes and counts.

    A row has at most BAG_CELLS entries, and a text at most CLASSES of them, whatever its length.
    """
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(c) for c, _ in held])
            columns = [_pack(x) for x in (sizes, *map(np.concatenate, zip(*held, strict=True)))]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["sizes", "classes", "counts"])

        for batch in batches:
            for part in _portions(batch):
                for text in part:
                    found = np.unique(_unpack(text), return_counts=True)
                    if held and size + len(found[0]) > BAG_CELLS:
                        yield flush()
                        held, size = [], 0
                    held.append(found)
                    size += len(found[0])
        if held:
            yield flush()

    return coded.where(~F.col("held_out")).select("classes").mapInArrow(bags, "sizes binary, classes binary, counts binary")


def _bag(sizes: bytes, classes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each text starts, the text of each entry, its class and its count."""
    sizes = _unpack(sizes).astype(np.int64)
    return np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes), _unpack(classes).astype(np.int64), _unpack(counts).astype(np.float64)


def _sketch_sums(classes: np.ndarray, counts: np.ndarray, starts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A sketch of each text: the square roots of its classes' shares, projected to SKETCH numbers."""
    signs = np.random.default_rng(SEED).choice(np.float32([-1, 1]), (CLASSES, SKETCH))
    unit = np.sqrt(counts / np.add.reduceat(counts, starts)[text]).astype(np.float32)
    return np.add.reduceat(unit[:, None] * signs[classes], starts).astype(np.float64)


def _weighed(weight: np.ndarray, text: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of each class in each state, of texts that belong to the states by weight."""
    return np.stack([np.bincount(classes, weights=counts * w[text], minlength=CLASSES) for w in weight.T], axis=1)


def initial(coded: DataFrame, states: int = STATES, log: Callable[[str], None] | None = None) -> Chain:
    """States from a mixture of class distributions, fitted to every training text.

    The texts are first parted by the signs of their places along the main directions of their sketches,
    then the mixture is fitted in steps until one gains less than INITIAL_GAIN a token, INITIAL_STEPS at most.
    All that comes together are sums of a size that no table changes.
    """
    say = log or (lambda line: None)
    bags = materialize(text_bags(coded), "hmm-bags")

    def moments(starts: np.ndarray, text: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        sketch = _sketch_sums(classes, counts, starts, text)
        return [np.array([len(sketch)]), sketch.sum(axis=0), sketch.T @ sketch]

    n, mean, square = _bag_sums(bags, moments, [(1,), (SKETCH,), (SKETCH, SKETCH)])
    mean = mean / max(1, n[0])
    bits = max(1, (states - 1).bit_length())
    main = np.linalg.eigh(square / max(1, n[0]) - np.outer(mean, mean))[1][:, ::-1][:, :bits]

    def parted(starts: np.ndarray, text: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        side = (_sketch_sums(classes, counts, starts, text) - mean) @ main > 0
        return [_weighed(np.eye(states)[side @ (1 << np.arange(bits)) % states], text, classes, counts)]

    emits = _bag_sums(bags, parted, [(CLASSES, states)])[0]
    total = emits.sum()
    overall = (emits.sum(axis=1) + 1) / (total + CLASSES)
    emits = emits / np.maximum(emits.sum(axis=0), 1) * 0.5 + 0.5 * overall[:, None]
    share = np.full(states, 1 / states)
    before = -np.inf
    for i in range(INITIAL_STEPS):
        logs, prior = np.log(emits), np.log(share)

        def step(
            starts: np.ndarray, text: np.ndarray, classes: np.ndarray, counts: np.ndarray, logs: np.ndarray = logs, prior: np.ndarray = prior
        ) -> list[np.ndarray]:
            score = np.add.reduceat(counts[:, None] * logs[classes], starts) + prior
            most = score.max(axis=1, keepdims=True)
            weight = np.exp(score - most)
            sums = weight.sum(axis=1, keepdims=True)
            weight /= sums
            return [weight.sum(axis=0), (most + np.log(sums)).sum(axis=0), _weighed(weight, text, classes, counts)]

        texts, likelihood, emits = _bag_sums(bags, step, [(states,), (1,), (CLASSES, states)])
        share = (texts + 1) / (texts.sum() + states)
        emits = emits + overall[:, None] * 100
        emits /= emits.sum(axis=0)
        say(f"mixture step {i + 1}: {likelihood[0] / max(1.0, total):.5f} a token")
        if likelihood[0] - before < INITIAL_GAIN * max(1.0, total):
            break
        before = likelihood[0]
    moves = np.full((states, states), 0.02 / max(1, states - 1)) + np.eye(states) * 0.98
    return Chain(share, moves / moves.sum(axis=1, keepdims=True), emits)


#: Numbers of the counts that are summed in one place.
SLICE = 2048


def _slices(flat: np.ndarray) -> pa.RecordBatch:
    pieces = [flat[i : i + SLICE].tobytes() for i in range(0, len(flat), SLICE)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces))), pa.array(pieces, pa.binary())], ["i", "v"])


def _summed(parts: DataFrame, shapes: list[tuple[int, ...]]) -> list[np.ndarray] | None:
    """The sums of the arrays that tasks gave as slices (i, v), or none if there are no rows."""
    def add(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        i, v = rows.column("i").to_numpy(), rows.column("v").to_pylist()
        starts = group_starts([rows.column("i")])
        sums = [sum(np.frombuffer(x) for x in v[a:b]).tobytes() for a, b in zip(starts, [*starts[1:], len(v)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(i[starts]), pa.array(sums, pa.binary())], ["i", "v"])

    summed = sorted((r.i, r.v) for r in map_groups(parts, ["i"], add, "i long, v binary").collect())
    if not summed:
        return None
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    flat = np.concatenate([np.frombuffer(v) for _, v in summed])
    return [part.reshape(shape) for part, shape in zip(np.split(flat, cuts), shapes, strict=True)]


def _bag_sums(bags: DataFrame, measure: Callable[..., list[np.ndarray]], shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """The sums over all bags of the arrays that measure gives for a row of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = None
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                own = np.concatenate([np.ravel(x).astype(np.float64) for x in measure(*_bag(*row))])
                flat = own if flat is None else flat + own
        if flat is not None:
            yield _slices(flat)

    found = _summed(bags.mapInArrow(run, "i long, v binary"), shapes)
    return found or [np.zeros(s) for s in shapes]


def train_pass(coded: DataFrame, chain: Chain) -> Chain:
    """One pass of Baum-Welch over all training texts: counts by task, sums by slice."""
    k = len(chain.first)
    held = coded.sparkSession.sparkContext.broadcast(chain)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        first, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
        for batch in batches:
            for part in _portions(batch):
                a, b, c = baum_welch_counts(model, [_unpack(x).astype(np.int64) for x in part])
                first, moves, emits = first + a, moves + b, emits + c
        yield _slices(np.concatenate([first, moves.ravel(), emits.ravel()]))

    parts = coded.where(~F.col("held_out")).select("classes").mapInArrow(count, "i long, v binary")
    sums = _summed(parts, [(k,), (k, k), (CLASSES, k)])
    return chain if sums is None else estimate(*sums)


def _portions(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[list[bytes]]:
    """The last column's values, some megabytes at a time."""
    held, size = [], 0
    for value in batch.column(batch.num_columns - 1).to_pylist():
        held.append(value)
        size += len(value)
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def score(coded: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of every text."""
    held = coded.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "inner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            outer = []
            for part in _portions(batch):
                sequences = [_unpack(x).astype(np.int64) for x in part]
                log = np.zeros(len(sequences))
                for own, table, running in _sheets(sequences, len(model.first)):
                    log[own] = _forward(model, table, running, keep=False)[0]
                outer.append(log)
            inner = batch.column(5).to_numpy()
            total = (np.concatenate(outer) if outer else np.zeros(0)) + inner
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(total)], [*names[:5], "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return coded.select(*names, "classes").mapInArrow(run, schema)


def language_model_scores(docs: DataFrame, states: int = STATES, passes: int = PASSES, log: Callable[[str], None] | None = None) -> DataFrame:
    """Counts, trains and scores: score's columns and train_tokens; log gets a line for each step."""
    say = log or (lambda line: None)
    blocks = materialize(text_blocks(docs), "hmm-blocks")
    tokens = int(blocks.agg(F.sum("tokens")).first()[0] or 0)
    totals = materialize(word_totals(blocks, max(1, tokens)), "hmm-totals")
    words = facts(blocks, totals)
    say(f"{words.tokens} tokens, {words.distinct} distinct, {len(words.frequent)} frequent")
    coded = materialize(encode(blocks, totals, words), "hmm-coded")
    chain = initial(coded, states, log)
    for i in range(passes):
        chain = train_pass(coded, chain)
        say(f"pass {i + 1}: stay {np.diag(chain.moves).round(4)}")
    return score(coded, chain).withColumn("train_tokens", F.lit(words.tokens).cast("long"))


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
