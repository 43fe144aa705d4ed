"""Quality classifier: random Fourier features, ridge normal equations, isotonic calibration.

Each whole text becomes a vector of document statistics (built-in expressions). Random
Fourier features approximate a Gaussian kernel over the standardised statistics. Every
partition sums its part of the normal equations, the sums meet by matrix row, and ridge
scores follow from one small solve. Scores of training rows that the solve has not seen
are calibrated by isotonic regression.

Labels are learned from at most FIT_ROWS labelled rows, chosen by a hash of doc_id; the
statistics, the scores and everything else cover all documents whole.

Null texts count as empty; empty texts are scored like any other. Rows with a null doc_id
are scored, are not held out and take no part in learning. Label rows with a null doc_id or
a quality other than 0 and 1 are ignored; repeated label rows count once each; repeated
documents are scored each. Without labels of both kinds every score is the labels' mean, or
0.5 without labels. An empty table gives an empty result. Statistics use the text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm.common import SPACE_CHARS, map_groups, marked, materialize, numbered, pinned, table, temporary, word_array
from voxelith.llm.quality_rules import STOP_WORDS

#: At most about so many labelled rows are learned from.
FIT_ROWS = 200_000
FIT_PARTITION_ROWS = 25_000
FEATURES = 256
#: Width of the Gaussian kernel in standard deviations, for each root of the dimension.
WIDTH = 1.0
RIDGE = 1e-3
SEED = 20_240_601
#: Raw scores meet in bins of this width before calibration.
BIN = 1e-3
THRESHOLD = 0.3

UPPER = "".join(map(chr, range(0x41, 0x5B))) + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
LOWER = "".join(map(chr, range(0x61, 0x7B))) + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
DIGITS = "0123456789"
SYMBOLS = "#*$%&<>@^_~=+\\/{}[]"
MARKS = "!?"
STOPS = ".,;:"
BAR = "|"


def with_statistics(docs: DataFrame, text: str = "text", name: str = "__stats") -> DataFrame:
    """Adds the document statistics as array<double>."""
    whole = F.coalesce(F.col(text), F.lit(""))
    inner = docs.withColumns(
        {
            "__t": whole,
            "__w": word_array(F.col(text)),
            "__l": F.split(whole, "\n"),
        }
    )
    words = sorted({w for ws in STOP_WORDS.values() for w in ws})
    inner = inner.withColumns(
        {
            "__chars": F.length("__t"),
            "__n": F.size("__w"),
            "__lines": F.size("__l"),
            "__distinct_lines": F.size(F.array_distinct("__l")),
            "__distinct": F.size(F.array_distinct("__w")),
            "__stop": F.size(F.filter("__w", lambda w: w.isin(*words))),
            "__spaces": F.length("__t") - F.length(F.translate("__t", SPACE_CHARS, "")),
            "__grams": F.expr(
                "case when size(__w) < 3 then 0 else size(array_distinct(transform(sequence(0, size(__w) - 3), "
                "i -> xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2))))) end"
            ),
        }
    )
    chars = F.greatest(F.col("__chars"), F.lit(1)).cast("double")
    n = F.greatest(F.col("__n"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("__lines"), F.lit(1)).cast("double")

    def share(of: str) -> Column:
        return (F.col("__chars") - F.length(F.translate("__t", of, ""))) / chars

    stats = F.array(
        F.log1p("__chars").cast("double"),
        F.log1p("__n").cast("double"),
        (F.col("__chars") - F.col("__spaces")) / n,
        share(UPPER), share(LOWER), share(DIGITS), share(SYMBOLS), share(MARKS), share(STOPS), share(BAR),
        F.col("__distinct") / n,
        F.when(F.col("__n") < 3, F.lit(1.0)).otherwise(F.col("__grams") / (F.col("__n") - 2)),
        F.col("__stop") / n,
        F.log1p(F.col("__chars") / lines),
        F.col("__distinct_lines") / lines,
        F.log1p("__lines").cast("double"),
    )
    return pinned(inner, **{name: stats}).select(*docs.columns, name)


@dataclass(frozen=True)
class Model:
    """Everything a score needs; a few hundred kilobytes at most."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    constant: float | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1])
        return np.concatenate([wave, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        raw = self.raw(stats)
        level = np.interp(raw, self.knots, self.values)
        # A thousandth of the raw order keeps documents of one isotonic block apart.
        return 0.999 * level + 0.001 / (1 + np.exp(-8 * np.clip(raw - 0.5, -4, 4)))


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over rising x: block centres and their means."""
    blocks: list[list[float]] = []
    for at, total, weight in zip(x, y, n, strict=True):
        blocks.append([at * weight, total, weight])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _stack(column: pd.Series | pa.ChunkedArray) -> np.ndarray:
    return np.array(list(column), dtype=np.float64) if len(column) else np.empty((0, 0))


def fit(stats: DataFrame, labels: DataFrame, learn: Column, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from labels (doc_id, quality) the model over stats (doc_id, __stats); learn, a
    condition on doc_id, keeps held-out rows away."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & learn).select(
        "doc_id", F.col("quality").cast("double").alias("y")
    )
    total = marks.count()
    share = min(1.0, fit_rows / max(1, total))
    marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * share))
    rows = materialize(
        stats.join(marks, "doc_id").select(
            F.col("__stats").alias("x"), "y", (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0).alias("c")
        ),
        "classifier-rows",
    )
    kinds = rows.agg(F.count("*"), F.sum("y")).first()
    empty = np.zeros(0)
    if not kinds[0] or kinds[1] in (0, kinds[0]):
        constant = float(kinds[1] / kinds[0]) if kinds[0] else 0.5
        return Model(empty, empty, empty, empty, empty, empty, empty, constant)
    size = len(rows.select("x").first()[0])
    moments = rows.agg(
        *[F.avg(F.col("x")[i]) for i in range(size)], *[F.stddev_pop(F.col("x")[i]) for i in range(size)]
    ).first()
    mean, scale = np.array(moments[:size]), np.array(moments[size:])
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(SEED)
    omega = rng.standard_normal((size, FEATURES)) / (WIDTH * np.sqrt(size))
    blank = Model(mean, scale, omega, rng.uniform(0, 2 * np.pi, FEATURES), empty, empty, empty)
    wide = FEATURES + 2

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((FEATURES + 1, wide))
        for frame in frames:
            if len(frame):
                z = blank.features(_stack(frame["x"]))
                sums += z.T @ np.concatenate([z, frame["y"].to_numpy()[:, None]], axis=1)
        yield pd.DataFrame({"i": np.arange(len(sums)), "v": list(sums)})

    def meet(parts: pa.Table) -> Iterator[pa.RecordBatch]:
        i = parts.column("i").to_numpy()
        v = parts.column("v").combine_chunks().values.to_numpy().reshape(len(i), wide)
        names, at = np.unique(i, return_inverse=True)
        out = np.zeros((len(names), wide))
        np.add.at(out, at, v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(list(out), pa.list_(pa.float64()))], ["i", "v"]
        )

    tasks = max(1, -(-min(total, fit_rows) // FIT_PARTITION_ROWS))
    parts = rows.where(~F.col("c")).select("x", "y").coalesce(tasks).mapInPandas(partial, "i long, v array<double>")
    summed = sorted((r.i, r.v) for r in map_groups(parts, ["i"], meet, "i long, v array<double>").collect())
    normal = np.array([v for _, v in summed])
    gram, right = normal[:, :-1], normal[:, -1]
    seen = max(1.0, gram[-1, -1])
    weights = np.linalg.solve(gram + RIDGE * seen / FEATURES * np.diag([1.0] * FEATURES + [0.0]) + 1e-9 * np.eye(FEATURES + 1), right)
    ridge = Model(mean, scale, omega, blank.phase, weights, empty, empty)

    @F.pandas_udf("double")
    def raw(x: pd.Series) -> pd.Series:
        return pd.Series(ridge.raw(_stack(x)))

    held = rows.where("c").withColumn("at", F.round(raw("x") / BIN) * BIN).groupBy("at").agg(F.sum("y"), F.count("*"))
    bins = np.array(sorted(tuple(r) for r in held.collect()), dtype=np.float64).reshape(-1, 3)
    knots, values = isotonic(bins[:, 0], bins[:, 1], bins[:, 2]) if len(bins) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return Model(mean, scale, omega, blank.phase, weights, knots, values)


def scorer(model: Model):
    """A column function from statistics to the calibrated score."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(_stack(x)) if len(x) else np.zeros(0))

    return score


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is a multiple of 5; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = materialize(with_statistics(docs.select("doc_id", "text")).select("doc_id", "__stats"), "classifier-stats")
    model = fit(stats, labels, ~held_out(F.col("doc_id")))
    scored = stats.withColumn("score", scorer(model)("__stats"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""
    # The row travels as one struct, so that its column names cannot clash with the measures.
    rows = numbered(docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("__whole")))
    with temporary() as keep:
        stats = materialize(with_statistics(rows.select("__row", "doc_id", "text")).select("__row", "doc_id", "__stats"), "classifier-stats")
        model = fit(stats.select("doc_id", "__stats"), labels, ~held_out(F.col("doc_id")))
        good = F.coalesce(scorer(model)("__stats") >= threshold, F.lit(False))
        gone = keep(materialize(stats.select("__row", good.alias("good")).where("not good").select("__row"), "classifier-gone"))
    # Rows that stay, as the bitmap shows for most of them, skip the shuffle.
    found = marked(rows.select("__row", "__whole"), gone)
    sure = found.where("not __maybe").select("__whole")
    others = found.where("__maybe").select("__row", "__whole").join(gone, "__row", "left_anti").select("__whole")
    return sure.unionByName(others).select("__whole.*")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
