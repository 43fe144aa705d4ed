"""Mixing sources to target weights by entropy balancing.

Each source has a token constraint. Among all document rates between 0 and the cap that
meet it, entropy balancing takes those closest to one copy each in relative entropy: the
rates min(cap, exp(lambda * size / mean size)), with one dual variable per source. The
convex dual is solved by distributed Newton steps, kept inside a bracket; a step is one
aggregation over the (source, size) histogram, which has the documents' exact sums.

Rates become whole copies by systematic rounding along sizes in rising order, so that the
words a source gains or loses by rounding never exceed about one large document; a few
rounds that each move one copy in each source then settle the rest. Documents
of equal source and size are dealt over buckets of bounded size before ranks are taken, so
a source or size that holds most rows is never sorted in one task.

Null texts and texts without words have size 0 and are taken with 0 words. A null source is
a source of its own, the last in order. Repeated rows are documents of their own. Runs
agree whatever the layout of the files. An empty table gives an empty result. Columns other than
doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelith.llm.common import materialize, numbered, table, word_array

#: Documents of equal source and size that are ranked in one task.
BUCKET_ROWS = 8192
NEWTON_STEPS = 40
#: A source counts as solved within this share of its target.
TOLERANCE = 1e-6
#: Rounds of single copies moved after rounding.
SETTLE_ROUNDS = 4


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Targets by source: weights repeat in code point order, null last; a target stops at cap
    times its source, and what it leaves goes to the others by weight until none is above.

    sizes: source, source_size. The fill level is read off the sources in order of
    cap * size / weight, which is where each of them stops.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("ceiling", cap * F.col("source_size"))
    rising = W.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    rows = (
        rows.withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("below", F.coalesce(F.sum("ceiling").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("shares", F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("below")) / F.col("shares"))
    )
    stops = F.col("ceiling") / F.col("weight") >= F.col("level")
    level = F.min(F.when(stops, F.struct(F.col("below"), F.col("level")))).over(everything)["level"]
    rows = rows.withColumn("fill", level)
    target = F.when(F.col("fill").isNull(), F.col("ceiling")).otherwise(F.least("ceiling", F.col("fill") * F.col("weight")))
    return rows.select("source", "source_size", "weight", "ceiling", target.alias("target"))


def _solve(hist: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """The dual variable of each source: source, unit (mean size), dual, full (every copy taken)."""
    scale = hist.where("size > 0").groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("unit"), F.min("size").alias("least")
    )
    rate = F.col("target") / F.col("source_size")
    state = targets.join(scale, targets.source.eqNullSafe(scale.source)).select(
        targets.source, "source_size", "target", "unit",
        (F.col("target") >= F.col("ceiling") * (1 - 1e-12)).alias("full"),
        F.when(rate <= 1, F.log(rate) * F.col("unit") / F.col("least")).otherwise(F.lit(0.0)).alias("lo"),
        F.when(rate <= 1, F.lit(0.0)).otherwise(F.log(F.lit(cap)) * F.col("unit") / F.col("least")).alias("hi"),
    )
    state = state.withColumn("dual", F.lit(0.0)).withColumn("miss", F.lit(1.0))
    state = materialize(state, "mix-dual")
    for _ in range(NEWTON_STEPS):
        worst = state.where("not full").agg(F.max("miss")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
        u = F.col("size") / F.col("unit")
        tilt = F.exp(F.least(F.col("dual") * u, F.lit(700.0)))
        words = F.col("size") * F.col("n")
        sums = (
            hist.where("size > 0").join(state.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
            .groupBy("source")
            .agg(
                F.sum(words * F.least(F.lit(cap), tilt)).alias("got"),
                F.sum(F.when(tilt < cap, words * u * tilt).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("dual")).otherwise(F.col("lo"))
        hi = F.when(gap >= 0, F.col("dual")).otherwise(F.col("hi"))
        step = F.col("dual") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (step > lo) & (step < hi)
        solved = F.abs(gap) <= TOLERANCE * F.col("target")
        state = materialize(
            state.join(sums.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).select(
                "source", "source_size", "target", "unit", "full", lo.alias("lo"), hi.alias("hi"),
                F.when(solved | F.col("full"), F.col("dual")).when(inside, step).otherwise((lo + hi) / 2).alias("dual"),
                (F.abs(gap) / F.col("target")).alias("miss"),
            ),
            "mix-dual",
        )
    return state.select("source", "unit", "dual", "full")


def mix_rows(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """__row, doc_id, source, size, source_size, target, rate, copies, taken for every row of docs,
    which has a __row of its own."""
    sized = materialize(
        docs.select("__row", "doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("__hash")),
        "mix-sizes",
    )
    hist = materialize(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, cap), "mix-targets")
    duals = _solve(hist, targets, cap)

    raw = F.when(F.col("full"), F.lit(cap)).otherwise(
        F.least(F.lit(cap), F.exp(F.least(F.col("dual") * F.col("size") / F.col("unit"), F.lit(700.0))))
    )
    t = targets.select(F.col("source").alias("__t"), "source_size", "target")
    d = duals.withColumnRenamed("source", "__d")
    rates = (
        hist.join(t, F.col("source").eqNullSafe(F.col("__t")))
        .join(d, F.col("source").eqNullSafe(F.col("__d")), "left")
        .select(
            F.col("source").alias("__source"), F.col("size").alias("__size"), "source_size", "target",
            F.when(F.col("size") > 0, raw).otherwise(F.lit(1.0)).alias("rate"),
            F.ceil(F.col("n") / BUCKET_ROWS).alias("__buckets"),
        )
    )
    # The hash is of the contents, so that another file layout changes nothing; the row's place only
    # parts rows that are equal in both, of which it doesn't matter which is taken.
    keyed = sized.join(rates, F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")))
    dealt = materialize(
        keyed.withColumn("__bucket", F.pmod(F.col("__hash"), F.col("__buckets")))
        .select("__row", "doc_id", "source", "size", "source_size", "target", "rate", "__hash", "__bucket"),
        "mix-dealt",
    )
    part = F.col("rate") - F.floor("rate")
    along = W.partitionBy("source").orderBy("size", "__bucket").rowsBetween(W.unboundedPreceding, -1)
    start = (
        dealt.groupBy("source", "size", "__bucket").agg((F.count(F.lit(1)) * F.first(part)).alias("__add"))
        .withColumn("__start", F.coalesce(F.sum("__add").over(along), F.lit(0.0)))
        .select(F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("__bucket").alias("__b"), "__start")
    )
    rank = F.row_number().over(W.partitionBy("source", "size", "__bucket").orderBy("__hash", "__row"))
    ranked = dealt.withColumn("__rank", rank)
    on = F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")) & (F.col("__bucket") == F.col("__b"))
    upto = lambda k: F.floor(F.round(F.col("__start") + k * part, 9) + 0.5)
    copies = (F.floor("rate") + upto(F.col("__rank")) - upto(F.col("__rank") - 1)).cast("long")
    rounded = materialize(
        ranked.join(start, on).select(
            "__row", "doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "rate",
            copies.alias("copies"), "__hash",
        ),
        "mix-rounded",
    )
    return _settle(rounded, cap)


def _settle(rounded: DataFrame, cap: float) -> DataFrame:
    """Moves single copies until each source's words are within a few of its target.

    A round takes, for each source, the largest document not above what is still missing
    (or, if too much was taken, of those with a copy) and changes its copies by one.
    """
    need = rounded.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("need")
    )
    state = materialize(need.select("source", "need", *[F.lit(None).cast("long").alias(c) for c in ("s", "h", "r")]), "mix-need")
    picks = []
    for _ in range(SETTLE_ROUNDS):
        now = state.select(F.col("source").alias("__source"), "need", "s", "h", "r")
        free = F.when(F.col("need") > 0, F.col("copies") + 1 <= F.lit(cap)).otherwise(F.col("copies") >= 1)
        later = F.col("s").isNull() | (F.struct("size", "__hash", "__row") < F.struct("s", "h", "r"))
        pick = (
            rounded.join(now, F.col("source").eqNullSafe(F.col("__source")))
            .where((F.col("size") > 0) & (F.col("size") <= F.abs("need")) & free & later)
            .groupBy("source").agg(F.max(F.struct("size", "__hash", "__row")).alias("p"))
            .select(F.col("source").alias("__source"), "p")
        )
        state = materialize(
            state.join(pick, F.col("source").eqNullSafe(F.col("__source")), "left").select(
                "source", (F.col("need") - F.signum("need") * F.coalesce(F.col("p.size"), F.lit(0))).alias("need"),
                F.coalesce(F.col("p.size"), F.lit(-1)).cast("long").alias("s"), F.col("p.__hash").alias("h"), F.col("p.__row").alias("r"),
                F.signum("need").cast("long").alias("move"),
            ),
            "mix-need",
        )
        picks.append(state.where("s >= 0").select(F.col("source").alias("__source"), F.col("s").alias("__s"), F.col("r").alias("__r"), "move"))
    moves = picks[0]
    for more in picks[1:]:
        moves = moves.unionByName(more)
    on = F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__s")) & (F.col("__row") == F.col("__r"))
    copies = F.col("copies") + F.coalesce(F.col("move"), F.lit(0))
    return rounded.join(moves, on, "left").select(
        "__row", "doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for every document."""
    rows = numbered(docs.select("doc_id", "source", "text"))
    return mix_rows(rows, weights, share, cap).drop("__row")


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns."""
    rows = numbered(docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in docs.columns]).alias("__whole")))
    taken = mix_rows(rows.select("__row", "doc_id", "source", "text"), weights, share, cap).where("copies > 0")
    times = taken.select("__row", F.sequence(F.lit(1).cast("long"), "copies").alias("__times"))
    return rows.select("__row", "__whole").join(times, "__row").select("__whole", F.explode("__times")).select("__whole.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies"
    )
