"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text, so the scan, the measures and
the verdict run in one stage without a shuffle and without user functions.

Null texts have no words. Empty and blank texts have no words and fail the base rules.
Repeated rows are judged each by themselves; extra columns of the input are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm.common import SPACE_CHARS, pinned, table, word_array

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Function words of the corpus languages, as they stand inside a sentence. Matching is
#: by exact case: running prose has them in lower case, shouted text does not.
STOP_WORDS = {
    "en": ("the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "a", "for", "on", "it"),
    "de": ("der", "die", "und", "das", "den", "zu", "ist", "ein", "mit", "nicht", "von", "eine", "auf"),
    "fr": ("le", "la", "de", "et", "les", "des", "en", "un", "une", "du", "que", "dans", "qui", "est"),
    "es": ("el", "la", "de", "que", "y", "en", "los", "las", "un", "por", "con", "para", "del", "se"),
}

#: A bullet opens a line with one of these.
BULLETS = "^[ \\t-\\r]*[-•*‣▪●]"
ELLIPSIS = "(\\.\\.\\.|…)[ \\t-\\r]*$"


@dataclass(frozen=True)
class Rule:
    """A measure must lie within [low, high]; None leaves a side open."""

    name: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are over words, lines or word characters as named.
THRESHOLDS = (
    Rule("n_words", low=50, high=1_000_000),
    Rule("mean_word_chars", low=2.5, high=12.0),
    Rule("symbols_per_word", high=0.1),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
    Rule("dup_line_ratio", high=0.6),
    Rule("stop_word_kinds", low=2),
    Rule("stop_word_ratio", low=0.02),
)

#: Measures that the contract fixes: fewer words fail, and a larger share in repeated windows.
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50


def _repeat_words(words: str, grams: str) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Texts whose windows all differ, by far the most,
    cost one hash set; otherwise windows are sorted with their places, those equal to a
    neighbour are kept, and each kept start covers up to three words before the next.
    """
    return F.expr(
        f"""
        case when size(array_distinct({grams})) = size({grams}) then 0L else
          aggregate(
            array(sort_array(transform({grams}, (h, i) -> struct(h as h, i as i)))),
            0L,
            (total, s) -> aggregate(
              array(sort_array(transform(
                filter(s, (x, j) -> coalesce(get(s, j - 1).h = x.h, false) or coalesce(get(s, j + 1).h = x.h, false)),
                x -> x.i))),
              0L,
              (t, p) -> aggregate(
                transform(p, (a, k) -> least(3, coalesce(get(p, k + 1) - a, 3))),
                0L, (u, d) -> u + d)))
        end
        """
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures of THRESHOLDS and of the base rules to the documents.

    Columns added: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)
    and the ratios named in THRESHOLDS (double). Input columns of those names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    stop = F.array(*[F.lit(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws})])
    step = docs.withColumns(
        {
            "__words": word_array(F.col(text)),
            "__lines": F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""),
            "word_chars": F.length(F.translate(whole, SPACE_CHARS, "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        }
    )
    step = step.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__grams": F.expr(
                "case when size(__words) < 3 then cast(array() as array<bigint>) else "
                "transform(sequence(0, size(__words) - 3), "
                "i -> xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2))) end"
            ),
            "__stops": F.size(F.array_intersect("__words", stop)),
            "__stop_words": F.size(F.filter("__words", lambda w: w.isin(*[w for ws in STOP_WORDS.values() for w in ws]))),
            "__bullets": F.size(F.filter("__lines", lambda x: x.rlike(BULLETS))),
            "__ellipses": F.size(F.filter("__lines", lambda x: x.rlike(ELLIPSIS))),
        }
    )
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    replaced = {"n_repeat_words", *[r.name for r in THRESHOLDS]} - {"n_words"}
    return pinned(
        step.drop(*replaced),
        **{
            "n_repeat_words": _repeat_words("__words", "__grams"),
            "mean_word_chars": F.col("word_chars") / words,
            "symbols_per_word": F.col("n_symbols") / words,
            "bullet_line_ratio": F.col("__bullets") / lines,
            "ellipsis_line_ratio": F.col("__ellipses") / lines,
            "dup_line_ratio": F.col("n_dup_lines") / lines,
            "stop_word_kinds": F.col("__stops").cast("double"),
            "stop_word_ratio": F.col("__stop_words") / words,
        }
    ).drop("__words", "__lines", "__grams", "__stops", "__stop_words", "__bullets", "__ellipses")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean column that holds when every rule does."""
    kept = F.lit(True)
    for rule in rules:
        value = F.col(rule.name)
        if rule.low is not None:
            kept = kept & (value >= F.lit(rule.low))
        if rule.high is not None:
            kept = kept & (value <= F.lit(rule.high))
    return kept


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The documents with their measures, base_failed and kept."""
    measured = measure(docs, text)
    base_failed = (F.col("n_words") < BASE_MIN_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return measured.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "stop_word_kinds", "stop_word_ratio", "symbols_per_word", "dup_line_ratio",
    )


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    verdict = " AND ".join(
        c
        for r in THRESHOLDS
        for c in (
            [f"{r.name} >= {r.low}"] * (r.low is not None) + [f"{r.name} <= {r.high}"] * (r.high is not None)
        )
    )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d
), g AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT rid, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(list_aggregate(words, 'string_agg', ''))::BIGINT AS word_chars0,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[ \\t-\\r]*[-•*‣▪●]')))
      / greatest(len(lines), 1)::DOUBLE AS bullet_line_ratio,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t-\\r]*$')))
      / greatest(len(lines), 1)::DOUBLE AS ellipsis_line_ratio,
    len(list_distinct(list_filter(words, lambda x: x IN ({stop}))))::DOUBLE AS stop_word_kinds,
    len(list_filter(words, lambda x: x IN ({stop}))) / greatest(len(words), 1)::DOUBLE AS stop_word_ratio,
    len(lines) AS n_lines
  FROM w LEFT JOIN covered c USING (rid)
), r AS (
  SELECT *, coalesce(word_chars0, 0) AS word_chars,
    coalesce(word_chars0, 0) / greatest(n_words, 1)::DOUBLE AS mean_word_chars,
    n_symbols / greatest(n_words, 1)::DOUBLE AS symbols_per_word,
    n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio,
    n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {verdict} AS kept,
  stop_word_kinds, stop_word_ratio, symbols_per_word, dup_line_ratio
FROM r
"""


SQL = _sql()
