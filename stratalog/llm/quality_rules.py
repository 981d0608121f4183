"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

All measures are Spark expressions over one row; nothing is shuffled and no user function runs.

Repeated 5-word windows are found by 64-bit hashes within one text.  A text of n words holds a false repeat with a
probability of about n*n / 2**65.

Defined results: a null or empty text has no words, all counts 0, base_failed true and kept false.  Ratios of a text
without words are 0.  Repeated rows are judged alike.  Further columns pass through `judge_quality`, whatever
their names, unless they bear one it adds, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import SPACE_CHARS, SPACE_CLASS, others, quoted, unused

WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "was", "with",
    "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "auf", "im", "auch",
    "au", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "pas", "pour", "que", "qui",
    "sur", "un", "une",
    "con", "del", "el", "las", "lo", "los", "no", "para", "por", "se", "su", "una", "y",
)

#: (measure, least, most); None leaves a side open.  A text is kept if all hold.
THRESHOLDS = (
    ("n_words", 10, None),
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_ratio", None, 0.1),
    ("emphasis_ratio", None, 0.3),
    ("capital_ratio", None, 0.5),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.3),
    ("repeat_ratio", None, 0.2),
)

_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))


def _only(text: Column, keep: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", ""))


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, of that name: the counts of the contract and those that the measures need."""
    named = unused(docs, "_text", "_w", "_lines", "_win", "_repeats", "_at", "_places", "_counts")
    text_, w_, lines_, win_, repeats_, at_, places_, counts_ = named
    t = F.col(text_)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    w = F.col(w_)
    n = F.size(w)
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    first = (
        docs.withColumn(text_, F.coalesce(quoted(text), F.lit("")))
        .withColumn(w_, _words(t))
        .withColumn(lines_, lines)
        .withColumn(win_, windows)
        .withColumn(repeats_, F.size(win_) > F.size(F.array_distinct(win_)))
        .withColumn(at_, F.when(F.col(repeats_), F.array_sort(F.transform(win_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    )
    at, m = F.col(at_), F.size(at_)
    # Of equal windows, which now stand side by side, all places; then the words that these windows cover.
    same = lambda a, b: F.get(at, a)["h"] == F.get(at, b)["h"]
    places = F.sort_array(
        F.transform(
            F.filter(F.sequence(F.lit(0), m - 1), lambda k: ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))) | ((k < m - 1) & same(k, F.least(k + 1, m - 1)))),
            lambda k: F.get(at, k)["i"],
        )
    )
    second = first.withColumn(places_, F.when(F.col(repeats_), places))
    covered = F.aggregate(
        places_,
        F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda s, p: F.struct((s["sum"] + F.least(F.lit(WINDOW), p - s["last"])).alias("sum"), p.alias("last")),
        lambda s: s["sum"],
    )
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, f"[{SPACE_CLASS}]+", "")).cast("long").alias("word_chars"),
        _only(t, "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines_).alias("_n_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS)))).alias("_n_stop"),
        _only(t, "!?").alias("_n_emphasis"),
        _only(t, r"\p{L}").alias("_n_letters"),
        _only(t, r"\p{Lu}").alias("_n_capitals"),
    )
    # Through explode, so that a later filter on the counts is not pushed below them, which would copy these expressions many times.
    return second.select(*map(quoted, others(docs, *_NAMES)), F.explode(F.array(counts)).alias(counts_)), counts_


def measures(counts: Column) -> dict[str, Column]:
    per = lambda a, b: F.when(counts[b] > 0, counts[a] / counts[b]).otherwise(F.lit(0.0))
    return {
        "n_words": counts["n_words"],
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "emphasis_ratio": per("_n_emphasis", "n_words"),
        "capital_ratio": per("_n_capitals", "_n_letters"),
        "stop_word_ratio": per("_n_stop", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "_n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
    }


def compiled(counts: Column, thresholds=THRESHOLDS) -> Column:
    """The threshold table as one condition."""
    known, holds = measures(counts), F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            holds = holds & (known[name] >= least)
        if most is not None:
            holds = holds & (known[name] <= most)
    return holds


def judge_quality(docs: DataFrame, *, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept."""
    counted, name = measured(docs, text)
    counts = F.col(name)
    failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
    told = [counts[c].alias(c) for c in _NAMES[:5]]
    return counted.select(*map(quoted, others(docs, *_NAMES)), *told, failed.alias("base_failed"), (~failed & compiled(counts, thresholds)).alias("kept"))
