"""Quality rules as one projection compiled from a threshold table.

``RULES`` names measures and the range in which a document passes.  The
measures are Spark expressions over the words and lines of the whole text; the
verdict is their conjunction.  There is no user function and no shuffle.

Defined results: a null text counts as an empty one and fails the base rule; a
measure whose denominator is zero passes; rows stay rows, whatever repeats; the
input's own columns are not looked at but for ``doc_id``, ``text``, ``lang``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

SYMBOLS = "#*$%&|<>"
# Frequent function words of four languages.
STOP_WORDS = {
    "en": "the of and to in is that was for on with at by from it an are this be as or not have has which",
    "fr": "de la le les des et un une que du en est pour dans qui par sur pas au avec ce il se",
    "de": "der die und das ist mit von den nicht ein eine zu im auf für sich dem des als auch es an",
    "es": "de la que el en y los las se del por con para una un su al es lo como más o",
}


@dataclass(frozen=True)
class Rule:
    """A document passes while ``low <= measure <= high``."""

    measure: str
    low: float = float("-inf")
    high: float = float("inf")


#: The threshold table.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", high=0.05),
    Rule("dup_line_ratio", high=0.6),
    Rule("stop_word_ratio", low=0.02),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _repeats(word: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more.

    Windows are compared by 64-bit hash.  Where all differ the count is 0;
    else they are sorted with their places, so that equal ones are neighbours,
    and each start covers what is left of its three words up to the next start.
    """
    starts = F.sequence(F.lit(0), F.size(word) - 3)
    tail = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
    pair = lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    equal = lambda s: F.flatten(F.filter(F.zip_with(s, tail(s), pair), lambda x: x.isNotNull()))
    step = lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))
    covered = lambda p: F.aggregate(F.zip_with(p, tail(p), step), F.lit(0), lambda n, x: n + x)

    def count(hashes):
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        found = let(F.sort_array(placed), equal)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(F.array_distinct(found)), covered))

    hashes = F.transform(starts, lambda i: F.xxhash64(word[i], word[i + 1], word[i + 2]))
    return F.when(F.size(word) < 3, F.lit(0)).otherwise(let(hashes, count))


def _is_stop_word(code: str):
    forms = [x for w in STOP_WORDS[code].split() for x in (w, w.capitalize())]
    return lambda w: w.isin(forms)


def measures(docs: DataFrame) -> DataFrame:
    """The counts of the base rule and the measures of the table, by row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    stop = F.lit(None).cast("int")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    out = docs.withColumns({"_w": words(text), "_l": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    for code in STOP_WORDS:
        stop = F.when(lang == code, F.size(F.filter("_w", _is_stop_word(code)))).otherwise(stop)
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_stop_words": stop.cast("long"),
            "n_repeat_words": let(F.col("_w"), _repeats).cast("long"),
        }
    )
    return out.drop("_w", "_l").withColumns(
        {
            "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": _ratio(F.col("n_symbols"), F.col("word_chars")),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "stop_word_ratio": _ratio(F.col("n_stop_words"), F.col("n_words")),
        }
    )


def verdict(rules=RULES) -> Column:
    """The table as one Boolean expression over the measures."""
    passes = F.lit(True)
    for r in rules:
        passes = passes & F.coalesce(F.col(r.measure).between(F.lit(r.low), F.lit(r.high)), F.lit(True))
    return passes


def judge(docs: DataFrame, rules=RULES, least_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept`` as new columns.

    They take the place of columns of these names; ``common.packed`` keeps those.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    return measures(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
