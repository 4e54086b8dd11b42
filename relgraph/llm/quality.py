"""Quality rules: a threshold table compiled into one projection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.llm.common import SPACE, let


class Rule(NamedTuple):
    """Keep a document only while ``low <= feature <= high``; a null feature passes."""

    feature: str
    low: float | None = None
    high: float | None = None


#: Frequent function words by language; a text in another language is not held to the stop-word rule.
STOP_WORDS = {
    "en": "the of and to in is that it for on with as are this be by at or an a was from".split(),
    "fr": "le la les de des du un une et est en que qui dans pour sur pas au avec ce".split(),
    "de": "der die das und ist in zu den von mit sich auf für nicht ein eine dem im als auch".split(),
    "es": "el la los las de del un una y es en que por con para se no su al lo".split(),
}

RULES = (
    Rule("mean_word_length", 2.5, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
)


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window which occurs twice or more in the text.

    Windows are compared by 64-bit hashes. Texts without a repeated window, most of
    them, stop after one hash set; the others sort their windows once.
    """

    def windows(w):
        n = F.size(w) - 2
        two = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(two, F.slice(w, 3, n), lambda a, b: F.xxhash64(a, b))

    def covered(hashes):
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spread(s):
            same = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: a.h == b.h)
            return let(same, lambda e: F.zip_with(
                s,
                F.zip_with(F.concat(e, F.array(F.lit(False))), F.concat(F.array(F.lit(False)), e), lambda a, b: a | b),
                lambda x, d: F.when(d, x.i),
            ))

        places = F.array_sort(F.array_compact(let(ordered, spread)))
        return let(places, lambda p: F.aggregate(
            F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(3))),
            F.lit(3), lambda total, x: total + x,
        ))

    counted = let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted).cast("long")


def features(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with counts and ratios of whole texts; built-in functions only.

    Null texts count as empty; ratios over nothing are null. A null or unknown
    language has no stop-word ratio.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    language = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    split = docs.withColumns({
        "_words": F.filter(F.split(whole, SPACE), lambda w: w != ""),
        "_lines": F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })
    words, lines = F.col("_words"), F.col("_lines")
    stop = F.lit(None).cast("long")
    for name, listed in STOP_WORDS.items():
        known = F.array(*map(F.lit, listed))
        stop = F.when(language == name, F.size(F.filter(words, lambda w: F.array_contains(known, F.lower(w))))).otherwise(stop)
    counted = split.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda total, w: total + F.length(w)),
        "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "_stop": stop,
    }).drop("_words", "_lines")
    n = F.nullif(F.col("n_words"), F.lit(0))
    return counted.withColumns({
        "mean_word_length": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "stop_word_ratio": F.col("_stop") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)),
    }).drop("_stop")


def compiled(rules=RULES) -> Column:
    """The threshold table as one boolean expression."""
    verdict = F.lit(True)
    for rule in rules:
        value = F.col(rule.feature)
        if rule.low is not None:
            verdict = verdict & F.coalesce(value >= rule.low, F.lit(True))
        if rule.high is not None:
            verdict = verdict & F.coalesce(value <= rule.high, F.lit(True))
    return verdict


def judge(docs: DataFrame, rules=RULES, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with features, ``base_failed`` and ``kept``.

    One narrow projection, no shuffle: every row of the input, repeated ones too,
    gives one row. The base rule fails texts of under 50 words, and texts with over
    half of their words in repeated three-word windows. Columns of the input whose
    names are those of features are replaced.
    """
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return features(docs, text, lang).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compiled(rules))
