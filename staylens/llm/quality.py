"""Quality rules: a table of thresholds compiled into one projection.

Each text is measured in its own row: lengths, symbols, stop words, repeated lines and repeated
three-word windows are array expressions over its words and lines, so there is no user function and
no shuffle, and one text never meets another.

A null text counts as the empty text; an empty text has no words and fails. Copies and equal ids are
judged one by one and alike. Extra columns of any name are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import filled, let, total, words_of

# Symbols counted, and the base rules.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50  # in a hundred words

# Frequent words of English, German, French and Spanish.
STOP_WORDS = [
    "a", "and", "are", "as", "at", "be", "for", "from", "in", "is", "it", "of", "on", "or", "that",
    "the", "this", "to", "was", "with",
    "auf", "das", "der", "die", "den", "ein", "eine", "im", "ist", "mit", "nicht", "und", "von",
    "zu",
    "au", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour",
    "que", "sur", "un", "une",
    "con", "el", "es", "las", "los", "no", "por", "se", "su", "una", "y",
]


@dataclass(frozen=True)
class Threshold:
    """A measure and the range, ends included, in which a text is kept."""

    measure: str
    least: float | None = None
    most: float | None = None


# Ratios to words, or to lines with a word.
THRESHOLDS = (
    Threshold("mean_word_length", 1.5, 25.0),
    Threshold("symbol_ratio", most=0.1),
    Threshold("stop_word_ratio", least=0.01),
    Threshold("duplicate_line_ratio", most=0.5),
    Threshold("bullet_line_ratio", most=0.9),
)


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three words that the text holds twice or more.

    Windows are sorted by their hash; those whose hash recurs are sorted again by their words, so
    that a chance collision of hashes is no repeat.
    """

    def recurring(pairs: Column) -> Column:
        return F.filter(
            pairs,
            lambda x, j: (x["k"] == F.get(pairs, j - 1)["k"])
            | (x["k"] == F.get(pairs, j + 1)["k"]),
        )

    def window(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)])

    def exact(candidates: Column) -> Column:
        named = F.transform(candidates, lambda x: F.struct(window(x["i"]).alias("k"), x["i"].alias("i")))
        return let(F.sort_array(named), recurring)

    def covered(places: Column) -> Column:
        steps = F.transform(
            places,
            lambda p, j: F.coalesce(
                F.least(F.lit(WINDOW), F.get(places, j + 1) - p), F.lit(WINDOW)
            ),
        )
        return total(steps)

    def places(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("k"), i.alias("i"))))
        found = exact(let(pairs, recurring))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    first = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    hashed = F.transform(
        first, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)])
    )
    return let(
        hashed,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            places(h)
        ),
    )


def measures(text: Column) -> Column:
    """A struct of all measures of one text; the counts are exact, over the whole text."""

    def of(words: Column, lines: Column) -> Column:
        stop = F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))
        # The letters of the words are what is left without white space.
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(filled(text), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            stop.cast("long").alias("n_stop_words"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]")))
            .cast("long")
            .alias("n_bullet_lines"),
        )

    lines = F.filter(
        F.split(filled(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    )
    return let(words_of(text), lambda words: let(lines, lambda x: of(words, x)))


def ratios(m: Column) -> dict[str, Column]:
    """The measures that thresholds can name; a ratio to nothing is null."""
    return {
        "mean_word_length": F.try_divide(m["word_chars"], m["n_words"]),
        "symbol_ratio": F.try_divide(m["n_symbols"], m["n_words"]),
        "stop_word_ratio": F.try_divide(m["n_stop_words"], m["n_words"]),
        "duplicate_line_ratio": F.try_divide(m["n_dup_lines"], m["n_lines"]),
        "bullet_line_ratio": F.try_divide(m["n_bullet_lines"], m["n_lines"]),
    }


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (
        100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"]
    )


def passes(m: Column, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """The table compiled into one condition. A measure that is null fails its rule."""
    values = ratios(m)
    held = F.lit(True)
    for rule in thresholds:
        value = values[rule.measure]
        if rule.least is not None:
            held = held & F.coalesce(value >= rule.least, F.lit(False))
        if rule.most is not None:
            held = held & F.coalesce(value <= rule.most, F.lit(False))
    return held


def judged(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", thresholds=THRESHOLDS
) -> DataFrame:
    """Per row: the id, the measures, whether a base rule failed and whether the text is kept."""
    measured = docs.select(F.col(id_column), measures(F.col(text)).alias("m"))
    failed = base_failed(F.col("m"))
    return measured.select(
        id_column,
        *[F.col("m")[k].alias(k) for k in MEASURES],
        *[v.alias(k) for k, v in ratios(F.col("m")).items()],
        failed.alias("base_failed"),
        (~failed & passes(F.col("m"), thresholds)).alias("kept"),
    )


MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_stop_words",
    "n_bullet_lines",
)


def kept_only(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows whose text passes, with their own columns."""
    verdict = let(measures(F.col(text)), lambda m: ~base_failed(m) & passes(m, thresholds))
    return docs.filter(verdict)
