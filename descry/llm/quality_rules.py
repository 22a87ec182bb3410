"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Null text: no words, so it fails. Empty text: the same. Null doc_id, repeated rows and extra
columns: a map, so each row is judged by itself and keeps its columns, but for those named like a
measure, base_failed or kept, which are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.llm._shared import fresh

SPACES = r"[\x20\x09-\x0D]+"
#: Symbols that are counted (fixed by the contract).
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on are by with this be as at from have or an not but "
    "der die das und ist von zu den mit für auf ein eine im dem nicht auch sich des als "
    "le la les et est de un une du dans que qui pour pas sur par au des en ne se "
    "el los las y es por con para su al lo del como más pero sus una no"
).split()
#: name, value, how it is compared for a text to pass, threshold.
RULES: tuple[tuple[str, str, str, float], ...] = (
    ("mean_word_chars", "word_chars / n_words", ">=", 2.0),
    ("mean_word_chars", "word_chars / n_words", "<=", 14.0),
    ("symbol_ratio", "n_symbols / n_words", "<=", 0.3),
    ("duplicate_line_ratio", "n_dup_lines / n_lines", "<=", 0.3),
    ("stop_word_ratio", "n_stop_words / n_words", ">=", 0.02),
)
#: Words of a window whose repetition counts, and the base rule (fixed by the contract).
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30


def let(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda variable, not an expression that is copied."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column) -> Column:
    """Words inside windows of 8 that the text has twice or more, the first included; windows are compared by 64-bit hashes of their words' hashes."""
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))

    def doubled(h: Column, by: int) -> Column:
        """The hash of twice as many words at each place: that of the words from there and of those `by` further on."""
        return F.zip_with(F.slice(h, 1, F.size(h) - by), F.slice(h, by + 1, F.size(h)), lambda x, y: F.xxhash64(x, y))

    def windows(h: Column) -> Column:
        return let(doubled(h, 1), lambda two: let(doubled(two, 2), lambda four: doubled(four, 4)))

    def marked(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twin = lambda s, x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i + 1 < F.size(s)) & (F.get(s, i + 1)["h"] == x["h"]))
        spots = let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: twin(s, x, i)), lambda x: x["p"])))
        gaps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return let(spots, lambda p: F.aggregate(gaps(p), F.lit(0).cast("long"), lambda a, g: a + g))

    none = F.lit(0).cast("long")
    found = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(marked(w))
    return F.when(F.size(words) < WINDOW + 1, none).otherwise(let(hashes(words), lambda h: let(windows(h), found)))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    (own,) = fresh(docs, "words")
    with_words = docs.withColumn(own, F.array_remove(F.split(text, SPACES), ""))
    words = F.col(own)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    count = lambda c: c.cast("long")
    stops = F.array(*map(F.lit, dict.fromkeys(STOP_WORDS)))
    return with_words.withColumns({
        "n_words": count(F.size(words)),
        "word_chars": count(F.length(F.array_join(words, ""))),
        "n_symbols": count(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))),
        "n_lines": count(F.size(lines)),
        "n_dup_lines": let(lines, lambda x: count(F.size(x) - F.size(F.array_distinct(x)))),
        "n_repeat_words": repeat_words(words),
        "n_stop_words": count(F.size(F.filter(words, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS))))),
    }).drop(own)


def verdict(rules: tuple[tuple[str, str, str, float], ...] = RULES) -> Column:
    """All rules hold; a ratio over nothing passes."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.expr(f"try_divide({value.split('/')[0]}, {value.split('/')[1]}) {how} {bound}"), F.lit(True)) for _, value, how, bound in rules))


def judge(docs: DataFrame, rules: tuple[tuple[str, str, str, float], ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with the measures, base_failed and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measures(docs, text_col).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))
