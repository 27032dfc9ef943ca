"""Document statistics as DataFrame expressions; no Python runs on executors.

Null text counts as empty. Whole texts are scanned. Words are maximal runs of
characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once per row and use it many times inside body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def occurrences(text: Column, chars: str) -> Column:
    """How many characters of text are among chars, which are single bytes in UTF-8."""
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(left)).cast("long")


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _text (no nulls), _words, _hashes (a 64-bit hash of each word)."""
    return (
        docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("_words", words(F.col("_text")))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    )


def n_words() -> Column:
    return F.size("_words").cast("long")


def word_chars() -> Column:
    return F.char_length(F.array_join("_words", "")).cast("long")


def n_symbols() -> Column:
    return occurrences(F.col("_text"), SYMBOLS)


def n_dup_lines() -> Column:
    """Lines that hold a word and equal an earlier line."""
    lines = F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return let(lines, lambda held: F.size(held) - F.size(F.array_distinct(held))).cast("long")


def n_lines() -> Column:
    return F.size(F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")).cast("long")


def n_adjacent_repeats() -> Column:
    """Words equal to the word before them."""
    return F.size(F.filter("_hashes", lambda h, i: (i > 0) & (h == F.get("_hashes", i - 1)))).cast("long")


def n_distinct_words() -> Column:
    return F.size(F.array_distinct("_hashes")).cast("long")


def windows(width: int = 8) -> Column:
    """A 64-bit hash of every window of so many words, from _hashes."""
    last = F.size("_hashes") - width
    hashed = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(width))))
    return F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>"))


def n_repeat_words(width: int = 8) -> Column:
    """Words inside windows that occur twice or more, from _windows.

    A text without a repeated window (one hash set tells) costs no more; else
    windows are sorted by hash, so that equal ones are neighbours, and the
    union of their spans is counted in order of position.
    """

    def repeated(ranked: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(ranked, j)["h"] == x["h"], F.lit(False))
        twins = F.filter(ranked, lambda x, j: same(x, j + 1) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))))
        return F.sort_array(F.transform(twins, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("at"))
        return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])

    ranked = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    counted = let(ranked, lambda r: covered(repeated(r)))
    return F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0)).otherwise(counted).cast("long")


def only(rows: DataFrame, keep: Column) -> DataFrame:
    """rows.filter(keep) with keep computed after the columns it reads.

    A plain filter would be pushed below them and repeat their expressions for
    every use; one that depends on a row's place stays where it is.
    """
    return rows.withColumn("_kept", F.when(keep, F.monotonically_increasing_id())).filter(F.col("_kept").isNotNull()).drop("_kept")
