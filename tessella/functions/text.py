"""Words, white space and readability as native expressions. Every function takes and returns a Column; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, for both regex dialects that Spark and the SQL oracle use.
WS = r"[\s\x{0B}\x{85}\p{Z}]"
#: Words: one Han or Hiragana character; a Katakana run; a run of letters, marks and digits of other scripts, which may hold a mark inside.
_RUN = r"[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}\p{IsThai}\p{IsHangul}\p{M}\p{N}_]"
WORD = r"[\p{IsHan}\p{IsHiragana}]|\p{IsKatakana}+|" + _RUN + r"+(?:[.'’:·]" + _RUN + "+)*"

#: Stop words and least lengths of the three Latin filters (fixed values).
LATIN_DEFAULT = (3, "the and or but in on at to for of with by".split())
LATIN_BASIC = (3, "the and or but in on at to for of with by is are was were".split())
LATIN_ENHANCED = (
    4,
    "the and or but in on at to for of with by is are was were be been have has had this that these those a an as if then than when where why how what who which will would can could should may might must shall".split(),
)
#: Phrases that lower the quality score (fixed values).
SPAM_PHRASES = ["click here", "buy now", "limited time", "act fast", "lorem ipsum"]


def trimmed(t: Column) -> Column:
    return F.regexp_replace(t, f"^{WS}+|{WS}+$", "")


def squeezed(t: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(t, f"{WS}+", " "))


def tokens(t: Column) -> Column:
    """Pieces between white space; no empty ones."""
    return F.filter(F.split(F.regexp_replace(t, f"{WS}+", " "), " ", -1), lambda x: x != "")


def words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1))


def count_words(t: Column) -> Column:
    """Words that hold a letter or digit."""
    return F.size(F.filter(words(t), lambda w: w.rlike(r"[\p{L}\p{N}]"))).cast("long")


def latin_filter(t: Column, least: int, stop: list[str], drop_numbers: bool = True) -> Column:
    """Keeps words of at least so many bytes that are no stop words and, if asked for, not all digits; a text without words stays."""
    found = words(t)

    def keep(w: Column) -> Column:
        ok = (F.octet_length(w) >= least) & ~F.lower(w).isin(stop)
        return ok & ~w.rlike(r"^\p{N}+$") if drop_numbers else ok

    return F.when(F.size(found) == 0, t).otherwise(F.array_join(F.filter(found, keep), " "))


def reading_seconds(n_words: Column) -> Column:
    return n_words.cast("double") / F.lit(225.0) * F.lit(60.0)


def difficulty(t: Column) -> Column:
    """By the mean length of the tokens, in characters."""
    each = tokens(t)
    n = F.size(each)
    mean = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).cast("double") / n
    return F.when(t.isNull(), None).when(n == 0, "Unknown").when(mean < 4.0, "Easy").when(mean < 5.5, "Medium").when(mean < 7.0, "Hard").otherwise("VeryHard")


def quality(t: Column) -> dict[str, Column]:
    """length, words, mean word length, unique words, spam phrases, score in 0..1. Lengths are bytes."""
    each = tokens(t)
    n, length = F.size(each).cast("long"), F.octet_length(t).cast("long")
    unique = F.size(F.array_distinct(each)).cast("long")
    total = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    mean = F.when(n > 0, total.cast("double") / n).otherwise(0.0)
    low = F.lower(t)
    spam = sum((F.when(low.contains(p), 1).otherwise(0) for p in SPAM_PHRASES), F.lit(0)).cast("long")
    point = lambda c: F.when(c, 0.1).otherwise(0.0)
    score = (
        point(length > 100) + point(length > 500) + point(length > 1000) + point(n > 20) + point(n > 50)
        + F.when(n > 0, unique.cast("double") / n).otherwise(0.0) * 0.3 + point(mean > 4.0) + point(mean > 5.0) - spam * F.lit(0.2)
    )
    return {"length": length, "word_count": n, "avg_word_length": mean, "unique_words": unique, "spam_indicators": spam, "quality_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))}
