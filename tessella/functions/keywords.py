"""Keyword search: positions, modes, gates, statistics and paragraphs as native expressions.

A match is struct(kw, keyword, pos, len): index and text of the keyword, position and length in characters, listed keyword
by keyword. Null text has no matches. Positions count from 0; case-insensitive search lower-cases both sides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.common import named
from tessella.functions.cleaning import compiled

MODES = ("any", "ci", "all", "exact", "regex")


@dataclass(frozen=True)
class KeywordConfig:
    keywords: tuple[str, ...]
    mode: str = "any"
    enabled: bool = True
    min_matches: int | None = None
    max_proximity: int | None = None
    include_context: bool = False
    context_window: int = 100
    highlight: bool = False

    def __post_init__(self) -> None:
        if not self.enabled:
            return
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        if not self.keywords or any(not k.strip() for k in self.keywords):
            raise ValueError("keywords must be given and not blank")
        if self.mode == "regex":
            for k in self.keywords:
                compiled(k)
        if self.max_proximity is not None and self.max_proximity <= 0:
            raise ValueError("proximity must be positive")
        if self.include_context and self.context_window <= 0:
            raise ValueError("the context window must be positive")

    @property
    def filters(self) -> bool:
        return self.enabled and bool(self.keywords)

    @property
    def normalized(self) -> list[str]:
        return [k.lower() for k in self.keywords] if self.mode == "ci" else list(self.keywords)


def _struct(i: Column | int, k: str | Column, pos: Column, length: Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return named(kw=lit(i).cast("int"), keyword=lit(k), pos=pos.cast("int"), len=length.cast("int"))


def _none() -> Column:
    return F.array().cast("array<struct<kw:int,keyword:string,pos:int,len:int>>")


def substring_matches(t: Column, i: int, k: str) -> Column:
    """Hits from left to right, each search going on after the last hit."""
    n = len(k)
    parts = F.split(t, re.escape(k), -1)
    sizes = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.length)
    start = named(at=F.lit(0), out=F.array().cast("array<int>"))
    walked = F.aggregate(sizes, start, lambda a, s: named(at=a["at"] + s + n, out=F.concat(a["out"], F.array(a["at"] + s))))["out"]
    return F.when(F.coalesce(F.contains(t, F.lit(k)), F.lit(False)), F.transform(walked, lambda p: _struct(i, k, p, F.lit(n)))).otherwise(_none())


def exact_matches(t: Column, i: int, k: str) -> Column:
    """Hits, overlapping ones too, whose neighbours are neither letters nor digits."""
    # split at a zero-width look-ahead: every piece but the first begins at a hit
    hit = rf"(?<![\p{{L}}\p{{N}}])(?={re.escape(k)}(?![\p{{L}}\p{{N}}]))"
    marked = F.regexp_replace(t, hit, "\u0000")
    parts = F.split(marked, "\u0000", -1)
    sizes = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.length)
    start = named(at=F.lit(0), out=F.array().cast("array<int>"))
    walked = F.aggregate(sizes, start, lambda a, s: named(at=a["at"] + s, out=F.concat(a["out"], F.array(a["at"] + s))))["out"]
    return F.when(F.coalesce(F.contains(t, F.lit(k)), F.lit(False)), F.transform(walked, lambda p: _struct(i, k, p, F.lit(len(k))))).otherwise(_none())


def regex_matches(t: Column, i: int, p: str) -> Column:
    """Non-overlapping hits; their places are found by splitting the text at the same pattern."""
    found = F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1))
    gaps = F.split(F.regexp_replace(t, p, "\u0000"), "\u0000", -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, f: named(g=g, f=f))
    start = named(at=F.lit(0), out=_none())
    walked = F.aggregate(pairs, start, lambda a, x: named(at=a["at"] + F.length(x["g"]) + F.length(x["f"]), out=F.concat(a["out"], F.array(_struct(i, p, a["at"] + F.length(x["g"]), F.length(x["f"]))))))
    return F.when(t.isNull() | (F.size(found) == 0), _none()).otherwise(walked["out"])


def matches(t: Column, cfg: KeywordConfig) -> Column:
    if not cfg.filters:
        return _none()
    if cfg.mode == "ci":
        t = F.lower(t)
    one = {"exact": exact_matches, "regex": regex_matches}.get(cfg.mode, substring_matches)
    every = F.concat(*[one(t, i, k) for i, k in enumerate(cfg.normalized)])
    if cfg.mode == "all":
        has = F.lit(True)
        for k in cfg.keywords:
            has = has & F.coalesce(F.contains(t, F.lit(k)), F.lit(False))
        every = F.when(has, every).otherwise(_none())
    if cfg.min_matches is not None:
        every = F.when(F.size(every) >= cfg.min_matches, every).otherwise(_none())
    if cfg.max_proximity is not None:
        every = F.when(proximity_ok(every, cfg.max_proximity), every).otherwise(_none())
    return every


def _neighbours(m: Column) -> Column:
    """Gaps from the end of each match to the next, in list order."""
    n = F.size(m)
    return F.when(n < 2, F.array().cast("array<int>")).otherwise(F.zip_with(F.slice(m, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(m, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: b["pos"] - (a["pos"] + a["len"])))


def proximity_ok(m: Column, most: int) -> Column:
    """Every step forward in the list is at most so long; steps back pass."""
    return F.forall(_neighbours(m), lambda g: g <= most)


def statistics(t: Column, m: Column, cfg: KeywordConfig) -> dict[str, Column]:
    """Bytes, share of keywords found, most frequent keyword (the first at ties), mean gap (null under two matches)."""
    kws = F.array_distinct(F.transform(m, lambda x: x["kw"]))
    counts = F.transform(kws, lambda k: named(n=F.size(F.filter(m, lambda x: x["kw"] == k)), i=-k))
    top = F.array_max(counts)
    names = F.array(*[F.lit(k) for k in cfg.normalized])
    gaps = _neighbours(m)
    mean = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g).cast("double") / F.size(gaps)
    return {
        "text_bytes": F.coalesce(F.octet_length(t), F.lit(0)).cast("long"),
        "match_percentage": F.size(kws).cast("double") / F.lit(float(len(cfg.keywords))) * 100.0,
        "top_keyword": F.when(F.size(m) > 0, F.get(names, -top["i"])),
        "mean_gap": F.when(F.size(gaps) > 0, mean),
    }


def context(t: Column, pos: Column, length: Column, window: int, highlight: bool = False) -> Column:
    left = F.greatest(pos - window, F.lit(0))
    before = F.substr(t, left + 1, pos - left)
    hit, after = F.substr(t, pos + 1, length), F.substr(t, pos + length + 1, F.lit(window))
    return F.concat(before, F.lit("**"), hit, F.lit("**"), after) if highlight else F.concat(before, hit, after)


def paragraphs(t: Column, m: Column) -> Column:
    """Non-blank lines that hold the start of a match; a repeated line takes the matches of its first place."""
    lines = F.filter(F.split(t, "\n", -1), lambda p: F.trim(F.regexp_replace(p, r"[\s\x{0B}\x{85}\p{Z}]+", "")) != "")
    return F.filter(lines, lambda p: F.exists(m, lambda x: (x["pos"] >= F.position(p, t) - 1) & (x["pos"] < F.position(p, t) - 1 + F.length(p))))


def filtered(t: Column, m: Column) -> dict[str, Column]:
    """The kept paragraphs joined by blank lines, with lengths in bytes, ratio and number."""
    kept = paragraphs(t, m)
    text = F.array_join(kept, "\n\n")
    size, full = F.octet_length(text).cast("long"), F.octet_length(t).cast("long")
    return {"filtered": text, "filtered_bytes": size, "original_bytes": full, "ratio": F.when(full > 0, size.cast("double") / full).otherwise(0.0), "paragraphs": F.size(kept).cast("long")}


def sentences_around(t: Column, m: Column) -> Column:
    """Of each match the text from the second full stop before to the second one after; trimmed, sorted, each once."""

    def one(x: Column) -> Column:
        before, after = F.substr(t, F.lit(1), x["pos"]), F.substr(t, x["pos"] + x["len"] + 1, F.length(t))
        head = F.substring_index(before, ".", -2)
        n = F.size(F.split(after, r"\.", -1)) - 1
        tail = F.when(n >= 2, F.concat(F.substring_index(after, ".", 2), F.lit("."))).otherwise(after)
        return F.trim(F.concat(head, F.substr(t, x["pos"] + 1, x["len"]), tail))

    return F.array_sort(F.array_distinct(F.transform(m, one)))
