"""Site template removal: what each line of a page is, by how often the host's pages repeat it.

The element subtrees of a page, as far as its text keeps them, are its units: each line (hashed by its letters) and each
opener, the label before a line's first separator with whatever follows it ("Sponsored: ..."). In Spark, units are counted
per host over different urls, together with where they stand. Units on at least MIN_PAGES urls and one in ONE_IN
of the host's are its template, and their positions say what they are:

- OPENS: nearly always followed by list items or cut-off lines. It owns the block of teasers below it.
- BYLINE: mostly between a heading and the first sentence. Such lines belong to the page, though authors recur.
- an opener counts only if it mostly stands alone and nothing after it is a sentence, so tables, questions and
  specifications, which come in runs, are no furniture.
- everything else is furniture.

No list of words decides. Pages without url have no template. Null, empty and blank contents have no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.common import staged

MIN_PAGES = 3
ONE_IN = 100

#: Looks of a line.
BLANK, BARE, SENT, CUT, ITEM, WIDE, TITLE, DATED, SLOT, FILLER, TRACE, TABLE = (1 << i for i in range(12))
#: Two bits above them: how many segments of a line are as long as a sentence of prose, 3 for more.
LONG = 1 << 12
#: Codes of template units.
NONE, FURN, OPENS, BYLINE = 0, 1, 2, 3
#: Labels of lines.
L_BLANK, L_FURN, L_HEAD, L_BY, L_TEXT, L_LIST = range(6)

_DATE = re.compile(r"^\W*\d{1,4}[-./]\d{1,2}[-./]\d{1,4}(?:[ T]\d{1,2}:\d{2})?\W*$")
_BULLET = re.compile(r"\s*(?:[•\-*»›–·▶]+|\d{1,2}\.)\s+")
_CUT = re.compile(r"(?:\.\.\.|…|\[…\])\s*[»›]?\s*$")
_END = re.compile(r"[.!?][\s”\"]|[。！？]|ã€‚")  # the last is 。 read in a wrong encoding
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_SEPARATOR = re.compile(r"\s*([:：])(?!//)|\s([–—|>›·-])\s")
_TABLE = re.compile(r"\s*\w[\w ]{1,18}: \S|\s*\d+ \w+ (?:of|de|di) ", re.I)
_TRACE = re.compile(r"\s*at [\w.$]+ ?\(")
_ODD = re.compile(r"[^\x00-\x7f]").findall
_MAY_PART = re.compile(r"[:：–—|>›·-]").search
_ASCII = bytes(range(256)).lower(), bytes(c for c in range(128) if not chr(c).isalpha())
OPENER = 40
#: A block of teasers has at most this many lines; what is longer is the page's own list.
BLOCK = 12


def letters(text: str) -> str:
    """What is compared of a line: its letters, in lower case."""
    if text.isascii():
        return text.encode().translate(*_ASCII).decode()
    low = text.lower()
    for c in set(_ODD(low)):
        if not c.isalpha():
            low = low.replace(c, "")
    return low.encode().translate(*_ASCII).decode()


def look_of(line: str) -> tuple[int, str, str, str]:
    """(look, letters, letters of the opener or '', separator) of a line on its own."""
    if not line.strip():
        return BLANK, "", "", ""
    bullet = _BULLET.match(line)
    core = (line[bullet.end() :] if bullet else line).strip(" \t\r\xa0\u3000»›…↑▾")
    key = letters(line)
    look = 0 if key else BARE
    if line.isascii() or not _CJK.search(line):
        sent = core.count(" ") >= 3 and (core[-1:] in (".", "!", "?") or ("." in core or "!" in core or "?" in core or not core.isascii()) and bool(_END.search(core)))
    else:
        look |= WIDE
        sent = len(core) >= 8 and (core[-1:] in (".", "!", "?") or bool(_END.search(core)))
    if sent:
        look |= SENT
    tail = line[-12:]
    if ("..." in tail or "…" in tail) and _CUT.search(tail):
        look |= CUT
    if (bullet or line.rstrip()[-1:] in ("»", "›")) and len(key) >= (8 if look & WIDE else 12) or look & CUT:
        look |= ITEM
    if _DATE.match(line):
        look |= DATED
    if _TRACE.match(line):
        look |= TRACE
    if not sent and (line.count("|") > 1 or _TABLE.match(line)):
        look |= TABLE
    sep = _SEPARATOR.search(core, 0, OPENER + 3) if _MAY_PART(core, 0, OPENER + 3) else None
    opener = letters(core[: sep.start()]) if sep else ""
    return look, key, opener if opener and len(opener) < len(key) else "", (sep[1] or sep[2]) if sep else ""


def title_core(title: str | None) -> str:
    """The letters of the title, without a site's name behind a dash or bar."""
    return letters(re.split(r"\s[-–|]\s(?=[^-–|]*$)", title)[0]) if title else ""


def is_text(look: int, size: int) -> bool:
    """A whole sentence, long enough for a paragraph."""
    return bool(look & SENT) and not look & CUT and size > (25 if look & WIDE else 60)


def label(look: list[int], size: list[int], code: list[int], opener: list[int]) -> list[int]:
    """One label per line. code: what its line is in the host's template; opener: the same of its opener."""
    n = len(look)
    out = [-1] * n
    for i in range(n):
        if look[i] & BLANK:
            out[i] = L_BLANK
        elif look[i] & DATED:
            out[i] = L_BY
        elif code[i] == BYLINE:
            out[i] = L_BY
        elif look[i] & TITLE:
            pass
        elif code[i] or opener[i]:
            out[i] = L_FURN
    # the heading: the title's line, else the line before the byline, else the last line before the first text
    head = next((i for i in range(n) if look[i] & TITLE and out[i] < 0), None)
    first = next((i for i in range(n) if out[i] < 0 and is_text(look[i], size[i]) and not look[i] & ITEM), None)
    if head is None:
        by = next((i for i in range(n) if out[i] == L_BY), None)
        stop = by if by is not None else first
        if stop is not None:
            head = next((i for i in range(stop - 1, -1, -1) if out[i] < 0 and size[i] < 160 and not look[i] & (CUT | ITEM)), None)
    if head is not None:
        out[head] = L_HEAD
    # what a template line opens: items, short lines and cut-off ones, until the heading, furniture or a whole paragraph
    open_, block = False, []
    for i in range(n):
        if out[i] == L_BLANK:
            continue
        if out[i] >= 0:
            if open_ and len(block) <= BLOCK:
                for k in block:
                    out[k] = L_FURN
            open_, block = out[i] == L_FURN and code[i] == OPENS, []
            continue
        if open_ and (look[i] & ITEM or not (look[i] & SENT and size[i] > (40 if look[i] & WIDE else 90))):
            block.append(i)
        elif open_:
            if len(block) <= BLOCK:
                for k in block:
                    out[k] = L_FURN
            open_ = False
    if open_ and len(block) <= BLOCK:
        for k in block:
            out[k] = L_FURN
    for i in range(n):
        if out[i] < 0:
            out[i] = L_TEXT if look[i] & SENT else L_LIST
    # pointers that stand between or below the footers
    last = max((i for i in range(n) if out[i] in (L_HEAD, L_BY, L_TEXT)), default=-1)
    if last >= 0:
        from_ = next((i for i in range(last + 1, n) if out[i] == L_FURN), n)
        pointers = [i for i in range(from_, n) if out[i] == L_LIST]
        if len(pointers) <= BLOCK:
            for i in pointers:
                out[i] = L_FURN
    return out


def templates(units: DataFrame, pages: DataFrame, min_pages: int = MIN_PAGES, one_in: int = ONE_IN) -> DataFrame:
    """unit, code of the hosts' templates. units: unit (hashed with its host), url, host, flags (see features), in any number
    of rows; a url counts once for a unit. pages: host, url of all pages."""
    from tessella.llm import features

    per_url = units.groupBy("unit", "url").agg(F.max("host").alias("host"), F.bit_or("flags").alias("flags"))
    times = lambda bit: F.count_if(F.col("flags").bitwiseAND(bit) > 0)
    bits = {"opener": features.IS_OPENER, "opens": features.OPENS, "byline": features.BYLINE, "alone": features.ALONE, "whole": features.WHOLE}
    n = per_url.groupBy("unit").agg(F.count("*").alias("n"), F.max("host").alias("host"), *[times(b).alias(k) for k, b in bits.items()]).where(F.col("n") >= min_pages)
    urls = pages.distinct().groupBy("host").agg(F.count("*").alias("urls"))
    code = (
        F.when(F.col("opener") > 0, F.when((F.col("alone") * 2 > F.col("n")) & (F.col("whole") * 2 < F.col("n")), FURN).otherwise(NONE))
        .when(F.col("opens") * 5 >= F.col("n") * 4, OPENS)
        .when(F.col("byline") * 2 > F.col("n"), BYLINE)
        .otherwise(FURN)
    )
    kept = n.join(urls, "host").where(F.col("n") * one_in >= F.col("urls")).select("unit", code.alias("code"))
    return staged(kept.where(F.col("code") > 0), "templates")
