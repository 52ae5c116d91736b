"""Rule-driven text cleaning. Stages run in the order character, word, language, length, custom rules, white space.

Configurations are resolved on the driver; the plan holds literals only. Null text gives null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import WS, squeezed, tokens

#: Code point ranges of the scripts that can be removed (fixed values).
SCRIPTS = {"cjk": [(0x4E00, 0x9FFF)], "japanese": [(0x3040, 0x309F), (0x30A0, 0x30FF)], "korean": [(0xAC00, 0xD7AF)], "arabic": [(0x0600, 0x06FF)], "cyrillic": [(0x0400, 0x04FF)]}


def compiled(pattern: str) -> re.Pattern:
    """Compiles a pattern of Java's dialect as nearly as Python can, to find mistakes on the driver."""
    p = re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern)
    return re.compile(re.sub(r"\\[pP]\{\w+\}", r"\\w", p))


@dataclass(frozen=True)
class CharacterFilter:
    remove_chars: str = ""
    remove_ranges: tuple[tuple[int, int], ...] = ()
    ascii_only: bool = False
    alphanumeric_only: bool = False
    remove_line_breaks: bool = False


@dataclass(frozen=True)
class WordFilter:
    remove_words: tuple[str, ...] = ()
    remove_patterns: tuple[str, ...] = ()
    case_sensitive: bool = False
    remove_numeric: bool = False
    remove_special: bool = False


@dataclass(frozen=True)
class LengthFilter:
    min_word: int | None = None
    max_word: int | None = None
    min_sentence: int | None = None
    max_sentence: int | None = None


@dataclass(frozen=True)
class CleaningConfig:
    enabled: bool = True
    characters: CharacterFilter | None = None
    words: WordFilter | None = None
    remove_scripts: tuple[str, ...] = ()
    lengths: LengthFilter | None = None
    custom_rules: tuple[str, ...] = ()
    normalize_whitespace: bool = True
    allow_empty: bool = False

    def __post_init__(self) -> None:
        if not self.enabled:
            return
        n = self.lengths or LengthFilter()
        for low, high in ((n.min_word, n.max_word), (n.min_sentence, n.max_sentence)):
            if low is not None and high is not None and low > high:
                raise ValueError("a minimum is above its maximum")
        for p in (self.words.remove_patterns if self.words else ()):
            compiled(p)
        for a, b in (self.characters.remove_ranges if self.characters else ()):
            if a > b:
                raise ValueError("a code point range is reversed")
        if any(not r.strip() for r in self.custom_rules):
            raise ValueError("a custom rule is blank")
        for r in self.custom_rules:
            parse_rule(r)

    @property
    def stages(self) -> int:
        return sum(map(bool, (self.characters, self.words, self.remove_scripts, self.lengths, self.custom_rules)))

    @property
    def cleans(self) -> bool:
        return self.enabled and self.stages > 0

    def with_(self, **changes) -> CleaningConfig:
        return replace(self, **changes)


BASIC = CleaningConfig(characters=CharacterFilter())
AGGRESSIVE = CleaningConfig(characters=CharacterFilter(ascii_only=True, remove_line_breaks=True), words=WordFilter(remove_numeric=True, remove_special=True))
REMOVE_CJK = CleaningConfig(remove_scripts=("cjk", "japanese", "korean"))


def parse_rule(text: str) -> tuple[str, str]:
    """'remove:pattern' or 'replace:pattern:replacement'; a pattern with a colon is an error."""
    parts = text.split(":")
    if parts[0] == "remove" and len(parts) == 2:
        pattern, new = parts[1], ""
    elif parts[0] == "replace" and len(parts) == 3:
        pattern, new = parts[1], parts[2]
    else:
        raise ValueError(f"not a rule: {text}")
    compiled(pattern)
    return pattern, new


def range_class(ranges) -> str:
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]+"


def clean_characters(t: Column, f: CharacterFilter) -> Column:
    if f.remove_chars:
        t = F.translate(t, f.remove_chars, "")
    if f.remove_ranges:
        t = F.regexp_replace(t, range_class(f.remove_ranges), "")
    if f.ascii_only:
        t = F.regexp_replace(t, r"[^\x00-\x7F]+", "")
    if f.alphanumeric_only:
        t = F.regexp_replace(t, r"[^\p{L}\p{N}\s\x{0B}\x{85}\p{Z}]+", "")
    if f.remove_line_breaks:
        t = F.translate(t, "\n\r", "  ")
    return t


def clean_words(t: Column, f: WordFilter) -> Column:
    drop = list(f.remove_words) if f.case_sensitive else [w.lower() for w in f.remove_words]

    def keep(w: Column) -> Column:
        ok = F.lit(True)
        if drop:
            ok = ok & ~(w if f.case_sensitive else F.lower(w)).isin(drop)
        for p in f.remove_patterns:
            ok = ok & ~w.rlike(p)
        if f.remove_numeric:
            ok = ok & ~w.rlike("[0-9]")
        if f.remove_special:
            ok = ok & ~w.rlike(r"[^\p{L}\p{N}]")
        return ok

    return F.array_join(F.filter(tokens(t), keep), " ")


def clean_scripts(t: Column, scripts) -> Column:
    for s in scripts:
        for r in SCRIPTS[s]:
            t = F.regexp_replace(t, range_class([r]), "")
    return t


def clean_lengths(t: Column, f: LengthFilter) -> Column:
    def within(low: int | None, high: int | None):
        return lambda x: (F.octet_length(x) >= (low or 0)) & (F.octet_length(x) <= (high if high is not None else 2**31 - 1))

    t = F.array_join(F.filter(tokens(t), within(f.min_word, f.max_word)), " ")
    if f.min_sentence is not None or f.max_sentence is not None:
        each = F.filter(F.split(t, r"\.", -1), lambda s: within(f.min_sentence, f.max_sentence)(F.trim(s)))
        t = F.array_join(each, ".")
    return t


def cleaned(t: Column, cfg: CleaningConfig) -> Column:
    """The cleaned text; where nothing is left, '' (null if the configuration does not allow it)."""
    if not cfg.cleans:
        return t
    out = t
    if cfg.characters:
        out = clean_characters(out, cfg.characters)
    if cfg.words:
        out = clean_words(out, cfg.words)
    if cfg.remove_scripts:
        out = clean_scripts(out, cfg.remove_scripts)
    if cfg.lengths:
        out = clean_lengths(out, cfg.lengths)
    for r in cfg.custom_rules:
        pattern, new = parse_rule(r)
        out = F.regexp_replace(out, pattern, java_template(pattern, new))
    if cfg.normalize_whitespace:
        out = squeezed(out)
    return out if cfg.allow_empty else F.nullif(out, F.lit(""))


def statistics(t: Column, c: Column, cfg: CleaningConfig) -> dict[str, Column]:
    n = lambda x: F.coalesce(F.octet_length(x), F.lit(0)).cast("long")
    w = lambda x: F.coalesce(F.size(tokens(x)), F.lit(0)).cast("long")
    return {
        "original_bytes": n(t), "cleaned_bytes": n(c), "original_words": w(t), "cleaned_words": F.when(c.isNull(), 0).otherwise(w(c)).cast("long"),
        "ratio": F.when(n(t) > 0, n(c).cast("double") / n(t)).otherwise(1.0), "stages": F.lit(cfg.stages).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str  # remove, replace, keep_only, transform
    pattern: str
    replacement: str | None = None
    priority: int = 50
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.kind not in ("remove", "replace", "keep_only", "transform"):
            raise ValueError(f"unknown kind {self.kind}")
        if self.kind != "transform":
            compiled(self.pattern)
        if self.kind == "replace" and self.replacement is None:
            raise ValueError("a replacement is missing")


def java_template(pattern: str, template: str) -> str:
    """$n and ${n} of a replacement for Java: groups that do not exist are empty, as is $1x, which names no group."""
    groups = compiled(pattern).groups

    def one(m: re.Match) -> str:
        name = m[1] or m[2]
        return f"${name}" if name.isdigit() and int(name) <= groups else ""

    out, at = "", 0
    for m in re.finditer(r"\$(?:\{(\w+)\}|(\w+))", template):
        out += template[at : m.start()].replace("\\", "\\\\").replace("$", "\\$") + one(m)
        at = m.end()
    return out + template[at:].replace("\\", "\\\\").replace("$", "\\$")


def apply_rules(t: Column, rules: list[Rule]) -> Column:
    """Enabled rules by falling priority, ties in the given order."""
    for r in sorted((r for r in rules if r.enabled), key=lambda r: -r.priority):
        if r.kind == "remove":
            t = F.regexp_replace(t, r.pattern, "")
        elif r.kind == "replace":
            t = F.regexp_replace(t, r.pattern, java_template(r.pattern, r.replacement or ""))
        elif r.kind == "keep_only":
            t = F.array_join(F.regexp_extract_all(t, F.lit(f"({r.pattern})"), F.lit(1)), " ")
        elif r.pattern in ("lowercase", "uppercase", "trim"):
            t = {"lowercase": F.lower, "uppercase": F.upper, "trim": lambda x: F.regexp_replace(x, f"^{WS}+|{WS}+$", "")}[r.pattern](t)
    return t


#: The three rule sets (patterns are fixed values). The first takes out all white space before the URL rule, so a URL then
#: takes the rest of the text with it; SAFE is the order one would want.
DEFAULT_RULES = [
    Rule("tags", "remove", r"<[^>]*>"),
    Rule("white space", "remove", f"{WS}+"),
    Rule("urls", "remove", r"https?://[^\s]+"),
    Rule("e-mail", "remove", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    Rule("quotes", "replace", r"['`]", "'"),
    Rule("dashes", "replace", "[–—]", "-"),
]
SAFE_RULES = [DEFAULT_RULES[0], DEFAULT_RULES[2], DEFAULT_RULES[3], Rule("white space", "replace", f"{WS}+", " "), *DEFAULT_RULES[4:]]
CJK_RULES = [Rule(f"range {a:x}", "remove", range_class([(a, b)])) for s in ("cjk", "japanese", "korean") for a, b in SCRIPTS[s]]
AGGRESSIVE_RULES = [Rule("not ascii", "remove", r"[^\x00-\x7F]+"), Rule("digits", "remove", r"\d+"), Rule("signs", "remove", r"[^\w\s]"), Rule("white space", "replace", r"\s+", " ")]
