"""Language identification by scripts and function words, as one expression; null where nothing speaks for any language.

Scripts decide first (Kana: Japanese, Hangul: Korean, Han: Chinese, Cyrillic, Arabic, Devanagari); Latin text is scored by
how many of its first tokens' words are function words of each language, words of two languages counting for both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.common import let, named
from tessella.functions.text import WS, difficulty, reading_seconds, tokens

#: Codes and names (fixed values).
NAMES = {"en": "English", "fr": "French", "de": "German", "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "ru": "Russian", "ar": "Arabic", "hi": "Hindi"}
#: The six languages with a type of their own, their HTTP codes and regional variants (fixed values).
TYPED = ["en", "zh", "fr", "de", "ja", "ko"]
HTTP_CODES = {"en": "en", "zh": "zh-CN", "fr": "fr", "de": "de", "ja": "ja", "ko": "ko"}
HTTP_VARIANTS = {"en": ["en-US", "en-GB", "en"], "zh": ["zh-CN", "zh-TW", "zh"], "fr": ["fr-FR", "fr-CA", "fr"], "de": ["de-DE", "de-AT", "de"], "ja": ["ja-JP", "ja"], "ko": ["ko-KR", "ko"]}
CJK = ["zh", "ja", "ko"]

#: Function words of our own choice; order breaks ties.
PROFILES = {
    "en": "the and of to in is that was for it with as on by this be at from are which not have has were their",
    "de": "der die das und den dem ein eine ist nicht von zu mit sich auf für wurde im auch es als nach wie so bei aus",
    "fr": "le la les des et est une un du que dans pour qui sur pas avec au il a sont été ce selon plus",
    "es": "el la los las de y que en un una es por con para se del al lo como más está según fue su",
    "it": "il lo gli di che e è una un per con non sono della nel alla più come anche",
    "pt": "o os as de que e em um uma não para com por mais foi dos da do se na no são",
}
LEAST_HITS = 2


_LONGEST = max(len(w) for ws in PROFILES.values() for w in ws.split())
#: Scripts that are counted; none has characters before U+0300, which saves looking up the script of most.
SCRIPTS = {"kana": r"\p{IsHiragana}\p{IsKatakana}", "hangul": r"\p{IsHangul}", "han": r"\p{IsHan}", "ru": r"\p{IsCyrillic}", "ar": r"\p{IsArabic}", "hi": r"\p{IsDevanagari}"}
_ANY_SCRIPT = r"[\x{300}-\x{10FFFF}&&[" + "".join(SCRIPTS.values()) + "]]"
_SPACE = WS[1:-1]
#: A token that without what stands around its first and last letter is one word no longer than those of the profiles.
_SHORT_WORD = rf"(?<![^{_SPACE}])[^\p{{L}}{_SPACE}]*+(\p{{L}}{{1,{_LONGEST}}}+)[^\p{{L}}{_SPACE}]*+(?![^{_SPACE}])"


def _hits(low: Column, words: list[str]) -> Column:
    return F.size(F.filter(low, lambda w: w.isin(words)))


def _count(t: Column, chars: str) -> Column:
    """How many characters of the class; runs of others go at once, where regexp_count makes a string of each."""
    return F.length(F.regexp_replace(t, f"[^{chars}]+", ""))


def _made(code: Column | str, score: Column, rest: Column) -> Column:
    return named(code=F.lit(code) if isinstance(code, str) else code, score=score, rest=rest)


def _by_script(n: Column) -> Column:
    letters, kana, hangul, han = n["letters"], n["kana"], n["hangul"], n["han"]
    share = lambda c: c.cast("double") / letters
    zero = F.lit(0.0)
    out = F.when(letters == 0, F.lit(None))
    out = out.when((kana + han) * 5 >= letters, F.when(kana * 10 >= han, _made("ja", share(kana + han), zero)).otherwise(_made("zh", share(han), zero)))
    out = out.when(hangul * 5 >= letters, _made("ko", share(hangul), zero))
    for code in ("ru", "ar", "hi"):
        out = out.when(n[code] * 2 >= letters, _made(code, share(n[code]), zero))
    return out


def _by_words(t: Column) -> Column:
    def ranked(short: Column) -> Column:
        return F.sort_array(F.array(*[named(n=_hits(short, ws.split()), i=F.lit(-i), c=F.lit(c)) for i, (c, ws) in enumerate(PROFILES.items())]), asc=False)

    def best(r: Column) -> Column:
        total = F.regexp_count(t, F.lit(f"[^{_SPACE}]+")).cast("double")
        return F.when(r[0]["n"] >= LEAST_HITS, let(total, lambda n: _made(r[0]["c"], r[0]["n"] / n, r[1]["n"] / n)))

    return let(let(F.regexp_extract_all(F.lower(t), F.lit(_SHORT_WORD), F.lit(1)), ranked), best)


def scores(t: Column) -> Column:
    """struct(code, score, rest): the best language, its share of the letters or hits, and the runner-up's. Texts without any
    of the scripts are not counted for them; each count is made once."""
    counts = named(letters=_count(t, r"\p{L}"), **{k: _count(t, v) for k, v in SCRIPTS.items()})
    return F.coalesce(F.when(t.rlike(_ANY_SCRIPT), let(counts, _by_script)), _by_words(t))


def detect(t: Column) -> Column:
    return scores(t)["code"]


def confidence(t: Column) -> Column:
    """How far the best language leads, 0..1."""
    return let(scores(t), lambda s: F.when(s["score"] > 0, (s["score"] - s["rest"]) / s["score"]))


def typed(code: Column) -> Column:
    return F.when(code.isin(TYPED), code)


def name_of(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), code), F.lit("Unknown"))


def http_code(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in HTTP_CODES.items() for x in kv]), code)


def supported(code: Column, accepted: list[str]) -> Column:
    """Undetected text is not supported."""
    return F.coalesce(typed(code).isin(accepted), F.lit(False))


def gate_ok(code: Column, accepted: list[str]) -> Column:
    """For the page gate: undetected text passes."""
    return code.isNull() | supported(code, accepted)


def statistics(t: Column) -> dict[str, Column]:
    code, n = detect(t), F.size(tokens(t)).cast("long")
    return {"language": typed(code), "confidence": F.coalesce(confidence(t), F.lit(0.0)), "difficulty": difficulty(t), "reading_seconds": reading_seconds(n), "words": n}
