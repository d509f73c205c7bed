"""Names of organisations, securities and funds in Korean and English brought to one Latin form.

Everything here works on single strings and is called from Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata

# The letters of Hangul in the order of the Unicode block, in Revised Romanization.
INITIALS = "g kk n d tt r m b pp s ss - j jj ch k t p h".replace("-", "").split(" ")
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
FINALS = "- k k ks n nj nh t l lk lm lp ls lt lp lh m p ps t t ng t t k t p h".replace("-", "").split(" ")

LEGAL = re.compile(r"\(주\)|㈜|주식회사|\bcompany limited\b|\bco\b\.?,?\s*\bltd\b\.?|\bcorp(?:oration)?\b\.?|\binc\b\.?|\bltd\b\.?|\bplc\b\.?|\bag\b\.?")
HANGUL = re.compile("[가-힣]")


_PATTERNS: dict[str, re.Pattern] = {}


def latin(text: str) -> str:
    """Hangul syllables romanized one by one, other characters kept."""
    out = []
    for char in text:
        code = ord(char) - 0xAC00
        if 0 <= code < 11172:
            out.append(INITIALS[code // 588] + VOWELS[code // 28 % 21] + FINALS[code % 28])
        else:
            out.append(char)
    return "".join(out)


def folded(text: str) -> str:
    """Compatibility forms composed, case and outer blanks removed."""
    return unicodedata.normalize("NFKC", text).casefold().strip()


def without_legal(text: str) -> str:
    return LEGAL.sub(" ", text.replace("㈜", " ").replace("(주)", " "))


def letters(text: str) -> str:
    """Only Latin letters and digits of a romanized text."""
    return re.sub(r"[^a-z0-9]", "", latin(text))


def longest_first(words: dict[str, str]) -> dict[str, str]:
    """A table of words as ``pulled`` wants it."""
    return dict(sorted(words.items(), key=lambda x: -len(x[0])))


def pulled(text: str, words: dict[str, str], where: str = "any") -> tuple[str, str | None]:
    """Text without the first word of a table it holds, and that word's meaning; tables have the longest words first.

    ``where``: "end", "start" or "any". The words must be folded; Korean words match without regard to blanks.
    """
    for word, meaning in words.items():
        for found in word_pattern(word).finditer(text):
            if where == "end" and text[found.end() :].strip(" .,-_·"):
                continue
            if where == "start" and text[: found.start()].strip(" .,-_·"):
                continue
            return f"{text[: found.start()]} {text[found.end() :]}".strip(), meaning
    return text, None


def word_pattern(word: str) -> re.Pattern:
    """A word of a table: Korean with blanks anywhere in it, Latin as a whole word."""
    if word not in _PATTERNS:
        _PATTERNS[word] = re.compile(r"\s*".join(map(re.escape, word)) if HANGUL.search(word) else rf"(?<![a-z]){re.escape(word)}(?![a-z])")
    return _PATTERNS[word]
