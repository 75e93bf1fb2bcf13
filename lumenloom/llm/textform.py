"""Character-level forms shared by the text operators: compatibility forms, ignorable characters, look-alike letters, folds."""

from __future__ import annotations

import re
import unicodedata

#: Letters of other scripts that have the shape of a Latin letter.
LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ",
    "v": "νѵ", "w": "ԝ", "x": "х", "y": "у", "Ë": "Ё", "Ï": "ЇΪ", "ë": "ё", "ï": "ї", "ó": "ό", "Ü": "Ϋ",
}
TO_LATIN = {ord(o): latin for latin, others in LOOKALIKES.items() for o in others}

_SCRIPTS = ((0x41, 0x24F, "L"), (0x1E00, 0x1EFF, "L"), (0x370, 0x3FF, "G"), (0x1F00, 0x1FFF, "G"), (0x400, 0x52F, "C"))


def script(ch: str) -> str:
    """L, C or G for a Latin, Cyrillic or Greek letter, else an empty string."""
    cp = ord(ch)
    return next((s for lo, hi, s in _SCRIPTS if lo <= cp <= hi and ch.isalpha()), "")


class _Lazy(dict):
    """A translation table whose entries are worked out when first met."""

    def __init__(self, rule):
        self.rule = rule

    def __missing__(self, cp: int):
        self[cp] = value = self.rule(chr(cp))
        return value


def _ignorable(ch: str) -> bool:
    cp = ord(ch)
    return unicodedata.category(ch) == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


def _visible(ch: str) -> str:
    if _ignorable(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if ord(ch) in TO_LATIN and unicodedata.normalize("NFKC", ch) != ch:
        return TO_LATIN[ord(ch)]  # the compatibility form would have another shape
    return "-" if ch in "‐‑" else ch


def _folded(ch: str) -> str:
    if _ignorable(ch):
        return ""
    out = []
    for c in unicodedata.normalize("NFKD", ch):
        kind = unicodedata.category(c)
        if kind[0] == "M":
            continue
        c = TO_LATIN.get(ord(c), c)
        out.append(c.lower() if kind[0] in "LN" else " ")
    return "".join(TO_LATIN.get(ord(c), c) for c in "".join(out))


_VISIBLE, _FOLD = _Lazy(_visible), _Lazy(_folded)


def compatible(text: str) -> str:
    """Compatibility form without ignorable characters; every kind of space becomes U+0020, tabs and line breaks stay."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", text.translate(_VISIBLE)).translate(_VISIBLE)


def fold(text: str) -> str:
    """Lower-case letters and digits without accents, look-alikes as Latin letters, everything else a blank."""
    return text.translate(_FOLD)


#: Han, kana and Hangul have no blanks between words, so each character counts as a word.
WORD = re.compile(r"[⺀-鿿가-힯豈-﫿\U00020000-\U0003ffff]|[^\W_⺀-鿿가-힯豈-﫿\U00020000-\U0003ffff]+")


_CJK = re.compile("[⺀-鿿가-힯豈-﫿\U00020000-\U0003ffff]")


def words(text: str) -> list[str]:
    """The words of the folded text; each Chinese, Japanese or Korean character is a word of its own."""
    folded = fold(text)
    # a folded text holds letters, digits and blanks only, so without such characters its words stand between the blanks
    return WORD.findall(folded) if not folded.isascii() and _CJK.search(folded) else folded.split()
