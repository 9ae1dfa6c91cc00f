"""Characters that differ but look the same, for Spark columns and for Python strings."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letter each one is drawn like.
_LETTERS = """
а a  е e  о o  р p  с c  у y  х x  ѕ s  і i  ј j  ԁ d  һ h  ԛ q  ԝ w  ӏ l  ё ë  ї ï
А A  В B  Е E  К K  М M  Н H  О O  Р P  С C  Т T  Х X  Ѕ S  І I  Ј J  У Y  Ү Y  Ԛ Q  Ԝ W  Ӏ I  Ё Ë  Ї Ï
ο o  ν v  ϲ c  ϳ j
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X  Ϲ C  Ϳ J
օ o  ɡ g  ɑ a  ⅼ l  ⅽ c  ⅾ d  ⅿ m  ⅰ i  ⅴ v  ⅹ x  Ⅰ I  Ⅴ V  Ⅹ X  Ⅼ L  Ⅽ C  Ⅾ D  Ⅿ M  ‐ -  ‑ -
"""
#: Drawn as nothing at all.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︎️﻿"
#: Drawn as one space.
SPACES = "               　"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st"}


def _pairs() -> dict[str, str]:
    words = _LETTERS.split()
    out = dict(zip(words[::2], words[1::2]))
    out |= {c: " " for c in SPACES} | {"\u212a": "K"}
    out |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # widened ASCII
    return out


PAIRS = _pairs()
class _Table(dict):
    """A translation table that remembers the characters it leaves alone: misses are slow."""

    def __missing__(self, code: int) -> int:
        self[code] = code
        return code


_PY = _Table({ord(k): v for k, v in (PAIRS | LIGATURES).items()} | {ord(c): None for c in INVISIBLE})
#: One to one on positions: what has no counterpart of one character stays.
_PY_KEEP = _Table({ord(k): v for k, v in PAIRS.items()})


#: Any character that mapping changes: most texts with accents have none.
_MAPPED = re.compile("[" + re.escape("".join(PAIRS) + "".join(LIGATURES) + INVISIBLE) + "]")
_PAIRED = re.compile("[" + re.escape("".join(PAIRS)) + "]")


def visible(text: str) -> str:
    """`text` with every look-alike mapped, what can't be seen removed, and accents composed."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_PY) if _MAPPED.search(text) else text)


def drawn_alike(text: str) -> str:
    """As `visible`, but each character stays at its position (nothing removed or composed)."""
    return text if text.isascii() or not _PAIRED.search(text) else text.translate(_PY_KEEP)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def visible_column(text: Column) -> Column:
    """`visible` without the composing of accents, as built-in functions; null gives null.

    Texts of ASCII only, told by their lengths alone, pass unchanged.
    """
    out = F.translate(text, "".join(PAIRS) + INVISIBLE, "".join(PAIRS.values()))
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return F.when(_is_ascii(text), text).otherwise(out)


class _Letters(dict):
    """Code point to what it contributes to `words_text`; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in chr(code).translate(_PY).lower():
            d = unicodedata.normalize("NFD", c)
            if unicodedata.combining(c):
                continue
            if len(d) > 1 and all(map(unicodedata.combining, d[1:])):
                c = d[0]
            out += c if c.isalnum() else " "
        self[code] = out
        return out


_LETTERS_OF = _Letters()


def words_text(text: str) -> str:
    """The words of `text` joined by single spaces, without case, punctuation, spacing, accents and
    invisible characters, look-alike letters made one: what comparisons of wording look at."""
    return " ".join(text.translate(_LETTERS_OF).split())
