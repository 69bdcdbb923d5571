"""Case and accent folding and splitting into words, as Columns that stay inside the JVM.

A word is a maximal run of a-z0-9 after lower-casing and then folding (NFKD, combining marks dropped).
NFKD followed by dropping marks is a map of single code points, so it needs no Python: most of it is one
``translate``, the few code points that unfold into several characters take a second, guarded step. Only
code points whose image holds a-z0-9, or that vanish, can change words; all others separate words either way.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"
_KEPT = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_SEP = "\u0001"


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, str, dict[str, str]]:
    """(code points with one image, their images, vanishing code points, {code point: longer image})."""
    source, image, gone, longer = [], [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0x20000 <= cp < 0xE0000 and not 0x2F800 <= cp < 0x2FA20:
            continue  # Hangul, surrogates and CJK: never a-z0-9
        ch = chr(cp)
        out = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if out == ch or (out and not _KEPT & set(out)):
            continue
        if not out:
            gone.append(ch)
        elif len(out) == 1:
            source.append(ch)
            image.append(out)
        else:
            longer[ch] = out
    return "".join(source), "".join(image), "".join(gone), longer


def _ranges(chars) -> str:
    """A character class that holds chars, and a few between them: a long one of single characters is slow to test."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c - out[-1][1] <= 4:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def fold_accents(col: Column) -> Column:
    """NFKD without combining marks, as far as it can matter to words; ASCII text passes untouched."""
    source, image, gone, longer = fold_tables()
    plain = F.translate(col, source + gone, image)
    keys, values = _SEP.join(longer), _SEP.join(longer.values())
    images = F.map_from_arrays(F.split(F.lit(keys), _SEP), F.split(F.lit(values), _SEP))
    chars = F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0))
    unfolded = F.array_join(F.transform(chars, lambda c: F.coalesce(F.element_at(images, c), c)), "")
    many = F.when(plain.rlike(_ranges(longer)), unfolded).otherwise(plain)
    return F.when(col.rlike("[^\\x00-\\x7F]"), many).otherwise(col)


def tokens(col: Column, fold: bool = True) -> Column:
    """All words in order, an empty array for null: lower first, then fold, then split."""
    low = F.lower(col)
    return F.coalesce(
        F.regexp_extract_all(fold_accents(low) if fold else low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>")
    )


def normal_term(col: Column) -> Column:
    """The single word in a term, whatever its case, accents and white space; null where there is none."""
    word = F.regexp_extract(fold_accents(F.lower(col)), WORD, 0)
    return F.when(col.rlike(f"^{WORD}$"), col).when(word != "", word)


def words_of(text: str | None, fold: bool = True) -> list[str]:
    """The same on the driver, straight from the definition."""
    import re

    low = (text or "").lower()
    if fold:
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return re.findall(WORD, low)
