"""The Porter stemmer (Porter 1980, with the revised bli and logi rules) as a pure function, and over columns.

A word is seen as a string of consonants and vowels, y being a vowel after a consonant; its measure m counts the
places where a consonant follows a vowel.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes and what takes their place, where the stem before them has m > 0.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
# Suffixes dropped where the stem before them has m > 1 (ion: only after s or t).
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """v for each vowel, c for each consonant (digits are consonants)."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def measure(word: str) -> int:
    return shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word).endswith("c")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _replaced(word: str, rules: dict[str, str]) -> str:
    """The longest suffix that the word ends in decides, whether or not its stem is long enough."""
    suffix = _longest(word, rules)
    if suffix is None:
        return word
    rest = word[: len(word) - len(suffix)]
    return rest + rules[suffix] if measure(rest) > 0 else word


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _participle(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    rest = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s)), None)
    if rest is None or "v" not in shape(rest):
        return w
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _double_end(rest):
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if measure(rest) == 1 and _short_end(rest) else rest


def _derived(w: str) -> str:
    suffix = _longest(w, STEP4)
    if suffix is None:
        return w
    rest = w[: len(w) - len(suffix)]
    return rest if measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))) else w


def _final(w: str) -> str:
    m = measure(w)  # before the e goes: it counts for the double l as well
    if w.endswith("e") and (m > 1 or m == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if m > 1 and w.endswith("ll") else w


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """Words of at most two letters stay as they are."""
    if len(word) <= 2:
        return word
    w = _participle(_plural(word))
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    return _final(_derived(_replaced(_replaced(w, STEP2), STEP3)))


def stems(words: list[str]) -> list[str]:
    """Of different words."""
    return list(map(stem, words))


def _stemmed(values: pa.Array) -> pa.Array:
    """Each different word of a batch is stemmed once (and remembered by the worker), whatever its count."""
    coded = values.dictionary_encode()
    stems = pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    return stems.take(coded.indices)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_array(words: pa.Array) -> pa.Array:
    offsets = words.offsets
    mask = pa.array(np.asarray(words.is_null())) if words.null_count else None
    return pa.ListArray.from_arrays(offsets, _stemmed(words.values), mask=mask)


@F.arrow_udf(T.StringType())
def stem_word(words: pa.Array) -> pa.Array:
    return _stemmed(words)


def stemmed(words: Column) -> Column:
    return stem_array(words)
