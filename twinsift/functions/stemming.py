"""English stems of words by Porter's algorithm, over the different words of a batch."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the algorithm (Porter 1980): endings and what they become, tried from the first.
LONG_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
MIDDLE_SUFFIXES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST_SUFFIXES = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]
SHORT = 6  # words of up to so many letters stay as they are


def _shape(word: str) -> str:
    """v for vowels and c for the rest; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _plural_and_past(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        if w.endswith(end) and "v" in _shape(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if _double(w) and w[-1] not in "lsz":
                return w[:-1]
            return w + "e" if _measure(w) == 1 and _short_end(w) else w
    return w


def _replaced(w: str, table: dict[str, str]) -> str:
    end = max((s for s in table if w.endswith(s)), key=len, default=None)
    return w[: -len(end)] + table[end] if end and _measure(w[: -len(end)]) > 0 else w


def stem(word: str) -> str:
    """The stem of a lower-case word; a short word, or one with other characters than a to z, is its own."""
    if len(word) <= SHORT or not (word.isascii() and word.isalpha()):
        return word
    w = _plural_and_past(word)
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, LONG_SUFFIXES), MIDDLE_SUFFIXES)
    end = max((s for s in LAST_SUFFIXES if w.endswith(s)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and _double(w) and w.endswith("l") else w


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """The stems of arrays of words: each different word of the batch is looked at once."""
    lists = pa.array(words, pa.list_(pa.string()))
    encoded = pc.dictionary_encode(lists.flatten())
    found = pa.array([stem(w) for w in encoded.dictionary.to_pylist()], pa.string()).take(encoded.indices)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
    out, at = [], 0
    values = found.to_pylist()
    for n in sizes:
        out.append(values[at : at + n])
        at += n
    return pd.Series(out)
