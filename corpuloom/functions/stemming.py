"""The English (Porter2) stemmer, from its published description."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published algorithm.
VOWELS = set("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = set("cdeghkmnrt")
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
R1_PREFIXES = ("gener", "commun", "arsen")
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _region(word: str, start: int) -> int:
    """Behind the first consonant that follows a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_syllable(word: str) -> bool:
    """Does the word end in one?"""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS | set("wxY") and word[-2] in VOWELS and word[-3] not in VOWELS


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    word = word.lstrip("'") if word.startswith("'") else word
    if word in SPECIAL:
        return SPECIAL[word]
    if word in INVARIANT:
        return word
    letters = list(word)
    for i, c in enumerate(letters):  # a y that is a consonant
        if c == "y" and (i == 0 or letters[i - 1] in VOWELS):
            letters[i] = "Y"
    word = "".join(letters)
    prefix = _longest_prefix(word)
    r1 = len(prefix) if prefix else _region(word, 0)
    r2 = _region(word, r1)
    for suffix in ("'s'", "'s", "'"):
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break
    word = _step1a(word)
    if word in AFTER_1A:
        return word
    word = _step1b(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _step2(word, r1)
    word = _step3(word, r1, r2)
    word = _step4(word, r2)
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def _longest_prefix(word: str) -> str | None:
    return max((p for p in R1_PREFIXES if word.startswith(p)), key=len, default=None)


def _step1a(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")):
        return word
    if word.endswith("s") and any(c in VOWELS for c in word[:-2]):
        return word[:-1]
    return word


def _step1b(word: str, r1: int) -> str:
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending is None:
        return word
    root = word[: -len(ending)]
    if ending.startswith("eed"):
        return root + "ee" if len(root) >= r1 else word
    if not any(c in VOWELS for c in root):
        return word
    if root.endswith(("at", "bl", "iz")):
        return root + "e"
    if root.endswith(DOUBLES):
        return root[:-1]
    if len(root) <= r1 and _short_syllable(root):
        return root + "e"
    return root


def _step2(word: str, r1: int) -> str:
    ending = _longest(word, (*STEP2, "ogi", "li"))
    if ending is None or len(word) - len(ending) < r1:
        return word
    root = word[: -len(ending)]
    if ending == "ogi":
        return root + "og" if root.endswith("l") else word
    if ending == "li":
        return root if root[-1:] in LI_ENDINGS else word
    return root + STEP2[ending]


def _step3(word: str, r1: int, r2: int) -> str:
    ending = _longest(word, (*STEP3, "ative"))
    if ending is None or len(word) - len(ending) < r1:
        return word
    root = word[: -len(ending)]
    if ending == "ative":
        return root if len(root) >= r2 else word
    return root + STEP3[ending]


def _step4(word: str, r2: int) -> str:
    ending = _longest(word, (*STEP4, "ion"))
    if ending is None or len(word) - len(ending) < r2:
        return word
    root = word[: -len(ending)]
    if ending == "ion":
        return root if root.endswith(("s", "t")) else word
    return root


@F.pandas_udf(T.StringType())
def porter2(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Apply to distinct tokens and join back, so each is stemmed once."""
    for t in tokens:
        yield t.map(stem, na_action="ignore")
