"""Normalised primary keys and stems, which need Unicode tables that SQL functions lack."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The usual Latin letters for those of other alphabets, and the characters that keys may have.
LETTERS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "þ": "th", "ð": "d", "ı": "i", "ħ": "h", "ŋ": "ng", "ə": "@",
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "ђ": "dj", "е": "e", "є": "ie", "ж": "zh", "з": "z", "и": "i", "і": "i", "ј": "j", "к": "k",
    "л": "l", "љ": "lj", "м": "m", "н": "n", "њ": "nj", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "ћ": "c", "у": "u", "ф": "f", "х": "kh", "ц": "ts",
    "ч": "ch", "џ": "dz", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "ё": "io", "й": "i", "ї": "yi", "ў": "u", "ѓ": "gj", "ќ": "kj",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
    "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
NOT_ALLOWED = re.compile(r"[^a-z0-9\s/\-+_#&@.:()]")
EDGES = r"\s/\\.:()"
EDGE = re.compile(rf"^[{EDGES}]+|[{EDGES}]+$")


@lru_cache(4096)
def latin(c: str) -> str:
    """A letter in Latin ones: by the table, without its marks, by its name, or by its number, so that none is lost."""
    if c in LETTERS:
        return LETTERS[c]
    bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    if bare.isascii():
        return bare
    if bare != c and not "HANGUL" in unicodedata.name(c, ""):
        return "".join(map(latin, bare))
    name = unicodedata.name(c, "")
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    if not c.isalpha():
        return ""
    # HIRAGANA LETTER SMALL YU, HANGUL SYLLABLE GAG: the sound is the last word, or what stands before WITH
    spoken = re.search(r" (?:LETTER|SYLLABLE)(?: SMALL| CAPITAL)? (\w+)(?: WITH .*)?$", name)
    return spoken[1].lower() if spoken else f"u{ord(c):x}"


def normalize(raw: str) -> str | None:
    text = "".join(filter(str.isprintable, unicodedata.normalize("NFKC", raw)))
    text = text.replace("–", "-").replace("—", "-").casefold()
    if not text.isascii():
        text = "".join(c if c.isascii() else latin(c) for c in unicodedata.normalize("NFKC", text))
    text = EDGE.sub("", NOT_ALLOWED.sub("", text))
    return re.sub(r"\s+", " ", text) or None


@pandas_udf(StringType())
def _normalize(raw: pd.Series) -> pd.Series:
    return raw.map(normalize, na_action="ignore")


def ascii_pk(raw: Column) -> Column:
    """The same for printable ASCII, in SQL functions."""
    kept = F.regexp_replace(F.lower(raw), r"[^a-z0-9\s/\-+_#&@.:()]", "")
    text = F.regexp_replace(F.regexp_replace(kept, rf"^[{EDGES}]+|[{EDGES}]+$", ""), r"\s+", " ")
    return F.when(text != "", text)


def normalize_pk(raw: Column) -> Column:
    """Only what isn't plain ASCII goes through Python."""
    plain = raw.rlike(r"^[ -~]*$")
    return F.coalesce(F.when(plain, ascii_pk(raw)), _normalize(F.when(~plain, raw)))


VOWEL = set("aeiou")


def _measure(stem: str) -> int:
    """Number of times that a consonant follows a vowel."""
    kinds = ["v" if c in VOWEL or c == "y" and i and stem[i - 1] not in VOWEL else "c" for i, c in enumerate(stem)]
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:], strict=False))


# The suffix steps of Porter's published algorithm.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _has_vowel(s: str) -> bool:
    return any(c in VOWEL or c == "y" and i for i, c in enumerate(s))


def _short(s: str) -> bool:
    return len(s) > 2 and s[-1] not in VOWEL | set("wxy") and s[-2] in VOWEL | {"y"} and s[-3] not in VOWEL


def stem(word: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(word) < 3:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz" and w[-1] not in VOWEL:
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for pair in table:
            old, _, new = pair.partition(":")
            if w.endswith(old):
                w = w[: -len(old)] + new if _measure(w[: -len(old)]) > 0 else w
                break
    for old in sorted(STEP4, key=len, reverse=True):
        if w.endswith(old):
            base = w[: -len(old)]
            if _measure(base) > 1 and (old != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@pandas_udf(StringType())
def stemmed(text: pd.Series) -> pd.Series:
    """The words' stems in lower case, put together."""
    return text.map(lambda t: "".join(stem(w) for w in re.findall(r"\w+", t.lower())).replace("01januari", ""), na_action="ignore")
