"""Devanagari in Latin letters, and English readings of record values.

A word is cut into syllables: an onset consonant or none, a vowel, marks. Each
syllable's kind is one letter of a shape string, on which two substitutions
delete the vowels that Hindi doesn't speak. Functions of one value are memoised,
as record values repeat.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Latin letters of vowels, vowel signs and consonants, without and with a dot below.
VOWELS = {
    "अ": "a", "आ": "a", "इ": "i", "ई": "ī", "उ": "u", "ऊ": "u", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o",
    "औ": "au",
}
SIGNS = {
    "ा": "a", "ि": "i", "ी": "ī", "ु": "u", "ू": "u", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au",
}
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh",
    "ष": "sh", "स": "s", "ह": "h", "ळ": "l",
}
DOTTED = {
    "ड": "r", "ढ": "rh", "ज": "z", "फ": "f", "क": "q", "ग": "gh",
}
HALANT, DOT, ANUSVARA, CHANDRABINDU, VISARGA = "्", "़", "ं", "ँ", "ः"
LABIALS = frozenset("p ph b bh m".split())
WHOLE_WORDS = {"सिंह": "Singh", "ज्ञान": "Gyan"}
#: Vocabulary of the records.
GLOSSARY = {
    "सिंचित": "Irrigated", "असिंचित": "Unirrigated", "बंजर": "Barren", "चारागाह": "Pasture", "आबादी": "Habitation",
    "बीघा": "bigha", "बिस्वा": "biswa", "हेक्टेयर": "hectare", "एकड़": "acre",
    "विक्रय": "Sale", "उत्तराधिकार": "Inheritance", "दान": "Gift", "बंटवारा": "Partition", "न्यायालय आदेश": "Court decree",
    "शुद्धि": "Correction", "अन्य": "Other",
    "उत्तर प्रदेश": "Uttar Pradesh", "डेमो जिला": "Demo District", "डेमो तहसील": "Demo Tehsil", "जिला": "District", "तहसील": "Tehsil", "ग्राम": "Village",
    "टिप्पणी": "Remark", "अभिलेख डिजिटलीकरण हेतु": "For record digitisation", "स्व.": "Late",
}
#: Place names that a call may bring; they travel with the tasks.
MOST_PLACES = 100_000

_WORD = re.compile("[ऀ-ॿ]+")
_SYLLABLE = re.compile(f"([{''.join(CONSONANTS)}])({DOT}?)([{HALANT}{''.join(SIGNS)}]?)|([{''.join(VOWELS)}])")
_PLAIN = str.maketrans("०१२३४५६७८९।", "0123456789.")


def _shape(found: re.Match, marks: str) -> str:
    """x: no vowel; s, h, n: spoken a of a consonant, bare, with a visarga, with a nasal; m: other vowel; v: a vowel alone."""
    if found[4]:
        return "v"
    if found[3]:
        return "x" if found[3] == HALANT else "m"
    return "n" if ANUSVARA in marks or CHANDRABINDU in marks else "h" if VISARGA in marks else "s"


@lru_cache(maxsize=1 << 16)
def romanised(word: str) -> str:
    """One word of Devanagari in Latin letters."""
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    found = list(_SYLLABLE.finditer(word))
    if not found:
        return word
    edges = [m.start() for m in found[1:]] + [len(word)]
    marks = [word[m.end() : edge] for m, edge in zip(found, edges, strict=True)]
    shape = "".join(map(_shape, found, marks))
    # The last a falls after a vowel; inside, an a falls between two vowels, never two in a row.
    shape = re.sub("(?<=[^x])[sh]$", "x", shape)
    shape = re.sub("(?<=[shnmv])s([shnm])", r"x\1", shape)
    onsets = [(DOTTED.get(m[1]) if m[2] else None) or CONSONANTS.get(m[1], "") for m in found]
    out = []
    for k, (m, kind) in enumerate(zip(found, shape, strict=True)):
        after_bare = k > 0 and shape[k - 1] == "x"
        out.append("w" if onsets[k] == "v" and after_bare else onsets[k])
        vowel = "" if kind == "x" else VOWELS[m[4]] if kind == "v" else SIGNS[m[3]] if kind == "m" else "a"
        out.append(vowel if vowel != "ī" else "i" if k == len(found) - 1 else "ee")
        nasal = [c for c in marks[k] if c in ANUSVARA + CHANDRABINDU]
        if nasal:
            out.append("m" if nasal[-1] == ANUSVARA and "".join(onsets[k + 1 : k + 2]) in LABIALS else "n")
        out.append("h" if VISARGA in marks[k] else "")
    return "".join(out)


def transliterated(text: str) -> str:
    """The text with its Devanagari words in Latin letters, capitalised."""

    def word(m: re.Match) -> str:
        latin = romanised(m[0])
        return latin[:1].upper() + latin[1:]

    return _WORD.sub(word, unicodedata.normalize("NFC", text).translate(_PLAIN))


def english_reader(places: dict[str, str] | None = None) -> Callable[[str | None], tuple[str, str, bool]]:
    """A function from a value to (english, method, has_devanagari); places go before the glossary."""
    if len(places or ()) > MOST_PLACES:
        raise ValueError(f"more than {MOST_PLACES} places; join them by name instead")
    normal = {unicodedata.normalize("NFC", k): v for k, v in (GLOSSARY | (places or {})).items()}
    ordered = sorted(normal, key=len, reverse=True)
    phrase = "|".join(re.escape(p) + ("" if p.endswith(".") else r"(?=[\s:,/()\-]|\Z)") for p in ordered)
    token = re.compile(rf"(?P<phrase>{phrase})|\s+|\S+")

    @lru_cache(maxsize=1 << 16)
    def read(value: str | None) -> tuple[str, str, bool]:
        text = " ".join(unicodedata.normalize("NFC", value or "").split())
        if not _WORD.search(text):
            return unicodedata.normalize("NFC", value or "").strip(), "none", False
        if text in normal:
            return normal[text], "glossary", True
        pieces = [(normal[m[0]], True) if m["phrase"] else (m[0], False) for m in token.finditer(text)]
        spelt = any(not known and _WORD.search(p) for p, known in pieces)
        joined = " ".join(p if known else transliterated(p) for p, known in pieces)
        english = " ".join(re.sub(r"\s+([:,.)])", r"\1", joined).split())
        known = any(k for _, k in pieces)
        return english, "mixed" if known and spelt else "glossary" if known else "transliteration", True

    return read


@F.pandas_udf(StringType())
def transliterate(text: pd.Series) -> pd.Series:
    """Devanagari words in Latin letters; null stays null."""
    return text.map(transliterated, na_action="ignore")


def to_english(value: Column, places: dict[str, str] | None = None) -> Column:
    """A struct (english, method, has_devanagari); a null value reads as the empty text."""
    english_reader(places)

    @F.pandas_udf("english string, method string, has_devanagari boolean")
    def run(text: pd.Series) -> pd.DataFrame:
        read = english_reader(places)
        return pd.DataFrame([read(x if isinstance(x, str) else None) for x in text], columns=["english", "method", "has_devanagari"])

    return run(value)
