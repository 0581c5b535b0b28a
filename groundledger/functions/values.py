"""Column functions: text normalisers, areas, shares, confidences, distances."""

from __future__ import annotations

import unicodedata
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Square metres of the area units, as the nearest doubles; a quotient may be the one beside it, and ties turn on that.
UNIT_SQM = {
    "BIGHA": 2529.285, "BISWA": 126.46425, "ACRE": 4046.86, "HECTARE": 10_000.0, "SQUARE_METRE": 1.0,
    "GUNTHA": 101.1715, "CENT": 40.4686,
}
#: First code points of the decimal digits of Arabic, Indic scripts and full width.
_DIGIT_ZEROS = (0x660, 0x6F0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xFF10)
#: Code-point ranges of the scripts told apart.
SCRIPTS = {"LATIN": "A-Za-z\\u00C0-\\u024F", "DEVANAGARI": "\\u0900-\\u097F", "BENGALI": "\\u0980-\\u09FF", "ARABIC": "\\u0600-\\u06FF"}


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no function for it."""
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Normal form C without white space at the edges, case-folded; lower() keeps a sharp s apart from ss."""
    return text.map(lambda x: unicodedata.normalize("NFC", x).strip().casefold(), na_action="ignore")


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "".join(chr(z + d) for z in _DIGIT_ZEROS for d in range(10)), "0123456789" * len(_DIGIT_ZEROS))


def tidy(text: Column) -> Column:
    """Normal form C, white space collapsed and trimmed; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(nfc(text), "\\s+", " ")), F.lit(""))


def plot_number(text: Column) -> Column:
    """Digits joined by slashes, after other separators became slashes."""
    plain = F.regexp_replace(F.translate(ascii_digits(text), "|\\।", "///"), "\\s*/\\s*", "/")
    return F.nullif(F.regexp_extract(plain, "\\d+(?:/\\d+)*", 0), F.lit(""))


def number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.translate(ascii_digits(text), ",", ""), "\\d+(?:\\.\\d+)?", 0), F.lit("")).try_cast("double")


def script_counts(text: Column) -> Column:
    """Map of script to its number of letters."""
    return F.create_map(*[x for name, chars in SCRIPTS.items() for x in (F.lit(name), F.regexp_count(text, F.lit(f"[{chars}]")))])


def comparison_key(text: Column) -> Column:
    """What two spellings are compared by: folded, without white space and the punctuation put between numbers and names."""
    return F.regexp_replace(folded(text), "[\\s.,;:।|/\\\\-]+", "")


def square_metres(value: Column, unit: Column) -> Column:
    """Area in square metres; null for an unknown unit."""
    return value * F.create_map(*[F.lit(x) for pair in UNIT_SQM.items() for x in pair])[unit]


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over the larger magnitude; 0 if both are 0."""
    return F.coalesce(F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b))), F.when((a == 0) & (b == 0), 0.0))


def fused_confidence(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the signals that are present, clamped to [0, 1]; 0 without any."""
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts), F.lit(0.0))
    value = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.greatest(F.least(F.coalesce(F.try_divide(value, total), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "HIGH").when(confidence >= 0.60, "MEDIUM").otherwise("LOW")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda k: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), k, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes."""
    return F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def planar_area(ring: Column) -> Column:
    """Shoelace area of an array of (x, y)."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def box_overlap(a: str, b: str) -> Column:
    """Overlap area of two boxes (columns <name>_x1, _y1, _x2, _y2)."""
    w = F.least(F.col(f"{a}_x2"), F.col(f"{b}_x2")) - F.greatest(F.col(f"{a}_x1"), F.col(f"{b}_x1"))
    h = F.least(F.col(f"{a}_y2"), F.col(f"{b}_y2")) - F.greatest(F.col(f"{a}_y1"), F.col(f"{b}_y1"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def content_digest(fields: dict[str, Column]) -> tuple[Column, Column]:
    """Canonical JSON (keys in order, nulls kept, no blanks) of the fields, and its SHA-256."""
    body = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return body, F.sha2(body, 256)


#: Fixed value: numbers in a hashed vector.
NGRAM_SIZE = 768


@F.pandas_udf(ArrayType(DoubleType()))
def ngram_vector(text: pd.Series) -> pd.Series:
    """Counts of the lower-cased text's trigrams by an 8-byte BLAKE2b digest modulo NGRAM_SIZE, scaled to length one."""

    def vector(value: str) -> list[float]:
        plain = f"  {unicodedata.normalize('NFC', value.lower())}  "
        out = np.zeros(NGRAM_SIZE)
        for k in range(len(plain) - 2):
            out[int.from_bytes(blake2b(plain[k : k + 3].encode(), digest_size=8).digest(), "big") % NGRAM_SIZE] += 1
        return (out / (np.linalg.norm(out) or 1.0)).tolist()

    return text.map(vector, na_action="ignore")
