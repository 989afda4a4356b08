"""Text scalars as Column functions: all run inside Catalyst."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks (to U+024F) that fall apart into a plain letter and marks, and those letters.
_MARKED = [(chr(k), d[0]) for k in range(0xC0, 0x250) if (d := unicodedata.normalize("NFKD", chr(k)))[0].isascii() and d[0].isalpha() and len(d) > 1 and all(map(unicodedata.combining, d[1:]))]
ACCENTED, PLAIN = ("".join(x) for x in zip(*_MARKED, strict=True))
# Blanks and hyphens of one character, and what stands for them.
ODD_BLANKS = "\u00a0\u2002\u2003\u2007\u2009\u200a\u202f\u2010\u2011"
PLAIN_BLANKS = "       --"
# Characters without width, which extraction removes.
NO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
EDGE_JUNK = " \t\n\r,;:!?()[]{}\"'«»“”‘’-–—*_|/"


def fold(x: Column) -> Column:
    """Upper case without marks."""
    return F.upper(F.translate(F.replace(x, F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN))


def same_length_blanks(x: Column) -> Column:
    """Odd blanks and hyphens as plain ones; offsets stay."""
    return F.translate(x, ODD_BLANKS, PLAIN_BLANKS)


# Compatibility characters that extraction leaves, and the letters they stand for (NFKC): ligatures, forms of figures and letters, dots.
COMPATIBLE = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st", "\u2026": "...", "\u2122": "TM", "\u2116": "No", "\u0132": "IJ", "\u0133": "ij"}


def compatible(x: Column) -> Column:
    """Compatibility characters of printed text as plain ones; full-width forms and other blanks too."""
    wide = "".join(chr(k) for k in range(0xFF01, 0xFF5F))
    x = F.translate(x, wide + ODD_BLANKS[:7] + "\u3000", "".join(chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F)) + " " * 8)
    for odd, plain in COMPATIBLE.items():
        x = F.replace(x, F.lit(odd), F.lit(plain))
    return x


def clean_extracted(x: Column) -> Column:
    """Extracted text: compatibility characters as plain ones, none without width, LF lines without trailing blanks, one empty line at most."""
    x = F.translate(compatible(x), NO_WIDTH, "")
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def words(x: Column) -> Column:
    """Words of a text: runs of letters, marks inside kept."""
    return F.regexp_extract_all(x, F.lit(r"[\p{L}][\p{L}'’-]*"), F.lit(0))


def list_term(x: Column) -> Column:
    """A term of an allow list: lower case, blanks collapsed."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def edge_offsets(x: Column) -> tuple[Column, Column]:
    """Characters of junk at the start and at the end of a span's text."""
    return F.length(x) - F.length(F.ltrim(x, F.lit(EDGE_JUNK))), F.length(x) - F.length(F.rtrim(x, F.lit(EDGE_JUNK)))


def repair_digits(x: Column) -> Column:
    """O and l read for digits in tokens of at least four digits and no more letters than half."""
    token = lambda t: F.when(
        (F.length(digits(t)) >= 4) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) * 2 <= F.length(t)), F.translate(t, "OoIl|", "00111")
    ).otherwise(t)
    return F.array_join(F.transform(F.split(x, " "), token), " ")


def thousands(n: Column) -> Column:
    """A number with blanks between thousands."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


# Roman numerals by value.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: Column) -> Column:
    out, left = F.lit(""), n
    for value, letters in ROMAN:
        out = F.concat(out, F.repeat(F.lit(letters), F.floor(left / value).cast("int")))
        left = left % value
    return out


def letters(n: Column) -> Column:
    """List letters: a ... z, aa ... az, ba ... zz, aaa ...: digits of base 26 without a nought."""
    units, left = F.lit(""), n
    for _ in range(4):
        more = left > 0
        units = F.when(more, F.concat(F.char((left - 1) % 26 + 97), units)).otherwise(units)
        left = F.when(more, F.floor((left - 1) / 26)).otherwise(F.lit(0))
    return units


def list_number(n: Column, style: Column) -> Column:
    """A list item's number in a word processor's style."""
    return (
        F.when(style == "decimalZero", F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string")))
        .when(style == "lowerLetter", letters(n))
        .when(style == "upperLetter", F.upper(letters(n)))
        .when(style == "lowerRoman", roman(n))
        .when(style == "upperRoman", F.upper(roman(n)))
        .when(style == "ordinal", F.concat(n.cast("string"), F.when(n == 1, "er").otherwise("e")))
        .otherwise(n.cast("string"))
    )


def is_page_number(x: Column) -> Column:
    return x.rlike(r"(?i)^\s*(?:page|p\.|blz\.?)?\s*[-–]?\s*\d{1,4}\s*(?:(?:/|sur|van|of)\s*\d{1,4})?\s*[-–]?\s*$")


def margin_key(x: Column) -> Column:
    """A header's or footer's text with its numbers made alike."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))), r"\d+", "#")


def garbled(x: Column) -> Column:
    """At least 20 visible characters of which over a fifth are private, control or replacement characters."""
    shown = F.regexp_replace(x, r"\s", "")
    odd = F.length(F.regexp_replace(shown, "[^\\p{Co}\\p{Cc}\\p{Cn}\\x{FFFD}]", ""))
    return (F.length(shown) >= 20) & (odd * 5 > F.length(shown))


def solid_word(text: Column, conf: Column) -> Column:
    """A word that OCR has read surely enough."""
    n = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return ((n >= 3) & (conf >= 70)) | ((n >= 2) & (conf >= 85))


def download_name(path: Column) -> Column:
    """The name of the redacted file of an upload."""
    base = F.regexp_replace(path, r"^.*[/\\]", "")
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    stem = F.trim(F.regexp_replace(stem, r'["<>:|?*\x00-\x1f]', "_"))
    return F.concat(F.lit("a-"), F.substring(F.when(stem == "", "document").otherwise(stem), 1, 150), F.lit(".md"))
