"""Numbers that carry a key, telephone numbers and lists of references.

A value is read into its parts, then graded by tables: which key a number has, and
how sure each of its states makes the rule that found it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from redactlake.functions.checks import IBAN_LENGTHS


@dataclass(frozen=True)
class Key:
    """A number of ``size`` digits whose last ones follow from the first ``body`` modulo 97."""

    size: int
    body: int
    leads: tuple[str, ...] = ("",)  # digits that may stand, unwritten, before the body
    plain: bool = False  # the key is the rest itself, 97 for 0, and not 97 less the rest


# National number (2 before the body from the year 2000 on), social security number, enterprise number, account.
KEYS = {"national": Key(11, 9, ("", "2")), "social": Key(15, 13), "enterprise": Key(10, 8), "account": Key(12, 10, plain=True)}

# The score of a rule's value by its state, the surest first; the last one holds without any.
GRADES: dict[str, tuple[tuple[str, float], ...]] = {
    "R01": (("key", 1.0), ("dotted", 0.75), ("", 0.3)),
    "R02": (("key", 1.0), ("spaced", 0.7), ("", 0.4)),
    "R03": (("listed key", 1.0), ("key", 0.9), ("listed", 0.65)),
    "R04": (("parted key", 0.9), ("key", 0.6), ("prefix", 0.6), ("dotted", 0.4), ("", 0.25)),
    "R05": (("key", 0.9), ("", 0.6)),
    "address": (("city", 0.9), ("number", 0.85), ("", 0.6)),
}


def mod97(text: str) -> int:
    """Digits, and letters as 10 to 35, read as one number modulo 97."""
    return reduce(lambda rest, v: (rest * (100 if v > 9 else 10) + v) % 97, (int(c, 36) for c in text), 0)


def holds(name: str, digits: str) -> bool:
    key = KEYS[name]
    if len(digits) != key.size or not digits.isdecimal():
        return False
    rests = (mod97(lead + digits[: key.body]) for lead in key.leads)
    return int(digits[key.body :]) in {(r or 97) if key.plain else 97 - r for r in rests}


def grade(table: str, states: set[str]) -> float | None:
    return next((score for state, score in GRADES[table] if not state or state in states), None)


def grouped(*sizes: int, blanks: str) -> str:
    """A pattern of groups of digits with the same separator, or none, between them."""
    return "|".join(re.escape(b).join(rf"\d{{{n}}}" for n in sizes) for b in ("", *blanks))


def iban(text: str) -> tuple[int, float] | None:
    """Where a written IBAN ends, at the length of its country, and its score."""
    shown = [(i, c) for i, c in enumerate(text, 1) if not c.isspace()]
    listed = IBAN_LENGTHS.get("".join(c for _, c in shown[:2]))
    size = listed or len(shown)
    if not 15 <= size <= min(34, len(shown)):
        return None
    value = "".join(c for _, c in shown[:size])
    key = mod97(value[4:] + value[:4]) == 1
    score = grade("R03", {*(["listed"] if listed else []), *(["key"] if key else []), *(["listed key"] if listed and key else [])})
    return None if score is None else (shown[size - 1][0], score)


# Telephone numbers: a candidate is a run of groups of digits; the grammar of its prefix says how many belong to it.

# Countries whose compact numbers may begin with 00.
COMPACT_CODES = ("31", "32", "33", "34", "39", "40", "41", "44", "48", "49", "90", "212", "213", "216", "351", "352", "377")
PHONE_SCORES = {"R21": 0.75, "R22": 0.55, "R23": 0.8, "R24": 0.85, "R25": 0.85}
CANDIDATE = re.compile(r"(?<![\w+])(?:\+(?=[1-9])|\((?=0\d{1,3}\))|(?=0\d))[\d(][\d() \t./-]*")
_PARTS = re.compile(r"(?P<gap>[^\d(]*\(0\)[^\d]*|[^\d]*)(?P<d>\d+)")  # a nought in brackets is not dialled from abroad
_GAP = re.compile(r"[ \t]?[./-][ \t]?|[ \t]")
_NOUGHT, _BRACKETS = re.compile(r"[ \t]*\(0\)[ \t]*"), str.maketrans("", "", "()")


def phone(text: str, start: int, raw: str) -> tuple[str, int] | None:
    """The rule and the end of the number that a candidate begins with."""
    abroad, bracket = raw.startswith(("+", "00")), raw.startswith("(")
    if not abroad and re.search(r"[\w+/,-]$|\d\.$", text[max(0, start - 2) : start]):
        return None
    head = 2 if raw.startswith("00") else int(abroad or bracket)
    parts = [(_NOUGHT.sub(" ", p["gap"]).translate(_BRACKETS) if abroad or bracket else p["gap"], p["d"], p.end(), "(0)" in p["gap"]) for p in _PARTS.finditer(raw, head)]
    if not parts:
        return None
    least, most, first, fewest = (9, 15, range(1, 8), 1) if abroad else (9, 10, range(2, 5), 2)
    taken, end, groups = len(parts[0][1]), parts[0][2], 0
    if taken not in first:  # written in one
        return _compact(text, start, raw, parts[0][1], end, abroad, bracket)
    for gap, d, at, whole in parts[1:]:
        sizes = range(1, 11 if whole else 7) if abroad else range(2, 5) if bracket and not groups else range(2, 4)
        apart = _GAP.fullmatch(gap) or not gap and (abroad or bracket)
        if not apart or len(d) not in sizes or taken + len(d) > most or groups == 6:
            break
        taken, end, groups = taken + len(d), at, groups + 1
    if not least <= taken <= most or groups < fewest or re.match(r"[./-]?\d", text[start + end : start + end + 2]):
        return None
    company = not abroad and re.fullmatch(r"\d{4}(?:\.\d{3}){2}", raw[:end]) and holds("enterprise", re.sub(r"\D", "", raw[:end]))
    return None if company else ("R24" if abroad else "R23" if bracket else "R21", end)


def _compact(text: str, start: int, raw: str, digits: str, end: int, abroad: bool, bracket: bool) -> tuple[str, int] | None:
    if bracket or re.match(r"\w", text[start + end : start + end + 1]):
        return None
    if not abroad:
        return ("R22", end) if len(digits) in (9, 10) and digits[1] != "0" else None
    code = raw.startswith("+") or any(digits.startswith(c) and 7 <= len(digits) - len(c) <= 12 for c in COMPACT_CODES)
    return ("R25", end) if code and 9 <= len(digits) <= 15 else None


# Lists of references: after a label, one reference, then others that can't be anything else.

_PART = r"[A-Z0-9]{1,10}"
#: Parts of a reference, of which the first few may be letters alone, with a stroke, a dot or a hyphen between them.
SHAPED = rf"(?=[A-Z./-]{{0,16}}\d){_PART}(?:[/.-]{_PART}){{1,7}}"
_REFERENCE = re.compile(rf"(?=[A-Z./ \t-]{{0,16}}\d){_PART}(?:(?:[.-]|[ \t]?/[ \t]?){_PART}){{0,7}}(?!\w)")
_PLAIN = re.compile(r"\d{3,6}(?![\w/]|[.,]\d)")


def joint(*marks: str) -> re.Pattern:
    return re.compile(rf"[ \t]*(?:{'|'.join(map(re.escape, marks))})[ \t]*")


# What stands between the references of a list, and between plain numbers.
_AND, _PLAIN_AND = joint(",", ";", "&", "–", "—", "-", "et", "en", "à"), joint(",", ";", "&", "et", "en")


def references(text: str, start: int, plain: bool = False) -> int | None:
    """Where a list of references that begins at start ends: others have two parts, or (plain) three to six digits."""
    first = _REFERENCE.match(text, start)
    if not first:
        return None
    end = first.end()
    while True:
        joint = _AND.match(text, end)
        more = joint and _REFERENCE.match(text, joint.end())
        if more and re.search(r"[/.-]", more[0]):
            end = more.end()
            continue
        joint = _PLAIN_AND.match(text, end) if plain else None
        more = joint and _PLAIN.match(text, joint.end())
        if not more:
            return end
        end = more.end()
