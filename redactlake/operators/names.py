"""Names of people: a value's words become a string of classes, and patterns over it say what belongs to the name.

I initials, M an initial that may stand for Monsieur, T title, R role, S word that ends a name, A article
(stop word and particle), P particle, C capitalised word, w any other.
"""

from __future__ import annotations

import re

from redactlake.operators import lexicon as L

INITIALS = re.compile(r"(?:[^\W\d_]\.-?)+")
_WORD = re.compile(r"\S+")
_PLAIN_LEAD, _TITLED_LEAD = re.compile(r"[RSAM]*(?:T[TRSA]*)?"), re.compile(r"[TRSA]*")
_NAME = re.compile(r"(?P<name>.[^S]*?)[PATR]*(?:S.*)?$")


def word_class(word: str, key: str, first: bool, dated: bool) -> str:
    if INITIALS.fullmatch(word):
        return "M" if key in ("M", "A") else "I"
    if key in L.MONTHS and not first:
        return "S" if dated or not word[:1].isupper() else "C"
    for letter, words in (("T", L.TITLE_WORDS), ("R", L.ROLES)):
        if key in words:
            return letter
    if key in L.PARTICLES:
        return "A" if key in L.STOPS else "P"
    return "S" if key in L.STOPS else "C" if word[:1].isupper() else "w"


def classes(value: str) -> tuple[list[tuple[int, int]], str]:
    found = list(_WORD.finditer(value))
    out = []
    for i, w in enumerate(found):
        dated = bool(re.match(r"[ \t]*\d", value[w.end() : w.end() + 3]) or re.search(r"\d[ \t]*$", value[max(0, w.start() - 3) : w.start()]))
        out.append(word_class(w[0], L.fold(w[0].strip(".,;:()")), not i, dated))
    return [w.span() for w in found], "".join(out)


def trim(value: str, titled: bool = False) -> tuple[int, int] | None:
    """Bounds of the name in a value; none where no word of it could be a name."""
    spans, kinds = classes(value)
    lead = (_TITLED_LEAD if titled else _PLAIN_LEAD).match(kinds).end()
    body = _NAME.match(kinds, lead)
    if not body:
        return None
    own = range(lead, body.end("name"))
    if not any(kinds[i] in "CSRT" and value[spans[i][0]].isupper() and len(value[slice(*spans[i])].strip(".,;:()")) > 1 for i in own):
        return None
    start, end = spans[own[0]][0], spans[own[-1]][1]
    return start, end if kinds[own[-1]] in "IM" else start + len(value[start:end].rstrip(".,;:()"))


def person_shaped(value: str) -> bool:
    """Two to four words, some in capitals and some not, none of an organisation, a heading or an institution."""
    words = [w for w in value.split() if L.fold(w) not in L.PARTICLES]
    keys = {L.fold(w).strip(".") for w in words}
    shaped = 2 <= len(words) <= 4 and all(re.fullmatch(r"[^\W\d_][\w’'.-]*", w) and w[0].isupper() for w in words) and not re.search(r"\d", value)
    upper = {w.isupper() for w in words if len(w) > 1}
    return shaped and upper == {True, False} and not keys & (L.HEADINGS | L.INSTITUTIONS) and not L.organisation(value)


def name_word(value: str) -> bool:
    """Whether a word may belong to a name: three letters, a capital, no word of a label, a heading or a sentence."""
    keys = [L.fold(w).strip("'’-") for w in re.findall(r"[^\W\d_][\w’'-]{2,}", value) if w[0].isupper()]
    return any(k not in L.STOPS | L.HEADINGS | L.LABEL_WORDS and not re.search(r"\d", k) for k in keys)


def two_people(left: str, right: str, kinds: set[str]) -> bool:
    """Whether names side by side are of two people: groups of initials, an initial that begins the second, or both whole."""
    begins = classes(right)[1][:1] in ("I", "M")
    return "initials" in kinds or begins or min(len(left.split()), len(right.split())) > 1


def keys(value: str) -> set[str]:
    """Words by which a name can be told again."""
    found = {L.fold(w).strip("'’-") for w in re.findall(r"[^\W\d_][\w’'-]+", value) if w[0].isupper()}
    return {k for k in found if len(k) >= 3 and k not in L.PARTICLES | L.STOPS}
