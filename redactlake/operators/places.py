"""What the words before a name say of it: the seat of a court, somebody's home, a company's seat, a theory's author."""

from __future__ import annotations

import re

from redactlake.operators import lexicon as L

# Words that begin a court's name, and words that may stand between one and its seat.
COURT_HEADS = L.folded(
    "tribunal tribunaux cour cours barreau parquet division auditorat greffe arrondissement canton ressort juridiction ordre prudhommes justice rechtbank hof balie"
)
COURT_LINKS = L.folded(
    "de du des d la l le les au première instance appel entreprise travail commerce famille police paix justice correctionnel correctionnelle civil civile "
    "judiciaire administratif francophone néerlandophone grande jeunesse chambre section siège cassation assises conseil ordre avocats ordinaire application "
    "peines référé référés van te eerste aanleg"
)
COURT_ENDS = L.folded("de du des d l van te")
# Stems of words that tie a place to a person (over a comma, and only within a clause), and to a company.
HOME_STEMS = ("DOMICILI", "DEMEUR", "RESID", "HABIT", "HEBERG", "VIT", "VIVENT", "VIVAIT", "INSTALL", "WONEND", "WOONACHTIG")
BIRTH_WORDS = L.folded("né née nés nées décédé décédée décédés originaire originaires domicile résidence naissance geboren")
SEAT_STEMS = ("SIEGE", "ETABLI", "FIXE", "SITUE", "SIS", "IMPLANTE", "LOCALISE", "SOCIAL", "EST", "SONT")
# Things that carry their author's name.
EPONYMS = L.folded("méthode formule table tables barème théorie doctrine jurisprudence loi lois règle principe critère critères test")
AT = L.folded("à au aux en te in")


def _before(text: str, start: int, most: int) -> str:
    """The text before a place on its line."""
    return text[max(text.rfind("\n", 0, start) + 1, start - most, 0) : start]


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\s'’-]+", L.fold(text)) if w]


def court_seat(text: str, start: int) -> bool:
    """Whether only words of courts' names lie between a court and the place."""
    clause = re.split(r"[,;:()\[\]«»\"]", _before(text, start, 120))[-1]
    kinds = "".join("h" if w in COURT_HEADS else "e" if w in COURT_ENDS else "l" if w in COURT_LINKS else "x" for w in _words(re.sub(r"(?i)prud['’ ]?hommes", "prudhommes", clause)))
    return bool(re.search(r"h[hel]*$", kinds)) and kinds[-1] in "he"


def of_person(text: str, start: int) -> bool:
    """Whether someone lives, was born or has died there."""
    clause = re.split(r"[.;]", _before(text, start, 100))[-1]
    words = _words(clause)
    if not words or words[-1] not in AT or not clause[-1:].isspace():
        return False
    return any(w.startswith(HOME_STEMS) for w in words) or any(w in BIRTH_WORDS for w in _words(clause.split(",")[-1][-60:]))


def of_seat(text: str, start: int) -> bool:
    """Whether a company or a building lies there, whatever a model takes the name for."""
    words = _words(_before(text, start, 60))
    own = words[-2:-1]
    return bool(words) and words[-1] in AT and bool(own) and own[0].startswith(SEAT_STEMS) and any(w.startswith(SEAT_STEMS[:7]) for w in words[-4:-1])


def of_author(text: str, start: int) -> bool:
    """Whether the name is that of a method, a law or a theory."""
    words = _words(_before(text, start, 30))
    while words and words[-1] in ("DE", "D"):
        words.pop()
    return bool(words) and words[-1] in EPONYMS
