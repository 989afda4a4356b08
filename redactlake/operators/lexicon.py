"""Word lists of the rules, folded to upper case without marks where ``fold`` is named."""

from __future__ import annotations

import unicodedata


def fold(text: str) -> str:
    """Upper case without marks."""
    if text.isascii():
        return text.upper()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).upper()


def folded(words: str) -> frozenset[str]:
    return frozenset(fold(w) for w in words.split())


# Forms of address, by gender where they have one.
TITLES = {"m": "monsieur mr messieurs dhr heer", "f": "madame mme mlle mademoiselle mesdames mevr mevrouw", "": "me maître maîtres dr docteur prof professeur meester"}
TITLE_WORDS = folded(" ".join(TITLES.values()))
# Offices and roles before or in place of names.
ROLES = folded(
    "juge président présidente greffier greffière procureur avocat avocate avocats notaire huissier substitut conseiller conseillère expert experte "
    "commissaire inspecteur inspectrice agent brigadier témoin prévenu prévenue inculpé inculpée demandeur demanderesse défendeur défenderesse appelant "
    "appelante intimé intimée requérant requérante curateur curatrice tuteur tutrice médiateur médiatrice bâtonnier rapporteur père mère fils fille "
    "frère sœur époux épouse oncle tante cousin cousine veuve veuf enfant bourgmestre ministre échevin directeur directrice rechter griffier advocaat"
)
# Street types.
STREETS = "rue avenue boulevard chaussée place allée impasse chemin quai cours square route sentier clos drève venelle esplanade passage faubourg montée"
STREET_WORDS = folded(STREETS)
# Particles of names.
PARTICLES = folded("de du des d la le les van von den der ten ter vander vanden di da del della el al ben ibn bin aan op 't")
# Words that end a name.
STOPS = folded(
    "et ou où à au aux en dans par pour sur avec sans chez est sont était né née nés domicilié domiciliée demeurant assisté assistée représenté "
    "représentée contre qui que dont ce cette ces son sa ses leur leurs il elle ils elles a ont avait comparaît partie parties cause tribunal cour "
    "arrêt jugement article loi code chambre section date le la les un une registre national numéro rue tél gsm fax email e-mail nationalité et-al "
    "après avant depuis vu attendu considérant dit ayant étant"
)
# Common first names, by gender.
FIRST_NAMES = {
    "m": "jean pierre paul jacques michel andré philippe alain bernard marc luc thomas nicolas julien antoine françois olivier david laurent vincent "
    "christophe sébastien patrick daniel eric éric henri louis charles mohamed ahmed karim youssef guy yves benoît xavier simon maxime hugo lucas "
    "arthur jan piet kris bart wim koen geert tom stijn peter dirk joris mathieu guillaume alexandre rené robert georges albert "
    "adrien aurélien benjamin bruno charly cédric damien didier dimitri édouard émile étienne fabien fabrice félix fernand florent franck frédéric gabriel "
    "gaston gauthier gérard gilles grégory hassan hervé ibrahim ismaël jacky jérémy jérôme joël jonathan joseph kevin laurens léon loïc mehmet mehdi mustapha noah "
    "omar pascal raphaël rachid raymond romain said samuel serge stefan stéphane théo thierry tristan valentin walter willem willy yannick steve",
    "f": "marie anne sophie catherine isabelle nathalie julie claire christine monique martine françoise sylvie valérie sandrine véronique brigitte "
    "céline caroline laura emma léa camille pauline charlotte alice louise jeanne élise hélène fatima amina nadia sarah els an katrien inge greet "
    "leen sofie lies annick chantal virginie laurence patricia aurélie émilie manon juliette "
    "adèle agnès aïcha alexandra amandine amélie anaïs angélique audrey aurore béatrice bernadette cécile chloé christelle clara coralie corinne danielle delphine "
    "denise ariane éliane elisabeth élodie emmanuelle estelle eva fabienne fanny florence bénédicte gabrielle geneviève géraldine ghislaine gisèle hanane hilde ingrid "
    "inès jacqueline joëlle joséphine karima khadija laetitia layla lucie lydia madeleine magali marion marguerite mathilde mélanie mireille muriel myriam nadine nicole "
    "odette pascale rachel samira sabine sara séverine simone solange sonia stéphanie suzanne vanessa yasmina yolande yvette zoé",
    "": "dominique claude camille maxence sacha alix andrea kim",
}
GENDER = {fold(n): g for g, names in FIRST_NAMES.items() for n in names.split()}
# First names that are words of the language too.
AMBIGUOUS = folded("rose claire aimé constant clément désiré juste ange violette pascal prudence florence olive tom an els kim victor blanche")
# Months.
MONTHS = folded("janvier février mars avril mai juin juillet août septembre octobre novembre décembre januari februari maart april mei juni juli augustus september oktober november december")
# Words of headings and of courts in capitals, which are no names.
HEADINGS = folded(
    "arrêt jugement ordonnance tribunal cour appel cassation constitutionnelle première instance chambre greffe motifs dispositif conclusions parties "
    "faits procédure droit cause demande défense annexe article loi code division rapport expertise médicale audition interrogatoire an deux mille vingt quatre cinq six sept huit neuf royaume belgique république française bruxelles liège mons gand anvers paris "
    "audience publique procès verbal police parquet ministère public avis note page total inventaire pièces requête citation notification acte bail contrat"
)
# Institutions that stay readable.
INSTITUTIONS = folded(
    "cour tribunal conseil commission parlement sénat chambre ministère ministre état commune ville province région université école hôpital cpas ocmw "
    "onem inami onss police parquet barreau ordre banque institut office agence service administration spf union onu otan greffe"
)
# Countries and parts of them, one to a name.
COUNTRIES = frozenset(
    fold(x.replace("_", " "))
    for x in (
        "afrique afrique_du_sud albanie algérie allemagne amérique angleterre argentine arménie asie australie autriche belgique bénin bosnie brésil bulgarie burundi "
        "cameroun canada chili chine chypre colombie congo corée_du_sud côte_d'ivoire croatie danemark écosse égypte espagne estonie états-unis éthiopie europe finlande "
        "flandre france géorgie ghana grèce guinée hongrie inde indonésie irak iran irlande islande israël italie japon kosovo lettonie liban libye lituanie luxembourg "
        "macédoine mali malte maroc mauritanie mexique moldavie monténégro nederland niger nigeria norvège pakistan palestine pays-bas pérou philippines pologne portugal "
        "rdc république_démocratique_du_congo roumanie royaume-uni royaume_de_belgique russie rwanda sénégal serbie slovaquie slovénie soudan suède suisse syrie tchad "
        "tchéquie thaïlande togo tunisie turquie ukraine union_européenne venezuela vietnam wallonie région_wallonne région_flamande "
        "communauté_française communauté_flamande communauté_germanophone bruxelles-capitale"
    ).split()
)
# Legal forms and trades in the names of organisations.
COMPANY_WORDS = folded(
    "sa srl sprl scrl sc scs snc asbl aisbl nv bv bvba vzw sarl sas sasu eurl gie gmbh ltd llc inc plc société groupe group holding consulting services "
    "assurances banque bank mutuelle entreprise fondation association associés syndicat cabinet étude bureau immobilière immo construction constructions transport transports invest partners company"
)
# Labels of identifiers, which are no names.
LABEL_WORDS = folded("rg fa rn nn niss insz rrn rép no nr numéro numéros tél gsm fax iban bic tva btw bce kbo pv notice portalis matricule")
# Dotted abbreviations that are no initials.
ABBREVIATIONS = frozenset("p.v. r.g. j.t. t.v.a. s.a. n.v. b.v. a.r. m.b. c.c. c.p. c.j. n.n. r.n. e.a. i.e. p.s. b.p. u.e. c.e. j.o. r.w. p.p. a.m. p.m.".split())


def is_first_name(word: str) -> bool:
    return all(p in GENDER for p in fold(word).split("-")) if word else False


ARTICLES = ("L'", "D'", "LE ", "LA ", "LES ", "DE ", "DU ", "DES ", "AU ", "AUX ")
OTHERS = ("E.A.", "E.A", "ET AUTRES", "ET CONSORTS", "C.S.")


def normal(value: str) -> str:
    """A name as it is compared: folded, without quotes, articles before it and "et autres" after it."""
    key = " ".join(fold(value).translate({ord(c): " " for c in "«»\"“”"} | {ord("’"): "'"}).split())
    while key.startswith(ARTICLES):
        key = key.removeprefix(next(a for a in ARTICLES if key.startswith(a))).lstrip()
    while tail := next((o for o in OTHERS if key.endswith((f" {o}", f",{o}"))), None):
        key = key.removesuffix(tail).rstrip(" ,")
    return key.strip(" ,.")


def institution(value: str) -> bool:
    key = normal(value)
    head = key.replace("'", " ").replace("-", " ").split()
    return bool(head) and head[0] in INSTITUTIONS or key in COUNTRIES


def organisation(value: str) -> bool:
    """A legal form or a trade, or an ampersand."""
    return "&" in value or any(w.strip(".,").replace(".", "") in COMPANY_WORDS for w in fold(value).replace("/", " ").split())
