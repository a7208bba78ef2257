"""What is no firm: named rules over one candidate, each with an example that it alone or first catches."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

from inkveil.functions.text import mojibake_py, remove_accents_py, repair_pdf_py
from inkveil.operators.noise import Lexicon

# Legal forms; what stands before a noun; words for a firm, and verbs that make it a sentence.
LEGAL_FORM = re.compile(r"\b(?:inc|incorporated|corp|corporation|ltd|limited|llc|llp|plc|co|company|lp|sas|sarl|gmbh|ag|bv|nv|kg|kgaa|ohg|ug|mbh|e\.?k\.?|e\.?v\.?|se|aktiengesellschaft|kommanditgesellschaft|lt[ée]e|limit[ée]e|enr|s\.?e\.?n\.?c\.?|n\.\s*v\.?|b\.\s*v\.?|s\.?a\.?r?\.?l?\.?|s\.?p\.?a\.?|s\.?r\.?l\.?)\b\.?", re.IGNORECASE)
LEADING_ARTICLE = re.compile(r"^(?:[LlDd]['’]\s*|[Ll][eao]s?\s+|[Dd][eiu]s?\s+|[Uu]n[ea]?\s+|[Ee]l\s+|[Ll]os\s+|[Ll]as\s+|[Ii]l\s+|[Gg]li\s+|[Uu]n[oa]?\s+|[Dd](?:er|ie|as|en|em|es)\s+|[Ee]in[e]?\s+|[Hh]et\s+|[Dd]e\s+|[Ee]en\s+|[Oo]s?\s+|[Aa]s?\s+)")
BEFORE_INITIALS = frozenset("le la les de du des au aux un une el los las il lo gli het der die das den dem ein eine o a os as".split())
BEFORE_FORM = frozenset("der die das den dem des ein eine le la les l' un une el los las una il lo gli de het een o a os as um uma the an".split())
BARE_FORMS = frozenset("ag gmbh kg kgaa ohg ug mbh se sa sarl sas srl spa snc inc corp llc ltd llp plc co lp bv nv".split())
FIRM_WORDS = frozenset("société societe sociedad empresa compañía compania società societa azienda impresa gesellschaft unternehmen firma vennootschap bedrijf onderneming sociedade companhia".split())
VERBS_AFTER_FIRM = frozenset("""
et ou qui que est a sont ont peut doit détermine determine présente presente utilise applique établit etablit calcule comptabilise
reconnaît reconnait constate enregistre amortit provisionne rembourse détient detient possède possede gère gere exploite opère opere
emploie embauche vend achète achete loue fabrique produit offre fournit distribue exporte importe
is are has have can must should will determines presents uses applies calculates holds owns manages operates employs sells buys rents produces offers provides
ist hat sind haben kann muss soll bestimmt verwendet berechnet hält haelt besitzt verwaltet betreibt beschäftigt beschaeftigt verkauft kauft mietet produziert bietet liefert
es ha son han puede debe determina presenta utiliza aplica calcula posee gestiona opera emplea vende compra alquila fabrica produce ofrece
è sono hanno può puo deve utilizza applica calcola detiene possiede gestisce impiega affitta fabbrica offre
heeft zijn hebben kan moet bepaalt presenteert gebruikt berekent bezit beheert exploiteert verkoopt koopt huurt produceert biedt levert
é tem são sao têm pode deve apresenta detém detem possui emprega aluga produz oferece
""".split())
SECOND_VERBS = frozenset("est a sont ont peut doit is are has have can must ist hat sind haben kann muss es ha son han puede debe è sono hanno heeft zijn hebben é tem são sao".split())
PURPOSE = frozenset("pour para für fuer per voor".split())
CATEGORY = frozenset("catégorie categorie category kategorie categoría categoria".split())
#: A final letter and what it may stand for where accents were lost.
LOST_ACCENTS = {"e": "éèêë", "a": "àâáãä", "o": "ôóõö", "i": "îí", "u": "ûùúü", "c": "ç", "n": "ñ"}
_EDGES = ".,;:!?()[]{}\"'‘’“”"
_HYPHENS = re.compile("[-–—]")
_APOSTROPHES = re.compile("['’]")


def has_form(text: str) -> bool:
    return LEGAL_FORM.search(text.strip()) is not None


def _forms_of(word: str, lexicon: Lexicon) -> list[str]:
    """A word, and how it may have stood before text was damaged or inflected."""
    out = [word, mojibake_py(word).lower(), repair_pdf_py(word).lower(), remove_accents_py(word), word.replace("ss", "ß", 1)]
    out += [word[:-1] + c for c in LOST_ACCENTS.get(word[-1], "")]
    for stem in lexicon.stems(word) if lexicon.stems else ():
        out += [stem, remove_accents_py(stem)]
    return out


def known_word(word: str, lexicon: Lexicon) -> bool:
    """Whether a word without its edge punctuation is vocabulary, in any of its forms or as a compound; bare punctuation is."""
    w = word.strip(_EDGES)
    return not w or any(f in lexicon.common for f in _forms_of(w, lexicon)) or lexicon.compound(w)


def known(word: str, lexicon: Lexicon) -> bool:
    """known_word, or parts around apostrophes or hyphens that are."""
    w = word.lower()
    if known_word(w, lexicon):
        return True
    parts = _APOSTROPHES.split(w)
    if len(parts) > 1:
        long = [p for p in parts if len(p) > 2]
        if (long and all(known_word(p, lexicon) for p in long)) or (len(parts) == 2 and len(parts[0]) <= 5 and known_word(parts[1], lexicon)):
            return True
    parts = [p for p in _HYPHENS.split(w) if p]
    return len(parts) > 1 and all(known_word(p, lexicon) for p in parts)


@dataclass(frozen=True)
class Firm:
    """A candidate, and what the rules ask of it."""

    text: str
    lexicon: Lexicon

    @cached_property
    def words(self) -> list[str]:
        return self.text.split()

    @cached_property
    def low(self) -> list[str]:
        return [w.lower() for w in self.words]

    @cached_property
    def n(self) -> int:
        return len(self.words)

    @cached_property
    def legal(self) -> bool:
        return has_form(self.text)

    @cached_property
    def known(self) -> list[bool]:
        return [known(w, self.lexicon) for w in self.words]

    def plain(self, marks: str = "-–—/.") -> bool:
        """All words are vocabulary, numbers or marks."""
        return all(k or w.isdigit() or set(w) <= set(marks) for k, w in zip(self.known, self.words, strict=True))

    def without_codes(self) -> list[str]:
        """The words of more than one character, without codes in brackets, numbers and single letters."""
        t = re.sub(r"\([A-Z0-9]{2,10}\)", "", self.text)
        t = re.sub(r"\b[a-zA-Z]['’]?\s", " ", re.sub(r"\b\d+\b", "", t))
        return [w for w in t.split() if len(w) > 1]


def _vocabulary(f: Firm) -> bool:
    rest = LEADING_ARTICLE.sub("", f.text)
    return any(t and t.lower() in f.lexicon.common for t in (f.text, mojibake_py(f.text), rest, mojibake_py(rest)))


def _without_codes(f: Firm) -> bool:
    rest = f.without_codes()
    return f.n >= 3 and not f.legal and len(rest) >= 2 and all(known(w, f.lexicon) or set(w) <= set("-–—/.,") for w in rest)


def _heading(f: Firm) -> bool:
    capitals = "".join(f.words).isupper()
    return f.n >= 3 and capitals and not has_form(f.words[-1]) and sum(k or w.isdigit() for k, w in zip(f.known, f.words, strict=True)) >= 0.75 * f.n


class Rule(NamedTuple):
    name: str
    example: str
    test: Callable[[Firm], bool]


RULES = [
    Rule("a sentence", "one two three four five six seven eight nine ten eleven twelve Ltd", lambda f: f.n > 12),
    Rule("too short", "A", lambda f: len(f.text) <= 2),
    Rule("an abbreviation", "TOTAL", lambda f: f.text.isupper() and (len(f.text) <= 5 or f.n == 1)),
    Rule("one short word", "Foo", lambda f: f.n == 1 and len(f.text) <= 3),
    Rule("a number first", "3 Rivers", lambda f: f.text[0].isdigit() and not f.legal),
    Rule("small letters", "some thing", lambda f: f.n <= 2 and f.text == f.text.lower()),
    Rule("vocabulary, perhaps after an article", "Het Department", _vocabulary),
    Rule("one word of the vocabulary", "Departments", lambda f: f.n == 1 and not f.legal and f.known[0]),
    Rule("a word and a number", "Annex 2", lambda f: f.n == 2 and not f.legal and any(f.words[k].isdigit() and f.known[1 - k] for k in (0, 1))),
    Rule("a numbered portion", "Portion 12", lambda f: f.n == 2 and f.low[0] == "portion" and f.words[1].isdigit()),
    Rule("words of the vocabulary only", "Annex / Department", lambda f: f.n >= 2 and not f.legal and f.plain()),
    Rule("a heading in capitals", "ANNEX DEPARTMENT OF XYZZY ANNEX", _heading),
    Rule("vocabulary around codes", "Annex (NCSC) Department", _without_codes),
    Rule("an article and initials", "La BNP", lambda f: f.n == 2 and f.low[0] in BEFORE_INITIALS and f.words[1].isupper() and len(f.words[1]) >= 2),
    Rule("a firm that does something", "Société détient Alpha", lambda f: f.n >= 2 and f.low[0] in FIRM_WORDS and f.low[1] in VERBS_AFTER_FIRM),
    Rule("a verb in the second place", "Alpha est Beta", lambda f: f.n >= 3 and f.low[1] in SECOND_VERBS),
    Rule("for a purpose", "Fonds pour Alpha", lambda f: not PURPOSE.isdisjoint(f.low) and not has_form(f.words[-1])),
    Rule("a category", "Alpha Category Beta", lambda f: f.n >= 3 and not CATEGORY.isdisjoint(f.low)),
    Rule("an article and a bare legal form", "Vorstand der AG", lambda f: f.n >= 3 and f.low[-2] in BEFORE_FORM and f.low[-1].rstrip(".") in BARE_FORMS),
]


def firm_noise(text: str, lexicon: Lexicon = Lexicon()) -> str | None:  # noqa: B008
    """The name of the first rule that tells that a text is no firm, or None. Empty texts are too short."""
    f = Firm(text.strip(), lexicon)
    return next((r.name for r in RULES if r.test(f)), None) if f.text else "too short"
