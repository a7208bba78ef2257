"""What is no place and no person: structural rules, with word sets as parameters (empty by default)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from inkveil.functions.text import strip_accents_py

# Articles in front of a noun, pronouns that start a clause.
ARTICLES = frozenset("le la les un une mon ma mes ton ta tes son sa ses ce cette el los las una mi tu su il lo gli mio mia der die das den dem des ein eine mein sein de het een mijn zijn o a os as um uma meu seu the my his her our this that".split())
PRONOUNS = frozenset("je tu il elle on nous vous ils elles ce c ça cela ceci yo él ella nosotros nosotras vosotros vosotras ellos ellas io lui lei noi voi loro esso essa ich er sie wir ihr ik hij zij wij jullie eu ele ela nós nos vós vos eles elas we they he she".split())
LINKING = ("", "es", "en", "er", "ns", "s", "n", "e")
_URL = re.compile(r"www\.|https?://|[a-z0-9]+\.[a-z]{2,}")
_MARKS = frozenset("-–—/.")


@dataclass(frozen=True)
class Lexicon:
    """Word sets of a deployment; stems: word -> its stems, if there are stemmers."""

    common: frozenset[str] = frozenset()
    german: frozenset[str] = frozenset()
    places: frozenset[str] = frozenset()
    persons: frozenset[str] = frozenset()
    short_names: frozenset[str] = frozenset()
    stems: Callable[[str], Iterable[str]] | None = None

    def knows(self, word: str) -> bool:
        """Whether a word is common vocabulary, with or without its accents; bare punctuation counts as such."""
        w = word.strip(".,;:!?()[]{}\"'‘’“”").lower()
        if not w:
            return True
        plain = strip_accents_py(w)
        return w in self.common or plain in self.common or self.compound(w) or ("-" in w.strip("-") and all(p in self.common for p in w.split("-") if p))

    def compound(self, word: str, parts: int = 3) -> bool:
        """Whether a word of eight letters or more is two or three German words of four or more, joined by a linking sound."""
        if len(word) < 8 or parts < 2 or not self.german:
            return False
        for i in range(4, len(word) - 3):
            if word[:i] in self.german:
                for link in LINKING:
                    rest = word[i + len(link) :]
                    if word[i:].startswith(link) and len(rest) >= 4 and (rest in self.german or self.compound(rest, parts - 1)):
                        return True
        return False


def _bare(word: str) -> bool:
    return bool(word) and _MARKS.issuperset(word)


def _never(clean: str) -> bool:
    """What neither a place nor a person looks like."""
    return len(clean) <= 2 or clean[0].isdigit() or clean.endswith(":") or bool(_URL.search(clean.lower()))


def place_noise(text: str, lexicon: Lexicon = Lexicon()) -> bool:  # noqa: B008
    clean = text.strip()
    low, words = clean.lower(), clean.split()
    if _never(clean) or low in lexicon.places or re.match(r"location\s+(?:de|d['’])", low):
        return True
    after = re.sub(r"^[ld]['’]\s*", "", low)
    if after != low and (after in lexicon.places or (" " not in after and lexicon.knows(after))):
        return True
    if len(words) > 1 and words[0].lower() in ARTICLES and (" ".join(words[1:]).lower() in lexicon.places or (len(words) == 2 and lexicon.knows(words[1]))):
        return True
    if len(words) == 1:
        return clean.isupper() or (clean == low and lexicon.knows(low)) or ("-" in clean and lexicon.knows(clean) and bool(lexicon.common))
    known = lambda w: w.lower() in lexicon.common or w.isdigit() or len(w) == 1 or _bare(w)
    if all(w.lower() in lexicon.places or w.isdigit() or _bare(w) for w in words) or (clean.isupper() and all(map(known, words))):
        return True
    content = [w for w in words if not _bare(w)]
    if len(content) < len(words) and content and all(map(known, content)):
        return True
    long = [w for w in words if len(w) > 2]
    if len(words) >= 3 and long and sum(w[0].islower() for w in long) >= len(long) * 0.5:
        return True
    return clean == low or words[0][0].islower()


def person_noise(text: str, lexicon: Lexicon = Lexicon()) -> bool:  # noqa: B008
    clean = text.strip()
    low, words = clean.lower(), clean.split()
    if _never(clean) or low in lexicon.persons or re.fullmatch(r"[A-ZÀ-Ü](?:\.[A-ZÀ-Ü])+\.?", clean):
        return True
    if len(clean) <= 4 and clean[0].isupper() and clean[-1] in "bcdfghjklmnpqrstvwxzç" and low not in lexicon.short_names:
        return True
    if len(words) == 1:
        shaped = len(clean) >= 5 and clean[0].isupper() and not clean.isupper()
        return len(clean) <= 3 or clean.isupper() or (not shaped and lexicon.knows(clean)) or lexicon.compound(low)
    first = words[0].lower().rstrip("'’")
    if first in PRONOUNS or all(w.lower() in lexicon.persons or w.isdigit() or _bare(w) for w in words):
        return True
    if first in ARTICLES and (" ".join(words[1:]).lower() in lexicon.persons or (len(words) == 2 and lexicon.knows(words[1]))):
        return True
    return clean == low or words[0][0].islower()
