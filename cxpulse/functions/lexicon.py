"""Word lists and default parameters.

FIXED VALUES: the three French word lists, the cleaning alphabet and the
negativity threshold below must stay exactly as written for results to match
the behaviour this engine reproduces.  They are plain data, listed in their
natural order.  Every operator takes them as parameters, so callers can pass
their own lexicon (see ``Lexicon``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — negative unigram lexicon (French)
# ---------------------------------------------------------------------------
NEGATIVE_WORDS: tuple[str, ...] = (
    "scandaleux", "honteux", "inadmissible", "inacceptable", "honte",
    "nul", "nulle", "catastrophe", "catastrophique", "horrible",
    "lamentable", "déplorable", "minable", "pitoyable",
    "panne", "bug", "bugge", "plante", "planté",
    "bloqué", "bloquée", "erreur", "impossible",
    "hs", "coupure", "coupé",
    "mécontent", "mécontente", "déçu", "déçue", "insatisfait",
    "insatisfaite", "plainte", "réclamation", "arnaque", "voleur",
    "voleurs", "menteur", "menteurs", "incompétent", "incompétente",
    "incompétents",
    "attente", "attend", "attends", "relance", "relancé",
    "résilier", "résiliation", "résilié", "partir", "quitter",
    "concurrence", "concurrent",
    "surfacturation", "remboursement", "rembourser",
)

# FIXED VALUES — negative bigrams (matched as substrings, no word boundary)
NEGATIVE_BIGRAMS: tuple[str, ...] = (
    "marche pas", "fonctionne pas", "personne répond", "trop cher",
    "hors service", "pure simple", "porter plainte", "trois semaines",
)

# FIXED VALUES — French stop words
STOPWORDS_FR: tuple[str, ...] = (
    "je", "tu", "il", "elle", "on", "nous", "vous", "ils", "elles",
    "le", "la", "les", "un", "une", "des", "de", "du", "au", "aux",
    "ce", "cette", "ces", "mon", "ma", "mes", "ton", "ta", "tes",
    "son", "sa", "ses", "notre", "votre", "leur", "leurs",
    "et", "ou", "mais", "donc", "car", "ni", "que", "qui", "dont",
    "où", "en", "dans", "sur", "sous", "avec", "sans", "pour", "par",
    "ne", "pas", "plus", "très", "bien", "aussi", "comme", "tout",
    "être", "avoir", "faire", "est", "sont", "suis", "ai", "a",
    "oui", "non", "merci", "bonjour", "bonsoir", "svp", "ok",
    "alors", "ça", "cela", "là", "ici", "voilà", "si", "se",
    "me", "te", "lui", "y", "à", "même", "quand", "peu", "peut",
    "encore", "après", "avant", "déjà", "tous", "toute", "toutes",
    "été", "fait", "dit", "mis", "pris", "rien", "quelque",
)

# FIXED VALUES — letters kept by the cleaner besides whitespace, ' and -
CLEAN_LETTERS: str = "a-zàâäéèêëïîôùûüÿçœæ"

# FIXED VALUES — a conversation is negative when its score is strictly above this
NEGATIVE_THRESHOLD: float = 0.15

# An English insult lexicon used to exercise custom lexicons on `documents`.
INSULT_WORDS: tuple[str, ...] = (
    "trash", "worthless", "idiot", "scum", "moron", "pathetic", "stupid", "loser",
)


def _dedup(words) -> tuple[str, ...]:
    seen: dict[str, None] = {}
    for w in words:
        seen.setdefault(w, None)
    return tuple(seen)


@dataclass(frozen=True)
class Lexicon:
    """A scoring lexicon: unigrams (word-bounded), bigrams (substring) and threshold."""

    words: tuple[str, ...] = field(default_factory=lambda: _dedup(NEGATIVE_WORDS))
    bigrams: tuple[str, ...] = field(default_factory=lambda: _dedup(NEGATIVE_BIGRAMS))
    threshold: float = NEGATIVE_THRESHOLD

    def __post_init__(self):
        object.__setattr__(self, "words", _dedup(self.words))
        object.__setattr__(self, "bigrams", _dedup(b for b in self.bigrams if b))


DEFAULT_LEXICON = Lexicon()
DEFAULT_STOPWORDS: tuple[str, ...] = _dedup(STOPWORDS_FR)
