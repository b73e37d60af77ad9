"""The language of short texts, by function words and letters (numpy-free, a few microseconds a text)."""

from __future__ import annotations

import re

#: Function words of each language; words that two languages share count for both.
WORDS = {
    "en": "the a an of to and is are was were in that for with not be by at on it its this from or as if how why what when which who does do can will into no has have all but only so than then they them each most until after before".split(),
    "de": "der die das und ist nicht ein eine einen einem zu den dem des mit von für auf im in sich auch es wird werden sind war wie warum wann welche nach bei aus keine kein nur wenn dass oder aber so als bis wo wer sowie danach über unter".split(),
    "fr": "le la les de des du et est un une que qui dans pour pas sur avec au aux ce cette ces sont par il elle comment pourquoi quand quel quelle si plus ne se son sa ses mais ou où avant après selon aussi cela tant dès je vous nous".split(),
    "es": "el la los las de del y es un una que en para no con por al se su sus lo como cuando qué cuál esto eso esta este son si más pero o donde antes después según también tras cada mientras porque le me".split(),
    "it": "il lo la i gli le di del della e è un una che per non con sono come perché quando quale questo questa nel nella dei più ma o dove prima dopo anche si da al".split(),
    "pt": "o a os as de do da dos das e é um uma que para não com por se como quando qual isso este esta na no são mais mas ou onde antes depois também ao pelo pela".split(),
    "nl": "de het een en van is niet dat in op met voor te zijn ook er aan bij wordt als hoe waarom wanneer welke naar uit geen om of maar dan nog".split(),
}
_LANGUAGES: dict[str, list[str]] = {}
for _k, _v in WORDS.items():
    for _w in dict.fromkeys(_v):
        _LANGUAGES.setdefault(_w, []).append(_k)
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = {"de": "äöüß", "fr": "éèêàùçœî", "es": "ñ¿¡áíóú", "pt": "ãõâ"}
#: Names of the languages, in the languages.
NAMES = {
    "en": ("english", "englisch", "anglais", "inglés", "inglese"),
    "de": ("german", "deutsch", "allemand", "alemán", "tedesco"),
    "fr": ("french", "französisch", "français", "francés", "francese"),
    "es": ("spanish", "spanisch", "espagnol", "español", "spagnolo"),
    "it": ("italian", "italienisch", "italien", "italiano"),
    "pt": ("portuguese", "portugiesisch", "portugais", "portugués", "português"),
    "nl": ("dutch", "niederländisch", "néerlandais", "neerlandés", "nederlands"),
}
_NAMED = {n: k for k, names in NAMES.items() for n in names}
_ANY_NAME = re.compile(rf"\b({'|'.join(sorted(_NAMED, key=len, reverse=True))})")
_SCRIPTS = (("ru", "Ѐ", "ӿ"), ("el", "Ͱ", "Ͽ"), ("zh", "一", "鿿"), ("ja", "぀", "ヿ"), ("ar", "؀", "ۿ"), ("ko", "가", "힯"))


def scores(text: str | None) -> dict[str, float]:
    """Evidence for each language: its function words and letters among the words of a text."""
    t = (text or "").lower()
    out = dict.fromkeys(WORDS, 0.0)
    for w in _WORD.findall(t):
        for k in _LANGUAGES.get(w, ()):
            out[k] += 1
    if not t.isascii():
        for k, letters in _LETTERS.items():
            out[k] += 0.5 * sum(c in letters for c in t)
        for k, lo, hi in _SCRIPTS:
            if n := sum(lo <= c <= hi for c in t):
                out[k] = float(n)
    return out


def language(text: str | None, margin: float = 1.0) -> str | None:
    """The language with the most evidence, or None where the lead over the next is under ``margin`` (short or blank texts)."""
    s = sorted(scores(text).items(), key=lambda x: -x[1])
    return s[0][0] if s[0][1] - s[1][1] >= margin and s[0][1] >= 2 else None


def asked_languages(question: str | None) -> set[str]:
    """Languages that a question names: it may want its answer in them."""
    return {_NAMED[m] for m in _ANY_NAME.findall((question or "").lower())}
