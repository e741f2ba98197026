"""Language of a text by stopword votes.

Each language has its commonest function words; every occurrence in the prose of a text
is a vote.  Chinese votes by its characters.  Code, identifiers and quoted names do not
vote.
"""

from __future__ import annotations

import re

LANGUAGES = ("none", "en", "zh", "de", "es")

#: Function words that are telling among these languages.
STOPWORDS = {
    "en": "the of and to is was has have that this which with for from are were been not but it its as at by an or be than when while does did will would should could what why how who there their they we our you your if into after before because so no only may more needs about first last without",
    "de": "der die das und ist nicht ein eine einer eines dem den des zu von mit auf für aus bei nach über unter wird wurde sich auch noch nur aber weil wenn dass denn oder wie was wer warum im am zum zur sind war hat haben kann muss soll sollten bitte liegt liest hinter deshalb jetzt mehr",
    "es": "el la los las un una unos unas y en que es por para con se del al lo su sus como más pero sin sobre también este esta ese esa desde hasta cuando porque qué cómo cuál según todavía ya entonces fue está son no falta hay muy",
}
_VOTE: dict[str, str] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words.split():
        _VOTE[_w] = "" if _w in _VOTE else _lang  # a word of two languages votes for none
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]+")
_HAN = re.compile(r"[㐀-䶿一-鿿]")
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\"[A-Za-z_]+\"\s*:|[A-Za-z]+_\w+|[a-z]+[A-Z]\w*", re.S)


def prose(text: str) -> str:
    """The text without code fences, quoted names, JSON keys and identifiers."""
    return _CODE.sub(" ", text)


def votes(text: str) -> dict[str, int]:
    """Votes of each language; one Chinese character counts as half a word."""
    out = dict.fromkeys(LANGUAGES[1:], 0)
    for w in _LATIN.findall(text):
        lang = _VOTE.get(w.lower())
        if lang:
            out[lang] += 1
    out["zh"] = len(_HAN.findall(text)) // 2
    return out


def language(text: str, least: int = 2) -> str:
    """The language with most votes, ``none`` when it has fewer than ``least``."""
    v = votes(text)
    best = max(v, key=lambda k: (v[k], k))
    return best if v[best] >= least else "none"
