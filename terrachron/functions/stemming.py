"""Stems of English words by the published Snowball rules (Porter's second stemmer).

A word has two regions: the first begins after the first consonant that follows a vowel, the second is the same
within the first. Steps take endings off in a fixed order; a step looks at the longest of its endings alone, and does
something only where the ending's condition holds. ``y`` that is a consonant is written ``Y`` meanwhile.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

# Fixed values of the rules: words with stems of their own, beginnings that end the first region, endings with what takes their place.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
BEGINNINGS = ("arsen", "commun", "emerg", "gener", "inter", "later", "organ", "past", "univers")
KEPT_ING = ("inn", "out", "cann", "herr", "earr", "even")
KEPT_EED = ("proc", "exc", "succ")
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogist": "og", "ogi": "og", "li": "",
}
SHORTENED = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
DROPPED = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy]|past)$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


@dataclass
class Word:
    text: str
    first: int
    second: int

    def ending(self, endings) -> str | None:
        """The longest of ``endings`` that the word has."""
        return max((e for e in endings if self.text.endswith(e)), key=len, default=None)

    def within(self, ending: str, region: int) -> bool:
        return len(self.text) - len(ending) >= region

    def swap(self, ending: str, other: str = "") -> None:
        self.text = self.text[: len(self.text) - len(ending)] + other


def regions(text: str) -> tuple[int, int]:
    """Where the two regions begin; at the end of the word where there is none."""
    begun = next((len(b) for b in BEGINNINGS if text.startswith(b)), None)

    def after(at: int) -> int:
        found = _REGION.search(text, at)
        return found.end() if found else len(text)

    first = after(0) if begun is None else begun
    return first, after(first)


def plural(w: Word) -> None:
    if mark := w.ending(("'", "'s", "'s'")):
        w.swap(mark)
    found = w.ending(("sses", "ied", "ies", "us", "ss", "s"))
    if found == "sses":
        w.swap("es")
    elif found in ("ied", "ies"):
        w.swap(found, "i" if len(w.text) > 4 else "ie")
    elif found == "s" and _VOWEL.search(w.text[:-2]):
        w.swap("s")


def past_or_going(w: Word) -> None:
    found = w.ending(("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if found is None:
        return
    rest = w.text[: -len(found)]
    if found.startswith("eed"):
        if w.within(found, w.first) and rest not in KEPT_EED:
            w.text = rest + "ee"
        return
    if found == "ing":
        if re.fullmatch("[^aeiouy]y", rest):
            w.text = rest[0] + "ie"
            return
        if rest in KEPT_ING:
            return
    if not _VOWEL.search(rest):
        return
    w.text = rest
    if rest.endswith(("at", "bl", "iz")):
        w.text = rest + "e"
    elif _DOUBLE.search(rest):
        w.text = rest if len(rest) == 3 and rest[0] in "aeo" else rest[:-1]
    elif len(rest) == w.first and _SHORT.search(rest):
        w.text = rest + "e"


def last_y(w: Word) -> None:
    if len(w.text) > 2 and w.text[-1] in "yY" and not _VOWEL.match(w.text[-2]):
        w.text = w.text[:-1] + "i"


def derived(w: Word) -> None:
    found = w.ending(DERIVED)
    if found is None or not w.within(found, w.first):
        return
    before = w.text[: -len(found)]
    if found == "ogi" and not before.endswith("l") or found == "li" and not before.endswith(tuple("cdeghkmnrt")):
        return
    w.swap(found, DERIVED[found])


def shortened(w: Word) -> None:
    found = w.ending(SHORTENED)
    if found and w.within(found, w.second if found == "ative" else w.first):
        w.swap(found, SHORTENED[found])


def dropped(w: Word) -> None:
    found = w.ending(DROPPED)
    if found and w.within(found, w.second) and (found != "ion" or w.text.endswith(("sion", "tion"))):
        w.swap(found)


def last_letter(w: Word) -> None:
    if w.text.endswith("e"):
        if w.within("e", w.second) or (w.within("e", w.first) and not _SHORT.search(w.text[:-1])):
            w.swap("e")
    elif w.text.endswith("ll") and w.within("l", w.second):
        w.swap("l")


STEPS: tuple[Callable[[Word], None], ...] = (plural, past_or_going, last_y, derived, shortened, dropped, last_letter)


@lru_cache(maxsize=50_000)
def stem_word(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if word in WHOLE_WORDS or len(word) < 3:
        return WHOLE_WORDS.get(word, word)
    text = word.removeprefix("'")
    letters = []
    for c in text:  # a consonant y: at the start, or after a vowel that is not such a one
        letters.append("Y" if c == "y" and (not letters or letters[-1] in "aeiouy") else c)
    text = "".join(letters)
    w = Word(text, *regions(text))
    for step in STEPS:
        step(w)
    return w.text.replace("Y", "y")
