"""Snowball stemmers for English (Porter2) and Russian, from the published algorithms."""

from __future__ import annotations

import re

# --- English -------------------------------------------------------------------------------------------------------

_VOWELS = "aeiouy"
#: Words with stems of their own.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words that step 1a leaves final.
_FINAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    m = re.compile(r"[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS and word[-1] not in "wxY"


def stem_english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = word.lstrip("'") if word.startswith("'") else word
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    m = re.match(r"gener|commun|arsen", word)
    r1 = m.end() if m else _region(word, 0)
    r2 = _region(word, r1)
    # 0: possessives
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    # 1a: plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in _FINAL:
        return word.lower()
    # 1b: past tense and participles
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(end):
            if end in ("eed", "eedly"):
                if len(word) - len(end) >= r1:
                    word = word[: -len(end)] + "ee"
            elif re.search("[aeiouy]", word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(_DOUBLES):
                    word = word[:-1]
                elif r1 >= len(word) and _short_end(word):
                    word += "e"
            break
    # 1c: final y
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    # 2 and 3: double suffixes
    for end, new in _STEP2:
        if word.endswith(end):
            if len(word) - len(end) >= r1 and (end != "ogi" or word[-4:-3] == "l") and (end != "li" or word[-3:-2] in tuple("cdeghkmnrt")):
                word = word[: -len(end)] + new
            break
    for end, new in _STEP3:
        if word.endswith(end):
            if len(word) - len(end) >= (r2 if end == "ative" else r1):
                word = word[: -len(end)] + new
            break
    # 4: single suffixes
    for end in _STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
                word = word[: -len(end)]
            break
    # 5: final e and l
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_end(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


# --- Russian -------------------------------------------------------------------------------------------------------

_RU_VOWELS = "аеиоуыэюя"


def _longest(word: str, start: int, endings: tuple[str, ...]) -> str | None:
    found = [e for e in endings if word.endswith(e) and len(word) - len(e) >= start]
    return max(found, key=len) if found else None


def _after_a(word: str, start: int, guarded: tuple[str, ...], free: tuple[str, ...]) -> str | None:
    """The longest ending; guarded ones must follow a or ya within the region."""
    found = [e for e in free if word.endswith(e) and len(word) - len(e) >= start]
    found += [e for e in guarded if word.endswith(e) and len(word) - len(e) - 1 >= start and word[-len(e) - 1] in "ая"]
    return max(found, key=len) if found else None


#: Endings of the Russian algorithm.
_GERUND = (("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"))
_ADJECTIVE = tuple("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split())
_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
_REFLEXIVE = ("ся", "сь")
_VERB = (
    tuple("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()),
    tuple("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()),
)
_NOUN = tuple("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split())
_SUPERLATIVE = ("ейш", "ейше")
_DERIVATIONAL = ("ост", "ость")


def stem_russian(word: str) -> str:
    word = word.replace("ё", "е")
    m = re.search(f"[{_RU_VOWELS}]", word)
    if not m:
        return word
    rv = m.end()
    first = re.compile(f"[{_RU_VOWELS}][^{_RU_VOWELS}]").search(word)
    r1 = first.end() if first else len(word)
    second = re.compile(f"[{_RU_VOWELS}][^{_RU_VOWELS}]").search(word, r1)
    r2 = second.end() if second else len(word)
    cut = lambda w, e: w[: len(w) - len(e)]
    if end := _after_a(word, rv, *_GERUND):
        word = cut(word, end)
    else:
        if end := _longest(word, rv, _REFLEXIVE):
            word = cut(word, end)
        if end := _longest(word, rv, _ADJECTIVE):
            word = cut(word, end)
            if end := _after_a(word, rv, *_PARTICIPLE):
                word = cut(word, end)
        elif end := _after_a(word, rv, *_VERB):
            word = cut(word, end)
        elif end := _longest(word, rv, _NOUN):
            word = cut(word, end)
    if end := _longest(word, rv, ("и",)):
        word = cut(word, end)
    if end := _longest(word, r2, _DERIVATIONAL):
        word = cut(word, end)
    if end := _longest(word, rv, _SUPERLATIVE):
        word = cut(word, end)
        if word.endswith("нн") and len(word) - 2 >= rv:
            word = word[:-1]
    elif word.endswith("нн") and len(word) - 2 >= rv:
        word = word[:-1]
    elif word.endswith("ь") and len(word) - 1 >= rv:
        word = word[:-1]
    return word
