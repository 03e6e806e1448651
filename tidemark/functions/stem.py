"""The published Porter2 (Snowball English) stemming algorithm, for use over distinct terms."""

from __future__ import annotations

import re

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = set("cdeghkmnrt")
# Exceptions of the published algorithm.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Endings of steps 2, 3 and 4.
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("ization", "ize"),
    ("izer", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"),
    ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("fulli", "ful"),
    ("lessli", "less"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]


def _regions(word: str) -> tuple[int, int]:
    for start in ("gener", "commun", "arsen"):
        if word.startswith(start):
            r1 = len(start)
            break
    else:
        found = re.search(r"[aeiouy][^aeiouy]", word)
        r1 = found.end() if found else len(word)
    found = re.search(r"[aeiouy][^aeiouy]", word[r1:])
    return r1, r1 + found.end() if found else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word)) or bool(re.fullmatch(r"[aeiouy][^aeiouy]", word))


def _longest(word: str, endings) -> tuple | None:
    for ending in sorted(endings, key=lambda e: -len(e[0])):
        if word.endswith(ending[0]):
            return ending
    return None


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    word = word.lstrip("'")
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = re.sub(r"^y", "Y", word)
    word = re.sub(r"([aeiouy])y", r"\1Y", word)
    r1, r2 = _regions(word)
    for ending in ("'s'", "'s", "'"):
        if word.endswith(ending):
            word = word[: -len(ending)]
            break
    # Step 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(r"[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in _KEPT:
        return word
    # Step 1b
    found = _longest(word, [("eedly",), ("eed",), ("ingly",), ("edly",), ("ing",), ("ed",)])
    if found:
        ending = found[0]
        body = word[: -len(ending)]
        if ending in ("eed", "eedly"):
            if len(body) >= r1:
                word = body + "ee"
        elif re.search(r"[aeiouy]", body):
            word = body
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLE):
                word = word[:-1]
            elif _short_end(word) and len(word) <= r1:
                word += "e"
    # Step 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _V:
        word = word[:-1] + "i"
    # Step 2
    found = _longest(word, _STEP2)
    if found and len(word) - len(found[0]) >= r1:
        body = word[: -len(found[0])]
        if found[0] == "ogi":
            word = body + "og" if body.endswith("l") else word
        elif found[0] == "li":
            word = body if body and body[-1] in _LI else word
        else:
            word = body + found[1]
    # Step 3
    found = _longest(word, _STEP3)
    if found and len(word) - len(found[0]) >= (r2 if found[0] == "ative" else r1):
        word = word[: -len(found[0])] + found[1]
    # Step 4
    found = _longest(word, [(e,) for e in _STEP4])
    if found and len(word) - len(found[0]) >= r2:
        body = word[: -len(found[0])]
        if found[0] != "ion" or body.endswith(("s", "t")):
            word = body
    # Step 5
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stem_legacy(word: str) -> str:
    """``text.legacy_stem`` for one word: the first of -ing, -ed, -ly, -s (not -ss) that leaves two bytes or more."""
    size = len(word.encode())
    for ending, longer_than in (("ing", 4), ("ed", 3), ("ly", 3), ("s", 2)):
        if word.endswith(ending) and size > longer_than and size - len(ending) >= 2 and not (ending == "s" and word.endswith("ss")):
            return word[: -len(ending)]
    return word
