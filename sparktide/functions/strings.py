"""Word distances and stemming: plain Python for the few words of topics, Arrow-batched for columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F


def indel_ratio(a: str, b: str) -> float:
    """(|a| + |b| - insertions and deletions between them) / (|a| + |b|); 1 for two empty strings."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return 2.0 * row[-1] / (len(a) + len(b))


def weighted_distance(a: str, b: str, insert: int = 2, delete: int = 2, substitute: int = 1) -> int:
    """Edit distance with these costs."""
    row = [j * insert for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        last, row[0] = row[0], (i + 1) * delete
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (0 if x == y else substitute), row[j + 1] + delete, row[j] + insert)
    return row[-1]


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity raised by up to 4 characters of common prefix (where it exceeds 0.7)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    right = [y for y, t in zip(b, taken, strict=True) if t]
    if not left:
        return 0.0
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPT = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEEP = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_KEEP_LATER = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_syllable(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-3] not in _VOWELS and w[-2] in _VOWELS and w[-1] not in _VOWELS + "wxY"


def stem(word: str) -> str:
    """Porter2 (Snowball English) stem of a lower-case word."""
    w = word
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    if w in _EXCEPT:
        return _EXCEPT[w]
    if w in _KEEP:
        return w
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEEP_LATER:
        return w
    if w.endswith(("eedly", "eed")):
        s = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if any(c in _VOWELS for c in w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_syllable(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for s, r in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and not (s == "ogi" and not w.endswith("logi")) and not (s == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
                w = w[: -len(s)] + r
            break
    for s, r in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + r
            break
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and not (s == "ion" and w[-4:-3] not in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_IRREGULAR = {"men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose", "people": "people", "data": "data", "series": "series", "species": "species"}
_NOUN_ENDINGS = (("sses", "ss"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("ies", "y"), ("ves", "f"))


def lemma(word: str) -> str:
    """Noun lemma by rules of detachment; there is no word list to confirm it against."""
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    for s, r in _NOUN_ENDINGS:
        if word.endswith(s) and len(word) > len(s) + 1:
            return word[: -len(s)] + r
    if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")):
        return word[:-1]
    return word


def _each(fn):
    def run(lists: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}
        return lists.map(lambda ws: None if ws is None else [seen[w] if w in seen else seen.setdefault(w, fn(w)) for w in ws])

    return run


def stem_words(tokens):
    """Column of word lists with each word stemmed; one Arrow batch at a time, each distinct word once."""
    return F.pandas_udf(_each(stem), "array<string>")(tokens)


def lemmatize_words(tokens):
    """Column of word lists with each word's noun lemma."""
    return F.pandas_udf(_each(lemma), "array<string>")(tokens)
