"""Porter stems of English words (published algorithm, 1980)."""

from __future__ import annotations

import re

V = r"(?:[aeiou]|(?<=[^aeiou])y)"
STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _kinds(stem: str) -> str:
    out = ""
    for k, c in enumerate(stem):
        out += "v" if c in "aeiou" or c == "y" and k and out[-1] == "c" else "c"
    return out


def measure(stem: str) -> int:
    """Number of vowel-consonant turns."""
    return len(re.findall("v+c", re.sub(r"c+", "c", _kinds(stem))))


def _vowel(stem: str) -> bool:
    return "v" in _kinds(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short(stem: str) -> bool:
    return _kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                base = w[: -len(end)]
                if _vowel(base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif measure(w) == 1 and _short(w):
                        w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end, new in sorted((x.split(" ") for x in table.split(",")), key=lambda e: -len(e[0])):
            if w.endswith(end):
                w = w[: -len(end)] + new if measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(STEP4.split(), key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if measure(base) > 1 or measure(base) == 1 and not _short(base):
            w = base
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w
