"""The Porter stemmer (Porter 1980), applied to distinct terms."""

from __future__ import annotations

import re
from functools import lru_cache

from tesserae.functions.text import fold_text


def _shape(stem: str) -> str:
    out = []
    for i, c in enumerate(stem):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _short(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


#: The suffix rules of the published algorithm.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def stem(word: str) -> str:
    w = word
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "v" in _shape(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        pairs = sorted((r.split(":") for r in rules.split()), key=lambda r: -len(r[0]))
        for suffix, to in pairs:
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + to
                break
    for suffix in sorted(_STEP4.split(), key=len, reverse=True):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@lru_cache(1 << 17)
def stem_folded(word: str) -> str:
    """The stem of a word without its diacritics: the key of an index."""
    return stem(fold_text(word))


def stem_sql(source: str, column: str) -> str:
    """The same rules as SQL, for engines without a stemmer: ``source`` with ``stem`` added. A ``y``
    that is a consonant is written ``Y`` meanwhile, so that shapes are plain patterns."""
    c, v = "[^aeiouy]", "[aeiouy]"
    some = lambda w, n: f"regexp_matches({w}, '^{c}*({v}+{c}+){{{n},}}')"
    vowel = lambda w: f"regexp_matches({w}, '{v}')"
    short = lambda w: f"regexp_matches({w}, '{c}{v}[^aeiouywxY]$')"
    cut = lambda n: f"left(w, length(w) - {n})"
    ends = lambda *x: f"regexp_matches(w, '({'|'.join(x)})$')"
    case = lambda *rules: "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in rules) + " ELSE w END"

    def suffixes(rules: str) -> str:
        pairs = sorted((r.split(":") for r in rules.split()), key=lambda r: -len(r[0]))
        return case(*((ends(a), f"CASE WHEN {some(cut(len(a)), 1)} THEN {cut(len(a))} || '{b}' ELSE w END") for a, b in pairs))

    def last(suffix: str) -> tuple[str, str]:
        rest = cut(len(suffix))
        more = f" AND regexp_matches({rest}, '[st]$')" if suffix == "ion" else ""
        return ends(suffix), f"CASE WHEN {some(rest, 2)}{more} THEN {rest} ELSE w END"

    repaired = case((ends("at", "bl", "iz"), "w || 'e'"), (f"right(w, 1) = substr(w, -2, 1) AND regexp_matches(w, '[^aeiouylsz]$')", cut(1)), (f"{some('w', 1)} AND NOT {some('w', 2)} AND {short('w')}", "w || 'e'"))
    fell = f"(NOT {ends('eed')} AND (({ends('ed')} AND {vowel(cut(2))}) OR ({ends('ing')} AND {vowel(cut(3))})))"
    steps = [
        "regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g')",
        case((ends("sses", "ies"), cut(2)), (ends("ss"), "w"), (ends("s"), cut(1))),
        f"CASE WHEN {ends('eed')} THEN CASE WHEN {some(cut(3), 1)} THEN {cut(1)} ELSE w END WHEN {fell} THEN {cut(3)} || CASE WHEN {ends('ed')} THEN substr(w, -3, 1) ELSE '' END || '+' ELSE w END",
        f"CASE WHEN right(w, 1) = '+' THEN (SELECT {repaired} FROM (SELECT left(x.w, length(x.w) - 1) AS w)) ELSE w END",
        case((f"regexp_matches(w, '[yY]$') AND {vowel(cut(1))}", f"{cut(1)} || 'i'")),
        suffixes(_STEP2),
        suffixes(_STEP3),
        case(*map(last, sorted(_STEP4.split(), key=len, reverse=True))),
        case((f"{ends('e')} AND ({some(cut(1), 2)} OR ({some(cut(1), 1)} AND NOT {short(cut(1))}))", cut(1))),
        case((f"{ends('ll')} AND {some('w', 2)}", cut(1))),
    ]
    out = f"SELECT {column} AS token, {column} AS w FROM ({source})"
    for step in steps:
        out = f"SELECT token, CASE WHEN regexp_matches(token, '^[a-z]{{3,}}$') THEN {step} ELSE w END AS w FROM ({out}) x"
    return f"SELECT token, lower(w) AS stem FROM ({out})"
