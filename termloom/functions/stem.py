"""Stemmers by their published rules, applied in Arrow batches; feed them distinct terms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Porter (1980). A word's measure is the number of its vowel-consonant sequences.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0 = re.compile(f"^({_C})?{_V}{_C}")
_M1 = re.compile(f"^({_C})?{_V}{_C}({_V})?$")
_MORE = re.compile(f"^({_C})?{_V}{_C}{_V}{_C}")
_VOWEL = re.compile(f"^({_C})?{_V}")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split(), key=len, reverse=True)


def _longest(word: str, rules: dict[str, str]) -> str:
    for n in range(7, 2, -1):
        end = rules.get(word[-n:]) if len(word) > n else None
        if end is not None:
            stem = word[:-n]
            return stem + end if _M0.match(stem) else word
    return word


@cache
def porter_stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    first = w[0]
    if first == "y":  # a consonant here
        w = "Y" + w[1:]
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _M0.match(w[:-3]):
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _VOWEL.match(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _CVC.match(w):
                    w += "e"
                break
            if w.endswith(end):
                break
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(w, _STEP2)
    w = _longest(w, _STEP3)
    if w.endswith("ion"):
        stem = w[:-3]
        if stem.endswith(("s", "t")) and _MORE.match(stem):
            w = stem
    else:
        for end in _STEP4:
            if w.endswith(end):
                if _MORE.match(w[: -len(end)]):
                    w = w[: -len(end)]
                break
    if w.endswith("e"):
        stem = w[:-1]
        if _MORE.match(stem) or (_M1.match(stem) and not _CVC.match(stem)):
            w = stem
    if w.endswith("ll") and _MORE.match(w):
        w = w[:-1]
    return first + w[1:] if first == "y" else w


# Paice and Husk (1990): reversed ending, * if only an intact word, letters to remove, what is added, > to go on or . to stop.
_RULES = """
ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct. hsi3> i*1. i1y>
ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1.
mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2>
ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1.
vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s.
"""
_PAICE: dict[str, list[tuple[str, bool, int, str, bool]]] = {}
for _rule in _RULES.split():
    _m = re.fullmatch(r"([a-z]+)(\*?)(\d)([a-z]*)([>.])", _rule)
    _PAICE.setdefault(_m[1][0], []).append((_m[1][::-1], bool(_m[2]), int(_m[3]), _m[4], _m[5] == ">"))


def _acceptable(stem: str) -> bool:
    if not stem:
        return False
    if stem[0] in "aeiou":
        return len(stem) >= 2
    return len(stem) >= 3 and any(c in "aeiouy" for c in stem)


@cache
def lancaster_stem(word: str) -> str:
    intact, going = True, True
    while going:
        going = False
        for end, only_intact, cut, add, more in _PAICE.get(word[-1:], ()):
            if not word.endswith(end) or (only_intact and not intact):
                continue
            new = word[: len(word) - cut] if cut else word
            if _acceptable(new):
                word, going, intact = new + add, more, intact and not cut and not add
                break
    return word


# Snowball for Spanish.
_ES_V = "aeiouáéíóúü"
_PRONOUNS = sorted("me se sela selo selas selos la le lo las les los nos".split(), key=len, reverse=True)
_GERUNDS = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
_S1 = [
    ("", "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"),
    ("ic", "adora ador ación adoras adores aciones ante antes ancia ancias acion"),
    ("log", "logía logías"), ("u", "ución uciones ucion"), ("ente", "encia encias"),
    ("amente", "amente"), ("mente", "mente"), ("idad", "idad idades"), ("iva", "iva ivo ivas ivos"),
]
_STEP1 = sorted(((s, k) for k, group in _S1 for s in group.split()), key=lambda x: -len(x[0]))
_Y_VERBS = sorted("ya ye yan yen yeron yendo yo yó yas yes yais yamos".split(), key=len, reverse=True)
_VERBS_E = ("en", "es", "éis", "emos")
_VERBS = sorted(
    """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis
    iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías
    aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos""".split(),
    key=len, reverse=True,
)


def _after(word: str, start: int) -> int:
    """The place after the first consonant that follows a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in _ES_V and word[i - 1] in _ES_V:
            return i + 1
    return len(word)


def _rv(w: str) -> int:
    if len(w) < 3:
        return len(w)
    if w[1] not in _ES_V:
        return next((i + 1 for i in range(2, len(w)) if w[i] in _ES_V), len(w))
    if w[0] in _ES_V:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in _ES_V), len(w))
    return 3


@cache
def spanish_stem(w: str) -> str:
    w = w.lower()
    rv, r1 = _rv(w), _after(w, 0)
    r2 = _after(w, r1)
    region = lambda end, at: w.endswith(end) and len(w) - len(end) >= at
    # attached pronouns
    for p in _PRONOUNS:
        if w.endswith(p):
            if region(p, rv):
                base = w[: -len(p)]
                for g in ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"):
                    if base.endswith(g) and len(base) - len(g) >= rv and (g != "yendo" or base.endswith("uyendo")):
                        w = base[: -len(g)] + _GERUNDS.get(g, g)
                        break
            break
    before = w
    for s, k in _STEP1:
        if not w.endswith(s):
            continue
        cut = w[: -len(s)]
        if k == "amente":
            if len(cut) >= r1:
                w = cut
                if w.endswith("iv") and len(w) - 2 >= r2:
                    w = w[:-2]
                    if w.endswith("at") and len(w) - 2 >= r2:
                        w = w[:-2]
                elif w.endswith(("os", "ic", "ad")) and len(w) - 2 >= r2:
                    w = w[:-2]
        elif len(cut) >= r2:
            w = cut + {"log": "log", "u": "u", "ente": "ente"}.get(k, "")
            for more, ends in (("ic", ("ic",)), ("mente", ("ante", "able", "ible")), ("idad", ("abil", "ic", "iv")), ("iva", ("at",))):
                if k == more:
                    for e in ends:
                        if w.endswith(e) and len(w) - len(e) >= r2:
                            w = w[: -len(e)]
                            break
        break
    if w == before:
        for s in _Y_VERBS:
            if region(s, rv):
                if w[: -len(s)].endswith("u"):
                    w = w[: -len(s)]
                break
    if w == before:
        best = max((s for s in (*_VERBS_E, *_VERBS) if region(s, rv)), key=len, default=None)
        if best:
            w = w[: -len(best)]
            if best in _VERBS_E and w.endswith("gu"):
                w = w[:-1]
    for s in ("os", "a", "o", "á", "í", "ó", "e", "é"):
        if region(s, rv):
            w = w[: -len(s)]
            if s in "eé" and w.endswith("gu") and len(w) - 1 >= rv:
                w = w[:-1]
            break
    return w.translate(str.maketrans("áéíóú", "aeiou"))


def _batched(f: Callable[[str], str]):
    @F.pandas_udf(StringType())
    def run(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in terms:
            yield t.map(f, na_action="ignore")

    return run


def porter(term: Column) -> Column:
    return _batched(porter_stem)(term)


def lancaster(term: Column) -> Column:
    return _batched(lancaster_stem)(term)


def spanish(term: Column) -> Column:
    return _batched(spanish_stem)(term)
