"""Phonetic keys and the typing-error match. Keys are Arrow UDFs over distinct terms; soundex has native forms too."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylex.functions.text import strip_accents, strip_accents_py

# Codes of A to Z.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SOUNDEX = dict(zip(_LETTERS, "01230120022455012623010202", strict=True))
_PHONIX = dict(zip(_LETTERS, "01230720022455012683070808", strict=True))


@lru_cache(1 << 16)
def soundex(term: str) -> str:
    """Four characters; only letters equal to the one just before are skipped, codes may repeat; padded as Z000."""
    w = strip_accents_py(term).upper()
    key, last = w[:1], w[:1]
    for c in w[1:]:
        if c != last and _SOUNDEX.get(c, "0") != "0" and len(key) < 4:
            key += _SOUNDEX[c]
        last = c
    return key + "Z000"[len(key) :]


def soundex_native(term: Column) -> Column:
    """soundex() as Column expressions: repeated letters squeezed, letters mapped to digits, zeros dropped."""
    w = F.upper(strip_accents(term))
    squeezed = F.regexp_replace(w, r"(.)\1+", "$1")
    rest = F.regexp_replace(F.substring(squeezed, 2, 1000), "[^A-Z]", "")
    digits = F.regexp_replace(F.translate(rest, _LETTERS, "".join(_SOUNDEX[c] for c in _LETTERS)), "0", "")
    return F.rpad(F.concat(F.substring(w, 1, 1), F.substring(digits, 1, 3)), 4, "0")


def soundex_alternative(term: Column) -> Column:
    """Up to six characters: the first letter as it is, then the digits of all coded letters, repeats kept, no padding."""
    w = strip_accents(term)
    rest = F.regexp_replace(F.upper(F.substring(w, 2, 1000)), "[^BCDFGJKLMNPQRSTVXZ]", "")
    return F.concat(F.substring(w, 1, 1), F.substring(F.translate(rest, "BPFVCSKGJQXZDTLMNR", "111122222222334556"), 1, 5))


# --- Phonix ---------------------------------------------------------------------------------------------------------------

# The published rules of letter groups.
_V, _C = "[AEIOUY]", "[B-DF-HJ-NP-TV-XZ]"
#: (place in the word, letters, their replacement, kind of letter before, kind of letter after)
_GADD = (
    ("any", "DG", "G", "", ""), ("any", "CO", "KO", "", ""), ("any", "CA", "KA", "", ""), ("any", "CU", "KU", "", ""),
    ("any", "CY", "SI", "", ""), ("any", "CI", "SI", "", ""), ("any", "CE", "SE", "", ""), ("start", "CL", "KL", "", "vowel"),
    ("any", "CK", "K", "", ""), ("end", "GC", "K", "", ""), ("end", "JC", "K", "", ""), ("start", "CHR", "KR", "", "vowel"),
    ("start", "CR", "KR", "", "vowel"), ("start", "WR", "R", "", ""), ("any", "NC", "NK", "", ""), ("any", "CT", "KT", "", ""),
    ("any", "PH", "F", "", ""), ("any", "AA", "AR", "", ""), ("any", "SCH", "SH", "", ""), ("any", "BTL", "TL", "", ""),
    ("any", "GHT", "T", "", ""), ("any", "AUGH", "ARF", "", ""), ("middle", "LJ", "LD", "vowel", "vowel"), ("any", "LOUGH", "LOW", "", ""),
    ("start", "Q", "KW", "", ""), ("start", "KN", "N", "", ""), ("end", "GN", "N", "", ""), ("any", "GHN", "N", "", ""),
    ("end", "GNE", "N", "", ""), ("any", "GHNE", "NE", "", ""), ("end", "GNES", "NS", "", ""), ("start", "GN", "N", "", ""),
    ("middle", "GN", "N", "", "consonant"), ("start", "PS", "S", "", ""), ("start", "PT", "T", "", ""), ("start", "CZ", "C", "", ""),
    ("middle", "WZ", "Z", "vowel", ""), ("middle", "CZ", "CH", "", ""), ("any", "LZ", "LSH", "", ""), ("any", "RZ", "RSH", "", ""),
    ("middle", "Z", "S", "", "vowel"), ("any", "ZZ", "TS", "", ""), ("middle", "Z", "TS", "consonant", ""), ("any", "HROUG", "REW", "", ""),
    ("any", "OUGH", "OF", "", ""), ("middle", "Q", "KW", "vowel", "vowel"), ("middle", "J", "Y", "vowel", "vowel"),
    ("start", "YJ", "Y", "", "vowel"), ("start", "GH", "G", "", ""), ("end", "E", "GH", "vowel", ""), ("start", "CY", "S", "", ""),
    ("any", "NX", "NKS", "", ""), ("start", "PF", "F", "", ""), ("end", "DT", "T", "", ""), ("end", "TL", "TIL", "", ""),
    ("end", "DL", "DIL", "", ""), ("any", "YTH", "ITH", "", ""), ("start", "TJ", "CH", "", "vowel"), ("start", "TSJ", "CH", "", "vowel"),
    ("start", "TS", "T", "", "vowel"), ("any", "TCH", "CH", "", ""), ("middle", "WSK", "VSKIE", "vowel", ""),
    ("end", "WSK", "VSKIE", "vowel", ""), ("start", "MN", "N", "", "vowel"), ("start", "PN", "N", "", "vowel"),
    ("middle", "STL", "SL", "vowel", ""), ("end", "STL", "SL", "vowel", ""), ("end", "TNT", "ENT", "", ""), ("end", "EAUX", "OH", "", ""),
    ("any", "EXCI", "ECS", "", ""), ("any", "X", "ECS", "", ""), ("end", "NED", "ND", "", ""), ("any", "JR", "DR", "", ""),
    ("end", "EE", "EA", "", ""), ("any", "ZS", "S", "", ""), ("middle", "R", "AH", "vowel", "consonant"), ("end", "R", "AH", "vowel", ""),
    ("middle", "HR", "AH", "vowel", "consonant"), ("end", "HR", "AH", "vowel", ""), ("end", "RE", "AR", "", ""), ("any", "LLE", "LE", "", ""),
    ("end", "LE", "ILE", "consonant", ""), ("end", "LES", "ILES", "consonant", ""), ("end", "E", "", "", ""), ("end", "ES", "S", "", ""),
    ("end", "SS", "AS", "vowel", ""), ("end", "MB", "M", "vowel", ""), ("any", "MPTS", "MPS", "", ""), ("any", "MPS", "MS", "", ""),
    ("any", "MPT", "MT", "", ""),
)


def _compile() -> list[tuple[re.Pattern[str], str]]:
    out = []
    kinds = {"vowel": _V, "consonant": _C}
    for place, old, new, before, after in _GADD:
        inside = "." if place == "middle" else None
        left, right = kinds.get(before, inside), kinds.get(after, inside)
        pattern = ("^" if place == "start" else "") + (f"(?<={left})" if left else "") + old + (f"(?={right})" if right else "") + ("$" if place == "end" else "")
        out.append((re.compile(pattern), new))
    return out


_PHONIX_RULES = _compile()
#: First letters of the terms that a phonix query may match, by the query's first letter.
PHONIX_FIRST = {"a": "aehiorsuy", "c": "ct", "d": "djr", "e": "aeiotuxy", "f": "fp", "g": "deg", "i": "aeilouy", "k": "cgjkq", "n": "gkmnp", "o": "aeiouy", "r": "hrw", "s": "cepsz", "t": "bdgptz", "u": "aeiouy", "v": "vw", "y": "aeijouy", "z": "wz"}


@lru_cache(1 << 16)
def phonix(term: str) -> str:
    """Letter groups respelled in order, then the first letter ($ for a vowel) and up to seven digits."""
    w = strip_accents_py(term).upper()
    for pattern, new in _PHONIX_RULES:
        w = pattern.sub(new, w)
    if not w:
        return ""
    key, last = "$" if w[0] in "AEIOUY" else w[0], w[0]
    for c in w[1:]:
        if c.isalpha() and c != last:
            last = c
            if _PHONIX.get(c, "0") != "0" and len(key) < 8:
                key += _PHONIX[c]
    return key


_FRONT, _VOWELS = "EIY", "AEIOU"


@lru_cache(1 << 16)
def metaphone(term: str) -> str:
    """Six characters at most. W and Y sound before a vowel."""
    w = re.sub("[^A-Z]", "", strip_accents_py(term).upper())
    if w[:2] in ("PN", "KN", "GN", "AE", "WR"):
        w = w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    elif w[:1] == "X":
        w = "S" + w[1:]
    at = lambda i: w[i] if 0 <= i < len(w) else ""
    key, i = "", -1
    for c in w:
        i += 1
        if len(key) >= 6:
            break
        a, n, nn = at(i - 1), at(i + 1), at(i + 2)
        front = bool(n) and n in _FRONT
        if c == a and c != "C":
            continue
        if c in "FJLMNR" or (i == 0 and c in _VOWELS):
            key += c
        elif c == "B" and not (a == "M" and not n):
            key += c
        elif c == "C" and not (a == "S" and front):
            hard = (i == 0 and nn not in (*_VOWELS,)) or a == "S"
            key += "X" if n == "I" and nn == "A" else "S" if front else ("K" if hard else "X") if n == "H" else "K"
        elif c == "D":
            key += "J" if n == "G" and nn and nn in _FRONT else "T"
        elif c == "G":
            silent = (n == "H" and not (nn and nn in _VOWELS)) or (n == "N" and (not nn or (nn == "E" and at(i + 3) == "D"))) or (a == "D" and front)
            if not silent:
                key += "J" if front and a != "G" else "K"
            elif n == "H" and at(i - 3) not in ("B", "D", "H") and at(i - 4) != "H" and i > 0:
                key += "F"
        elif c == "H" and a not in ("C", "G", "P", "S", "T") and (n and n in _VOWELS):
            key += c
        elif c == "K" and a != "C":
            key += c
        elif c == "P":
            key += "F" if n == "H" else c
        elif c == "Q":
            key += "K"
        elif c == "S":
            key += "X" if n == "H" or (n == "I" and nn in ("O", "A")) else c
        elif c == "T":
            if n == "I" and nn in ("O", "A"):
                key += "X"
            elif n == "H":
                key += "0"
            elif not (n == "C" and nn == "H"):
                key += c
        elif c == "V":
            key += "F"
        elif c in "WY" and n and n in _VOWELS:
            key += c
        elif c == "X":
            key += "S" if i == 0 else "KS"
        elif c == "Z":
            key += "S"
    return key[:6]


def typo(term: str, candidate: str, most: int = 1) -> bool:
    """Same first letter and equal, a prefix within most, or at most so many slips in one scan from the left.

    A slip is a transposition, a wrong letter, an extra letter on either side, or a missing accent.
    """
    if not term or not candidate or term[0] != candidate[0]:
        return False
    if term == candidate or (candidate.startswith(term) and len(candidate) - len(term) <= most):
        return True
    at = lambda s, k: s[k] if k < len(s) else ""
    i = j = 1
    slips = 0
    while i < len(term) and j < len(candidate):
        a, b, a2, b2 = term[i], candidate[j], at(term, i + 1), at(candidate, j + 1)
        if a != b:
            slips += 1
            if not a2 and not b2:
                pass
            elif (a == b2 and a2 == b) or a2 == b2:
                i, j = i + 1, j + 1
            elif a == b2:
                j += 1
            elif a2 == b:
                i += 1
            elif strip_accents_py(a) == strip_accents_py(b):
                i, j = i + 1, j + 1
        i, j = i + 1, j + 1
    if j < len(candidate):
        slips += len(candidate) - j
    elif i < len(term):
        slips += len(term) - i
    return 0 < slips <= most


def _udf(f):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return run


soundex_udf, phonix_udf, metaphone_udf = _udf(soundex), _udf(phonix), _udf(metaphone)


def typo_match(term: str, candidates: Column, most: int = 1) -> Column:
    """Arrow test of a vocabulary column against one query term; cheap native tests come first."""

    @F.pandas_udf(T.BooleanType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda c: c is not None and typo(term, c, most))

    near = candidates.startswith(term[:1]) & (F.abs(F.length(candidates) - len(term)) <= most)
    return near & run(F.when(near, candidates))
