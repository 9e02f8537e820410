"""Stemmers: plural rules for twelve languages as Column expressions, Porter and Lovins for English as Arrow UDFs.

Porter and Lovins are meant for distinct terms (the vocabulary), never for postings.
"""

from __future__ import annotations

import functools
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CONS = "bcdfghjklmnpqrstvwxz"


def _drop(t: Column, n: int, add: str = "") -> Column:
    short = F.substring(t, F.lit(1), F.length(t) - n)
    return F.concat(short, F.lit(add)) if add else short


def _alternatives(pattern: str) -> list[str]:
    """The strings that a pattern of letters, [classes] and (?:a|b) groups matches."""
    out = [""]
    for group, cls, letter in re.findall(r"\(\?:([^)]*)\)|\[([^\]]*)\]|(.)", pattern):
        out = [o + x for o in out for x in (group.split("|") if group else list(cls) if cls else [letter])]
    return out


def ends(t: Column, pattern: str) -> Column:
    """t ends with the pattern, whatever the case; comparisons of bytes do instead of regular expressions.

    A pattern may start with a negated class of the character before, which must be there.
    """
    low = F.lower(t)
    m = re.match(r"\[\^([^\]]*)\](.*)$", pattern)
    strings = _alternatives(m[2] if m else pattern)
    test = functools.reduce(lambda a, b: a | b, [low.endswith(x) for x in strings])
    if not m:
        return test
    before = F.substring(low, F.length(t) - len(strings[0]), F.lit(1))
    return test & (F.length(t) > len(strings[0])) & (~before.rlike(r"\p{P}") if m[1] == r"\p{P}" else ~before.isin(*m[1]))


def _rules(t: Column, *rules: tuple[int, str, int, str]) -> Column:
    """The first rule (length above, pattern of the end, characters to drop, ending to add) that holds."""
    out = None
    for above, pattern, n, add in rules:
        test = (F.length(t) > above) & ends(t, pattern)
        out = F.when(test, _drop(t, n, add) if n or add else t) if out is None else out.when(test, _drop(t, n, add) if n or add else t)
    return out.otherwise(t)


def plural_en(t: Column) -> Column:
    return F.when(~F.lower(t).endswith("s"), t).otherwise(_rules(t, (3, r"[^ea]ies", 3, "y"), (3, r"ies", 0, ""), (4, r"(?:sh|ch|ss|x)es", 2, ""), (3, r"[^aeiou]es", 1, ""), (2, r"es", 0, ""), (2, r"[us]s", 0, ""), (2, r"[^\p{P}]s", 1, "")))


def plural_fr(t: Column) -> Column:
    marked = F.when(ends(t, "aux"), _drop(t, 3, "al")).when(ends(t, "x"), _drop(t, 1))
    # one s, then r, e and é in this order, then one of two like letters
    s = F.regexp_replace(F.regexp_replace(t, "(?i)s$", ""), "(?i)(?<=^.{2,64})r$", "")
    for end in ("e", "é"):
        s = F.regexp_replace(s, f"(?i)(?<=^.{{2,64}}){end}$", "")
    s = F.regexp_replace(s, r"(?i)(?<=^.{1,64})(\p{L})\1$", "$1")
    return F.when(F.length(t) > 5, marked.otherwise(s)).otherwise(t)


def plural_es(t: Column) -> Column:
    return _rules(t, (4, "eses", 2, ""), (4, "ces", 3, "z"), (4, "[oaeóáé]s", 2, ""), (4, "[oaeóáéòàè]", 1, ""))


def plural_pt(t: Column) -> Column:
    return _rules(
        t, (2, "[õã]es", 3, "ão"), (5, "res", 2, ""), (4, "les", 2, ""), (2, "es", 1, ""), (4, "[eé]is", 3, "el"), (4, "óis", 3, "ol"), (2, "ais", 3, "al"), (3, "is", 2, "il"), (2, "is", 0, ""), (2, "ns", 2, "m"), (2, "s", 1, "")
    )


def plural_gl(t: Column) -> Column:
    return _rules(
        t, (5, "ões", 3, "ãn"), (3, "ães", 3, "ão"), (5, "res", 2, ""), (4, "les", 2, ""), (2, "es", 1, ""), (4, "[éeè]is", 3, "el"), (4, "[óo]is", 3, "ol"), (3, "ais", 3, "al"), (2, "is", 0, ""), (3, "ís", 2, "il"), (2, "ns", 1, ""), (2, "s", 1, "")
    )


def plural_de(t: Column) -> Column:
    return _rules(t, (6, "nen", 3, ""), (5, "e[nsr]", 2, ""), (5, "se", 2, ""), (4, "[nsre]", 1, ""))


def plural_it(t: Column) -> Column:
    return _rules(t, (5, "[ih][ei]", 2, ""), (5, "[ei]", 1, ""), (5, "i[oa]", 2, ""), (5, "[oa]", 1, ""))


def plural_nl(t: Column) -> Column:
    return _rules(t, (4, f"[{_CONS}]en", 2, ""), (4, f"[{_CONS.replace('j', '')}]s", 1, ""))


def plural_sv(t: Column) -> Column:
    return _rules(t, (4, "[bcdfghjklmnoprtvy]s", 1, ""))


def plural_no(t: Column) -> Column:
    return _rules(t, (4, "[bcdfghjklmnoprtvyz]s", 1, ""))


def plural_da(t: Column) -> Column:
    return _rules(t, (4, "[abcdfghjklmnoprtvyzå]s", 1, ""))


def plural_bg(t: Column) -> Column:
    core = _rules(t, (4, "ове", 3, ""), (4, "еве", 3, "й"), (4, "ища", 3, ""), (4, "овци", 3, "о"), (4, "ци", 2, "к"), (4, "зи", 2, "г"))
    inner = F.when((F.length(t) > 4) & t.rlike("(?i)е.и$"), F.concat(_drop(t, 3), F.lit("я"), F.substring(t, F.length(t) - 1, F.lit(1))))
    known = (F.length(t) > 4) & ends(t, "(?:ове|еве|ища|ци|зи)")
    return F.when(known, core).otherwise(F.coalesce(inner, _rules(t, (4, "та", 2, ""), (4, "и", 1, ""))))


def plural_any(t: Column) -> Column:
    return _rules(t, (2, r"[^\p{P}]s", 1, ""))


PLURAL = {"en": plural_en, "fr": plural_fr, "es": plural_es, "pt": plural_pt, "gl": plural_gl, "it": plural_it, "de": plural_de, "nl": plural_nl, "sv": plural_sv, "no": plural_no, "da": plural_da, "bg": plural_bg}


def plural(t: Column, lang: Column | str) -> Column:
    """Plural stemming by canonical language, with the generic rule for all others."""
    if isinstance(lang, str):
        return PLURAL.get(lang.split("-")[0], plural_any)(t)
    code = F.substring_index(lang, "-", 1)
    out = F.when(F.lit(False), t)
    for k, f in PLURAL.items():
        out = out.when(code == k, f(t))
    return out.otherwise(plural_any(t))


# --- Porter -----------------------------------------------------------------------------------------------------------


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("v" if _vowel(w, i) else "c" for i in range(len(w)))
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and not _vowel(w, len(w) - 3) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 1) and w[-1] not in "wxy"


# Endings of the steps.
_STEP2 = {
    "ational": "ate", "ation": "ate", "ator": "ate", "abli": "able", "alism": "al", "aliti": "al", "alli": "al", "anci": "ance", "biliti": "ble",
    "eli": "e", "enci": "ence", "entli": "ent", "fulness": "ful", "isation": "ise", "iser": "ise", "iveness": "ive", "iviti": "ive", "ization": "ize",
    "izer": "ize", "ousli": "ous", "ousness": "ous", "tional": "tion",
}
_STEP3 = {
    "alise": "al", "alize": "al", "ative": "", "ful": "", "ical": "ic", "icate": "ic", "iciti": "ic", "ness": "",
}
_STEP4 = "able al ance ant ate ement ence ent er ible ic ise ism iti ive ize ment ou ous".split()


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


@lru_cache(1 << 16)
def porter(term: str) -> str:
    """The published algorithm with British spellings (-ise, -isation, -alise); terms with other characters stay as they are."""
    if not term.isalpha() or len(term) < 3:
        return term
    w = term.lower()
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif (end := next((e for e in ("ed", "ing") if w.endswith(e)), None)) and _has_vowel(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz", "is")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprtwx":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (end := _longest(w, table)) and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    if (end := _longest(w, _STEP4)) and not w.endswith(("sion", "tion")):
        if _measure(w[: -len(end)]) > 1:
            w = w[: -len(end)]
    elif w.endswith(("sion", "tion")) and _measure(w[:-3]) > 1:
        w = w[:-3]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w.upper() if term.isupper() else w


# --- Lovins -----------------------------------------------------------------------------------------------------------

#: Fixed values of the published algorithm: endings by the letter of their condition, A for none.
_LOVINS = {
    "A": """a ae acy aic ata ate able ably aric ates ator acies acity aical alist ality alize arial aries arily arity arize aroid ately ative
        ators atory aceous alness ancial ancies ariser arized arizer atable atives ability aically alities aristic arizing ateness atingly
        atively ativism ableness arizable antaneous antiality arisation arization ativeness antialness arisations arizations arizability
        e ese eful eity ence ency eous ehood eless elity ement enced ences ental ently efully encies encing ential entist eously encible
        entally entials entiate entness entation entially eousness entations entiality entialize entiation entialness ful fully fulness hood
        i ia ic is ial ian ics ied ier ily ist ity ium ive ials ians ible ibly ical iers iful ious ists ially icant ician icide icism icist
        icity iedly ihood inate iness ional ioned ished istic ities itous ively ivity ialist iality ialize ically icance icians icists ifully
        ionals ioning ionist iously istics ibility icalism icalist icality icalize icianry ination ingness ionally isation ishness istical
        iteness iveness ivistic ivities ization izement ibleness icalness ionality ionalize iousness istically ionalness ially
        less ly lessly lessness ness o ogen oid ous oidal oides oidism ousness s""",
    "B": "age als ably ages ally ance ancy ant ants aging alism anced ances arity atic ation ations acious ancing alistic ational ationally alistically as ism isms ions ingly",
    "BB": "al als allic", "C": "ant antic ent ented enting ish allically", "D": "ionate", "E": "ature ed ely ene ery es edly ened enly eness ening elihood eableness ariness izable",
    "F": "ary en ize ized izer izers izing", "G": "action ication", "H": "itic", "I": "ated ating idine", "J": "inism", "K": "arly", "L": "ide ides", "M": "ine ines", "N": "ing ings", "O": "ars", "P": "ies",
    "Q": "ion", "R": "on", "S": "ori", "W": "s's", "X": "ar", "Y": "eal ear ealy early", "Z": "eature", "AA": "ite", "CC": "inity",
}
_CONDITION = {
    "A": lambda s: True, "B": lambda s: len(s) > 2, "C": lambda s: len(s) > 3, "D": lambda s: len(s) > 4, "E": lambda s: not s.endswith("e"), "F": lambda s: len(s) > 2 and not s.endswith("e"),
    "G": lambda s: len(s) > 2 and s.endswith("f"), "H": lambda s: s.endswith(("t", "ll")), "I": lambda s: not s.endswith(("o", "e")), "J": lambda s: not s.endswith(("a", "e")),
    "K": lambda s: len(s) > 2 and (s.endswith(("l", "i")) or (s.endswith("e") and s[-3:-2] == "u")), "L": lambda s: not s.endswith(("u", "x")) and (not s.endswith("s") or s.endswith("os")),
    "M": lambda s: not s.endswith(("a", "c", "e", "m")), "N": lambda s: len(s) > 2 and (s[-3:-2] != "s" or len(s) > 3), "O": lambda s: s.endswith(("l", "i")), "P": lambda s: not s.endswith("c"),
    "Q": lambda s: len(s) > 2 and not s.endswith(("l", "n")), "R": lambda s: s.endswith(("n", "r")), "S": lambda s: s.endswith("dr") or (s.endswith("t") and not s.endswith("tt")),
    "W": lambda s: not s.endswith(("s", "u")), "X": lambda s: s.endswith(("l", "i")) or (s.endswith("e") and s[-3:-2] == "u"), "Y": lambda s: s.endswith("in"), "Z": lambda s: not s.endswith("f"),
    "AA": lambda s: s.endswith(("d", "f", "ph", "th", "l", "er", "or", "es", "t")), "BB": lambda s: len(s) > 2 and not s.endswith(("met", "ryst")), "CC": lambda s: s.endswith("l"),
}
_ENDINGS = {e: k for k, v in _LOVINS.items() for e in v.split()}
#: Respellings of a stem's end: (end, respelled, letters that must not stand before).
_RECODE = (
    ("uad", "uas", ""), ("vad", "vas", ""), ("cid", "cis", ""), ("lid", "lis", ""), ("erid", "eris", ""), ("pand", "pans", ""), ("end", "ens", "s"),
    ("ond", "ons", ""), ("lud", "lus", ""), ("rud", "rus", ""), ("ul", "l", "aio"), ("istr", "ister", ""), ("metr", "meter", ""), ("her", "hes", "pt"),
    ("urs", "ur", ""), ("uct", "uc", ""), ("umpt", "um", ""), ("rpt", "rb", ""), ("mit", "mis", ""), ("ert", "ers", ""), ("et", "es", "n"),
    ("yt", "ys", ""), ("iev", "ief", ""), ("olv", "olut", ""), ("bex", "bic", ""), ("dex", "dic", ""), ("pex", "pic", ""), ("tex", "tic", ""),
    ("ax", "ac", ""), ("ex", "ec", ""), ("ix", "ic", ""), ("lux", "luc", ""), ("yz", "ys", ""),
)


@lru_cache(1 << 16)
def lovins(term: str) -> str:
    """Longest-match removal of an ending under its condition, then undoubling and respelling of the stem's end."""
    w = term.lower()
    if len(w) <= 2:
        return term
    for n in range(min(11, len(w) - 2), 0, -1):
        kind = _ENDINGS.get(w[-n:])
        if kind and _CONDITION[kind](w[:-n]):
            w = w[:-n]
            break
    if len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdglmnprst":
        w = w[:-1]
    for old, new, guard in _RECODE:
        if w.endswith(old) and (not guard or len(w) == len(old) or w[-len(old) - 1] not in guard):
            w = w[: -len(old)] + new
            break
    return w.upper() if term.isupper() else w


@F.pandas_udf(T.StringType())
def porter_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else porter(t))


@F.pandas_udf(T.StringType())
def lovins_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else lovins(t))


def stem(t: Column, stemmer: str, lang: Column | str = "en") -> Column:
    """Dispatch by stemmer and language: the English algorithms leave other languages to the plural rules."""
    if stemmer == "none":
        return t
    if stemmer == "plural":
        return plural(t, lang)
    udf = {"porter": porter_udf, "lovins": lovins_udf}[stemmer]
    if isinstance(lang, str):
        return udf(t) if lang.split("-")[0] == "en" else plural(t, lang)
    return F.when(F.substring_index(lang, "-", 1) == "en", udf(t)).otherwise(plural(t, lang))
