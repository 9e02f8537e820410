"""Term expansion: predicates over the vocabulary. All are restricted to terms whose first character has the query's class.

A search of an index that isn't stored puts them to every word of the texts: plain comparisons, which refuse most words, come
before regular expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylex.functions import phonetics, text

FUNCTIONS = {"soundex": "soundex", "phonix": "phonix", "metaphone": "metaphone", "soundslike": "metaphone", "typo": "typo", "regex": "regex", "regexp": "regex", "literal": "literal", "range": "range", "wildcard": "wildcard"}
_WILD = {"*": ".*", "?": ".", "@": r"\p{L}", "%": r"\p{Nd}"}


class ExpansionError(ValueError):
    pass


def has_wildcard(term: str) -> bool:
    return bool(re.search(r"(?<!\\)[*?@%]", term))


def wildcard_regex(pattern: str) -> tuple[str, str]:
    """(literal prefix, anchored regular expression) of a pattern with * ? @ %, where a backslash makes a literal."""
    out, prefix, open_ = "", "", True
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            c = pattern[i]
            out += re.escape(c)
            prefix += c if open_ else ""
        elif c in _WILD:
            out += _WILD[c]
            open_ = False
        else:
            out += re.escape(c)
            prefix += c if open_ else ""
        i += 1
    return prefix, f"^{out}$"


def same_class(term: Column, query: str) -> Column:
    c = query[:1]
    kind = "digit" if re.match("[0-9]", c) else "upper" if re.match("[A-Z]", c) else "lower" if re.match("[a-z]", c) else "high"
    spans = {"digit": ("0", ":"), "upper": ("A", "["), "lower": ("a", "{")}  # from the first character to the one after the last
    within = {k: (term >= low) & (term < end) for k, (low, end) in spans.items()}
    return within[kind] if kind in within else ~(within["digit"] | within["upper"] | within["lower"])


def _prefixed(term: Column, prefix: str) -> Column:
    return term.startswith(prefix) if prefix else F.lit(True)


def wildcard(term: Column, pattern: str) -> Column:
    prefix, regex = wildcard_regex(pattern)
    return _prefixed(term, prefix) & term.rlike(regex)


def regex(term: Column, pattern: str) -> Column:
    """Unanchored, but the literal letters and digits it starts with must start the term."""
    prefix = re.match(r"\^?(\w*)", pattern).group(1)
    if re.match(r"\^?\w+[*?{|]", pattern):
        prefix = prefix[:-1]
    return _prefixed(term, prefix) & term.rlike(pattern)


def numeric_range(term: Column, low: int, high: int) -> Column:
    return (term >= "0") & (term < ":") & term.rlike(r"^\d{1,18}$") & term.try_cast("bigint").between(low, high)


def alpha_range(term: Column, low: str, high: str) -> Column:
    kind = F.lit("upper" if low.isupper() else "mixed" if low != low.lower() else "lower")
    return F.lower(term).between(low.lower(), high.lower()) & term.rlike(r"^\p{L}") & (text.case_class(term) == kind)


def term_range(term: Column, spec: str) -> Column:
    low, dash, high = spec.partition("-")
    if not dash or not low or not high or has_wildcard(spec):
        raise ExpansionError(f"not a range: {spec}")
    if low.isdigit() and high.isdigit():
        return numeric_range(term, int(low), int(high))
    if low.isdigit() or high.isdigit() or (low != low.lower()) != (high != high.lower()):
        raise ExpansionError(f"both ends of a range must be of a kind: {spec}")
    return alpha_range(term, low, high)


def comparison(term: Column, op: str, value: str) -> Column:
    """= != > < >= <= on numbers where the value is one, else on terms of the same case."""
    if value.isdigit():
        number, v = term.try_cast("bigint"), int(value)
        shape = term.rlike(r"^\d{1,18}$")
    else:
        number, v = F.lower(term), value.lower()
        shape = text.case_class(term) == F.lit("upper" if value.isupper() else "lower")
    tests = {"=": number == v, "!=": number != v, ">": number > v, "<": number < v, ">=": number >= v, "<=": number <= v}
    return shape & tests[op]


def predicate(term: Column, function: str, value: str) -> Column:
    """The test of one term function; wildcards inside other functions are rejected."""
    if function not in ("wildcard", "regex") and has_wildcard(value):
        raise ExpansionError(f"no wildcard may stand in {function}[{value}]")
    if function == "wildcard":
        return wildcard(term, value) & same_class(term, value)  # a prefix is the quickest test
    elif function == "regex":
        return regex(term, value)
    elif function == "range":
        return term_range(term, value)
    elif function == "literal":
        return term == value
    elif function == "typo":
        test = phonetics.typo_match(value, term)
    elif function == "soundex":
        test = (F.lower(F.substring(term, 1, 1)) == value[:1].lower()) & (phonetics.soundex_native(term) == phonetics.soundex(value))
    elif function == "phonix":
        first = phonetics.PHONIX_FIRST.get(value[:1].lower(), value[:1].lower())
        near = F.lower(F.substring(term, 1, 1)).isin(*first)
        test = near & (phonetics.phonix_udf(F.when(near, term)) == phonetics.phonix(value))
    elif function == "metaphone":
        test = phonetics.metaphone_udf(term) == phonetics.metaphone(value)
    else:
        raise ExpansionError(f"unknown term function {function}")
    return same_class(term, value) & test


def expand(terms: DataFrame, function: str, value: str, field_ids: list[int] | None = None) -> DataFrame:
    """The rows of terms that a term function selects, of given fields only."""
    out = terms.where(predicate(F.col("term"), function, value))
    return out.where(F.arrays_overlap("field_ids", F.array(*map(F.lit, field_ids)))) if field_ids else out
