"""English stop lists: none, a short web list, and a longer one with single characters and contractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of both lists.
SHORT = frozenset("a about an are as at be by com edu for from how i in is it of on that the this to was what when where which who why will with".split())
LONG = frozenset("""
    0 1 2 3 4 5 6 7 8 9 a about an are as at b be by c com d e edu f for for's from g h how how's how'd i in is it it'd it'll it's its j k l m n o of on p
    q r s t that that'll that's thats the this this'd this'll to u v w was what what'd what'll what're what's when when's where where'd where'll where're
    where's where've which who who'd who'll who're who's who've why why'd will will's wills with x y z
    """.split())
LISTS: dict[str, frozenset[str]] = {"none": frozenset(), "short": SHORT, "long": LONG}


def read_list(path: str) -> frozenset[str]:
    """A stop list from a text file on the driver: one term a line, blank lines and # comments skipped."""
    with open(path, encoding="utf-8") as f:
        return frozenset(t.lower() for line in f if (t := line.split("#")[0].strip()))


def is_stop(term: Column, stop_list: str | frozenset[str] = "long") -> Column:
    words = LISTS[stop_list] if isinstance(stop_list, str) else stop_list
    return F.lower(term).isin(*sorted(words)) if words else F.lit(False)
