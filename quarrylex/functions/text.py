"""Text analysis as Column expressions: tokenizers, case, accents, UTF-8, normalisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALNUM = r"[\p{L}\p{N}]+"
#: Punctuation that may start a token, and that may end one.
_LEAD, _TAIL = r"$£¢¥.", r"#+"
_PUNCT = r"\p{P}\p{S}"
_ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝŸàáâãäåçèéêëìíîïðñòóôõöøùúûüýÿ"
_BARE = "AAAAAACEEEEIIIIDNOOOOOOUUUUYYaaaaaaceeeeiiiidnoooooouuuuyy"
assert len(_ACCENTED) == len(_BARE)
_HAN = r"\p{IsHan}"
_SCRIPTS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]"
_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))


def tokens_alnum(text: Column) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ALNUM), F.lit(0))


def tokens_punct(text: Column) -> Column:
    """White-space tokens without punctuation around them; currency signs and dots may lead, # and + may end a token."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\s+")
    return F.filter(F.transform(parts, trim_token), lambda t: t.rlike(rf"[^{_PUNCT}\s]"))


def trim_token(token: Column) -> Column:
    head = F.regexp_replace(token, rf"^(?:(?![{_LEAD}])[{_PUNCT}])+", "")
    return strip_trailing(head)


def strip_trailing(token: Column) -> Column:
    """Without punctuation at the end, unless the last character is # or +."""
    return F.regexp_replace(token, rf"(?:(?![{_TAIL}])[{_PUNCT}])+$", "")


def components(token: Column) -> Column:
    """The token, and its parts where punctuation stands between other characters; all share the token's position."""
    parts = F.filter(F.split(token, rf"[{_PUNCT}]+"), lambda p: p != "")
    inner = token.rlike(rf"[^{_PUNCT}][{_PUNCT}]+[^{_PUNCT}]")
    return F.when(inner, F.array_distinct(F.concat(F.array(token), parts))).otherwise(F.array(token))


def has_script(text: Column) -> Column:
    """Chinese, Japanese, Korean or Thai characters occur."""
    return text.rlike(_SCRIPTS)


def bigrams(text: Column) -> Column:
    """Overlapping pairs of characters of each run of such a script (a single character alone)."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_SCRIPTS + "+"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))
    return F.flatten(pairs)


def unigrams(text: Column) -> Column:
    """One token a character, white space dropped."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c.rlike(r"\S"))


def hiragana(text: Column) -> Column:
    return F.translate(text, _KATAKANA, _HIRAGANA)


def tokens_auto(text: Column, lang: Column | None = None) -> Column:
    """The tokenizer by script and language hint: bigrams for Han, Kana, Hangul and Thai runs, plain tokens for the rest."""
    hinted = has_script(text) if lang is None else has_script(text) | lang.isin("zh", "ja", "ko", "th")
    rest = tokens_punct(F.regexp_replace(text, _SCRIPTS + "+", " "))
    return F.when(hinted, F.concat(bigrams(hiragana(text)), rest)).otherwise(tokens_punct(text))


def tokens_lines(text: Column) -> Column:
    """A term on each line, blank lines apart."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda t: t != "")


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"alnum": tokens_alnum, "punct": tokens_punct, "bigram": bigrams, "unigram": unigrams, "auto": tokens_auto, "lines": tokens_lines}


def bounded(tokens: Column, least: int = 1, most: int = 255) -> Column:
    """Tokens of at least so many characters, cut after most."""
    return F.transform(F.filter(tokens, lambda t: F.length(t) >= least), lambda t: F.substring(t, 1, most))


def has_upper(t: Column) -> Column:
    return t.rlike(r"\p{Lu}")


def has_lower(t: Column) -> Column:
    return t.rlike(r"\p{Ll}")


def all_upper(t: Column) -> Column:
    return has_upper(t) & ~has_lower(t)


def mixed_case(t: Column) -> Column:
    return has_upper(t) & has_lower(t)


def all_digits(t: Column) -> Column:
    return t.rlike(r"^\p{Nd}+$")


def case_class(t: Column) -> Column:
    """upper, mixed, lower, digits or none."""
    return F.when(all_upper(t), "upper").when(mixed_case(t), "mixed").when(has_lower(t), "lower").when(all_digits(t), "digits").otherwise("none")


def first_class(t: Column) -> Column:
    """Class of the first character, which restricts every expansion: digit, upper, lower or high."""
    return F.when(t.rlike("^[0-9]"), "digit").when(t.rlike("^[A-Z]"), "upper").when(t.rlike("^[a-z]"), "lower").otherwise("high")


def strip_accents(t: Column) -> Column:
    return F.translate(t, _ACCENTED, _BARE)


def strip_accents_py(t: str) -> str:
    return t.translate(str.maketrans(_ACCENTED, _BARE))


def clean_utf8(raw: Column) -> Column:
    """Bytes as text, invalid sequences replaced by a space."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�", " ")


def truncate(t: Column, most: int) -> Column:
    return F.substring(t, 1, most)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalise(t: Column) -> Column:
    """NFKC (Arrow UDF, only where a character beyond ASCII occurs), then dashes, quotes and spaces folded to their plain forms."""
    folded = F.when(t.rlike(r"[^\x00-\x7F]"), _nfkc(t)).otherwise(t)
    for pattern, plain in ((r"\p{Pd}", "-"), (r"[‘’‚‛′]", "'"), (r"[“-‟″«»]", '"'), (r"\p{Zs}", " ")):
        folded = F.regexp_replace(folded, pattern, plain)
    return folded


def recode(raw: Column, charset: str) -> Column:
    """Bytes of a charset as text."""
    return F.decode(raw, charset)
