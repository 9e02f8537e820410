"""Restrictions of results: dates, languages, inclusion and exclusion terms, list files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylex.functions import stemmers
from quarrylex.operators import expand
from quarrylex.operators.index import Index


def date_test(tests: list[tuple[str, int]], column: str = "ansi_date") -> Column:
    """All of the comparisons hold; documents without a date fail."""
    c = F.col(column)
    forms = {"=": lambda v: c == v, "!=": lambda v: c != v, ">": lambda v: c > v, "<": lambda v: c < v, ">=": lambda v: c >= v, "<=": lambda v: c <= v}
    return reduce(lambda a, b: a & b, [forms[o](F.lit(v)) for o, v in tests], c > 0)


def language_test(langs: list[str], column: str = "lang") -> Column:
    """Any of the languages; a canonical code (en) also takes its regions (en-us)."""
    whole = [x.lower() for x in langs if "-" in x]
    bare = [x.lower() for x in langs if "-" not in x]
    c = F.lower(F.regexp_replace(F.col(column), "_", "-"))
    return (c.isin(whole) if whole else F.lit(False)) | (F.substring_index(c, "-", 1).isin(bare) if bare else F.lit(False))


def _split(word: str) -> tuple[tuple[str, ...], str]:
    """Field names and body of a filter term: field=word or field:word."""
    m = re.match(r"([A-Za-z_*][\w*-]*)(?:=|:(?!//))(.+)$", word)
    return ((m[1].replace("-", "_"),), m[2]) if m else ((), word)


def _form(index: Index, body: str) -> Column:
    """A filter word as it stands in the index: stemmed if it has no upper case."""
    if body == body.lower() and index.config.stemmer == "plural":
        return stemmers.plural(F.lit(body), index.config.lang)
    if body == body.lower() and index.config.stemmer in ("porter", "lovins"):
        return F.lit(getattr(stemmers, index.config.stemmer)(body))
    return F.lit(body)


def term_test(index: Index, word: str, term: Column) -> Column:
    """Whether a term is one that a filter term stands for, in whatever field."""
    body = _split(word)[1]
    return expand.predicate(term, "wildcard", body) if expand.has_wildcard(body) else term == _form(index, body)


def term_documents(index: Index, word: str) -> DataFrame:
    """(doc_id) of one filter term: field=word or field:word, a wildcard pattern, or a word, stemmed if it has no upper case."""
    names, body = _split(word)
    ids = index.field_ids(names)
    rows = index.postings.where(F.col("field_id").isin(ids)) if ids else index.postings
    if expand.has_wildcard(body):
        chosen = expand.expand(index.terms, "wildcard", body, ids).select("term")
        return rows.join(chosen, "term", "left_semi").select("doc_id")
    return rows.where(F.col("term") == _form(index, body)).select("doc_id")


def any_of(index: Index, words: list[str]) -> DataFrame:
    return reduce(DataFrame.union, [term_documents(index, w) for w in words]).distinct()


def listed(index: Index, path: str) -> DataFrame:
    """(doc_id) of the documents that hold a term of a UTF-8 list file, one term a line; the file is read as a table."""
    words = index.spark.read.text(path).select(F.trim("value").alias("term")).where("term <> ''").distinct()
    low = words.select(F.when(F.lower("term") == F.col("term"), stemmers.plural(F.col("term"), index.config.lang) if index.config.stemmer == "plural" else F.col("term")).otherwise(F.col("term")).alias("term"))
    return index.postings.join(low, "term", "left_semi").select("doc_id").distinct()


def counters(index: Index, docs: DataFrame, modifiers: dict, lists: dict[str, str] | None = None, whole: Index | None = None) -> DataFrame:
    """One row: documents matched, those that each kind of restriction refuses (a document may fail several), and returned.

    Each restriction is one flag of a document, joined on doc_id; the counts are one aggregation. whole: as in restrict.
    """
    lists, whole = lists or {}, whole or index
    yes = lambda df: df.select("doc_id").distinct()
    needed = [any_of(index, words) for words in modifiers.get("inclusion_filter") or []]
    needed += [yes(reduce(DataFrame.union, [listed(whole, lists[n]) for n in names])) for names in modifiers.get("inclusion_list_filter") or []]
    gone = [any_of(index, words) for words in modifiers.get("exclusion_filter") or []]
    gone += [listed(whole, lists[n]) for names in modifiers.get("exclusion_list_filter") or [] for n in names]
    rows = yes(docs).join(index.documents.select("doc_id", "ansi_date", "lang"), "doc_id", "left")
    rows = rows.withColumn("late", ~date_test(modifiers["date"]) if modifiers.get("date") else F.lit(False)).withColumn("foreign", ~language_test(modifiers["language"]) if modifiers.get("language") else F.lit(False))
    rows = rows.select("doc_id", F.coalesce("late", F.lit(True)).alias("late"), F.coalesce("foreign", F.lit(True)).alias("foreign"))
    for name, sides, there in (("outside", needed, False), ("inside", gone, True)):
        rows = rows.withColumn(name, F.lit(False))
        for k, side in enumerate(sides):
            rows = rows.join(yes(side).withColumn(f"f{k}", F.lit(True)), "doc_id", "left").withColumn(name, F.col(name) | (F.coalesce(f"f{k}", F.lit(False)) == there)).drop(f"f{k}")
    refused = F.col("late") | F.col("foreign") | F.col("outside") | F.col("inside")
    return rows.agg(
        F.count(F.lit(1)).alias("matched"), F.count_if("late").alias("failed_date"), F.count_if("foreign").alias("failed_language"), F.count_if("outside").alias("not_included"), F.count_if("inside").alias("excluded"), F.count_if(~refused).alias("returned")
    )


def restrict(index: Index, docs: DataFrame, modifiers: dict, lists: dict[str, str] | None = None, whole: Index | None = None) -> DataFrame:
    """docs (with doc_id) under all filters of the modifiers: each inclusion filter must hold, no exclusion filter may.

    lists: paths of the named list filters; whole: the index that these need, where index is narrowed to the search's words.
    """
    lists, whole = lists or {}, whole or index
    for words in modifiers.get("inclusion_filter") or []:
        docs = docs.join(any_of(index, words), "doc_id", "left_semi")
    for names in modifiers.get("inclusion_list_filter") or []:
        docs = docs.join(reduce(DataFrame.union, [listed(whole, lists[n]) for n in names]).distinct(), "doc_id", "left_semi")
    gone = [any_of(index, words) for words in modifiers.get("exclusion_filter") or []]
    gone += [listed(whole, lists[n]) for names in modifiers.get("exclusion_list_filter") or [] for n in names]
    for g in gone:
        docs = docs.join(g, "doc_id", "left_anti")
    tests = []
    if modifiers.get("date"):
        tests.append(date_test(modifiers["date"]))
    if modifiers.get("language"):
        tests.append(language_test(modifiers["language"]))
    if tests:
        keep = index.documents.where(reduce(lambda a, b: a & b, tests)).select("doc_id")
        docs = docs.join(keep, "doc_id", "left_semi")
    return docs
