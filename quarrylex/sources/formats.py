"""Document formats: each reads files and gives (path, seq, doc_key, title, ansi_date, fields map<string,string>, text).

Files are read whole and split by expressions, so that the work of many files is spread over the cluster; a single file that
is larger than memory should be split beforehand, or be in a line format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylex.functions import dates


def files(spark: SparkSession, path: str | list[str], whole: bool = True, recurse: bool = False, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(path, value) of whole files or of lines. include and exclude are a glob of names and a regular expression of paths."""
    reader = spark.read.option("recursiveFileLookup", recurse)
    if include:
        reader = reader.option("pathGlobFilter", include)
    df = reader.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    return df.where(~F.col("path").rlike(exclude)) if exclude else df


def _documents(rows: DataFrame, key: Column, title: Column, date: Column | None, fields: Column, text: Column) -> DataFrame:
    return rows.select("path", "seq", F.coalesce(key, F.concat_ws("#", "path", F.col("seq").cast("string"))).alias("doc_key"), title.alias("title"), (F.coalesce(dates.parse(date), F.lit(0)) if date is not None else F.lit(0)).cast("bigint").alias("ansi_date"), fields.alias("fields"), text.alias("text"))


def _split(df: DataFrame, pattern: str) -> DataFrame:
    """A row for each non-blank part of a file, numbered from 0."""
    parts = F.filter(F.split("value", pattern), lambda p: p.rlike(r"\S"))
    return df.select("path", F.posexplode(parts).alias("seq", "value"))


def _first_line(v: Column) -> Column:
    return F.trim(F.regexp_extract(v, r"^\s*([^\n]*)", 1))


def _rest(v: Column) -> Column:
    return F.regexp_replace(v, r"^\s*[^\n]*\n?", "")


def _field(v: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(v, pattern, 1)), F.lit(""))


def _pairs(v: Column, pattern: str) -> Column:
    """map of names to their values, several values of a name joined by a line end; pattern has two groups."""
    names, values = F.regexp_extract_all(v, F.lit(pattern), F.lit(1)), F.regexp_extract_all(v, F.lit(pattern), F.lit(2))
    rows = F.zip_with(names, values, lambda a, b: F.struct(F.trim(a).alias("k"), F.trim(F.regexp_replace(b, r"\n[ \t]*", " ")).alias("v")))
    keys = F.array_distinct(F.transform(rows, lambda r: r["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_join(F.transform(F.filter(rows, lambda r: r["k"] == k), lambda r: r["v"]), "\n")))


def _none() -> Column:
    return F.lit(None).cast("string")


def read_text(spark: SparkSession, path, **how) -> DataFrame:
    """One document a file, its first line the title."""
    rows = files(spark, path, **how).withColumn("seq", F.lit(0))
    v = F.col("value")
    return _documents(rows, F.col("path"), _first_line(v), None, F.create_map(F.lit("title"), _first_line(v), F.lit("text"), _rest(v)), v)


def read_para(spark: SparkSession, path, **how) -> DataFrame:
    """One document a paragraph; paragraphs end at blank lines."""
    rows = _split(files(spark, path, **how), r"\n[ \t]*\n")
    v = F.col("value")
    return _documents(rows, _none(), _first_line(v), None, F.create_map(F.lit("title"), _first_line(v), F.lit("text"), _rest(v)), F.trim(v))


def read_line(spark: SparkSession, path, **how) -> DataFrame:
    """One document a file: a title line, then a term on each line, blanks included: to be indexed with the tokenizer "lines"."""
    rows = files(spark, path, **how).withColumn("seq", F.lit(0))
    v = F.col("value")
    return _documents(rows, F.col("path"), _first_line(v), None, F.create_map(F.lit("title"), _first_line(v), F.lit("text"), _rest(v)), _rest(v))


def read_mbox(spark: SparkSession, path, **how) -> DataFrame:
    """Mail folders: a message starts at a line "From "; headers end at a blank line and may be folded."""
    rows = _split(files(spark, path, **how), r"(?m)^From .*$")
    v = F.regexp_replace("value", r"^\n+", "")
    head, body = F.regexp_extract(v, r"(?s)^(.*?)(?:\n\n|\z)", 1), F.regexp_extract(v, r"(?s)\n\n(.*)$", 1)
    got = lambda n: _field(F.regexp_replace(head, r"\n[ \t]+", " "), rf"(?im)^{n}:[ \t]*(.*)$")
    names = ("subject", "from", "to", "date")
    fields = F.create_map(*[x for n in names for x in (F.lit(n), got(n))], F.lit("body"), F.regexp_replace(body, r"(?m)^>From ", "From "))
    return _documents(rows, got("message-id"), got("subject"), F.regexp_replace(got("date"), r" *\([^)]*\)$", ""), fields, body)


# Field names of the record letters.
REFER = {
    "A": "author", "B": "book", "C": "city", "D": "date", "E": "editor", "F": "footnote", "G": "govt", "H": "commentary", "I": "publisher", "J": "journal", "K": "keyword", "L": "label", "M": "bell", "N": "issue", "O": "other", "P": "page",
    "Q": "corporate", "R": "report", "S": "series", "T": "title", "U": "annotation", "V": "volume", "W": "undefined", "X": "abstract", "Y": "toc", "Z": "reference",
}


def read_refer(spark: SparkSession, path, **how) -> DataFrame:
    """Bibliographic records: %X value lines, records apart by blank lines."""
    rows = _split(files(spark, path, **how), r"\n[ \t]*\n")
    v = F.concat(F.lit("\n"), F.col("value"))
    raw = _pairs(v, r"\n%([A-Z])[ \t]+([^\n]*(?:\n(?!%)[^\n]*)*)")
    names = F.create_map(*[F.lit(x) for kv in REFER.items() for x in kv])
    fields = F.transform_keys(raw, lambda k, _: F.coalesce(names[k], k))
    return _documents(rows, raw["L"], raw["T"], raw["D"], fields, F.array_join(F.map_values(raw), "\n"))


def read_tagged_text(spark: SparkSession, path, **how) -> DataFrame:
    """Tagged text: lines "title: ", "url: ", "date: ", "key: ", "language: " and then text, documents apart by form feeds or ---."""
    rows = _split(files(spark, path, **how), r"(?m)^(?:\f|---+)[ \t]*$")
    v = F.concat(F.lit("\n"), F.col("value"))
    raw = F.transform_keys(_pairs(v, r"\n(?i)(title|url|date|key|rank|language|text):[ \t]*([^\n]*(?:\n(?!(?:title|url|date|key|rank|language|text):)[^\n]*)*)"), lambda k, _: F.lower(k))
    return _documents(rows, raw["key"], raw["title"], raw["date"], raw, F.coalesce(raw["text"], F.col("value")))


def read_tagged_xml(spark: SparkSession, path, **how) -> DataFrame:
    """The same as elements of <document>."""
    rows = files(spark, path, **how).select("path", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<document\b[^>]*>(.*?)</document>"), F.lit(1))).alias("seq", "value"))
    v = F.col("value")
    raw = F.transform_values(_pairs(v, r"(?s)<(\w+)[^>]*>(.*?)</\1>"), lambda _, x: _unescaped(x))
    return _documents(rows, raw["key"], raw["title"], raw["date"], raw, raw["text"])


def _unescaped(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def read_feed(spark: SparkSession, path, **how) -> DataFrame:
    """Feed items: blocks of "name: value" lines, of which an empty line ends one; values may run over indented lines."""
    rows = _split(files(spark, path, **how), r"\n[ \t]*\n")
    v = F.concat(F.lit("\n"), F.col("value"))
    raw = F.transform_keys(_pairs(v, r"\n([A-Za-z][\w-]*):[ \t]*([^\n]*(?:\n[ \t]+[^\n]*)*)"), lambda k, _: F.lower(F.replace(k, F.lit("-"), F.lit("_"))))
    key = F.coalesce(raw["key"], raw["item_url"], raw["url"])
    return _documents(rows, key, raw["title"], raw["date"], raw, F.concat_ws("\n", raw["title"], raw["description"], raw["content"]))


def read_medline(spark: SparkSession, path, **how) -> DataFrame:
    """Citations: four-character tags, "- ", and indented continuations."""
    rows = _split(files(spark, path, **how), r"\n[ \t]*\n")
    v = F.concat(F.lit("\n"), F.col("value"))
    raw = _pairs(v, r"\n([A-Z]{2,4}) *- ([^\n]*(?:\n {2,}[^\n]*)*)")
    return _documents(rows, F.coalesce(raw["UI"], raw["PMID"]), raw["TI"], F.coalesce(raw["DA"], raw["DP"]), raw, F.concat_ws("\n", raw["TI"], raw["AB"]))


def read_omim(spark: SparkSession, path, **how) -> DataFrame:
    """Records *RECORD* with parts *FIELD* XX."""
    rows = _split(files(spark, path, **how), r"(?m)^\*RECORD\*[ \t]*$|^\*THEEND\*[ \t]*$")
    raw = _pairs(F.concat(F.lit("\n"), F.col("value")), r"\n\*FIELD\* (\w+)[ \t]*\n([^\n]*(?:\n(?!\*)[^\n]*)*)")
    return _documents(rows, raw["NO"], raw["TI"], None, raw, F.concat_ws("\n", raw["TI"], raw["TX"]))


def read_trec(spark: SparkSession, path, **how) -> DataFrame:
    """<DOC> elements with <DOCNO>; headlines from HL, HEADLINE, TI or TITLE."""
    rows = files(spark, path, **how).select("path", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<DOC>(.*?)</DOC>"), F.lit(1))).alias("seq", "value"))
    v = F.col("value")
    got = lambda n: _field(v, rf"(?s)<{n}>(.*?)</{n}>")
    title = F.coalesce(*[got(n) for n in ("HL", "HEADLINE", "TI", "TITLE")])
    body = F.trim(F.regexp_replace(F.array_join(F.regexp_extract_all(v, F.lit(r"(?s)<TEXT>(.*?)</TEXT>"), F.lit(1)), "\n"), r"<[^>]+>", " "))
    return _documents(rows, got("DOCNO"), title, F.coalesce(got("DATE"), got("DD")), _pairs(v, r"(?s)<([A-Z][A-Z0-9]*)>([^<]*)</\1>"), body)


FORMATS: dict[str, Callable[..., DataFrame]] = {
    "text": read_text, "para": read_para, "line": read_line, "mbox": read_mbox, "refer": read_refer, "tagged-text": read_tagged_text, "tagged-xml": read_tagged_xml, "feed": read_feed, "medline": read_medline, "omim": read_omim, "trec": read_trec,
}


def read(spark: SparkSession, form: str, path, most: int | None = None, autokey: bool = False, associate: tuple[str, str] | None = None, **how) -> DataFrame:
    """most: cap on documents; autokey: running keys instead of the format's; associate: (item, extension) of files beside the documents' own."""
    docs = FORMATS[form](spark, path, **how)
    if autokey:
        docs = docs.withColumn("doc_key", F.monotonically_increasing_id().cast("string"))
    if associate:
        item, extension = associate
        other = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", True).load(path)
        stem = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), r"\.[^./]*$", "")
        other = other.select(stem(F.col("path")).alias("stem"), F.col("content").alias(item))
        docs = docs.withColumn("stem", stem(F.col("path"))).join(other, "stem", "left").drop("stem")
    return docs.limit(most) if most is not None else docs
