"""The index stream: tagged lines V N L F S T D H I K R C M E Z that describe fields, documents, terms and items.

A file is one stream; files are read in parallel, each by one task, since its lines refer to those before them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylex.functions import dates, stoplists, text
from quarrylex.operators.index import REGULAR, STOP, Config, Field, Index, forms_of

SCHEMA = "path string, kind string, seq long, name string, value string, number long, extra string, data binary"
OPTIONS = {"stemmingon": ("stemming", True), "stemmingoff": ("stemming", False), "stoptermon": ("stop", True), "stoptermoff": ("stop", False), "termpositionon": ("positions", True), "termpositionoff": ("positions", False)}


class StreamError(ValueError):
    pass


def events(path: str, content: bytes) -> Iterator[tuple]:
    """Rows (path, kind, seq, name, value, number, extra, data) of one stream; seq is the document's number from 1."""
    seq, field_id, language, place, last = 1, 0, None, 0, -1
    seen_terms = 0
    declared = 0
    at, n = 0, len(content)
    while at < n:
        stop = content.find(b"\n", at)
        stop = n if stop < 0 else stop
        line = content[at:stop].decode("utf-8", "replace").rstrip("\r")
        at = stop + 1
        tag, _, rest = line.partition(" ")
        parts = rest.split()
        if not tag or tag.startswith("#"):
            continue
        if tag == "F":
            number = int(parts[1])
            declared += 1
            if number != declared:
                raise StreamError(f"{path}: field numbers must follow each other: {line}")
            yield path, "field", 0, parts[0], " ".join(parts[4:]), number, " ".join(parts[2:4]), None
        elif tag == "S":
            yield path, "default", 0, None, rest.strip(), None, None, None
        elif tag in ("V", "N"):
            yield path, {"V": "version", "N": "name"}[tag], 0, None, rest.strip(), None, None, None
        elif tag == "L":
            language = text_language(parts[0]) if parts else language
            yield path, "language", seq, None, language, None, " ".join(parts[1:]), None
        elif tag == "T":
            word = parts[0]
            field_id = int(parts[1]) if len(parts) > 1 else field_id
            if len(parts) > 2:
                place = int(parts[2])
                if place and place < last:
                    raise StreamError(f"{path}: positions must not fall: {line}")
            else:
                place = last + 1 if last > 0 else 1
            last = place or last
            seen_terms += 1
            yield path, "term", seq, language, word, place, str(field_id), None
        elif tag == "D":
            yield path, "date", seq, None, rest.strip(), None, None, None
        elif tag in ("H", "K"):
            yield path, {"H": "title", "K": "key"}[tag], seq, None, rest.strip(), None, None, None
        elif tag in ("R", "C"):
            yield path, {"R": "rank", "C": "count"}[tag], seq, None, None, int(parts[0]), None, None
        elif tag == "I":
            size = int(parts[2]) if len(parts) > 2 and parts[2].isdigit() else 0
            data = None
            if len(parts) <= 3 and size:  # the bytes follow the line
                data, at = content[at : at + size], at + size + 1
            yield path, "item", seq, parts[0], parts[1] if len(parts) > 1 else None, size, " ".join(parts[3:]), data
        elif tag == "E":
            yield path, "end", seq, None, None, seen_terms, None, None
            seq, last, place, seen_terms = seq + 1, -1, 0, 0
        elif tag == "M":
            yield path, "message", seq, None, rest, None, None, None
        elif tag == "Z":
            return
        else:
            raise StreamError(f"{path}: unknown line {line!r}")


def text_language(code: str) -> str:
    return code.lower().split("-")[0]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(list(events(p, bytes(content))), columns=names).astype({"seq": "int64", "number": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def read_index(spark: SparkSession, path: str, config: Config = Config()) -> Index:
    """The index that streams describe; documents are numbered by file and place."""
    rows = read_events(spark, path)
    head = rows.where("kind in ('field', 'default')").orderBy("path", "number").collect()  # a few lines
    fields: dict[str, Field] = {}
    default: tuple[str, ...] = config.default_fields
    for r in head:
        if r["kind"] == "default":
            default = tuple(r["value"].replace(",", " ").split())
            continue
        how = dict(OPTIONS[o] for o in (r["extra"] or "").replace(",", " ").lower().split() if o in OPTIONS)
        fields.setdefault(r["name"], Field(r["name"], r["name"], description=r["value"] or "", **how))
    files = spark.createDataFrame([(p, k) for k, p in enumerate(sorted({r["path"] for r in rows.select("path").distinct().collect()}))], "path string, file_no long")
    rows = rows.join(F.broadcast(files), "path").withColumn("doc_id", F.col("file_no") * 1_000_000_000 + F.col("seq"))
    first = lambda kind, c="value": F.first(F.when(F.col("kind") == kind, F.col(c)), ignorenulls=True)
    ended = rows.where("kind = 'end'").select("doc_id")
    body = rows.where("seq > 0").join(ended, "doc_id", "left_semi")
    places = F.countDistinct(F.when((F.col("kind") == "term") & (F.col("number") > 0), F.col("number")))
    docs = body.groupBy("doc_id").agg(first("key").alias("doc_key"), first("title").alias("title"), first("language").alias("lang"), first("rank", "number").alias("rank"), F.coalesce(first("count", "number"), places).alias("term_count"), first("date").alias("date"))
    name = F.lit(config.name)
    documents = docs.select(name.alias("index_name"), "doc_id", F.coalesce("doc_key", F.col("doc_id").cast("string")).alias("doc_key"), "title", F.coalesce("lang", F.lit(config.lang)).alias("lang"), F.coalesce("rank", F.lit(0)).cast("bigint").alias("rank"), F.col("term_count").cast("bigint"), F.coalesce(dates.parse(F.col("date")), F.lit(0)).cast("bigint").alias("ansi_date"))
    config = Config(config.name, tuple(fields.values()) or config.fields, default, config.tokenizer, config.stemmer, config.stop_list, config.lang, config.least, config.most, config.case_variants)
    words = body.where("kind = 'term'").select("doc_id", F.col("extra").cast("int").alias("field_id"), F.col("number").cast("int").alias("position"), F.coalesce("name", F.lit(config.lang)).alias("lang"), F.substring("value", 1, config.most).alias("token")).where(F.length("token") >= config.least)
    forms = forms_of(words, config).select("doc_id", "field_id", "position", "term", "in_counts")
    stop = stoplists.is_stop(F.col("term"), config.stop_list)
    terms = forms.groupBy("term").agg(F.count(F.lit(1)).alias("term_count"), F.countDistinct("doc_id").alias("doc_count"), F.sort_array(F.collect_set("field_id")).alias("field_ids"), F.max("in_counts").alias("in_counts")).select(name.alias("index_name"), "term", F.when(stop, STOP).otherwise(REGULAR).alias("term_type"), "term_count", "doc_count", "field_ids", "in_counts")
    postings = forms.where(~stop).select(name.alias("index_name"), "term", "doc_id", "position", "field_id")
    return Index(config, documents, postings, terms)


def write_stream(docs: DataFrame, path: str, column: str = "text", tokenizer: str = "alnum") -> None:
    """Documents (doc_key, title, text) as index streams, one for each task."""
    lines = docs.select("doc_key", F.concat(
        F.array(F.concat(F.lit("H "), F.coalesce("title", F.lit(""))), F.concat(F.lit("K "), F.col("doc_key"))),
        F.transform(text.TOKENIZERS[tokenizer](F.col(column)), lambda w, i: F.concat_ws(" ", F.lit("T"), w, F.lit("1"), (i + 1).cast("string"))), F.array(F.lit("E")),
    ).alias("lines"))
    lines.select(F.array_join("lines", "\n").alias("value")).write.mode("overwrite").text(path)
