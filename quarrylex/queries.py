"""The engine's registered queries: one or more for each operator, over the driver's tables."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylex.api import Engine
from quarrylex.functions import dates, phonetics, stemmers, stoplists, text
from quarrylex.operators import algebra, catalog, expand, feedback, index, logs, results, scoring
from quarrylex.operators.index import Config, Field
from quarrylex.plans.compile import Plan, merged_reports
from quarrylex.plans.parser import parse
from quarrylex.session import shared_folder, ship
from quarrylex.sources import formats, stream, tables
from quarrylex.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PLAIN = Config(name="documents", stemmer="none", stop_list="none")
CLOCK = dt.datetime(1996, 7, 15)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
    return f


def _index(spark: SparkSession, sf_dir: str, config: Config = PLAIN) -> index.Index:
    return index.build(tables.documents(spark, sf_dir), config)


def _engine(indexes: dict[str, index.Index], **how) -> Engine:
    """Most queries here are about other things than the weights of neighbours, which have queries of their own."""
    return Engine(indexes, **{"proximity": False, **how})


def _scored(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"))


def _search(name: str, search: str, config: Config = PLAIN, **how) -> None:
    """Register a search that returns all documents with their scores."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _engine({"documents": _index(spark, sf_dir, config)}, clock=CLOCK, **how)
        return _scored(engine.search("documents", search).scored)

    run.__name__ = name
    query(run)


SEARCHES = {
    "bool_term": "of", "bool_and": "of AND that", "bool_or": "of OR with", "bool_ior": "that IOR with", "bool_xor": "that XOR with", "bool_not": "that NOT with", "nested_boolean": "of AND that OR [and] NOT is", "grouping": "of AND (with OR by)",
    "required_one": "+with OR by", "required_both": "+with OR +by", "adj_phrase": '"of the"', "adj_three": '"of the and"', "adj_distance": "of ADJ[2] the", "near_any": "that NEAR[5] with", "near_plus": "that NEAR[+5] with", "near_minus": "that NEAR[-5] with",
    "and_of_phrases": '"of the" AND with', "term_weight": "of[2.5] OR with[0.5]", "exact_case": "The AND of", "field_query": "text=(of with)",
    "filter_lang": "of {language:en}", "filter_langs": "de {language:fr,es}", "incl_filter": "{inclusion_filter:with by} {inclusion_filter:that} of", "excl_filter": "{exclusion_filter:with,by} of", "freetext": "{search_type:freetext}{bo:or} with and by",
    "wildcard_multi": "ther*", "wildcard_single": "th?", "wildcard_alpha": "a@d", "wildcard_digit": "1%", "regex_term": "regex[^ther.*on$]", "literal_term": "[The]", "range_numeric": "range[1-50]", "range_alpha": "range[thea-theb]", "wildcard_and": "ther* AND with",
}
for _name, _text in SEARCHES.items():
    _search(_name, _text)
for _name in ("none", "basic", "evolved", "sparck72", "croft79", "inquery", "bm25"):
    _search(f"rank_{_name}", "of OR with", ranking=_name)
for _name in ("none", "raw", "log2", "average"):
    _search(f"length_{_name}", "of OR with", length=_name)


# --- analysis -----------------------------------------------------------------------------------------------------------


def _digest(tokens) -> list:
    return [F.size(tokens).cast("bigint").alias("n"), F.md5(F.concat_ws(" ", tokens).cast("binary")).alias("digest")]


@query
def tok_alnum(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", *_digest(text.tokens_alnum(F.col("text"))))


@query
def tok_punct(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", *_digest(text.tokens_punct(F.col("text"))))


@query
def tok_unigram(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", *_digest(text.unigrams(F.col("text"))))


@query
def tok_length(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", *_digest(text.bounded(text.tokens_alnum(F.col("text")), 3, 8)))


@query
def tok_components(spark, sf_dir):
    words = tables.documents(spark, sf_dir).select(F.explode(text.tokens_punct(F.col("text"))).alias("token")).distinct()
    return words.select("token", F.explode(text.components(F.col("token"))).alias("part")).where("part <> token")


def _vocabulary(spark, sf_dir):
    return tables.documents(spark, sf_dir).select(F.explode(text.tokens_alnum(F.col("text"))).alias("token")).distinct()


@query
def case_classes(spark, sf_dir):
    return _vocabulary(spark, sf_dir).groupBy(text.case_class(F.col("token")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("token").alias("first"))


@query
def accents(spark, sf_dir):
    t = F.col("token")
    return _vocabulary(spark, sf_dir).select("token", text.strip_accents(t).alias("bare")).where("bare <> token")


@query
def normalised_text(spark, sf_dir):
    t = tables.documents(spark, sf_dir)
    return t.select("doc_id", F.md5(text.normalise(F.col("text")).cast("binary")).alias("digest"))


def _plural(lang: str) -> None:
    def run(spark, sf_dir):
        low = _vocabulary(spark, sf_dir).select(F.lower("token").alias("term")).distinct()
        return low.select("term", stemmers.plural(F.col("term"), lang).alias("stem")).where("stem <> term")

    run.__name__ = f"stem_plural_{lang}"
    query(run)


for _lang in ("en", "es", "de", "it", "nl", "sv", "no", "da", "pt", "gl", "xx", "fr", "bg"):
    _plural(_lang)


@query
def stem_by_language(spark, sf_dir):
    t = tables.documents(spark, sf_dir).select("lang", F.explode(text.tokens_alnum(F.lower("text"))).alias("term")).distinct()
    return t.select("lang", "term", stemmers.plural(F.col("term"), F.col("lang")).alias("stem")).where("stem <> term")


def _keyed(name, column):
    def run(spark, sf_dir):
        low = _vocabulary(spark, sf_dir).select(F.lower("token").alias("term")).distinct().where(F.col("term").rlike("^[a-z]+$"))
        return low.select("term", column(F.col("term")).alias("key"))

    run.__name__ = name
    query(run)


for _name, _column in (("porter", stemmers.porter_udf), ("lovins", stemmers.lovins_udf), ("soundex_std", phonetics.soundex_native), ("soundex_alt", phonetics.soundex_alternative), ("metaphone", phonetics.metaphone_udf), ("phonix", phonetics.phonix_udf)):
    _keyed(_name, _column)


@query
def typo_expansion(spark, sf_dir):
    return expand.expand(_index(spark, sf_dir).terms, "typo", "ther").select("term", "term_count", "doc_count")


@query
def soundex_expansion(spark, sf_dir):
    return expand.expand(_index(spark, sf_dir).terms, "soundex", "ther").select("term", "term_count", "doc_count")


@query
def stop_flags(spark, sf_dir):
    low = _vocabulary(spark, sf_dir).select(F.lower("token").alias("term")).distinct()
    return low.where(stoplists.is_stop(F.col("term"), "short")).select("term")


# --- index --------------------------------------------------------------------------------------------------------------


@query
def term_stats(spark, sf_dir):
    return _index(spark, sf_dir).vocabulary.where("in_counts").select("term", "term_count", "doc_count")


@query
def case_variants(spark, sf_dir):
    return _index(spark, sf_dir).vocabulary.where("not in_counts").select("term", "term_count", "doc_count")


@query
def stop_handling(spark, sf_dir):
    x = _index(spark, sf_dir, Config(name="documents", stemmer="none", stop_list="short"))
    kept = x.postings.groupBy("term").agg(F.count(F.lit(1)).alias("kept"))
    return x.terms.where("term_type = 2").join(kept, "term", "left").select("term", "term_count", F.coalesce("kept", F.lit(0)).alias("kept"))


@query
def document_lengths(spark, sf_dir):
    return _index(spark, sf_dir).documents.select("doc_id", "term_count", "lang")


@query
def document_numbers(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return index.numbered(docs, "key").select("key", "doc_id")


@query
def key_dictionary(spark, sf_dir):
    t = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_key"), F.col("o_orderkey").alias("doc_id"))
    return index.key_dictionary(t)


@query
def position_faults(spark, sf_dir):
    return index.broken_positions(_index(spark, sf_dir).postings).agg(F.count(F.lit(1)).alias("n"))


@query
def ansi_dates(spark, sf_dir):
    t = tables.table(spark, sf_dir, "orders")
    return t.select("o_orderkey", dates.parse(F.date_format("o_orderdate", "d MMM yyyy")).alias("ansi"), dates.parse(F.date_format("o_orderdate", "yyyy-MM")).alias("month"))


# --- weights, sets ------------------------------------------------------------------------------------------------------


def _weights(op):
    def run(spark, sf_dir):
        x = _index(spark, sf_dir)
        a, b = (x.postings.where(F.col("term") == w).groupBy("doc_id").agg(F.count(F.lit(1)).cast("double").alias("score")) for w in ("that", "with"))
        return algebra.weights(op, a, b)

    run.__name__ = f"weights_{op}"
    query(run)


def _sets(op):
    def run(spark, sf_dir):
        x = _index(spark, sf_dir)
        return algebra.sets(op, *(x.postings.where(F.col("term") == w).select("doc_id") for w in ("that", "with")))

    run.__name__ = f"set_{op}"
    query(run)


for _op in ("or", "and", "xor", "not"):
    _weights(_op)
    _sets(_op)


@query
def relaxed_and(spark, sf_dir):
    """An AND of which one side matches nothing gives the other side's documents."""
    engine = _engine({"documents": _index(spark, sf_dir)})
    return _scored(engine.search("documents", "{boolean_operation:relaxed} zzzznowhere AND with").scored)


@query
def strict_and(spark, sf_dir):
    return _scored(_engine({"documents": _index(spark, sf_dir)}).search("documents", "zzzznowhere AND with").scored)


@query
def stop_phrase(spark, sf_dir):
    """A stop word inside a phrase widens the distance by one."""
    engine = _engine({"documents": _index(spark, sf_dir, Config(name="documents", stemmer="none", stop_list=frozenset({"the"})))})
    return engine.search("documents", '"of the and"').scored.select("doc_id")


@query
def proximity_weight(spark, sf_dir):
    x = _index(spark, sf_dir)
    rows = x.postings.where(F.col("term").isin("that", "with")).select("doc_id", "position", F.lit(1.0).alias("weight"))
    return _scored(scoring.document_scores(scoring.proximity(rows)))


@query
def co_occurrence(spark, sf_dir):
    x = _index(spark, sf_dir)
    a, b = (x.postings.where(F.col("term") == w).groupBy("doc_id").agg(F.count(F.lit(1)).cast("double").alias("score")) for w in ("that", "with"))
    return _scored(scoring.co_occurrence(a, b))


@query
def frequent_demotion(spark, sf_dir):
    x = _index(spark, sf_dir)
    return scoring.frequent(x.terms.where("in_counts"), x.n_docs, 100.0).where("frequent").select("term", "term_count")


@query
def max_sort_key(spark, sf_dir):
    scored = _engine({"documents": _index(spark, sf_dir)}).search("documents", "that OR with").scored
    return scoring.relative_to_best(scored).select("doc_id", F.round("relative", 6).alias("relative"))


# --- order and pages ----------------------------------------------------------------------------------------------------


@query
def topk_relevance(spark, sf_dir):
    return _scored(_engine({"documents": _index(spark, sf_dir)}).search("documents", "that OR with", end=9).page)


@query
def splice_page(spark, sf_dir):
    return _scored(_engine({"documents": _index(spark, sf_dir)}).search("documents", "that OR with", start=10, end=24).page)


def _orders(spark, sf_dir):
    return index.build(tables.orders(spark, sf_dir), Config(name="orders", stemmer="none", stop_list="none"))


@query
def sort_date(spark, sf_dir):
    r = _engine({"orders": _orders(spark, sf_dir)}).search("orders", "urgent {sort:date:asc}", end=49)
    return r.page.select("doc_id", F.col("sort_key").cast("bigint").alias("ansi_date"))


@query
def sort_rank(spark, sf_dir):
    r = _engine({"orders": _orders(spark, sf_dir)}).search("orders", "high {sort:rank:desc}", end=49)
    return r.page.select("doc_id", F.col("sort_key").cast("bigint").alias("rank"))


@query
def sort_item(spark, sf_dir):
    x = index.build(tables.parts(spark, sf_dir), Config(name="part", fields=(Field("kind", "kind"), Field("size", "size")), stemmer="none", stop_list="none"))
    r = _engine({"part": x}, kinds={"size": "int"}).search("part", "kind=promo {sort:size:desc}", end=49)
    return r.page.select("doc_id", F.col("sort_key").cast("bigint").alias("size"))


@query
def sort_none(spark, sf_dir):
    return _scored(_engine({"documents": _index(spark, sf_dir)}).search("documents", "that {sort:none}").page)


@query
def filter_date(spark, sf_dir):
    r = _engine({"orders": _orders(spark, sf_dir)}, clock=CLOCK).search("orders", "{date>=1996,<=19970630} urgent")
    return r.scored.select("doc_id")


@query
def filter_date_name(spark, sf_dir):
    r = _engine({"orders": _orders(spark, sf_dir)}, clock=CLOCK).search("orders", "{date=thisyear} urgent")
    return r.scored.select("doc_id")


@query
def restriction_only(spark, sf_dir):
    return _engine({"documents": _index(spark, sf_dir)}).search("documents", "{language:fr}{exclusion_filter:le,la}").scored.select("doc_id")


@query
def list_filter(spark, sf_dir):
    """Documents of the labelled ids, as a list table: a semi join."""
    x = _index(spark, sf_dir)
    marked = tables.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return _engine({"documents": x}).search("documents", "with").scored.join(marked, "doc_id", "left_semi").select("doc_id")


@query
def multi_field(spark, sf_dir):
    x = index.build(tables.parts(spark, sf_dir), Config(name="part", fields=(Field("brand", "brand"), Field("kind", "kind")), stemmer="none", stop_list="none"))
    return _engine({"part": x}).search("part", "kind=medium AND brand:13").scored.select("doc_id")


# --- feedback, key terms ------------------------------------------------------------------------------------------------


def _item(spark, sf_dir) -> str:
    return tables.table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]


@query
def feedback_pos(spark, sf_dir):
    x = _index(spark, sf_dir)
    return _scored(_engine({"documents": x}, length="none").search("documents", like=_item(spark, sf_dir)).scored)


@query
def feedback_neg(spark, sf_dir):
    x = _index(spark, sf_dir)
    return _scored(_engine({"documents": x}, length="none").search("documents", "with", unlike=_item(spark, sf_dir)).scored)


@query
def feedback_mixed(spark, sf_dir):
    x = _index(spark, sf_dir)
    return _scored(_engine({"documents": x}).search("documents", "that OR with", like=_item(spark, sf_dir)).scored)


@query
def key_terms(spark, sf_dir):
    x = _index(spark, sf_dir)
    items = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("key"), "text")
    return feedback.key_terms(x, items, coverage=50.0, by="doc_count").select("key", "rank", "term", "tf", F.round("weight", 6).alias("weight"))


@query
def key_phrases(spark, sf_dir):
    x = _index(spark, sf_dir)
    items = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("key"), F.regexp_replace("text", r"[.,]\s*", "\t").alias("text"))
    return feedback.key_phrases(x, items, coverage=100_000.0).select("key", "rank", "phrase", "n", F.round("weight", 6).alias("weight"))


# --- several indexes ----------------------------------------------------------------------------------------------------


def _both(spark, sf_dir):
    return {"documents": _index(spark, sf_dir), "talks": index.build(tables.conversations(spark, sf_dir), Config(name="talks", stemmer="none", stop_list="none"))}


@query
def virtual_local_idf(spark, sf_dir):
    r = _engine(_both(spark, sf_dir), virtual={"all": ["[.*]"]}).search("all", "that OR with")
    return r.scored.select("index_name", "doc_id", F.round("score", 6).alias("score"))


@query
def virtual_global_idf(spark, sf_dir):
    r = _engine(_both(spark, sf_dir), virtual={"all": ["documents", "talks"]}, global_idf=True).search("all", "that OR with")
    return r.scored.select("index_name", "doc_id", F.round("score", 6).alias("score"))


@query
def search_report(spark, sf_dir):
    x = _index(spark, sf_dir, Config(name="documents", stemmer="none", stop_list="short"))
    return Plan(x, parse("the AND that AND zzzznowhere")).report().select("term", "term_count", "doc_count", "status")


@query
def merged_report(spark, sf_dir):
    q = parse("that OR with")
    return merged_reports([Plan(x, q).report() for x in _both(spark, sf_dir).values()]).select("term", "term_count", "doc_count")


# --- information, retrieval, forms --------------------------------------------------------------------------------------


@query
def index_info(spark, sf_dir):
    return _index(spark, sf_dir).info.select("index_name", "n_docs", "unique_terms", "total_terms")


@query
def field_info(spark, sf_dir):
    return _index(spark, sf_dir).fields.select("field_id", "name", "stemming", "stop_term", "term_position")


@query
def term_info(spark, sf_dir):
    return catalog.term_info(_index(spark, sf_dir), "wildcard", "there*")


@query
def doc_info(spark, sf_dir):
    return catalog.document_info(_index(spark, sf_dir), "17").select("doc_id", "doc_key", "lang", "term_count")


@query
def retrieve_bytes(spark, sf_dir):
    return catalog.retrieve(_index(spark, sf_dir), "17", "text", 10, 59, unit="characters").select("doc_key", "chunk")


@query
def length_histogram(spark, sf_dir):
    return catalog.length_histogram(_index(spark, sf_dir, Config(name="documents", stemmer="none", stop_list="none", case_variants=False))).select(F.col("length").cast("bigint").alias("length"), "terms", "occurrences")


@query
def index_verify(spark, sf_dir):
    return catalog.statistics(_index(spark, sf_dir))


def _page(spark, sf_dir):
    r = _engine({"documents": _index(spark, sf_dir)}).search("documents", "that OR with", end=9)
    return r.page.select("doc_id", F.round("score", 6).alias("score"))


@query
def results_json(spark, sf_dir):
    return results.as_json(_page(spark, sf_dir).select("doc_id"))


@query
def results_xml(spark, sf_dir):
    return results.as_xml(_page(spark, sf_dir).select("doc_id"))


@query
def results_notation(spark, sf_dir):
    return results.as_notation(_page(spark, sf_dir).select("doc_id"))


@query
def results_run(spark, sf_dir):
    return results.as_run(_engine({"documents": _index(spark, sf_dir)}).search("documents", "that OR with", end=9).page, "1")


# --- logs (events stand for log lines) ----------------------------------------------------------------------------------


def _events(spark, sf_dir):
    return tables.table(spark, sf_dir, "events")


@query
def log_counters(spark, sf_dir):
    return logs.counters(_events(spark, sf_dir), "event_type")


@query
def log_clients(spark, sf_dir):
    return logs.by_client(_events(spark, sf_dir), "user_id", F.col("event_type") == "error")


@query
def log_times(spark, sf_dir):
    t = logs.times(_events(spark, sf_dir), "value", "event_type")
    return t.select("event_type", "least", "most", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query
def log_hourly(spark, sf_dir):
    return logs.per_period(_events(spark, sf_dir), "hour").select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n")


@query
def log_daily(spark, sf_dir):
    return logs.per_period(_events(spark, sf_dir), "day").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query
def log_concurrency(spark, sf_dir):
    e = _events(spark, sf_dir)
    ts = F.col("ts").cast("timestamp")
    sessions = e.select(ts.alias("start"), F.timestamp_micros(F.unix_micros(ts) + F.floor(F.col("value") * 60).cast("bigint") * 1_000_000).alias("stop"))
    return logs.concurrency(sessions, "hour").select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "most")


@query
def log_slow(spark, sf_dir):
    return logs.slow(_events(spark, sf_dir), 60.0, "value").select("event_id", "value")


@query
def log_top(spark, sf_dir):
    return logs.top(_events(spark, sf_dir), 10, F.col("user_id"))


@query
def log_frequency(spark, sf_dir):
    return logs.frequency(_events(spark, sf_dir), F.col("user_id"))


@query
def log_window(spark, sf_dir):
    t = ingest.windowed(_events(spark, sf_dir))
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# --- sources: the items, written in each format and read again ------------------------------------------------------------


def _written(spark, sf_dir) -> tuple[DataFrame, str]:
    items = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc_key"), F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("title"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    return items, f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"


#: What a document looks like in each format, and the column or field that has its text.
RECORDS = {
    "para": ("<key>\n<text>\n", "text"), "mbox": ("From a@b Mon Oct 11 2004\nMessage-ID: <key>\nSubject: <title>\n\n<text>\n", "body"), "refer": ("%T <title>\n%L <key>\n%X <text>\n", "abstract"),
    "tagged-text": ("title: <title>\nkey: <key>\ntext: <text>\n---", "text"), "tagged-xml": ("<document><title><title></title><key><key></key><text><![CDATA[<text>]]></text></document>", "text"),
    "feed": ("Title: <title>\nKey: <key>\nDescription: <text>\n", "description"), "medline": ("UI  - <key>\nTI  - <title>\nAB  - <text>\n", "AB"), "omim": ("*RECORD*\n*FIELD* NO\n<key>\n*FIELD* TI\n<title>\n*FIELD* TX\n<text>", "TX"),
    "trec": ("<DOC>\n<DOCNO><key></DOCNO>\n<HEADLINE><title></HEADLINE>\n<TEXT>\n<text>\n</TEXT>\n</DOC>", None),
}


def _record(form: str):
    """The record as a Column: in XML only the innermost marks stand for values."""
    record, out, at = RECORDS[form][0], [], 0
    marks = {"<key>": "doc_key", "<title>": "title", "<text>": "text"}
    for m in re.finditer(r"(?<=<key>)<key>|(?<=<title>)<title>|(?<=CDATA\[)<text>" if form == "tagged-xml" else r"<key>|<title>|<text>", record):
        out += [F.lit(record[at : m.start()]), F.col(marks[m[0]])]
        at = m.end()
    return F.concat(*out, F.lit(record[at:]))


def _source(form: str) -> None:
    def run(spark, sf_dir):
        items, path = _written(spark, sf_dir)
        items.select(_record(form).alias("value")).write.text(path)
        docs = formats.read(spark, form, path)
        name = RECORDS[form][1]
        body = F.col("text") if name is None else F.col("fields")[name]
        key = F.col("title") if form == "para" else F.col("doc_key")
        return docs.select(key.alias("key"), F.md5(F.trim(F.regexp_replace(body, r"\s+", " ")).cast("binary")).alias("digest"))

    run.__name__ = f"source_{form.replace('-', '_')}"
    query(run)


for _name in RECORDS:
    _source(_name)


@query
def source_index_stream(spark, sf_dir):
    """Terms of the index that streams of the items describe."""
    items, path = _written(spark, sf_dir)
    stream.write_stream(items, path)
    x = stream.read_index(spark, path, Config(name="items", stemmer="none", stop_list="none", case_variants=False))
    return x.terms.select("term", "term_count", "doc_count")


# --- neighbours, default analysis, counters, list files, stored indexes -----------------------------------------------------


def _neighbours(name: str, search: str, log: bool) -> None:
    """Searches with the weights of neighbours; those of AND can be huge, so their logarithms are compared."""

    def run(spark, sf_dir):
        scored = Engine({"documents": _index(spark, sf_dir)}).search("documents", search).scored
        return scored.select("doc_id", F.round(F.log("score"), 6).alias("log_score")) if log else _scored(scored)

    run.__name__ = name
    query(run)


for _name, _text, _log in (("prox_or", "that OR with", False), ("prox_three", "of OR the OR and", False), ("prox_and", "of AND the", True), ("prox_mixed", "(of AND the) OR with", True)):
    _neighbours(_name, _text, _log)


@query
def stemmed_index(spark, sf_dir):
    """Terms of an index whose words are stemmed by their documents' languages."""
    return _index(spark, sf_dir, Config(name="documents", stop_list="none")).terms.where("in_counts").select("term", "term_count", "doc_count")


@query
def default_analysis(spark, sf_dir):
    """Plural stemming and the long stop list, at index and query time."""
    return _scored(_engine({"documents": _index(spark, sf_dir, Config(name="documents"))}).search("documents", "ands AND thes OR hers").scored)


@query
def report_counters(spark, sf_dir):
    return _engine({"documents": _index(spark, sf_dir)}).counters("documents", "of {language:en,fr}{inclusion_filter:with}{exclusion_filter:by}")


@query
def list_filter_file(spark, sf_dir):
    """An inclusion list read from a text file."""
    path = f"{shared_folder(spark)}/list-{uuid.uuid4().hex}"
    words = tables.table(spark, sf_dir, "benchmark").where("item_id % 5 = 0").select(F.explode(text.tokens_alnum(F.lower("text"))).alias("value")).where("length(value) > 9").distinct()
    words.write.text(path)
    return _engine({"documents": _index(spark, sf_dir)}, lists={"long_words": path}).search("documents", "of {inclusion_list_filter:long_words}").scored.select("doc_id")


@query
def field_filter(spark, sf_dir):
    """Filter terms with a field, and with a wildcard."""
    x = index.build(tables.parts(spark, sf_dir), Config(name="part", fields=(Field("brand", "brand"), Field("kind", "kind")), stemmer="none", stop_list="none"))
    return _engine({"part": x}).search("part", "{inclusion_filter:kind=promo,kind=med*}{exclusion_filter:brand=13} brand").scored.select("doc_id")


@query
def stop_fielded(spark, sf_dir):
    """A stop word is found in the field that keeps stop words."""
    docs = tables.documents(spark, sf_dir).withColumn("copy", F.col("text"))
    x = index.build(docs, Config(name="documents", fields=(Field("text", "text"), Field("copy", "copy", stop=False)), stemmer="none", stop_list="short"))
    return x.postings.where("term = 'the'").groupBy("field_id").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("n"))


@query
def terms_stop(spark, sf_dir):
    return catalog.term_info(_index(spark, sf_dir, Config(name="documents", stemmer="none", stop_list="short")), "stop")


@query
def terms_regular(spark, sf_dir):
    return catalog.term_info(_index(spark, sf_dir, Config(name="documents", stemmer="none", stop_list="short")), "regular")


@query
def term_comparison(spark, sf_dir):
    t = _index(spark, sf_dir).vocabulary
    both = t.where(expand.comparison(F.col("term"), ">=", "1900") | expand.comparison(F.col("term"), "<", "abc"))
    return both.select("term", "term_count", "doc_count")


@query
def server_info(spark, sf_dir):
    return catalog.server_info(spark, "documents", "nobody").select("name", "administrator")


@query
def index_list(spark, sf_dir):
    return _engine(_both(spark, sf_dir), virtual={"all": ["[.*]"]}).index_info("all").select("index_name", "n_docs", "unique_terms")


@query
def stored_index(spark, sf_dir):
    """Postings of an index that was stored twice and read again."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    docs = tables.documents(spark, sf_dir)
    index.build(docs.limit(3), PLAIN).write(path, buckets=4)
    x = index.build(docs, PLAIN, once=True).write(path, buckets=4)
    return x.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("places"), F.max("doc_id").alias("last"))


# --- log lines ------------------------------------------------------------------------------------------------------------


def _log(spark, sf_dir) -> DataFrame:
    """Log lines made of the events, read again."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    e = _events(spark, sf_dir)
    when = F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss")
    names = F.concat(F.col("event_type"), F.lit(","), F.lit("all"))
    line = F.format_string("%d: %d: %s +0000: INFO: Search, index: '%s', search: 'Word%d  of {language:en}', found: %d documents and returned: 10, in: %.4f seconds.", F.col("event_id"), F.col("user_id"), when, names, F.col("user_id"), F.col("user_id") + 7, F.abs("value"))
    bad = F.format_string("%d: %s +0000: ERROR: Search failed, index: '%s', search: 'x'", F.col("event_id"), when, F.col("event_type"))
    e.select(F.when(F.col("event_type") == "error", bad).otherwise(line).alias("value")).write.text(path)
    return logs.read(spark, path)


@query
def log_parsed(spark, sf_dir):
    got = _log(spark, sf_dir)
    return got.select("process", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "level", "kind", F.concat_ws("+", "indexes").alias("indexes"), "search", F.coalesce("found", F.lit(-1)).alias("found"), F.coalesce(F.round("seconds", 4), F.lit(-1.0)).alias("seconds"))


@query
def log_by_index(spark, sf_dir):
    return logs.by_index(_log(spark, sf_dir))


@query
def log_searches(spark, sf_dir):
    return logs.top(_log(spark, sf_dir).where("kind = 'search'"), 10)


@query
def log_script(spark, sf_dir):
    return logs.script(_log(spark, sf_dir).where("kind = 'search'"))


# --- sources with a file for each document ----------------------------------------------------------------------------------


def _single_files(spark, sf_dir) -> tuple[DataFrame, str]:
    """A folder for each item with one file: a title line, then the item's words in lines of two."""
    items, path = _written(spark, sf_dir)
    words = text.tokens_alnum(F.col("text"))
    lines = F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(2)), lambda i: F.concat_ws(" ", F.slice("w", i, 2)))
    rows = items.select("doc_key", "title", words.alias("w")).where("size(w) > 0").select("doc_key", F.concat_ws("\n", F.array("title"), lines).alias("value"))
    rows.write.partitionBy("doc_key").text(path)
    return items, path


@query
def source_text(spark, sf_dir):
    _, path = _single_files(spark, sf_dir)
    docs = formats.read(spark, "text", path, recurse=True)
    return docs.select(F.regexp_extract("doc_key", r"doc_key=(\d+)", 1).alias("key"), "title", F.md5(F.regexp_replace(F.col("fields")["text"], r"\s+$", "").cast("binary")).alias("digest"))


@query
def source_line(spark, sf_dir):
    """Each line is one term, blanks included."""
    _, path = _single_files(spark, sf_dir)
    docs = formats.read(spark, "line", path, recurse=True).select(F.regexp_extract("doc_key", r"doc_key=(\d+)", 1).cast("bigint").alias("doc_id"), "text")
    x = index.build(docs, Config(name="lines", tokenizer="lines", stemmer="none", stop_list="none", case_variants=False))
    return x.terms.select("term", "term_count", "doc_count")


@query
def source_selected(spark, sf_dir):
    """Files chosen by a pattern of names, some left out by a pattern of paths."""
    _, path = _single_files(spark, sf_dir)
    docs = formats.read(spark, "text", path, recurse=True, include="*.txt", exclude=r"doc_key=\d*[13579]/")
    return docs.select(F.regexp_extract("doc_key", r"doc_key=(\d+)", 1).alias("key"))


# --- characters, caps, orders of several indexes ----------------------------------------------------------------------------


@query
def first_classes(spark, sf_dir):
    """Classes of first characters, of which an expansion takes one only."""
    return _vocabulary(spark, sf_dir).groupBy(text.first_class(F.col("token")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def charset_recoded(spark, sf_dir):
    t = tables.documents(spark, sf_dir).where(~F.col("text").rlike(r"[^\x00-\xFF]"))
    return t.select("doc_id", F.md5(text.recode(F.encode("text", "ISO-8859-1"), "ISO-8859-1").cast("binary")).alias("digest"))


@query
def utf8_cleaned(spark, sf_dir):
    """Bytes that are no UTF-8, put after the texts, become a space."""
    broken = F.concat(F.col("text").cast("binary"), F.lit(b"\xff").cast("binary"))
    return tables.documents(spark, sf_dir).select("doc_id", F.md5(text.clean_utf8(broken).cast("binary")).alias("digest"))


@query
def stripped_tokens(spark, sf_dir):
    words = tables.documents(spark, sf_dir).select(F.explode(F.split("text", r"\s+")).alias("token")).distinct()
    return words.select("token", text.strip_trailing(F.col("token")).alias("bare")).where("bare <> token")


@query
def capped_page(spark, sf_dir):
    """A cap on documents, whatever end a page asks for."""
    return _scored(_engine({"documents": _index(spark, sf_dir)}, most=5).search("documents", "that OR with", end=99).page)


@query
def federated_page(spark, sf_dir):
    """The best documents of two indexes in one order."""
    r = _engine(_both(spark, sf_dir), virtual={"all": ["[.*]"]}).search("all", "that OR with", end=19)
    return r.page.select("index_name", "doc_id", F.round("score", 6).alias("score"))
