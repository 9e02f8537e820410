"""What keeps searches and stored indexes within bounds on large tables."""

import pytest
from pyspark.sql import functions as F

from quarrylex.api import Engine
from quarrylex.functions import text
from quarrylex.operators import catalog, expand, index
from quarrylex.operators.index import Config, Field
from quarrylex.queries import QUERIES

PLAIN = Config(name="documents", stemmer="none", stop_list="none")
TEXTS = ["Of the and of THE ands", "with a theory of cities", "That theme, with the Ponies and Boats", "İstanbul of 𝐀 ÉTÉ", "", "..."]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, ("en", "en-gb", "fr", None)[k % 4], "s") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")


def test_index_list_counts_ids_that_have_words_once(spark, docs, tmp_path):
    """Turns from 1,000 on have the ids of the next conversation's."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    talks = spark.createDataFrame([(0, 1000, "user", "x y"), (1, 0, "user", "Z x"), (2, 0, "user", "...")], "conv_id long, turn long, role string, text string")
    talks.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["index_name"]: (r["n_docs"], r["unique_terms"]) for r in QUERIES["index_list"](spark, str(tmp_path)).collect()}
    assert got["talks"] == (1, 3) and got["documents"][0] == 4


def _cuts(df) -> int:
    """How often texts are cut into words by a plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


@pytest.mark.parametrize("search", ["of IOR with", '"of the and"', "th* AND with", "range[thea-thez]", "+with OR of", "{inclusion_filter:with,b*}{exclusion_filter:zz} of"])
def test_a_search_cuts_texts_once(docs, search):
    """What is left of the texts in the plan of a search is its words' rows, and they give what the whole index gives."""
    x = index.build(docs, PLAIN)
    whole = index.Index(x.config, x.documents, x.postings, x.terms)  # never narrowed
    one, other = (Engine({"d": y}, length="none", proximity=False).search("d", search).scored for y in (x, whole))
    assert _cuts(one) == 0 < _cuts(other)
    assert sorted(one.collect()) == sorted(other.collect())


@pytest.mark.parametrize(("search", "how"), [("the OR with", "log"), ('"of the"', "average"), ("{inclusion_filter:with} th? AND of", "raw")])
def test_lengths_are_found_with_the_words(spark, docs, search, how):
    """Scores by length need no second cut of the texts; ids that occur twice, null texts and lengths that are given keep their results."""
    rows = docs.unionByName(spark.createDataFrame([(0, "the of and with theme", "en", "s"), (90, None, "en", "s")], docs.schema))
    given = rows.withColumn("term_count", F.when(F.col("doc_id") < 2, F.col("doc_id") + 3))
    two = Config(name="d", fields=(Field("text", "text"), Field("source", "source")), stemmer="none", stop_list="none", least=2)
    for x in (index.build(rows, PLAIN), index.build(given, PLAIN), index.build(rows, two)):
        whole = index.Index(x.config, x.documents, x.postings, x.terms)
        one, other = (Engine({"d": y}, length=how).search("d", search).scored for y in (x, whole))
        assert _cuts(one) == 0 < _cuts(other)
        assert [(r["doc_id"], round(r["score"], 12)) for r in one.sort("doc_id", "score").collect()] == [(r["doc_id"], round(r["score"], 12)) for r in other.sort("doc_id", "score").collect()]


def test_lengths_where_tokens_have_parts(docs):
    """These lengths count tokens, not their parts, and come from the documents."""
    x = index.build(docs, Config(name="d", tokenizer="punct", stemmer="none", stop_list="none"))
    whole = index.Index(x.config, x.documents, x.postings, x.terms)
    one, other = (sorted(Engine({"d": y}).search("d", "the OR with").scored.collect()) for y in (x, whole))
    assert one == other != []


def test_term_tests_compare_before_they_match(spark):
    """Plain comparisons, which refuse most words of a text, stand before regular expressions, and select the same terms."""
    t = F.col("term")
    for function, value in (("range", "thea-theb"), ("range", "1-50"), ("wildcard", "th?"), ("wildcard", "1%")):
        said = str(expand.predicate(t, function, value)).lower()
        assert min(said.find(x) for x in (">=", "startswith") if x in said) < said.find("rlike"), said
    terms = spark.createDataFrame([(w,) for w in ("", "a", "z", "{", "`", "A", "Z", "[", "@", "0", "9", ":", "/", "é", "É", "ß", "٣", "theab", "The", "THEA", "the", "thea", "theb", "thebc", "50", "51", "1", "0001", "1a", "x1", "1234567890123456789")], "term string")
    for first in "q7Qé":
        kind = {"q": "lower", "7": "digit", "Q": "upper"}.get(first, "high")
        assert terms.where(expand.same_class(t, first) != (text.first_class(t) == kind)).count() == 0
    got = lambda *how: {r["term"] for r in terms.where(expand.predicate(t, *how)).collect()}
    assert got("range", "thea-theb") == {"theab", "thea", "theb"} and got("range", "1-50") == {"50", "1", "0001", "9"} and got("range", "THEA-THEB") == {"THEA"}


def test_whole_vocabulary_shuffles_no_pairs_of_terms_and_documents(spark, docs):
    """Terms are counted by one aggregation by term; documents of one id, or without one, count as before."""
    again = docs.unionByName(spark.createDataFrame([(0, "of theme Theme THE", "en", "s"), (None, "of 𝐀 λόγος ΛΌΓΟΣ", "en", "s")], docs.schema))
    other = Config(name="documents", stemmer="none", stop_list="short", most=4, case_variants=False)
    for rows, config in ((docs, PLAIN), (docs.where("doc_id > 0").unionByName(again.where("doc_id is null").withColumn("doc_id", F.lit(7).cast("bigint"))), PLAIN), (docs, other), (again, PLAIN)):
        x = index.build(rows, config)
        assert x.vocabulary.dtypes == x.terms.dtypes
        assert sorted(map(str, x.vocabulary.collect())) == sorted(map(str, x.terms.collect()))
    regular = catalog.term_info(index.build(docs, PLAIN), "regular")
    assert "doc_id" not in regular._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1].split("\n")[0] and "distinct" not in regular._jdf.queryExecution().optimizedPlan().toString()


def test_feedback_and_counters_cut_texts_once(docs):
    x = index.build(docs, PLAIN)
    whole = index.Index(x.config, x.documents, x.postings, x.terms)
    for how in ({"like": "theory of cities"}, {"search": "{fmtct:100} of", "unlike": "boats with the"}, {"search": "with {fmtct:100}", "like": "THE boats"}):
        one, other = (Engine({"d": y}, length="none").search("d", **how).scored for y in (x, whole))
        assert _cuts(one) <= 1 < _cuts(other)  # the feedback text itself
        assert sorted(one.collect()) == sorted(other.collect())
    counted = [Engine({"d": y}).counters("d", "of {language:en}{inclusion_filter:with}{exclusion_filter:boat*}").collect() for y in (x, whole)]
    assert counted[0] == counted[1]


def test_verification_cuts_texts_once_and_finds_faults(docs):
    x = index.build(docs, PLAIN)
    assert _cuts(catalog.statistics(x)) == 0
    faulty = index.Index(x.config, x.documents.where("doc_id <> 1"), x.postings.where("term <> 'of' or doc_id <> 0"), x.terms)
    faults = {r["what"]: r["n"] for r in catalog.statistics(faulty).collect()}
    assert faults["terms_off"] == 1 and faults["postings_without_document"] == 5 and faults["documents"] == 5 and faults["terms"] == x.terms.count()


def test_stems_of_rare_words_need_no_shuffle(spark, docs, monkeypatch):
    """Whether a word's stem is among those sent to all tasks or not, it is the same, and words are never shuffled by their term."""
    config = Config(name="d", stop_list="none")
    rows = lambda x: sorted(tuple(r) for r in x.exploded.collect())
    many = rows(index.build(docs, config))
    monkeypatch.setattr(index, "BROADCAST_STEMS", 3)
    x = index.build(docs, config)
    assert rows(x) == many
    assert {r[0] for r in many} >= {"city", "and", "ÉTÉ"}
    plan = x.exploded._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_a_stored_index_has_files_by_its_size(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "FILE_ROWS", 4)
    x = index.build(docs, PLAIN, once=True)
    path = str(tmp_path / "ix")
    stored = x.write(path, buckets=2)
    assert stored.postings.select(F.input_file_name().alias("f")).distinct().count() > 4
    assert sorted(map(tuple, stored.postings.collect())) == sorted(map(tuple, x.postings.collect()))
