import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrylex.api import Engine
from quarrylex.operators import algebra, catalog, feedback, index, logs, results
from quarrylex.operators.index import Config, Field
from quarrylex.plans.compile import Plan
from quarrylex.plans.parser import parse

ROWS = [
    (1, "en", 20200115000000, "Bats and lions are animals"),
    (2, "en", 20200301000000, "The Donna Klumpp collection: who assembled the minerals"),
    (3, "en", 20210000000000, "Klumpp met Donna near the diamond minerals"),
    (4, "fr", 20210615000000, "animals elephants animals"),
    (5, "en", 20210615120000, "ELEPHANTS and diamond gems"),
    (6, "de", 20221231235959, "lion 150 lionesses computing computer"),
    (7, "en", 20190704000000, "Lions lions LIONS 42 comput"),
    (8, "en", 20230101000000, "minerals minerals animals bats"),
]
CONFIG = Config(name="tiny", stemmer="none", stop_list=frozenset({"and", "are", "the", "who", "near", "met"}))
FOUND = {
    "animals": [1, 4, 8], "bats": [1, 8], "lions": [1, 7], "elephants": [4, 5], "ELEPHANTS": [5], "Lions": [7], "bats OR lions": [1, 7, 8], "bats AND animals": [1, 8], "bats IOR animals": [1, 8], "bats XOR animals": [4],
    "+bats OR lions": [1, 8], "+bats OR +lions": [1], "animals NOT elephants": [1, 8], '"donna klumpp"': [2], '"klumpp collection who assembled"': [2], "donna NEAR klumpp": [2, 3], "donna NEAR[+10] klumpp": [2],
    "donna NEAR[-10] klumpp": [3], "donna NEAR[1] klumpp": [2], "bats OR minerals AND animals": [1, 8], "bats AND animals OR diamond AND minerals": [1, 3, 8], "animals NOT elephants OR gems": [1, 5, 8], "comput*": [6, 7], "lion?": [1, 7],
    "range[100-200]": [6], "animals {language:en}": [1, 8], "minerals {date>=2021}": [3, 8], "{exclusion_filter:animals,gems}": [2, 3, 6, 7], "{inclusion_filter:animals} {inclusion_filter:bats}": [1, 8], "{inclusion_filter:animals,gems}": [1, 4, 5, 8],
    "nowhere": [], "nowhere AND bats": [], "{boolean_operation:relaxed} nowhere AND bats": [1, 8], "{boolean_operation:relaxed} +nowhere AND bats": [], "nowhere OR bats": [1, 8], "+nowhere OR bats": [], "the AND bats": [1, 8], "typo[bast]": [1, 8], "soundex[bats]": [1, 8],
    "text=bats": [1, 8], "regex[^comp.*er$]": [6], "literal[Lions]": [7], "bats AND (lions OR minerals)": [1, 8], "animals NOT (bats OR lions)": [4],
    "{boolean_operation:relaxed} (bats AND gems) AND animals": [1, 4, 8],
}


@pytest.fixture(scope="module")
def tiny(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, lang string, ansi_date long, text string")
    x = index.build(docs, CONFIG)
    return index.Index(CONFIG, x.documents.cache(), x.postings.cache(), x.terms.cache())


@pytest.mark.parametrize("search", FOUND)
def test_documents(tiny, search):
    got = Engine({"tiny": tiny}).search("tiny", search).scored
    assert sorted(r["doc_id"] for r in got.collect()) == FOUND[search]


@pytest.mark.parametrize("search", ["bats AND animals", "bats OR lions", "bats XOR animals", "animals IOR bats", "animals NOT elephants OR gems", "bats AND animals OR diamond AND minerals", "comput* OR lions", "bats[3] OR lions AND animals"])
def test_one_scan_equals_algebra(tiny, search):
    plan = Plan(tiny, parse(search), proximity=False)
    assert plan._masked()
    one = {r["doc_id"]: round(r["score"], 9) for r in plan.matches().collect()}
    from quarrylex.operators.scoring import document_scores

    many = {r["doc_id"]: round(r["score"], 9) for r in document_scores(plan.evaluate(plan.query.root).df).collect()}
    assert one == many


def test_identities(tiny):
    n = lambda q: Engine({"tiny": tiny}).search("tiny", q).total()
    a, b = "animals", "bats"
    assert n(f"{a} OR {b}") == n(a) + n(b) - n(f"{a} AND {b}") and n(f"{a} XOR {b}") == n(f"{a} OR {b}") - n(f"{a} AND {b}")
    assert n(f"{a} IOR {b}") == n(f"+{a} OR {b}") == n(a) and n(f"+{a} OR +{b}") == n(f"{a} AND {b}")
    assert n("donna NEAR[+10] klumpp") == n("klumpp NEAR[-10] donna")


def test_near_by_cells_equals_all_pairs(spark):
    import random

    r = random.Random(3)
    a = sorted({(r.randrange(3), r.randrange(1, 60)) for _ in range(60)})
    b = sorted({(r.randrange(3), r.randrange(1, 60)) for _ in range(60)})
    frame = lambda rows: algebra.Postings(spark.createDataFrame([(d, p, 1.0) for d, p in rows], "doc_id long, position int, weight double"))
    for distance, sign in ((0, ""), (1, "+"), (4, ""), (7, "-")):
        test = {"": lambda g, d=distance: abs(g) <= d, "+": lambda g, d=distance: 0 <= g <= d, "-": lambda g, d=distance: -d <= g <= 0}[sign]
        want = sorted({(d, max(p, q)) for d, p in a for e, q in b if d == e and test(q - p)})
        got = algebra.op_near(frame(a), frame(b), distance, sign).df.collect()
        assert sorted((x["doc_id"], x["position"]) for x in got) == want


def test_scores_order_and_pages(tiny):
    e = Engine({"tiny": tiny})
    page = e.search("tiny", "minerals OR animals", end=1).page.collect()
    assert [r["doc_id"] for r in page] == [r["doc_id"] for r in e.search("tiny", "minerals OR animals").page.collect()][:2]
    dates = [r["sort_key"] for r in e.search("tiny", "animals {sort:date:asc}").page.collect()]
    assert dates == sorted(dates)
    assert e.search("tiny", "animals {search_results:suppress}").page.count() == 0
    assert len(e.search("tiny", "animals", start=1).page.collect()) == 2
    assert e.search("tiny", "animals", end=0, details=True).page.columns[:2] == ["index_name", "doc_id"]


def test_report_and_information(tiny):
    report = {r["term"]: r["doc_count"] for r in Engine({"tiny": tiny}).search("tiny", "the AND bats AND nowhere").report.collect()}
    assert report == {"the": -1, "bats": 2, "nowhere": -2}
    info = tiny.info.first()
    assert info["n_docs"] == 8 and info["unique_stop_terms"] == 6
    assert [r["term"] for r in catalog.term_info(tiny, "wildcard", "lion*").collect()] == ["lion", "lionesses", "lions"]
    faults = {r["what"]: r["n"] for r in catalog.statistics(tiny).collect()}
    assert faults["terms_off"] == 0 and faults["postings_without_document"] == 0
    assert index.broken_positions(tiny.postings).count() == 0
    assert catalog.retrieve(tiny, "1", "text", 0, 3).first()["chunk"] == b"Bats"
    assert catalog.retrieve(tiny, "1", "text", 5, 10_000, unit="characters").first()["chunk"] == "and lions are animals"
    with pytest.raises(Exception, match="after the end"):
        catalog.retrieve(tiny, "1", "text", 500).collect()


def test_store_and_virtual_index(spark, tiny, tmp_path):
    stored = tiny.write(str(tmp_path / "a"), buckets=2)
    other = index.build(spark.createDataFrame([(1, "bats bats minerals")], "doc_id long, text string"), Config(name="other", stemmer="none", stop_list="none"))
    e = Engine({"tiny": stored, "other": other}, virtual={"all": ["[.*]"]}, cache_mode="write")
    got = sorted((r["index_name"], r["doc_id"]) for r in e.search("all", "bats").scored.collect())
    assert got == [("other", 1), ("tiny", 1), ("tiny", 8)]
    assert sorted((r["index_name"], r["doc_id"]) for r in e.search("all", "bats").scored.collect()) == got
    shared = Engine({"tiny": stored, "other": other}, global_idf=True).search("tiny,other", "bats").scored
    assert shared.count() == 3
    with pytest.raises(KeyError):
        e.search("none", "bats")


def test_feedback(spark, tiny):
    e = Engine({"tiny": tiny}, length="none")
    like = e.search("tiny", "{feedback_maximum_term_coverage_threshold:100}", like="diamond gems 42").scored
    assert {r["doc_id"] for r in like.collect()} == {3, 5}
    both = {r["doc_id"]: r["score"] for r in e.search("tiny", "animals {fmtct:100}", unlike="elephants").scored.collect()}
    plain = {r["doc_id"]: r["score"] for r in e.search("tiny", "animals").scored.collect()}
    assert both.keys() == plain.keys() and both[4] < plain[4] and both[1] == plain[1]
    top = feedback.key_terms(tiny, feedback.texts(spark, "diamond diamond bats"), coverage=100.0).orderBy("rank").collect()
    assert top[0]["term"] == "diamond"
    phrases = feedback.key_phrases(tiny, feedback.texts(spark, "diamond minerals\tthe bats\tunknownword bats"), coverage=1000.0).collect()
    assert [p["phrase"] for p in phrases] == ["diamond minerals"]


def test_fields_stop_words_and_stems(spark):
    docs = spark.createDataFrame([(1, "The cats", "dogs run"), (2, "a dog", "cat")], "doc_id long, title string, body string")
    x = index.build(docs, Config(name="f", fields=(Field("title", "title", stop=False), Field("body", "body", positions=False)), stop_list="short"))
    e = Engine({"f": x})
    ids = lambda q: sorted(r["doc_id"] for r in e.search("f", q).scored.collect())
    assert ids("cats") == [1, 2] and ids("title=cat") == [1] and ids("body:dogs") == [1] and ids("title=the") == [1] and ids("nofield=cat") == [1, 2] and ids("*=dog") == [1, 2]
    assert ids('body="dogs run"') == []  # no positions are kept there
    porter = index.build(docs, Config(name="p", fields=(Field("title", "title"), Field("body", "body")), stemmer="porter", stop_list="none"))
    assert sorted(r["doc_id"] for r in Engine({"p": porter}).search("p", "dogs").scored.collect()) == [1, 2]


def test_list_filters_and_frequent_terms(spark, tiny, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("gems\nelephants\n\n")
    e = Engine({"tiny": tiny}, lists={"rare": str(path)})
    assert sorted(r["doc_id"] for r in e.search("tiny", "{inclusion_list_filter:rare}").scored.collect()) == [4, 5]
    assert sorted(r["doc_id"] for r in e.search("tiny", "animals {elf:rare}").scored.collect()) == [1, 8]
    assert sorted(r["doc_id"] for r in e.search("tiny", "animals AND bats {ft:drop}{ftct:45}").scored.collect()) == [1, 8]


def test_result_forms(tiny):
    page = Engine({"tiny": tiny}).search("tiny", "bats").page
    assert results.as_run(page, "7").first()["value"].startswith("7 Q0 ")
    assert results.as_json(page.select("doc_id")).first()["value"].startswith('{"doc_id":')
    assert "<doc_id>" in results.as_xml(page.select("doc_id")).first()["value"]
    rss = results.as_rss(page.join(tiny.documents.select("doc_id", "title", "doc_key"), "doc_id"))
    assert rss.first()["value"].startswith("<item>")


LOG = """30243: 20: 12/Oct/2004:09:32:37 -0500: INFO: Search, index: 'posts,news', search: 'Are Halland {SORT:DATE:DESC}', found: 139 documents and returned: 16, in: 0.001451 seconds.
30243: 20: 12/Oct/2004:09:32:37 -0500: INFO: Relevance feedback terms, total: 100, unique: 100, used: 10.
30243: 17: 12/Oct/2004:09:32:31 -0500: INFO: Finished handling client.
not a log line"""


def test_logs(spark):
    events = logs.parse(spark.createDataFrame([(line,) for line in LOG.split("\n")], "value string")).cache()
    s = events.where("kind = 'search'").first()
    assert events.count() == 3 and s["found"] == 139 and s["returned"] == 16 and s["seconds"] == 0.001451 and s["indexes"] == ["posts", "news"]
    assert s["ts"] == dt.datetime(2004, 10, 12, 14, 32, 37)
    assert {r["kind"]: r["n"] for r in logs.counters(events).collect()} == {"search": 1, "feedback": 1, "close": 1}
    assert sorted(r["index_name"] for r in logs.by_index(events).collect()) == ["news", "posts"]
    assert logs.top(events.where("search is not null"), 5).first()["key"] == "are halland"
    assert logs.script(events).first()["value"].startswith('search "posts,news"')


def test_numbered(spark):
    got = index.numbered(spark.range(100).select((F.col("id") * 7 % 101).alias("k")), "k").orderBy("k").collect()
    assert [r["doc_id"] for r in got] == list(range(1, 101))


def test_neighbours_equal_a_fold(spark):
    """OR and AND against loops over both lists in the order of places."""
    import random

    r = random.Random(8)

    def plain_or(a, b):
        rows = sorted([(d, p, 1, w) for d, p, w in a] + [(d, p, 0, w) for d, p, w in b])
        return [(d, p, w * 3 if k and rows[k - 1][0] == d and 0 < rows[k - 1][1] == p - 1 else w) for k, (d, p, _, w) in enumerate(rows)]

    def plain_and(a, b):
        out = {}
        for doc in {d for d, _, _ in a} & {d for d, _, _ in b}:
            total, last = 0.0, -9
            for p, side, w in sorted([(p, 1, w) for d, p, w in a if d == doc] + [(p, 0, w) for d, p, w in b if d == doc]):
                total += w
                if side == 0 and p == last + 1 and last > 0:
                    total *= 3
                last = p
            out[doc] = (last, total)
        return out

    frame = lambda rows: algebra.Postings(spark.createDataFrame(rows, "doc_id long, position int, weight double"))
    for _ in range(3):
        a, b = ([(d, p, w) for d, p in sorted({(r.randrange(6), r.randrange(0, 25)) for _ in range(40)})] for w in (1.5, 0.5))
        got = [tuple(x) for x in algebra.op_or(frame(a), frame(b), proximity=True).df.collect()]
        assert sorted(got) == sorted(plain_or(a, b))
        got = {x["doc_id"]: (x["position"], round(x["weight"], 6)) for x in algebra.op_and(frame(a), frame(b), proximity=True).df.collect()}
        assert got == {d: (p, round(w, 6)) for d, (p, w) in plain_and(a, b).items()}


def test_neighbours_weigh_more_in_searches(tiny):
    score = lambda q, **how: {r["doc_id"]: r["score"] for r in Engine({"tiny": tiny}, length="none", ranking="none", **how).search("tiny", q).scored.collect()}
    near, far = score("donna OR klumpp"), score("donna OR klumpp", proximity=False)
    assert near == {2: 4.0, 3: 2.0} and far == {2: 2.0, 3: 2.0}  # klumpp right after donna in the second only
    assert score("klumpp AND donna") == {2: 2.0, 3: 2.0} and score("donna AND klumpp") == {2: 6.0, 3: 2.0}
    assert score("animals OR bats").keys() == score("animals OR bats", proximity=False).keys()


def test_index_writes_are_whole(spark, tiny, tmp_path):
    """A failed write leaves the index as it was, a lock keeps others out, a new version takes over at once."""
    path = str(tmp_path / "ix")
    n = tiny.write(path, buckets=2).n_docs
    broken = index.Index(tiny.config, tiny.documents.select(F.raise_error(F.lit("no")).alias("doc_id")), tiny.postings, tiny.terms)
    with pytest.raises(Exception, match="no"):
        broken.write(path, buckets=2)
    again = index.Index.read(spark, path, tiny.config)
    assert again.n_docs == n and not (tmp_path / "ix" / "_lock").exists() and len(list((tmp_path / "ix").glob("v-*"))) == 1
    (tmp_path / "ix" / "_lock").touch()
    with pytest.raises(index.IndexLocked):
        tiny.write(path)
    (tmp_path / "ix" / "_lock").unlink()
    small = index.build(spark.createDataFrame([(1, "one word")], "doc_id long, text string"), tiny.config, once=True).write(path, buckets=2)
    assert small.n_docs == 1 and again.n_docs == n and {r["term"] for r in small.terms.collect()} == {"one", "word"}
    with pytest.raises(FileNotFoundError):
        index.Index.read(spark, str(tmp_path / "none"), tiny.config)


def test_stems_by_language_and_case(spark):
    docs = spark.createDataFrame([(1, "Cities CITIES cities", "en"), (2, "Cities", "xx-yy"), (3, "cities", None)], "doc_id long, text string, lang string")
    x = index.build(docs, Config(name="t", stop_list="none"))
    got = {(r["term"], r["doc_id"]) for r in x.postings.collect()}
    assert got == {("city", 1), ("City", 1), ("CITIES", 1), ("citie", 2), ("Citie", 2), ("citie", 3)}
    assert [r["doc_id"] for r in Engine({"t": x}).search("t", "cities").scored.collect()] == [1]


def test_counters_and_cache(tiny):
    e = Engine({"tiny": tiny}, cache_mode="write", remembered=1)
    row = e.counters("tiny", "animals {language:en}{exclusion_filter:bats}").first().asDict()
    assert row == {"index_name": "tiny", "matched": 3, "failed_date": 0, "failed_language": 1, "not_included": 0, "excluded": 2, "returned": 0}
    e.search("tiny", "animals")
    e.search("tiny", "bats")
    assert len(e._cache) == 1
    e.forget()
    assert not e._cache
