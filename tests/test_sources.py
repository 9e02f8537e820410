import pytest

from quarrylex.api import Engine
from quarrylex.operators.index import Config
from quarrylex.sources import formats, stream
from quarrylex.streaming import ingest

FILES = {
    "text": "A title\nfirst line\nsecond\n", "para": "One para\nof two lines\n\n\nNext para\n", "line": "Title here\nterm one\nterm two\n",
    "mbox": "From a@b Mon Oct 11 2004\nFrom: A <a@b.c>\nTo: x@y.z\nSubject: Hello\n there\nDate: Mon, 11 Oct 2004 10:00:00 +0000\n\nBody text\n>From here\n\nFrom c@d Tue Oct 12 2004\nSubject: Second\n\nMore\n",
    "refer": "%A Smith, J.\n%A Jones, K.\n%T A paper\n%D 1985\n\n%T Other\n continued\n%L key2\n", "tagged-text": "title: First\nurl: http://x.y/\ntext: some text\nmore\n---\ntitle: Second\nkey: k2\ntext: other\n",
    "tagged-xml": "<documents><document><title>A &amp; B</title><key>k</key><text>hello</text></document><document><title>C</title><text><![CDATA[x < y]]></text></document></documents>",
    "feed": "Title: Post one\nFeed-Url: http://f\nKey: p1\nDate: 2004-10-12\nDescription: short\n\nTitle: Post two\nContent: long\n  text\n",
    "medline": "UI  - 123\nTI  - A title that\n      goes on\nAB  - Abstract\nDA  - 19990102\n\nPMID- 456\nTI  - Second\n",
    "omim": "*RECORD*\n*FIELD* NO\n100050\n*FIELD* TI\nAARSKOG\n*FIELD* TX\nLong text\nhere\n*RECORD*\n*FIELD* NO\n100070\n*FIELD* TI\nOTHER\n*THEEND*\n",
    "trec": "<DOC>\n<DOCNO> FT-1 </DOCNO>\n<HL>Head</HL>\n<TEXT>\nbody <b>bold</b>\n</TEXT>\n</DOC>\n<DOC><DOCNO>FT-2</DOCNO><TEXT>x</TEXT></DOC>\n",
}
WANT = {
    "text": [("A title", None)], "para": [("One para", None), ("Next para", None)], "line": [("Title here", None)], "mbox": [("Hello there", None), ("Second", None)], "refer": [("A paper", None), ("Other continued", "key2")],
    "tagged-text": [("First", None), ("Second", "k2")], "tagged-xml": [("A & B", "k"), ("C", None)], "feed": [("Post one", "p1"), ("Post two", None)], "medline": [("A title that goes on", "123"), ("Second", "456")],
    "omim": [("AARSKOG", "100050"), ("OTHER", "100070")], "trec": [("Head", "FT-1"), (None, "FT-2")],
}


@pytest.mark.parametrize("form", FILES)
def test_format(spark, tmp_path, form):
    (tmp_path / "a.dat").write_text(FILES[form])
    rows = formats.read(spark, form, str(tmp_path / "a.dat")).orderBy("seq").collect()
    assert [r["title"] for r in rows] == [t for t, _ in WANT[form]]
    assert all(k is None or r["doc_key"] == k for r, (_, k) in zip(rows, WANT[form], strict=True))
    if form == "mbox":
        assert rows[0]["ansi_date"] == 20041011100000 and "From here" in rows[0]["fields"]["body"]
    if form == "refer":
        assert rows[0]["fields"]["author"] == "Smith, J.\nJones, K." and rows[0]["ansi_date"] == 19850000000000
    if form == "medline":
        assert rows[0]["ansi_date"] == 19990102000000


def test_file_choice(spark, tmp_path):
    for n in ("a.txt", "b.txt", "c.dat"):
        (tmp_path / n).write_text(f"Title {n}\n")
    (tmp_path / "a.jpg").write_bytes(b"\x01\x02")
    read = lambda **how: sorted(r["title"] for r in formats.read(spark, "text", str(tmp_path), **how).collect())
    assert read(include="*.txt") == ["Title a.txt", "Title b.txt"] and read(include="*.txt", exclude="b[.]txt$") == ["Title a.txt"]
    assert len(read(include="*.txt", most=1)) == 1
    rows = formats.read(spark, "text", str(tmp_path), include="*.txt", associate=("image", "jpg")).collect()
    assert {r["title"]: r["image"] and bytes(r["image"]) for r in rows} == {"Title a.txt": b"\x01\x02", "Title b.txt": None}


STREAM = "\n".join(
    [
        "V 0 0", "L en UTF-8", "F title 1 string StemmingOn Title of it", "F text 2 string StemmingOff,StopTermOff Text", "S text", "L en", "T Quartz 1 1", "T amethyst 1", "T lions 2 3", "D 2004-10", "H Quartz amethyst", "K k1",
        "I document text/plain 5", "hello", "R 7", "E", "K k2", "T lions 2", "E", "T unfinished 2", "Z", "T ignored 2", "",
    ]
)


def test_index_stream(spark, tmp_path):
    (tmp_path / "s.txt").write_text(STREAM)
    x = stream.read_index(spark, str(tmp_path / "s.txt"), Config(name="s", stop_list="none"))
    docs = {r["doc_key"]: r for r in x.documents.collect()}
    assert set(docs) == {"k1", "k2"} and docs["k1"]["term_count"] == 3 and docs["k1"]["ansi_date"] == 20041000000000 and docs["k1"]["rank"] == 7
    assert [f.name for f in x.config.fields] == ["title", "text"] and not x.config.fields[1].stemming and x.config.default_fields == ("text",)
    found = lambda q: sorted(r["doc_id"] for r in Engine({"s": x}).search("s", q).scored.collect())
    assert len(found("literal[lions]")) == 2 and len(found('title="quartz amethyst"')) == 1 and found("unfinished") == []
    items = [r for r in stream.read_events(spark, str(tmp_path / "s.txt")).where("kind = 'item'").collect()]
    assert bytes(items[0]["data"]) == b"hello"
    (tmp_path / "bad.txt").write_text("F a 2 string\n")
    with pytest.raises(Exception, match="follow each other"):
        stream.read_events(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "falls.txt").write_text("T a 1 5\nT b 1 3\nE\n")
    with pytest.raises(Exception, match="must not fall"):
        stream.read_events(spark, str(tmp_path / "falls.txt")).collect()


def test_streaming_ingest(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "bats and lions"), (2, "lions")], "doc_id long, text string").write.parquet(src)
    docs = spark.readStream.schema("doc_id long, text string").parquet(src)
    ingest.ingest(docs, str(tmp_path / "out"), str(tmp_path / "ck"), Config(name="seg", stemmer="none")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/terms")).where("term = 'lions'").agg({"doc_count": "sum"}).first()[0] == 2


def test_windowed_events(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    assert ingest.windowed(e).agg({"n": "sum"}).first()[0] == e.count()
