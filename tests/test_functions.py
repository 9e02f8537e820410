import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrylex.functions import dates, phonetics, stemmers, stoplists, text


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]


def test_tokenizers(spark):
    values = ["M&A, C++ (see .net) -- $5 it's", "", None, "aéb 12"]
    assert column(spark, values, text.tokens_alnum) == [["M", "A", "C", "see", "net", "5", "it", "s"], [], [], ["aéb", "12"]]
    assert column(spark, values, text.tokens_punct) == [["M&A", "C++", "see", ".net", "$5", "it's"], [], [], ["aéb", "12"]]
    assert column(spark, ["M&A", "C++", "it's"], text.components) == [["M&A", "M", "A"], ["C++"], ["it's", "it", "s"]]
    assert column(spark, ["中文字", "中", "ab"], text.bigrams) == [["中文", "文字"], ["中"], []]
    assert column(spark, ["a b"], text.unigrams) == [["a", "b"]]
    assert column(spark, ["中文字 abc"], text.tokens_auto) == [["中文", "文字", "abc"]]


def test_case_and_accents(spark):
    assert column(spark, ["ABC", "aBc", "abc", "12", "ÀB1", "--"], text.case_class) == ["upper", "mixed", "lower", "digits", "upper", "none"]
    assert column(spark, ["Éèñ", "œ"], text.strip_accents) == ["Een", "œ"]
    assert column(spark, ["ﬁne — “x” y", "ab"], text.normalise) == ['fine - "x" y', "ab"]


PLURALS = {
    "en": {"cities": "city", "movies": "movy", "eies": "eies", "churches": "church", "boxes": "box", "games": "game", "shoes": "shoes", "bus": "bus", "class": "class", "lions": "lion", "is": "is"},
    "es": {"meses": "mes", "luces": "luz", "casas": "cas", "libro": "libr"}, "de": {"freundinnen": "freundin", "bilder": "bild", "hunde": "hund"}, "it": {"amiche": "amic", "castelli": "castell", "occhio": "occh"},
    "nl": {"boeken": "boek", "tafels": "tafel"}, "pt": {"leões": "leão", "flores": "flor", "animais": "animal", "homens": "homem"}, "fr": {"chevaux": "cheval", "bateaux": "bateal"}, "sv": {"bilars": "bilar"}, "gl": {"leóns": "león"}, "xx": {"things": "thing"},
}


@pytest.mark.parametrize("lang", PLURALS)
def test_plurals(spark, lang):
    want = PLURALS[lang]
    got = dict(zip(want, column(spark, list(want), lambda c: stemmers.plural(c, lang)), strict=True))
    assert got == want


def test_porter():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "vietnamization": "vietnam", "organisation": "organ", "electrical": "electr", "adjustment": "adjust", "adoption": "adopt", "controll": "control", "rate": "rate", "abc1s": "abc1s", "CATS": "CAT"}
    assert {w: stemmers.porter(w) for w in want} == want


def test_lovins():
    want = {"nationally": "nat", "sitting": "sit", "matrix": "matric", "believing": "belief", "magnesia": "magnes", "at": "at"}
    assert {w: stemmers.lovins(w) for w in want} == want


def test_phonetics(spark):
    assert phonetics.soundex("Pfister") == "P123" and phonetics.soundex("Lee") == "L000" and phonetics.soundex("Robert") == "R163"
    names = ["Pfister", "Lee", "Robert", "Müller", "Aaron", "x"]
    assert column(spark, names, phonetics.soundex_native) == [phonetics.soundex(n) for n in names]
    assert column(spark, ["Pfister", "bobby"], phonetics.soundex_alternative) == ["P1236", "b11"]
    assert phonetics.metaphone("Thompson") == "0MPSN"
    assert phonetics.metaphone("Knight") == phonetics.metaphone("Night")
    assert phonetics.phonix("Knight") == phonetics.phonix("night") and phonetics.phonix("apple")[0] == "$"


def test_typo():
    yes = [("form", "from"), ("form", "farm"), ("form", "forms"), ("form", "frm"), ("form", "foorm"), ("form", "form")]
    no = [("form", "dorm"), ("form", "fragment"), ("form", ""), ("form", "formless")]
    assert all(phonetics.typo(a, b) for a, b in yes) and not any(phonetics.typo(a, b) for a, b in no)


def test_stop_lists():
    assert "the" in stoplists.SHORT and "and" not in stoplists.LONG and {"x", "7", "it'll", "where've", "what'd", "which"} <= stoplists.LONG and len(stoplists.SHORT) == 32
    assert not {"this's", "why's"} & stoplists.LONG and stoplists.SHORT <= stoplists.LONG


def test_dates(spark):
    values = ["2021", "1985-00", "Tue, 12 Oct 2004 09:32:37 +0000", "12 Oct 2004", "12/Oct/2004:09:32:37", "spring 1999", "2004-10-12T09:32:37", "nonsense", None]
    assert column(spark, values, dates.parse) == [20210000000000, 19850000000000, 20041012093237, 20041012000000, 20041012093237, 19990300000000, 20041012093237, None, None]
    assert dates.valid(19850000000000) and not dates.valid(19851300000000) and not dates.valid(19850230000000)
    now = dt.datetime(2024, 5, 16, 12)
    assert dates.relative("monday", now) == 20240513000000 and dates.relative("june", now) == 20230600000000 and dates.relative("hier", now) == 20240515000000 and dates.relative("lastmonth", now) == 20240401000000 and dates.relative("whenever", now) is None
