"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index has a posting (row, term, position) of every test term in the training corpus; one pass cuts the texts into words.
A phrase is a window of an item's words (all of them if it has fewer). Corpus statistics order the terms of a phrase by
rarity. Lists are intersected from the rarest terms on: for each distinct pair of rare terms at their distance, one list is
shifted by the distance and met with the other, give or take the spread; overlapping phrases and phrases that many items
share have the same pairs, so that each is met once. What survives is checked against the lists of all terms of its phrases:

- an exact match has every term at its place;
- a proximity match has at least share of its terms (rounded up) within spread of their places, as seen from an anchor. With m
  terms to miss the m + 1 rarest are anchors, and of the m + 2 rarest one more must be there: no match is lost by the pairs.

Null and empty texts have no words. Every row of documents is a document of its own, rows with the same id included. Repeated
items count once; items without an id count for n_hit only, having no id to list. Ties between terms go to the smaller
offset. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylex.llm.base import BROADCAST_ROWS, attach, materialise, pick, semi

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands after a text's last word, so that its position is the number of words; no word can hold a zero byte.
_END = "\x00"


def tokens(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; lower() does that at once where the text is ASCII."""
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS), "")


def windows(items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(phrase, terms) of the distinct phrases, and (phrase, item_id) of the items that hold them."""
    words = items.select("item_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - width, F.lit(0))
    runs = words.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item_id", F.slice("w", F.col("at") + 1, F.lit(width)).alias("terms"))
    runs = runs.withColumn("phrase", F.concat_ws(" ", "terms")).distinct()
    return runs.select("phrase", "terms").distinct(), runs.select("phrase", "item_id").distinct()


class Index:
    """Postings of the test terms, and which terms to meet first, in tables of the shared scratch folder."""

    def __init__(self, docs: DataFrame, items: DataFrame, width: int = 13, spread: int = 3, share: float = 0.9):
        self.spread, self.share = spread, share
        phrases, owners = windows(items, width)
        self.owners, phrases = materialise(owners, "owners"), materialise(phrases, "phrases")
        flat = phrases.select("phrase", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "word"))
        end = docs.sparkSession.range(1).select(F.lit(_END).alias("word"), F.lit(0).cast("bigint").alias("term"))
        vocabulary = flat.select("word").distinct().withColumn("term", F.monotonically_increasing_id() + 1)
        vocabulary = materialise(vocabulary.unionByName(end), "vocabulary")
        n = vocabulary.count()
        rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")  # numbered before they are taken apart
        words = rows.select("row", "doc_id", F.posexplode(F.concat(tokens(F.col("text")), F.array(F.lit(_END)))).alias("pos", "word"))
        # rows are numbered in this one table, which all later steps read
        table = materialise(attach(words, vocabulary, "word", n).select("row", "doc_id", "term", "pos"), "postings")
        self.sizes = table.where("term = 0").select("row", "doc_id", F.col("pos").cast("bigint").alias("n_words"))
        self.postings = table.where("term > 0").select("row", "term", "pos")
        count = materialise(self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("count")), "statistics")
        terms = attach(flat, vocabulary, "word", n).join(count, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
        rank = F.row_number().over(Window.partitionBy("phrase").orderBy("count", "off"))
        self.terms = materialise(terms.select("phrase", "size", "off", "term", rank.alias("rank")), "terms")
        self.pairs = materialise(self._pairs(), "pairs")

    def _pairs(self) -> DataFrame:
        """(t1, t2, d, phrase, o1, o2, two): two rare terms of a phrase, their distance and offsets; two: either is an anchor.

        With m terms to miss the anchors are the m + 1 rarest, and any of them meets one of the m + 2 rarest. A phrase of one
        term pairs it with itself.
        """
        x = self.terms.withColumn("m", F.col("size") - F.ceil(F.col("size") * self.share)).where("rank <= m + 2")
        y = x.select("phrase", F.col("term").alias("t2"), F.col("off").alias("o2"), F.col("rank").alias("rank2"))
        both = x.join(y, "phrase").where("rank < rank2 or size = 1")
        return both.select(F.col("term").alias("t1"), "t2", (F.col("o2") - F.col("off")).alias("d"), "phrase", F.col("off").alias("o1"), "o2", F.expr("rank2 <= m + 1").alias("two"))

    def candidates(self) -> DataFrame:
        """(phrase, row, start): where two rare terms of a phrase stand at their distance, seen from either anchor."""
        spread, cell = self.spread, 16
        pairs = materialise(self.pairs.select("t1", "t2", "d").distinct(), "distinct-pairs")
        rare = materialise(self.pairs.select(F.explode(F.array("t1", "t2")).alias("term")).distinct(), "rare-terms")
        lists = materialise(semi(self.postings, rare, "term", rare.count()), "rare-postings")
        want = attach(lists.withColumnRenamed("term", "t1"), pairs, "t1", pairs.count()).select("row", "t1", "t2", "d", "pos", (F.col("pos") + F.col("d")).alias("at"))
        near = [F.floor((F.col("at") + k) / cell).cast("int") for k in (-spread, spread)]
        want = want.withColumn("cell", F.explode(F.array_distinct(F.array(*near))))
        there = lists.select("row", F.col("term").alias("t2"), F.col("pos").alias("pos2"), F.floor(F.col("pos") / cell).cast("int").alias("cell"))
        met = want.join(there, ["row", "t2", "cell"]).where(F.abs(F.col("pos2") - F.col("at")) <= spread).select("t1", "t2", "d", "row", "pos", "pos2")
        met = materialise(met, "met")
        out = met.join(self.pairs, ["t1", "t2", "d"])
        starts = F.when(F.col("two"), F.array(F.col("pos") - F.col("o1"), F.col("pos2") - F.col("o2"))).otherwise(F.array(F.col("pos") - F.col("o1")))
        return out.select("phrase", "row", F.explode(F.array_distinct(starts)).alias("start")).distinct()

    def matches(self) -> DataFrame:
        """(phrase, row, start, size, exact, near): the candidates whose terms are all at their places, or enough near them."""
        found = materialise(self.candidates(), "candidates")
        ids = materialise(found.select("row").distinct(), "candidate-rows")
        lists = materialise(semi(self.postings, ids, "row", ids.count()), "full-postings")
        width = self.spread
        probe = found.join(self.terms.select("phrase", "size", "off", "term"), "phrase").select("phrase", "row", "start", "size", "off", "term", (F.col("start") + F.col("off")).alias("at"))
        probe = probe.withColumn("cell", F.explode(F.array_distinct(F.array(*[F.floor((F.col("at") + k) / 16).cast("int") for k in (-width, width)]))))
        there = lists.withColumn("cell", F.floor(F.col("pos") / 16).cast("int"))
        hit = probe.join(there, ["row", "term", "cell"]).where(F.abs(F.col("pos") - F.col("at")) <= width)
        term = hit.groupBy("row", "phrase", "start", "size", "off").agg(F.max((F.col("pos") == F.col("at")).cast("int")).alias("exact"))
        whole = term.groupBy("row", "phrase", "start", "size").agg(F.sum("exact").alias("exact"), F.count(F.lit(1)).alias("n"))
        out = whole.select("phrase", "row", "start", "size", (F.col("exact") == F.col("size")).alias("exact"), (F.col("n") >= F.ceil(F.col("size") * self.share)).alias("near"))
        return out.where("exact or near")


def hit_words(matches: DataFrame) -> DataFrame:
    """(row, n_hit): words covered by the union of the matches, whose ends don't fall as starts rise after a running maximum."""
    runs = matches.groupBy("row", "start").agg(F.max(F.col("start") + F.col("size")).alias("stop"))
    w = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("stop").over(w), F.lit(0))
    return runs.select("row", F.greatest(F.col("stop") - F.greatest("start", seen), F.lit(0)).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))


def report(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20, spread: int = 3) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and n_near.

    n_hit: words inside exact matches; contaminated: at least one in share of all words. n_near: items with proximity matches,
    exact ones included.
    """
    docs = pick(docs, "doc_id", "text")
    items = items.select(F.col("item_id"), F.col("text").cast("string"))
    index = Index(docs, items, width, spread)
    matches = materialise(index.matches(), "matches")
    hits = hit_words(matches.where("exact"))
    owned = matches.groupBy("row", "phrase").agg(F.max("exact").alias("exact")).join(index.owners.where("item_id is not null"), "phrase")
    own = owned.groupBy("row", "item_id").agg(F.max("exact").alias("exact")).groupBy("row").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id").cast("string")))).alias("items"), F.count(F.lit(1)).alias("n_near"))
    found = materialise(hits.join(own, "row", "full"), "found")
    out = attach(index.sizes, found, "row", found.count(), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
    )


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents in which no benchmark passage stands, whatever their length, with their own columns.

    Passages in long texts are far less than the share that report's contaminated asks for, yet a model would learn them too.
    Rows whose id has a passage in any row go; rows without an id are compared as one.
    """
    bad = materialise(report(docs, items, **how).where("n_hit > 0").select("doc_id").distinct(), "contaminated")
    n = bad.count()
    return docs.join(F.broadcast(bad) if n <= BROADCAST_ROWS else bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")
