"""The inverted index as DataFrames: documents, postings, terms, fields and one row about the index.

Everything is a projection or an aggregation over the tokenised documents: one shuffle on the term for the statistics, none
for the postings. A search of an index that isn't stored cuts the texts once and keeps the rows of the terms that it needs
(narrowed); a stored one is laid out by term.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylex.functions import stemmers, stoplists, text
from quarrylex.session import scratch

REGULAR, STOP, FREQUENT = 1, 2, 3
#: Stems that are sent to all tasks; those of rarer words are worked out where they stand (plural rules) or joined by shuffles.
BROADCAST_STEMS = 300_000
#: Postings of a file of a stored index; a larger index has more files than its buckets.
FILE_ROWS = 4_000_000


class IndexLocked(RuntimeError):
    """Another writer holds the index's folder."""


@dataclass(frozen=True)
class Field:
    """A searchable field: its column and whether it is stemmed, drops stop terms and keeps positions."""

    name: str
    column: str
    stemming: bool = True
    stop: bool = True
    positions: bool = True
    description: str = ""


@dataclass(frozen=True)
class Config:
    name: str = "main"
    fields: tuple[Field, ...] = (Field("text", "text"),)
    default_fields: tuple[str, ...] = ()
    tokenizer: str = "alnum"
    stemmer: str = "plural"
    stop_list: str | frozenset[str] = "long"
    lang: str = "en"
    least: int = 1
    most: int = 255
    case_variants: bool = True
    normalise: bool = False


@dataclass
class Index:
    config: Config
    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    _n: int | None = field(default=None, repr=False)
    exploded: DataFrame | None = field(default=None, repr=False)  # what postings and terms are made from
    written: bool = field(default=False, repr=False)  # exploded is read from a scratch table, not made from texts
    chosen: Callable[[Callable[[Column], Column]], DataFrame] | None = field(default=None, repr=False)  # exploded under a test on terms, with the documents' lengths if they are at hand
    sizes: DataFrame | None = field(default=None, repr=False)  # lengths that were found with the terms
    counted: Callable[[], DataFrame | None] | None = field(default=None, repr=False)  # terms counted document by document
    uid: str = field(default_factory=lambda: uuid.uuid4().hex, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    @property
    def n_docs(self) -> int:
        if self._n is None:
            self._n = self.documents.count()
        return self._n

    @property
    def vocabulary(self) -> DataFrame:
        """terms, for use as a whole: where they are made from texts, pairs of terms and documents aren't shuffled if that can be."""
        found = self.counted() if self.counted is not None and not self.written else None
        return self.terms if found is None else found

    @property
    def lengths(self) -> DataFrame:
        """(doc_id, term_count) of all documents."""
        return self.documents.select("doc_id", "term_count") if self.sizes is None else self.sizes

    @property
    def fields(self) -> DataFrame:
        rows = [(self.config.name, k, f.name, "string", f.stemming, f.stop, f.positions, f.description) for k, f in enumerate(self.config.fields, 1)]
        return self.spark.createDataFrame(rows, "index_name string, field_id int, name string, type string, stemming boolean, stop_term boolean, term_position boolean, description string")

    @property
    def info(self) -> DataFrame:
        """One row: names of the analysers, bounds, counts of documents and of regular and stop terms."""
        c = self.config
        kinds = self.vocabulary.where("in_counts").agg(
            F.count_if(F.col("term_type") == REGULAR).alias("unique_terms"), F.coalesce(F.sum(F.when(F.col("term_type") == REGULAR, F.col("term_count"))), F.lit(0)).alias("total_terms"),
            F.count_if(F.col("term_type") == STOP).alias("unique_stop_terms"), F.coalesce(F.sum(F.when(F.col("term_type") == STOP, F.col("term_count"))), F.lit(0)).alias("total_stop_terms"),
        )
        docs = self.documents.agg(F.count(F.lit(1)).alias("n_docs"), F.max("ansi_date").alias("last_date"))
        named = [F.lit(v).alias(k) for k, v in (("index_name", c.name), ("version", "1"), ("lang", c.lang), ("tokenizer", c.tokenizer), ("stemmer", c.stemmer), ("stop_list", c.stop_list if isinstance(c.stop_list, str) else "file"), ("min_len", c.least), ("max_len", c.most))]
        return docs.join(kinds, how="cross").select(*named, "n_docs", "unique_terms", "total_terms", "unique_stop_terms", "total_stop_terms", F.array(*map(F.lit, c.default_fields or [f.name for f in c.fields])).alias("default_fields"), "last_date")  # one row each

    def field_ids(self, names: tuple[str, ...]) -> list[int] | None:
        """Ids of field names; None: no restriction. Unknown names are ignored, and if none is left the default fields hold."""
        if not names or "*" in names:
            return None
        known = {f.name: k for k, f in enumerate(self.config.fields, 1)}
        ids = [known[n] for n in names if n in known]
        return ids or ([known[n] for n in self.config.default_fields] or None)

    def narrowed(self, test: Callable[[Column], Column]) -> Index:
        """The index of the terms that pass a test, for one search: texts are cut once, and what is found is written.

        Counts of these terms and of documents, and the documents' lengths, are those of the whole index. A stored index is
        as good as it is.
        """
        if self.chosen is None or self.written:
            return self
        rows, sizes = scratch(self.chosen(test), "narrowed"), None
        if "size" in rows.columns:
            sizes = rows.where("size is not null").select("doc_id", F.col("size").alias("term_count"))
            rows = rows.where("term is not null").drop("size")
        return Index(self.config, self.documents, _postings(rows, self.config), _terms(rows, self.config), self.n_docs, rows, True, sizes=sizes, uid=self.uid)

    def write(self, path: str, buckets: int = 64) -> Index:
        """Store the tables in a folder of their own below path, to which path points once they are complete.

        Texts are cut into terms once. Postings are dealt by ranges of (term, document), so that a term's list is in few
        files and row groups, and the list of a very common term in several: at least buckets, and more where a file would
        have more than FILE_ROWS. One writer at a time holds the folder's lock; a write that fails leaves the index as it
        was. The version before is kept for readers that have it open.
        """
        with _locked(self.spark, path):
            version = f"v-{uuid.uuid4().hex}"
            try:
                x = self
                if self.exploded is not None:
                    rows = self.exploded if self.written else scratch(self.exploded, "terms-in-places")
                    x = Index(self.config, self.documents, _postings(rows, self.config), _terms(rows, self.config))
                files = max(buckets, -(-x.postings.count() // FILE_ROWS))
                out = {
                    "documents": x.documents,
                    "postings": x.postings.repartitionByRange(files, "term", "doc_id").sortWithinPartitions("term", "doc_id", "position"),
                    "terms": x.terms.repartition(max(1, files // 8), "term").sortWithinPartitions("term"),
                }
                for name, df in out.items():
                    df.write.parquet(f"{path}/{version}/{name}")
            except BaseException:
                _files(self.spark, path)[0].delete(_path(self.spark, f"{path}/{version}"), True)
                raise
            _publish(self.spark, path, version)
        return Index.read(self.spark, path, self.config)

    @staticmethod
    def read(spark: SparkSession, path: str, config: Config) -> Index:
        version = _current(spark, path)
        if not version:
            raise FileNotFoundError(f"no index at {path}")
        return Index(config, *(spark.read.parquet(f"{path}/{version}/{name}") for name in ("documents", "postings", "terms")))

    def save_tables(self, prefix: str, buckets: int = 64) -> None:
        """The same as catalog tables bucketed by term, for joins of postings and terms without a shuffle."""
        self.postings.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term", "doc_id").saveAsTable(f"{prefix}_postings")
        self.terms.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(f"{prefix}_terms")
        self.documents.write.mode("overwrite").saveAsTable(f"{prefix}_documents")


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, path: str):
    """The file system of a path, whichever it is, and the path there."""
    at = _path(spark, path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _current(spark: SparkSession, path: str) -> str:
    """The version of a stored index; empty if there is none."""
    fs, _ = _files(spark, path)
    if not fs.exists(_path(spark, f"{path}/_current")):
        return ""
    stream = fs.open(_path(spark, f"{path}/_current"))
    try:
        return stream.readUTF()
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, version: str) -> None:
    fs, at = _files(spark, path)
    before = _current(spark, path)
    stream = fs.create(_path(spark, f"{path}/_current"), True)  # one small file, replaced at once
    stream.writeUTF(version)
    stream.close()
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(f.getPath(), True)


@contextlib.contextmanager
def _locked(spark: SparkSession, path: str) -> Iterator[None]:
    fs, at = _files(spark, path)
    fs.mkdirs(at)
    lock = _path(spark, f"{path}/_lock")
    if not fs.createNewFile(lock):
        raise IndexLocked(f"{path} is being written; if no writer is alive, delete {path}/_lock")
    try:
        yield
    finally:
        fs.delete(lock, False)


def _cases(tokens: DataFrame, config: Config) -> DataFrame:
    """Rows with their terms before stemming: the lower-cased form always, and the original where it has upper case."""
    token = F.col("token")
    kept = [c for c in tokens.columns if c != "token"]
    if not config.case_variants:
        return tokens.select(*kept, F.lower(token).alias("term"), F.lit(True).alias("in_counts"))
    return tokens.withColumn("v", F.explode(_both_cases(token))).select(*kept, "v.*")


def _own_case(token: Column) -> Column:
    return (token != F.lower(token)) & text.has_upper(token)


def _both_cases(token: Column) -> Column:
    low, own = F.struct(F.lower(token).alias("term"), F.lit(True).alias("in_counts")), F.struct(token.alias("term"), F.lit(False).alias("in_counts"))
    return F.when(_own_case(token), F.array(low, own)).otherwise(F.array(low))


def _found(tokens: DataFrame, config: Config, test: Callable[[Column], Column]) -> DataFrame:
    """The same rows for the terms that pass a test; where tokens have a size, that of each document stands in one of its rows.

    Most tokens fail, so the test comes before all else that is asked about a token. size is null but in a document's first
    row, which is kept, without a term if that one fails.
    """
    token, sized = F.col("token"), "size" in tokens.columns
    passes = test(F.lower(token))
    if config.case_variants:
        passes = passes | (test(token) & _own_case(token))
    first = F.col("size").isNotNull() if sized else F.lit(False)
    rows = _cases(tokens.where(passes | first if sized else passes), config)
    if not sized:
        return rows.where(test(F.col("term")))
    rows = rows.withColumn("term", F.when(test(F.col("term")), F.col("term"))).withColumn("size", F.when(F.col("in_counts"), F.col("size")))
    return rows.where("term is not null or size is not null")


def forms_of(tokens: DataFrame, config: Config, once: bool = False) -> DataFrame:
    """Rows (..., field_id, lang, token) with the terms they are found by: (..., term, in_counts).

    The lower-cased form always, and the original where it has upper case. Terms all in upper case are never stemmed, mixed
    ones are stemmed in both forms, by the rules of the row's language.
    """
    rows = _cases(tokens, config)
    return _stemmed(scratch(rows, "forms") if once else rows, config)


def _stemmed(rows: DataFrame, config: Config) -> DataFrame:
    """Terms as their stems. Stems are worked out for distinct terms and joined back.

    By plural rules the most frequent words are sent to all tasks with their stems, and those of the others are worked out
    for each row: nothing is shuffled by word, however frequent one is. The lambda keeps these rules out of the tasks'
    generated code, for which they are too long.
    """
    stemmed = [k for k, f in enumerate(config.fields, 1) if f.stemming]
    if config.stemmer == "none" or not stemmed:
        return rows
    free = F.col("field_id").isin(stemmed) & ~text.all_upper(F.col("term"))
    other = F.col("term")
    counted = scratch(rows.where(free).groupBy("term", "lang").agg(F.count(F.lit(1)).alias("n")), "vocabulary")
    distinct = counted.select("term", "lang")
    if config.stemmer == "plural":  # each language's rules by themselves: all in one expression are too much code
        distinct = counted.where(F.col("n") >= _least(counted)).select("term", "lang")
        code = F.substring_index("lang", "-", 1)
        present = [r["c"] for r in distinct.select(code.alias("c")).where(F.col("c").isin(*stemmers.PLURAL)).distinct().collect()]  # twelve at most
        parts = [distinct.where(code == c).withColumn("stem", stemmers.plural(F.col("term"), c)) for c in sorted(present)]
        parts.append(distinct.where(F.coalesce(~code.isin(*present), F.lit(True)) if present else F.lit(True)).withColumn("stem", stemmers.plural_any(F.col("term"))))
        stems = scratch(reduce(DataFrame.unionByName, parts), "stems")
        other = F.element_at(F.transform(F.array("term"), lambda t: stemmers.plural(t, F.col("lang"))), 1)
        few = True
    else:
        stems = distinct.withColumn("stem", stemmers.stem(F.col("term"), config.stemmer, F.col("lang")))
        stems = scratch(stems.where("stem <> term"), "stems")
        few = stems.count() <= BROADCAST_STEMS
    stems = stems.select(F.col("term").alias("t"), F.col("lang").alias("l"), "stem")
    joined = rows.join(F.broadcast(stems) if few else stems, (F.col("term") == F.col("t")) & F.col("lang").eqNullSafe(F.col("l")), "left")
    return joined.withColumn("term", F.when(free, F.coalesce("stem", other)).otherwise(F.col("term"))).drop("stem", "t", "l")


def _least(counted: DataFrame) -> int:
    """The least count n of which at most BROADCAST_STEMS words have as many, by classes of counts."""
    size = F.floor(F.log2("n") * 4)
    total, least = 0, 1 << 62
    for r in counted.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).orderBy(F.desc("size")).collect():  # 250 classes at most
        total += r["words"]
        if total > BROADCAST_STEMS:
            break
        least = r["n"]
    return least


#: Tokenizers that keep punctuation, whose tokens have parts.
_PARTING = ("punct", "auto")


def _tagged(field_id: int):
    return lambda t: F.struct(F.lit(field_id).alias("field_id"), t.alias("token"))


def _shortened(token: Column, config: Config) -> Column:
    return F.when(F.octet_length(token) > config.most, F.substring(token, 1, config.most)).otherwise(token)


def tokenised(docs: DataFrame, config: Config, sized: bool = False) -> DataFrame:
    """(doc_id, lang, field_id, position, token): positions run through all fields of a document from 1.

    One field whose tokens are all long enough is cut without functions on arrays, which are slow. sized: with the number of
    a document's tokens as size in its first row, which it has even if it has no token; null in the others.
    """
    cut = text.TOKENIZERS[config.tokenizer]
    lang = (F.col("lang") if "lang" in docs.columns else F.lit(config.lang)).alias("lang")
    given = [F.col("term_count").cast("bigint").alias("given")] if sized and "term_count" in docs.columns else []
    tokens, field_id, token = [], F.lit(1), F.col("t")
    for k, f in enumerate(config.fields, 1):
        source = F.col(f.column).cast("string")
        tokens.append(cut(text.normalise(source) if config.normalise else source))
    if len(config.fields) == 1 and config.least <= 1:
        every, token = tokens[0], _shortened(token, config)
    else:
        every = F.concat(*[F.transform(text.bounded(t, config.least, config.most), _tagged(k)) for k, t in enumerate(tokens, 1)])
        field_id, token = F.col("t.field_id"), F.col("t.token")
    named = ["doc_id", "lang", field_id.alias("field_id"), (F.col("p") + 1).alias("position"), token.alias("token")]
    if not sized:
        return _parted(docs.select("doc_id", lang, F.posexplode(every).alias("p", "t")).select(*named), config)
    rows = docs.select("doc_id", lang, *given, every.alias("tokens"))
    rows = rows.select("*", F.posexplode_outer("tokens").alias("p", "t"))
    size = F.size("tokens").cast("bigint")
    return rows.select(*named, F.when(F.coalesce("p", F.lit(0)) == 0, F.coalesce("given", size) if given else size).alias("size"))


def _parted(tokens: DataFrame, config: Config) -> DataFrame:
    """With the parts of M&A at its position, by the tokenizers that keep punctuation."""
    return tokens.withColumn("token", F.explode(text.components(F.col("token")))) if config.tokenizer in _PARTING else tokens


def build(docs: DataFrame, config: Config = Config(), once: bool = False) -> Index:
    """docs needs doc_id and the fields' columns; doc_key, title, lang, rank, ansi_date and term_count are optional.

    once: the texts' terms are written to the scratch folder first, for an index that will be stored, so that they are not
    cut again for the vocabulary, the postings and the statistics.
    """
    have = set(docs.columns)
    tokens = tokenised(docs, config)
    named = ["term", "doc_id", "position", "field_id", "in_counts"]
    exploded = forms_of(tokens, config, once).select(*named)
    plain = config.stemmer == "none" or not any(f.stemming for f in config.fields)
    sized = not config.normalise and config.tokenizer not in _PARTING  # else tokens are not what documents' lengths count
    chosen = lambda test: _found(tokenised(docs, config, sized), config, test).select(*named, *["size"] * sized) if plain else exploded.where(test(F.col("term")))
    counted = (lambda: _counted(docs, config)) if plain and len(config.fields) == 1 and config.least <= 1 and config.tokenizer not in _PARTING else None
    name = F.lit(config.name)
    cut = text.TOKENIZERS[config.tokenizer]
    long_enough = lambda tokens: tokens if config.least <= 1 else text.bounded(tokens, config.least, config.most)
    size = sum((F.size(long_enough(cut(F.col(f.column).cast("string")))) for f in config.fields), F.lit(0)).cast("bigint")
    opt = lambda c, default, kind: (F.col(c) if c in have else default).cast(kind).alias(c)
    documents = docs.select(
        name.alias("index_name"), F.col("doc_id").cast("bigint"), opt("doc_key", F.col("doc_id"), "string"), opt("title", F.lit(None), "string"), opt("lang", F.lit(config.lang), "string"), opt("rank", F.lit(0), "bigint"),
        (F.coalesce(F.col("term_count").cast("bigint"), size) if "term_count" in have else size).alias("term_count"), opt("ansi_date", F.lit(0), "bigint"),
        *[F.col(f.column).cast("string").alias(f"item_{f.name}") for f in config.fields],
    )
    return Index(config, documents, _postings(exploded, config), _terms(exploded, config), exploded=exploded, written=once, chosen=chosen, counted=counted)


def _stop(config: Config) -> Column:
    return stoplists.is_stop(F.col("term"), config.stop_list)


def _postings(exploded: DataFrame, config: Config) -> DataFrame:
    """Without the stop terms of the fields that drop them, and without positions where a field keeps none."""
    drops = [k for k, f in enumerate(config.fields, 1) if f.stop]
    kept = exploded.where(~(_stop(config) & F.col("field_id").isin(drops))) if drops else exploded
    flat = [k for k, f in enumerate(config.fields, 1) if not f.positions]
    at = F.when(F.col("field_id").isin(flat), F.lit(0)).otherwise(F.col("position")) if flat else F.col("position")
    return kept.select(F.lit(config.name).alias("index_name"), "term", "doc_id", at.alias("position"), "field_id")


def _terms(exploded: DataFrame, config: Config) -> DataFrame:
    """Counts of each term; its fields are gathered as bits, so that the aggregation stays a hash table of numbers."""
    n = len(config.fields)
    if n <= 62:
        fields = F.expr("bit_or(shiftleft(1L, field_id))")
        named = F.filter(F.array(*[F.lit(k) for k in range(1, n + 1)]), lambda k: F.getbit(F.col("f"), k) == 1)
    else:
        fields, named = F.collect_set("field_id"), F.sort_array("f")
    counted = exploded.groupBy("term").agg(F.count(F.lit(1)).alias("term_count"), F.countDistinct("doc_id").alias("doc_count"), fields.alias("f"), F.max("in_counts").alias("in_counts"))
    return counted.select(F.lit(config.name).alias("index_name"), "term", F.when(_stop(config), STOP).otherwise(REGULAR).alias("term_type"), "term_count", "doc_count", named.alias("field_ids"), "in_counts")


def _counted(docs: DataFrame, config: Config) -> DataFrame | None:
    """What _terms gives for the unstemmed words of one field, without a shuffle of the pairs of terms and documents.

    A document's terms are sorted where it stands, so that the first of each is known and one aggregation by term counts
    documents too. None where ids repeat or are missing: documents of one id are one document.
    """
    every, different = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if every != different:
        return None
    source = F.col(config.fields[0].column).cast("string")
    cut = text.TOKENIZERS[config.tokenizer](text.normalise(source) if config.normalise else source)
    tokens = docs.select(F.transform(cut, lambda t: _shortened(t, config)).alias("tokens"))
    terms = F.transform("tokens", lambda t: F.lower(t))
    if config.case_variants:
        terms = F.concat(terms, F.filter("tokens", _own_case))
    rows = tokens.select(F.sort_array(terms).alias("terms")).select("terms", F.posexplode("terms").alias("p", "term"))
    first = ~F.get("terms", F.col("p") - 1).eqNullSafe(F.col("term"))
    counts = rows.select("term", first.cast("int").alias("first")).groupBy("term").agg(F.count(F.lit(1)).alias("term_count"), F.sum("first").alias("doc_count"))
    own = _own_case(F.col("term")) if config.case_variants else F.lit(False)
    return counts.select(F.lit(config.name).alias("index_name"), "term", F.when(_stop(config), STOP).otherwise(REGULAR).alias("term_type"), "term_count", "doc_count", F.array(F.lit(1)).alias("field_ids"), (~own).alias("in_counts"))


def numbered(docs: DataFrame, *order: str) -> DataFrame:
    """doc_id from 1 in the given order: counts of range partitions are added up, so that no task sees all rows."""
    ranged = docs.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_part", *order)
    ranged = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
    return ranged.join(F.broadcast(before), "_part").withColumn("doc_id", F.col("_row") + F.coalesce("_before", F.lit(0))).drop("_part", "_row", "_n", "_before")


def key_dictionary(docs: DataFrame) -> DataFrame:
    """doc_key to doc_id; of repeated keys the last document is found, the earlier ones stay in the index."""
    return docs.groupBy("doc_key").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def broken_positions(postings: DataFrame) -> DataFrame:
    """Postings whose position is smaller than the one before in their term's list, or 0 after another; none in a good index."""
    w = Window.partitionBy("term", "doc_id").orderBy("position")
    return postings.withColumn("before", F.lag("position").over(w)).where("before is not null and (position < before or (position = 0 and before > 0))")


def append(spark: SparkSession, path: str, segment: Index) -> None:
    """Add a segment to stored tables partitioned by index_name: how a virtual index grows."""
    for name in ("documents", "postings", "terms"):
        getattr(segment, name).write.mode("append").partitionBy("index_name").parquet(f"{path}/{name}")
