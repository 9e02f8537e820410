"""Relevance feedback, key terms and key phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylex.functions import stemmers, text
from quarrylex.operators import scoring
from quarrylex.operators.index import REGULAR, Index


def _terms_of(index: Index, texts: DataFrame) -> DataFrame:
    """(key, term, tf) of texts (key, text): words all in upper case as they are and lower-cased and stemmed; numbers left out."""
    c = index.config
    words = texts.select("key", F.explode(text.bounded(text.TOKENIZERS[c.tokenizer](F.col("text")), c.least, c.most)).alias("w")).where(~text.all_digits(F.col("w")))
    low = stemmers.stem(F.lower("w"), c.stemmer, c.lang)
    forms = words.select("key", F.explode(F.when(text.all_upper(F.col("w")), F.array(F.col("w"), low)).otherwise(F.array(low))).alias("term"))
    return forms.groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))


def words_of(index: Index, *values: str) -> list[str]:
    """The distinct terms of feedback texts: no more than these texts have."""
    return sorted(r["term"] for r in _terms_of(index, texts(index.spark, *values)).select("term").distinct().collect())


def weighted_terms(index: Index, texts: DataFrame, coverage: float, ranking: str = "cosine", by: str = "doc_count") -> DataFrame:
    """(key, term, tf, doc_count, term_count, weight = idf * tf) of regular terms that few enough documents hold."""
    known = index.terms.where(F.col("term_type") == REGULAR)
    joined = _terms_of(index, texts).join(known.select("term", "doc_count", "term_count"), "term")
    return joined.where(F.col(by) / F.lit(float(index.n_docs)) <= coverage / 100.0).withColumn("weight", scoring.idf_column(ranking, index.n_docs) * F.col("tf"))


def key_terms(index: Index, texts: DataFrame, least: int = 10, percent: float = 20.0, coverage: float = 2.5, by: str = "term_count") -> DataFrame:
    """The heaviest terms of each text: max(least, percent of its terms). Ties go to the term that sorts first."""
    found = weighted_terms(index, texts, coverage, by=by).where("weight > 0")
    w = Window.partitionBy("key")
    ranked = found.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("weight"), "term")))
    return ranked.where(F.col("rank") <= F.greatest(F.lit(least), F.floor(F.col("n") * percent / 100.0))).select("key", "rank", "term", "tf", "doc_count", "weight")


def feedback_terms(index: Index, value: str, least: int = 10, percent: float = 25.0, coverage: float = 8.0) -> DataFrame:
    """The terms of a feedback text that take part, with idf * tf."""
    one = index.spark.createDataFrame([("q", value)], "key string, text string")
    return key_terms(index, one, least, percent, coverage, by="doc_count").drop("key")


def term_weight(n_query: int, used: int, weight: float = 0.1, top: float = 1.0, negative: bool = False) -> float:
    """Weight of the feedback against the query: the fewer query words to used feedback terms, the less, within bounds."""
    import math

    w = weight if not n_query else max(weight, min(top, n_query / (math.log(used) + 1.0) if used else top))
    return -w if negative else w


def document_weights(index: Index, value: str, n_query: int = 0, negative: bool = False, weight: float = 0.1, **selection) -> DataFrame:
    """(doc_id, score): for each posting of a chosen term its idf, times the feedback weight."""
    chosen = feedback_terms(index, value, **selection)
    used = chosen.count()  # at most a share of one text's terms
    w = term_weight(n_query, used, weight, negative=negative)
    per = chosen.join(index.terms.select("term", "term_count"), "term").select("term", (scoring.idf_column("cosine", index.n_docs) * w).alias("w"))
    return index.postings.join(F.broadcast(per), "term").groupBy("doc_id").agg(F.sum("w").alias("score"))


def combined(scores: DataFrame, feedback: DataFrame) -> DataFrame:
    """The documents of a boolean result, with what feedback adds; the score stays above zero."""
    total = F.col("score") + F.coalesce("extra", F.lit(0.0))
    return scores.join(feedback.select("doc_id", F.col("score").alias("extra")), "doc_id", "left").select("doc_id", F.when(total < 0, F.lit(scoring.FLOOR)).otherwise(total).alias("score"))


def key_phrases(index: Index, texts: DataFrame, least: int = 10, percent: float = 20.0, coverage: float = 2.5) -> DataFrame:
    """Phrases between tabs, weighed by the sum of their terms' idf times their count in the text.

    A phrase with a stop, frequent, unknown or one-character term is left out.
    """
    c = index.config
    phrases = texts.select("key", F.explode(F.split("text", "\t")).alias("p")).select("key", F.lower(F.trim(F.regexp_replace("p", r"\s+", " "))).alias("phrase")).where("phrase <> ''")
    counted = phrases.groupBy("key", "phrase").agg(F.count(F.lit(1)).alias("n"))
    words = counted.select("key", "phrase", "n", F.explode(text.TOKENIZERS[c.tokenizer](F.col("phrase"))).alias("w")).withColumn("term", stemmers.stem(F.col("w"), c.stemmer, c.lang))
    known = index.terms.where(F.col("term_type") == REGULAR).select("term", "doc_count", "term_count")
    bad = F.col("doc_count").isNull() | (F.length("w") < 2) | (F.col("term_count") / F.lit(float(index.n_docs)) > coverage / 100.0)
    sums = words.join(known, "term", "left").groupBy("key", "phrase", "n").agg(F.bool_or(bad).alias("bad"), F.sum(scoring.idf_column("cosine", index.n_docs)).alias("idf"))
    found = sums.where("not bad").select("key", "phrase", "n", (F.col("idf") * F.col("n")).alias("weight"))
    w = Window.partitionBy("key")
    ranked = found.withColumn("all", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("weight"), "phrase")))
    return ranked.where(F.col("rank") <= F.greatest(F.lit(least), F.floor(F.col("all") * percent / 100.0))).select("key", "rank", "phrase", "n", "weight")


def top_terms(terms: DataFrame, n: int) -> DataFrame:
    return terms.orderBy(F.desc("weight"), "term").limit(n)


def texts(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(str(k), v) for k, v in enumerate(values)], "key string, text string")
