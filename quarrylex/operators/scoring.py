"""Ranking: weights of postings, proximity, and length normalisation, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROXIMITY = 3.0
CO_OCCURRENCE = 1.2
FLOOR = 1e-10

RANKINGS = ("cosine", "none", "basic", "evolved", "sparck72", "croft79", "inquery", "bm25")


def idf(ranking: str, n_docs: float, doc_count: float, term_count: float) -> float:
    """Weight of one posting of a term, of which the driver knows the counts."""
    n, df, tc = float(n_docs), float(doc_count), float(term_count)
    if not df or not tc:
        return 0.0
    if ranking == "none":
        return 1.0
    if ranking == "basic":
        return 1.0 / tc
    if ranking == "evolved":
        return math.log(1.0 + n / df)
    if ranking == "sparck72":
        return math.log(n / df + 1.0)
    if ranking == "croft79":
        return math.log((n - df) / tc) if n > df else 1.0
    if ranking == "inquery":
        return math.log((n + 0.5) / df) / math.log(n + 1.0)
    if ranking == "bm25":
        return math.log(1.0 + (n - df + 0.5) / (df + 0.5))
    w = math.log(n / df)
    return w if w > 0 else 1.0


def idf_column(ranking: str, n_docs: int, df: str = "doc_count", tc: str = "term_count") -> Column:
    """The same for a table of terms."""
    n, d, t = F.lit(float(n_docs)), F.col(df).cast("double"), F.col(tc).cast("double")
    forms = {
        "none": F.lit(1.0), "basic": 1.0 / t, "evolved": F.log(1.0 + n / d), "sparck72": F.log(n / d + 1.0), "croft79": F.when(n > d, F.log((n - d) / t)).otherwise(F.lit(1.0)),
        "inquery": F.log((n + 0.5) / d) / F.log(n + 1.0), "bm25": F.log(1.0 + (n - d + 0.5) / (d + 0.5)),
    }
    return forms.get(ranking, F.when(F.log(n / d) > 0, F.log(n / d)).otherwise(F.lit(1.0)))


def document_scores(postings: DataFrame) -> DataFrame:
    """(doc_id, score): the sum of the weights, never below a small floor."""
    total = F.sum("weight")
    return postings.groupBy("doc_id").agg(F.when(total < 0, F.lit(FLOOR)).otherwise(total).alias("score"))


def normalised(scores: DataFrame, documents: DataFrame, how: str = "log") -> DataFrame:
    """Divide by the logarithm of the document's length plus one (log), by its length (raw), its base-2 logarithm (log2), or the average length (average)."""
    if how == "none":
        return scores
    joined = scores.join(documents.select("doc_id", "term_count"), "doc_id")
    n = F.col("term_count")
    if how == "average":
        mean = documents.agg(F.avg("term_count").alias("mean"))
        joined = joined.join(F.broadcast(mean))  # one row
        by = n / F.col("mean")
    else:
        by = {"log": F.log(n + 1.0), "raw": n.cast("double"), "log2": F.log2(n + 1.0)}[how]
    return joined.withColumn("score", F.when(n > 0, F.col("score") / by).otherwise(F.col("score"))).select(*scores.columns)


def proximity(postings: DataFrame, distance: int = 1) -> DataFrame:
    """Weights times PROXIMITY where the posting before in the document stands right next to it; within documents only."""
    w = Window.partitionBy("doc_id").orderBy("position")
    gap = F.col("position") - F.lag("position").over(w)
    return postings.withColumn("weight", F.when((gap > 0) & (gap <= distance), F.col("weight") * PROXIMITY).otherwise(F.col("weight")))


def co_occurrence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sum of two document scores, times CO_OCCURRENCE where both have the document."""
    r = right.select("doc_id", F.col("score").alias("other"))
    both = F.col("score").isNotNull() & F.col("other").isNotNull()
    total = F.coalesce("score", F.lit(0.0)) + F.coalesce("other", F.lit(0.0))
    return left.join(r, "doc_id", "full").select("doc_id", F.when(both, total * CO_OCCURRENCE).otherwise(total).alias("score"))


def relative_to_best(scores: DataFrame, key: str = "score") -> DataFrame:
    """A column with the share of the largest key, found by one aggregation that is joined back as one row."""
    best = scores.agg(F.max(key).alias("max_key"))
    return scores.join(F.broadcast(best)).withColumn("relative", F.when(F.col("max_key") > 0, F.col(key) / F.col("max_key")).otherwise(F.lit(0.0)))


def frequent(terms: DataFrame, n_docs: int, threshold: float) -> DataFrame:
    """terms with status frequent where occurrences per 100 documents exceed the threshold."""
    return terms.withColumn("frequent", (F.col("term_count") * 100.0 / F.lit(float(n_docs))) > threshold)
