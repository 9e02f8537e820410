"""Boolean and proximity operators on postings: the joins and set operations of the engine.

A postings list is a DataFrame (doc_id, position, weight) with what is known when the plan is made: its term type, whether
it is required, and whether it is surely empty. OR keeps all postings, AND leaves one posting a document, ADJ and NEAR pair
positions. Everything joins on doc_id, so one exchange of each side serves a whole chain of operators.

With proximity, OR and AND also weigh words that stand right after each other PROXIMITY times, in the order of places within
a document (at one place the right side's postings come first, then lighter ones), each operator anew as the tree is folded.
Postings without places (0) have no neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylex.operators.scoring import PROXIMITY

UNKNOWN, REGULAR, STOP, FREQUENT = 0, 1, 2, 3


@dataclass
class Postings:
    df: DataFrame
    kind: int = REGULAR
    required: bool = False
    empty: bool = False  # known when the plan is made

    def nothing(self) -> Postings:
        return Postings(self.df.where(F.lit(False)), UNKNOWN, self.required, True)


def _kind(a: Postings, b: Postings) -> int:
    return STOP if a.kind == STOP and b.kind == STOP else UNKNOWN


def _docs(df: DataFrame) -> DataFrame:
    return df.select("doc_id").distinct()


def per_document(df: DataFrame) -> DataFrame:
    return df.groupBy("doc_id").agg(F.max("position").alias("position"), F.sum("weight").alias("weight"))


def _survivor(a: Postings, b: Postings, strict: bool) -> Postings | None:
    """What an AND, ADJ or NEAR gives if a side is known to be empty: the other side, nothing, or None if both have postings."""
    if not a.empty and not b.empty:
        return None
    for gone, other in ((a, b), (b, a)):
        if gone.empty and (gone.kind == STOP if strict else not gone.required):
            return other
    return a.nothing()


def _or_one(both: DataFrame, a: Postings, b: Postings, strict: bool) -> DataFrame:
    """Relaxed AND of lists whose emptiness only the run shows: if one has no posting, the other's documents stand."""
    if strict:
        return both
    key = F.lit(1).alias("k")
    for gone, other in ((a, b), (b, a)):
        if not gone.required:
            alone = per_document(other.df).withColumn("k", F.lit(1)).join(gone.df.limit(1).select(key), "k", "left_anti").drop("k")
            both = both.unionByName(alone.select(*both.columns))
    return both


def _in_order(a: DataFrame, b: DataFrame) -> tuple[DataFrame, Column]:
    """Both sides' postings with their side (left 1, right 0), and whether the one before in the document stands right before."""
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(0)))
    before = F.lag("position").over(Window.partitionBy("doc_id").orderBy("position", "side", "weight"))
    return both, F.coalesce((before > 0) & (F.col("position") == before + 1), F.lit(False))


def _weighed(a: DataFrame, b: DataFrame) -> DataFrame:
    """OR: a posting right after another weighs PROXIMITY times as much."""
    both, follows = _in_order(a, b)
    return both.withColumn("follows", follows).select("doc_id", "position", F.when(F.col("follows"), F.col("weight") * PROXIMITY).otherwise(F.col("weight")).alias("weight"))


def _accumulated(a: DataFrame, b: DataFrame) -> DataFrame:
    """AND: weights add up along a document, and what has added up is multiplied at each right posting right after another.

    A weight is multiplied as often as that happens from its own place on: a running count from the document's end. Documents
    of one side only are dropped; everything is in one exchange by document.
    """
    both, follows = _in_order(a, b)
    whole = Window.partitionBy("doc_id")
    both = both.withColumn("jump", (follows & (F.col("side") == 0)).cast("int")).withColumn("sides", F.max("side").over(whole) - F.min("side").over(whole)).where("sides = 1")
    rest = whole.orderBy("position", "side", "weight").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = both.withColumn("weight", F.col("weight") * F.pow(F.lit(PROXIMITY), F.sum("jump").over(rest)))
    return per_document(both)


def op_or(a: Postings, b: Postings, strict: bool = True, proximity: bool = False) -> Postings:
    """All postings of both; a required side turns it into IOR from that side, two of them into AND."""
    if a.empty or b.empty:
        gone, other = (a, b) if a.empty else (b, a)
        return a.nothing() if gone.required else other
    if a.required and b.required:
        return op_and(a, b, strict, proximity)
    if a.required:
        return op_ior(a, b)
    if b.required:
        return op_ior(b, a)
    return Postings(_weighed(a.df, b.df) if proximity else a.df.unionByName(b.df), _kind(a, b))


def op_ior(a: Postings, b: Postings) -> Postings:
    """Documents of the left side only, with the postings that both have there: a left outer join."""
    if a.empty or b.empty:
        gone, other = (a, b) if a.empty else (b, a)
        return a.nothing() if gone.required else other
    return Postings(a.df.unionByName(b.df.join(_docs(a.df), "doc_id", "left_semi")), _kind(a, b), a.required)


def op_xor(a: Postings, b: Postings) -> Postings:
    """All postings in documents that only one side has; both sides meet in one aggregation of flags."""
    if a.empty or b.empty:
        return b if a.empty else a
    tagged = a.df.withColumn("side", F.lit(1)).unionByName(b.df.withColumn("side", F.lit(2)))
    once = tagged.groupBy("doc_id").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo = hi").select("doc_id")
    return Postings(a.df.unionByName(b.df).join(once, "doc_id", "left_semi"), _kind(a, b))


def op_and(a: Postings, b: Postings, strict: bool = True, proximity: bool = False) -> Postings:
    """One posting for each common document: the last position and the sum of the weights."""
    if (one := _survivor(a, b, strict)) is not None:
        return one
    if proximity:
        return Postings(_or_one(_accumulated(a.df, b.df), a, b, strict), _kind(a, b), a.required or b.required)
    x, y = per_document(a.df), per_document(b.df).select("doc_id", F.col("position").alias("p2"), F.col("weight").alias("w2"))
    both = x.join(y, "doc_id").select("doc_id", F.greatest("position", "p2").alias("position"), (F.col("weight") + F.col("w2")).alias("weight"))
    return Postings(_or_one(both, a, b, strict), _kind(a, b), a.required or b.required)


def op_not(a: Postings, b: Postings) -> Postings:
    if a.empty:
        return a.nothing()
    return a if b.empty else Postings(a.df.join(_docs(b.df), "doc_id", "left_anti"), a.kind, a.required)


def _paired(pairs: DataFrame) -> DataFrame:
    """One posting for each right position: the best of its pairs."""
    return pairs.groupBy("doc_id", "position").agg(F.max("weight").alias("weight"))


def op_adj(a: Postings, b: Postings, distance: int = 1, strict: bool = True) -> Postings:
    """Phrase: the right position follows the left one by distance, or is the same; an equality join on document and place."""
    if (one := _survivor(a, b, strict)) is not None:
        return one
    left = a.df.where("position > 0").select("doc_id", F.explode(F.array(F.col("position"), F.col("position") + distance)).alias("position"), F.col("weight").alias("w1"))
    pairs = left.join(b.df.where("position > 0"), ["doc_id", "position"]).select("doc_id", "position", ((F.col("w1") + F.col("weight")) * PROXIMITY).alias("weight"))
    return Postings(_or_one(_paired(pairs), a, b, strict), _kind(a, b), a.required or b.required)


def op_near(a: Postings, b: Postings, distance: int = 10, sign: str = "", strict: bool = True) -> Postings:
    """Positions at most distance apart: in any order, left before right (+) or right before left (-).

    A range join by cells: each left position is dealt to its cell of the width of the distance and to the next ones, so
    that it meets all right positions in reach by an equality join, however often both terms occur.
    """
    if (one := _survivor(a, b, strict)) is not None:
        return one
    width = max(distance, 1)
    cell = F.floor(F.col("position") / width)
    reach = {"": (-1, 0, 1), "+": (0, 1), "-": (-1, 0)}[sign]
    left = a.df.where("position > 0").select("doc_id", F.col("position").alias("p1"), F.col("weight").alias("w1"), F.explode(F.array(*[cell + d for d in reach])).alias("cell"))
    right = b.df.where("position > 0").withColumn("cell", cell)
    gap = F.col("position") - F.col("p1")
    test = {"": F.abs(gap) <= distance, "+": (gap >= 0) & (gap <= distance), "-": (gap <= 0) & (gap >= -distance)}[sign]
    pairs = left.join(right, ["doc_id", "cell"]).where(test).select("doc_id", F.greatest("position", "p1").alias("position"), ((F.col("w1") + F.col("weight")) * PROXIMITY).alias("weight"))
    return Postings(_or_one(_paired(pairs), a, b, strict), _kind(a, b), a.required or b.required)


# --- document weights (doc_id, score) and document sets (doc_id) ---------------------------------------------------------


def weights(op: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """or: sums; and: sums where both are positive; xor: where one is; not: the left where the right isn't positive."""
    r = b.select("doc_id", F.col("score").alias("other"))
    both = a.join(r, "doc_id", "full").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("l"), F.coalesce("other", F.lit(0.0)).alias("r"))
    keep = {"or": F.lit(True), "and": (F.col("l") > 0) & (F.col("r") > 0), "xor": (F.col("l") > 0) != (F.col("r") > 0), "not": (F.col("l") > 0) & ~(F.col("r") > 0)}[op]
    return both.where(keep).select("doc_id", (F.col("l") if op == "not" else F.col("l") + F.col("r")).alias("score"))


def sets(op: str, a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = _docs(a), _docs(b)
    if op == "or":
        return a.union(b).distinct()
    if op == "and":
        return a.join(b, "doc_id", "left_semi")
    if op == "not":
        return a.join(b, "doc_id", "left_anti")
    return a.unionByName(b).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("doc_id")
