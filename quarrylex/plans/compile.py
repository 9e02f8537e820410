"""From syntax tree to one DataFrame plan.

Terms are looked up first: one small job gives the counts of all words of the query, which fix weights, term types and what is
known to be empty. A query without positions or neighbours becomes a single scan of the postings of its terms and one aggregation by
document, whose flags and sums evaluate the whole tree. Else the operators of the algebra are composed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylex.functions import stemmers, stoplists
from quarrylex.operators import algebra, expand, scoring
from quarrylex.operators.algebra import STOP, Postings
from quarrylex.operators.index import Index
from quarrylex.plans.ast import Cluster, Node, Query, QueryError, Term, combines, leaves, positional

_BY_UDF = ("typo", "phonix", "metaphone", "soundslike")


@dataclass
class Leaf:
    """A term of the query as it is looked up: its form in the vocabulary, kind, counts and weight of a posting."""

    term: Term
    form: str
    field_ids: list[int] | None
    kind: int = algebra.REGULAR
    term_count: int = 0
    doc_count: int = 0
    weight: float = 0.0
    status: str = "regular"

    @property
    def expands(self) -> bool:
        return self.term.function not in ("", "literal")


class Plan:
    def __init__(self, index: Index, query: Query, ranking: str = "cosine", n_docs: int | None = None, terms: DataFrame | None = None, proximity: bool = True):
        self.index, self.query, self.ranking, self.proximity = index, query, ranking, proximity
        self.n_docs = index.n_docs if n_docs is None else n_docs
        self.terms = index.terms if terms is None else terms
        self.strict = query.modifiers.get("boolean_operation", "strict") == "strict"
        self.leaves = self._looked_up()

    # --- terms ------------------------------------------------------------------------------------------------------

    def _form(self, t: Term, stems: dict[str, str]) -> str:
        """Words all in upper case and literals as they are, other words stemmed."""
        config = self.index.config
        if t.function or t.text.isupper() or config.stemmer == "none":
            return t.text
        if config.stemmer in ("porter", "lovins") and config.lang.startswith("en"):
            return getattr(stemmers, config.stemmer)(t.text)
        return stems[t.text]

    def _stems(self, words: list[str]) -> dict[str, str]:
        """Plural stems of all words of the query, by one small job."""
        if not words or self.index.config.stemmer in ("none", "porter", "lovins") and (self.index.config.stemmer == "none" or self.index.config.lang.startswith("en")):
            return {}
        table = self.index.spark.createDataFrame([(w,) for w in words], "w string")
        return {r["w"]: r["s"] for r in table.select("w", stemmers.plural(F.col("w"), self.index.config.lang).alias("s")).collect()}

    def _looked_up(self) -> dict[Term, Leaf]:
        default = tuple(self.query.modifiers.get("unfielded_search_field_names") or self.index.config.default_fields)
        stems = self._stems(sorted({t.text for t in leaves(self.query.root) if not t.function and not t.text.isupper()}))
        found = {t: Leaf(t, self._form(t, stems), self.index.field_ids(t.fields or default)) for t in dict.fromkeys(leaves(self.query.root))}
        exact = [x for x in found.values() if not x.expands]
        words = sorted({x.form for x in exact} | {x.term.text for x in exact})
        counts = {}
        if words:  # as many rows as the query has words
            rows = self.terms.where(F.col("term").isin(words)).groupBy("term").agg(F.sum("term_count").alias("tc"), F.sum("doc_count").alias("dc"), F.max("term_type").alias("kind")).collect()
            counts = {r["term"]: r for r in rows}
        threshold = self.query.modifiers.get("frequent_term_coverage_threshold")
        drop = self.query.modifiers.get("frequent_terms") == "drop" and threshold is not None and len(found) > 1
        for x in found.values():
            w = x.term.weight if x.term.weight is not None else self.query.modifiers.get("term_weight", 1.0)
            if x.expands:
                x.weight, x.status = w, "expanded"
                continue
            row = counts.get(x.form)
            if row is None and x.term.function == "" and stoplists.LISTS and str(x.form).lower() in (stoplists.LISTS[self.index.config.stop_list] if isinstance(self.index.config.stop_list, str) else self.index.config.stop_list):
                x.kind, x.status = STOP, "stop"
                continue
            if row is None:
                x.status = "missing"
                continue
            x.term_count, x.doc_count = row["tc"], row["dc"]
            x.weight = scoring.idf(self.ranking, self.n_docs, row["dc"], row["tc"]) * w
            if row["kind"] == STOP:
                x.kind, x.status = STOP, "stop"
            elif drop and row["tc"] * 100.0 / max(self.n_docs, 1) > threshold:
                x.kind, x.status = STOP, "frequent"
        return found

    @classmethod
    def test(cls, index: Index, query: Query) -> Callable[[Column], Column] | None:
        """The test that all terms of a query pass, for Index.narrowed; None: it has UDFs, which are for vocabularies only."""
        if any(t.function in _BY_UDF for t in leaves(query.root)):
            return None
        plan = cls.__new__(cls)
        plan.index, plan.query = index, query
        stems = plan._stems(sorted({t.text for t in leaves(query.root) if not t.function and not t.text.isupper()}))
        exact = [t for t in leaves(query.root) if t.function in ("", "literal")]
        words = sorted({plan._form(t, stems) for t in exact} | {t.text for t in exact})
        expanded = {(t.function, t.text) for t in leaves(query.root)} - {(t.function, t.text) for t in exact}
        return lambda term: reduce(Column.__or__, [expand.predicate(term, *e) for e in sorted(expanded)], term.isin(words) if words else F.lit(False))

    def _stored_stop(self, x: Leaf) -> bool:
        """A stop term is searched where its fields keep stop terms, never if it was demoted for its frequency."""
        ids = x.field_ids or range(1, len(self.index.config.fields) + 1)
        return x.status == "stop" and any(not self.index.config.fields[i - 1].stop for i in ids)

    def _postings(self, x: Leaf) -> Postings:
        base = self.index.postings
        if x.field_ids:
            base = base.where(F.col("field_id").isin(x.field_ids))
        if x.expands:
            chosen = expand.expand(self.terms, x.term.function, x.term.text, x.field_ids).where(F.col("term_type") == algebra.REGULAR)
            chosen = chosen.select("term", (scoring.idf_column(self.ranking, self.n_docs) * x.weight).alias("weight"))
            return Postings(base.join(chosen, "term").select("doc_id", "position", "weight"), required=x.term.required)
        rows = base.where(F.col("term") == x.form).select("doc_id", "position", F.lit(float(x.weight)).alias("weight"))
        empty = x.doc_count == 0 or (x.kind == STOP and not self._stored_stop(x))
        return Postings(rows.where(F.lit(False)) if empty else rows, x.kind, x.term.required, empty)

    # --- trees ------------------------------------------------------------------------------------------------------

    def evaluate(self, node: Node) -> Postings:
        if isinstance(node, Term):
            return self._postings(self.leaves[node])
        out, skipped = self.evaluate(node.items[0]), 0
        for item in node.items[1:]:
            right = self.evaluate(item)
            if node.op in ("adj", "near") and right.empty and right.kind == STOP:
                skipped += 1  # the words after it are one place further on
                continue
            if node.op == "or":
                out = algebra.op_or(out, right, self.strict, self.proximity)
            elif node.op == "ior":
                out = algebra.op_ior(out, right)
            elif node.op == "xor":
                out = algebra.op_xor(out, right)
            elif node.op == "and":
                out = algebra.op_and(out, right, self.strict, self.proximity)
            elif node.op == "not":
                out = algebra.op_not(out, right)
            elif node.op == "adj":
                out = algebra.op_adj(out, right, (node.distance or 1) + skipped, self.strict)
                skipped = 0
            elif node.op == "near":
                out = algebra.op_near(out, right, (10 if node.distance is None else node.distance) + skipped, node.sign, self.strict)
                skipped = 0
            else:
                raise QueryError(f"unknown operator {node.op}")
        out.required = out.required or node.required
        return out

    def _masked(self) -> bool:
        """One aggregation is enough: no positions, no relaxed emptiness, and no stop or required word that changes a rule."""
        return self.strict and not (self.proximity and combines(self.query.root)) and not positional(self.query.root) and not any(x.term.required or x.kind == STOP for x in self.leaves.values()) and not _required_cluster(self.query.root) and len(self.leaves) <= 62

    def matches(self) -> DataFrame:
        """(doc_id, score) before length normalisation."""
        root = self.query.root
        if root is None:
            return self.index.documents.select("doc_id", F.lit(0.0).alias("score"))
        if self._masked():
            return self._one_scan(root)
        return scoring.document_scores(self.evaluate(root).df)

    def _one_scan(self, root: Node) -> DataFrame:
        keys = list(self.leaves)
        scans = []
        plain = [(k, x) for k, x in enumerate(self.leaves.values()) if not x.expands]
        if plain:  # one pass over the postings of all words
            forms = sorted({x.form for _, x in plain})
            base = self.index.postings.where(F.col("term").isin(forms))
            tags = F.array(*[F.when((F.col("term") == x.form) & (F.col("field_id").isin(x.field_ids) if x.field_ids else F.lit(True)), F.struct(F.lit(k).alias("k"), F.lit(float(x.weight)).alias("w"))) for k, x in plain])
            scans.append(base.select("doc_id", F.explode(F.array_compact(tags)).alias("t")).select("doc_id", "t.k", "t.w") if len(plain) > len(forms) or any(x.field_ids for _, x in plain) else base.select("doc_id", *_tagged(plain)))
        for k, x in enumerate(self.leaves.values()):
            if x.expands:
                scans.append(self._postings(x).df.select("doc_id", F.lit(k).alias("k"), F.col("weight").alias("w")))
        rows = scans[0]
        for s in scans[1:]:
            rows = rows.unionByName(s)
        sums = [F.sum(F.when(F.col("k") == k, F.col("w"))).alias(f"w{k}") for k in range(len(keys))]
        docs = rows.groupBy("doc_id").agg(*sums)
        there, score = self._flags(root, keys)
        return docs.where(there).select("doc_id", F.when(score < 0, F.lit(scoring.FLOOR)).otherwise(score).alias("score"))

    def _flags(self, node: Node, keys: list[Term]) -> tuple[Column, Column]:
        """Whether a document matches, and its score, from the sums of the leaves."""
        if isinstance(node, Term):
            w = F.col(f"w{keys.index(node)}")
            return w.isNotNull(), F.coalesce(w, F.lit(0.0))
        here, score = self._flags(node.items[0], keys)
        for item in node.items[1:]:
            h, s = self._flags(item, keys)
            zero = F.lit(0.0)
            if node.op == "and":
                here, score = here & h, score + s
            elif node.op == "or":
                here, score = here | h, F.when(here, score).otherwise(zero) + F.when(h, s).otherwise(zero)
            elif node.op == "ior":
                score = score + F.when(h, s).otherwise(zero)
            elif node.op == "xor":
                here, score = here != h, F.when(here, score).otherwise(s)
            else:
                here = here & ~h
        return here, score

    def report(self) -> DataFrame:
        """(term, fields, function, weight, term_count, doc_count, status); counts of -1 stop, -2 missing, -3 frequent words."""
        special = {"stop": -1, "missing": -2, "frequent": -3}
        rows, sums = [], []
        for k, x in enumerate(self.leaves.values()):
            if x.expands:
                sums.append(expand.expand(self.terms, x.term.function, x.term.text, x.field_ids).agg(F.sum("term_count").alias("a"), F.sum("doc_count").alias("b")).withColumn("k", F.lit(k)))
        expanded = {r["k"]: r for r in reduce(DataFrame.unionByName, sums).collect()} if sums else {}  # a row for each expanded term
        for k, x in enumerate(self.leaves.values()):
            tc, dc = x.term_count, x.doc_count
            if x.expands:
                tc, dc = expanded[k]["a"] or 0, expanded[k]["b"] or 0
            code = special.get(x.status)
            rows.append((x.form, ",".join(x.term.fields), x.term.function, float(x.weight), code if code else tc, code if code else dc, x.status))
        return self.index.spark.createDataFrame(rows, "term string, fields string, function string, weight double, term_count long, doc_count long, status string")


def _tagged(plain: list[tuple[int, Leaf]]) -> tuple[Column, Column]:
    k = w = None
    for i, x in plain:
        test = F.col("term") == x.form
        k = F.when(test, i) if k is None else k.when(test, i)
        w = F.when(test, float(x.weight)) if w is None else w.when(test, float(x.weight))
    return k.alias("k"), w.alias("w")


def _required_cluster(node: Node | None) -> bool:
    return isinstance(node, Cluster) and (node.required or any(map(_required_cluster, node.items)))


def merged_reports(reports: list[DataFrame]) -> DataFrame:
    """Reports of several indexes: real counts are summed, and win over stop, missing and frequent marks."""
    all_ = reports[0]
    for r in reports[1:]:
        all_ = all_.unionByName(r)
    real = lambda c: F.sum(F.when(F.col(c) >= 0, F.col(c)))
    return all_.groupBy("term", "fields", "function").agg(F.max("weight").alias("weight"), F.coalesce(real("term_count"), F.max("term_count")).alias("term_count"), F.coalesce(real("doc_count"), F.max("doc_count")).alias("doc_count"), F.min("status").alias("status"))
