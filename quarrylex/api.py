"""The search engine: physical and virtual indexes, searches with feedback, reports, and a cache of results."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylex.operators import catalog, feedback, filters, results, scoring
from quarrylex.operators.index import Index
from quarrylex.plans.ast import Query, leaves, show
from quarrylex.plans.compile import Plan, merged_reports
from quarrylex.plans.parser import parse


@dataclass
class Response:
    """Results of a search, lazily evaluated: all scored documents, the page asked for, and the report."""

    query: Query
    scored: DataFrame
    page: DataFrame
    report: DataFrame | None
    messages: tuple[str, ...] = ()

    def total(self) -> int:
        return self.scored.count()

    def max_key(self) -> float:
        return self.scored.agg(F.max("score")).first()[0] or 0.0


@dataclass
class Engine:
    """indexes by name; virtual names stand for several, as names or [regular expressions].

    ranking: weight of postings; length: normalisation of scores; global_idf: statistics over all indexes of a search
    together, instead of each index's own; proximity: OR and AND weigh words that stand right after each other more, which
    needs their places: without it a search of words is one scan and one aggregation. lists: paths of list filters by name.
    most: cap on documents returned. remembered: number of results that the cache holds; the oldest go first.
    """

    indexes: dict[str, Index]
    virtual: dict[str, list[str]] = field(default_factory=dict)
    ranking: str = "cosine"
    length: str = "log"
    global_idf: bool = False
    proximity: bool = True
    lists: dict[str, str] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    most: int | None = None
    clock: dt.datetime | None = None
    cache_mode: str = "off"  # off, read, write
    remembered: int = 100
    _cache: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def resolve(self, name: str) -> list[Index]:
        """The physical indexes of a name, of several with commas, or of a virtual one."""
        out: list[Index] = []
        for part in (p.strip() for p in name.split(",")):
            if part in self.indexes:
                out.append(self.indexes[part])
                continue
            for entry in self.virtual.get(part, [part] if part.startswith("[") else []):
                if entry.startswith("["):
                    out += [x for n, x in sorted(self.indexes.items()) if re.fullmatch(entry.strip("[]"), n)]
                elif entry in self.indexes:
                    out.append(self.indexes[entry])
        if not out:
            raise KeyError(f"no index {name}")
        return list({id(x): x for x in out}.values())

    def search(self, index: str, search: str = "", like: str = "", unlike: str = "", start: int = 0, end: int = 0, details: bool = False, **preset) -> Response:
        """search: query text; like, unlike: positive and negative feedback texts; start, end: page, zero-based and inclusive."""
        query = parse(search, self.clock, **preset)
        parts, reports = [], []
        found = self.resolve(index)
        several = self.global_idf and len(found) > 1
        narrow = {x.uid: self._narrowed(x, query, like, unlike) for x in found} if several else {}
        shared = self._global(list(narrow.values())) if several else (None, None)
        for x in found:
            key = sha256(repr((x.config, x.uid, show(query.root), sorted(map(str, query.modifiers.items())), like, unlike, self.ranking, self.length, self.global_idf, self.proximity)).encode()).hexdigest()
            if self.cache_mode != "off" and query.modifiers.get("search_cache") == "enable" and key in self._cache:
                parts.append(self._cache[key])
                continue
            own = narrow.get(x.uid) or self._narrowed(x, query, like, unlike)
            plan = Plan(own, query, self.ranking, *shared, proximity=self.proximity)
            part = self._scored(own, plan, query, like, unlike, x)
            if self.cache_mode == "write" and query.modifiers.get("search_cache") == "enable":
                part = part.cache()
                self._cache[key] = part
                while len(self._cache) > self.remembered:
                    self._cache.pop(next(iter(self._cache))).unpersist()
            parts.append(part)
            if query.modifiers.get("search_report") == "return":
                reports.append(plan.report())
        scored = reduce(DataFrame.unionByName, parts)
        documents = reduce(DataFrame.unionByName, [x.documents for x in found])
        if len(found) > 1:  # ids are unique within an index only
            rows = self._order_many(scored, documents, query)
        else:
            rows = results.ordered(scored, documents, query.modifiers.get("sort", "default"), self.kinds)
        page = results.page(rows, start, end, self.most)
        if query.modifiers.get("search_results") == "suppress":
            page = page.limit(0)
        if details:
            on = ["index_name", "doc_id"]
            page = page.join(documents, on, "left")
        return Response(query, scored, page, merged_reports(reports) if reports else None, query.messages)

    def _order_many(self, scored: DataFrame, documents: DataFrame, query: Query) -> DataFrame:
        key, down = results.sort_key(query.modifiers.get("sort", "default"), documents, self.kinds)
        if key is None:
            return scored
        rows = scored.join(documents.select("index_name", "doc_id", "rank", "ansi_date", *[c for c in documents.columns if c.startswith("item_")]), ["index_name", "doc_id"]) if query.modifiers.get("sort", "default") != "default" else scored
        rows = rows.withColumn("sort_key", key)
        return rows.orderBy(F.desc("sort_key") if down else F.asc("sort_key"), "index_name", "doc_id").select(*scored.columns, "sort_key")

    @staticmethod
    def _global(found: list[Index]) -> tuple[int, DataFrame]:
        terms = reduce(DataFrame.unionByName, [x.terms for x in found])
        merged = terms.groupBy("term").agg(F.max("term_type").alias("term_type"), F.sum("term_count").alias("term_count"), F.sum("doc_count").alias("doc_count"), F.array_distinct(F.flatten(F.collect_list("field_ids"))).alias("field_ids"), F.max("in_counts").alias("in_counts"))
        return sum(x.n_docs for x in found), merged

    @staticmethod
    def _narrowed(x: Index, query: Query, like: str = "", unlike: str = "") -> Index:
        """The index of the terms that the query, its filters and its feedback texts name."""
        words = [w for kind in ("inclusion_filter", "exclusion_filter") for group in query.modifiers.get(kind) or [] for w in group]
        test = Plan.test(x, query)
        if x.chosen is None or test is None or (query.root is None and not words and not like and not unlike):
            return x
        alike = feedback.words_of(x, *filter(None, (like, unlike))) if like or unlike else []
        return x.narrowed(lambda term: reduce(Column.__or__, [filters.term_test(x, w, term) for w in words] + ([term.isin(alike)] if alike else []), test(term)))

    def _scored(self, x: Index, plan: Plan, query: Query, like: str, unlike: str, whole: Index | None = None) -> DataFrame:
        mods = query.modifiers
        how = {"weight": mods.get("feedback_term_weight", 0.1), "least": mods.get("feedback_minimum_term_count", 10), "percent": mods.get("feedback_maximum_term_percentage", 25.0), "coverage": mods.get("feedback_maximum_term_coverage_threshold", 8.0)}
        words = len(leaves(query.root))
        given = [feedback.document_weights(x, text, words, neg, **how) for text, neg in ((like, False), (unlike, True)) if text]
        extra = reduce(DataFrame.unionByName, given).groupBy("doc_id").agg(F.sum("score").alias("score")) if given else None
        if query.root is None and extra is not None:
            docs = extra.where("score > 0")
        else:
            docs = plan.matches()
            docs = feedback.combined(docs, extra) if extra is not None else docs
        docs = filters.restrict(x, docs, mods, self.lists, whole)
        scored = scoring.normalised(docs, x.lengths, self.length) if query.root is not None or extra is not None else docs
        return scored.select(F.lit(x.config.name).alias("index_name"), "doc_id", "score")

    def forget(self) -> None:
        """Empty the cache of results."""
        for part in self._cache.values():
            part.unpersist()
        self._cache.clear()

    def counters(self, index: str, search: str) -> DataFrame:
        """(index_name, matched, failed_date, failed_language, not_included, excluded, returned) of a search: why documents that match its words aren't in its results."""
        query = parse(search, self.clock)
        parts = []
        for whole in self.resolve(index):
            x = self._narrowed(whole, query)
            counts = filters.counters(x, Plan(x, query, self.ranking, proximity=self.proximity).matches(), query.modifiers, self.lists, whole)
            parts.append(counts.select(F.lit(x.config.name).alias("index_name"), "*"))
        return reduce(DataFrame.unionByName, parts)

    # --- information ------------------------------------------------------------------------------------------------

    def index_info(self, name: str) -> DataFrame:
        return catalog.server_index_info(self.resolve(name))

    def field_info(self, name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [x.fields for x in self.resolve(name)])

    def term_info(self, name: str, match: str, value: str = "", fields: tuple[str, ...] = (), any_case: bool = False) -> DataFrame:
        parts = [catalog.term_info(x, match, value, fields, any_case) for x in self.resolve(name)]
        both = reduce(DataFrame.unionByName, parts)
        return both.groupBy("term").agg(F.max("term_type").alias("term_type"), F.sum("term_count").alias("term_count"), F.sum("doc_count").alias("doc_count"))

    def document_info(self, name: str, key: str) -> DataFrame:
        return catalog.document_info(self.resolve(name)[0], key)

    def retrieve(self, name: str, key: str, item: str, start: int = 0, end: int | None = None, unit: str = "bytes") -> DataFrame:
        return catalog.retrieve(self.resolve(name)[0], key, item, start, end, unit)
