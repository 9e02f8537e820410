"""Order, pages, and forms of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylex.operators.scoring import relative_to_best

_ITEM_KINDS = {"int": "int", "uint": "bigint", "long": "bigint", "ulong": "bigint", "float": "float", "double": "double", "date": "bigint"}


def sort_key(sort: str, documents: DataFrame, kinds: dict[str, str] | None = None) -> tuple[Column | None, bool]:
    """(key, descending) of a sort modifier: default, none, relevance, rank, date, or an item with its type; anything else is the default."""
    if sort == "none":
        return None, True
    name, _, way = sort.partition(":")
    down = not way.lower().startswith("asc")
    name = name.strip().lower()
    if name in ("rank", "date"):
        return F.col("rank" if name == "rank" else "ansi_date").cast("double"), down
    item = f"item_{name}"
    if item in documents.columns:
        kind = _ITEM_KINDS.get((kinds or {}).get(name, "char"))
        if kind is None:
            return F.col(item), down
        return F.coalesce(F.col(item).try_cast(kind), F.lit(0)).cast("double"), down
    return F.round("score", 9), down if name == "relevance" else True  # equal but for the order of additions is equal


def ordered(scores: DataFrame, documents: DataFrame, sort: str = "default", kinds: dict[str, str] | None = None) -> DataFrame:
    """Scores in order; ties by doc_id. Only the columns that the key needs are joined."""
    key, down = sort_key(sort, documents, kinds)
    if key is None:
        return scores
    used = [c for c in ("rank", "ansi_date", *[d for d in documents.columns if d.startswith("item_")]) if c.removeprefix("item_") in ("rank", "ansi_date") or f"item_{sort.partition(':')[0].lower()}" == c]
    rows = scores if sort.startswith(("default", "relevance")) else scores.join(documents.select("doc_id", *used), "doc_id")
    rows = rows.withColumn("sort_key", key)
    return rows.orderBy(F.desc("sort_key") if down else F.asc("sort_key"), "doc_id").select(*scores.columns, "sort_key")


def page(rows: DataFrame, start: int = 0, end: int = 0, most: int | None = None) -> DataFrame:
    """Rows start to end of an order, zero-based and inclusive; an end of 0 is the end. most: cap of a server."""
    if end and end < start:
        return rows.limit(0)
    n = end - start + 1 if end else None
    if most is not None:
        n = most if n is None else min(n, most)
    out = rows.offset(start) if start else rows
    return out if n is None else out.limit(n)


def detailed(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents of a page: the narrow page is joined back, so that items are only read for its rows."""
    cols = [c for c in documents.columns if c != "doc_id"]
    return rows.join(documents.select("doc_id", *cols), "doc_id", "left")


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def as_notation(rows: DataFrame, style: str = "ruby") -> DataFrame:
    """Object notation of a scripting language: ruby's => between keys and values, python's None and True."""
    pairs = [F.concat(F.lit(f'"{c}"' + (" => " if style == "ruby" else ": ")), F.coalesce(F.when(F.lit(t == "string"), F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))).otherwise(F.col(c).cast("string")), F.lit("nil" if style == "ruby" else "None"))) for c, t in rows.dtypes]
    return rows.select(F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}")).alias("value"))


def as_xml(rows: DataFrame, tag: str = "result") -> DataFrame:
    def safe(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            v = F.replace(v, F.lit(a), F.lit(b))
        return F.concat(F.lit(f"<{c}>"), v, F.lit(f"</{c}>"))

    return rows.select(F.concat(F.lit(f"<{tag}>"), *[safe(c) for c in rows.columns], F.lit(f"</{tag}>")).alias("value"))


def as_rss(rows: DataFrame, link: str = "document?key=") -> DataFrame:
    """One <item> a row, with the share of the best score."""
    items = relative_to_best(rows).select(F.coalesce("title", F.lit("")).alias("title"), F.concat(F.lit(link), F.url_encode("doc_key")).alias("link"), F.round("relative", 6).alias("score"))
    return as_xml(items, "item")


def as_run(rows: DataFrame, topic: str, run: str = "run") -> DataFrame:
    """Lines of a retrieval evaluation's run file: topic Q0 key rank score run, scores as shares of the best."""
    from pyspark.sql import Window

    ranked = relative_to_best(rows).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(topic)).orderBy(F.desc(F.round("score", 9)), "doc_id")))  # a page of results
    return ranked.select(F.concat_ws(" ", F.lit(topic), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", F.col("relative")), F.lit(run)).alias("value"))


def write(rows: DataFrame, path: str, form: str = "json", **how) -> None:
    forms = {"json": as_json, "xml": as_xml, "rss": as_rss, "run": as_run, "ruby": as_notation, "python": lambda r: as_notation(r, "python")}
    forms[form](rows, **how).write.mode("overwrite").text(path)
