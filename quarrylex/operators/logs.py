"""Usage statistics from server logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LINE = r"^(\d+): (\d+): (\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}) ([+-]\d{4}): (\w+): (.*)$"
_OLD = r"^(\d+): (\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}) ([+-]\d{4}): (\w+): (.*)$"


def _kind(m: Column) -> Column:
    tests = (("search", "^Search, index"), ("search_error", "^Search.*(?:failed|error)"), ("retrieval", "^(?:Retrieval|Retrieved|Document)"), ("feedback", "^Relevance feedback"), ("connect", "^(?:Client|Connection|Accepted|Connect)"), ("close", "^(?:Finished handling|Closed)"))
    out = None
    for name, pattern in tests:
        out = F.when(m.rlike(pattern), name) if out is None else out.when(m.rlike(pattern), name)
    return out.otherwise("other")


def parse(lines: DataFrame) -> DataFrame:
    """Lines of text (value) as (process, entry, ts, level, kind, indexes, search, found, returned, seconds, client, message)."""
    v = F.col("value")
    new = v.rlike(_LINE)
    part = lambda i, j: F.when(new, F.regexp_extract(v, _LINE, i)).otherwise(F.regexp_extract(v, _OLD, j))
    base = lines.where(new | v.rlike(_OLD)).select(
        part(1, 1).cast("bigint").alias("process"), F.when(new, F.regexp_extract(v, _LINE, 2)).cast("bigint").alias("entry"),
        F.try_to_timestamp(F.concat(part(3, 2), F.lit(" "), part(4, 3)), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts"), part(5, 4).alias("level"), part(6, 5).alias("message"),
    )
    m = F.col("message")
    got = lambda p: F.nullif(F.regexp_extract(m, p, 1), F.lit(""))
    return base.select(
        "process", "entry", "ts", "level", _kind(m).alias("kind"), F.split(got(r"index(?:es)?: '([^']*)'"), r"\s*,\s*").alias("indexes"), got(r"search: '(.*)', found").alias("search"),
        got(r"found: (\d+)").cast("bigint").alias("found"), got(r"returned: (\d+)").cast("bigint").alias("returned"), got(r"in: ([\d.]+) seconds").cast("double").alias("seconds"), got(r"client: '?([^',]+)").alias("client"), "message",
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def counters(events: DataFrame, kind: str = "kind") -> DataFrame:
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def by_index(events: DataFrame) -> DataFrame:
    """Searches and errors of each index; a search of several counts for each."""
    return events.where(F.col("kind").isin("search", "search_error")).select(F.explode("indexes").alias("index_name"), "kind").groupBy("index_name").agg(F.count_if(F.col("kind") == "search").alias("searches"), F.count_if(F.col("kind") == "search_error").alias("errors"))


def by_client(events: DataFrame, client: str = "client", failed: Column | None = None) -> DataFrame:
    failed = F.col("kind") == "search_error" if failed is None else failed
    return events.groupBy(client).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("errors"))


def times(events: DataFrame, value: str = "seconds", *by: str) -> DataFrame:
    """Least, most, mean and (population) standard deviation."""
    return events.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def per_period(events: DataFrame, unit: str = "hour", ts: str = "ts") -> DataFrame:
    return events.groupBy(F.date_trunc(unit, F.col(ts)).alias(unit)).agg(F.count(F.lit(1)).alias("n"))


def concurrency(sessions: DataFrame, unit: str = "hour") -> DataFrame:
    """Most sessions (start, stop) open at once in each period. Steps of one second are summed before they are added up, and
    the running total is made day by day from the day's opening number, so that no task holds all rows.
    """
    steps = sessions.select(F.explode(F.array(F.struct(F.date_trunc("second", "start").alias("ts"), F.lit(1).alias("d")), F.struct(F.date_trunc("second", "stop").alias("ts"), F.lit(-1).alias("d")))).alias("s")).select("s.*")
    steps = steps.groupBy("ts").agg(F.sum("d").alias("d"), F.sum(F.greatest("d", F.lit(0))).alias("up")).withColumn("day", F.to_date("ts"))
    days = steps.groupBy("day").agg(F.sum("d").alias("net")).withColumn("before", F.coalesce(F.sum("net").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a day
    w = Window.partitionBy("day").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    run = steps.join(F.broadcast(days.select("day", "before")), "day").withColumn("open", F.col("before") + F.coalesce(F.sum("d").over(w), F.lit(0)) + F.col("up"))
    return run.groupBy(F.date_trunc(unit, "ts").alias(unit)).agg(F.max("open").alias("most"))


def slow(events: DataFrame, least: float, value: str = "seconds") -> DataFrame:
    return events.where(F.col(value) >= least).orderBy(F.desc(value), "ts")


def clean_search(search: Column) -> Column:
    """Searches that differ in modifiers, case or spaces count as one."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(search, r"\{[^}]*\}", " ")), r"\s+", " "))


def top(events: DataFrame, n: int, key: Column | None = None) -> DataFrame:
    key = clean_search(F.col("search")) if key is None else key
    return events.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(n)


def frequency(events: DataFrame, key: Column | None = None) -> DataFrame:
    """How many searches were made how often."""
    key = clean_search(F.col("search")) if key is None else key
    return events.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("times")).groupBy("times").agg(F.count(F.lit(1)).alias("searches"))


def script(events: DataFrame) -> DataFrame:
    """Replay commands: one search a line."""
    return events.where("search is not null").select(F.concat(F.lit('search "'), F.concat_ws(",", "indexes"), F.lit('" "'), F.regexp_replace("search", '"', '\\\\"'), F.lit('"')).alias("value"))


def report(events: DataFrame, path: str) -> None:
    """The aggregates as CSV tables below path."""
    tables = {"counters": counters(events), "levels": counters(events, "level"), "indexes": by_index(events), "clients": by_client(events), "times": times(events.where("kind = 'search'")), "hours": per_period(events.where("kind = 'search'")), "days": per_period(events.where("kind = 'search'"), "day"), "top": top(events.where("search is not null"), 100), "frequency": frequency(events.where("search is not null"))}
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
