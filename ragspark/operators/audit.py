"""Audits and monitors (AGG-06..08, AGG-14..17, ORD-02): counts across tables, changes between polls, page and citation checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Terms that a migration page should hold.
KEY_TERMS = ["migration", "features", "supported", "combination", "source", "destination"]
SHORT_PAGE = 200


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()))


def type_counts(rows: DataFrame, by: str, source_type: str) -> DataFrame:
    """(by, n) of the rows of one source_type, the most frequent first, equal ones by name."""
    return rows.filter(F.col("source_type") == source_type).groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def crawl_summary(documents: DataFrame) -> DataFrame:
    """One row over page documents (page_url, content_type, content): pages, documents of each type, characters."""
    kinds = [F.count_if(F.col("content_type") == k).alias(f"n_{k}") for k in ("faq", "table", "text")]
    return documents.agg(F.count_distinct("page_url").alias("n_pages"), F.count(F.lit(1)).alias("n_documents"), *kinds, F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("chars"))


def latest(rows: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The n newest rows, a report's size."""
    return rows.orderBy(F.desc(order)).limit(n)


def poll_changes(polls: DataFrame) -> DataFrame:
    """Adds delta, the change of n since a collection's previous poll (name, poll, n); null at the first."""
    return polls.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy("name").orderBy("poll")))


def page_audit(pages: DataFrame, content: str, terms: list[str] = KEY_TERMS, short: int = SHORT_PAGE) -> DataFrame:
    """Adds length, is_short and found_terms."""
    low = F.lower(F.coalesce(content, F.lit("")))
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, F.lower(t)))
    return pages.withColumn("length", F.length(F.coalesce(content, F.lit(""))).cast("long")).withColumn("is_short", F.col("length") < short).withColumn("found_terms", found)


def short_citation(file_name: Column, folder: Column) -> Column:
    """``[Source: f - folder]``; null without a file name."""
    inside = F.when(F.coalesce(folder, F.lit("")) != "", F.concat(F.lit(" - "), folder)).otherwise("")
    return F.when(F.coalesce(file_name, F.lit("")) != "", F.concat(F.lit("[Source: "), file_name, inside, F.lit("]")))


def citation_audit(rows: DataFrame, file_name: str, folder: str, answer: str) -> DataFrame:
    """Adds citation, is_valid and n_citations, the ``[Source:`` marks of the answer."""
    cited = rows.withColumn("citation", short_citation(F.col(file_name), F.col(folder)))
    return cited.withColumn("is_valid", F.col("citation").isNotNull()).withColumn("n_citations", F.regexp_count(answer, F.lit(r"\[Source:")).cast("long"))


def observed(rows: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """``rows`` with counters that a run fills on its way, at no extra pass: ``observation.get`` after an action."""
    seen = Observation(name)
    return rows.observe(seen, *[F.count_if(c).alias(k) for k, c in counters.items()]), seen
