"""Matching rows against a short stated list of targets (EXT-17, JOIN-06), site addresses (EXT-19) and listings (SRC-32..34)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Targets are literals of the plan, matched in the scan of the rows; a longer list should be a table and a join.
MAX_TARGETS = 1000


def _literals(targets: list[str]) -> Column:
    if len(targets) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    return F.array(*map(F.lit, dict.fromkeys(targets)))


def unquote(url: Column) -> Column:
    """Percent-decoded; a plus sign stays, and so does all of a value that can't be decoded."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def page_lookup(pages: DataFrame, paths: list[str]) -> DataFrame:
    """(path, pos, url): for each path the first page (pos, url, name, title) that ANY of four rules matches.

    The rules (path within the address; name; name without extension; title within the file name or the reverse) are
    one condition, not an order of preference. A path without a match has no row. One scan, then one
    partial minimum a path: nothing but the winners is shuffled.
    """
    bare = lambda c: F.lower(F.replace(c, F.lit(".aspx")))
    blank = F.lit(" ")
    rows = pages.select("pos", "url", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("title", F.lit("")).alias("title"), F.explode(_literals(paths)).alias("path"))
    path = unquote(F.btrim("path", F.lit("/")))
    file = F.element_at(F.split(path, "/"), -1)
    title = F.replace(F.lower("title"), blank)
    stem = F.replace(F.replace(bare(file), blank), F.lit("_"))
    named = (F.col("name") != "") & ((F.lower(file) == F.lower("name")) | (bare(file) == bare(F.col("name"))))
    titled = (F.col("title") != "") & (F.contains(stem, title) | F.contains(title, stem))
    hit = F.contains(F.lower(unquote(F.coalesce("url", F.lit("")))), F.lower(path)) | named | titled
    return rows.filter(hit).groupBy("path").agg(F.min(F.struct("pos", "url")).alias("p")).select("path", "p.pos", "p.url")


def first_mention(docs: DataFrame, targets: list[str], title: str, head: int = 500) -> DataFrame:
    """(target, doc_id, n_chars, is_short): the first document with the target in its title or in the head of its text, whatever the case.

    A target that nothing mentions has no row.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.lower(F.coalesce(title, F.lit(""))).alias("t"), F.substring(F.lower(text), 1, head).alias("h"), F.length(text).cast("long").alias("n_chars"))
    rows = rows.select("*", F.explode(_literals(targets)).alias("target"))
    found = rows.filter(F.contains("t", F.lower("target")) | F.contains("h", F.lower("target")))
    best = found.groupBy("target").agg(F.min(F.struct("doc_id", "n_chars")).alias("b"))
    return best.select("target", "b.doc_id", "b.n_chars", (F.col("b.n_chars") < 200).alias("is_short"))


def site_address(url: Column, base: str) -> Column:
    """``base``/host:/.../sites/name of a page address; null if the path names no site."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    parts = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    at = F.array_position(parts, "sites").cast("int")
    site = F.concat(F.lit(base), host, F.lit(":/"), F.array_join(F.slice(parts, F.lit(1), at + 1), "/"))
    return F.when((at > 0) & (F.size(parts) > at), site)


def enumerate_nested(users: DataFrame, meetings: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Transcripts of users' meetings, those with content: (user_id, ...), (user_id, meeting_id, ...), (meeting_id, content, ...)."""
    return users.join(meetings, "user_id").join(transcripts.filter(F.col("content") != ""), "meeting_id")


def by_suffix(listings: list[DataFrame], suffixes: list[str], limit: int | None = None) -> DataFrame:
    """All listings' files (name, ...) with one of the suffixes; a file found twice stays twice. ``limit``: the first by name."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), listings)
    rows = rows.filter(reduce(lambda a, b: a | b, [F.lower("name").endswith(s) for s in suffixes]))
    return rows.orderBy("name").limit(limit) if limit else rows


def first_nonempty(sources: list[DataFrame]) -> DataFrame:
    """The first source that has a row, else the last one."""
    return next((s for s in sources[:-1] if not s.isEmpty()), sources[-1])
