"""Remote listings as Spark data sources (SRC-01, SRC-02, SRC-25, SRC-41): ``spark.read.format("json_pages")``, ``"web_listing"``, ``"linked_pages"``, ``"offset_rows"``.

All take ``server``, the ``module:Class`` of what fetches, made in every task from the source's options: its ``fetch(address)`` returns a payload, nothing, or fails.

* ``json_pages`` (start, last, pages_per_task): numbered pages of JSON arrays, both ends included, a range of pages a partition; rows (page, pos, item, state).
  An empty, broken or failing page has one row whose state says so, and ends its range; ``listing`` cuts what lies after the first of these. Its
  stream has page numbers as offsets: a restart goes on with the first page it has not read; the server's ``last()`` is the newest page.
* ``web_listing`` (urls: JSON array of addresses, start, last, per_page, pages_per_task): each address is read as it is, if its query names a page, else page by
  page, its other parameters kept; rows (url, page, pos, item, state), which ``listing`` cuts address by address.
* ``linked_pages`` (roots: JSON array of addresses, items, next): pages that name their successor, one partition for each root, to the end or
  to an address met before; rows (root, n, pos, item, state).
* ``offset_rows`` (total, page, pages_per_task): rows by offset and limit, ``fetch("offset-limit")``; a page that fails or is short is read row by row,
  and rows that fail stay, with ok = false; rows (offset, ok, item).
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import parse_qsl, urlencode, urlsplit
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ragspark.tables import partitions

ITEM, EMPTY, FAILED = "item", "empty", "failed"


def _server(options: dict[str, str]) -> Any:
    module, _, name = options["server"].partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


def _items(payload: str | None) -> list[str]:
    rows = json.loads(payload) if payload and payload.strip() else []
    if not isinstance(rows, list):
        raise ValueError("no array")
    return [r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows]


class Range(InputPartition):
    """Numbers from start up to, without, end."""

    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


#: Partitions of a read at most, about; beyond, neighbouring ranges share one.
MAX_TASKS = 2_000


class Group(InputPartition):
    """Partitions that one task reads one after the other."""

    def __init__(self, parts: list):
        super().__init__(len(parts))
        self.parts = parts


def _grouped(parts: list) -> list[Group]:
    each = -(-len(parts) // MAX_TASKS)
    return [Group(parts[i : i + each]) for i in range(0, len(parts), each)]


class Root(InputPartition):
    def __init__(self, address: str):
        super().__init__(address)
        self.address = address


def _ranges(start: int, end: int, size: int) -> list[Range]:
    # Spark needs one partition at least.
    return [Range(a, min(a + size, end)) for a in range(start, end, size)] or [Range(0, 0)]


class _Read:
    def __init__(self, options: dict[str, str]):
        self.options = options

    def number(self, name: str, default: int) -> int:
        return int(self.options.get(name, default))


def _page_rows(server: Any, pages: Range, address: Callable[[int], str] = str) -> Iterator[tuple]:
    for page in range(pages.start, pages.end):
        try:
            items = _items(server.fetch(address(page)))
        except Exception:  # the listing ends at a page that fails, as at an empty one
            yield page, None, None, FAILED
            return
        if not items:
            yield page, None, None, EMPTY
            return
        for pos, item in enumerate(items):
            yield page, pos, item, ITEM


class _Pages(_Read, DataSourceReader):
    def partitions(self) -> list[Group]:
        return _grouped(_ranges(self.number("start", 1), self.number("last", 1) + 1, self.number("pages_per_task", 8)))

    def read(self, partition: Group) -> Iterator[tuple]:
        server = _server(self.options)
        for pages in partition.parts:
            yield from _page_rows(server, pages)


class _NewPages(_Read, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": self.number("start", 1)}

    def latestOffset(self) -> dict:
        return {"page": max(self.number("start", 1), int(_server(self.options).last()) + 1)}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        return _grouped(_ranges(start["page"], end["page"], self.number("pages_per_task", 8)))

    def read(self, partition: Group) -> Iterator[tuple]:
        server = _server(self.options)
        for pages in partition.parts:
            yield from _page_rows(server, pages)

    def commit(self, end: dict) -> None:
        pass


class JsonPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "page long, pos int, item string, state string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _NewPages(dict(self.options))


def page_address(url: str, page: int, per_page: int) -> str:
    """The address of one page of a listing: other parameters stay, ``page`` and ``per_page`` are set anew."""
    parts = urlsplit(url)
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in ("page", "per_page")]
    return parts._replace(query=urlencode([*kept, ("per_page", per_page), ("page", page)]), fragment="").geturl()


def is_single(url: str) -> bool:
    return any(k == "page" for k, _ in parse_qsl(urlsplit(url).query, keep_blank_values=True))


class Site(InputPartition):
    """Pages of one address; of one that is read as it is there is one page."""

    def __init__(self, url: str, pages: Range, single: bool):
        super().__init__(url)
        self.url, self.pages, self.single = url, pages, single


class _Sites(_Read, DataSourceReader):
    def partitions(self) -> list[Group]:
        start, out = self.number("start", 1), []
        for url in dict.fromkeys(json.loads(self.options["urls"])):
            single = is_single(url)
            ranges = [Range(start, start + 1)] if single else _ranges(start, self.number("last", 1) + 1, self.number("pages_per_task", 8))
            out += [Site(url, r, single) for r in ranges]
        return _grouped(out or [Site("", Range(0, 0), True)])

    def read(self, partition: Group) -> Iterator[tuple]:
        server, size = _server(self.options), self.number("per_page", 100)
        for site in partition.parts:
            for row in _page_rows(server, site.pages, lambda page, site=site: site.url if site.single else page_address(site.url, page, size)):
                yield (site.url, *row)


class WebListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web_listing"

    def schema(self) -> str:
        return "url string, page long, pos int, item string, state string"

    def reader(self, schema) -> DataSourceReader:
        return _Sites(dict(self.options))


class _Links(_Read, DataSourceReader):
    def partitions(self) -> list[Root]:
        return [Root(a) for a in dict.fromkeys(json.loads(self.options["roots"]))] or [Root("")]

    def read(self, partition: Root) -> Iterator[tuple]:
        server, met, n = _server(self.options), set(), 0
        address: str | None = partition.address
        while address and address not in met:
            met.add(address)
            n += 1
            try:
                body = json.loads(server.fetch(address) or "null")
                items, then = _items(json.dumps(body.get(self.options.get("items", "value")) or [])), body.get(self.options.get("next", "next"))
            except Exception:  # what was read before stays
                yield partition.address, n, None, None, FAILED
                return
            if not items:
                yield partition.address, n, None, None, EMPTY
            for pos, item in enumerate(items):
                yield partition.address, n, pos, item, ITEM
            address = then


class LinkedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linked_pages"

    def schema(self) -> str:
        return "root string, n int, pos int, item string, state string"

    def reader(self, schema) -> DataSourceReader:
        return _Links(dict(self.options))


class _Offsets(_Read, DataSourceReader):
    def partitions(self) -> list[Group]:
        return _grouped(_ranges(0, self.number("total", 0), self.number("page", 50) * self.number("pages_per_task", 8)))

    def read(self, partition: Group) -> Iterator[tuple]:
        server, page = _server(self.options), self.number("page", 50)

        def fetched(start: int, size: int) -> list[str]:
            items = _items(server.fetch(f"{start}-{size}"))
            if len(items) != size:
                raise ValueError("short page")
            return items

        for start, end in ((a, r.end) for r in partition.parts for a in range(r.start, r.end, page)):
            size = min(page, end - start)
            try:
                for i, item in enumerate(fetched(start, size)):
                    yield start + i, True, item
            except Exception:  # a corrupt page is read row by row
                for at in range(start, start + size):
                    try:
                        row = fetched(at, 1)[0]
                    except Exception:
                        row = None
                    yield at, row is not None, row


class OffsetRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "offset_rows"

    def schema(self) -> str:
        return "offset long, ok boolean, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Offsets(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (JsonPages, WebListing, LinkedPages, OffsetRows):
        spark.dataSource.register(source)


def listing(pages: DataFrame) -> DataFrame:
    """The rows of ``json_pages`` or ``web_listing`` before the first page, of each address, that is empty or fails, without their state."""
    by = ["url"] if "url" in pages.columns else []
    ended = pages.filter(F.col("state") != ITEM)
    rows = pages.filter(F.col("state") == ITEM)
    if by:
        rows = rows.join(ended.groupBy("url").agg(F.min("page").alias("_end")), "url", "left")
    else:
        # One row: the end of the listing.
        rows = rows.join(F.broadcast(ended.agg(F.min("page").alias("_end"))))
    return rows.filter(F.col("_end").isNull() | (F.col("page") < F.col("_end"))).select(*by, "page", "pos", "item")


def joined_posts(rows: DataFrame) -> DataFrame:
    """(url, n_posts, text): the rendered contents of an address's posts, in order, a blank line between: one text an address, so one listing must fit a row.
    Posts without contents are left out; ``operators.rebuild.web_documents`` cuts post by post instead."""
    body = F.get_json_object("item", "$.content.rendered")
    posts = F.array_sort(F.collect_list(F.struct("page", "pos", body.alias("body"))))
    return rows.filter(body.isNotNull()).groupBy("url").agg(F.count(F.lit(1)).alias("n_posts"), F.array_join(F.transform(posts, lambda x: x["body"]), "\n\n").alias("text"))


#: Addresses of one file of payloads, about; files read last that a server keeps.
PER_FILE, KEPT = 256, 4


def _bucket(address: str, of: int) -> int:
    """The file of an address. The last digit of each number in it does not count, so neighbours lie in one file."""
    return crc32(re.sub("([0-9]*)[0-9]", r"\1", address).encode()) % of


class Folder:
    """A server over a folder that Spark wrote (``write_payloads``): option ``path``; an address nobody wrote has no payload.

    A fetch reads the file of its address, which is of bounded size, unless it is among the last that were read.
    """

    def __init__(self, options: dict[str, str]):
        from pyarrow import fs

        path = options["path"]
        self.files, self.path = fs.FileSystem.from_uri("file://" + path[len("file:") :] if path.startswith("file:/") and not path.startswith("file://") else path)
        self.counts = sorted(int(f.base_name.partition("=")[2]) for f in self._below(self.path) if f.base_name.startswith("of="))
        self.read: dict[str, dict[str, str]] = {}

    def _below(self, path: str) -> list:
        from pyarrow import fs

        return self.files.get_file_info(fs.FileSelector(path, allow_not_found=True))

    def _parts(self, path: str) -> list[str]:
        return sorted(f.path for f in self._below(path) if f.base_name.startswith("part-"))

    def _payloads(self, bucket: str) -> dict[str, str]:
        """Payloads by address; those of one address one after the other, each a line at least."""
        import pyarrow.parquet as pq

        if bucket not in self.read:
            got: dict[str, str] = {}
            for path in self._parts(bucket):
                with self.files.open_input_file(path) as file:
                    table = pq.read_table(file, columns=["address", "payload"])
                for address, payload in zip(table["address"].to_pylist(), table["payload"].to_pylist(), strict=True):
                    got[address] = f"{got.get(address, '')}{payload or ''}\n"
            while len(self.read) >= KEPT:
                del self.read[next(iter(self.read))]
            self.read[bucket] = got
        return self.read[bucket]

    def fetch(self, address: str) -> str | None:
        return "".join(self._payloads(f"{self.path}/of={n}/bucket={_bucket(address, n)}").get(address, "") for n in self.counts) or None

    def last(self) -> int:
        """The highest address that is a number."""
        import pyarrow.parquet as pq

        found = -1
        for n in self.counts:
            for bucket in self._below(f"{self.path}/of={n}"):
                for path in self._parts(bucket.path) if bucket.base_name.startswith("bucket=") else []:
                    with self.files.open_input_file(path) as file:
                        found = max([found, *(int(a) for a in pq.read_table(file, columns=["address"])["address"].to_pylist() if re.fullmatch("[0-9]+", a))])
        return found


def write_payloads(payloads: DataFrame, path: str) -> None:
    """A folder for ``Folder`` of (address, payload): files of about PER_FILE addresses, whatever their number."""
    rows = payloads.select(F.col("address").cast("string").alias("address"), "payload").filter(F.col("address").isNotNull())
    of = max(1, -(-rows.count() // PER_FILE))
    bucket = F.pmod(F.crc32(F.regexp_replace("address", "([0-9]*)[0-9]", "$1").cast("binary")), F.lit(of)).alias("bucket")
    dealt = rows.select("address", "payload", bucket).repartition(min(of, partitions(payloads.sparkSession)), "bucket")
    dealt.write.mode("append").partitionBy("bucket").parquet(f"{path}/of={of}")
