"""Data sources for hosted services: paged JSON lists, changes paged by cursor, counts; over HTTP, with retries.

What they share: `path` (one target per line, see each source), the token's options of `credentials`, `page_size`,
`wait` (seconds before the first retry), `per_task` (targets of one partition). The headers are made anew for each
call, so a token that ends during a long scan is renewed. A target that fails gives a row with its `error`, and the
others go on.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schemas import MERGED_PRS
from . import credentials, endpoints

#: Seconds of an HTTP call; tries, first and longest wait when a limit is hit.
HTTP_SECONDS, TRIES, WAIT, LONGEST_WAIT = 120, 6, 30, 900

Fetch = Callable[[str, dict[str, str]], tuple[object, dict[str, str]]]


def http_get(url: str, headers: dict[str, str], payload: object = None) -> tuple[object, dict[str, str]]:
    """The JSON at an address and the headers; with a payload it is posted. An HTTP error becomes a RuntimeError with code and body."""
    data = None if payload is None else json.dumps(payload).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=data, headers=headers), timeout=HTTP_SECONDS) as r:
            return json.load(r), {k.lower(): v for k, v in r.headers.items()}
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"HTTP {e.code} for {url}: {e.read().decode('utf-8', 'replace')[:500]}") from e


def with_retry(call: Callable[[], object], sleep: Callable[[float], None] = time.sleep, wait: float = WAIT) -> object:
    """A call that is repeated, with waits that double, while its error speaks of a rate limit."""
    for left in range(TRIES - 1, -1, -1):
        try:
            return call()
        except RuntimeError as e:
            if not left or not re.search("rate limit|HTTP 429", str(e), re.I):
                raise
            sleep(wait)
            wait = min(2 * wait, LONGEST_WAIT)


def pages(url: str, style: str, headers: dict[str, str] | Callable[[], dict[str, str]], page_size: int = 100, fetch: Fetch = http_get, wait: float = WAIT) -> Iterator[object]:
    """All items of a paged list.

    `style` `link`: a Link header names the next page; a body that is no list ends the list. `number`: X-Next-Page or
    short pages tell; a body that is no list is one item. `document`: one item, without pages.
    """
    made = headers if callable(headers) else lambda: headers
    number, joint = 1, "&" if "?" in url else "?"
    while True:
        address = url if style == "document" else f"{url}{joint}per_page={page_size}&page={number}"
        body, got = with_retry(lambda: fetch(address, made()), wait=wait)
        if style == "document" or not isinstance(body, list):
            if style != "link":
                yield body
            return
        yield from body
        if style == "link":
            if 'rel="next"' not in got.get("link", ""):
                return
            number += 1
        elif got.get("x-next-page"):
            number = int(got["x-next-page"])
        elif len(body) < page_size or "x-next-page" in got:
            return
        else:
            number += 1


class _Targets(InputPartition):
    def __init__(self, lines: list[str]):
        self.lines = lines


class _HostedReader(DataSourceReader):
    """Reads one target after the other; `rows` gives tuples without the error, of `width` fields, the target's key first."""

    width = 0

    def __init__(self, options: dict):
        self.options = dict(options)
        self.size, self.wait = int(self.options.get("page_size", 100)), float(self.options.get("wait", WAIT))

    def partitions(self) -> list[InputPartition]:
        lines = [x for x in self.options["path"].split("\n") if x.strip()]
        n = int(self.options.get("per_task", 1))
        return [_Targets(lines[k : k + n]) for k in range(0, len(lines), n)] or [_Targets([])]

    def headers(self) -> dict[str, str]:
        return credentials.headers(self.options)

    def call(self, url: str, payload: object = None) -> tuple[object, dict[str, str]]:
        return with_retry(lambda: http_get(url, self.headers(), payload), wait=self.wait)

    def rows(self, line: str) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for line in partition.lines:
            try:
                for row in self.rows(line):
                    yield *row, None
            except (RuntimeError, OSError, ValueError, KeyError, TypeError) as e:  # the reason is data; other targets go on
                yield line.split("\t")[0], *[None] * (self.width - 1), str(e)[:500]


class ListReader(_HostedReader):
    """A line is a key, a tab, and a chain of addresses parted by spaces: the first that is neither missing (HTTP 404)
    nor empty gives the items. A line without a tab is its own key."""

    width = 4

    def items(self, url: str) -> Iterator[object]:
        return pages(url, self.options.get("style", "link"), self.headers, self.size, wait=self.wait)

    def rows(self, line: str) -> Iterator[tuple]:
        key, _, chain = line.rpartition("\t")
        for url in chain.split():
            n = 0
            try:
                for n, item in enumerate(self.items(url), 1):
                    yield key or line, url, n, json.dumps(item, ensure_ascii=False)
            except RuntimeError as e:
                if "HTTP 404" not in str(e) or url == chain.split()[0] == chain.split()[-1]:
                    raise
            if n:
                return


class ChangesReader(_HostedReader):
    """A line is a repository's full name; `endpoint` is the GraphQL address, `query` that of one page. Pages come last updated first, so a lower
    bound of `updated_at` or `merged_at` that Spark pushes down ends the paging: no merge is later than the last update."""

    width = 5

    def __init__(self, options: dict):
        super().__init__(options)
        self.since = self.options.get("since") or ""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute in (("updated_at",), ("merged_at",)) and isinstance(f.value, str):
                self.since = max(self.since, f.value)
            yield f  # Spark applies it to the rows of the last page

    def rows(self, line: str) -> Iterator[tuple]:
        owner, _, name = line.partition("/")
        def ask(cursor: str | None) -> dict:
            body, _ = self.call(self.options["endpoint"], {"query": self.options["query"], "variables": {"owner": owner, "name": name, "cursor": cursor}})
            return endpoints.connection(body, line)

        for node in endpoints.cursor_pages(ask):
            if self.since and (node.get("updatedAt") or "9") < self.since:
                return
            yield line, node.get("number"), node.get("updatedAt"), node.get("mergedAt"), json.dumps(node, ensure_ascii=False)


class CountReader(_HostedReader):
    """The number of merged changes without their rows, where the service tells it.

    `platform` github: a line is a full name, `endpoint` the GraphQL address, one call tells the total. gitlab: a line
    is a key, a tab and the address of the list; the X-Total header of a page of one item tells it, else the list is
    counted.
    """

    width = 3

    def rows(self, line: str) -> Iterator[tuple]:
        if self.options.get("platform") == "gitlab":
            key, _, url = line.rpartition("\t")
            _, got = self.call(f"{url}{'&' if '?' in url else '?'}per_page=1")
            told = got.get("x-total")
            total = int(told) if told is not None else sum(1 for _ in pages(url, "number", self.headers, self.size, wait=self.wait))
            yield key, total, told is not None
            return
        owner, _, name = line.partition("/")
        body, _ = self.call(self.options["endpoint"], {"query": endpoints.COUNT_QUERY, "variables": {"owner": owner, "name": name}})
        yield line, int(endpoints.connection(body, line)["totalCount"]), True


class _Hosted(DataSource):
    label, form, kind = "", "", _HostedReader

    @classmethod
    def name(cls) -> str:
        return cls.label

    def schema(self) -> str:
        return self.form

    def reader(self, schema) -> DataSourceReader:
        return self.kind(self.options)


class Hosted(_Hosted):
    label, form, kind = "hosted_json", "key string, url string, seq long, item string, error string", ListReader


class MergedChanges(_Hosted):
    label, form, kind = "merged_changes", "repo string, number int, updated_at string, merged_at string, item string, error string", ChangesReader


class MergedCounts(_Hosted):
    label, form, kind = "merged_counts", "repo string, merged long, told boolean, error string", CountReader


def fetched(lines: DataFrame, source: type[_Hosted] = Hosted, **options: object) -> DataFrame:
    """The rows of a source for targets that are rows (`line`): the tasks that hold them read them."""
    given, reader = {k: str(v) for k, v in _with_query(source, options).items()}, source.kind
    arrow = to_arrow_schema(StructType.fromDDL(source.form))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader(given)
        for batch in batches:
            for line in batch.column(0).to_pylist():
                columns = list(zip(*own.read(_Targets([line])))) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return lines.select("line").mapInArrow(run, source.form)


def _with_query(source: type[_Hosted], options: dict) -> dict:
    """Options with the query that the source needs: executors have no parser of schemas."""
    if source is not MergedChanges:
        return options
    return {"query": endpoints.merged_query(StructType.fromDDL(MERGED_PRS))} | options


def load(spark: SparkSession, source: type[_Hosted], lines: Iterable[str], **options: object) -> DataFrame:
    """The rows of a source for these targets. Filters are pushed into the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.label).options(**_with_query(source, options)).load("\n".join(lines))
