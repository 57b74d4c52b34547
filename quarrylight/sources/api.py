"""JSON APIs as a data source: paged listings as a batch, logs by offset as a batch or a stream.

    spark.dataSource.register(JsonApi)
    spark.read.format("json_api").schema("id long, name string").option("url", "https://host/items?page={page}").load()
    spark.readStream.format("json_api").schema("id long, body string").option("url", "https://host/{endpoint}?offset={offset}&limit={limit}").option("endpoints", '["chats/1", "chats/2"]').load()
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Endpoint(InputPartition):
    """An endpoint whose pages are read one after another."""

    name: str


@dataclass
class Span(InputPartition):
    """Rows of an endpoint from an offset to another."""

    name: str
    start: int
    end: int


class Api:
    """What the options say, and requests by them."""

    def __init__(self, options: dict, schema: StructType):
        if "url" not in options:
            raise ValueError("json_api needs a url")
        self.url = options["url"]
        self.endpoints = [str(e) for e in json.loads(options.get("endpoints", '[""]'))]
        #: Where in an answer the rows are, and how many there are in all; names between dots.
        self.rows, self.total = options.get("rows", ""), options.get("total", "total")
        self.key = options.get("key", "id")
        self.size, self.first, self.most = int(options.get("size", 0)), int(options.get("first", 1)), int(options.get("most", 0))
        self.tries, self.wait, self.timeout = int(options.get("tries", 3)), float(options.get("wait", 1)), float(options.get("timeout", 30))
        #: Rows of a log that one task reads.
        self.span = int(options.get("span", 10_000))
        self.headers = json.loads(options.get("headers", "{}"))
        self.fields = [(f.name, f.dataType.typeName()) for f in schema]

    def get(self, **values):
        """The answer as JSON; failures of the server or the line are tried again, waiting twice as long each time."""
        values = {k: urllib.parse.quote(str(v)) for k, v in values.items()}
        asked = urllib.request.Request(self.url.format(**values), headers=self.headers)
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
                    return json.loads(answer.read())
            except OSError as e:
                if n + 1 == self.tries or getattr(e, "code", 500) < 500:
                    raise
                time.sleep(self.wait * 2**n)

    def within(self, answer, path: str):
        for name in path.split(".") if path else []:
            answer = answer.get(name) if isinstance(answer, dict) else None
        return answer

    def row(self, endpoint: str, record: dict) -> tuple:
        """A row by the names of the schema: `endpoint` is the endpoint, `payload` the record as JSON unless it has such a field, texts of what is no text are JSON."""
        out = []
        for name, kind in self.fields:
            value = record.get(name)
            if name not in record and name == "endpoint":
                value = endpoint
            elif name not in record and name == "payload":
                value = json.dumps(record, ensure_ascii=False)
            elif kind == "string" and value is not None and not isinstance(value, str):
                value = json.dumps(value, ensure_ascii=False)
            out.append(value)
        return tuple(out)


class PageReader(DataSourceReader):
    """An endpoint a task; its pages until one is empty, short or brings no new key. Each key once."""

    def __init__(self, api: Api):
        self.api = api

    def partitions(self):
        return [Endpoint(e) for e in self.api.endpoints]

    def read(self, partition: Endpoint) -> Iterator[tuple]:
        api, seen, page, offset = self.api, set(), self.api.first, 0
        while not api.most or page < api.first + api.most:
            got = api.within(api.get(endpoint=partition.name, page=page, offset=offset, limit=api.size or 100), api.rows) or []
            fresh = False
            for record in got:
                key = json.dumps(record.get(api.key))
                if key not in seen:
                    seen.add(key)
                    fresh = True
                    yield api.row(partition.name, record)
            if not fresh or len(got) < api.size:
                return
            page, offset = page + 1, offset + len(got)


class LogReader(DataSourceStreamReader):
    """Endpoints whose rows keep their offset; a batch is what came since the last one, in spans of so many rows a task."""

    def __init__(self, api: Api):
        self.api = api

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.api.endpoints, 0)

    def latestOffset(self) -> dict:
        found = {}
        for e in self.api.endpoints:
            total = self.api.within(self.api.get(endpoint=e, offset=0, limit=1, page=self.api.first), self.api.total)
            if total is None:
                raise ValueError(f"the answer of {e!r} has no {self.api.total!r}, which tells how many rows there are")
            found[e] = int(total)
        return found

    def partitions(self, start: dict, end: dict):
        spans = []
        for e, last in end.items():
            for at in range(start.get(e, 0), last, self.api.span):
                spans.append(Span(e, at, min(at + self.api.span, last)))
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        at = partition.start
        while at < partition.end:
            limit = min(self.api.size or 100, partition.end - at)
            got = self.api.within(self.api.get(endpoint=partition.name, offset=at, limit=limit, page=0), self.api.rows) or []
            if not got:
                raise OSError(f"{partition.name!r} gave no rows from {at}, though it told of {partition.end}")
            for record in got[:limit]:
                yield self.api.row(partition.name, record)
            at += len(got[:limit])

    def commit(self, end: dict) -> None:
        pass


class JsonApi(DataSource):
    """Records of a JSON API by the names of the given schema.

    Options: url, with {endpoint}, {page}, {offset}, {limit} in it; endpoints, a JSON list
    (one nameless); rows and total, where an answer has its rows and their number; key, of which each is
    given once; size, the rows of a full page (0: any number); first, the first page's number; most, of
    pages (0: any number); span, rows of a stream that a task reads; headers, a JSON object; tries, wait, timeout.
    """

    @classmethod
    def name(cls) -> str:
        return "json_api"

    def schema(self) -> str:
        return "endpoint string, payload string"

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(Api(self.options, schema))

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(Api(self.options, schema))


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(JsonApi)
    return spark
