"""Backends that answer in pages, as a data source: `spark.read.format("mesh_pages")` and `spark.readStream`.

A backend is asked by `url?limit=…&offset=…`, with `since` and `until` (both included, in milliseconds) and any equality
that is pushed down, and answers `{"items": [...], "total": n}`, oldest first. Each page is a partition, so that pages are
fetched by all executors and one that is lost is fetched again. A page that fails is retried; one that keeps failing fails
its task, which Spark retries elsewhere. A stream reads what has become known since its last batch, by time: offsets are
times, and a batch is a range of time, so that a batch that is repeated asks for the same rows."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

#: Rows of a page, attempts at one, and seconds before the second, doubled each time; seconds an answer may take.
PAGE, ATTEMPTS, PAUSE, PATIENCE = 500, 4, 0.2, 30


def asked(url: str, **about) -> dict:
    """The answer to one request; a failure or an answer that isn't whole is tried again."""
    query = urllib.parse.urlencode({k: v for k, v in about.items() if v is not None})
    for attempt in range(ATTEMPTS):
        try:
            with urllib.request.urlopen(f"{url}?{query}", timeout=PATIENCE) as answer:
                found = json.load(answer)
            if isinstance(found.get("items"), list):
                return found
            failure: Exception = ValueError("no list of items")
        except urllib.error.HTTPError as e:
            if e.code < 500 and e.code != 429:  # asking again won't help
                raise
            failure = e
        except (OSError, ValueError) as e:
            failure = e
        if attempt + 1 < ATTEMPTS:
            time.sleep(PAUSE * 2**attempt)
    raise RuntimeError(f"{url}?{query} failed {ATTEMPTS} times: {failure}")


def fitted(value, kind: DataType):
    """A JSON value as a column's; null where it doesn't fit."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, (IntegerType, LongType)):
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    if isinstance(kind, (FloatType, DoubleType)):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if isinstance(kind, ArrayType):
        return [fitted(v, kind.elementType) for v in value] if isinstance(value, list) else None
    raise TypeError(f"pages hold no {kind.simpleString()}")


@dataclass
class Page(InputPartition):
    about: dict


def planned(url: str, size: int, about: dict) -> list[Page]:
    """A partition for each page; how many there are is asked once."""
    total = int(asked(url, limit=1, offset=0, **about).get("total") or 0)
    return [Page(about | {"limit": size, "offset": at}) for at in range(0, total, size)]


class _Reads:
    def __init__(self, schema: StructType, options: dict):
        self.fields = [(f.name, f.dataType) for f in schema.fields]
        self.url, self.size = options["url"], int(options.get("page_size", PAGE))
        self.time, self.about = options.get("time", "heard_ms"), {}

    def read(self, partition: Page) -> Iterator[tuple]:
        for item in asked(self.url, **partition.about)["items"]:
            yield tuple(fitted(item.get(name), kind) for name, kind in self.fields)


class PageReader(_Reads, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities and bounds of time go to the backend; Spark applies all the others, and these once more."""
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if isinstance(f, EqualTo) and isinstance(f.value, (str, int)) and not isinstance(f.value, bool) and column not in ("limit", "offset", "since", "until"):
                self.about[column] = f.value
            elif isinstance(f, GreaterThanOrEqual) and column == self.time:
                self.about["since"] = max(f.value, self.about.get("since", f.value))
            elif isinstance(f, LessThanOrEqual) and column == self.time:
                self.about["until"] = min(f.value, self.about.get("until", f.value))
            yield f

    def partitions(self) -> list[Page]:
        return planned(self.url, self.size, self.about)


class PageStream(_Reads, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        """One millisecond after the newest row, which is the last one as rows come oldest first."""
        total = int(asked(self.url, limit=1, offset=0).get("total") or 0)
        newest = asked(self.url, limit=1, offset=total - 1)["items"] if total else []
        return {"next": max((int(i[self.time]) + 1 for i in newest), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return planned(self.url, self.size, {"since": start["next"], "until": end["next"] - 1}) if start["next"] < end["next"] else []

    def commit(self, end: dict) -> None:
        pass  # the backend keeps what it has


class MeshPages(DataSource):
    """Options: url; page_size; time, the column that since and until are about. A schema has to be given."""

    @classmethod
    def name(cls) -> str:
        return "mesh_pages"

    def schema(self) -> str:
        raise ValueError("a schema of the pages' items has to be given")

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, self.options)

    def streamReader(self, schema: StructType) -> PageStream:
        return PageStream(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets its filters be pushed down."""
    spark.dataSource.register(MeshPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
