"""The shop's paginated API as a data source: spark.read.format("shop_api").

The number of pages is asked for once; ranges of pages are then read by the executors, each page with its own retries, and rows go to
Spark as they arrive. What was added since the count was taken is read by the task of the last pages, which goes on while the API says
that there is more. A page that cannot be read fails its task, which Spark repeats.

Options: url, entity, updated_since, page_size, pages_per_task, tries, longest_pause (seconds), timeout (seconds).
"""

from __future__ import annotations

import json
import math
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The fields of each entity; all are read as text.
FIELDS = {
    "customers": "customer_id first_name last_name email phone city postal_code country created_at updated_at".split(),
    "products": "product_id name category brand unit_price currency is_active created_at updated_at".split(),
}
KEYS = {"customers": "customer_id", "products": "product_id"}
#: Records of a page, and pages that a task reads.
PAGE_SIZE, PAGES_PER_TASK = 500, 20
FIRST_PAUSE = 0.5
RETRIED = {429, 500, 502, 503, 504}


class ApiError(RuntimeError):
    pass


def http_get(url: str, timeout: float = 15.0) -> tuple[int, dict[str, str], str]:
    """(status, headers, body); a server that cannot be reached counts as one that is overloaded."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), ""
    except OSError:
        return 503, {}, ""


class ApiClient:
    """Reads single pages, each with its own retries."""

    def __init__(self, base: str, get: Callable | None = None, sleep: Callable[[float], None] = time.sleep, tries: int = 6, most: float = 30.0, page_size: int = PAGE_SIZE, timeout: float = 15.0):
        self.base, self.sleep, self.tries, self.most, self.page_size = base.rstrip("/"), sleep, tries, most, page_size
        self.get = get or (lambda url: http_get(url, timeout))

    def page(self, entity: str, number: int, updated_since: str | None, page_size: int | None = None) -> dict:
        query = {"page": number, "page_size": page_size or self.page_size} | ({"updated_since": updated_since} if updated_since else {})
        url = f"{self.base}/{entity}?{urllib.parse.urlencode(query)}"
        for attempt in range(self.tries):
            status, headers, body = self.get(url)
            if status == 200:
                return json.loads(body)
            if status not in RETRIED:
                raise ApiError(f"{url}: {status}")
            if attempt < self.tries - 1:
                self.sleep(min(self.most, self.pause(attempt, headers.get("Retry-After"))))
        raise ApiError(f"{url}: {status} after {self.tries} tries")

    @staticmethod
    def pause(attempt: int, asked: str | None) -> float:
        """Seconds to wait: what the server asks for if that is a number, else twice as long after each attempt, a little shaken."""
        if asked and re.fullmatch(r"\d+(\.\d*)?", asked.strip()):
            return float(asked)
        return FIRST_PAUSE * 2.0**attempt * random.uniform(0.75, 1.25)



class PageRange(InputPartition):
    """Pages first to last; the last range is open: it goes on while there are more."""

    def __init__(self, first: int, last: int, is_open: bool):
        super().__init__((first, last))
        self.first, self.last, self.is_open = first, last, is_open

    def __eq__(self, other: object) -> bool:
        return isinstance(other, PageRange) and (self.first, self.last, self.is_open) == (other.first, other.last, other.is_open)

    def __repr__(self) -> str:
        return f"PageRange({self.first}, {self.last}, {self.is_open})"


def page_ranges(n_pages: int, each: int) -> list[PageRange]:
    """Ranges of `each` pages; there is always one, as an empty entity has a page without """
    starts = range(1, max(1, n_pages) + 1, each)
    return [PageRange(a, min(a + each - 1, max(1, n_pages)), a == starts[-1]) for a in starts]


def text(value: object) -> str | None:
    """A field as text: texts as they are, anything else as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class ShopReader(DataSourceReader):
    def __init__(self, entity: str, client: ApiClient, since: str | None, each: int):
        self.entity, self.client, self.since, self.each = entity, client, since, each

    def partitions(self) -> list[PageRange]:
        """From the count that the API gives with its pages; an API that gives none is read by one task, page after page."""
        told = self.client.page(self.entity, 1, self.since, page_size=1)["pagination"]
        total = told.get("total")
        return page_ranges(math.ceil(total / self.client.page_size) if total is not None else 1, self.each)

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        names = FIELDS[self.entity]
        number, more = partition.first, True
        while more:
            page = self.client.page(self.entity, number, self.since)
            rows = page["data"]
            columns = [pa.array([text(r.get(n)) for r in rows], pa.string()) for n in names]
            raw = pa.array([json.dumps(r, ensure_ascii=False) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, raw, pa.array([number] * len(rows), pa.int64())], names=[*names, "_raw", "_page"])
            number += 1
            more = number <= partition.last or (partition.is_open and page["pagination"]["has_next"])


class ShopApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shop_api"

    def schema(self) -> str:
        return ", ".join(f"{n} STRING" for n in [*FIELDS[self.options["entity"]], "_raw"]) + ", _page BIGINT"

    def reader(self, schema) -> ShopReader:
        told = self.options
        client = ApiClient(
            told["url"], tries=int(told.get("tries", 6)), most=float(told.get("longest_pause", 30)), page_size=int(told.get("page_size", PAGE_SIZE)), timeout=float(told.get("timeout", 15))
        )
        return ShopReader(told["entity"], client, told.get("updated_since"), int(told.get("pages_per_task", PAGES_PER_TASK)))


def read(spark: SparkSession, url: str, entity: str, updated_since: str | None = None, **options: object) -> DataFrame:
    """(fields of the entity, _raw, _page) of every record, or of those that changed since."""
    spark.dataSource.register(ShopApi)
    reader = spark.read.format("shop_api").option("url", url).option("entity", entity)
    if updated_since:
        reader = reader.option("updated_since", updated_since)
    return reader.options(**{k: str(v) for k, v in options.items()}).load()
