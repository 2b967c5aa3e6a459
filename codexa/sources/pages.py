"""Payloads of a content service as a Spark data source: one partition, and one request, for each translation."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codexa.sources.tables import CONTENT

#: Rows of a page, characters of an answer that an error quotes.
PAGE, EXCERPT = 5000, 500


class Translation(InputPartition):
    def __init__(self, number: int, name: str | None) -> None:
        self.number, self.name = number, name


class PayloadPages(DataSource):
    """Pages of payloads: lines of JSON that read_pages understands, in the order of the translations.

    Options: url, the service's base; translations, a JSON list of names (none: everything by one request); key, sent as
    X-API-Key; timeout in seconds, 300 if not given.
    """

    @classmethod
    def name(cls) -> str:
        return "payload_pages"

    def schema(self) -> str:
        return "translation string, page bigint, value string"

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(dict(self.options))


class PayloadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "url" not in options:
            raise ValueError("the option url is needed")
        self.url, self.key, self.timeout = options["url"].rstrip("/"), options.get("key"), float(options.get("timeout", 300))
        self.names = json.loads(options.get("translations", "[]"))

    def partitions(self) -> list[Translation]:
        return [Translation(i, n) for i, n in enumerate(self.names)] or [Translation(0, None)]

    def read(self, partition: Translation) -> Iterator[tuple[str | None, int, str]]:
        asked = f"{self.url}/api/data" + (f"?{urllib.parse.urlencode({'translation': partition.name})}" if partition.name else "")
        request = urllib.request.Request(asked, headers={"X-API-Key": self.key} if self.key else {})  # noqa: S310
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                status, body = answer.status, answer.read()
        except urllib.error.HTTPError as e:
            status, body = e.code, e.read(4 * EXCERPT)
        if status != 200:
            raise RuntimeError(f"the source answered {status}: {body.decode(errors='replace')[:EXCERPT]}")
        number = partition.number << 32
        for table, rows in json.loads(body).items():
            for at in range(0, len(rows), PAGE) if table in CONTENT else ():
                yield partition.name, number, json.dumps({"page": number, table: rows[at : at + PAGE]}, ensure_ascii=False)
                number += 1


def fetch_pages(spark: SparkSession, url: str, folder: str, translations: list[str] | None = None, key: str | None = None, timeout: float = 300) -> DataFrame:
    """Fetches payloads into a folder that read_pages reads, each translation by a task of its own; translation and pages of each.

    A RuntimeError quotes the beginning of an answer that isn't 200; then the folder isn't complete and has no _SUCCESS.
    """
    spark.dataSource.register(PayloadPages)
    options = {"url": url, "translations": json.dumps(translations or []), "timeout": str(timeout)} | ({"key": key} if key else {})
    pages = spark.read.format("payload_pages").options(**options).load()
    pages.write.parquet(f"{folder}-fetched")  # asked once, whatever is retried later
    fetched = spark.read.schema(PayloadPages({}).schema()).parquet(f"{folder}-fetched")
    fetched.select("value").write.text(folder)
    return fetched.groupBy("translation").count().withColumnRenamed("count", "pages")
