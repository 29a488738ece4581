"""A Spark data source over paged JSON feeds: every partition reads its own pages until one is short."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "number long, title string, body string, state string, is_pull_request boolean, url string, updated_at string, comments array<string>"


class Lane(InputPartition):
    """Pages `first`, `first` + lanes, ..."""

    def __init__(self, first: int) -> None:
        super().__init__(first)
        self.first = first


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.size, self.lanes, self.token = options["url"], int(options.get("page_size", "100")), int(options.get("lanes", "4")), options.get("token", "")

    def partitions(self) -> list[InputPartition]:
        return [Lane(i + 1) for i in range(self.lanes)]

    def _page(self, number: int) -> list[dict]:
        headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url.format(page=number, size=self.size), headers=headers), timeout=60) as answer:
                return json.load(answer)
        except urllib.error.URLError as error:
            if isinstance(getattr(error, "reason", None), FileNotFoundError) or getattr(error, "code", 0) == 404:
                return []  # past the last page
            raise

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        number = partition.first
        while True:
            items = self._page(number)
            for i in items:
                comments = [c if isinstance(c, str) else c.get("body") or "" for c in i.get("comments") or []] if isinstance(i.get("comments"), list) else []
                yield i.get("number"), i.get("title"), i.get("body"), i.get("state"), "pull_request" in i, i.get("html_url"), i.get("updated_at"), comments
            if len(items) < self.size:
                return
            number += self.lanes


class ItemPages(DataSource):
    """spark.dataSource.register(ItemPages); spark.read.format("item_pages").option("url", "https://.../issues?page={page}&per_page={size}").load()"""

    @classmethod
    def name(cls) -> str:
        return "item_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(dict(self.options))
