"""Web pages as a Spark data source with a pluggable fetcher.

A fetcher is a Python module with ``fetch(url) -> str`` and, if it likes,
``configure(options)``, ``connect()`` and ``close()``.  Each partition opens the
fetcher once, reads its addresses, and closes it; an address that fails becomes
a row with a reason, never a failed job.
"""

from __future__ import annotations

import importlib
import importlib.util
import re
import urllib.request
from collections.abc import Iterator
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marlstone.functions import markup

SCHEMA = "url string, text string, reason string"
#: Fixed value: pages larger than this are downloads, not documents.
MAX_PAGE = 8 * 1024 * 1024


def load_fetcher(name: str) -> ModuleType:
    """A fetcher by module name or by the path of its file."""
    if name.endswith(".py"):
        spec = importlib.util.spec_from_file_location("fetcher", name)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    else:
        module = importlib.import_module(name)
    if not callable(getattr(module, "fetch", None)):
        raise TypeError(f"{name} has no fetch(url)")
    return module


def fetch(url: str, timeout: float = 20.0) -> str:
    """The built-in fetcher: one GET, as Markdown under the page's title."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        raw = answer.read(MAX_PAGE + 1)
        charset = answer.headers.get_content_charset() or "utf-8"
        kind = answer.headers.get_content_type()
    if len(raw) > MAX_PAGE:
        raise ValueError("page too large")
    text = raw.decode(charset, "replace")
    if kind != "text/html":
        return text
    return markup.lead_with_title(markup.to_markdown(text), markup.read_head(text, url)[0])


def fetch_each(urls: list[str], name: str, options: dict[str, str]) -> Iterator[tuple[str, str | None, str | None]]:
    """(url, text, reason) of every address, inside one bracket of the fetcher."""
    module = load_fetcher(name)
    call = lambda what, *a: getattr(module, what)(*a) if hasattr(module, what) else None
    call("configure", options)
    call("connect")
    try:
        for url in urls:
            try:
                text = re.sub("\r\n?", "\n", module.fetch(url))
                yield url, re.sub("[  \u0085]", " ", text).replace("\x00", ""), None
            except Exception as e:  # noqa: BLE001
                yield url, None, f"{type(e).__name__}: {e}"
    finally:
        call("close")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.urls = [u for u in self.options.get("urls", "").split() if u]
        self.size = int(self.options.get("urls_per_partition", "50"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.urls[i : i + self.size]) for i in range(0, len(self.urls), self.size)] or [InputPartition([])]

    def read(self, partition: InputPartition):
        yield from fetch_each(partition.value, self.options.get("fetcher", __name__), self.options)


class WebPages(DataSource):
    """``spark.read.format("webpages").option("urls", "…").option("fetcher", "…")``."""

    @classmethod
    def name(cls) -> str:
        return "webpages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)


def fetch_all(listed: DataFrame, fetcher: str = __name__, options: dict[str, str] | None = None) -> DataFrame:
    """Fetch the addresses of a table ``url``, however many there are."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame(list(fetch_each(list(pdf["url"]), fetcher, options or {})), columns=["url", "text", "reason"])

    return listed.select("url").mapInPandas(run, SCHEMA)
