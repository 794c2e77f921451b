"""Network sources whose partitions are pages, details or archives; each request retries where it runs, nothing passes the driver.

``PagesSource`` is a Python data source (``http_pages``) of numbered listing pages: a partition is a page. ``fetch`` reads the
URLs of a table in its tasks, a few at once, and gives status, body, attempts and error of each: a failed request is a
row, so a lost executor costs its partitions' requests only. Urls may be of any scheme that ``opener`` reads.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .http import Response, Retry, get

TOGETHER = 8  # requests of a task at once, and bodies that it holds
ANSWER = "status int, body binary, attempts int, error string"


@dataclass
class Client:
    """How a task sends requests; ``opener`` makes the client of an attempt, so every attempt has its own."""

    attempts: int = 15
    base: float = 0.5
    most: float = 30.0
    timeout: float = 30.0
    opener: Callable[[], Callable] | None = field(default=None)

    def ask(self, url: str) -> tuple[int | None, bytes | None, int, str | None]:
        """(status, body, attempts, error): the last answer, whatever its status, or the last failure."""
        tried = [0]

        def send() -> Response:
            tried[0] += 1
            return get(url, self.timeout, self.opener() if self.opener else None)

        try:
            answer = Retry(self.attempts, self.base, self.most).run(send)
        except (OSError, ValueError) as e:
            return None, None, tried[0], str(e)
        ok = answer.status < 400
        return answer.status, answer.body if ok else None, tried[0], None if ok else f"status {answer.status}"


def fetch(urls: DataFrame, client: Client | None = None, url_col: str = "url") -> DataFrame:
    """``urls`` with status, body, attempts and error of each row's URL; null URLs are errors."""
    client = client or Client()
    kept = [c for c in urls.columns if c not in ("status", "body", "attempts", "error")]
    rows = urls.select(*kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(TOGETHER) as pool:
            for pdf in batches:
                for i in range(0, len(pdf), TOGETHER):
                    part = pdf.iloc[i : i + TOGETHER]
                    found = list(pool.map(lambda u: client.ask(u) if isinstance(u, str) and u else (None, None, 0, "no url"), part[url_col]))
                    answers = pd.DataFrame(found, columns=["status", "body", "attempts", "error"], index=part.index).astype({"status": "Int64"})
                    yield pd.concat([part, answers], axis=1)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, {ANSWER}")


class PagesSource(DataSource):
    """Listing pages by number. Options: url (with ``{page}``), pages (0: as many as the first names), max_pages (0: all), attempts, base, timeout."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return f"page int, url string, {ANSWER}"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)


class _Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        number = lambda key, default: type(default)(options.get(key, default))
        self.url, self.pages, self.most = options["url"], number("pages", 0), number("max_pages", 0)
        if self.pages < 0 or self.most < 0:
            raise ValueError("bounds must not be negative")
        self.client = Client(number("attempts", 15), number("base", 0.5), timeout=number("timeout", 30.0))

    def partitions(self) -> list[InputPartition]:
        last = self.pages
        if not last:
            _, body, _, error = self.client.ask(self.url.replace("{page}", "1"))
            if body is None:
                raise OSError(f"first page: {error}")
            last = max([1, *map(int, re.findall(r"/page/(\d+)", body.decode("utf-8", "replace")))])
        return [_Page(n) for n in range(1, min(last, self.most or last) + 1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        url = self.url.replace("{page}", str(partition.page))
        yield partition.page, url, *self.client.ask(url)


def details(slugs: DataFrame, url: str, most: int = 0, client: Client | None = None, wave: int = 64) -> DataFrame:
    """The first ``most`` slugs (slug, pos) in order whose details could be read, as (slug, pos, json); 0: all.

    With a bound, waves of ranks are asked for until enough have succeeded, so failures are replaced by later slugs.
    """
    from ..plans.facts import shared_dir
    from .corpus import first_successes

    if most < 0:
        raise ValueError("the bound must not be negative")
    asked = slugs.withColumn("url", F.replace(F.lit(url), F.lit("{slug}"), F.col("slug")))

    def read(rows: DataFrame) -> DataFrame:
        got = fetch(rows, client).select("slug", "pos", F.col("body").cast("string").alias("json"))
        return got.where(F.try_parse_json("json").isNotNull())

    if not most:
        return read(asked)
    import uuid

    path, start, top = f"{shared_dir(slugs.sparkSession)}/plugscope/details-{uuid.uuid4().hex}", 0, slugs.agg(F.max("pos")).first()[0]
    while top is not None and start <= top:
        read(asked.where((F.col("pos") >= start) & (F.col("pos") < start + max(wave, most)))).write.mode("append").parquet(path)
        start += max(wave, most)
        if slugs.sparkSession.read.parquet(path).count() >= most:
            break
    if top is None:
        return slugs.select("slug", "pos", F.lit("").alias("json")).limit(0)
    found = slugs.sparkSession.read.schema("slug string, pos int, json string").parquet(path)
    return first_successes(found.select("slug", "pos", "json", F.col("pos").alias("rank"), F.lit(True).alias("success")), most).select("slug", "pos", "json")


def archives(plugins: DataFrame, client: Client | None = None) -> DataFrame:
    """(plugin_slug, content, error) of plugins (slug, download_link): each archive's bytes stay with the task that read them."""
    got = fetch(plugins.select(F.col("slug").alias("plugin_slug"), F.col("download_link").alias("url")), client)
    return got.select("plugin_slug", F.col("body").alias("content"), "error")
