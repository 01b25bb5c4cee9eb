"""Pages over a network as a data source of Spark's: `spark.read.format("pages")` and `spark.readStream.format("pages")`.

A population is a file of JSON Lines, runs of (run, folder, first, last), to which lines may be added. Reading plans a partition for each so many pages of a folder; a task fetches its pages one by one, tries each a bounded number of times, and gives a
row for what failed as for what came. A stream's offset is a place in the population: how many pages of it have been taken.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .fetch import PAUSE_S, TRIES, get, with_retries

SCHEMA = "run string, folder string, n int, page string, source_url string, content binary, detail string"
#: Pages of a partition.
PAGES = 64


@dataclass(frozen=True)
class Pages(InputPartition):
    """So many pages of a run's folder, first and last included."""

    run: str
    folder: str
    first: int
    last: int


class Population:
    """What the options say. population: the file's URI; base_url: where folders lie; pages: of a partition; tries and pause_s: attempts at a page and what is waited between them, longer each time."""

    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}
        missing = [k for k in ("population", "base_url") if k not in given]
        if missing:
            raise ValueError(f"the options lack {', '.join(missing)}")
        self.uri, self.base = given["population"], given["base_url"].rstrip("/")
        self.pages, self.tries, self.pause_s = int(given.get("pages", PAGES)), int(given.get("tries", TRIES)), float(given.get("pause_s", PAUSE_S))
        if self.pages < 1 or self.tries < 1:
            raise ValueError("pages and tries must be 1 or more")

    def runs(self) -> list[tuple[str, str, int, int]]:
        """The runs in order; a run that ends before it begins has no pages."""
        store, path = pyarrow.fs.FileSystem.from_uri(self.uri) if "://" in self.uri else (pyarrow.fs.LocalFileSystem(), self.uri)
        with store.open_input_stream(path) as f:
            lines = [json.loads(x) for x in f.read().decode().split("\n") if x.strip()]
        return [(r["run"], r["folder"], int(r["first"]), int(r["last"])) for r in lines]

    def size(self) -> int:
        return sum(max(0, last - first + 1) for *_, first, last in self.runs())

    def between(self, start: int, end: int) -> list[Pages]:
        """Partitions of the pages from place start to before end, none over two runs."""
        out, before = [], 0
        for run, folder, first, last in self.runs():
            n = max(0, last - first + 1)
            lo, hi = max(start - before, 0), min(end - before, n)
            out += [Pages(run, folder, first + k, first + min(k + self.pages, hi) - 1) for k in range(lo, hi, self.pages)]
            before += n
        return out

    def fetch(self, part: Pages) -> Iterator[tuple]:
        """A row for each page: its bytes, or null and what went wrong."""
        for n in range(part.first, part.last + 1):
            page = f"{part.folder}-{n:03d}"
            url = f"{self.base}/folder.{part.folder}/{page}.jpg"
            content, problem = with_retries(url, get, self.tries, self.pause_s)
            yield part.run, part.folder, n, page, url, content, problem


class PageReader(DataSourceReader):
    def __init__(self, population: Population):
        self.population = population

    def partitions(self) -> list[Pages]:
        return self.population.between(0, self.population.size())

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.population.fetch(partition)


class PageStreamReader(DataSourceStreamReader):
    def __init__(self, population: Population):
        self.population = population

    def initialOffset(self) -> dict:
        return {"place": 0}

    def latestOffset(self) -> dict:
        return {"place": self.population.size()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.population.between(start["place"], end["place"])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.population.fetch(partition)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(Population(self.options))

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(Population(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(PageSource)
