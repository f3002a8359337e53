"""Where run metadata comes from: a paged catalog behind an interface, and files of saved pages."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import parse_run_pages

PAGE = 10_000
ATTEMPTS = 3


class RunCatalog(Protocol):
    """A remote search.  ``count`` raises LookupError when nothing matches, which is not retried."""

    def count(self, species: str, long_reads: bool) -> int: ...

    def page(self, start: int, size: int) -> str: ...


def pages(catalog: RunCatalog, species: str, long_reads: bool = False, size: int = PAGE) -> Iterator[str]:
    """All pages of a search; a page that fails is asked for again."""
    total = catalog.count(species, long_reads)
    for start in range(0, total, size):
        for attempt in range(ATTEMPTS):
            try:
                yield catalog.page(start, size)
                break
            except OSError:
                if attempt == ATTEMPTS - 1:
                    raise


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a folder of saved pages, a task for each file."""
    return parse_run_pages(spark.read.text(path, wholetext=True).select(F.col("value").alias("xml")))


def availability(code: Column) -> Column:
    """Status of an object by its response code: 2xx available, 403 and 404 absent, else error."""
    return F.when(code.between(200, 299), "available").when(code.isin(403, 404), "absent").otherwise("error")


def retried(code: Column) -> Column:
    """Whether to ask again: no response, or a fault of the server."""
    return code.isNull() | (code >= 500)
