"""Fetching pages over a network, in tasks."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

TIMEOUT_S, TRIES, PAUSE_S = 120, 3, 5


def get(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=TIMEOUT_S) as response:
        return response.read()


def with_retries(url: str, get: Callable[[str], bytes], tries: int = TRIES, pause_s: float = PAUSE_S) -> tuple[bytes | None, str | None]:
    """(content, None), or (None, what went wrong) after the last try. Pauses grow with each try."""
    for attempt in range(tries):
        try:
            return get(url), None
        except Exception as e:  # a source's failure is a state of its row, whatever its kind
            problem = f"{type(e).__name__}: {e}"
            if attempt < tries - 1:
                time.sleep(pause_s * (attempt + 1))
    return None, problem


def fetched(pages: DataFrame, get: Callable[[str], bytes] = get, tries: int = TRIES, pause_s: float = PAUSE_S, url: str = "source_url") -> DataFrame:
    """pages with content (null where fetching failed) and detail (what went wrong). Pages are fetched where they lie: repartition them for more at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), 16):  # contents are large
                part = f.iloc[lo : lo + 16]
                got = [with_retries(u, get, tries, pause_s) for u in part[url]]
                yield part.assign(content=[c for c, _ in got], detail=[d for _, d in got])

    fields = ", ".join(f"`{name}` {kind}" for name, kind in pages.dtypes)
    return pages.mapInPandas(run, f"{fields}, content binary, detail string")
