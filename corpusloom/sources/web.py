"""Fetching pages and documents as a transformation with an injectable fetcher, and robots rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Fetcher = Callable[[str], tuple[int, str, bytes]]  # url -> (status, content type, body)


def allowed(url: Column, robots: Column, agent: str = "*") -> Column:
    """Whether a robots text lets an agent fetch a URL; no text (unreachable) allows everything."""

    @F.pandas_udf("boolean")
    def check(urls: pd.Series, texts: pd.Series) -> pd.Series:
        seen: dict[str, RobotFileParser] = {}

        def one(u, t):
            if not isinstance(t, str) or not isinstance(u, str):
                return True
            if t not in seen:
                p = RobotFileParser()
                p.parse(t.splitlines())
                seen[t] = p
            return seen[t].can_fetch(agent, u)

        return pd.Series([one(u, t) for u, t in zip(urls, texts)])

    return check(url, robots)


def fetched(urls: DataFrame, fetch: Fetcher) -> DataFrame:
    """(url, status, content_type, body, error): every address once; a failure is a row, so one bad
    record never fails a task. The encoding is the header's, else what the bytes decode as."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u in b["url"]:
                try:
                    status, kind, body = fetch(u)
                    name = kind.lower().partition("charset=")[2].split(";")[0].strip() or "utf-8"
                    try:
                        text = body.decode(name)
                    except (LookupError, UnicodeDecodeError):
                        text = body.decode("latin-1")
                    rows.append((u, status, kind, text if "text/html" in kind else None, None if status < 400 else f"HTTP {status}"))
                except Exception as e:  # noqa: BLE001
                    rows.append((u, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["url", "status", "content_type", "body", "error"]).astype({"status": "Int64"})

    return urls.select("url").mapInPandas(run, "url string, status bigint, content_type string, body string, error string")
