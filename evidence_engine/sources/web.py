"""Web search and page fetches behind an injected transport; without a network a table of pages stands in."""

from __future__ import annotations

import html
import ipaddress
import json
import re
import time
from collections.abc import Callable, Iterable
from typing import NamedTuple, Protocol
from urllib.parse import parse_qs, quote_plus, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncate_page
from .ingest import html_text

# Bounds of a fetch, and what a result and its snippet look like in the fallback's pages.
MOST_HOPS, MOST_BYTES, MOST_PAGES = 5, 5_000_000, 5
RESULT = re.compile(r'<a[^>]+class="result__a"[^>]+href="([^"]+)"[^>]*>(.*?)</a>', re.DOTALL)
SNIPPET = re.compile(r'class="result__snippet"[^>]*>(.*?)</a>', re.DOTALL)


class Reply(NamedTuple):
    status: int
    headers: dict[str, str]
    body: bytes


#: transport(url, seconds) -> Reply; may raise OSError. resolve(host) -> addresses.
Transport = Callable[[str, float], Reply]


class WebSource(Protocol):
    """Search results and pages as tables."""

    def results(self, queries: DataFrame) -> DataFrame:
        """queries (run_id, query) -> run_id, rank, url, title, snippet, engine."""

    def pages(self, results: DataFrame) -> DataFrame:
        """results -> url, text, kept, total, truncated."""


def public_host(host: str, resolve: Callable[[str], Iterable[str]]) -> bool:
    """Is every address of a host a public one? An unresolvable host isn't."""
    try:
        found = [ipaddress.ip_address(a) for a in resolve(host)]
    except (OSError, ValueError):
        return False
    return bool(found) and not any(a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified for a in found)


def safe_url(url: str, resolve: Callable[[str], Iterable[str]]) -> bool:
    parts = urlsplit(url)
    return parts.scheme in ("http", "https") and bool(parts.hostname) and public_host(parts.hostname, resolve)


def fetch(url: str, transport: Transport, resolve: Callable[[str], Iterable[str]], seconds: float = 12.0) -> str | None:
    """A page's HTML, or None: every hop is checked, at most 5 redirects, 5 MB and HTML only."""
    for _ in range(MOST_HOPS + 1):
        if not safe_url(url, resolve):
            return None
        reply = transport(url, seconds)
        headers = {k.lower(): v for k, v in reply.headers.items()}
        if reply.status in (301, 302, 303, 307, 308) and headers.get("location"):
            url = urljoin(url, headers["location"])
            continue
        if reply.status != 200 or "html" not in headers.get("content-type", "text/html").lower():
            return None
        charset = re.search(r"charset=([\w-]+)", headers.get("content-type", ""))
        try:
            return reply.body[:MOST_BYTES].decode(charset[1] if charset else "utf-8", "replace")
        except LookupError:
            return reply.body[:MOST_BYTES].decode("utf-8", "replace")
    return None


def search_json(query: str, endpoints: Iterable[str], transport: Transport, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> list[tuple[str, str, str, str]]:
    """(url, title, snippet, engine) from the first endpoint that answers with results. A 429 waits as long as it says, other faults
    1, 2, 4 ... seconds; then the next endpoint has its turn."""
    for endpoint in endpoints:
        for attempt in range(tries):
            try:
                reply = transport(f"{endpoint.rstrip('/')}/search?q={quote_plus(query)}&format=json", 12.0)
            except OSError:
                wait(2.0**attempt)
                continue
            if reply.status == 429 or reply.status >= 500:
                said = {k.lower(): v for k, v in reply.headers.items()}.get("retry-after", "")
                wait(float(said) if said.isdigit() else 2.0**attempt)
                continue
            try:
                rows = json.loads(reply.body).get("results", []) if reply.status == 200 else []
            except ValueError:
                rows = []
            if rows:
                return [(r["url"], r.get("title") or "", r.get("content") or "", r.get("engine") or "") for r in rows if r.get("url")]
            break
    return []


def search_html(query: str, transport: Transport, endpoint: str) -> list[tuple[str, str, str, str]]:
    """(url, title, snippet, engine) scraped from a page of results; nothing if it can't be had."""
    try:
        reply = transport(f"{endpoint}?q={quote_plus(query)}", 12.0)
    except OSError:
        return []
    page = reply.body.decode("utf-8", "replace") if reply.status == 200 else ""

    def text(markup):
        return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", markup))).strip()

    snippets = [text(s) for s in SNIPPET.findall(page)]
    found = []
    for i, (url, title) in enumerate(RESULT.findall(page)):
        target = parse_qs(urlsplit(html.unescape(url)).query).get("uddg")
        found.append((unquote(target[0]) if target else html.unescape(url), text(title), snippets[i] if i < len(snippets) else "", "html"))
    return [r for r in found if r[0].startswith("http")]


def searched(queries: DataFrame, search: Callable[[str], list[tuple[str, str, str, str]]], most: int = 10) -> DataFrame:
    """queries (run_id, nth, query) -> run_id, rank, url, title, snippet, engine: each url once, at most so many a run."""

    def rows(batches):
        for pdf in batches:
            yield pd.DataFrame([(r.run_id, r.nth, i, *hit) for r in pdf.itertuples() for i, hit in enumerate(search(r.query))], columns=["run_id", "nth", "i", "url", "title", "snippet", "engine"])

    kind = queries.schema["run_id"].dataType.simpleString()
    found = queries.select("run_id", "nth", "query").mapInPandas(rows, f"run_id {kind}, nth int, i int, url string, title string, snippet string, engine string")
    once = found.withColumn("r", F.row_number().over(Window.partitionBy("run_id", "url").orderBy("nth", "i"))).filter("r = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("nth", "i"))).filter(F.col("rank") <= most).select("run_id", "rank", "url", "title", "snippet", "engine")


def fetched(results: DataFrame, get: Callable[[str], str | None], limit_chars: int = 40_000, most: int = MOST_PAGES) -> DataFrame:
    """results (run_id, rank, url) -> url, text, kept, total, truncated of the first pages of each run, each url fetched once.
    get(url) gives HTML or None; a fetch that raises leaves its page out. Partitions fetch side by side."""
    urls = results.filter((F.col("rank") <= most) & F.col("url").rlike("^https?://")).select("url").distinct()

    def rows(batches):
        for pdf in batches:
            out = []
            for url in pdf["url"]:
                try:
                    out.append((url, get(url)))
                except Exception:  # what has arrived is still of use
                    out.append((url, None))
            yield pd.DataFrame(out, columns=["page_id", "html"])

    pages = html_text(urls.mapInPandas(rows, "page_id string, html string").filter("html is not null"))
    return pages.select(F.col("page_id").alias("url"), truncate_page(F.col("text"), limit_chars).alias("t")).select("url", "t.*").filter("text <> ''")


class TableSource:
    """A WebSource over tables that are there already."""

    def __init__(self, results: DataFrame, pages: DataFrame):
        self._results, self._pages = results, pages

    def results(self, queries: DataFrame) -> DataFrame:
        return self._results.join(queries.select("run_id").distinct(), "run_id", "left_semi")

    def pages(self, results: DataFrame) -> DataFrame:
        return self._pages.join(results.select("url").distinct(), "url", "left_semi")
