"""Checks of requests on the driver, before any job runs."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

CONTROL = re.compile(r"[\x00-\x1f\x7f]")


class Invalid(ValueError):
    """A request that will not be run, with the reason."""


def within(name: str, value: int, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise Invalid(f"{name} must be between {low} and {high}")
    return value


def text(name: str, value: str, most_bytes: int) -> str:
    if not isinstance(value, str) or not value.strip() or len(value.encode()) > most_bytes or CONTROL.search(value):
        raise Invalid(f"{name} must be non-blank, without control characters, and of at most {most_bytes} bytes")
    return value


def http_url(name: str, value: str, most_bytes: int = 4_096) -> str:
    text(name, value, most_bytes)
    parts = urlsplit(value)
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.username or parts.password or parts.query or parts.fragment:
        raise Invalid(f"{name} must be http(s) without credentials, query or fragment")
    return value


def search(query: str, limit: int = 8, max_text: int = 4_000, mode: str = "auto") -> None:
    text("query", query, 1_024)
    if not any(c.isalnum() for c in query):
        raise Invalid("query needs a letter or digit")
    within("limit", limit, 1, 50)
    within("max_text", max_text, 1, 20_000)
    if mode not in ("auto", "keywords", "exact"):
        raise Invalid("mode must be auto, keywords or exact")


def metadata(url_prefix: str | None = None, heading: str | None = None, crawled_after: int | None = None) -> None:
    if url_prefix is not None:
        http_url("url_prefix", url_prefix)
    if heading is not None:
        text("heading", heading, 1_024)
    if crawled_after is not None:
        within("crawled_after", crawled_after, 0, 2**63 - 1)


def context(neighbours: int = 1, max_chunks: int = 50, max_chars: int = 12_000, max_chunk_chars: int = 4_000) -> None:
    within("neighbours", neighbours, 0, 3)
    within("max_chunks", max_chunks, 1, 100)
    within("max_chars", max_chars, 1, 100_000)
    within("max_chunk_chars", max_chunk_chars, 1, 20_000)


def graph(seeds: int = 4, edges: int = 4, chunks: int = 2, candidates: int = 20) -> None:
    within("seeds", seeds, 1, 8)
    within("edges", edges, 1, 8)
    within("chunks", chunks, 1, 3)
    within("candidates", candidates, 1, 50)


def crawl(source_id: str, crawl_id: str, root_url: str, seeds: list[str], max_pages: int = 100, concurrency: int = 4, max_body: int = 16 << 20, timeout_s: float = 30, redirects: int = 5) -> None:
    from folioscope.functions.urls import join_url

    text("source_id", source_id, 256)
    text("crawl_id", crawl_id, 256)
    http_url("root_url", root_url)
    within("max_pages", max_pages, 1, 10_000)
    within("concurrency", concurrency, 1, 64)
    within("max_body", max_body, 1, 16 << 20)
    within("redirects", redirects, 0, 20)
    if not 0 < timeout_s <= 120:
        raise Invalid("timeout_s must be above 0 and at most 120")
    root = urlsplit(root_url)
    stem = root.path.rstrip("/")
    for s in seeds:
        p = urlsplit(join_url(root_url, s) or "")
        if (p.scheme, p.netloc) != (root.scheme, root.netloc) or not (p.path == stem or p.path.startswith(stem + "/")):
            raise Invalid(f"{s} is out of scope")


def embedding_space(provider: str, model: str, dimensions: int) -> None:
    text("provider", provider, 256)
    text("model", model, 256)
    within("dimensions", dimensions, 1, 4_096)


def rank_lists(lists: list[list[str]]) -> None:
    if len(lists) > 8 or any(len(x) > 50 for x in lists) or any(len(set(x)) != len(x) for x in lists):
        raise Invalid("at most 8 lists of at most 50 different candidates")
