"""Addresses: resolving, scope and policy checks."""

from __future__ import annotations

import ipaddress
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File endings of pages that may hold HTML.
HTML_ENDINGS = ("", "htm", "html", "xhtml", "shtml", "php", "asp", "aspx", "jsp")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def fragment(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?s)#(.*)$", 1), F.lit(""))


def join_url(base: str | None, href: str | None) -> str | None:
    """href resolved against base; None unless it is http(s) without credentials."""
    if base is None or href is None:
        return None
    try:
        url = urljoin(base, href.strip())
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname or parts.username or parts.password:
            return None
        return url
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def joined_url(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([join_url(b, h) for b, h in zip(base, href)], dtype=object)


def is_public(address: str | None) -> bool:
    """Whether an IP address can be reached by the public: no private, shared, test, or reserved range."""
    try:
        ip = ipaddress.ip_address((address or "").strip("[]"))
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_global and not ip.is_multicast


@F.pandas_udf(T.BooleanType())
def public_address(address: pd.Series) -> pd.Series:
    return address.map(is_public)


def in_scope(url: Column, root: str) -> Column:
    """Same origin as root and below its path on whole path parts; no per-cent signs, no credentials."""
    parts = urlsplit(root)
    prefix = parts.path.rstrip("/")
    origin = f"{parts.scheme}://{parts.netloc}".lower()
    bare = F.regexp_replace(url, r"[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1)
    inside = (path == prefix) | path.startswith(prefix + "/") if prefix else F.lit(True)
    return F.coalesce((host == origin) & inside & ~path.contains("%") & ~host.contains("@"), F.lit(False))


def path_depth(url: Column) -> Column:
    path = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1)
    return F.size(F.filter(F.split(path, "/"), lambda x: x != ""))


def html_candidate(url: Column) -> Column:
    """Whether the last path part has no ending, or one of a page."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/([^/]*)$", 1)
    return F.lower(F.regexp_extract(last, r"\.([^.]*)$", 1)).isin(*HTML_ENDINGS)


def under_prefix(url: Column, prefix: str) -> Column:
    """url is the prefix, or continues it by a path part or a query."""
    parts = urlsplit(prefix)
    whole = prefix + "/" if parts.path == "" and not parts.query else prefix
    stem = whole.rstrip("/")
    return (url == whole) | (url == stem) | url.startswith(stem + "/") | url.startswith(whole + "?")


def header(headers: Column, name: str) -> Column:
    """The first value of a header, whatever the letter case of its name."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.get(found, 0)["value"].cast("string")


@F.pandas_udf(T.BooleanType())
def valid_http_date(value: pd.Series) -> pd.Series:
    def good(x: str | None) -> bool:
        try:
            return x is not None and parsedate_to_datetime(x) is not None
        except (TypeError, ValueError):
            return False

    return value.map(good)


def valid_etag(value: Column) -> Column:
    return F.coalesce(value.rlike(r'^(W/)?"[\x21\x23-\x7e\x80-\xff]*"$'), F.lit(False))
