"""Fetching pages over HTTP on the executors."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pagestrata.functions.given import first_given

#: What is asked for, and how long to wait.
ACCEPT = "text/markdown, text/plain;q=0.9, */*;q=0.1"
TIMEOUT_S = 30
RESPONSE = "url string, final_url string, status_code int, content_type string, etag string, last_modified string, markdown_tokens int, original_tokens int, content_signal string, body string, raw binary, error string"


def get(url: str, etag: str | None = None, last_modified: str | None = None, proxy: str | None = None) -> dict:
    """One request; a page that is unchanged by its validators answers 304, a failure has its text in ``error``.

    Without ``proxy`` that of the environment is used, if there is one.
    """
    headers = {"Accept": ACCEPT}
    headers |= {"If-None-Match": etag} if etag else {}
    headers |= {"If-Modified-Since": last_modified} if last_modified else {}
    out = dict.fromkeys([c.split()[0] for c in RESPONSE.split(", ")]) | {"url": url, "final_url": url}
    handlers = [urllib.request.ProxyHandler({"http": proxy, "https": proxy})] if proxy else []
    number = lambda v: int(v) if v and v.isdigit() else None
    try:
        try:
            reply = urllib.request.build_opener(*handlers).open(urllib.request.Request(url, headers=headers), timeout=TIMEOUT_S)
        except urllib.error.HTTPError as answer:
            reply = answer
        with reply:
            h, raw = reply.headers, reply.read()
            return out | {
                "final_url": reply.geturl(), "status_code": reply.status, "content_type": h.get("Content-Type"), "etag": h.get("ETag"), "last_modified": h.get("Last-Modified"),
                "markdown_tokens": number(h.get("x-markdown-tokens")), "original_tokens": number(h.get("x-original-tokens")), "content_signal": h.get("content-signal"), "body": raw.decode("utf-8", "replace"), "raw": raw,
            }
    except (OSError, ValueError) as trouble:
        return out | {"error": str(trouble)}


def fetch(frontier: DataFrame, request: Callable[..., dict] = get, proxy: str | None = None) -> DataFrame:
    """The responses to the addresses of a frontier (url, and optionally etag and last_modified of the page before).

    A task asks for its addresses one after the other; how many sites are asked at once is the number of
    partitions. A request may be repeated if an executor is lost. The proxy is the first one given of ``proxy`` and
    the frontier's own ``proxy_url``; it is passed to ``request`` if there is one.
    """
    names = [c.split()[0] for c in RESPONSE.split(", ")]
    extra = [c for c in ("etag", "last_modified", "proxy_url") if c in frontier.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                through = first_given(proxy, r.get("proxy_url"))
                rows.append(request(r["url"], r.get("etag"), r.get("last_modified"), *([through] if through else [])))
            out = pd.DataFrame(rows, columns=names)
            for c in ("status_code", "markdown_tokens", "original_tokens"):
                out[c] = out[c].astype("Int32")
            yield out

    return frontier.select("url", *extra).mapInPandas(run, RESPONSE)
