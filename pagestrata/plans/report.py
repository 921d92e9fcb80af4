"""HTML reports and chat messages of snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.text import html_escaped

STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px}.card{display:inline-block;border:1px solid #ccc;padding:8px 16px;margin:4px}"
FILTER = "<input id='f' placeholder='filter' oninput=\"for(const r of document.querySelectorAll('tbody tr'))r.hidden=!r.textContent.toLowerCase().includes(this.value.toLowerCase())\">"


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_key, row): a table row of HTML per page; what isn't known shows as n/a or a dash."""
    shown = lambda c, other: html_escaped(F.coalesce(c.cast("string"), F.lit(other)))
    address = F.coalesce(F.nullif("final_url", F.lit("")), F.col("url"), F.col("page_key"))
    profile = F.coalesce(F.try_element_at("normalization.profiles_applied", F.lit(1)), F.lit("generic"))
    cells: list[Column] = [
        shown(address, "-"), shown(F.col("status"), "-"), shown(F.col("change_status"), "unknown"), shown(F.col("fetch_method"), "-"), shown(profile, "generic"), shown(F.col("quality.rating"), "n/a"), shown(F.col("quality.score"), "-"), shown(F.col("byte_size"), "-"),
    ]
    return pages.select("page_key", F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>")).alias("row"))


def cards(counts: dict[str, object]) -> str:
    return "".join(f"<div class='card'><b>{v}</b><br>{k.replace('_', ' ')}</div>" for k, v in counts.items())


def snapshot_html(title: str, counts: dict[str, object], pages: DataFrame, limit: int = 2000) -> str:
    """A report of one snapshot: its counts and a table of its first ``limit`` pages by key.

    The limit is part of the report, as a browser can't show more; the counts are of all pages.
    """
    rows = page_rows(pages).orderBy("page_key").limit(limit).collect()
    heads = "".join(f"<th>{h}</th>" for h in ("page", "status", "change", "method", "profile", "quality", "score", "bytes"))
    body = "".join(r.row for r in rows)
    return f"<!doctype html><meta charset='utf-8'><title>{title}</title><style>{STYLE}</style><h1>{title}</h1>{cards(counts)}<p>{FILTER}</p><table><thead><tr>{heads}</tr></thead><tbody>{body}</tbody></table>"


def overview_html(overview: DataFrame, limit: int = 2000) -> str:
    """A report of all sources with the counts of their latest snapshots."""
    totals = overview.agg(*[F.sum(c).alias(c) for c in ("page_count", "changed_pages", "removed_pages", "low_quality_pages", "chunk_count")], F.count(F.lit(1)).alias("sources")).first().asDict()
    shown = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), html_escaped(F.coalesce(F.col(c).cast("string"), F.lit("-"))), F.lit("</td>")) for c in overview.columns], F.lit("</tr>"))
    rows = overview.select("source_name", shown.alias("row")).orderBy("source_name").limit(limit).collect()
    heads = "".join(f"<th>{c.replace('_', ' ')}</th>" for c in overview.columns)
    return f"<!doctype html><meta charset='utf-8'><title>Sources</title><style>{STYLE}</style><h1>Sources</h1>{cards(totals)}<p>{FILTER}</p><table><thead><tr>{heads}</tr></thead><tbody>{''.join(r.row for r in rows)}</tbody></table>"


def send_messages(messages: DataFrame, send: Callable[[str], None]) -> int:
    """Hands each message of (source_name, snapshot_label, message) to ``send``, one snapshot at a time; tells how many."""
    sent = 0
    for row in messages.orderBy("source_name", "snapshot_label").toLocalIterator():
        send(row.message)
        sent += 1
    return sent
