"""HTML to Markdown by a fixed order of replacements.

The contract is this library's own: comments, scripts, styles, head and, unless asked for, navigation and
footer go first; headings, list items, links, strong text, code blocks, breaks and paragraphs become Markdown;
other tags are dropped; named entities are decoded, the ampersand last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagestrata.functions.text import trimmed

#: The named entities that are decoded, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")]


def html_to_markdown(html: Column, keep_chrome: bool = False) -> Column:
    """Markdown of a page, trimmed and with a final line end; null for null."""
    dropped = "script|style|head" + ("" if keep_chrome else "|nav|footer")
    steps = [("(?s)<!--.*?-->", ""), (f"(?is)<({dropped})\\b[^>]*>.*?</\\1\\s*>", "")]
    steps += [(f"(?is)<h{n}\\b[^>]*>(.*?)</h{n}\\s*>", "\n\n" + "#" * n + " $1\n\n") for n in range(1, 7)]
    steps += [
        ("(?is)<pre\\b[^>]*>(.*?)</pre\\s*>", "\n\n```\n$1\n```\n\n"),
        ("(?i)<li\\b[^>]*>", "\n- "),
        ('(?is)<a\\b[^>]*\\bhref="([^"]*)"[^>]*>(.*?)</a\\s*>', "[$2]($1)"),
        ("(?i)</?strong\\b[^>]*>", "**"),
        ("(?i)<br\\s*/?>", "\n"),
        ("(?i)</?p\\b[^>]*>", "\n\n"),
        ("(?s)<[a-zA-Z/!][^>]*>", ""),
    ]
    text = html
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    text = F.regexp_replace(text, "\n[ \\t]*\n(?:[ \\t]*\n)+", "\n\n")
    return F.concat(trimmed(text), F.lit("\n"))


def page_title(markdown: Column) -> Column:
    """The text of the first top heading; null if there is none."""
    found = F.regexp_extract(F.concat(F.lit("\n"), markdown), "\n# +([^\n]+)", 1)
    return F.when(found != "", trimmed(found))
