"""Text helpers whose meaning doesn't depend on the engine's own idea of white space or letters."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode's White_Space property as the inside of a character class.
SPACE = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: The same characters one by one; trimming by a list of them only looks at a text's ends.
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(text: Column) -> Column:
    """Without surrounding Unicode white space."""
    return F.btrim(text, F.lit(SPACES))


def trimmed_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def trimmed_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def lines(text: Column) -> Column:
    """The lines of a text: a final line end makes no empty last line, and a carriage return before one is dropped."""
    whole = F.regexp_replace(text, "\\r?\\n\\z", "")
    parts = F.split(F.regexp_replace(whole, "\\r\\n", "\n"), "\n")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(parts)


def ascii_lower(text: Column) -> Column:
    """Lower case for the 26 basic letters only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than Unicode white space."""
    return F.regexp_count(F.translate(text, SPACES, " " * len(SPACES)), F.lit("[^ ]+")).cast("bigint")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def html_escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def percent_decoded(text: Column) -> Column:
    """Percent escapes decoded; a plus sign stays one. Text with a broken escape is returned as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
