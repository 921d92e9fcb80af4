"""Cutting drafts that are too large into pieces of balanced size at natural boundaries.

Rows within their limit never leave the JVM. For the others the least number of pieces is computed, equally
long targets are placed, each is moved to the strongest boundary nearby, and the number of pieces grows
until every piece is within the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters of Unicode's White_Space property, as the inside of a character class.
WHITE_SPACE = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = re.compile(f"[^{WHITE_SPACE}]+")
FENCE = re.compile(r"[ \t]{0,3}(```+|~~~+)")
HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:\s|$)")
ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s")

#: How strong a boundary is before a word: a heading, a blank line, a list item, a line, a sentence, a clause, none.
STRENGTHS = {"heading": 6, "block": 5, "item": 4, "line": 3, "sentence": 2, "clause": 1, "none": 0}

PIECES = T.StructType([
    T.StructField("draft_id", T.LongType()),
    T.StructField("section_path", T.ArrayType(T.StringType())),
    T.StructField("piece_no", T.LongType()),
    T.StructField("pieces", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("words", T.LongType()),
    T.StructField("overlap", T.LongType()),
    T.StructField("boundary", T.StringType()),
    T.StructField("markdown", T.StringType()),
])


def word_count(text: Column) -> Column:
    """Maximal runs of characters that aren't Unicode white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE_SPACE}]+")), F.lit(0)).cast("bigint")


def boundaries(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """The spans of the words, and the strength of the boundary before each word.

    Inside a code fence only its lines are boundaries; a fence that is never closed counts as open to the
    end, so text without any blank line still has its lines and sentences.
    """
    spans = [m.span() for m in WORD.finditer(text)]
    strengths = [0] * len(spans)
    inside, line_start, previous_end = "", True, 0
    opening_lines: dict[int, bool] = {}
    at = 0
    for line in text.split("\n"):
        mark = FENCE.match(line)
        if mark and (not inside or mark.group(1)[0] == inside):
            opening_lines[at] = bool(inside)
            inside = "" if inside else mark.group(1)[0]
        elif inside:
            opening_lines[at] = True
        at += len(line) + 1
    for i, (start, _) in enumerate(spans):
        gap = text[previous_end:start] if i else "\n\n"
        breaks = gap.count("\n") or gap.count("\r")
        line_start = breaks > 0
        before = text[previous_end - 1] if i else ""
        in_code = False
        if line_start:
            head = text.rfind("\n", 0, start) + 1
            in_code = opening_lines.get(head, False)
            rest = text[head : text.find("\n", start) if text.find("\n", start) >= 0 else len(text)]
            if in_code:
                strengths[i] = STRENGTHS["line"]
            elif HEADING.match(rest):
                strengths[i] = STRENGTHS["heading"]
            elif breaks > 1:
                strengths[i] = STRENGTHS["block"]
            elif ITEM.match(rest):
                strengths[i] = STRENGTHS["item"]
            else:
                strengths[i] = STRENGTHS["line"]
        elif before and before in ".!?。！？…:;" or text[max(0, previous_end - 2) : previous_end] in ('."', ".)", '!"', '?"'):
            strengths[i] = STRENGTHS["sentence"] if before not in ":;" else STRENGTHS["clause"]
        elif before and before in ",、，)":
            strengths[i] = STRENGTHS["clause"]
        previous_end = spans[i][1]
    return spans, strengths


def cut_points(strengths: list[int], limit: int, overlap: int) -> list[int]:
    """The first new word of each piece but the first, so that with the overlap no piece exceeds ``limit``.

    ``overlap`` is taken as at most ``limit - 1``, as a piece must bring at least one new word.
    """
    n, step = len(strengths), limit - overlap
    if n <= limit:
        return []
    pieces = 1 + -(-(n - limit) // step)
    while True:
        length, cuts, last = n / pieces, [], 0
        for k in range(1, pieces):
            room = limit if k == 1 else step
            # what must still fit behind this cut bounds it from below, the limit from above
            low, high = max(last + 1, n - step * (pieces - k)), min(last + room, n - 1)
            if low > high:
                break
            target = min(max(round(k * length), low), high)
            reach = max(1, int(length / 4))
            window = range(max(low, target - reach), min(high, target + reach) + 1)
            last = max(window, key=lambda i: (strengths[i], -abs(i - target)))
            cuts.append(last)
        if len(cuts) == pieces - 1:
            return cuts
        pieces += 1


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str, str]]:
    """(first word, words, overlap, name of the boundary, text) of each piece.

    A piece is the exact stretch of the text from its first to its last word, so white space within it is
    kept; every piece but the first begins ``overlap`` words before the end of the one before it, or at
    that one's first word if it is shorter.
    """
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    spans, strengths = boundaries(text)
    cuts = [0, *cut_points(strengths, limit, overlap), len(spans)]
    names = {v: k for k, v in STRENGTHS.items()}
    out, previous_first = [], 0
    for k, (start, end) in enumerate(zip(cuts, cuts[1:])):
        shared = min(overlap, start - previous_first) if k else 0
        first = start - shared
        name = names[strengths[end]] if end < len(spans) else "end"
        out.append((first, end - first, shared, name, text[spans[first][0] : spans[end - 1][1]]))
        previous_first = first
    return out


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            pieces = split_text(row.markdown, row.target_words, row.overlap_words)
            path = None if row.section_path is None else list(row.section_path)
            rows += [(row.draft_id, path, k, len(pieces), *piece) for k, piece in enumerate(pieces)]
        yield pd.DataFrame(rows, columns=PIECES.names)


def with_limits(drafts: DataFrame, configs: DataFrame) -> DataFrame:
    """(draft_id, section_path, markdown, target_words, overlap_words, n_words) of each draft.

    A null config_id means the config with is_default (the least config_id, if several); a null
    overlap_words means none. A draft of an unknown config, or of one without a target, has no limit and is
    left out; a null text has no words. Rows delivered twice are kept as they are.
    """
    limits = configs.where("config_id IS NOT NULL AND target_words IS NOT NULL").groupBy("config_id").agg(
        F.max("target_words").alias("target_words"), F.max(F.coalesce("overlap_words", F.lit(0))).alias("overlap_words"), F.bool_or("is_default").alias("is_default")
    )
    default = limits.where("is_default").groupBy("is_default").agg(F.min_by(F.struct("target_words", "overlap_words"), "config_id").alias("d"))
    by_id = limits.drop("is_default").unionByName(default.select(F.lit(None).cast("int").alias("config_id"), "d.target_words", "d.overlap_words"))
    rows = drafts.select("draft_id", "section_path", "markdown", "config_id").alias("r")
    joined = rows.join(by_id.alias("l"), F.col("r.config_id").eqNullSafe(F.col("l.config_id")))
    return joined.select("draft_id", "section_path", "markdown", "target_words", "overlap_words", word_count(F.col("markdown")).alias("n_words"))


def split_drafts(drafts: DataFrame, configs: DataFrame) -> DataFrame:
    """The pieces of every draft that has more words than its config's target.

    Columns: draft_id, section_path (that of the draft), piece_no from 0, pieces, first_word, words, overlap,
    boundary (what the piece ends at) and markdown. No piece has more than target_words words. Drafts within
    their limit, empty and null ones have no row.
    """
    large = with_limits(drafts, configs).where("n_words > target_words").drop("n_words")
    return large.mapInPandas(_split, PIECES)
