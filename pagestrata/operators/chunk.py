"""Section-aware overlapping chunks of Markdown pages.

Lines are exploded once; sections, heading paths, code fences and blocks are running aggregates over that
one partitioning. Each section's blocks are then packed by a walk over their counts of words.
"""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.functions.text import SPACE, lines, sha256_hex, trimmed, trimmed_start, word_count

TARGET_WORDS, OVERLAP_WORDS = 220, 40
HEADING = f"^[{SPACE}]*(#{{1,6}})([^#].*)?\\z"


def with_sections(pages: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """Each line with its section number, and the section's heading and path; a null text has no lines.

    A heading has one to six number signs and a title; no blank is needed between them, and code fences
    aren't looked at. Lines before the first heading form section 0 without heading and with an empty path.
    """
    rows = pages.where(F.col(text).isNotNull()).select(*keys, F.posexplode(lines(F.col(text))).alias("pos", "line"))
    start = trimmed_start(F.col("line"))
    level = F.length(F.regexp_extract(start, "^(#*)", 1))
    title = trimmed(F.substring(start, level + 1, 2**31 - 1))
    is_heading = level.between(1, 6) & (title != "")
    named = rows.withColumns({"level": F.when(is_heading, level), "title": F.when(is_heading, trimmed(F.regexp_replace(title, "^#+|#+\\z", "")))})
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = named.withColumn("section", F.count("level").over(order))
    # a heading's depth: one below the heading before it, but never deeper than its own level
    floor = F.min(F.col("level") - F.col("section")).over(order)
    deep = numbered.withColumn("depth", F.when(F.col("section") > 0, F.col("section") - 1 + F.least(F.lit(0), floor)))
    path = [F.last(F.when(F.col("level").isNotNull() & (F.col("depth") == d), F.col("title")), ignorenulls=True).over(order) for d in range(6)]
    heading = F.last("title", ignorenulls=True).over(order)
    full = F.when(F.col("section") > 0, F.slice(F.array(*path), 1, (F.col("depth") + 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    return deep.select(*keys, "pos", "line", "section", F.when(F.col("section") > 0, heading).alias("heading"), full.alias("section_path"))


def blocks(sectioned: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks of each section: runs of lines between blank lines; a code fence is kept whole.

    A closing fence ends a block; an opening one doesn't begin one; a fence left open swallows its section.
    """
    bare = trimmed(F.col("line"))
    inside = Window.partitionBy(*keys, "section").orderBy("pos")
    fence = (bare.startswith("```") | bare.startswith("~~~")).cast("int")
    before = F.coalesce(F.sum("fence").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = sectioned.withColumn("fence", fence).withColumn("in_fence", before % 2 == 1)
    blank = (bare == "") & ~F.col("in_fence")
    closed = F.coalesce(F.lag((F.col("fence") == 1) & F.col("in_fence")).over(inside), F.lit(False))
    cut = marked.withColumn("blank", blank).withColumn("edge", (F.col("blank") | closed).cast("int"))
    numbered = cut.withColumn("block", F.sum("edge").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    whole = (
        numbered.where(~F.col("blank"))
        .groupBy(*keys, "section", "block")
        .agg(F.first("heading").alias("heading"), F.first("section_path").alias("section_path"), trimmed(joined).alias("markdown"))
        .where("markdown <> ''")
    )
    return whole.withColumn("word_count", word_count(F.col("markdown")))


PACKS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


def pack(words: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """The blocks [s, e) of each chunk of a section, from the words of its blocks; each block is looked at a few times."""
    sums = [0, *accumulate(max(1, w) for w in words)]
    n, s, e, out = len(words), 0, 0, []
    while s < n:
        e = max(e, s + 1)
        while e < n and sums[e] - sums[s] < target:
            e += 1
        out.append((s, e))
        if e == n:
            break
        # the shared blocks: at least one, and back until they hold the overlap; none if that is the whole chunk
        back = e - 1
        while back > s and sums[e] - sums[back] < overlap:
            back -= 1
        s = e if back == s else back
    return out


def _packs(target: int, overlap: int):
    """``pack`` over the sections' counts of words. A walk whose steps depend on each other is quadratic as a fold of
    columns, whose state is copied at each step; only numbers go to Python and back.
    """

    @F.pandas_udf(PACKS)
    def packs(words: pd.Series) -> pd.Series:
        return pd.Series([pack(w.tolist(), target, overlap) for w in words], dtype=object)

    return packs(F.transform("blocks", lambda b: b["word_count"]))


def chunk_pages(pages: DataFrame, keys: list[str], text: str = "markdown", target_words: int = TARGET_WORDS, overlap_words: int = OVERLAP_WORDS) -> DataFrame:
    """The chunks of each page, numbered from 1: keys, ordinal, heading, section_path, markdown, word_count,
    sha256, byte_size and chunk_id.

    A chunk takes whole blocks until it holds the target; the next one begins with the last blocks that hold
    the overlap (at least one), or without any if these are the whole chunk. A block larger than the target
    is a chunk of its own. The first key names the page in chunk_id. Null and blank texts have no chunks.
    """
    per_section = blocks(with_sections(pages, keys, text), keys).groupBy(*keys, "section").agg(
        F.first("heading").alias("heading"), F.first("section_path").alias("section_path"),
        F.array_sort(F.collect_list(F.struct("block", "markdown", "word_count"))).alias("blocks"),
    )
    packed = per_section.withColumn("packs", _packs(target_words, overlap_words))
    parts = packed.select(*keys, "section", "heading", "section_path", "blocks", F.posexplode("packs").alias("part", "range"))
    body = trimmed(F.array_join(F.transform(F.slice("blocks", F.col("range.s") + 1, F.col("range.e") - F.col("range.s")), lambda b: b["markdown"]), "\n\n"))
    rows = parts.withColumn("markdown", body).where("markdown <> ''")
    ordinal = F.row_number().over(Window.partitionBy(*keys).orderBy("section", "part")).cast("bigint")
    numbered = rows.withColumn("ordinal", ordinal)
    name = F.concat_ws("::", F.col(keys[0]).cast("string"), F.col("ordinal").cast("string"), F.array_join("section_path", " > "))
    return numbered.select(
        *keys, "ordinal", "heading", "section_path", "markdown", word_count(F.col("markdown")).alias("word_count"),
        sha256_hex(F.col("markdown")).alias("sha256"), F.octet_length("markdown").cast("bigint").alias("byte_size"), sha256_hex(name).alias("chunk_id"),
    )


def summarize(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(chunk_count, chunked_pages, average_chunks_per_page)."""
    return chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"), F.count(F.lit(1)).alias("chunked_pages"),
        F.coalesce(F.round(F.avg("n"), 4), F.lit(0.0)).alias("average_chunks_per_page"),
    )
