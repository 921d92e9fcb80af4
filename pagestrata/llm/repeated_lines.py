"""Lines that a site repeats over its pages, found with bitmaps of pages and taken out of each page.

Every line's words give a key; lines that write the same words differently (case, markup, links) are
variants of it. Each source numbers its pages, and a key's pages are a bitmap over these numbers, kept as words
of 64 pages of which those without a page aren't stored, so a line on one page takes one word and no value grows
with the source. The bits of all variants are united while the words are built, their exact cardinality decides,
and a line goes if its page's bit is found in the bitmap of a repeated key. A key can only be repeated if it has
at least as many line rows as pages are asked for, which is checked first by a plain count, so bitmaps are built
only for the few keys that can still pass: with a share s there are at most (lines a page) / s of them per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.session import broadcast_if_small, cut

MIN_WORDS = 3
MIN_PAGES = 4
MIN_SHARE_PERCENT = 15

#: What is left out of a line before its words are taken. A link target goes from "](" to the
#: next ")", a URL to the next white space of any kind.
LINK_TARGET = r"\]\([^)]*\)"
URL = "https?://[^\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]*"


def line_words(line: Column) -> Column:
    """The lower-case words of a line, joined by blanks; link targets and URLs are left out."""
    bare = F.regexp_replace(F.regexp_replace(line, LINK_TARGET, "]"), URL, " ")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}]+", " "))


def page_lines(pages: DataFrame) -> DataFrame:
    """(body_id, source_name, line_no, line, words) of each line with ``MIN_WORDS`` words or more.

    A null text has no lines. Rows with a null body_id, source or page_key can't be named or belong to no
    site and are left out.
    """
    lines = (
        _of_sites(pages).where("markdown IS NOT NULL")
        .select("body_id", "source_name", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line"))
        .where(F.length("line") >= 2 * MIN_WORDS - 1)
    )
    return lines.withColumn("words", line_words(F.col("line"))).where(
        F.length("words") - F.length(F.replace("words", F.lit(" "))) >= MIN_WORDS - 1
    )


def _of_sites(pages: DataFrame) -> DataFrame:
    return pages.where("body_id IS NOT NULL AND source_name IS NOT NULL AND page_key IS NOT NULL")


def keyed_lines(pages: DataFrame) -> DataFrame:
    """(body_id, source_name, line_no, k1, k2): the lines by a 128-bit key of their words, from two seeds."""
    return page_lines(pages).select(
        "body_id", "source_name", "line_no", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit("second"), F.col("words")).alias("k2")
    )


def page_numbers(pages: DataFrame) -> DataFrame:
    """(body_id, n): the distinct page_keys of each source, numbered from 0, for each row of a page.

    A source may hold a third of all pages, so it isn't ranked as a whole: pages are counted by hash bucket,
    the buckets' offsets come from the small table of counts, and ranks are taken within a bucket.
    """
    keys = _of_sites(pages).select("body_id", "source_name", "page_key", F.pmod(F.xxhash64("page_key"), F.lit(1024)).alias("bucket"))
    inside = Window.partitionBy("source_name", "bucket").orderBy("page_key")
    ranked = keys.withColumn("rank", F.dense_rank().over(inside) - 1)
    sizes = ranked.groupBy("source_name", "bucket").agg((F.max("rank") + 1).alias("size"))
    before = Window.partitionBy("source_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("source_name", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return ranked.join(offsets, ["source_name", "bucket"]).select("body_id", (F.col("offset") + F.col("rank")).alias("n")).distinct()


def thresholds(pages: DataFrame, min_pages: int = MIN_PAGES, percent: int = MIN_SHARE_PERCENT) -> DataFrame:
    """(source_name, pages, least): how many distinct pages each source has, and on how many a line must occur."""
    counts = _of_sites(pages).select("source_name", "page_key").distinct().groupBy("source_name").agg(F.count(F.lit(1)).alias("pages"))
    share = F.floor((F.col("pages") * F.lit(percent) + F.lit(99)) / F.lit(100))
    return counts.withColumn("least", F.greatest(F.lit(min_pages), share).cast("bigint"))


KEY = ["source_name", "k1", "k2"]


def numbered_lines(lines: DataFrame, pages: DataFrame, min_pages: int = MIN_PAGES, percent: int = MIN_SHARE_PERCENT) -> DataFrame:
    """(body_id, line_no, source_name, k1, k2, least, word, bit) of the lines whose keys have enough rows to be repeated."""
    possible = (
        lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") >= min_pages)
        .join(thresholds(pages, min_pages, percent).select("source_name", "least"), "source_name")
        .where("rows >= least")
        .select(*KEY, "least")
    )
    numbered = lines.join(broadcast_if_small(cut(possible)), KEY).join(page_numbers(pages), "body_id")
    return numbered.select(
        "body_id", "line_no", *KEY, "least", F.shiftright("n", 6).alias("word"), F.expr("shiftleft(1L, CAST(n & 63 AS INT))").alias("bit")
    )


def repeated_keys(numbered: DataFrame) -> DataFrame:
    """(source_name, k1, k2, word, bits): the bitmaps, a row for each word, of the keys that are on ``least`` pages or more."""
    bitmaps = cut(numbered.groupBy(*KEY, "least", "word").agg(F.bit_or("bit").alias("bits")))
    hits = bitmaps.groupBy(*KEY, "least").agg(F.sum(F.bit_count("bits")).alias("on_pages")).where("on_pages >= least")
    return bitmaps.join(broadcast_if_small(cut(hits.select(*KEY))), KEY, "left_semi").drop("least")


def repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES, percent: int = MIN_SHARE_PERCENT) -> DataFrame:
    """(body_id, line_no) of every line that its source repeats.

    Repeated rows of a page count as one page. Lines of fewer than three words, blank lines and null texts
    have no row. A page delivered under two body_ids has its lines listed under both.
    """
    numbered = cut(numbered_lines(cut(keyed_lines(pages)), pages, min_pages, percent))
    found = numbered.join(repeated_keys(numbered), [*KEY, "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return found.select("body_id", F.col("line_no").cast("bigint").alias("line_no")).distinct()


def without_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The pages with ``markdown`` freed of the lines in ``found`` (body_id, line_no); other columns stay."""
    drop = found.groupBy("body_id").agg(F.collect_set("line_no").alias("__drop"))
    kept = F.filter(
        F.split("markdown", "\n"), lambda line, i: F.col("__drop").isNull() | ~F.array_contains("__drop", i.cast("bigint"))
    )
    return pages.join(drop, "body_id", "left").withColumn("markdown", F.array_join(kept, "\n")).drop("__drop")
