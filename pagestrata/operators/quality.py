"""Quality scores of Markdown pages: counts, a score of 0 to 100, a rating and the reasons for a low signal.

Everything is a column expression over the text and its array of lines, so a page never leaves its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.text import lines, trimmed, trimmed_start

# The patterns counted, written so that both engines read them alike.
WORDS = "[A-Za-z0-9][A-Za-z0-9'_-]*"
LINKS = "\\[[^\\]]+\\]\\([^)]+\\)"
HTML_TAGS = "<[a-z][^>]*>"
COMPONENTS = "</?[A-Z][A-Za-z0-9]*(?:[ \\t\\n\\r\\f\\v][^>]*)?>"

# What a score begins with and what is taken off, the ratings' least scores and the limits of a low signal.
FULL_SCORE, UNTITLED, FEW_LINES, WEAK_STRUCTURE = 100, 12, 20, 8
#: Fewer words than this, and what that costs; the smallest limit that fits holds.
SHORT = [(15, 45), (40, 25), (80, 10)]
#: A share of text lines below this percentage, and what that costs.
THIN = [(45, 20), (60, 10)]
#: What each leftover tag or component costs, and at most.
TAG_COST, COMPONENT_COST = (3, 24), (4, 20)
LEAST_LINES, LONG_WITHOUT_HEADING = 3, 60
RATINGS = [(75, "high"), (45, "medium"), (0, "low")]
LOW_WORDS, LOW_SCORE = 40, 30


def _first(of: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    chosen = F.when(*of[0])
    for condition, value in of[1:]:
        chosen = chosen.when(condition, value)
    return chosen.otherwise(otherwise)


def with_metrics(pages: DataFrame, text: str = "markdown") -> DataFrame:
    """Adds the counts that a score is made of; a null text has nulls."""
    body = F.col(text)
    count = lambda pattern: F.regexp_count(body, F.lit(pattern)).cast("bigint")
    held = pages.withColumn("__lines", F.filter(lines(body), lambda x: trimmed(x) != ""))
    start = lambda x: trimmed_start(x)
    fence = lambda x: start(x).startswith("```")
    size = lambda rows: F.when(body.isNotNull(), F.size(rows).cast("bigint"))
    first = F.try_element_at("__lines", F.lit(1))
    return held.select(
        *pages.columns,
        count(WORDS).alias("word_count"),
        size(F.col("__lines")).alias("non_empty_lines"),
        size(F.filter("__lines", lambda x: ~fence(x) & x.rlike("[A-Za-z0-9]"))).alias("text_lines"),
        size(F.filter("__lines", lambda x: start(x).startswith("#"))).alias("heading_count"),
        F.floor(size(F.filter("__lines", fence)) / 2).alias("code_block_count"),
        count(LINKS).alias("link_count"),
        count(HTML_TAGS).alias("residual_html_tags"),
        count(COMPONENTS).alias("residual_mdx_components"),
        F.when(body.isNotNull(), F.coalesce(trimmed_start(first).startswith("# "), F.lit(False))).alias("title_present"),
    )


def _thin(percent: int) -> Column:
    """A density below a percentage, in whole numbers; without any line the density is 0."""
    return (F.col("text_lines") * 100 < F.col("non_empty_lines") * percent) | (F.col("non_empty_lines") == 0)


def with_score(metrics: DataFrame) -> DataFrame:
    """Adds text_density, score, rating, low_signal_reasons and low_signal to the counts."""
    words, tags, components = F.col("word_count"), F.col("residual_html_tags"), F.col("residual_mdx_components")
    weak, few = (F.col("heading_count") == 0) & (words > LONG_WITHOUT_HEADING), F.col("non_empty_lines") <= LEAST_LINES
    leftovers = [F.least(held * cost, F.lit(most)) for held, (cost, most) in ((tags, TAG_COST), (components, COMPONENT_COST))]
    # a page without words starts from nothing, whatever its title and length would take off
    whole = F.lit(FULL_SCORE) - F.when(F.col("title_present"), 0).otherwise(UNTITLED) - _first([(words < n, cost) for n, cost in SHORT], 0)
    taken = [F.when(few, FEW_LINES).otherwise(0), _first([(_thin(percent), cost) for percent, cost in THIN], 0), *leftovers, F.when(weak, WEAK_STRUCTURE).otherwise(0)]
    score = reduce(lambda left, cost: left - cost, taken, F.when(words == 0, 0).otherwise(whole))
    named = [
        ("missing_title", ~F.col("title_present")), ("empty_content", words == 0), ("very_short", (words > 0) & (words < SHORT[0][0])), ("short_content", (words >= SHORT[0][0]) & (words < SHORT[1][0])),
        ("too_few_lines", few), ("low_text_density", _thin(THIN[0][0])), ("residual_html", tags > 0), ("residual_mdx", components > 0), ("weak_structure", weak),
    ]
    reasons = F.array_compact(F.array(*[F.when(holds, reason) for reason, holds in named]))
    density = F.when(F.col("non_empty_lines") == 0, 0.0).otherwise(F.round(F.col("text_lines") / F.col("non_empty_lines"), 4))
    scored = metrics.withColumns({
        "text_density": density,
        "score": F.when(words.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), score))).cast("int"),
        "low_signal_reasons": F.when(words.isNotNull(), reasons),
    })
    rated = scored.withColumn("rating", _first([(F.col("score") >= least, rating) for least, rating in RATINGS]))
    return rated.withColumn("low_signal", is_low_signal(F.col("rating"), words, F.col("score")))


def is_low_signal(rating: Column, words: Column, score: Column) -> Column:
    return (rating == "low") & ((words < LOW_WORDS) | (score < LOW_SCORE))


def score_pages(pages: DataFrame, text: str = "markdown") -> DataFrame:
    return with_score(with_metrics(pages, text))


def summarize(scored: DataFrame, *by: str) -> DataFrame:
    """Pages by rating and signal, for all pages or by groups."""
    grouped = scored.groupBy(*by) if by else scored.groupBy()
    return grouped.agg(
        F.count_if(F.col("score").isNotNull()).alias("pages_scored"),
        F.count_if(F.col("rating") == "high").alias("high_quality_pages"),
        F.count_if(F.col("rating") == "medium").alias("medium_quality_pages"),
        F.count_if(F.col("rating") == "low").alias("low_quality_pages"),
        F.count_if(~F.col("title_present")).alias("missing_title_pages"),
        F.count_if((F.col("residual_html_tags") > 0) | (F.col("residual_mdx_components") > 0)).alias("residual_markup_pages"),
    )
