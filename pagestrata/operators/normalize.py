"""Markdown and MDX cleanup as one window plan.

A page's lines are exploded once. What a line becomes, and what it does to the dedenting behind it, depends
on the line alone; the state before a line is the last such event, and a repeated heading is one equal to
the last non-blank line. Both are windows over the same partitioning and order, so there is one shuffle. Only a
digest of the original text goes along with its lines, to tell whether it changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.functions.text import SPACE, ascii_lower, lines, trimmed, trimmed_end, trimmed_start

# The component names and markers of the documentation engines.
TITLED = "Step|Accordion|Tab|TabItem|Card|Details|Callout|VPCard"
CALLOUT_TAGS = {"<Info>": "Note:", "<Tip>": "Tip:", "<Warning>": "Warning:", "<Note>": "Note:", "<Check>": "Check:"}
CLOSING = [f"</{t}>" for t in "Info Tip Warning Note Check Tabs Steps Columns CardGroup AccordionGroup Step Accordion Tab TabItem Card Details Callout VPCard details".split()]
WRAPPERS = [*CLOSING, *[f"<{t}>" for t in "Tabs Steps Columns CardGroup AccordionGroup details Badge".split()], "</Badge>"]
CALLOUTS = {
    "tip": "Tip", "success": "Tip", "warning": "Warning", "danger": "Warning", "caution": "Warning", "check": "Check",
    "info": "Note", "note": "Note", "important": "Important", "example": "Example",
}

# The lines that the rules take, one pattern for each rule.
S = f"[{SPACE}]"
TOOLTIP = "<Tooltip[^>]*>(.*?)</Tooltip>"
COMPONENT = f"</?[A-Z][A-Za-z0-9]*(?:{S}[^>]*)?>"
OPEN_TAG = f"^<({TITLED})\\b([^>]*)/?>{S}*\\z"
GITBOOK = f"^\\{{%{S}*(hint|endhint|tabs|endtabs|tab|endtab)\\b(.*?)%\\}}{S}*\\z"
MKDOCS_TAB = f"^==={S}+[\"'](.+?)[\"']{S}*\\z"
MKDOCS_NOTE = f"^(?:!!!|\\?\\?\\?){S}+([A-Za-z_-]+)(?:{S}+[\"'](.+?)[\"'])?{S}*\\z"
MODULE = f"^(?:import{S}.+;|export{S}+(?:const|default|function|class)\\b.*)\\z"
COMMENT = f"^{S}*\\{{/\\*.*\\*/\\}}{S}*\\z|^{S}*<!--.*-->{S}*\\z"
SUMMARY = "^<summary>(.+)</summary>\\z"
FENCE = "^```([A-Za-z0-9_+-]+).*\\z"


def _attribute(attrs: Column, *names: str) -> Column:
    """The first of the named attributes that isn't blank."""
    return F.coalesce(*[F.nullif(trimmed(F.regexp_extract(attrs, f'{n}="([^"]+)"', 1)), F.lit("")) for n in names])


def _bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions refer to by value.

    The optimizer would copy an expression into each of its uses, and the rules refer to the same few values
    dozens of times. A one-element generator keeps it from doing so and stays within generated code.
    """
    value = F.struct(*[c.alias(n) for n, c in columns.items()])
    held = df.select("*", F.explode(F.array(value)).alias("__bound"))
    return held.select("*", *[F.col(f"__bound.{n}").alias(n) for n in columns]).drop("__bound")


def _without_index(rows: Column) -> Column:
    """The lines without a leading notice of a documentation index."""
    first = F.array_position(F.transform(rows, lambda x: trimmed(x) != ""), True).cast("int")
    rest = F.slice(rows, F.greatest(first, F.lit(1)), F.size(rows))
    opens = (F.size(rows) >= 3) & (first > 0) & trimmed(F.try_element_at(rest, F.lit(1))).startswith("> ## Documentation Index")
    named = F.exists(F.slice(rest, 1, 5), lambda x: x.contains("llms.txt"))
    quoted = F.transform(rest, lambda x: trimmed_start(x).startswith(">") | (trimmed(x) == ""))
    stop = F.array_position(quoted, False).cast("int")
    length = F.when(stop == 0, F.size(rest)).otherwise(stop - 1)
    found = F.coalesce(opens & named, F.lit(False))
    kept = F.concat(F.slice(rows, 1, F.greatest(first - 1, F.lit(0))), F.slice(rest, length + 1, F.size(rest)))
    return F.struct(F.when(found, kept).otherwise(rows).alias("rows"), F.when(found, length).otherwise(0).alias("removed"))


def _with_rules(lines_: DataFrame) -> DataFrame:
    """Adds what each line becomes by the first rule that fits: __emit, __wrappers, __assets, __profile, __event.

    A null __emit is the line itself without its inline component tags.
    """
    col = F.col
    tipped = _bound(lines_, __line2=F.when(F.contains("__line", F.lit("<Tooltip")), F.regexp_replace("__line", TOOLTIP, "$1")).otherwise(F.col("__line")))
    named = _bound(tipped, __t=trimmed(col("__line2")))
    t = col("__t")
    first_name = F.regexp_extract(F.regexp_replace(t, "^(?:</)*<*", ""), f"^([^{SPACE}]*)", 1)
    marked = t.rlike("^[<{=!?`ie]")  # what none of these begins is an ordinary line
    rule = F.when(marked, (
        F.when(t.rlike(MODULE) | t.rlike(COMMENT), "module")
        .when(t.contains("<img "), "asset")
        .when(t.rlike(GITBOOK), "gitbook")
        .when(t.rlike(MKDOCS_TAB), "tab")
        .when(t.rlike(MKDOCS_NOTE), "note")
        .when(t.rlike(OPEN_TAG), "open")
        .when(t.rlike(SUMMARY), "summary")
        .when(t.isin(*CALLOUT_TAGS), "callout")
        .when(t.isin(*WRAPPERS), "wrapper")
        .when(t.startswith("<Badge ") | t.startswith("<VPBadge "), "badge")
        .when(t.startswith("<") & t.endswith(">") & first_name.rlike("^[A-Z]"), "component")
        .when(t.rlike(FENCE), "fence")
        .otherwise("line")
    )).otherwise(F.when(t == "", "blank").when(t.contains("<img "), "asset").otherwise("line"))
    ruled = _bound(named, __r=rule)
    r = col("__r")
    pick = lambda g: F.when(r == "gitbook", F.regexp_extract("__t", GITBOOK, g)).when(r == "open", F.regexp_extract("__t", OPEN_TAG, g))
    parsed = _bound(
        ruled, __tag=pick(1), __attrs=pick(2),
        __word=F.when(r == "tab", trimmed(F.regexp_extract("__t", MKDOCS_TAB, 1))).when(r == "summary", trimmed(F.regexp_extract("__t", SUMMARY, 1))).when(r == "fence", F.regexp_extract("__t", FENCE, 1)),
        __bare=F.when((r == "line") & F.contains("__line2", F.lit("<")), F.regexp_replace("__line2", COMPONENT, "")).when(r == "line", F.col("__line2")),
    )
    tag, attrs = col("__tag"), col("__attrs")
    quoted = t.rlike(f"[\"'].+[\"']{S}*\\z")
    title = (
        F.when(r == "note", F.when(quoted, trimmed(F.regexp_extract("__t", MKDOCS_NOTE, 2))))
        .when(r == "open", _attribute(attrs, "title", "label", "value", "summary", "text"))
        .when(tag == "hint", _attribute(attrs, "title")).when(tag == "tab", F.coalesce(_attribute(attrs, "title", "label"), F.lit("Tab")))
    )
    kind = F.when(r == "note", F.regexp_extract("__t", MKDOCS_NOTE, 1)).when(tag == "hint", _attribute(attrs, "type", "style")).when(tag == "Callout", _attribute(attrs, "type"))
    card = tag.isin("Card", "VPCard")
    valued = _bound(
        parsed, __title=title, __kind=ascii_lower(F.coalesce(F.btrim(kind, F.lit('"')), F.lit("note"))), __href=F.when(card, _attribute(attrs, "href")), __desc=F.when(card, _attribute(attrs, "desc")),
        __known=F.lit(None).cast("string"),
    )
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in CALLOUTS.items() for x in kv]), F.col("__kind"))
    valued = _bound(valued.drop("__known"), __known=known)
    parts = F.filter(F.split("__kind", "[-_ ]"), lambda p: p != "")
    cased = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 10_000))), " ")
    # a title follows a known kind of callout and replaces an unknown one
    callout = (
        F.when(col("__known").isNull(), F.concat(F.coalesce("__title", cased), F.lit(":")))
        .when(F.coalesce("__title", F.lit("")) != "", F.concat("__known", F.lit(": "), "__title"))
        .otherwise(F.concat("__known", F.lit(":")))
    )
    text = lambda *out: F.array(*out).cast("array<string>")
    nothing = F.array().cast("array<string>")
    level = F.when(tag.isin("Tab", "TabItem"), "### ").otherwise("## ")
    calls = F.try_element_at(F.create_map(*[F.lit(x) for kv in CALLOUT_TAGS.items() for x in kv]), t)
    final = trimmed_end(col("__bare"))
    emit = (
        F.when(r == "blank", text(F.lit("")))
        .when((tag == "hint") | (tag == "Callout") | (r == "note"), text(callout))
        .when((tag == "tab") & (r == "gitbook"), text(F.concat(F.lit("### "), "__title")))
        .when(r == "tab", text(F.concat(F.lit("### "), "__word")))
        .when(r == "open", F.array_compact(F.array(F.concat(level, "__title"), F.concat(F.lit("Source: "), "__href"), F.col("__desc"))))
        .when(r == "summary", text(F.concat(F.lit("## "), "__word")))
        .when(r == "callout", text(calls))
        .when(r == "fence", text(F.concat(F.lit("```"), "__word")))
        .when((r == "line") & (final != ""), F.lit(None).cast("array<string>"))
        .otherwise(nothing)
    )
    stripped = (col("__bare") != col("__line2")).cast("int")
    wrappers = (
        F.when(r.isin("blank", "asset"), 0).when(r == "fence", (t != F.concat(F.lit("```"), "__word")).cast("int"))
        .when(r == "line", F.when(final == "", stripped + 1).otherwise(stripped)).otherwise(1)
    )
    profile = (
        F.when(r.isin("module", "component"), "mdx").when(r == "gitbook", "gitbook").when(r.isin("tab", "note"), "mkdocs").when(r == "badge", "vitepress").when(r == "summary", "docusaurus")
        .when(r == "callout", "mintlify").when(r == "wrapper", F.when(t.contains("details"), "docusaurus").otherwise("mintlify"))
        .when(r == "open", F.when(tag == "TabItem", "docusaurus").when(tag.isin("Callout", "Details"), "nextra").when(tag == "VPCard", "vitepress").otherwise("mintlify"))
    )
    event = F.when(r == "gitbook", tag.isin("hint", "tab", "tabs")).when(r.isin("tab", "note", "open", "summary", "callout"), True).when(r == "wrapper", False)
    done = _bound(valued, __emit=emit, __wrappers=wrappers, __assets=(r == "asset").cast("int"), __profile=profile, __event0=event, __tip=col("__line2") != col("__line"), __default=trimmed_end(col("__bare")))
    return done.drop("__t", "__r", "__tag", "__attrs", "__word", "__bare", "__title", "__kind", "__href", "__desc", "__known", "__line2")


def normalize_pages(pages: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """One row per page: the keys, the normalized ``markdown``, whether it ``changed``, the counters and profiles.

    A null text stays null with zero counters; an empty or blank text becomes one line end. Keys must tell
    pages apart: rows with equal keys are taken as one page. Profiles come in the order of their first line.
    """
    held = _bound(pages.select(*keys, F.col(text).alias("__text")), __original=_original(F.col("__text")))
    blank = F.array(F.lit(""))
    split = F.when(F.coalesce(F.col("__original"), F.lit("\n")) == "\n", blank).otherwise(lines(F.col("__original")))
    started = _bound(_bound(held, __rows=split), __index=_without_index(F.col("__rows")), __digest=F.md5("__original"))
    exploded = started.select(
        *keys, F.col("__text").isNull().alias("__null"), "__digest", F.col("__index.removed").alias("__removed"), F.posexplode_outer("__index.rows").alias("__pos", "__raw")
    )
    own = _bound(exploded, __line=F.replace(F.coalesce("__raw", F.lit("")), F.lit("\t"), F.lit("    "))).drop("__raw")
    own = own.withColumn("__lead", F.length("__line") - F.length(F.ltrim("__line")))
    ruled = _with_rules(own)
    bare_line = trimmed(F.col("__line"))
    closes = bare_line.isin(*CLOSING) | bare_line.startswith("{% end")
    off = F.when((F.col("__lead") < 4) & ~closes & (bare_line != ""), False)
    # a line that isn't emitted still has its row, for its event and its counters
    emitted = ruled.withColumn("__event", F.coalesce("__event0", off)).select(
        "*", F.col("__emit").isNull().alias("__plain"), F.posexplode_outer(F.when(F.col("__emit").isNull(), F.array(F.col("__default"))).otherwise(F.col("__emit"))).alias("__sub0", "__out"),
    )
    sub = F.coalesce("__sub0", F.lit(0))
    ready = _bound(emitted, __sub=sub, __shown=trimmed(F.col("__out"))).withColumn("__event", F.when(F.col("__sub") == 0, F.col("__event"))).drop("__sub0", "__emit", "__default", "__line", "__event0")
    order = Window.partitionBy(*keys).orderBy("__pos", "__sub").rowsBetween(Window.unboundedPreceding, -1)
    seen = ready.withColumns({
        "__dedent": F.coalesce(F.last("__event", ignorenulls=True).over(order), F.lit(False)),
        "__before": F.last(F.when(F.col("__shown") != "", F.col("__shown")), ignorenulls=True).over(order),
    })
    unindented = F.when(F.col("__plain") & F.col("__dedent") & (F.col("__lead") >= 4) & F.startswith(F.col("__out"), F.lit("    ")), F.substring(F.col("__out"), 5, 2**31 - 1)).otherwise(F.col("__out"))
    repeated = F.coalesce(F.col("__shown").startswith("#") & (F.col("__shown") == F.col("__before")), F.lit(False))
    final = seen.withColumns({"__final": unindented, "__repeated": repeated})
    once = lambda c: F.sum(F.when(F.col("__sub") == 0, c).otherwise(0))
    place = F.struct("__pos", "__sub", F.col("__final").alias("line"))
    profile = lambda k, when, p: F.collect_list(F.when(when & (F.col("__sub") == 0), F.struct("__pos", F.lit(k).alias("k"), p.alias("p"))))
    grouped = final.groupBy(*keys).agg(
        F.first("__null").alias("__null"), F.first("__digest").alias("__digest"), F.first("__removed").alias("__removed"),
        once(F.col("__wrappers") + F.col("__tip").cast("int")).alias("__wrappers"), once(F.col("__assets")).alias("asset_lines_removed"),
        F.sum(F.col("__repeated").cast("int")).alias("duplicate_headings_removed"),
        F.array_sort(F.collect_list(F.when(F.col("__final").isNotNull() & ~F.col("__repeated"), place))).alias("__kept"),
        profile(0, F.col("__tip"), F.lit("mintlify")).alias("__tips"), profile(1, F.col("__profile").isNotNull(), F.col("__profile")).alias("__profiles"),
    )
    joined = _bound(grouped, __fenced=F.concat(F.lit("\u0001\n"), F.array_join(F.transform("__kept", lambda k: k["line"]), "\n"), F.lit("\n\u0001")))
    closed = _bound(joined, __closed=F.regexp_replace("__fenced", "\n{3,}", "\n\n"))
    body = F.when(F.size("__kept") == 0, F.lit("")).otherwise(F.concat(trimmed(F.substring(F.col("__closed"), F.lit(3), F.length("__closed") - 4)), F.lit("\n")))
    blanks = F.when(F.size("__kept") == 0, 0).otherwise(F.length("__fenced") - F.length("__closed"))
    shaped = _bound(closed, markdown=F.when(~F.col("__null"), body), blank_lines_collapsed=blanks)
    profiles = F.array_distinct(F.transform(F.array_sort(F.concat("__tips", "__profiles")), lambda p: p["p"]))
    zero = lambda c: F.when(F.col("__null"), 0).otherwise(c).cast("bigint")
    return shaped.select(
        *keys, "markdown",
        F.when(~F.col("__null"), F.md5("markdown") != F.col("__digest")).alias("changed"),
        profiles.alias("profiles_applied"),
        zero((F.col("__removed") > 0).cast("int")).alias("boilerplate_blocks_removed"),
        zero(F.col("__wrappers") + F.col("__removed")).alias("component_wrappers_removed"),
        zero(F.col("duplicate_headings_removed")).alias("duplicate_headings_removed"),
        zero(F.col("asset_lines_removed")).alias("asset_lines_removed"),
        zero(F.col("blank_lines_collapsed")).alias("blank_lines_collapsed"),
    )


def _original(text: Column) -> Column:
    """The text that a change is told against: line ends unified, no outer white space, one final line end."""
    return F.concat(trimmed(F.replace(text, F.lit("\r\n"), F.lit("\n"))), F.lit("\n"))
