"""Statistics of the main body of each page, and which pages are a list, a table or junk instead of prose.

The pass that finds the boilerplate also measures each line; statistics of a page are sums over the lines
that are left, so texts are read once and only numbers are moved. Repetition is measured by the shares of
lines and paragraphs that occur before on the page, by how much of a line its most frequent word pair covers,
and by how much of the page its dominant n-grams cover. The kind of a page follows from combined rules over
these figures. For the n-grams each page's tokens are numbered, and the numbers are moved.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.llm import boilerplate as B
from pagestrata.session import cut

#: Kinds of lines; those from CODE on aren't text.
NONE, PROSE, LIST, TABLE, JUNK, CODE, HEADING, TITLE = range(8)
KINDS = {LIST: "list", TABLE: "table", JUNK: "junk"}
#: A body is not prose if it has at most this many sentences outside of lists, tables and junk.
LEAD_SENTENCES = 1
#: The kind's lines hold at least this share of the body's characters, headings, code and the lead aside.
KIND_SHARE = 0.5
#: A line that one word pair covers to this extent, or with fewer different words than this, repeats itself.
PAIR_COVER = 0.4
DIFFERENT_WORDS = 0.34
#: A body repeats itself if one n-gram's later places hold more than this share of its characters; it has so many tokens at least.
REPEATED = 0.5
LEAST_TOKENS = 12
#: Pages are measured together until their tokens take so many bytes.
BATCH_BYTES = 1 << 20

# Frequent function words of the languages of the corpus.
COMMON = frozenset(
    """the a an and or of to in is are be it its this that for on with as by at from not no if when which than you your we our can may will has have had each every
    der die das den dem des ein eine und oder von zu im ist sind nicht mit auf für als bei nach wie wenn kann sie ihr es
    el la los las un una y o de en que es son no con por para se si cuando como más su
    и в на не с по к из за от до что как это для или если после перед при у о
    và của là không có được trong khi cho với các những này đã sẽ một từ sau trước nếu hay""".split()
)
_DIGIT = re.compile(r"\d")
# bytes that aren't letters, blanks by themselves, and bytes that aren't signs
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_BLANKS = bytes(c for c in range(128) if chr(c).isspace())
_NO_SIGNS = bytes(c for c in range(128) if chr(c).isspace() or chr(c).isalnum())
_WIDE = re.compile("[\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef]")
_SENTENCE = re.compile("[.!?\u3002\uff01\uff1f\u2026][\"')\\]*_`]*(?=\\s|$|[^\u0000-\u2e80])")
_ENTRY = re.compile(r"\s*(?:[-*+•–—▪◦‣]\s|\(?\d{1,4}[.)]\s|\[[ xX]\]\s|[a-z][.)]\s)")
_MARK = re.compile(r"\s*(?:[-*+•–—▪◦‣]|\(?\d{1,4}[.)])\s+(?:\[[ xX]\]\s+)?")
_GARBLED = re.compile("[\u00c2-\u00f4][\u0080-\u009f\u00a1-\u00bf\u20ac\u201a-\u201e\u2020-\u2022\u2026\u2030\u2039\u203a\u2018-\u201d\u2013\u2014\u2122\u0152\u0153\u0160\u0161\u017d\u017e\u0192\u02c6\u02dc]|\ufffd|[\u0080-\u0084\u0086-\u009f]")
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}", re.I)
_MINIFIED = re.compile(r"function\s*\(|=>|\breturn\b|\bvar\b|\)\s*[{;]|[;{}()]{2}")
_CODE_SIGN = re.compile(r"[(){};=,.]")
_CELLS = re.compile(r"\t+| {2,}| · | ; |;(?=\S)|,(?=\S)|\s\|\s")
_LINKS = re.compile(r"\[[^\]]+\]\([^)]+\)")
# letters of scripts without blanks between words, which are tokens by themselves
_UNBROKEN = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\uff66-\uff9f"
_NO_BLANKS = re.compile(f"[{_UNBROKEN}]")
_PIECES = re.compile(rf"[{_UNBROKEN}]|[^\s{_UNBROKEN}]+")
_SAFE = re.compile(r"`[^`]*`|https?://\S+|\[([^\]]*)\]\([^)]*\)")


_NOTHING = (NONE, 0, 0, 0, 0, 0, 0, 0, ())


def _pair_cover(words: list[str]) -> float:
    pairs = Counter(zip(words, words[1:]))
    return 2 * pairs.most_common(1)[0][1] / len(words) if pairs else 0.0


def _repeats(words: list[str]) -> bool:
    different = len(set(words))
    return different < DIFFERENT_WORDS * len(words) or different < 0.7 * len(words) and _pair_cover(words) > PAIR_COVER


def covers(pages: np.ndarray, tokens: np.ndarray, chars: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The share of each page's characters that its dominant n-gram covers, for n = 2, 4, 8 and so on while any repeats,
    and the largest share that later places of one of them hold. An n-gram's weight is its count by its length.

    The token at each place has the number of its page, which don't descend, a number that tells it apart on
    its page, and a length. A page without repeated n-grams has none of the next n.
    """
    size = int(pages[-1]) + 1 if len(pages) else 0
    total = np.bincount(pages, chars, minlength=size)
    out, again = {}, np.zeros(size)
    ends = np.concatenate([[0], np.cumsum(chars)])
    level = pd.factorize(pages * (int(tokens.max(initial=0)) + 1) + tokens)[0]
    n = 1
    while len(level) > n:
        # an n-gram twice as long is a pair of n-grams, side by side; what crosses a page's end is -1
        whole = (pages[:-n] == pages[n:]) & (level[:-n] >= 0) & (level[n:] >= 0)
        at = np.flatnonzero(whole)
        codes, grams = pd.factorize(level[at] * (int(level.max()) + 1) + level[at + n])
        n *= 2
        counts = np.bincount(codes, minlength=len(grams))
        first = np.empty(len(grams), dtype=np.int64)
        first[codes[::-1]] = at[::-1]
        long = ends[first + n] - ends[first]
        weight = np.where(counts > 1, counts * long, 0)
        of = pages[first]  # n-grams are numbered in order of their first place, so pages don't descend here either
        most = np.zeros(size, dtype=np.int64)
        np.maximum.at(most, of, weight)
        best = np.flatnonzero((weight == most[of]) & (weight > 0))[::-1]
        top = np.full(size, -1)
        top[of[best]] = best  # the first of equal ones, as it is written last
        if not len(best):
            break
        places = at[codes == top[pages[at]]]
        of_place = pages[places]
        before = np.where(of_place == np.roll(of_place, 1), np.roll(places + n, 1), 0)
        before[0] = 0
        covered = np.bincount(of_place, ends[places + n] - ends[np.maximum(places, before)], minlength=size)
        repeating = top >= 0
        out[n] = np.divide(covered, total, out=np.zeros(size), where=repeating)
        later = covered - np.where(repeating, long[top], 0)
        again = np.maximum(again, np.divide(later, total, out=np.zeros(size), where=repeating))
        level = np.full(len(pages), -1)
        level[at] = codes
        left = repeating[pages]  # whole pages go, so neighbours stay neighbours
        if not left.all():
            level, pages, ends = level[left], pages[left], np.concatenate([[0], np.cumsum(np.diff(ends)[left])])
    return out, again


def measure(line: str, role: int, known: tuple | None = None) -> tuple[int, int, int, int, int, int, int, int, list[str]]:
    """(kind, sentences, characters, words, letters, signs, common words, links, tokens) of one line; ``known`` as ``analyse`` has it."""
    stripped = line.strip()
    if not stripped:
        return _NOTHING
    links = len(_LINKS.findall(stripped)) if "](" in stripped else 0
    if role in (B.CODE, B.HEADING, B.TITLE):
        return ({B.CODE: CODE, B.HEADING: HEADING, B.TITLE: TITLE}[role], 0, len(stripped), 0, 0, 0, 0, links, ())
    if known:
        bare, (lower, words) = stripped, known
    else:
        bare = _SAFE.sub(r"\1", stripped) if "`" in stripped or "](" in stripped or "://" in stripped else stripped
        lower = bare.lower()
        words = B.words_of(lower)
    tokens = lower.split()
    plain = bare.isascii()
    if plain:  # byte tables take the characters out that don't count
        raw = lower.encode()
        letters, solid = len(raw.translate(None, _NO_LETTERS)), len(raw.translate(None, _BLANKS))
        signs = len(raw.translate(None, _NO_SIGNS))
        ended, wide = "." in stripped or "!" in stripped or "?" in stripped or not stripped.isascii(), 0
    else:
        letters, solid = sum(map(len, words)), sum(map(len, tokens))
        signs = max(0, solid - letters - len(_DIGIT.findall(bare)))
        ended, wide = True, len(_WIDE.findall(bare))
    common = len(COMMON.intersection(tokens))
    sentences = len(_SENTENCE.findall(stripped)) if ended and role != B.TABLE else 0
    kind = NONE
    if role == B.TABLE:
        kind = TABLE
    elif not plain and len(_GARBLED.findall(stripped)) >= max(3, letters // 6):
        kind = JUNK
    elif len(words) >= 12 and not wide and _repeats(words):
        kind = JUNK
    elif _ENTRY.match(line) or role == B.LINK:
        entry = _MARK.sub("", bare, count=1)
        kind = LIST if not _is_junk(entry, B.words_of(entry.lower()), common, wide) else JUNK
    elif common > 2 and sentences:
        kind = PROSE
    elif _is_junk(bare, words, common, wide):
        kind = JUNK
    elif _is_row(stripped, words, sentences, common):
        kind = LIST if " · " in stripped else TABLE  # dots set the items of an entry apart, not the columns of a table
    elif sentences and (common > 1 or common and len(words) >= 3 or wide >= 4 or len(words) >= 4):
        kind = PROSE
    elif common >= 2 or wide >= 12 or len(words) >= 9:
        kind, sentences = PROSE, max(1, sentences)
    if not plain and _NO_BLANKS.search(lower):
        tokens = _PIECES.findall(lower)
    return (kind, sentences, len(stripped), len(words), letters, signs, common, links, tokens)


#: The site's elements recur, so they are measured once per worker.
_measured = lru_cache(maxsize=20_000)(measure)


def _is_row(text: str, words: list[str], sentences: int, common: int) -> bool:
    """Three or more short cells parted by tabs, runs of blanks, dots, commas or semicolons."""
    if common > 2:
        return False
    cells = [c for c in _CELLS.split(text) if c.strip()]
    if len(cells) < 3:
        return False
    long = sum(len(c.split()) > 3 or len(c) > 40 for c in cells)
    ends = text[-1] in ".!?。"
    return not long and not (ends and sentences and common) and (len(cells) > 3 or "\t" in text or "  " in text or " · " in text or len(words) >= 2)


def _is_junk(text: str, words: list[str], common: int, wide: int) -> bool:
    """Encoded data, minified code or random characters; two function words or a third of wide letters say no."""
    tokens = text.split()
    solid = sum(map(len, tokens))
    if common > 1 or solid < 12 or wide > solid // 3:
        return False
    longest = max(tokens, key=len)
    if len(longest) >= 32 and not longest.startswith(("http", "/", "git+")):
        upper = sum(map(str.isupper, longest))
        if 4 < upper < len(longest) - 4 or len(longest) > 45 and longest.isalnum() and longest.isascii():
            return True
    if len(_MINIFIED.findall(text)) >= 4 and len(_CODE_SIGN.findall(text)) > solid // 7:
        return True
    rough = len(_CONSONANTS.findall(text))
    if rough >= 2 and rough * 16 > solid:
        return True
    signs = solid - sum(map(str.isalnum, text))
    return signs > 0.35 * solid and len(words) < solid / 8


def page_kind(kinds: list[int], sentences: list[int], chars: list[int], keys: list[int], text: list[int], parts: dict[int, bytes], repeated: float) -> str | None:
    """``list``, ``table``, ``junk`` or None for prose, from the measures of the lines of ``text`` and the tokens of those without a kind.

    ``repeated`` is the share of their characters that later places of one n-gram hold.
    """
    weight, prose, lead, other, seen, again = Counter(), 0, 0, 0, set(), 0
    for i in text:
        kind = kinds[i]
        if kind == NONE:
            if parts[i] in seen:
                again += chars[i]
            else:
                other += chars[i]
                seen.add(parts[i])
        elif kind == PROSE:
            if keys[i] and keys[i] in seen:  # a line that was there before is repetition
                again += chars[i]
                continue
            prose += sentences[i]
            lead += chars[i]
            seen.add(keys[i])
        else:
            weight[kind] += chars[i]
    running = lead + other + again + weight[JUNK]
    if repeated > REPEATED and running > weight[LIST] + weight[TABLE]:
        return KINDS[JUNK]
    weight[JUNK] += again if again > lead + other else 0
    if not any(weight.values()):
        return None
    top, most = max(weight.items(), key=lambda kv: kv[1])
    if prose > LEAD_SENTENCES and not (top == JUNK and most >= KIND_SHARE * (lead + sum(weight.values()))):
        return None  # stray lines of random characters may look like sentences, so junk is weighed against them
    return KINDS[top] if most >= KIND_SHARE * sum(weight.values()) else None


#: What is kept of each line, one after the other; figures of all lines of a page are one array of them.
MEASURES = ["kinds", "sentences", "chars", "words", "letters", "signs", "common", "links", "sizes"]
LINES = T.StructType([*B.LINES.fields, *[T.StructField(m, T.BinaryType()) for m in ("figures", "lengths", "tokens")]])


def _numbered(parts: list[list[str]]) -> tuple[bytes, bytes]:
    """The length of each different token, and the tokens by their numbers."""
    numbers: dict[str, int] = defaultdict(count().__next__)
    tokens = list(map(numbers.__getitem__, chain.from_iterable(parts)))
    return array("i", map(len, numbers)).tobytes(), array(_code(len(numbers)), tokens).tobytes()


def _code(different: int) -> str:
    return "H" if different <= 1 << 16 else "I"


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch.pop("markdown"):
            known: list = []
            roles, keys, blocks = B.analyse(text, known)
            figures = [_measured(line, role) if role >= B.FIRST_ELEMENT else measure(line, role, seen) for line, role, seen in zip(text.split("\n"), roles, known)] if text else []
            *columns, parts = zip(*figures) if figures else [()] * len(_NOTHING)
            held = array("i")
            for column in (*columns, map(len, parts)):
                held.extend(column)
            rows.append((*B.packed(roles, keys, blocks), held.tobytes(), *_numbered(parts)))
        for name, column in zip(["roles", "keys", "blocks", "figures", "lengths", "tokens"], zip(*rows) if rows else [()] * 6):
            batch[name] = pd.Series(column, index=batch.index, dtype=object)
        yield batch


#: The n-grams whose cover is given; longer ones count for repeated_share.
COVERS = (2, 4, 8, 16)
STATISTICS = T.StructType([
    T.StructField("body_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    *[T.StructField(n, T.LongType()) for n in ("word_count", "text_lines", "chrome_lines", "list_lines", "table_lines", "junk_lines", "sentences", "link_count")],
    *[T.StructField(n, T.DoubleType()) for n in ("mean_word_length", "symbol_share", "ended_share", "common_share", "duplicate_line_share", "duplicate_paragraph_share", "text_density", *[f"cover_{n}_gram" for n in COVERS], "repeated_share")],
])


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hosts = B.Hosts()
    for batch in batches:
        # pages are done together until they have so many bytes of tokens; a larger one is done by itself
        for _, part in batch.groupby(batch["tokens"].map(len).cumsum() // BATCH_BYTES):
            yield pd.DataFrame(_page_rows(part, hosts), columns=STATISTICS.names)


def _page_rows(batch: pd.DataFrame, hosts: B.Hosts) -> list[tuple]:
    pages, tokens, chars, measured = [], [], [], []
    for at, row in enumerate(batch.itertuples(index=False)):
        roles, keys = list(row.roles), row.keys.tolist()
        chrome = set(B.chrome_lines(roles, keys, row.blocks.tolist(), hosts.keys(row.source_name, row.recurring)))
        figures = np.frombuffer(row.figures, dtype=np.int32).reshape(len(MEASURES), -1)
        lengths = np.frombuffer(row.lengths, dtype=np.int32)
        numbers = np.frombuffer(row.tokens, dtype=_code(len(lengths)))
        kinds, chars_of = figures[0].tolist(), figures[2].tolist()
        text = [i for i, kind in enumerate(kinds) if kind < CODE and chars_of[i] and i not in chrome]
        in_text = np.zeros(len(roles), dtype=bool)
        in_text[text] = True
        body = numbers[np.repeat(in_text, figures[-1])]
        pages.append(np.full(len(body), at))
        tokens.append(body)
        chars.append(lengths[body])
        measured.append((row.body_id, roles, keys, chrome, kinds, figures, text, numbers, len(body)))
    none = [np.zeros(0, dtype=np.int64)]
    cover, repeated = covers(*(np.concatenate(x or none).astype(np.int64) for x in (pages, tokens, chars)))
    fill = np.zeros(len(measured))
    repeated = np.concatenate([repeated, fill[len(repeated) :]])
    shares = [np.concatenate([cover.get(n, fill[:0]), fill])[: len(fill)] for n in COVERS]
    return [_page_row(*m, repeated[at], [s[at] for s in shares]) for at, m in enumerate(measured)]


def _page_row(body_id, roles, keys, chrome, kinds, figures, text, numbers, size, repeated, shares) -> tuple:
    sentences, chars = figures[1].tolist(), figures[2].tolist()
    starts = np.concatenate([[0], np.cumsum(figures[-1])])
    # lines without a kind are the same only if they have the same tokens, numbers among them
    parts = {i: numbers[starts[i] : starts[i + 1]].tobytes() for i in text if kinds[i] == NONE}
    kept = [i for i in range(len(roles)) if i not in chrome and chars[i]]
    kinds_of_text = Counter(kinds[i] for i in text)
    words, letters, signs, common = figures[3:7, text].sum(axis=1).tolist()
    hashed = [keys[i] for i in text if keys[i]]
    # a block of text ends before a text line that follows a blank one
    breaks = np.cumsum(np.frombuffer(bytes(roles), dtype=np.uint8) == B.BLANK)[text].tolist()
    blocks = [tuple(keys[i] for _, i in same) for _, same in groupby(zip(breaks, text), key=itemgetter(0))]
    share = lambda part, whole: part / whole if whole else 0.0
    return (
        body_id, page_kind(kinds, sentences, chars, keys, text, parts, repeated if size >= LEAST_TOKENS else 0.0) or "prose",
        words, len(text), len(chrome), kinds_of_text[LIST], kinds_of_text[TABLE], kinds_of_text[JUNK], sum(sentences[i] for i in text), int(figures[7, kept].sum()),
        share(letters, words), share(signs, letters + signs), share(sum(sentences[i] > 0 for i in text), len(text)), share(common, words),
        share(len(hashed) - len(set(hashed)), len(hashed)), share(len(blocks) - len(set(blocks)), len(blocks)), share(len(text), len(kept)),
        *shares, repeated,
    )


def _measured_pages(pages: DataFrame) -> DataFrame:
    texts = pages.where("body_id IS NOT NULL").select("body_id", "source_name", "page_key", "markdown")
    return B.with_recurring(cut(texts.mapInPandas(_measure, LINES))).mapInPandas(_statistics, STATISTICS)


def page_statistics(pages: DataFrame) -> DataFrame:
    """The statistics of each page's main body, one row per body_id, and its kind: prose, list, table or junk.

    Figures are those of the lines that are neither boilerplate, heading nor code: word_count (runs of
    letters), text_lines, sentences, mean_word_length, symbol_share (of letters and signs), ended_share (lines
    with the end of a sentence), common_share (function words), duplicate_line_share,
    duplicate_paragraph_share, text_density (text lines of all lines of the body), link_count (of all lines of
    the body), cover_2_gram to cover_16_gram (characters that the dominant n-gram covers; words, or characters
    of scripts without blanks) and repeated_share (those at later places of one n-gram, of any n). An empty, blank or null
    text has zeros and counts as prose, as it is no list, table or junk. Of rows with one
    body_id the one with the greatest figures holds, the kind being the first of them.
    """
    # repeated rows are told apart by their figures, not by their texts, so no text is moved
    held = F.max(F.struct(*STATISTICS.names[1:])).alias("held")
    return _measured_pages(pages).groupBy("body_id").agg(held).select("body_id", "held.*")


def pages_without_prose(pages: DataFrame) -> DataFrame:
    """(body_id, kind) of every page whose main body is a list, a table or junk, as ``page_statistics`` has it."""
    return _measured_pages(pages).groupBy("body_id").agg(F.max("kind").alias("kind")).where(F.col("kind") != "prose")
