"""Corpus documents that hold passages of held-out test items, found with suffix arrays.

The corpus is read in shards. Each shard's words become one array of ids, and a suffix array sorts the
places where a match of the least length can begin: a place counts only if its next ``MIN_WORDS`` words all
occur in test items and lie in one document, which is necessary for a match and leaves few places. Every
suffix of every test item is then binary-searched in the shard, and matches are extended word by word to
their full length. Nothing is shuffled; the test items are sent in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.session import cut

MIN_WORDS = 12
#: Test items are sent to the executors in blocks of at most so many characters of prompt.
BLOCK_CHARS = 8_000_000
#: Documents whose characters add up to this make a shard.
SHARD_CHARS = 4_000_000

#: The characters dropped from a text before its words are taken (soft hyphen, zero-width space).
DROPPED = "­​"
_DROP = re.compile(f"[{DROPPED}]")
# letters and digits: the alphanumeric characters, without the underscore
_WORD = re.compile(r"[^\W_]+")

MATCHES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("doc_word", T.LongType()),
    T.StructField("item_word", T.LongType()),
    T.StructField("words", T.LongType()),
])


def words_of(text: str | None) -> list[str]:
    """The lower-case words: maximal runs of letters and digits, without soft hyphens and zero-width spaces."""
    if not text:
        return []
    if not text.isascii():
        text = _DROP.sub("", text)
    return _WORD.findall(text.lower())


class TestSuffixes:
    """The words of a block of test items as ids, with the starts of all suffixes of at least the least length."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], least: int = MIN_WORDS):
        self.least, self.ids = least, {}
        flat, self.item, self.start = [], [], []
        at, origin = [], []
        for item_id, prompt in items:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(prompt)]
            base = len(flat)
            for k in range(len(ids) - least + 1):
                at.append(base + k)
                self.item.append(item_id)
                origin.append(k)
            flat += ids
            flat += [0]  # ends an item: a match never goes on into the next one
        self.flat = np.array([*flat, *[0] * least], dtype=np.int32)
        self.at = np.array(at, dtype=np.int64)
        self.origin = np.array(origin, dtype=np.int64)
        self.item = np.array(self.item, dtype=np.int64)
        self.keys = pack(self.flat, self.at, least)


def pack(ids: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """The ``least`` ids from each place as byte strings whose order is that of the ids."""
    if not len(at):
        return np.zeros(0, dtype=f"S{4 * least}")
    windows = ids[at[:, None] + np.arange(least)].astype(">u4")
    return np.ascontiguousarray(windows).view(f"S{4 * least}").ravel()


def shard_matches(docs: list[tuple[int, str]], tests: TestSuffixes) -> list[tuple[int, int, int, int, int]]:
    """(doc_id, item_id, first word in the document, first word in the item, length) of each maximal match.

    A match that is the continuation of one that began a word earlier in both texts isn't repeated.
    """
    least, known = tests.least, tests.ids
    flat, starts, ends = [], [], []
    base = 0
    for _, text in docs:
        ids = [known.get(w, 0) for w in words_of(text)]
        starts.append(base)
        flat += ids
        base += len(ids)
        ends.append(base)
        flat.append(0)  # ends a document
        base += 1
    if base < least or not len(tests.at):
        return []
    ids = np.array([*flat, *[0] * least], dtype=np.int32)
    # the places whose next ``least`` words are all words of test items, none of them an end
    unknown = np.concatenate([[0], np.cumsum(ids == 0)])
    places = np.flatnonzero(unknown[least : base + 1] == unknown[: base + 1 - least])
    if not len(places):
        return []
    keys = pack(ids, places, least)
    order = np.argsort(keys, kind="stable")
    suffixes, keys = places[order], keys[order]
    low, high = np.searchsorted(keys, tests.keys, "left"), np.searchsorted(keys, tests.keys, "right")
    hit = np.flatnonzero(high > low)
    doc_of = np.array(starts)
    out = []
    for t in hit:
        item_at = tests.at[t]
        found = suffixes[low[t] : high[t]]
        before = tests.flat[item_at - 1] if item_at else 0
        if before:
            found = found[ids[found - 1] != before]
        for place in found:
            a, b, length = place + least, item_at + least, least
            while ids[a] != 0 and ids[a] == tests.flat[b]:
                a, b, length = a + 1, b + 1, length + 1
            d = int(np.searchsorted(doc_of, place, "right")) - 1
            out.append((docs[d][0], int(tests.item[t]), int(place - starts[d]), int(tests.origin[t]), length))
    return out


def _search(items: list[tuple[int, str]], least: int, shard_chars: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests = TestSuffixes(items, least)
        shard, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                shard.append((doc_id, text))
                size += len(text)
                if size >= shard_chars:
                    yield pd.DataFrame(shard_matches(shard, tests), columns=MATCHES.names)
                    shard, size = [], 0
        yield pd.DataFrame(shard_matches(shard, tests), columns=MATCHES.names)

    return search


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """The test items in blocks of at most about ``block_chars`` characters, by ranges of a hash of the id."""
    total = items.agg(F.sum(F.length("prompt"))).first()[0] or 0
    blocks = -(-total * 2 // block_chars) if total > block_chars else 1
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks)]


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS, block_chars: int = BLOCK_CHARS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, words): every maximal verbatim match of at least ``least`` words.

    Null and empty texts and prompts hold no passage; items shorter than ``least`` words can't leak. Repeated
    rows of a document or item give repeated matches once. If the items fill more than one block, each block's
    matches are written before the next block is collected, so the driver and a task hold one block at a time, and
    the corpus is read once for each block.
    """
    items = items.where("item_id IS NOT NULL AND prompt IS NOT NULL").select("item_id", "prompt").distinct()
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    found, blocks = None, item_blocks(items, block_chars)
    for block in blocks:
        rows = [(r.item_id, r.prompt) for r in block.orderBy("item_id", "prompt").collect()]
        part = texts.mapInPandas(_search(rows, least, shard_chars), MATCHES)
        part = cut(part) if len(blocks) > 1 else part
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def leaked_documents(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id), each pair once."""
    return leaked_passages(documents, items, least).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The documents that hold no passage of a test item; a null doc_id is kept."""
    return documents.join(leaked_documents(documents, items, least).select("doc_id").distinct(), "doc_id", "left_anti")
