"""Abusive, hateful and sexual passages, scored by a bidirectional gated recurrent network.

A text's words are brought into a normal spelling (look-alike letters, digits for letters, letters set
apart, stretched letters), cut into windows at sentence ends, long sentences into overlapping windows; further
overlapping windows run over all words, so that a passage is seen whole where a line or a dot parts it. Every
window is scored. A word's input is an embedding of the word and one of its character trigrams, so
disguised and unseen words still have an input. Attention pools the states of both directions. Training and
scoring are numpy; the weights are trained by ``harm_training`` and shipped with the package.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATEGORIES = ("abusive", "hateful", "sexual")
WINDOW, STRIDE, SHORT = 28, 14, 5
BUCKETS, WORD_DIM, CHAR_DIM, STATES, ATTENTION = 8192, 16, 16, 16, 16
THRESHOLD = 0.9
#: A worker forgets the inputs of its words when it holds so many.
CACHE_WORDS = 120_000
#: Texts are scored together until they have so many characters; a longer one is scored by itself.
BATCH_CHARS = 4_000_000
WEIGHTS = os.path.join(os.path.dirname(__file__), "harm_weights.npz")

# Look-alike letters and signs, and the letters they stand for.
LOOK_ALIKE = str.maketrans(dict(zip("аеорсухкмтвніјѕԁһαορινκτ", "aeopcyxkmtbhijsdhaopivkt")))
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "€": "e"})

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_CODE = re.compile(r"`[^`\n]*`")
_TARGET = re.compile(r"\]\([^)\n]*\)")
_URL = re.compile(r"https?://\S*")
_APART = re.compile(r"(?<![\w])[^\W\d_](?:([ .\-_*])[^\W\d_])(?:\1[^\W\d_])+(?!\w)")
_EMPHASIS = re.compile(r"(?<![^\W_])(?<!\*)\*+|\*+(?![^\W_]|\*)")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_TOKEN = re.compile(r"@[\w-]+|[\w$!€@]*[*][\w*$!€@]*|[\w$€@](?:[\w$€@']|!(?=\w))*|[.!?…。！？\n]")
_ENDS = frozenset(".!?…。！？\n")
_WIDE = re.compile("[぀-ヿ㐀-鿿가-힯]")
_LATIN = re.compile("[a-z]")
_OTHER = re.compile("[Ͱ-ӿԀ-ԯ]")
_MIXED = re.compile(r"[^\W\d_].*[\d$@!€]|[\d$@!€].*[^\W\d_]")


@lru_cache(maxsize=200_000)
def normal_word(token: str) -> str | list[str] | None:
    """One token in its normal spelling; None for the end of a sentence, single characters for scripts without blanks."""
    if token in _ENDS:
        return None
    token = _STRETCHED.sub(r"\1", token)
    if token.isalpha() and token.isascii():
        return token
    if not token.isascii() and _WIDE.search(token):
        return list(token)
    if token[0] == "@" and len(token) > 3 and token[1:].replace("-", "").isalnum():
        return "@"
    if not any(c.isalpha() for c in token):
        return "*" if "*" in token else "#"
    if not token.isascii() and _LATIN.search(token) and _OTHER.search(token):
        token = token.translate(LOOK_ALIKE)
    if _MIXED.search(token) and "_" not in token:
        token = token.translate(LEET)
    return token


def sentences(text: str) -> list[list[str]]:
    """The normal words of each sentence; a line's end ends a sentence, and mixed-script lines are unmasked first."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if "`" in text:
        text = _CODE.sub(" codespan ", text)
    if "](" in text:
        text = _TARGET.sub("] ", text)
    if "://" in text:
        text = _URL.sub(" weblink ", text)
    if "*" in text:
        text = _EMPHASIS.sub(" ", text)
    text = _APART.sub(lambda m: m.group(0).replace(m.group(1), ""), text)
    out, now = [], []
    for word in map(normal_word, _TOKEN.findall(text)):
        if word is None:
            if now:
                out.append(now)
                now = []
        elif word.__class__ is list:
            now += word
        else:
            now.append(word)
    if now:
        out.append(now)
    return out


def windows(text: str | None) -> list[tuple[str, ...]]:
    """All windows of a text's sentences: a short one goes with the one behind it, long ones come in overlapping parts."""
    parts = sentences(text) if text else []
    return _cut(parts, _of_sentences(list(map(len, parts))))


def scored_windows(text: str | None) -> list[tuple[str, ...]]:
    """The windows that are scored: those of the sentences, and overlapping ones over all words of the text."""
    parts = sentences(text) if text else []
    return _cut(parts, spans(list(map(len, parts))))


def _cut(parts: list[list[str]], found: list[tuple[int, int]]) -> list[tuple[str, ...]]:
    words = [word for part in parts for word in part]
    return [tuple(words[low : low + size]) for low, size in found]


def spans(sizes: list[int]) -> list[tuple[int, int]]:
    """(first word, words) of each window that is scored, from the words of each sentence of a text."""
    return _of_sentences(sizes) + (_overlapping(0, sum(sizes)) if len(sizes) > 1 else [])


def _overlapping(low: int, size: int) -> list[tuple[int, int]]:
    if size <= WINDOW:
        return [(low, size)]
    return [(low + k, min(WINDOW, size - k)) for k in range(0, size - WINDOW + STRIDE, STRIDE)]


def _of_sentences(sizes: list[int]) -> list[tuple[int, int]]:
    out, low = [], 0
    for size, behind in zip(sizes, [*sizes[1:], 0]):
        whole = size + behind if size <= SHORT else size
        if whole <= WINDOW:
            out.append((low, whole))
        else:
            out += _overlapping(low, whole)
        low += size
    return out


def word_ids(word: str) -> tuple[int, list[int]]:
    """The buckets of a word and of its character trigrams."""
    padded = f"<{word}>"
    grams = [padded[i : i + 3] for i in range(max(1, len(padded) - 2))]
    return xxhash.xxh3_64_intdigest(word) % BUCKETS, [xxhash.xxh3_64_intdigest(g, seed=7) % BUCKETS for g in grams]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Scorer:
    """Scores windows with given weights.

    A window is a stretch of an array of words, and a step gathers the inputs of its words from tables, so neither
    windows nor their inputs are laid out. The sigmoids are written as tanh, whose halves are folded into the weights.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = w = {k: v.astype(np.float32) for k, v in weights.items()}
        gates = np.repeat(np.float32([0.5, 0.5, 1]), STATES)  # a sigmoid is a half and half a tanh of the half
        self.inward = [(w[f"w{d}"] * gates, w[f"b{d}"] * gates) for d in "fb"]
        self.recurrent = [np.stack(np.split(w[f"u{d}"] * np.float32(0.5), 3, axis=1)) for d in "fb"]
        self.rows: dict[str, int] = {}
        self.inputs = [np.zeros((3, 1024, STATES), dtype=np.float32) for _ in "fb"]

    def _row(self, word: str) -> None:
        row = len(self.rows)
        if row >= self.inputs[0].shape[1]:
            self.inputs = [np.concatenate([held, np.zeros_like(held)], axis=1) for held in self.inputs]
        bucket, grams = word_ids(word)
        x = np.concatenate([self.w["words"][bucket], self.w["grams"][grams].mean(axis=0)])
        for held, (inward, bias) in zip(self.inputs, self.inward):
            held[:, row] = (x @ inward + bias).reshape(3, STATES)
        self.rows[word] = row

    def words(self, flat: list[str]) -> np.ndarray:
        """The words' rows in the tables of inputs, which hold until the next call."""
        if len(self.rows) > CACHE_WORDS:
            self.rows.clear()
        for word in set(flat).difference(self.rows):
            self._row(word)
        return np.fromiter(map(self.rows.__getitem__, flat), np.intp, len(flat))

    def _run(self, direction: int, words: np.ndarray, out: np.ndarray, order: range) -> None:
        """The states of one direction after each step; ``words`` and ``out`` have the step first."""
        inputs, recurrent = self.inputs[direction], self.recurrent[direction]
        n = words.shape[1]
        h, x, a = np.zeros((n, STATES), dtype=np.float32), *(np.empty((3, n, STATES), dtype=np.float32) for _ in "xa")
        gates, keep, reset, new, held = x[:2], x[0], x[1], x[2], a[2]
        for t in order:
            for table, row in zip(inputs, x):
                np.take(table, words[t], axis=0, out=row, mode="clip")
            np.matmul(h, recurrent, out=a)
            gates += a[:2]
            np.tanh(gates, out=gates)
            gates += 1
            held *= reset
            new += held
            np.tanh(new, out=new)
            h -= new
            h *= keep
            h *= 0.5
            h += new
            out[t] = h

    def score_spans(self, words: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The probabilities of none and of each category, for each window: a stretch of ``words``."""
        w, out = self.w, np.zeros((len(low), 1 + len(CATEGORIES)), dtype=np.float32)
        for length in np.unique(size):
            same = np.flatnonzero(size == length)
            steps = np.arange(length)[:, None]
            for part in np.split(same, range(1024, len(same), 1024)):
                ids = words[low[part] + steps]
                forward, backward = (np.empty((length, len(part), STATES), dtype=np.float32) for _ in "fb")
                self._run(0, ids, forward, range(length))
                self._run(1, ids, backward, range(length - 1, -1, -1))
                e = forward.reshape(-1, STATES) @ w["wa"][:STATES]
                e += backward.reshape(-1, STATES) @ w["wa"][STATES:]
                np.tanh(e, out=e)
                share = np.exp(e @ w["va"]).reshape(length, len(part))
                share /= share.sum(axis=0)
                pooled = np.concatenate([np.einsum("tn,tnk->nk", share, h) for h in (forward, backward)], axis=1)
                y = pooled @ w["wo"] + w["bo"]
                y = np.exp(y - y.max(axis=1, keepdims=True))
                out[part] = y / y.sum(axis=1, keepdims=True)
        return out

    def score(self, found: list[tuple[str, ...]]) -> np.ndarray:
        """The probabilities of none and of each category, for each window given by its words."""
        size = np.array(list(map(len, found)), dtype=np.intp)
        return self.score_spans(self.words([word for window in found for word in window]), np.cumsum(size) - size, size)

    def top(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The highest score of any window per category, and the number of windows, of each text."""
        flat, found, first = [], [], []
        for text in texts:
            base, sizes = len(flat), []
            for part in sentences(text):
                flat += part
                sizes.append(len(part))
            first.append(len(found))
            found += [(base + low, size) for low, size in spans(sizes)]
        low, size = np.array(found, dtype=np.intp).reshape(-1, 2).T
        y = self.score_spans(self.words(flat), low, size)[:, 1:]
        if len(y):
            # a passage has one category: the others of its window don't count
            y[y < y.max(axis=1, keepdims=True)] = 0
        counts = np.diff([*first, len(found)])
        best = np.zeros((len(texts), len(CATEGORIES)), dtype=np.float32)
        if len(y):
            best[counts > 0] = np.maximum.reduceat(y, np.array(first)[counts > 0], axis=0)
        return best, counts


def load_weights(path: str = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as held:
        return {k: held[k].astype(np.float32) for k in held.files}


SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("windows", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in CATEGORIES],
])


def _score(path: str):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(load_weights(path))
        for batch in batches:
            texts = batch["text"].fillna("")
            group = texts.str.len().cumsum() // BATCH_CHARS
            for _, part in texts.groupby(group):
                codes, unique = pd.factorize(part)  # a text that comes again is scored once
                best, counts = scorer.top(list(unique))
                rows = batch.loc[part.index]
                yield pd.DataFrame({"doc_id": rows["doc_id"], "source": rows["source"], "windows": counts[codes], **{c: best[codes, k].astype(float) for k, c in enumerate(CATEGORIES)}})

    return score


def score_documents(documents: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """(doc_id, source, windows, abusive, hateful, sexual): the highest score of any window, per category.

    Null, empty and blank texts have no windows and zeros. Rows with a null doc_id are left out; repeated
    rows are scored as often as they come. ``weights`` is a file that every executor can read.
    """
    return documents.where("doc_id IS NOT NULL").select("doc_id", "source", "text").mapInPandas(_score(weights), SCORES)


def harmful_documents(documents: DataFrame, threshold: float = THRESHOLD, weights: str = WEIGHTS) -> DataFrame:
    """(doc_id, category) of every document with a window that scores above the threshold, each pair once."""
    pairs = F.array(*[F.when(F.col(c) > threshold, F.lit(c)) for c in CATEGORIES])
    scored = score_documents(documents, weights).select("doc_id", F.explode(F.array_compact(pairs)).alias("category"))
    return scored.distinct()


def rates_by_source(documents: DataFrame, threshold: float = THRESHOLD, weights: str = WEIGHTS) -> DataFrame:
    """(source, documents, and for each category the number and share of documents that hold it); null is a source."""
    over = [F.count_if(F.col(c) > threshold).alias(f"{c}_documents") for c in CATEGORIES]
    counts = score_documents(documents, weights).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), *over)
    return counts.select("*", *[(F.col(f"{c}_documents") / F.col("documents")).alias(f"{c}_rate") for c in CATEGORIES])
