"""Encoding a whole corpus with a public byte-level BPE vocabulary.

The texts of a batch become one array of code points. Boundaries between pre-tokens are found on the array
of their classes, without a regular expression: each class change is a transition function that forgets
everything before it, so composing the functions (an associative scan) keeps only the last change, and the
boundaries follow from comparisons of neighbouring elements and of run lengths. The slices are encoded by
merging byte pairs, each distinct slice once per worker. Batches go through Arrow without Python rows.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTER, NUMBER, OTHER, SPACE, END = 1, 2, 3, 4, 5
#: The code points of Unicode's White_Space property, as inclusive ranges.
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
#: The endings that an apostrophe forms a pre-token with.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

#: A worker forgets its encoded slices when it holds so many.
CACHE_SLICES = 2_000_000
#: Characters encoded at once; a longer text is still encoded as a whole.
BATCH_CHARS = 2_000_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed package of public tokenizers keeps a file."""
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None or not spec.submodule_search_locations:
        raise FileNotFoundError(f"give the path of {name}: the package public_tokenizers isn't installed")
    return os.path.join(list(spec.submodule_search_locations)[0], name)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    for low, high in WHITE_SPACE:
        table[low : high + 1] = SPACE
    return table


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pre-tokens start; ``ends`` are the places of the end marks of the texts, one behind each.

    A run of letters, of numbers or of other signs is a pre-token, with one blank before it. White space
    before a text's end is one pre-token; elsewhere its last character stands apart from the ones before it
    and, if it is a blank, belongs to what follows. An apostrophe and an ending are one where they begin.
    """
    n = len(points)
    kind = class_table()[points]
    kind[ends] = END
    changed = np.empty(n, dtype=bool)
    changed[0] = True
    np.not_equal(kind[1:], kind[:-1], out=changed[1:])
    start = changed.copy()
    space = kind == SPACE
    # the last white space before something else starts a pre-token
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & changed[1:] & (kind[1:] != END)
    start |= last
    # a blank in that place takes the run behind it along
    taken = np.flatnonzero(last & (points == 32)) + 1
    start[taken] = False

    mark = np.flatnonzero((points[:-2] == 39) & changed[:-2] & changed[1:-1] & (kind[1:-1] == LETTER)) if n > 2 else np.zeros(0, dtype=np.int64)
    mark = mark[start[mark]]  # one behind a blank is taken
    if len(mark):
        first, second = points[mark + 1], points[mark + 2]
        for ending in ENDINGS:
            fits = first == ord(ending[0])
            if len(ending) == 2:
                fits &= second == ord(ending[1])
            hit = mark[fits]
            start[hit + 1] = False
            behind = hit + 1 + len(ending)
            start[behind[behind < n]] = True
    start[ends] = True
    return np.flatnonzero(start)


class Encoder:
    """Byte pair merging with a cache of slices."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one slice: of the neighbours that form a token, those of the lowest rank are joined first."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > 300:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, rank = -1, None
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (rank is None or r < rank):
                    best, rank = i, r
            if rank is None:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap and links, for slices whose square would hurt."""
        import heapq

        ranks, n = self.ranks, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop:
                continue
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offset of each text's ids, start in its text of the slice that each id belongs to).

        A null text has the ids of an empty one: none.
        """
        texts = [t or "" for t in texts]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        joined = "\0".join([*texts, ""])
        if not len(joined):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int32), np.zeros(0, dtype=np.int32)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(lengths + 1) - 1
        starts = boundaries(points, ends)
        is_end = np.zeros(len(points), dtype=bool)
        is_end[ends] = True
        a, b = starts[:-1], starts[1:]
        real = ~is_end[a]
        a, b = a[real], b[real]
        if len(self.cache) > CACHE_SLICES:
            self.cache.clear()
        cache, merge = self.cache, self.merge
        slices = [joined[i:j] for i, j in zip(a.tolist(), b.tolist())]
        parts = list(map(cache.get, slices))
        if None in parts:
            for k, part in enumerate(parts):
                if part is None:
                    s = slices[k]
                    part = cache.get(s)
                    if part is None:
                        part = cache[s] = merge(s.encode("utf-8", "replace"))
                    parts[k] = part
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ids = np.fromiter(chain.from_iterable(parts), dtype=np.int32, count=int(sizes.sum()))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        offsets = np.concatenate([[0], upto[np.searchsorted(a, ends)]]).astype(np.int32)
        text_start = np.concatenate([[0], ends[:-1] + 1])
        slice_start = (a - text_start[np.searchsorted(ends, a)]).astype(np.int32)
        return ids, offsets, np.repeat(slice_start, sizes)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary, with what it has cached so far."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _groups(texts: list[str | None], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    low, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield low, k + 1
            low, size = k + 1, 0
    if low < len(texts):
        yield low, len(texts)


def encode_texts(documents: DataFrame, path: str | None = None, with_starts: bool = False) -> DataFrame:
    """(doc_id, ids) of each row of ``documents`` (doc_id, text), optionally with ``starts``.

    Empty and null texts have an empty list. Repeated rows are encoded as often as they come, whatever their
    doc_id; no row is dropped. ``starts`` has, for each id, where the slice it belongs to begins in the text.
    ``path`` is the vocabulary's file on every executor; without it that of the installed package is used.
    """
    where = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(where or vocabulary_path()).encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for low, high in _groups(texts):
                ids, offsets, starts = encode(texts[low:high])
                columns = [keys.slice(low, high - low), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
                if with_starts:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(starts)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if with_starts:
        fields.append(T.StructField("starts", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]
    return documents.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); an empty list is an empty text, null ids a null one."""
    where = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {v: k for k, v in encoder(where or vocabulary_path()).ranks.items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    fields = [T.StructField("doc_id", encoded.schema["doc_id"].dataType), T.StructField("text", T.StringType())]
    return encoded.select("doc_id", "ids").mapInArrow(run, T.StructType(fields))


def token_statistics(encoded: DataFrame) -> DataFrame:
    """(id, tokens, documents) over all documents."""
    return (
        encoded.select("doc_id", F.explode("ids").alias("id"))
        .groupBy("id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("id").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    )
