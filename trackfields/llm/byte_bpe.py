"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Every code point gets a class from a table; run boundaries come from
comparing neighbours and from a running maximum, and the few places where the outcome depends on what was matched
before (contractions after an apostrophe) are resolved by an associative scan of transition functions over short
windows. The slices found go to pair merging with a per-worker cache. Token offsets (in bytes of the UTF-8 text) are kept
beside the ids, so any token's bytes can be located in the text and ids can be decoded alone.

Edge cases: a null text counts as empty; an empty text has no tokens and decodes to no bytes; repeated rows give repeated
results; other columns pass through unless they are called ``ids``, ``offsets`` (encode) or ``decoded`` (decode), which
are replaced. Very long runs without a boundary are merged with a heap, so time stays n log n.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, small_batches

# Classes of code points.
LETTER, NUMBER, WHITE, OTHER = 0, 1, 2, 3
# Code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces kept in a worker's cache; beyond that it starts anew, so memory stays bounded.
CACHE_PIECES = 500_000
#: Code points of texts that a worker cuts at once (a longer text is cut alone).
CHUNK = 250_000

# States of the automaton that reads an apostrophe and what follows it.
START, APOS, PAIR_R, PAIR_V, PAIR_L, DONE2, DONE3, FAIL = range(8)


@lru_cache(1)
def class_table() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = WHITE
    return out


@lru_cache(1)
def transitions() -> np.ndarray:
    """For each of the symbols ' s t r e v m l d and any other: the function from state to state."""
    f = np.full((10, 8), FAIL, np.uint8)
    for symbol in range(10):
        f[symbol, DONE2], f[symbol, DONE3] = DONE2, DONE3
    f[0, START] = APOS
    for symbol in (1, 2, 6, 8):  # 's 't 'm 'd
        f[symbol, APOS] = DONE2
    f[3, APOS], f[5, APOS], f[7, APOS] = PAIR_R, PAIR_V, PAIR_L
    f[4, PAIR_R] = f[4, PAIR_V] = f[7, PAIR_L] = DONE3  # 're 've 'll
    return f


def scan(functions: np.ndarray) -> np.ndarray:
    """Compositions of the functions along axis 1 from the first on, by doubling (composition is associative)."""
    out, step = functions, 1
    while step < out.shape[1]:
        later = np.take_along_axis(out[:, step:], out[:, :-step].astype(np.intp), axis=2)
        out = np.concatenate([out[:, :step], later], axis=1)
        step *= 2
    return out


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of the code points at which a piece begins. ``first``: flags of the code points at which a text begins."""
    n = len(points)
    cls = class_table()[points]
    change = np.ones(n, bool)
    change[1:] = (cls[1:] != cls[:-1]) | first[1:]
    last = np.ones(n, bool)  # the last code point of its text
    last[:-1] = first[1:]
    white = cls == WHITE
    # A run's first code point: running maximum of the positions of changes.
    at = np.arange(n)
    begin = np.maximum.accumulate(np.where(change, at, 0))
    run_ends = np.ones(n, bool)
    run_ends[:-1] = change[1:]
    starts = change.copy()
    # The last white space of a run before other text stands apart or, if it is a blank, joins what follows.
    tail = white & run_ends & ~last
    starts[tail] = True
    joined = np.flatnonzero(tail & (points == 32)) + 1
    starts[joined] = False
    # An apostrophe that begins a piece, alone in its run: contractions.
    apos = np.flatnonzero((points == 39) & change & run_ends & ~last)
    if len(apos):
        before = np.where(first[apos], 0, points[np.maximum(apos - 1, 0)])
        apos = apos[before != 32]
    if len(apos):
        symbols = np.full(128, 9, np.intp)
        symbols[[ord(c) for c in "'strevmld"]] = range(9)
        window = np.minimum(apos[:, None] + np.arange(3), n - 1)
        inside = (apos[:, None] + np.arange(3) < n) & (np.cumsum(first[window] & (np.arange(3) > 0), axis=1) == 0)
        symbol = np.where(inside & (points[window] < 128), symbols[np.minimum(points[window], 127)], 9)
        state = scan(transitions()[symbol])[:, -1, START]
        for size, name in ((2, DONE2), (3, DONE3)):
            hit = apos[state == name]
            starts[hit + 1] = False
            after = hit + size
            after = after[after < n]
            starts[after[(cls[after] == LETTER) & ~first[after]]] = True
    assert begin[0] == 0
    return starts


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@lru_cache(4)
def token_bytes(path: str) -> dict[int, bytes]:
    return {b: a for a, b in load_ranks(path).items()}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until none has a rank."""
    n = len(piece)
    if n < 60:
        none, get = 1 << 40, ranks.get
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [get(piece[i : i + 2], none) for i in range(n - 1)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]
    end, prev, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    alive = bytearray(b"\x01") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
            continue
        j = end[i]
        alive[j], end[i] = 0, stop
        if stop < n:
            prev[stop] = i
            r = ranks.get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if prev[i] >= 0:
            r = ranks.get(piece[prev[i] : stop])
            if r is not None:
                heapq.heappush(heap, (r, prev[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The pieces of all texts and, for each text, the number of pieces before it."""
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if not len(points):
        return [], np.zeros(len(texts) + 1, np.int64)
    first = np.zeros(len(points), bool)
    first[offsets[:-1][sizes > 0]] = True
    starts = boundaries(points, first)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    in_bytes = np.concatenate([[0], np.cumsum(width)])
    cut = [*in_bytes[:-1][starts].tolist(), int(in_bytes[-1])]
    raw = whole.encode()
    before = np.concatenate([[0], np.cumsum(starts)])[offsets]
    return [raw[a:b] for a, b in zip(cut, cut[1:])], before


_cache: dict[str, dict[bytes, list[int]]] = {}


def encode_texts(texts: list[str], path: str) -> list[list[int]]:
    ranks, cache = load_ranks(path), _cache.setdefault(path, {})
    found, before = pieces(texts)
    out = []
    for a, b in zip(before, before[1:]):
        ids: list[int] = []
        for p in found[a:b]:
            got = cache.get(p)
            if got is None:
                r = ranks.get(p)
                got = [r] if r is not None else merge(p, ranks)
                if len(p) <= 64:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[p] = got
            ids += got
        out.append(ids)
    return out


def _chunks(texts: list[str], most: int = CHUNK):
    """Runs of texts of about ``most`` code points together."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield texts[begin:i]
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield texts[begin:]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and, for each id, the byte at which its token begins in the text (``offsets``)."""

    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranks_len = {i: len(b) for i, b in token_bytes(path).items()}
        sizes = np.zeros(max(ranks_len) + 1, np.int64)
        sizes[list(ranks_len)] = list(ranks_len.values())
        for s in batches:
            texts = ["" if t is None else t for t in s.where(s.notna(), None)]
            ids, offsets = [], []
            for part in _chunks(texts):
                for x in encode_texts(part, path):
                    a = np.array(x, np.int32)
                    ids.append(a)
                    offsets.append((np.cumsum(sizes[a]) - sizes[a]) if len(a) else np.zeros(0, np.int64))
            yield pd.DataFrame({"ids": ids, "offsets": offsets})

    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.LongType()))])
    run = F.pandas_udf(ids_of, kind)
    docs = small_batches(docs)
    rest = [c for c in docs.columns if c not in ("ids", "offsets")]
    (both,) = free(docs, "bpe")
    return docs.withColumn(both, run(F.col(text))).select(*rest, F.col(both)["ids"].alias("ids"), F.col(both)["offsets"].alias("offsets"))


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the bytes of the ids; no bytes for null or no ids."""

    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = token_bytes(path)
        for s in batches:
            yield pd.Series([b"" if x is None else b"".join(map(table.__getitem__, x.tolist())) for x in s], dtype=object)

    run = F.pandas_udf(bytes_of, T.BinaryType())
    return small_batches(rows).withColumn("decoded", run(F.col(ids)))


def digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
