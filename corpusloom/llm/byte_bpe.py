"""Byte-level BPE. Boundaries come from a scan over transition functions, not from a regular expression.

Every code point has a class; a class is a function from state to state of a small automaton. All compositions
of these functions are few, so each is a small number and composing two is one look-up. Composition is
associative, which lets numpy scan all texts of a slice at once: within columns of a matrix, then over the
rows' totals. The states and their neighbours say where pieces start. Pieces are slices of the UTF-8 bytes;
each distinct one is merged once and kept in a bounded cache.

Edge cases: a null text is an empty one, with no ids. Rows are encoded one by one, so repeated rows, null ids
and extra columns pass through; a new column whose name is taken gets a leading underscore.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import fresh, map_batches, slices, texts

# White space as the pattern means it.
WHITE_SPACE = (
    [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

# States: what the last code point was.
START, SPACE, BLANK, LETTER, DIGIT, OTHER, APOSTROPHE, AFTER_R, AFTER_V, AFTER_L, CONTRACTED = range(11)
STATES = 11
# Classes of code points.
C_SPACE, C_BLANK, C_LETTER, C_DIGIT, C_OTHER, C_APOSTROPHE, C_SHORT, C_R, C_V, C_L, C_E = range(11)
CLASSES = 11
CACHED_PIECES = 1 << 16
SHORT_PIECE = 32
MERGED_AT_ONCE = 1 << 12
UNKNOWN = np.int32(2**31 - 1)
ROW = 256


#: Letters and digits of Unicode 16.0, which the library's tables have and older Pythons' do not (first, last).
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATER_DIGITS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)


def _step(state: int, kind: int) -> int:
    if kind == C_APOSTROPHE:  # begins a piece unless a space or a run of others goes on
        return OTHER if state in (SPACE, OTHER, APOSTROPHE) else APOSTROPHE
    if state == APOSTROPHE:
        after = {C_SHORT: CONTRACTED, C_R: AFTER_R, C_V: AFTER_V, C_L: AFTER_L}
        if kind in after:
            return after[kind]
    if (state in (AFTER_R, AFTER_V) and kind == C_E) or (state == AFTER_L and kind == C_L):
        return CONTRACTED
    return {C_SPACE: SPACE, C_BLANK: BLANK, C_DIGIT: DIGIT, C_OTHER: OTHER}.get(kind, LETTER)


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(sys.maxunicode + 1, C_OTHER, np.uint8)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            out[point] = C_LETTER
        elif kind == "N":
            out[point] = C_DIGIT
    for ranges, kind in ((LATER_LETTERS, C_LETTER), (LATER_DIGITS, C_DIGIT)):
        for first, last in ranges:
            out[first:last + 1] = kind
    out[WHITE_SPACE] = C_BLANK
    out[ord(" ")] = C_SPACE
    out[ord("'")] = C_APOSTROPHE
    for letters, kind in (("stmd", C_SHORT), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E)):
        out[[ord(letter) for letter in letters]] = kind
    return out


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray]:
    """(compose, apply): compose[f << 8 | g] is "f, then g"; apply[f, state].

    The first CLASSES functions are the classes; the next CLASSES are the same after the start of a text."""
    functions = [tuple(_step(s, c) for s in range(STATES)) for c in range(CLASSES)]
    functions += [(_step(START, c),) * STATES for c in range(CLASSES)]
    number: dict[tuple[int, ...], int] = {}
    for f in functions:
        number.setdefault(f, len(number) if f not in number else 0)
    known = list(functions)
    index = {f: i for i, f in reversed(list(enumerate(known)))}
    grown = True
    while grown:
        grown = False
        for f in list(known):
            for g in functions:
                h = tuple(g[s] for s in f)
                if h not in index:
                    index[h] = len(known)
                    known.append(h)
                    grown = True
    assert len(known) <= 256
    compose = np.zeros(1 << 16, np.uint8)
    for i, f in enumerate(known):
        for j, g in enumerate(known):
            compose[i << 8 | j] = index[tuple(g[s] for s in f)]
    return compose, np.array(known, np.uint8)


def _prefixes(functions: np.ndarray) -> np.ndarray:
    """Composition of all functions up to each place."""
    compose, _ = _monoid()
    n = len(functions)
    if n <= ROW:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[int(out[i - 1]) << 8 | int(out[i])]
        return out
    columns, totals = _columns(functions)
    before = _prefixes(totals)
    columns[:, 1:] = compose[before[:-1].astype(np.uint16) << 8 | columns[:, 1:]]
    return columns.T.reshape(-1)[:n]


def _columns(functions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The functions as ROW rows, composed down each column, and the columns' totals."""
    compose, _ = _monoid()
    n = len(functions)
    padded = np.zeros(-(-n // ROW) * ROW, np.uint8)
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(-1, ROW).T)
    for row in range(1, ROW):
        grid[row] = compose[grid[row - 1].astype(np.uint16) << 8 | grid[row]]
    return grid, grid[-1].copy()


def states(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """State after each code point. `first` marks the first code point of each text."""
    _, apply = _monoid()
    functions = kinds + CLASSES * first.astype(np.uint8)
    n = len(functions)
    grid, totals = _columns(functions)
    entering = np.zeros(grid.shape[1], np.uint8)
    entering[1:] = apply[_prefixes(totals)[:-1], START]
    flat = apply.reshape(-1)
    return flat[grid.astype(np.uint16) * STATES + entering].T.reshape(-1)[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks the code points that start a piece."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    state = states(_classes()[points], first)
    before = np.empty_like(state)
    before[0], before[1:] = START, state[:-1]
    before[first] = START
    after = np.full(n, START, np.uint8)
    after[:-1] = np.where(first[1:], START, state[1:])
    white, was_white = state <= BLANK, (before == SPACE) | (before == BLANK)
    starts = np.where(white, ~was_white | (after > BLANK), True)
    starts &= ~((state == LETTER) & np.isin(before, (LETTER, SPACE, AFTER_R, AFTER_V, AFTER_L)))
    starts &= ~((state == DIGIT) & ((before == DIGIT) | (before == SPACE)))
    starts &= ~((state == OTHER) & np.isin(before, (OTHER, SPACE, APOSTROPHE)))
    starts &= state != CONTRACTED
    half = (state >= AFTER_R) & (state <= AFTER_L)
    starts &= ~half | (after != CONTRACTED)
    return starts | first


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


class Merger(dict):
    """Ids of pieces, packed as 32-bit integers; the least used half goes when it is full.

    `learn` merges many new pieces at once; a look-up of any other piece merges that one."""

    def __init__(self, path: str, size: int = CACHED_PIECES):
        super().__init__()
        self.ranks, self.pairs = _vocabulary(path)
        self.size, self.old = size, {}

    def __missing__(self, piece: bytes) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = np.array(merge(piece, self.ranks), np.int32).tobytes()
        self[piece] = packed
        return packed

    def learn(self, pieces: list[bytes]) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        new = [p for p in set(pieces).difference(self) if len(p) <= SHORT_PIECE and p not in self.old]
        new.sort(key=len)
        for at in range(0, len(new), MERGED_AT_ONCE):
            some = new[at:at + MERGED_AT_ONCE]
            self.update(zip(some, merge_many(some, self.ranks, self.pairs)))


@functools.lru_cache(2)
def _vocabulary(path: str) -> tuple[dict[bytes, int], tuple[np.ndarray, np.ndarray]]:
    """Ranks, and all pairs of ids that make up a piece: sorted keys and ids."""
    ranks = load_ranks(path)
    pairs = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    keys = np.fromiter(pairs, np.int64, len(pairs))
    order = np.argsort(keys)
    return ranks, (np.append(keys[order], np.int64(2**62)), np.fromiter(pairs.values(), np.int32, len(pairs))[order])


def merge_many(pieces: list[bytes], ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """Packed ids of short pieces: in each round every piece joins its first pair of lowest rank."""
    keys, joined = pairs
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = int(lengths.max())
    column = np.arange(width)
    grid = np.zeros((len(pieces), width), np.int64)
    grid[column < lengths[:, None]] = single[np.frombuffer(b"".join(pieces), np.uint8)]

    def rank_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.searchsorted(keys, wanted)
        return np.where(keys[at] == wanted, joined[np.minimum(at, len(joined) - 1)], UNKNOWN)

    out = np.zeros((len(pieces), width), np.int32)
    size = lengths.copy()
    rank = np.full((len(pieces), width), UNKNOWN, np.int32)
    known = column[:-1] < lengths[:, None] - 1
    rank[:, :-1][known] = rank_of(grid[:, :-1][known], grid[:, 1:][known])
    rows = np.arange(len(pieces))
    while len(rows):
        at = rank.argmin(1)
        low = rank[np.arange(len(rows)), at].astype(np.int64)
        done = low == UNKNOWN
        if done.any():
            out[rows[done]] = grid[done]
            going = ~done
            rows, grid, rank, at, low = rows[going], grid[going], rank[going], at[going], low[going]
            if not len(rows):
                break
        size[rows] -= 1
        moved = column[None, :-1] > at[:, None]
        grid[:, :-1] = np.where(moved, grid[:, 1:], grid[:, :-1])
        rank[:, :-1] = np.where(moved, rank[:, 1:], rank[:, :-1])
        rank[:, -1] = UNKNOWN
        here = np.arange(len(rows))
        grid[here, at] = low
        last = size[rows] - 1
        right = np.minimum(at + 1, width - 1)
        rank[here, at] = np.where(at < last, rank_of(low, grid[here, right]), UNKNOWN)
        inner = at > 0
        rank[here[inner], at[inner] - 1] = rank_of(grid[here[inner], at[inner] - 1], low[inner])
    data = out.tobytes()
    step = 4 * width
    return [data[i * step:i * step + 4 * n] for i, n in enumerate(size.tolist())]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Joins the pair of lowest rank, leftmost first, until none is known. n log n in the piece's length."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))
    if n <= SHORT_PIECE:
        rank = [ranks.get(piece[i:i + 2], 1 << 30) for i in range(n - 1)]
        at = list(range(n))
        while rank:
            low = min(rank)
            if low == 1 << 30:
                break
            i = rank.index(low)
            del at[i + 1], rank[i]
            stop = at[i + 2] if i + 2 < len(at) else n
            if i < len(rank):
                rank[i] = ranks.get(piece[at[i]:stop], 1 << 30)
            if i:
                stop = at[i + 1] if i + 1 < len(at) else n
                rank[i - 1] = ranks.get(piece[at[i - 1]:stop], 1 << 30)
        at.append(n)
        return [ranks[piece[a:b]] for a, b in zip(at, at[1:])]
    previous = list(range(-1, n - 1))
    heap = [(ranks[piece[i:i + 2]], i, i + 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            previous[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := previous[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


def encode_texts(values: list[str], merger: Merger) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, ids in each text, starts of pieces in bytes of their text, pieces in each text)."""
    joined = "".join(values)
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    text_at = np.concatenate(([0], np.cumsum(lengths)))
    first = np.zeros(len(points), bool)
    first[text_at[:-1][lengths > 0]] = True
    starts = np.flatnonzero(boundaries(points, first))
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    byte_at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=byte_at[1:])
    data = joined.encode()
    begin = byte_at[starts]
    marks = begin.tolist()
    pieces = [data[a:b] for a, b in zip(marks, chain(marks[1:], (len(data),)))]
    merger.learn(pieces)
    packed = [merger[piece] for piece in pieces]
    counts = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
    piece_at = np.searchsorted(starts, text_at)
    id_at = np.concatenate(([0], np.cumsum(counts)))
    ids = np.frombuffer(b"".join(packed), np.int32)
    own = np.repeat(byte_at[text_at[:-1]], np.diff(piece_at))
    return ids, np.diff(id_at[piece_at]), (begin - own).astype(np.int32), np.diff(piece_at)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """All columns of `docs`, `token_ids`, and `piece_starts`: where each piece starts in the text's UTF-8 bytes.

    `ranks_path` is a file of ranks that every executor can open."""
    ids_name, starts_name = fresh(docs, "token_ids"), fresh(docs, "piece_starts")
    kind = T.ArrayType(T.IntegerType())
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_name, kind), T.StructField(starts_name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(ranks_path)
        for batch in slices(batches, text):
            ids, counts, starts, pieces = encode_texts(texts(batch, text), merger)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _lists(ids, counts), _lists(starts, pieces)],
                [*batch.schema.names, ids_name, starts_name],
            )

    return map_batches(docs, run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """All columns of `encoded` and the bytes of its ids; null ids give no bytes."""
    name = fresh(encoded, to)
    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {rank: piece for piece, rank in _vocabulary(ranks_path)[0].items()}
        for batch in batches:
            for small in _cut(batch, ids):
                column = small.column(ids)
                flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
                data = [pieces[i] for i in flat]
                counts = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_pylist()
                out, at = [], 0
                for count in counts:
                    out.append(b"".join(data[at:at + count]))
                    at += count
                yield pa.RecordBatch.from_arrays(
                    [*small.columns, pa.array(out, pa.binary())], [*small.schema.names, name]
                )

    return map_batches(encoded, run, schema)


def _cut(batch: pa.RecordBatch, ids: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    counts = pa.compute.fill_null(pa.compute.list_value_length(batch.column(ids)), 0).to_pylist()
    start = held = 0
    for row, count in enumerate(counts):
        if held and held + count > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += count
    if start < len(counts):
        yield batch.slice(start)


def decode_pieces(ids: list[int], starts: list[int], low: int, high: int, pieces: dict[int, bytes]) -> bytes:
    """Bytes of the pieces low..high-1 of one text, decoded without what stands before them in the output."""
    data = b"".join(pieces[i] for i in ids)
    stop = starts[high] if high < len(starts) else len(data)
    return data[starts[low]:stop] if low < high else b""


def digests(decoded: DataFrame, ids: str = "token_ids", data: str = "decoded") -> list:
    """Columns n_tokens, ids_sha256 and decoded_sha256."""
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(data), 256).alias("decoded_sha256"),
    ]
