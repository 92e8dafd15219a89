"""Repeated passages found by fixed blocks: every window of words that stands elsewhere too is removed.

Reference blocks are the words [0, b), [b, 2b), ... of each document with b = (window + 1) // 2, so that every window holds a whole
block. The blocks are the index; the b words that start at any word probe it. A block that some other place repeats is a hit, and
a hit is extended: each window around it that another place shares too belongs to a maximal exact repeat, and the windows' union is
the repeats. Two equal windows hold equal words at the same offset as the block of either, so both blocks are hits: none is lost.

Places never meet in pairs. Documents are packed into rows of a few megabytes; a pack sends each different key once to the key's
bucket, in byte planes, and the bucket answers with one bit a key. So a passage in a third of all documents arrives once a pack,
and the work grows with the words, whatever repeats. Blocks are looked up by 40 bits and the bucket (a false hit only costs work),
windows by 80 bits and the bucket."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, ship, slices, staged

WINDOW = 35
#: Bytes of text in a pack; a longer text is a pack of its own.
PACK_BYTES = 4 << 20
#: Keys that a bucket gets, about, if no pack repeats any.
BUCKET_KEYS = 1 << 21
BLOCK_BYTES, WINDOW_BYTES = 5, 10

_PACK = "pack long, n_words long, sizes array<int>, data binary"
_KEYS = "bucket int, pack long, n int, planes binary, own binary, twice binary"
_ANSWER = "pack long, kind int, bucket int, live binary"

_rng = np.random.default_rng(35)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_ODD = _rng.integers(0, 2**63, 3, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def _sums(values: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each slice [start, end): a polynomial of its values, wherever it stands."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=total[1:])
    return _mixed((total[ends] - total[starts]) * _powers(_inverse(base), len(values) + 1)[starts])


class Words:
    """The words of a pack's texts: a hash of each, and the first word of each text."""

    def __init__(self, sizes: np.ndarray, data: bytes):
        octets = np.frombuffer(data, np.uint8)
        space = _SPACE[octets]
        # texts are joined by a space, so an edge is where white space ends or begins
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        lengths = (ends - starts).astype(np.uint64)
        self.hash = _mixed(_sums(_BYTE[octets], _ODD[0], starts, ends) + lengths)
        begins = np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64) + 1)))
        self.first = np.searchsorted(starts, begins)

    def starts(self, length: int, window: int) -> np.ndarray:
        """Words at which `length` words of one text start, in texts of a window or more."""
        first, end = self.first[:-1], self.first[1:]
        ok = end - first >= window
        counts = np.where(ok, end - first - length + 1, 0)
        skipped = np.repeat(first - (np.cumsum(counts) - counts), counts)
        return np.arange(counts.sum()) + skipped

    def text_start(self, places: np.ndarray) -> np.ndarray:
        return self.first[np.searchsorted(self.first, places, "right") - 1]

    def keys(self, places: np.ndarray, length: int) -> np.ndarray:
        return _sums(self.hash, _ODD[1], places, places + length)

    def wide(self, places: np.ndarray, length: int) -> np.ndarray:
        """16 more bits, from other hashes of the words."""
        return _sums(_mixed(self.hash + np.uint64(1)), _ODD[2], places, places + length) >> np.uint64(48)


class Sent:
    """The different keys that a pack sends, by bucket and key: computed alike whenever the pack is read."""

    def __init__(self, keys: np.ndarray, wide: np.ndarray | None, buckets: int):
        bucket = keys % np.uint64(buckets)
        rest = keys // np.uint64(buckets)
        if wide is None:
            rest = rest & np.uint64((1 << 40) - 1)
            self.order = np.lexsort((rest, bucket))
        else:
            self.order = np.lexsort((wide, rest, bucket))
        bucket, rest = bucket[self.order], rest[self.order]
        new = np.ones(len(rest), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (rest[1:] != rest[:-1])
        if wide is not None:
            wide = wide[self.order]
            new[1:] |= wide[1:] != wide[:-1]
        self.number = np.cumsum(new) - 1  # of the key, by sorted place
        lead = np.flatnonzero(new)
        self.bucket, self.rest = bucket[lead].astype(np.int64), rest[lead]
        self.wide = None if wide is None else wide[lead]
        self.twice = np.diff(np.append(lead, len(rest))) > 1

    def of_places(self, bits: np.ndarray) -> np.ndarray:
        """A bit of each key as a bit of each place."""
        out = np.empty(len(self.order), bool)
        out[self.order] = bits[self.number]
        return out

    def of_keys(self, bits: np.ndarray) -> np.ndarray:
        """Whether any place of a key has its bit set."""
        out = np.zeros(len(self.rest), bool)
        out[self.number[bits[self.order]]] = True
        return out

    def rows(self, pack: int, own: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        ends = np.append(cuts[1:], len(self.bucket))
        planes = [
            _planes(self.rest[a:b], 5 if self.wide is None else 8) + (b"" if self.wide is None else _planes(self.wide[a:b], 2))
            for a, b in zip(cuts, ends)
        ]
        return pa.RecordBatch.from_arrays([
            pa.array(self.bucket[cuts], pa.int32()), pa.array(np.full(len(cuts), pack), pa.int64()),
            pa.array(ends - cuts, pa.int32()), pa.array(planes, pa.binary()),
            pa.array([np.packbits(own[a:b]).tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            pa.array([np.packbits(self.twice[a:b]).tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        ], ["bucket", "pack", "n", "planes", "own", "twice"])


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes, first all highest ones: sorted values have runs there."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width:].T.tobytes()


def _unplaned(data: bytes, n: int, first: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - width:] = np.frombuffer(data, np.uint8, n * width, first * n).reshape(width, n).T
    return out.view(">u8").ravel().astype(np.uint64)


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _answers(kind: int):
    """What a bucket tells its packs: which of their own keys stand at two places or more, one bit for each key."""
    def run(rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_numpy()
        planes, own, twice = (rows.column(c).to_pylist() for c in ("planes", "own", "twice"))
        rest = np.concatenate([_unplaned(p, k, 0, 5 if kind == 0 else 8) for p, k in zip(planes, n)])
        mine = np.concatenate([_bits(b, k) for b, k in zip(own, n)])
        several = np.concatenate([_bits(b, k) for b, k in zip(twice, n)])
        if kind == 0:
            order = np.argsort(rest, kind="stable")
            new = np.diff(rest[order], prepend=rest[order[:1]] + np.uint64(1)) != 0
        else:
            wide = np.concatenate([_unplaned(p, k, 8, 2) for p, k in zip(planes, n)])
            order = np.lexsort((wide, rest))
            new = np.ones(len(order), bool)
            a, b = rest[order], wide[order]
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        lead = np.flatnonzero(new)
        places = np.diff(np.append(lead, len(order)))
        live = (places > 1) | np.logical_or.reduceat(several[order], lead)
        out = np.empty(len(order), bool)
        out[order] = np.repeat(live, places)
        told = [out[e - k:e][mine[e - k:e]] for e, k in zip(np.cumsum(n), n)]
        return pa.table({
            "pack": rows.column("pack"), "kind": pa.array(np.full(len(n), kind), pa.int32()), "bucket": rows.column("bucket"),
            "live": pa.array([np.packbits(t).tobytes() for t in told], pa.binary()),
        }).filter(pa.array([bool(t.any()) for t in told]))
    return run


def _pack(docs: DataFrame, pack_bytes: int) -> DataFrame:
    """Documents as packs: their ids, their texts' sizes and the texts joined by a space, compressed."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"ids array<{kind}>, {_PACK}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            nonlocal number
            ids = pa.concat_arrays([b.column("id") for b in held])
            values = [v for b in held for v in b.column("text").to_pylist()]
            data = b" ".join(values)
            blob = len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)
            number += 1
            return pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([(task << 32) + number], pa.int64()),
                pa.array([sum(len(v.split()) for v in values)], pa.int64()),
                pa.array([[len(v) for v in values]], pa.list_(pa.int32())), pa.array([blob], pa.binary()),
            ], ["ids", "pack", "n_words", "sizes", "data"])

        for batch in slices(batches, "text", pack_bytes // 4):
            more = batch.column("text").nbytes
            if held and size + more > pack_bytes:
                yield row()
                held, size = [], 0
            held.append(batch)
            size += more
        if held:
            yield row()

    return map_batches(docs, run, schema)


def _data(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _block_keys(words: Words, window: int, buckets: int) -> tuple[Sent, np.ndarray, np.ndarray]:
    """What the pack sends to find hits, the places it probes with, and which of them are blocks."""
    block = (window + 1) // 2
    places = words.starts(block, window)
    blocks = (places - words.text_start(places)) % block == 0
    return Sent(words.keys(places, block), None, buckets), places, blocks


def _window_keys(words: Words, window: int, buckets: int, answers: dict[int, bytes]) -> tuple[Sent | None, np.ndarray]:
    """The windows around the pack's hits, and what the pack sends to extend them."""
    sent, places, blocks = _block_keys(words, window, buckets)
    live = sent.of_places(_live(sent, sent.of_keys(blocks), answers)) & blocks
    hit = np.zeros(len(words.hash) + 1, np.int64)
    hit[places[live]] = 1
    before = np.concatenate(([0], np.cumsum(hit)))
    starts = words.starts(window, window)
    block = (window + 1) // 2
    # the one block that starts among the window's first words
    starts = starts[before[starts + window - block + 1] > before[starts]]
    if not len(starts):
        return None, starts
    return Sent(words.keys(starts, window), words.wide(starts, window), buckets), starts


def _live(sent: Sent, own: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """The buckets' answers as one bit for each key that the pack sent; a bucket without an answer has none set."""
    out = np.zeros(len(own), bool)
    cuts = np.flatnonzero(np.diff(sent.bucket, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(own))):
        mine = np.flatnonzero(own[a:b]) + a
        answer = answers.get(int(sent.bucket[a]))
        if answer is not None:
            out[mine] = _bits(answer, len(mine))
    return out


def _answered(rows: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: live for k, b, live in zip(*(rows.column(c).to_pylist() for c in ("kind", "bucket", "live"))) if k == kind}


def _cut(words: Words, starts: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Spans (first word, words) that the windows cover, by text."""
    edges = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    covered = np.cumsum(edges)[:-1] > 0
    # a span ends with its text
    firsts = np.unique(words.first[words.first < len(covered)])
    begin = covered & ~np.concatenate(([False], covered[:-1]))
    begin[firsts] = covered[firsts]
    last = covered & ~np.append(covered[1:], False)
    ends = firsts[firsts > 0] - 1
    last[ends] = covered[ends]
    begin, last = np.flatnonzero(begin), np.flatnonzero(last)
    text = np.searchsorted(words.first, begin, "right") - 1
    out = [[] for _ in range(len(words.first) - 1)]
    for t, a, b in zip(text.tolist(), begin.tolist(), last.tolist()):
        out[t].append((a - int(words.first[t]), b - a + 1))
    return out


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
           pack_bytes: int = PACK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(id, text, n_words, n_removed, spans) of every row: `text` holds the kept words joined by a space, `spans` the removed
    (start, length) in words.

    Words are runs of anything but ASCII white space, whole texts, unchanged; a null text has none. A row that stands twice is two
    places, whatever its id, so its windows go from both; ids may be null. Texts of fewer words than a window stay whole.
    Only the two named columns are read. Memory: a pack (or the longest text) and a bucket's keys at a time."""
    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema[doc_id].dataType.simpleString()
    narrow = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    packs = staged(_pack(narrow, pack_bytes), "repeat-packs")
    total = packs.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_keys))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, sizes, data in zip(*(batch.column(c) for c in ("pack", "sizes", "data"))):
                words = Words(np.array(sizes.as_py()), _data(data.as_py()))
                sent, _, blocks = _block_keys(words, window, buckets)
                if len(sent.rest):
                    yield sent.rows(pack.as_py(), sent.of_keys(blocks))

    probes = map_batches(packs.select("pack", "sizes", "data"), probe, _KEYS)
    hits = staged(probes.groupBy("bucket").applyInArrow(_answers(0), _ANSWER), "repeat-hits")

    def extend(pack: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(np.array(pack.column("sizes")[0].as_py()), _data(pack.column("data")[0].as_py()))
        sent, _ = _window_keys(words, window, buckets, _answered(answers, 0))
        number = pack.column("pack")[0].as_py()
        if sent is None:
            return pa.table({n: pa.array([], t) for n, t in (
                ("bucket", pa.int32()), ("pack", pa.int64()), ("n", pa.int32()), ("planes", pa.binary()),
                ("own", pa.binary()), ("twice", pa.binary()))})
        return pa.Table.from_batches([sent.rows(number, np.ones(len(sent.rest), bool))])

    by_pack = packs.select("pack", "sizes", "data").join(hits.select("pack").distinct(), "pack", "left_semi")
    windows = by_pack.groupBy("pack").cogroup(hits.groupBy("pack")).applyInArrow(extend, _KEYS)
    repeats = staged(windows.groupBy("bucket").applyInArrow(_answers(1), _ANSWER), "repeat-windows")

    def cut(pack: pa.Table, answers: pa.Table) -> pa.Table:
        data = _data(pack.column("data")[0].as_py())
        sizes = np.array(pack.column("sizes")[0].as_py(), np.int64)
        words = Words(sizes, data)
        found = [[] for _ in sizes]
        if answers.num_rows:
            sent, starts = _window_keys(words, window, buckets, _answered(answers, 0))
            if sent is not None:
                live = _live(sent, np.ones(len(sent.rest), bool), _answered(answers, 1))
                found = _cut(words, starts[sent.of_places(live)], window)
        kept, begin = [], 0
        for size, spans in zip(sizes.tolist(), found):
            parts = data[begin:begin + size].split()
            begin += size + 1
            for a, n in reversed(spans):
                del parts[a:a + n]
            kept.append(b" ".join(parts))
        n_words = np.diff(words.first)
        return pa.table({
            "id": pack.column("ids").combine_chunks().flatten(), "kept": pa.array(kept, pa.binary()), "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array([sum(n for _, n in s) for s in found], pa.int64()),
            "spans": pa.array([[{"start": a, "length": n} for a, n in s] for s in found],
                              pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        })

    answers = hits.unionByName(repeats)
    out = packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(
        cut, f"id {id_type}, kept binary, n_words long, n_removed long, spans array<struct<start:long,length:long>>")
    return out.select(F.col("id").alias(doc_id), F.col("kept").cast("string").alias("text"), "n_words", "n_removed", "spans")
