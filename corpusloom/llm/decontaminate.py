"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words: A-Z lowered, everything outside `0-9`, `a-z` and code points from U+0080 on separates.
Every window of `width` consecutive words of a benchmark item (an item of fewer words is one window) becomes a
string of one symbol per word. One automaton holds all of them; a document's words, as symbols, pass through it
once. Word numbers are mapped to character offsets of the original text for documents with hits.

The benchmark is collected, as its size is checked first: above `PART_BYTES` it is cut into parts by item, each
with an automaton of its own, and their hits are united per document.

Edge cases: null texts have no words and no windows. A row of the benchmark whose item_id is null still hits words,
but is no item to count or list. Rows of one item_id are one item. Documents are judged one by one, so repeated rows and null ids
pass through. Columns of `docs` are kept; a new column whose name is taken gets a leading underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import fresh, map_batches, slices

WIDTH = 10
#: Bytes of benchmark texts in one automaton.
PART_BYTES = 4 << 20
_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Byte to byte: lower case, and a space for what separates words.
NORMAL = bytes(
    b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
UNKNOWN = "\x00"

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.LongType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("first_word", T.IntegerType()), T.StructField("words", T.IntegerType()),
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    ]))),
])


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def _symbol(number: int) -> str:
    """A character for each word; surrogates are left out."""
    number += 1
    return chr(number if number < 0xD800 else number + 0x800)


class Matcher:
    """The automaton and the words' symbols."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        self.symbols: dict[bytes, str] = {}
        self.items: list[set[int]] = []
        numbers: dict[str, int] = {}
        for item, text in items:
            found = words((text or "").encode())
            line = "".join(self.symbols.setdefault(w, _symbol(len(self.symbols))) for w in found)
            for at in range(max(1, len(line) - width + 1) if line else 0):
                number = numbers.setdefault(line[at:at + width], len(numbers))
                if number == len(self.items):
                    self.items.append(set())
                if item is not None:
                    self.items[number].add(item)
        self.automaton = ahocorasick.Automaton()
        for window, number in numbers.items():
            self.automaton.add_word(window, (len(window), number))
        if numbers:
            self.automaton.make_automaton()
        self.empty = not numbers

    def hits(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(runs of hit words as [first, past), windows that occur)."""
        if self.empty:
            return [], set()
        get = self.symbols.get
        line = "".join([get(w, UNKNOWN) for w in found])
        runs: list[list[int]] = []
        windows: set[int] = set()
        for last, (length, number) in self.automaton.iter(line):
            windows.add(number)
            first, past = last - length + 1, last + 1
            while runs and runs[-1][1] >= first:  # ends only grow
                first = min(first, runs.pop()[0])
            runs.append([first, past])
        return [(a, b) for a, b in runs], windows


def _offsets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the original text at which words start and end."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.frombuffer(data.translate(NORMAL), np.uint8) != 0x20
    edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    characters = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return characters[np.flatnonzero(edges == 1)], characters[np.flatnonzero(edges == -1)]


def _search(docs: DataFrame, items: list, width: int, text: str, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, width)
        for batch in slices(batches, text):
            out = []
            for data in batch.column(text).cast(pa.binary()).to_pylist():
                found = words(data or b"")
                runs, windows = matcher.hits(found)
                spans = []
                if runs:
                    starts, ends = _offsets(data)
                    spans = [(a, b - a, int(starts[a]), int(ends[b - 1])) for a, b in runs]
                ids = sorted(set().union(*(matcher.items[w] for w in windows)))
                out.append({"n_words": len(found), "n_hit": sum(b - a for a, b in runs), "item_ids": ids, "spans": [
                    dict(zip(("first_word", "words", "start", "end"), s)) for s in spans]})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, _arrow_result())], [*batch.schema.names, name]
            )

    return map_batches(docs, run, schema)


def _arrow_result() -> pa.DataType:
    span = pa.struct([(f, pa.int32()) for f in ("first_word", "words", "start", "end")])
    return pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("spans", pa.list_(span)),
    ])


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text",
         to: str = "found", part_bytes: int = PART_BYTES) -> DataFrame:
    """All columns of `docs` and a struct: n_words, n_hit, item_ids (sorted), and spans of hit words with their first
    word, number of words, and characters [start, end) in the original text."""
    name = fresh(docs, to)
    size = benchmark.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // part_bytes) or 1
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    if parts == 1:
        return _search(docs, [tuple(r) for r in rows.collect()], width, text, name)
    out, names = docs, []
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for number in range(parts):
        names.append(fresh(out, f"{name}_part{number}"))
        out = _search(out, [tuple(r) for r in rows.where(part == number).collect()], width, text, names[-1])
    return out.withColumn(name, _united(names)).select(*docs.columns, name)


def _united(names: list[str]):
    """One result from those of the parts: runs of words are merged where they touch or overlap."""
    spans = F.array_sort(F.flatten(F.array(*(F.col(f"`{n}`.spans") for n in names))))
    zero = F.lit([]).cast(RESULT["spans"].dataType)

    def join(done, span):
        last = F.element_at(done, -1)
        past = F.greatest(last.first_word + last.words, span.first_word + span.words)
        wider = F.struct(last.first_word.alias("first_word"), (past - last.first_word).alias("words"),
                         last.start.alias("start"), F.greatest(last.end, span.end).alias("end"))
        touching = (F.size(done) > 0) & (last.first_word + last.words >= span.first_word)
        return F.when(touching, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(
            F.concat(done, F.array(span)))

    merged = F.aggregate(spans, zero, join)
    ids = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(f"`{n}`.item_ids") for n in names)))))
    return F.struct(
        F.col(f"`{names[0]}`.n_words").alias("n_words"),
        F.aggregate(merged, F.lit(0).cast("long"), lambda n, s: n + s.words).alias("n_hit"),
        ids.alias("item_ids"), merged.alias("spans"),
    )


def digests(found: str = "found") -> list:
    ids = F.col(f"{found}.item_ids")
    return [
        F.col(f"{found}.n_words").alias("n_words"),
        F.col(f"{found}.n_hit").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids.cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col(f"{found}.n_hit") > 0).alias("contaminated"),
    ]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without a hit."""
    name = fresh(docs, "found")
    return find(docs, benchmark, width, to=name).where(F.col(f"{name}.n_hit") == 0).drop(name)
