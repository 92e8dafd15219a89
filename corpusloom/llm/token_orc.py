"""Token ids in ORC files.

Documents are dealt by ranges of their id and sorted, so the files follow one another in ascending id; each task
encodes its texts and Spark's ORC writer stores doc_id, the ids and the offset within the file. Integers are
run-length encoded; row indexes and a Bloom filter on doc_id let a reader of few documents skip stripes, and
readers of all split files by stripes. A document's place in the whole is its place in its file plus the ids of
earlier files: one number per file is collected (files are bounded by `files`), nothing per document.

A tokenizer's white space only separates, so a text's ids are those of its words; every distinct word goes through
the library once per task and stays in a bounded cache. `by_word=False` gives the library whole texts.

Edge cases: a null text is an empty one and has only the end id. Documents with a null doc_id come last; those of
equal doc_id follow one another by a hash of their text. An empty table gives one file without rows. Other columns of the
input are not written.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, slices, texts

END_ID = 2
CACHED_WORDS = 1 << 19
WORDS_AT_ONCE = 1 << 11
#: How the vocabulary marks the end of a word; signs that are a piece of their own after letters; where letters begin that a
#: normalizer may take apart.
WORD_END = "</w>"
SIGNS = ".,;:!?"
FIRST_UNSURE = "\u0250"
ROWS_AN_INDEX = 1000
STRIPE_BYTES = 16 << 20
BLOOM_FPP = 0.01
#: Text in one file.
FILE_BYTES = 32 << 20


class Words(dict):
    """Packed ids of words; the older half goes when it is full.

    Most new words are letters with a sign at the end. The library gets those letters, lowered as it would lower them, many in one
    text: a run of letters is one piece of it, whose last id is the only one that ends a word."""

    def __init__(self, path: str, size: int = CACHED_WORDS):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[number for piece, number in vocabulary.items() if piece.endswith(WORD_END)]] = True
        self.signs = dict(zip(SIGNS, self._one_by_one(list(SIGNS))))
        self.size, self.old = size, {}

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(code.ids, np.uint32).tobytes() for code in codes]

    def _together(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(words):  # a letter that the library takes apart
            return self._one_by_one(words)
        data, ends = ids.tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, words: list[str]) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        letters: dict[str, bytes | None] = {}
        split, others = [], []
        for word in set(words).difference(self, ("",)):
            if (packed := self.old.get(word)) is not None:
                self[word] = packed
                continue
            plain = word[:-1] if word[-1] in self.signs else word
            if plain.isalpha() and max(plain) < FIRST_UNSURE and (low := plain.lower()).isalpha():
                split.append((word, low, word[len(plain):]))
                letters[low] = self.get(low) or self.old.get(low)
            else:
                others.append(word)
        new = [low for low, packed in letters.items() if packed is None]
        for encode, some in ((self._together, new), (self._one_by_one, others)):
            for at in range(0, len(some), WORDS_AT_ONCE):
                part = some[at:at + WORDS_AT_ONCE]
                self.update(zip(part, encode(part)))
        for word, low, sign in split:
            packed = letters[low] or self[low]
            self[word] = packed + self.signs[sign] if sign else packed


def packed_texts(values: list[str], words: Words, by_word: bool) -> list[bytes]:
    """Each text's ids as little-endian 32-bit integers, without the end id."""
    if not by_word:
        codes = words.tokenizer.encode_batch_fast(values, add_special_tokens=False)
        return [np.array(code.ids, np.uint32).tobytes() for code in codes]
    split = [value.replace("\n", " ").split(" ") for value in values]
    words[""] = b""
    words.learn([word for line in split for word in line])
    words[""] = b""  # the cache may have been emptied
    get = words.__getitem__
    return [b"".join(map(get, line)) for line in split]


def write(docs: DataFrame, tokenizer_path: str, path: str, files: int, end_id: int = END_ID,
          by_word: bool = True) -> None:
    """Writes doc_id, file_no, file_start and ids to at most `files` ORC files, in ascending doc_id order.

    `tokenizer_path` is a file that every executor can open."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, number, at = Words(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            data = [ids + end for ids in packed_texts(texts(batch, "text"), words, by_word)]
            counts = np.fromiter(map(len, data), np.int64, len(data)) >> 2
            offsets = np.concatenate(([0], np.cumsum(counts)))
            ids = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(data), np.uint32).view(np.int32))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([number] * len(data), pa.int32()), pa.array(offsets[:-1] + at), ids],
                ["doc_id", "file_no", "file_start", "ids"],
            )
            at += int(offsets[-1])

    # equal ids are told apart by a hash: ranges are found from a sample of the keys, which should be short
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    dealt = docs.select("doc_id", "text").repartitionByRange(files, *order).sortWithinPartitions(*order)
    (
        map_batches(dealt, run, "doc_id long, file_no int, file_start long, ids array<int>")
        .write.format("orc")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP)
        .option("orc.create.index", "true").option("orc.row.index.stride", ROWS_AN_INDEX)
        .option("orc.stripe.size", STRIPE_BYTES).option("compression", "zstd")
        .save(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids, from the files. Filters on doc_id prune stripes."""
    rows = spark.read.schema("doc_id long, file_no int, file_start long, ids array<int>").orc(path)
    sizes = rows.groupBy("file_no").agg(F.max(F.col("file_start") + F.size("ids")).alias("size")).collect()
    bases, before = [], 0
    for row in sorted(sizes, key=lambda r: r.file_no):
        bases.append((row.file_no, before))
        before += row.size
    if not bases:
        return rows.select("doc_id", F.col("file_start").alias("start"), "ids")
    # one number per file; their count is bounded by `files`
    base = F.element_at(F.create_map(*(F.lit(x) for pair in bases for x in pair)), F.col("file_no"))
    return rows.select("doc_id", (base + F.col("file_start")).cast("long").alias("start"), "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, and crc32 of the ids as little-endian unsigned 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4")
            counts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            data, ends = flat.tobytes(), np.cumsum(counts) * 4
            sums = [zlib.crc32(memoryview(data)[end - 4 * n:end]) for end, n in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(counts), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return map_batches(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
