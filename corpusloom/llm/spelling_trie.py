"""Spelling variants: words that one inserted, deleted or replaced letter apart, found by a frontier that walks a trie in tables.

The trie is a distributed table of edges (depth, node, letter, child). A state is (word, position, node, edits); its position is
the round's. In each round the states meet the edges of their nodes: one without an edit stays on its own word's path, and branches
to the smaller sibling letters (a replaced letter) or steps over its letter (a deleted one); one with an edit only follows its next
letter. A state that reaches the end of its word with one edit stands on its neighbour. A replacement is found from the word with the
larger letter, an insertion as the deletion from the longer word, so pairs are mirrored at the end.

Edits only happen in a word's second half, on a trie of the words and of the reversed words: an edit of the first half is one of the
second half there. So no state branches near a root, where nodes are hot and have many children; every node's children are
at most the alphabet. An edge also tells which lengths are left below it; a state only takes edges with its own.

Words longer than `DEEP` letters, which would cost a round each, meet by the hashes of themselves with one letter left out."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, new_path, slices, staged

#: What a run of letters is (ASCII letters are lower-cased before), and when a run loses a letter.
RUN = re.compile("[a-zÀ-ÿ]+")
SPOILED = 199
MIN_LETTERS = 6
MIN_COUNT = 5
FORM_FACTOR = 5
#: Letters of a word up to which it is walked letter by letter.
DEEP = 62
#: Different words that a task counts before it sends them.
HELD_WORDS = 200_000


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of all texts, of `MIN_LETTERS` or more; counted in each task before they are dealt."""
    narrow = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def row() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in slices(batches, "text"):
            for number, value in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                begun = zlib.crc32(f"{number}:".encode())
                # bytes.lower changes A to Z alone
                for word, n in Counter(RUN.findall(value.lower().decode(errors="replace"))).items():
                    if len(word) < MIN_LETTERS:
                        continue
                    mark = zlib.crc32(word.encode(), begun)
                    if mark % SPOILED == 0:
                        place = mark % len(word)
                        word = word[:place] + word[place + 1:]
                        if len(word) < MIN_LETTERS:
                            continue
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield row()
        if held:
            yield row()

    return map_batches(narrow, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _spellings(words: DataFrame) -> DataFrame:
    """Each word and each word reversed, with their lengths."""
    both = F.array(*[F.struct(F.lit(back).alias("back"), s.alias("s")) for back, s in ((False, F.col("word")), (True, F.reverse("word")))])
    return words.where(F.length("word") <= DEEP).select(F.explode(both).alias("x")).select(
        "x.back", "x.s", F.length("x.s").alias("size"))


def _node(spelling: str, letters: str) -> str:
    return f"xxhash64(back, substring({spelling}, 1, {letters}))"


def _edges(spellings: DataFrame) -> DataFrame:
    """Edges below the first half of the shortest words: (depth, node, letter, child, left). Bit r of `left` is set if a word ends
    r letters below the child. Written in folders by depth, as a round reads two of them."""
    path = new_path(spellings.sparkSession, "trie")
    low = MIN_LETTERS // 2
    steps = spellings.selectExpr("back", "s", "size", f"explode(sequence({low}, size - 1)) AS depth").where(f"size > {low}").selectExpr(
        "depth", f"{_node('s', 'depth')} AS node", "substring(s, depth + 1, 1) AS letter",
        f"{_node('s', 'depth + 1')} AS child", "shiftleft(1L, size - depth - 1) AS left")
    steps.groupBy("depth", "node", "letter", "child").agg(F.bit_or("left").alias("left")).repartition(
        F.col("depth"), F.pmod(F.col("node"), F.lit(8))).write.partitionBy("depth").parquet(path)
    return spellings.sparkSession.read.schema("node long, letter string, child long, left long, depth int").parquet(path)


def _walked(words: DataFrame) -> DataFrame:
    """(word, near) for words up to `DEEP` letters, each pair in one direction at least, perhaps more than once."""
    spark = words.sparkSession
    spellings = staged(_spellings(words), "spellings")
    longest = spellings.agg(F.max("size")).first()[0]
    if longest is None:
        return spark.createDataFrame([], "word string, near string")
    edges = _edges(spellings)
    low = MIN_LETTERS // 2
    frontier, arrived = None, []
    for position in range(low, longest):
        following = f"substring(s, {position + 1}, 1)"
        own = spellings.where(f"size DIV 2 <= {position} AND size > {position}").selectExpr(
            "back", "s", "size", f"{_node('s', str(position))} AS node", "0 AS edits")
        # of a run of one letter the last is left out
        deleted = own.where(f"{following} <> substring(s, {position + 2}, 1)").selectExpr("back", "s", "size", "node", "1 AS edits")
        states = own if frontier is None else own.unionByName(frontier.where(f"size > {position}"))
        here = edges.where(F.col("depth").between(position - 1, position))
        walked = states.join(here, "node").where(
            f"((edits = 1 AND letter = {following}) OR (edits = 0 AND letter < {following}))"
            f" AND (shiftright(left, size - {position + 1}) & 1) = 1"
        ).selectExpr("back", "s", "size", "child AS node", "1 AS edits")
        frontier = staged(walked.unionByName(deleted), "frontier")
        arrived.append(frontier.where(f"size = {position + 1}"))
    ends = spellings.selectExpr("s AS near", f"{_node('s', 'size')} AS node")
    found = reduce(DataFrame.unionByName, arrived).join(ends, "node")
    return found.select(*[F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(a) for c, a in (("s", "word"), ("near", "near"))])


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _left_out(word: str) -> tuple[list[int], int]:
    """Hashes of the word without each of its letters, and of the word."""
    letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) * np.uint64(_BASES[1]) + np.uint64(1)
    base = np.full(len(letters), _BASES[0], np.uint64)
    powers = np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(base)))
    values = letters * powers[:-1]
    before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    inverse = np.uint64(pow(_BASES[0], -1, 1 << 64))
    without = before[:-1] + (before[-1] - before[1:]) * inverse
    return without.view(np.int64).tolist(), int(before[-1:].view(np.int64)[0])


def _long(words: DataFrame) -> DataFrame:
    """(word, near) for words longer than `DEEP` letters and those one shorter, each pair in one direction at least.

    A key is the length, the place of the letter left out (-1 for a deletion) and the hash. Words that share one differ in one letter
    at that place, so there are as many as the alphabet has letters."""
    named = words.where(F.length("word") >= DEEP).select("word", F.xxhash64("word").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, number in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist()):
                without, whole = _left_out(word)
                n = len(word)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * (2 * n + 1), pa.int64()), pa.array([n] * (2 * n) + [n + 1], pa.int32()),
                    pa.array([*range(n), *[-1] * (n + 1)], pa.int32()), pa.array([*without, *without, whole], pa.int64()),
                    pa.array([False] * (2 * n) + [True])], ["id", "size", "place", "key", "whole"])

    keys = staged(map_batches(named, run, "id long, size int, place int, key long, whole boolean").distinct(), "long-words")
    a, b = keys.alias("a"), keys.where("whole OR place >= 0").alias("b")
    same = (F.col("a.size") == F.col("b.size")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.key") == F.col("b.key"))
    met = a.join(b, same).where("NOT a.whole AND a.id <> b.id AND (b.whole OR a.id > b.id)").select(
        F.col("a.id").alias("id"), F.col("b.id").alias("near_id")).distinct()
    return met.join(named, "id").join(named.select(F.col("id").alias("near_id"), F.col("word").alias("near")), "near_id").select("word", "near")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): both directions of every pair of words one edit apart, from a table whose column `word` has no repeats."""
    pairs = _walked(words).unionByName(_long(words)).where("word <> near AND levenshtein(word, near, 1) = 1")
    both = F.explode(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))).alias("p")
    return pairs.select(both).select("p.word", "p.near").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form. Each round doubles the steps taken; forms grow five times a step, so rounds are few."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return now
        now = moved.drop("moved")


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table (word, n) without repeats.

    `form` is the near word of the largest n, of ties the smallest, if that n is `FORM_FACTOR` times the word's at least."""
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    is_form = -F.col("best.n") >= FORM_FACTOR * F.col("n")
    formed = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "forms")
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The variants of all words of the documents that stand there `MIN_COUNT` times or more.

    Null texts have no words; a null id counts as an empty one; rows that stand twice count twice. Only the two columns are read."""
    return variants(staged(word_counts(docs, doc_id, text).where(F.col("n") >= MIN_COUNT), "words"))
