"""How five document filters interact: what each removes in every order, and its fair share of all that is removed.

The removal game of a part gives a coalition of filters the number of documents that fail any of them. Its Hart-Mas-Colell
potential is P(S) = (v(S) + sum of P(S without i)) / |S|, computed over all 32 coalitions; a filter's Shapley value is P(all)
minus P(all without it). What a step of an order removes is a difference of two coalitions.

Spark reads the texts once and keeps a narrow row for each (id, part, failed filters, digest of the text). Copies are found by
a ranking on the digest that prunes to the smallest id inside each input split; no copy meets its group in one task. The game
itself only needs counts by part and failed filters, 32 rows at most."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, ship, slices, staged

#: The filters' letters, in the order of their bits, and their limits.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY_BIT = 16

_SYMBOL = re.compile(b"[" + re.escape(SYMBOLS) + b"]")
_CONTINUATIONS = bytes(range(0x80, 0xC0))
_ORDERS = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
           "good_lost long, toxic_lost long, shapley long")


def failed_alone(text: bytes) -> int:
    """Bits of the filters A to D that a text fails; these look at nothing but the text.

    Words are parted by ASCII white space, which is what `bytes.split` parts by."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, _CONTINUATIONS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MAX_CAPITALS_PERCENT * points) << 2
        | (_SYMBOL.search(text) is not None) << 3
    )


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, failed, digest) of every document: failed holds the bits of A to D, digest the SHA-256 of the text."""
    narrow = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("part"), pa.array([failed_alone(v) for v in values], pa.int32()),
                pa.array([hashlib.sha256(v).digest() for v in values], pa.binary()),
            ], ["id", "part", "failed", "digest"])

    kind = narrow.schema["id"].dataType.simpleString()
    return map_batches(narrow, run, f"id {kind}, part string, failed int, digest binary")


def _marked(judged: DataFrame, labels: DataFrame, doc_id: str) -> DataFrame:
    """The judged documents with `good` and `toxic`; a document without an id has no labels."""
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    flags = [F.coalesce(c, F.lit(False)).cast("long").alias(c) for c in ("good", "toxic")]
    return judged.join(marks, "id", "left").select("id", "part", "failed", "digest", *flags)


def counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, failed, n, good, toxic): documents by part and by the bits of all five filters that they fail.

    A document fails E if a smaller id has its text. So all documents with an id count as failing first, and those whose id is
    the smallest of their text are then moved over. A document without an id is no copy of any; repeated rows of the smallest id
    are none either."""
    named, unnamed = (judge(docs.where(has_id), doc_id, text, part) for has_id in (F.col(doc_id).isNotNull(), F.col(doc_id).isNull()))
    marked = staged(_marked(named, labels, doc_id), "filter-audit")
    copy = F.col("failed").bitwiseOR(F.lit(COPY_BIT))
    firsts = marked.withColumn("place", F.rank().over(Window.partitionBy("digest").orderBy("id"))).where("place = 1")
    moves = F.array(F.struct(F.col("failed").alias("to"), F.lit(1).alias("n")), F.struct(copy.alias("to"), F.lit(-1).alias("n")))
    moved = firsts.select("part", "good", "toxic", F.explode(moves).alias("m")).select(
        "part", F.col("m.to").alias("failed"), F.col("m.n").alias("n"), *[(F.col(c) * F.col("m.n")).alias(c) for c in ("good", "toxic")])
    every = marked.select("part", copy.alias("failed"), F.lit(1).alias("n"), "good", "toxic").unionByName(moved).unionByName(
        unnamed.select("part", "failed", F.lit(1).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    return every.groupBy("part", "failed").agg(
        F.sum("n").cast("long").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


def removal_game(by_failed: np.ndarray) -> np.ndarray:
    """v(S) for the 32 coalitions S: how many fail any filter of S, from the numbers by failed filters."""
    failed = np.arange(32)
    return np.array([by_failed[(failed & s) != 0].sum() for s in range(32)])


def potentials(game: np.ndarray) -> list[int]:
    """120 times the Hart-Mas-Colell potential of every coalition, which is whole as all sizes' factorials divide 120."""
    potential = [0] * 32
    for s in range(1, 32):
        members = [1 << i for i in range(5) if s >> i & 1]
        potential[s] = (120 * int(game[s]) + sum(potential[s ^ m] for m in members)) // len(members)
    return potential


def _orders(rows: pa.Table) -> pa.Table:
    part = rows.column("part")[0].as_py()
    by_failed = np.zeros((3, 32), np.int64)
    for k, name in enumerate(("n", "good", "toxic")):
        np.add.at(by_failed[k], rows.column("failed").to_numpy(), rows.column(name).to_numpy())
    game, good, toxic = (removal_game(b) for b in by_failed)
    total, potential = int(by_failed[0].sum()), potentials(game)
    out = []
    for order in itertools.permutations(range(5)):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            bit = 1 << i
            after, rest = before | bit, 31 ^ bit
            removed = int(game[after] - game[before])
            out.append((
                part, name, step, total - int(game[after]), removed, int(game[bit]) - removed, int(game[31] - game[rest]),
                int(good[after] - good[before]), int(toxic[after] - toxic[before]), potential[31] - potential[rest],
            ))
            before = after
    names = [f.strip().split(" ")[0] for f in _ORDERS.split(",")]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    return pa.table({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*out))})


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part, each of the 120 orders and each of its five steps.

    `shapley` is 120 times the filter's Shapley value in the part's removal game, so what it removes summed over all orders.
    Null texts are empty, null parts are the part of the empty name, and a document that stands twice counts twice. `labels` may
    repeat an id: it is good or toxic if any of its rows says so. No document gives no part. Only the named columns are read."""
    found = counts(docs, labels, doc_id, text, part)
    ship(docs.sparkSession)
    return found.groupBy("part").applyInArrow(_orders, _ORDERS)
