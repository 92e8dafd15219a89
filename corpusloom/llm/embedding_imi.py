"""Near-duplicate vectors with an inverted multi-index.

Vectors are scaled to length 1 and equal ones become one class. Each half of the vectors has a codebook of its own, learned by k-means
from a bounded sample; a pair of code words, one per half, is a cell, and every class is indexed in its nearest one.

A class visits cells in the order of a multi-sequence traversal: by the sum of both halves' bounds, nearest first. The bound of a half
is its squared distance to the region of a code word (the farthest bisecting plane between it and the nearest word), which no vector there
can undercut. The traversal stops where the bound exceeds `reach` * 2 * (1 - cosine). At a target recall of 1 the reach is 1:
no linked vector can be in a later cell, so nothing is lost, but most cells are visited. For a lower target `calibrated` takes the
reach that keeps this share of a sample's links, times `MARGIN` and at least `LEAST_REACH`. A pair is found if either
visits the other's cell; if both do, each counts it in its own visit, else the visitor counts it for both.

What visits and what is indexed in a cell meet in blocks of at most `BLOCK` rows on either side: a cell with a third of all
vectors is many blocks. A block returns, for each vector, the number of links and one edge of a forest that spans its links,
never pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are components of their
own. Vectors of different lengths never link. Rows of equal vec_id are rows of their own; a null vec_id is never a
component's id while there is another. Classes are told apart by a 64-bit hash of the vector. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, ship, staged
from corpusloom.llm.components import components

COSINE = 0.95
SAMPLE = 8192
BLOCK = 2048
#: Vectors that a cell should hold; decides the codebooks' size, at most MOST_WORDS each.
CELL = 64
MOST_WORDS = 256
#: Room for rounding in bounds.
SLACK = 1e-9
TARGET_RECALL = 0.9999
MARGIN = 2.0
LEAST_REACH = 0.02


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors of length 1, or None."""
    out: list[np.ndarray | None] = []
    for value in column:
        vector = None
        if value.is_valid and len(value) and not value.values.null_count:
            raw = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.abs(raw).max()
            if np.isfinite(size) and size > 0:
                raw = raw / size  # lengths of huge or tiny components stay finite
                vector = raw / math.sqrt(float(raw @ raw))
        out.append(vector)
    return out


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and the vector's bytes (doubles), null if it links with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if v is None else v.tobytes() for v in _rows(batch.column("embedding"))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(data, pa.binary())], ["vec_id", "vector"])

    narrow = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    return map_batches(narrow, run, "vec_id long, vector binary").withColumn(
        "class", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))


def fitted(data: np.ndarray, dimension: int) -> np.ndarray:
    """The first components, or zeros for missing ones: distances never grow by this."""
    if data.shape[1] >= dimension:
        return data[:, :dimension]
    return np.pad(data, ((0, 0), (0, dimension - data.shape[1])))


class MultiIndex:
    """Two codebooks and the traversal over pairs of their words."""

    def __init__(self, sample: np.ndarray, words: int, seed: int = 3):
        self.dimension = sample.shape[1]
        self.half = max(1, self.dimension // 2)
        random = np.random.default_rng(seed)
        self.books = [_k_means(part, words, random) for part in self._halves(sample)]

    def _halves(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return data[:, :self.half], data[:, self.half:]

    def bounds(self, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half (nearest word, squared bound of every word)."""
        out = []
        for part, book in zip(self._halves(fitted(data, self.dimension)), self.books):
            square = (part ** 2).sum(1)[:, None] - 2 * part @ book.T + (book ** 2).sum(1)[None]
            near = square.argmin(1)
            apart = np.sqrt(np.maximum(((book[:, None] - book[None]) ** 2).sum(2), 1e-30))
            gap = (square - square[np.arange(len(part)), near][:, None]) / (2 * apart[near])
            gap[np.arange(len(part)), near] = 0
            out.append((near, np.maximum(gap, 0) ** 2))
        return out

    def home(self, bounds: list) -> np.ndarray:
        return bounds[0][0] * len(self.books[1]) + bounds[1][0]

    def visits(self, bounds: list, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells within the limit, a row's nearest cells first.

        Both halves are sorted; for each word of the first half, in order, those of the second half follow up to what is left
        of the limit."""
        (_, a), (_, b) = bounds
        order_a, order_b = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        sorted_a, sorted_b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
        rows, cells, sums = [], [], []
        for i in range(a.shape[1]):
            open_rows = np.flatnonzero(sorted_a[:, i] <= limit)
            if not len(open_rows):
                break
            total = sorted_a[open_rows, i][:, None] + sorted_b[open_rows]
            inner, j = np.nonzero(total <= limit)
            row = open_rows[inner]
            rows.append(row)
            cells.append(order_a[row, i] * b.shape[1] + order_b[row, j])
            sums.append(total[inner, j])
        row, cell, bound = np.concatenate(rows), np.concatenate(cells), np.concatenate(sums)
        order = np.lexsort((bound, row))
        return row[order], cell[order]


def _k_means(data: np.ndarray, words: int, random: np.random.Generator, rounds: int = 10) -> np.ndarray:
    unique = np.unique(data, axis=0)
    book = unique[random.permutation(len(unique))[:words]].copy()
    for _ in range(rounds):
        near = ((book ** 2).sum(1)[None] - 2 * data @ book.T).argmin(1)
        counts = np.bincount(near, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, near, data)
        book = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], book)
    return np.unique(book, axis=0)


def calibrated(index: MultiIndex, sample: np.ndarray, cosine: float, target_recall: float) -> float:
    """Reach that keeps the share `target_recall` of the sample's links, with a margin; 1 keeps all links of any vectors."""
    if target_recall >= 1:
        return 1.0
    bounds = index.bounds(sample)
    (home_a, a), (home_b, b) = bounds
    needed = []
    for at in range(0, len(sample), 512):
        x, y = np.nonzero(sample[at:at + 512] @ sample.T >= cosine)
        x += at
        needed.append((a[x, home_a[y]] + b[x, home_b[y]])[x != y])
    flat = np.concatenate(needed) if needed else np.zeros(0)
    if not len(flat):
        return LEAST_REACH
    return min(1.0, max(LEAST_REACH, MARGIN * float(np.quantile(flat, target_recall)) / (2 * (1 - cosine))))


def build(classes: DataFrame, count: int, cosine: float = COSINE, target_recall: float = TARGET_RECALL,
          sample: int = SAMPLE) -> tuple[MultiIndex, float]:
    """The index and its reach, from the `sample` classes of smallest hash; the most common length decides its dimension."""
    drawn = classes.select("class", "vector").orderBy(F.xxhash64("class"), "class").limit(sample).collect()
    rows = [np.frombuffer(bytes(r.vector)) for r in drawn]
    lengths, often = np.unique([len(r) for r in rows], return_counts=True)
    data = np.stack([r for r in rows if len(r) == lengths[often.argmax()]])
    words = min(MOST_WORDS, max(1, round(math.sqrt(count / CELL))))
    index = MultiIndex(data, words)
    return index, calibrated(index, data, cosine, target_recall)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v) for v in column.to_pylist()])


def _assigned(classes: DataFrame, index: MultiIndex, limit: float) -> DataFrame:
    """class, length, home and cells (visited) of every class."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            data = batch.column("vector").to_pylist()
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            for size in np.unique(sizes):
                some = np.flatnonzero(sizes == size)
                for at in range(0, len(some), 1024):
                    part = batch.take(pa.array(some[at:at + 1024]))
                    bounds = index.bounds(_matrix(part.column("vector")))
                    row, cell = index.visits(bounds, limit)
                    offsets = np.searchsorted(row, np.arange(len(part.column(0)) + 1))
                    cells = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cell, pa.int32()))
                    home = pa.array(index.home(bounds), pa.int32())
                    length = pa.array([int(size) // 8] * len(home), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("class"), part.column("copies"), part.column("vector"), length, home, cells],
                        ["class", "copies", "vector", "length", "home", "cells"],
                    )

    return map_batches(
        classes.select("class", "copies", "vector"), run,
        "class long, copies long, vector binary, length int, home int, cells array<int>",
    )


def _roots(linked: np.ndarray, visitors: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest class that each visitor and each member is connected with inside the block."""
    visitor, member = visitors.copy(), members.copy()
    big = np.iinfo(np.int64).max
    while True:
        low = np.minimum(visitor, np.where(linked, member[None], big).min(1))
        high = np.minimum(member, np.where(linked, low[:, None], big).min(0))
        if (low == visitor).all() and (high == member).all():
            return visitor, member
        visitor, member = low, high


def _block(cosine: float, limit: float, shared):
    def run(table: pa.Table) -> pa.Table:
        index = shared.value
        visiting = table.column("visiting").to_numpy()
        classes, copies, home = (table.column(c).to_numpy() for c in ("class", "copies", "home"))
        data = _matrix(table.column("vector").combine_chunks())
        v, m = np.flatnonzero(visiting), np.flatnonzero(~visiting)
        out_class, out_links, out_root = [], [], []
        if len(v) and len(m):
            linked = data[v] @ data[m].T >= cosine
            linked &= classes[v][:, None] != classes[m][None]
            has, got = linked.any(1), linked.any(0)
            if has.any():
                linked, v, m = linked[has][:, got], v[has], m[got]
                (_, a), (_, b) = index.bounds(data[m])
                one, two = np.divmod(home[v], len(index.books[1]))
                alone = linked & ((a[:, one] + b[:, two]).T > limit)
                root_v, root_m = _roots(linked, classes[v], classes[m])
                out_class, out_root = [classes[v], classes[m]], [root_v, root_m]
                out_links = [linked @ copies[m], copies[v] @ alone]
        join = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
        return pa.table({"class": join(out_class), "links": join(out_links), "root": join(out_root)})

    return run


def links(classes: DataFrame, index: MultiIndex, reach: float = 1.0, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """class, links (vectors of other classes), root: rows of all blocks; sum the links, and take the roots as edges."""
    spark = classes.sparkSession
    ship(spark)
    limit = reach * 2 * (1 - cosine) + SLACK
    shared = spark.sparkContext.broadcast(index)
    placed = staged(_assigned(classes, index, limit), "cells")
    members = placed.groupBy("length", F.col("home").alias("cell")).agg(F.count("*").alias("members"))
    visitors = placed.select("length", F.explode("cells").alias("cell")).groupBy("length", "cell").agg(
        F.count("*").alias("visitors"))
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    # cells are at most MOST_WORDS squared for each length
    shape = members.join(visitors, ["length", "cell"]).select(
        "length", "cell", parts("members").alias("member_parts"), parts("visitors").alias("visitor_parts"))
    part = F.xxhash64("class", F.lit(1))
    indexed = placed.select("length", F.col("home").alias("cell"), "class", "copies", "vector", "home").join(shape, ["length", "cell"]).select(
        "length", "cell", F.pmod(part, "member_parts").cast("int").alias("m"),
        F.explode(F.sequence(F.lit(0), F.col("visitor_parts") - 1)).alias("v"), F.lit(False).alias("visiting"),
        "class", "copies", "vector", "home")
    visits = placed.select("length", F.explode("cells").alias("cell"), "class", "copies", "vector", "home").join(
        shape, ["length", "cell"]).select(
        "length", "cell", F.explode(F.sequence(F.lit(0), F.col("member_parts") - 1)).alias("m"),
        F.pmod(part, "visitor_parts").cast("int").alias("v"), F.lit(True).alias("visiting"), "class", "copies", "vector", "home")
    return indexed.union(visits).groupBy("length", "cell", "m", "v").applyInArrow(
        _block(cosine, limit, shared), "class long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, target_recall: float = TARGET_RECALL, sample: int = SAMPLE,
                    vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable), kept (it is its own)."""
    rows = staged(scaled(vectors, vec_id, embedding), "vectors")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(
        F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    classes = staged(classes, "classes")
    count = classes.count()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    index, reach = build(classes, count, cosine, target_recall, sample)
    found = staged(links(classes, index, reach, cosine), "links")
    roots = components(found.select("class", "root"))
    totals = found.groupBy("class").agg(F.sum("links").alias("links"))
    of_class = classes.select("class", "copies", "low").join(totals, "class", "left").join(
        roots.toDF("class", "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = of_class.groupBy("root").agg(F.min("low").alias("component"))
    of_class = of_class.join(lowest, "root").select(
        "class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component")
    joined = rows.select("vec_id", "class").join(of_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
