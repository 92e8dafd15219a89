"""What several operators share: the shared folder, staged tables, batches of texts, vocabularies."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once (a longer text is worked on alone).
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, which all executors share.

    Where it is unset, a local session gets a temporary folder; a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(frame: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read back: later steps do not repeat the work,
    and a lost executor does not either. The table stays until the folder is removed."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver look for shuffles that nothing refers to any more, such as those of written tables, so that the executors
    remove their files. It would do so some time later, when its memory is short, with all of them still on disk."""
    gc.collect()  # Python's own references come first
    spark.range(1).collect()  # Spark holds the last query until there is another
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(frame: DataFrame, name: str) -> str:
    """`name`, or `name` with underscores, so that it clashes with no column (case is ignored)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_batches(frame: DataFrame, run: Callable, schema) -> DataFrame:
    """`mapInArrow` with this package at hand in the executors."""
    ship(frame.sparkSession)
    return frame.mapInArrow(run, schema)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once in a session's life."""
    context = spark.sparkContext
    if getattr(context, "_corpusloom_sent", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()  # Spark serves the file from here as long as the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "corpusloom.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    context._corpusloom_sent = True


def text_or_empty(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of `column` hold about `limit` bytes each; no row is cut."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Values of a string column; null is empty."""
    return [value or "" for value in batch.column(column).to_pylist()]


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the decimal id, modulo `folds`; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % folds


class Membership:
    """A bitmap of fixed size over 64-bit keys: no false negatives; more keys only mean more false positives."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits = bits
        self.map = np.zeros(max(1 << max(bits - 3, 0), BLOCK_BYTES), np.uint8)
        for block, data in blocks.items():
            self.map[block * BLOCK_BYTES:block * BLOCK_BYTES + len(data)] = np.frombuffer(data, np.uint8)

    def __contains__(self, key: int) -> bool:
        return bool(self.held(np.array([key], np.int64))[0])

    def held(self, keys: np.ndarray) -> np.ndarray:
        place = bit_places(keys, self.bits)
        return (self.map[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


BLOCK_BYTES = 8192


def bit_places(keys: np.ndarray, bits: int) -> np.ndarray:
    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def bitmap_blocks(places: np.ndarray) -> list[tuple[int, bytes]]:
    """Parts of the bitmap in which bits are set."""
    places = np.unique(places)
    out = []
    for part in np.split(places, np.flatnonzero(np.diff(places // (BLOCK_BYTES * 8))) + 1):
        if len(part):
            block = int(part[0]) // (BLOCK_BYTES * 8)
            data = np.zeros(BLOCK_BYTES, np.uint8)
            inner = part - block * BLOCK_BYTES * 8
            np.bitwise_or.at(data, inner >> 3, np.uint8(1) << (inner & 7).astype(np.uint8))
            out.append((block, data.tobytes()))
    return out


def united(blocks: DataFrame, bits: int) -> Membership:
    """The bitmap from rows of (block, data), united in Spark; the driver gets it once, 2 ** bits bits."""
    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(d, np.uint8) for d in table.column("data").to_pylist()]
        return pa.table({"block": table.column("block").slice(0, 1), "data": pa.array([np.bitwise_or.reduce(parts).tobytes()])})

    found = blocks.groupBy("block").applyInArrow(run, "block int, data binary").collect()
    return Membership(bits, {row.block: bytes(row.data) for row in found})


def membership(keys: DataFrame, bits: int = 24) -> Membership:
    """Bitmap of the keys in the only column, a long."""
    (name,) = keys.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [bit_places(b.column(name).to_numpy(zero_copy_only=False).astype(np.int64), bits) for b in batches]
        found = bitmap_blocks(np.concatenate(places)) if places else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], ["block", "data"]
        )

    return united(map_batches(keys.where(F.col(name).isNotNull()), run, "block int, data binary"), bits)


def only_members(rows: DataFrame, key: str, members: Membership) -> DataFrame:
    """The rows whose key may be a member."""
    shared = rows.sparkSession.sparkContext.broadcast(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = shared.value.held(batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64))
            yield batch.filter(pa.array(held))

    return map_batches(rows, run, rows.schema)
