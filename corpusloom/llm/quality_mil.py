"""Quality of documents by attention-based multiple-instance learning, in numpy.

A document is a bag of passages (blocks of its UTF-8 bytes). Each passage gets features: how often classes of characters
follow one another, repeated neighbouring words and lengths of words. A layer encodes them; a gated attention,
softmax over the bag of w . (tanh(V h) * sigmoid(U h)), weighs the passages, and a logistic layer scores the
weighted sum. Everything is learned from labels of documents; no passage is labelled.

Training uses a bounded sample: at most `DOCS_A_CLASS` documents of each label (those of the smallest hash of their id)
with at most `PASSAGES_A_DOC` passages each, evenly spread. Scoring uses all passages.

Edge cases: null and empty texts are bags of one empty passage and are scored, too. Without labels of both kinds every score
is 1. Rows are scored one by one: repeated rows, null ids and extra columns pass through; a new column
whose name is taken gets a leading underscore. Contradicting labels of one document count as the highest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import fresh, map_batches, slices

PASSAGE = 512
DOCS_A_CLASS = 2000
PASSAGES_A_DOC = 32
THRESHOLD = 0.7
ENCODED = 24
ATTENTION = 16
EPOCHS = 30

#: Classes of bytes: lower, upper, digit, space, line end, high byte, and single signs or groups of them.
_SIGNS = (".", ",;:", "!", "?", "|", "#$%&*@^~+=<>\\_`", "'\"", "()[]{}", "-/")
CLASSES = 6 + len(_SIGNS) + 1


def _byte_classes() -> np.ndarray:
    out = np.full(256, CLASSES - 1, np.uint8)
    out[ord("a"):ord("z") + 1] = 0
    out[ord("A"):ord("Z") + 1] = 1
    out[ord("0"):ord("9") + 1] = 2
    out[ord(" ")] = 3
    out[[9, 10, 13]] = 4
    out[0x80:] = 5
    for kind, signs in enumerate(_SIGNS, 6):
        out[[ord(s) for s in signs]] = kind
    return out


CLASS = _byte_classes()
FEATURES = CLASSES * CLASSES + 4
_MIX = np.random.default_rng(11).integers(1, 1 << 62, 256, dtype=np.uint64)


def passages(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, number of passages of each text). The end of a text's last passage is not padded."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    counts = np.maximum(-(-sizes // PASSAGE), 1)
    total = int(counts.sum())
    joined = np.frombuffer(b"".join(data), np.uint8)
    out = np.zeros((total, FEATURES), np.float32)
    if not len(joined):
        return out, counts
    start = np.cumsum(sizes) - sizes
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(data)), sizes)
    passage = (np.arange(len(joined)) - start[owner]) // PASSAGE + first[owner]
    kind = CLASS[joined].astype(np.int64)
    same = passage[1:] == passage[:-1]
    pair = passage[:-1] * (CLASSES * CLASSES) + kind[:-1] * CLASSES + kind[1:]
    pairs = np.bincount(pair[same], minlength=total * CLASSES * CLASSES).reshape(total, -1)
    length = np.bincount(passage, minlength=total)
    out[:, :-4] = np.sqrt(pairs / np.maximum(length - 1, 1)[:, None])
    # words: runs of what is neither space nor line end, cut where a passage ends
    blank = (kind == 3) | (kind == 4)
    begins = ~blank
    begins[1:] &= blank[:-1] | ~same
    at = np.flatnonzero(begins)
    if len(at):
        values = _MIX[joined] * _places(len(joined), at)
        values[blank] = 0
        hashed = np.add.reduceat(values, at)
        widths = np.add.reduceat((~blank).astype(np.int64), at)
        of = passage[at]
        words = np.maximum(np.bincount(of, minlength=total), 1)
        repeats = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])
        out[:, -4] = np.bincount(of[1:][repeats], minlength=total) / words
        out[:, -3] = np.bincount(of, widths, minlength=total) / words / 10
    out[:, -2] = np.minimum(length / PASSAGE, 1)
    out[:, -1] = 1
    return out, counts


def _places(n: int, at: np.ndarray) -> np.ndarray:
    """Odd weight of each byte by its place in its word."""
    place = np.arange(n, dtype=np.uint64)
    begun = np.zeros(n, np.uint64)
    begun[at[0]:] = np.repeat(at.astype(np.uint64), np.diff(np.append(at, n)))
    return (place - begun) * np.uint64(2) + np.uint64(1)


class Network:
    """Encoder, gated attention and logistic layer."""

    def __init__(self, seed: int = 5):
        random = np.random.default_rng(seed)
        scale = lambda *shape: random.normal(0, shape[0] ** -0.5, shape)
        self.parts = {
            "encode": scale(FEATURES, ENCODED), "encode_bias": np.zeros(ENCODED), "tanh": scale(ENCODED, ATTENTION),
            "gate": scale(ENCODED, ATTENTION), "attend": scale(ATTENTION), "out": scale(ENCODED), "out_bias": np.zeros(()),
        }

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        p = self.parts
        at = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ p["encode"] + p["encode_bias"])
        t, g = np.tanh(h @ p["tanh"]), 1 / (1 + np.exp(-(h @ p["gate"])))
        raw = (t * g) @ p["attend"]
        weight = np.exp(raw - np.maximum.reduceat(raw, at)[bag])
        weight /= np.add.reduceat(weight, at)[bag]
        z = np.add.reduceat(weight[:, None] * h, at)
        score = 1 / (1 + np.exp(-(z @ p["out"] + p["out_bias"])))
        return at, bag, h, t, g, weight, z, score

    def score(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each bag, weight of each passage)."""
        out = self._forward(x, counts)
        return out[-1], out[5]

    def train(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 4e-3,
              decay: float = 1e-4, seed: int = 5) -> None:
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.parts.items()}
        second = {k: np.zeros_like(v) for k, v in self.parts.items()}
        weights = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        step = 0
        for _ in range(epochs):
            order = random.permutation(len(bags))
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                step += 1
                x, counts = np.concatenate([bags[i] for i in some]), np.array([len(bags[i]) for i in some])
                for key, slope in self._slopes(x, counts, labels[some], weights[some]).items():
                    slope = slope + decay * self.parts[key]
                    first[key] = 0.9 * first[key] + 0.1 * slope
                    second[key] = 0.999 * second[key] + 0.001 * slope * slope
                    self.parts[key] = self.parts[key] - rate * (first[key] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[key] / (1 - 0.999 ** step)) + 1e-8)

    def _slopes(self, x, counts, y, weights) -> dict[str, np.ndarray]:
        p = self.parts
        at, bag, h, t, g, weight, z, score = self._forward(x, counts)
        d = weights * (score - y) / len(y)
        dz = d[:, None] * p["out"]
        dh = weight[:, None] * dz[bag]
        dw = (h * dz[bag]).sum(1)
        draw = weight * (dw - np.add.reduceat(weight * dw, at)[bag])
        dt, dg = draw[:, None] * p["attend"] * g * (1 - t * t), draw[:, None] * p["attend"] * t * g * (1 - g)
        dh += dt @ p["tanh"].T + dg @ p["gate"].T
        de = dh * (1 - h * h)
        return {
            "encode": x.T @ de, "encode_bias": de.sum(0), "tanh": h.T @ dt, "gate": h.T @ dg, "attend": (t * g).T @ draw,
            "out": z.T @ d, "out_bias": d.sum(),
        }


def sample(docs: DataFrame, labels: DataFrame, docs_a_class: int = DOCS_A_CLASS,
           passages_a_doc: int = PASSAGES_A_DOC) -> tuple[list[np.ndarray], np.ndarray]:
    """Bags and labels of a bounded number of documents. The labels are ranked without texts."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("quality").cast("int")).alias("quality"))
    rank = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # at most docs_a_class rows a label
    chosen = known.withColumn("rank", rank).where(F.col("rank") <= docs_a_class).select("doc_id", "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            features, counts = passages([d or b"" for d in batch.column("text").cast(pa.binary()).to_pylist()])
            bags = np.split(features, np.cumsum(counts)[:-1])
            packed = [b[np.unique(np.linspace(0, len(b) - 1, passages_a_doc).astype(int))].tobytes() for b in bags]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(packed, pa.binary()), batch.column("quality")],
                ["doc_id", "bag", "quality"],
            )

    found = sorted(map_batches(rows, run, "doc_id long, bag binary, quality int").collect())
    bags = [np.frombuffer(bytes(r.bag), np.float32).reshape(-1, FEATURES) for r in found]
    return bags, np.array([r.quality for r in found], np.float64)


def train(docs: DataFrame, labels: DataFrame, **bounds: int) -> Network | None:
    """Learns from the documents given; None without labels of both kinds."""
    bags, marks = sample(docs, labels, **bounds)
    if len(set(marks.tolist())) < 2:
        return None
    network = Network()
    network.train(bags, marks)
    return network


def score(docs: DataFrame, network: Network | None, text: str = "text", to: str = "score") -> DataFrame:
    """All columns of `docs` and the score in [0, 1], over all passages of every text."""
    name = fresh(docs, to)
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in slices(batches, text, 1 << 20):
            data = [d or b"" for d in batch.column(text).cast(pa.binary()).to_pylist()]
            values = network.score(*passages(data))[0] if network else np.ones(len(data))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values.astype(np.float64))], [*batch.schema.names, name]
            )

    return map_batches(docs, run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least `threshold`."""
    name = fresh(docs, "score")
    network = train(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, network, to=name).where(F.col(name) >= threshold).drop(name)
