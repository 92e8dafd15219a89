"""Language identification by a convolutional network over bytes, trained here in numpy.

A text's UTF-8 bytes are cut into windows of fixed length, the last one padded; all windows of the text are
used. Filters of several widths run over embedded bytes, each filter's response is max-pooled over the window, and a
softmax layer gives the languages. A text's prediction is the softmax of its windows' mean scores, weighted by bytes.

Training uses a bounded sample: at most `DOCS_A_LANGUAGE` documents a language (those of the smallest hash of their
id) with `WINDOWS_A_DOC` windows each. For prediction the first layer is folded into tables: a filter's response is
a sum of look-ups by pairs of bytes.

Edge cases: null texts and texts without a letter are `und` with score 0, and so is every text if nothing could be
learned. Rows are predicted one by one: repeated rows, null ids and extra columns pass through; a new column whose
name is taken gets a leading underscore.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import fresh, map_batches, slices

WINDOW = 256
DOCS_A_LANGUAGE = 1000
WINDOWS_A_DOC = 2
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
EPOCHS = 12
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """The pattern also matches fractions and the like, which are no letters."""
    return any(found[0].isalpha() for found in LETTER.finditer(text))


class Network:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        random = np.random.default_rng(seed)
        self.languages = languages
        self.parts = {"embedding": random.normal(0, 0.5, (256, EMBEDDING))}
        for width in WIDTHS:
            self.parts[f"filter{width}"] = random.normal(0, (2 / (width * EMBEDDING)) ** 0.5, (width, EMBEDDING, FILTERS))
            self.parts[f"bias{width}"] = np.zeros(FILTERS)
        total = FILTERS * len(WIDTHS)
        self.parts["out"] = random.normal(0, total ** -0.5, (total, len(languages)))
        self.parts["out_bias"] = np.zeros(len(languages))
        self.parts = {k: v.astype(np.float32) for k, v in self.parts.items()}

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 3e-3,
              seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.parts.items()}
        second = {k: np.zeros_like(v) for k, v in self.parts.items()}
        step = 0
        for _ in range(epochs):
            order = random.permutation(len(windows))
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                step += 1
                for key, slope in self._slopes(windows[some], labels[some]).items():
                    first[key] = 0.9 * first[key] + 0.1 * slope
                    second[key] = 0.999 * second[key] + 0.001 * slope * slope
                    self.parts[key] -= rate * (first[key] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[key] / (1 - 0.999 ** step)) + 1e-8)

    def _slopes(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.parts, len(x)
        embedded = p["embedding"][x]
        pooled, where = [], {}
        for width in WIDTHS:
            places = x.shape[1] - width + 1
            response = sum(embedded[:, k:k + places] @ p[f"filter{width}"][k] for k in range(width))
            where[width] = response.argmax(1)
            pooled.append(np.take_along_axis(response, where[width][:, None], 1)[:, 0] + p[f"bias{width}"])
        before = np.concatenate(pooled, 1)
        hidden = np.maximum(before, 0)
        scores = hidden @ p["out"] + p["out_bias"]
        scores = np.exp(scores - scores.max(1, keepdims=True))
        slope = scores / scores.sum(1, keepdims=True)
        slope[np.arange(n), y] -= 1
        slope /= n
        out = {"out": hidden.T @ slope, "out_bias": slope.sum(0)}
        back = (slope @ p["out"].T) * (before > 0)
        out["embedding"] = np.zeros_like(p["embedding"])
        rows = np.arange(n)[:, None]
        for i, width in enumerate(WIDTHS):
            part = back[:, i * FILTERS:(i + 1) * FILTERS]
            out[f"bias{width}"] = part.sum(0)
            slopes = np.zeros_like(p[f"filter{width}"])
            for k in range(width):
                seen = x[rows, where[width] + k]
                slopes[k] = np.einsum("nfe,nf->ef", p["embedding"][seen], part)
                np.add.at(out["embedding"], seen, part[:, :, None] * p[f"filter{width}"][k].T[None])
            out[f"filter{width}"] = slopes
        return out

    def tables(self) -> dict:
        """Look-ups of the first layer: by a pair of bytes, and by one byte for odd widths."""
        embedding, found = self.parts["embedding"], {}
        for width in WIDTHS:
            single = [embedding @ self.parts[f"filter{width}"][k] for k in range(width)]
            pairs = [(single[k][:, None] + single[k + 1][None]).reshape(-1, FILTERS) for k in range(0, width - 1, 2)]
            found[width] = (pairs, single[-1] if width % 2 else None)
        return found


def scores(network: Network, tables: dict, windows: np.ndarray) -> np.ndarray:
    """Scores of the languages before the softmax, for rows of bytes."""
    pairs = windows[:, :-1].astype(np.uint16) << 8 | windows[:, 1:]
    pooled = []
    for width in WIDTHS:
        places = windows.shape[1] - width + 1
        by_pair, single = tables[width]
        response = by_pair[0][pairs[:, :places]]
        for k, look_up in enumerate(by_pair[1:], 1):
            response += look_up[pairs[:, 2 * k:2 * k + places]]
        if single is not None:
            response += single[windows[:, width - 1:]]
        pooled.append(response.max(1) + network.parts[f"bias{width}"])
    return np.maximum(np.concatenate(pooled, 1), 0) @ network.parts["out"] + network.parts["out_bias"]


def cut(data: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each window, bytes in each window)."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    counts = -(-sizes // length)
    padded = b"".join(d + bytes(int(c) * length - len(d)) for d, c in zip(data, counts))
    owner = np.repeat(np.arange(len(data)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return (np.frombuffer(padded, np.uint8).reshape(-1, length), owner,
            np.minimum(sizes[owner] - place * length, length))


def sample(docs: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE, windows_a_doc: int = WINDOWS_A_DOC) -> list:
    """(lang, window) of a bounded number of documents of each language."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.xxhash64("data")))
    data = F.col("text").cast("binary")
    room = F.greatest(F.octet_length(data) - F.lit(WINDOW - 1), F.lit(1))
    pieces = F.array(*(
        F.substring(data, F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(i)), room).cast("int"), F.lit(WINDOW))
        for i in range(windows_a_doc)
    ))
    narrow = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", pieces.alias("data"))
    chosen = narrow.withColumn("rank", rank).where(F.col("rank") <= docs_a_language)
    return [(row.lang, bytes(piece)) for row in chosen.collect() for piece in row.data]


def train(docs: DataFrame, **bounds: int) -> Network | None:
    """Learns from `lang` and `text` of the rows given; None if there are none."""
    rows = sorted(sample(docs, **bounds))
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    network = Network(languages)
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for i, (_, piece) in enumerate(rows):
        windows[i, :len(piece)] = np.frombuffer(piece, np.uint8)
    network.train(windows, np.array([languages.index(lang) for lang, _ in rows]))
    return network


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """All columns of `docs`, `lang_pred` and `score`."""
    lang_name, score_name = fresh(docs, "lang_pred"), fresh(docs, "score")
    schema = T.StructType([
        *docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType()),
    ])
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        tables = network.tables() if network else None
        for batch in slices(batches, text, 1 << 20):
            values = batch.column(text).to_pylist()
            wanted = [bool(network and v and has_letter(v)) for v in values]
            windows, owner, sizes = cut([v.encode() if w else b"" for v, w in zip(values, wanted)])
            names, certainty = ["und"] * len(values), [0.0] * len(values)
            if len(windows):
                total = np.zeros((len(values), len(network.languages)))
                for at in range(0, len(windows), 512):
                    part = slice(at, at + 512)
                    np.add.at(total, owner[part], scores(network, tables, windows[part]) * sizes[part, None])
                held = np.maximum(np.bincount(owner, sizes, len(values)), 1)[:, None]
                mean = total / held
                mean = np.exp(mean - mean.max(1, keepdims=True))
                mean /= mean.sum(1, keepdims=True)
                best = mean.argmax(1)
                for i in np.flatnonzero(wanted):
                    names[i], certainty[i] = network.languages[best[i]], float(mean[i, best[i]])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(certainty, pa.float64())],
                [*batch.schema.names, lang_name, score_name],
            )

    return map_batches(docs, run, schema)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
