"""Byte-level convolutional quality classifier in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters run
over byte embeddings in every chunk; each filter's largest response in a chunk, and how much of
the chunk is text, go through a small hidden layer to a chunk score. The mean chunk score gives
one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import text_or_empty

CHUNK, STEP = 256, 224
WIDTH, STRIDE = 8, 2
EMBED, FILTERS, HIDDEN = 8, 32, 16
#: Fitting uses at most this many labelled texts (smallest hash of the id first) ...
SAMPLE_DOCS = 4000
#: ... and at most this many chunks of each, spread over the whole text.
SAMPLE_CHUNKS = 8
STEPS, BATCH, RATE = 800, 64, 0.01
#: What an error on the rarer class 0 weighs against one on class 1.
LOW_WEIGHT = 1.5
CUT = 0.7
#: Chunks that a task scores at once.
SCORED = 512


def chunks(text: bytes) -> np.ndarray:
    """(n, CHUNK) bytes: overlapping chunks over the whole text, the last padded with zeros; one at least."""
    n = max(1, -(-(len(text) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return as_strided(padded, (n, CHUNK), (STEP, 1))


def with_fill(pooled: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Add the share of each chunk that is text: few bytes cannot excite many filters."""
    fill = np.count_nonzero(data, axis=1).astype(np.float32) / CHUNK
    return np.concatenate((pooled, fill[:, None]), axis=1)


@dataclass
class Network:
    """Weights; `constant` replaces them when the labels show one class or none."""

    weights: dict[str, np.ndarray]
    constant: float | None = None

    def windows(self, data: np.ndarray) -> np.ndarray:
        table = self.weights["embed"][data]
        n, size, item = len(data), (CHUNK - WIDTH) // STRIDE + 1, table.itemsize
        return as_strided(table, (n, size, WIDTH * EMBED), (table.strides[0], STRIDE * EMBED * item, item))

    def responses(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        windows = np.ascontiguousarray(self.windows(data))
        return windows, (windows.reshape(-1, WIDTH * EMBED) @ self.weights["filters"]).reshape(len(data), -1, FILTERS)

    def chunk_scores(self, data: np.ndarray) -> np.ndarray:
        w = self.weights
        pooled = with_fill(np.maximum(self.responses(data)[1].max(axis=1) + w["bias"], 0), data)
        hidden = np.maximum(pooled @ w["inner"] + w["inner_bias"], 0)
        return hidden @ w["out"] + w["out_bias"]

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """One probability per text. Chunks of many texts are scored together, whole texts however long."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        held, owners, size = [], [], 0

        def flush() -> None:
            nonlocal held, owners, size
            if held:
                scores = self.chunk_scores(np.concatenate(held))
                np.add.at(sums, np.concatenate(owners), scores)
            held, owners, size = [], [], 0

        for k, text in enumerate(texts):
            cut = chunks(text)
            counts[k] = len(cut)
            for at in range(0, len(cut), SCORED):
                part = cut[at : at + SCORED]
                held.append(part)
                owners.append(np.full(len(part), k))
                size += len(part)
                if size >= SCORED:
                    flush()
        flush()
        return 1 / (1 + np.exp(-np.clip(sums / counts, -30, 30)))


def _cut(data: np.ndarray, shortest: int, rng: np.random.Generator) -> np.ndarray:
    chunk = data[rng.integers(len(data))]
    size = int(min(rng.integers(shortest, 120), max(1, np.count_nonzero(chunk))))
    out = np.zeros((1, CHUNK), np.uint8)
    at = rng.integers(0, max(1, np.count_nonzero(chunk) - size + 1))
    out[0, :size] = chunk[at : at + size]
    return out


def fit(samples: list[tuple[np.ndarray, int]], seed: int = 7) -> Network:
    """Train on (chunks, label) pairs by Adam on the mean chunk score of each text.

    Some texts of label 1 also teach by a short cut, so that short texts are known too. Texts of
    label 0 don't: what is wrong with them may not show in a few bytes.
    """
    labels = np.array([y for _, y in samples], np.float32)
    if len(set(labels.tolist())) < 2:
        return Network({}, float(labels[0]) if len(labels) else 1.0)
    rng = np.random.default_rng(seed)
    short = [(_cut(data, 16, rng), label) for data, label in samples if label and rng.random() < 0.4]
    samples = samples + short
    labels = np.array([y for _, y in samples], np.float32)
    draw = lambda *shape: rng.normal(0, (2 / shape[0]) ** 0.5, shape).astype(np.float32)
    w = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "filters": draw(WIDTH * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32), "inner": draw(FILTERS + 1, HIDDEN), "inner_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN), "out_bias": np.zeros((), np.float32)}
    w["embed"][0] = 0
    net = Network(w)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    while step < STEPS:
        order = rng.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            if step == STEPS:
                break
            chosen = order[at : at + BATCH]
            data = np.concatenate([samples[k][0] for k in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(samples[k][0]) for k in chosen])
            share = 1 / np.bincount(owner)[owner]
            windows, found = net.responses(data)
            best = found.argmax(axis=1)
            pooled_raw = np.take_along_axis(found, best[:, None, :], 1)[:, 0] + w["bias"]
            pooled = with_fill(np.maximum(pooled_raw, 0), data)
            inner_raw = pooled @ w["inner"] + w["inner_bias"]
            inner = np.maximum(inner_raw, 0)
            score = np.bincount(owner, (inner @ w["out"] + w["out_bias"]) * share)
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[chosen]) * np.where(labels[chosen] > 0, 1, LOW_WEIGHT)
            d_chunk = (error[owner] * share / len(chosen)).astype(np.float32)
            d_inner = np.outer(d_chunk, w["out"]) * (inner_raw > 0)
            d_pooled = (d_inner @ w["inner"].T)[:, :FILTERS] * (pooled_raw > 0)
            rows = np.arange(len(data))[:, None]
            picked = windows[rows, best]
            d_embed = np.zeros_like(w["embed"])
            d_window = d_pooled[:, :, None] * w["filters"].T[None]
            where = data[rows[:, :, None], (best * STRIDE)[:, :, None] + np.arange(WIDTH)]
            np.add.at(d_embed, where.reshape(-1), d_window.reshape(-1, EMBED))
            d_embed[0] = 0
            grads = {"embed": d_embed, "filters": np.einsum("nf,nfw->wf", d_pooled, picked), "bias": d_pooled.sum(0), "inner": pooled.T @ d_inner, "inner_bias": d_inner.sum(0), "out": inner.T @ d_chunk, "out_bias": d_chunk.sum()}
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= (RATE * (1.02 - step / STEPS) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Fit on a bounded sample of the labelled rows that are not held out.

    Ids without a label, with a null or with contradicting labels teach nothing. Without labels
    every score is 1: nothing is known against a text. With one class every score is that class.
    Only the sample's chunks reach the driver: SAMPLE_DOCS x SAMPLE_CHUNKS x CHUNK bytes at most.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("low"), F.max(label_col).cast("int").alias("high"))
    sample = known.where("low = high").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS).select("id", F.col("low").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text")).join(F.broadcast(sample), "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text in batch.column(1):
                whole = chunks(text.as_py())
                parts.append(whole[np.unique(np.linspace(0, len(whole) - 1, SAMPLE_CHUNKS).astype(int))].tobytes())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(parts, pa.binary())], names=["id", "label", "chunks"])

    rows = texts.mapInArrow(cut, "id long, label int, chunks binary").collect()
    rows = sorted(((r[0], bytes(r[2]), r[1]) for r in rows))[: 2 * SAMPLE_DOCS]
    return fit([(np.frombuffer(c, np.uint8).reshape(-1, CHUNK), y) for _, c, y in rows])


def score(docs: DataFrame, network: Network, text_col: str = "text", into: str = "score") -> DataFrame:
    """`docs` with the probability of label 1 for every row's whole text, in column `into`.

    Null and empty texts are scored as one chunk of zeros. All other columns, repeated rows and
    null ids pass unchanged; a column already named `into` is replaced. Empty in, empty out.
    Only the text goes to Python and only the score comes back.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(network.probabilities([x or b"" for x in texts.to_pylist()]), pa.float64())

    probability = F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER)
    return docs.withColumn(into, probability(F.col(text_col).cast("binary")))


def op3_byte_cnn(spark, sf_dir: str) -> DataFrame:
    """Every document's quality probability and decision."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), network)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
