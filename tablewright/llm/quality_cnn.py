"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into chunks of 512 window starts, 384 apart, that cover it
to the last byte.  Learned filters look at windows of 6 bytes; each filter's
largest response in a chunk goes through a hidden layer to one number per
chunk, and the mean and the least of these numbers make one probability for
the document (the least, because part of a bad document may look good).

``fit`` trains on a bounded sample of labelled rows (``PER_LABEL`` of each
label) for a fixed number of steps, so its cost does not grow with the input.
For scoring, embedding and filters are multiplied out into one table per
window place, so a window costs 6 table rows, and the responses of overlapping
chunks are computed once.

Null and empty texts are scored as one empty window.  Without usable labels
of both kinds every score is the share of label 1 (0.5 without any).  Rows are
scored one by one; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts
from .labelled import Sample, held_out, sample

BLOCK = 128
CHUNK_BLOCKS = 4
STEP_BLOCKS = 3
WIDTH = 6
FILTERS = 16
HIDDEN = 16
EMBEDDING = 8
PER_LABEL = 1500
STEPS = 500
BATCH_CHUNKS = 256


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def chunk_starts(n: int) -> np.ndarray:
    """First window starts of the chunks of a text of ``n`` bytes."""
    over = n - CHUNK_BLOCKS * BLOCK
    return np.arange(1 + max(0, -(-over // (STEP_BLOCKS * BLOCK)))) * (STEP_BLOCKS * BLOCK)


class Network:
    """Parameters, training, and scoring."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {"embed": r.normal(0, 0.5, (256, EMBEDDING)), "filters": r.normal(0, 0.2, (WIDTH, EMBEDDING, FILTERS)),
                  "bias": np.zeros(FILTERS), "w1": r.normal(0, 0.3, (FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN),
                  "w2": r.normal(0, 0.3, HIDDEN), "mix": np.array([0.5, 0.5, 0.0])}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.prior: float | None = None

    def gradients(self, data: np.ndarray, valid: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted log loss, for chunks (``data``: bytes, ``valid``: window starts inside) of the documents ``doc``."""
        p, size, n = self.p, CHUNK_BLOCKS * BLOCK, len(y)
        x = p["embed"][data]
        response = sum(x[:, k:k + size] @ p["filters"][k] for k in range(WIDTH)) + p["bias"]
        response[~valid] = -1e9
        at = response.argmax(axis=1)
        top = np.take_along_axis(response, at[:, None, :], 1)[:, 0]
        pooled = np.maximum(top, 0)
        hidden = np.maximum(pooled @ p["w1"] + p["b1"], 0)
        z = hidden @ p["w2"]
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[first, len(doc)])
        mean, least = np.add.reduceat(z, first) / count, np.minimum.reduceat(z, first)
        d = (_sigmoid(p["mix"][0] * mean + p["mix"][1] * least + p["mix"][2]) - y) * weight / n
        lowest = np.zeros(len(z))
        lowest[[f + int(np.argmin(z[f:f + c])) for f, c in zip(first, count)]] = 1
        dz = np.repeat(d * p["mix"][0] / count, count) + np.repeat(d * p["mix"][1], count) * lowest
        d_hidden = dz[:, None] * p["w2"] * (hidden > 0)
        d_top = d_hidden @ p["w1"].T * (top > 0)
        seen = data[np.arange(len(data))[:, None, None], at[:, :, None] + np.arange(WIDTH)]  # chunk, filter, place
        d_embed = np.zeros_like(p["embed"])
        np.add.at(d_embed, seen, d_top[:, :, None, None] * p["filters"].transpose(2, 0, 1)[None])
        return {"embed": d_embed, "filters": np.einsum("nf,nfke->kef", d_top, p["embed"][seen]), "bias": d_top.sum(0),
                "w1": pooled.T @ d_hidden, "b1": d_hidden.sum(0), "w2": hidden.T @ dz,
                "mix": np.array([d @ mean, d @ least, d.sum()])}

    def train(self, labelled: Sample, steps: int = STEPS, rate: float = 0.01, seed: int = 4) -> None:
        y, weight = np.array(labelled.labels, np.float32), np.array(labelled.weights, np.float32)
        if len(set(labelled.labels)) < 2:
            self.prior = float(y.mean()) if len(y) else 0.5
            return
        size, r = CHUNK_BLOCKS * BLOCK, np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        order, at = r.permutation(len(y)), 0
        for step in range(1, steps + 1):
            docs, starts = [], []
            while not docs or sum(map(len, starts)) < BATCH_CHUNKS:
                if at == len(order):
                    order, at = r.permutation(len(y)), 0
                docs.append(order[at])
                starts.append(chunk_starts(len(labelled.texts[order[at]])))
                at += 1
            data = np.zeros((sum(map(len, starts)), size + WIDTH - 1), np.uint8)
            valid = np.zeros((len(data), size), bool)
            row = 0
            for i, begins in zip(docs, starts):
                text = labelled.texts[i]
                for b in begins:
                    piece = np.frombuffer(text[b:b + size + WIDTH - 1], np.uint8)
                    data[row, :len(piece)] = piece
                    valid[row, :max(1, min(size, len(text) - b))] = True
                    row += 1
            doc = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
            for k, g in self.gradients(data, valid, doc, y[docs], weight[docs]).items():
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.01 * (g * g - v2[k])
                lr = rate * (1 - step / (steps + 1))
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 of each text."""
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        p = self.p
        tables = np.ascontiguousarray(np.einsum("be,kef->kbf", p["embed"], p["filters"]))
        chunks, counts = [], []
        for text in texts:
            data = np.frombuffer(text + bytes(WIDTH - 1 + (not text)), np.uint8)
            n = len(data) - WIDTH + 1
            tops = []
            for a in range(0, n, 64 * BLOCK):
                b = min(a + 64 * BLOCK, n)
                response = tables[0][data[a:b]]
                for k in range(1, WIDTH):
                    response += tables[k][data[a + k:b + k]]
                tops.append(np.maximum.reduceat(response, np.arange(0, b - a, BLOCK), axis=0))
            block = np.concatenate(tops)
            begins = chunk_starts(n) // BLOCK
            pooled = block[begins]
            for k in range(1, CHUNK_BLOCKS):
                pooled = np.maximum(pooled, block[np.minimum(begins + k, len(block) - 1)])
            chunks.append(pooled)
            counts.append(len(begins))
        if not chunks:
            return np.zeros(0)
        pooled = np.maximum(np.concatenate(chunks) + p["bias"], 0)
        z = np.maximum(pooled @ p["w1"] + p["b1"], 0) @ p["w2"]
        first = np.r_[0, np.cumsum(counts)[:-1]]
        mean, least = np.add.reduceat(z, first) / counts, np.minimum.reduceat(z, first)
        return _sigmoid(p["mix"][0] * mean + p["mix"][1] * least + p["mix"][2]).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, steps: int = STEPS) -> Network:
    network = Network()
    network.train(sample(docs, labels, "quality", per_label), steps)
    return network


def score(docs: DataFrame, network: Network, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.score(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return (ids_and_texts(docs).mapInArrow(run, "doc_id bigint, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
