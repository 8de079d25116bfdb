"""Language identification by a bidirectional gated recurrent network over bytes.

The network is written and trained in numpy, by backpropagation through time and Adam. Text is read in segments of ``SEGMENT``
bytes; within a segment one recurrent layer runs forward and one backward, and every byte gets a distribution over the
languages from both states. A document's probabilities are the mean over all its bytes.

Only the sample is bounded: at most ``max_docs`` documents of each language (those with the smallest hash of
doc_id), at most ``SAMPLE_SEGMENTS`` segments of each. Every whole text is predicted. Segments of one batch of rows run side by
side, so the work follows the bytes, however they are spread over documents.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without a labelled document
all are; with one language every text with a letter is that one, score 1; null labels and null ids are not learned
from; rows that repeat are predicted alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lastleg.session import stage

SEGMENT = 128
SAMPLE_SEGMENTS = 4
HIDDEN = 8
UNKNOWN = "und"
_WIDTH = 2048  # segments run side by side
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Weights: w (2, 3H, 256) of a byte for update, reset and candidate; u (2, 3H, H) of the state; b (2, 3H); out (C, 2H), c (C)."""

    languages: list[str]
    w: np.ndarray
    u: np.ndarray
    b: np.ndarray
    out: np.ndarray
    c: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.w, self.u, self.b, self.out, self.c]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run_kept(net: Network, way: int, ids: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T, H, B) of one direction over ids (T, B), and what its gradient needs."""
    h_size = net.u.shape[2]
    h = np.zeros((h_size, ids.shape[1]))
    states, kept = np.empty((len(ids), h_size, ids.shape[1])), []
    for t in range(len(ids)) if way == 0 else range(len(ids) - 1, -1, -1):
        x = net.w[way][:, ids[t]] + net.b[way][:, None]
        g = net.u[way] @ h
        z, r = _sigmoid(x[:h_size] + g[:h_size]), _sigmoid(x[h_size: 2 * h_size] + g[h_size: 2 * h_size])
        n = np.tanh(x[2 * h_size:] + r * g[2 * h_size:])
        kept.append((t, h, z, r, n, g[2 * h_size:]))
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _backward(net: Network, way: int, ids: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dw, du, db = np.zeros_like(net.w[way]), np.zeros_like(net.u[way]), np.zeros_like(net.b[way])
    dh = np.zeros_like(d_states[0])
    for t, before, z, r, n, gn in reversed(kept):
        dh = dh + d_states[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (before - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dg = np.concatenate([dz, dr, dn * r])
        dx = np.concatenate([dz, dr, dn])
        np.add.at(dw.T, ids[t], dx.T)
        db += dx.sum(axis=1)
        du += dg @ before.T
        dh = dh * z + net.u[way].T @ dg
    return dw, du, db


def loss_and_gradient(net: Network, ids: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of ids (T, B), where ``labels`` holds the language of each segment."""
    runs = [_run_kept(net, way, ids) for way in (0, 1)]
    both = np.concatenate([runs[0][0], runs[1][0]], axis=1)  # (T, 2H, B)
    logits = np.matmul(net.out, both) + net.c[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    columns = np.arange(len(labels))
    loss = -np.log(p[:, labels, columns] + 1e-30).mean()
    d = p
    d[:, labels, columns] -= 1
    d /= ids.size
    d_out, d_c = np.einsum("tcb,thb->ch", d, both), d.sum(axis=(0, 2))
    d_both = np.matmul(net.out.T, d)
    size = net.u.shape[2]
    parts = [_backward(net, way, ids, runs[way][1], d_both[:, way * size: (way + 1) * size]) for way in (0, 1)]
    return float(loss), [np.stack([a[i] for a in parts]) for i in range(3)] + [d_out, d_c]


def train(segments: list[bytes], labels: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = 400,
          batch: int = 96, rate: float = 0.02, seed: int = 3) -> Network:
    """A network fitted to full-length segments; every language is drawn equally often."""
    rng = np.random.default_rng(seed)
    shape = (2, 3 * hidden)
    net = Network(
        languages, rng.normal(0, 0.3, (*shape, 256)), rng.normal(0, 0.3, (*shape, hidden)), np.zeros(shape),
        rng.normal(0, 0.3, (len(languages), 2 * hidden)), np.zeros(len(languages)),
    )
    table = np.frombuffer(b"".join(segments), np.uint8).reshape(len(segments), SEGMENT)
    by_language = [np.nonzero(labels == i)[0] for i in range(len(languages))]
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        drawn = rng.integers(0, len(languages), batch)
        chosen = np.array([rng.choice(by_language[i]) for i in drawn])
        at = rng.integers(0, SEGMENT // 2)  # half segments, from any place
        ids = table[chosen, at: at + SEGMENT // 2].T.astype(np.int64)
        _, gradient = loss_and_gradient(net, ids, drawn)
        norm = np.sqrt(sum((g**2).sum() for g in gradient))
        now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
        for p, g, m, v in zip(net.parameters(), gradient, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-12))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class Reader:
    """The trained network laid out for prediction in single precision; factors 1/2 of the gates are folded into the weights."""

    def __init__(self, net: Network):
        size = net.u.shape[2]
        half = np.concatenate([np.full(2 * size, 0.5), np.ones(size)])[None, :, None]
        self.w = (np.concatenate([net.w, np.zeros((2, 3 * size, 1))], axis=2) * half + net.b[:, :, None] * half).astype(np.float32)
        self.u = (net.u * half).astype(np.float32)
        self.out = np.stack([net.out[:, :size], net.out[:, size:]]).astype(np.float32)
        self.c = net.c.astype(np.float32)
        self.size = size

    def positions(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(t, probabilities (C, n)) for every position t of ids (T, B); segments by falling length, n of them reach t."""
        active = np.searchsorted(-lengths, -np.arange(1, len(ids) + 1), side="right")
        forward = [self.out[0] @ h for _, h in self._states(0, ids, active, range(len(ids)))]
        for t, h in self._states(1, ids, active, range(len(ids) - 1, -1, -1)):
            logits = self.out[1] @ h
            logits += forward[t]
            logits += self.c[:, None]
            logits -= logits.max(axis=0)
            p = np.exp(logits, out=logits)
            p /= p.sum(axis=0)
            yield t, p

    def _states(self, way: int, ids: np.ndarray, active: np.ndarray, order: range) -> Iterator[tuple[int, np.ndarray]]:
        size, w, u = self.size, self.w[way], self.u[way]
        h = np.zeros((size, ids.shape[1]), np.float32)
        for t in order:
            n = int(active[t])
            state = h[:, :n]
            x = w.take(ids[t, :n], axis=1)
            g = u @ state
            gates = x[: 2 * size]
            gates += g[: 2 * size]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new = g[2 * size:]
            new *= gates[size:]
            new += x[2 * size:]
            np.tanh(new, out=new)
            state -= new
            state *= gates[:size]
            state += new
            yield t, state

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (texts, C) over all positions; zeros for an empty text."""
        sums = np.zeros((len(texts), len(self.c)))
        pieces = [(i, text[at: at + SEGMENT]) for i, text in enumerate(texts) for at in range(0, len(text), SEGMENT)]
        pieces.sort(key=lambda p: -len(p[1]))
        for lo in range(0, len(pieces), _WIDTH):
            part = pieces[lo: lo + _WIDTH]
            lengths = np.array([len(p) for _, p in part])
            padded = b"".join(p.ljust(int(lengths[0]), b"\0") for _, p in part)
            ids = np.ascontiguousarray(np.frombuffer(padded, np.uint8).reshape(len(part), -1).T)
            total = np.zeros((len(self.c), len(part)), np.float32)
            for _, p in self.positions(ids, lengths):
                total[:, : p.shape[1]] += p
            np.add.at(sums, [i for i, _ in part], total.T.astype(float))
        size = np.array([[max(len(t), 1)] for t in texts])
        return sums / size if len(texts) else sums


def label_spans(reader: Reader, languages: list[str], text: str) -> list[tuple[int, int, str]]:
    """Runs of bytes with the same label: (start, end, language)."""
    data = text.encode()
    labels = np.zeros(len(data), int)
    for at in range(0, len(data), SEGMENT):
        ids = np.frombuffer(data[at: at + SEGMENT], np.uint8)[:, None]
        for t, p in reader.positions(ids, np.array([len(ids)])):
            labels[at + t] = int(p[:, 0].argmax())
    edges = [0, *(np.nonzero(np.diff(labels))[0] + 1).tolist(), len(data)]
    return [(a, b, languages[labels[a]]) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def fit(docs: DataFrame, learn: Column, max_docs: int = 300, steps: int = 400) -> Network | None:
    """A network for the languages of the documents that meet ``learn``; None if there are none."""
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).distinct()
    chosen = chosen.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max_docs).select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    chosen = stage(chosen, "sample_ids")  # max_docs for each language, hence small enough to broadcast
    texts = known.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("label"))).select("id", "label", F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, label, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                data = text.encode()
                if not _LETTER.search(text):
                    continue
                places = max(1, len(data) // SEGMENT)
                for place in sorted({j * places // SAMPLE_SEGMENTS for j in range(SAMPLE_SEGMENTS)}):
                    part = data[place * SEGMENT: (place + 1) * SEGMENT]
                    rows.append((i, label, (part * SEGMENT)[:SEGMENT] if len(part) < SEGMENT else part))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())],
                ["id", "label", "part"],
            )

    rows = texts.mapInArrow(cut, "id long, label string, part binary").orderBy("label", "id", "part").collect()
    languages = sorted({r["label"] for r in rows})
    if not languages:
        return None
    labels = np.array([languages.index(r["label"]) for r in rows])
    return train([bytes(r["part"]) for r in rows], labels, languages, steps=steps if len(languages) > 1 else 0)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score, probabilities) of every row."""
    languages = net.languages if net else []
    reader = docs.sparkSession.sparkContext.broadcast(Reader(net) if net else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = part.column(1).to_pylist()
                read = [t.encode() if t and languages and _LETTER.search(t) else b"" for t in texts]
                pooled = reader.value.pooled(read) if languages else np.zeros((len(texts), 0))
                best = [int(p.argmax()) if r else -1 for r, p in zip(read, pooled, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([languages[b] if b >= 0 else UNKNOWN for b in best], pa.string()),
                    pa.array([min(1.0, float(p[b])) if b >= 0 else 0.0 for b, p in zip(best, pooled, strict=True)], pa.float64()),
                    pa.array(list(pooled), pa.list_(pa.float64())),
                ], ["doc_id", "lang_pred", "score", "probabilities"])

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    return docs.select(*columns).mapInArrow(run, "doc_id long, lang_pred string, score double, probabilities array<double>")
