"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text's terms are its words (hashed), the shapes of its words (case, length,
the marks around them) and how often a word repeats the one before.  Term
frequencies, damped and weighted by inverse document frequency, are projected
by a truncated SVD of a bounded labelled sample.  The sample's vectors (at most
``LABELLED`` x ``DIM`` floats, about a MB) and the projection are broadcast; for
every document the exact cosines with all of them are computed, a block of
documents at a time, and the labels of the ``NEIGHBOURS`` nearest vote with
their similarity as weight.

Edge cases: null counts as empty; a text without terms, or without a neighbour
of positive similarity, gets the sample's mean label; without labelled rows
every score is 0.5; of equally near neighbours the first in hash order of ids
votes; repeated rows stay; further columns pass through."""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext.llm.common import fresh, parts, replacing
from bitext.llm.labelled import training_rows

LABELLED = 4096
DIM = 48
NEIGHBOURS = 25
WORD_BUCKETS = 2048
SHAPE_BUCKETS = 2048
_TERMS = WORD_BUCKETS + SHAPE_BUCKETS + 16
_WORD_WEIGHT = 0.15
_BLOCK = 256
_CACHE = 100_000
PASS_SCORE = 0.7


def _shape(word: str) -> str:
    """Case and length class of the letters, and the marks at both ends."""
    core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    head, tail = word[: word.find(core)] if core else word, word[word.find(core) + len(core) :] if core else ""
    case = "-" if not core else "9" if core.isdigit() else "U" if core.isupper() and len(core) > 1 else (
        "T" if core[0].isupper() else "l")
    inner = "" if core.isalnum() or not core else "~"
    return f"{head[:4]} {case}{inner}{min(len(core) // 8, 4)} {tail[:4]}"


_SEEN: dict[str, tuple[int, int]] = {}  # of the worker


def _terms_of(word: str) -> tuple[int, int]:
    found = _SEEN.get(word)
    if found is None:
        if len(_SEEN) > _CACHE:
            _SEEN.clear()
        found = _SEEN[word] = (
            zlib.crc32(word.lower().encode()) % WORD_BUCKETS,
            WORD_BUCKETS + zlib.crc32(_shape(word).encode()) % SHAPE_BUCKETS,
        )
    return found


def term_weights(text: str) -> np.ndarray:
    """Dense damped term frequencies of a text."""
    out = np.zeros(_TERMS, np.float32)
    words = text.split()
    n = len(words)
    if not n:
        return out
    for word, count in Counter(words).items():
        a, b = _terms_of(word)
        out[a] += count
        out[b] += count
    same = sum(map(eq, words, words[1:]))
    out[WORD_BUCKETS + SHAPE_BUCKETS + min(15, int(16 * same / n))] = n
    out = np.sqrt(out / n)
    out[:WORD_BUCKETS] *= _WORD_WEIGHT
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


class Model:
    """Projection, labelled vectors, labels and their mean."""

    def __init__(self, weights: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.mean = float(labels.mean()) if len(labels) else 0.5
        df = (weights > 0).sum(axis=0)
        self.idf = np.log((1 + len(weights)) / (1 + df)).astype(np.float32) + 1
        x = _unit(weights * self.idf)
        rng = np.random.default_rng(7)
        dim = max(1, min(DIM, len(x)))
        basis = rng.standard_normal((x.shape[1], dim + 16)).astype(np.float32)
        for _ in range(3):  # randomized range finder
            basis = x.T @ np.linalg.qr(x @ basis)[0] if len(x) else basis
        q = np.linalg.qr(x @ basis)[0]
        right = np.linalg.svd(q.T @ x, full_matrices=False)[2][:dim] if len(x) else np.zeros((dim, _TERMS))
        self.project = np.ascontiguousarray(right.T * self.idf[:, None]).astype(np.float32)
        self.near = _unit(weights @ self.project).astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.mean)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), _BLOCK):
            w = np.stack([term_weights(t) for t in texts[i : i + _BLOCK]])
            cos = _unit(w @ self.project) @ self.near.T
            top = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.tile(np.arange(k), (len(cos), 1))
            sim = np.maximum(np.take_along_axis(cos, top, 1), 0).astype(np.float64) ** 4
            total = sim.sum(axis=1)
            vote = (sim * self.labels[top]).sum(axis=1)
            out[i : i + len(w)] = np.where(total > 0, vote / np.where(total > 0, total, 1), self.mean)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = LABELLED) -> Model:
    """Terms are counted where the texts are; the driver gets at most ``bound`` sparse rows."""

    def run(batches):
        for b in parts(batches, 100):
            rows = [term_weights(t or "") for t in b.column(1).to_pylist()]
            at = [np.flatnonzero(r).astype("<i4") for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([i.tobytes() for i in at], pa.binary()),
                 pa.array([r[i].tobytes() for r, i in zip(rows, at)], pa.binary())],
                names=["doc_id", "label", "at", "w"],
            )

    sample = training_rows(docs, labels, label, bound).select("doc_id", "text", "label")
    got = sample.mapInArrow(run, "doc_id long, label int, at binary, w binary").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    weights = np.zeros((len(got), _TERMS), np.float32)
    for row, r in zip(weights, got):
        row[np.frombuffer(r.at, "<i4")] = np.frombuffer(r.w, "<f4")
    return Model(weights, np.array([r.label for r in got], np.float32))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` and a score; a column of that name is replaced."""
    docs = replacing(docs, text_col, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in parts(batches):
            scores = shared.value.scores([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], names=[*b.schema.names, out])
        _SEEN.clear()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``PASS_SCORE``."""
    score = fresh(docs, "score")
    return with_score(docs, fit(docs, labels), text_col, score).filter(F.col(score) >= PASS_SCORE).drop(score)
