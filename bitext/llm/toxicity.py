"""Toxicity: a subsequence string-kernel SVM with Nystroem landmarks.

Kernel of two words: all subsequences of three characters (the word's ends
count as characters) whose span is at most five, each occurrence weighted by
``DECAY`` per skipped character; the normalised product is raised to ``POWER``.
Characters inserted into an insult or left out of it therefore cost some
similarity, not all of it.  Marks inside a word are taken off first, and runs
of single characters (``i d i o t``) are also read as one word.

A sentence's features are, for each landmark word, the largest kernel value of
its words, mapped by the inverse root of the landmarks' kernel matrix.  A
linear SVM (squared hinge, Newton steps) is trained on sentences of labelled
documents; in a toxic document the sentences that the last model holds for the
toxic ones stay, the rest is dropped and the model is trained again.  The score
of a document is its highest sentence's, made a probability by a logistic fit.

Landmarks are words typical of toxic training documents; those that no other
training document has also train the SVM in every form with one letter inserted
or left out.  Training takes at most ``LABELLED`` documents and of each the at most
``SENTENCES`` sentences that are most like a landmark, so the driver gets at most
``LABELLED * SENTENCES`` rows of ``LANDMARKS`` numbers, 37 MB; scoring takes every
whole text.

Edge cases: null counts as empty; texts without words score like a sentence
without any similarity; without labelled rows of both kinds every score is 0;
repeated rows stay; further columns pass through, one named like the score is replaced."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext.llm.common import parts, replacing
from bitext.llm.labelled import training_rows

LABELLED = 6000
SENTENCES = 16  # of a labelled document that the SVM is trained on
LANDMARKS = 96
CANDIDATES = 600
DECAY = 0.6
POWER = 3
FORM_WEIGHT = 2.0
SURE = 5  # toxic documents that a word without others must be in
FLOOR = 0.03  # kernel values below count as none
TOXIC_SCORE = 0.3
_LONG = 48  # a longer word is read in pieces that overlap by half
_CACHE = 150_000  # words known; as many older ones are kept beside them
_CHUNK = 5_000

#: Offsets of the second and third character and the weight of a subsequence.
_STEPS = [(a, b, DECAY ** (b - 2)) for b in (2, 3, 4) for a in range(1, b)]

_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_MARKS = re.compile(r"[\W_]+")


def words_of(sentence: str) -> list[str]:
    """Lower-case words without marks; a run of three or more single characters
    gives one more word."""
    cleaned = [c if c.isalnum() else _MARKS.sub("", c) for c in sentence.lower().split()]
    if 1 not in map(len, cleaned):
        return [w for w in cleaned if len(w) > 2]
    out, run = [], []
    for word in cleaned:
        if len(word) == 1:
            run.append(word)
            continue
        if len(run) > 2:
            out.append("".join(run))
        run = []
        if len(word) > 2:
            out.append(word)
    if len(run) > 2:
        out.append("".join(run))
    return out


def sentences_of(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def _pieces(word: str) -> list[str]:
    if len(word) <= _LONG:
        return [word]
    return [word[i : i + _LONG] for i in range(0, len(word) - _LONG // 2, _LONG // 2)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence code, weight), sums over equal ones of a word."""
    flat = "".join(f"\x02{w}\x03\0\0\0\0" for w in words)
    chars = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.cumsum(chars == 2) - 1
    owners, codes, weights = [], [], []
    n = len(chars)
    for a, b, weight in _STEPS:
        first, second, third = chars[: n - b], chars[a : n - b + a], chars[b:]
        ok = np.flatnonzero((first > 0) & (second > 0) & (third > 0) & (owner[: n - b] == owner[b:]))
        codes.append((first[ok] << 42) | (second[ok] << 21) | third[ok])
        owners.append(owner[: n - b][ok])
        weights.append(np.full(len(ok), weight))
    who, code, weight = map(np.concatenate, (owners, codes, weights))
    if not len(who):
        return who, code, weight
    order = np.lexsort((code, who))
    who, code, weight = who[order], code[order], weight[order]
    new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (code[1:] != code[:-1])]))
    return who[new], code[new], np.add.reduceat(weight, new)


class Landmarks:
    """Kernel values of words against fixed landmark words."""

    def __init__(self, words: list[str]):
        self.words = words
        who, code, weight = subsequences(words)
        norm = np.sqrt(np.bincount(who, weight**2, minlength=len(words)))
        # per code the landmarks that have it, and their weights: a code is in few of them
        order = np.argsort(code, kind="stable")
        self.codes, first = np.unique(code[order], return_index=True)
        self.first = np.append(first, len(order))
        self.marks, self.weights = who[order], (weight / norm[who])[order]
        gram = self.kernel(words)
        values, vectors = np.linalg.eigh(gram + 1e-3 * np.eye(len(words)))
        self.root = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T
        #: what a word is like: the number of its row in ``rows``, or -1; older words apart
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.rows = np.zeros((0, len(words)), np.float32)
        self.n_rows = 0

    def kernel(self, words: list[str]) -> np.ndarray:
        n = len(self.words)
        out = np.zeros((len(words), n))
        if not len(self.codes):
            return out
        for i in range(0, len(words), _CHUNK):
            part = words[i : i + _CHUNK]
            who, code, weight = subsequences(part)
            norm = np.sqrt(np.bincount(who, weight**2, minlength=len(part)))
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = np.flatnonzero(self.codes[at] == code)
            if not len(hit):
                continue
            some = at[hit]
            sizes = self.first[some + 1] - self.first[some]
            each = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[some], sizes)
            value = self.weights[each] * np.repeat(weight[hit] / norm[who[hit]], sizes)
            place = np.repeat(who[hit], sizes) * n + self.marks[each]
            sums = np.bincount(place, value, minlength=len(part) * n)
            out[i : i + len(part)] = np.minimum(sums.reshape(-1, n), 1) ** POWER
        return out

    def learn(self, words: set[str]) -> None:
        """Know all of ``words``; words that no text had for long are dropped."""
        if len(self.known) > _CACHE:
            self.older, self.known = self.known, {}
            kept = [w for w, row in self.older.items() if row >= 0]
            self.rows = self.rows[[self.older[w] for w in kept]]
            self.older.update(zip(kept, range(len(kept))))
            self.n_rows = len(kept)
        new = []
        for w in words - self.known.keys():
            row = self.older.get(w)
            if row is None:
                new.append(w)
            else:
                self.known[w] = row
        self.known.update(dict.fromkeys(new, -1))
        pieces, of = [], []
        for w in new:
            mine = _pieces(w)
            pieces += mine
            of += [w] * len(mine)
        for i in range(0, len(pieces), _CHUNK):
            values = self.kernel(pieces[i : i + _CHUNK]).astype(np.float32)
            for j in np.flatnonzero(values.max(axis=1, initial=0) >= FLOOR).tolist():
                row = self.known[of[i + j]]
                if row >= 0:  # another piece of the word
                    self.rows[row] = np.maximum(self.rows[row], values[j])
                    continue
                if self.n_rows == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros((max(1024, self.n_rows), len(self.words)), np.float32)])
                self.rows[self.n_rows] = values[j]
                self.known[of[i + j]] = self.n_rows
                self.n_rows += 1

    def sentences(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the features of its sentences with any similarity."""
        cut = [[words_of(s) for s in sentences_of(t)] for t in texts]
        self.learn({w for sentences in cut for words in sentences for w in words})
        find, rows, starts, sizes = self.known.__getitem__, [], [], []
        for sentences in cut:
            n = len(starts)
            for words in sentences:
                near = [r for r in map(find, words) if r >= 0]
                if near:
                    starts.append(len(rows))
                    rows += near
            sizes.append(len(starts) - n)
        if not starts:
            return [np.zeros((0, len(self.words)), np.float32) for _ in texts]
        all_rows = np.maximum.reduceat(self.rows[rows], starts, axis=0)
        return np.split(all_rows, np.cumsum(sizes)[:-1])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Weights and bias of an L2-regularised squared-hinge SVM by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        inside = np.flatnonzero(y * (x @ w) < 1)
        left, right = ridge.copy(), np.zeros(len(w))
        for i in range(0, len(inside), _CHUNK):  # sums in doubles, a slice of rows at a time
            some = inside[i : i + _CHUNK]
            xi = x[some].astype(float)
            scaled = (xi * (c * weight[some])[:, None]).T
            left += scaled @ xi
            right += scaled @ y[some]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    x = np.stack([f, np.ones_like(f)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-3 * np.array([a, b]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def altered(word: str) -> list[str]:
    """The word with one letter inserted or left out, its ends as they are."""
    more = [word[:i] + c + word[i:] for i in range(1, len(word)) for c in "xeo"]
    return more + ([word[:i] + word[i + 1 :] for i in range(1, len(word) - 1)] if len(word) > 5 else [])


class Model:
    def __init__(
        self, marks: Landmarks, docs: list[np.ndarray], toxic: np.ndarray, sure: list[str] = (), rounds: int = 4
    ):
        forms = [a for w in sure for a in altered(w)]
        extra = marks.kernel(forms) @ marks.root if forms else np.zeros((0, len(marks.words)))
        self.marks = marks
        x = (np.concatenate(docs) @ marks.root.astype(np.float32)).astype(np.float32)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        toxic_row = toxic[doc] > 0
        use = np.ones(len(x), bool)
        for _ in range(rounds):
            y = np.where(toxic_row, 1.0, -1.0)[use]
            # as much weight on the toxic sentences as on the others, and a row for "no similarity"
            weight = np.where(y > 0, max(1.0, (y < 0).sum() / max(1, (y > 0).sum())) ** 0.5, 1.0)
            rows = np.concatenate([x[use], extra.astype(np.float32), np.zeros((1, x.shape[1]), np.float32)])
            y = np.concatenate([y, np.ones(len(extra)), [-1.0]])
            self.w = _svm(rows, y, np.concatenate([weight, np.full(len(extra), FORM_WEIGHT), [10.0]]))
            f = x @ self.w[:-1] + self.w[-1]
            top = np.full(len(docs), -np.inf)
            np.maximum.at(top, doc, f)
            use = ~toxic_row | (f >= np.minimum(top[doc], 0.5) - 1e-9) & (f > self.w[-1])
        self.a, self.b = 1.0, 0.0
        self.a, self.b = _logistic(np.maximum(np.where(np.isfinite(top), top, self.w[-1]), self.w[-1]), toxic.astype(float))

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for i in range(0, len(texts), 256):
            for j, rows in enumerate(self.marks.sentences(texts[i : i + 256])):
                f = self.w[-1]
                if len(rows):
                    f = max(f, float((rows @ self.marks.root @ self.w[:-1]).max()) + self.w[-1])
                out[i + j] = 1 / (1 + np.exp(-np.clip(self.a * f + self.b, -30, 30)))
        return out


def pick_landmarks(counts: list[tuple[str, int, int]], bound: int = LANDMARKS) -> list[str]:
    """(word, toxic documents, other documents) -> the most typical words, none
    of which is nearly another."""
    if not counts:
        return []
    marks = Landmarks([w for w, _, _ in counts])
    near = marks.kernel(marks.words)
    taken: list[int] = []
    for i in range(len(counts)):
        if len(taken) < bound and (not taken or near[i, taken].max() < 0.6):
            taken.append(i)
    return [counts[i][0] for i in taken]


def hardest(rows: np.ndarray, bound: int | None = None) -> np.ndarray:
    """At most ``SENTENCES`` of a document's sentences, those with the largest similarity to
    a landmark, in their order."""
    bound = SENTENCES if bound is None else bound
    if len(rows) <= bound:
        return rows
    return rows[np.sort(np.argsort(-rows.max(axis=1), kind="stable")[:bound])]


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model | None:
    sample = training_rows(docs, labels, "toxic", bound)

    def cut(batches):
        for b in parts(batches):
            words = [sorted({w for s in sentences_of(t or "") for w in words_of(s) if len(w) <= _LONG}) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(words, pa.list_(pa.string()))], names=["label", "words"])

    per_doc = sample.select("doc_id", "text", "label").mapInArrow(cut, "label int, words array<string>")
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    share = sizes[1] / sizes[0]
    counted = (
        per_doc.select("label", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other"))
        .filter("toxic >= 2")
    )
    typical = F.col("toxic") / (F.col("other") * share + 1.0)
    best = counted.orderBy(typical.desc(), "word").limit(CANDIDATES).collect()
    marks = Landmarks(pick_landmarks([(r.word, r.toxic, r.other) for r in best]))
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def features(batches):
        for b in parts(batches):
            rows = [hardest(r) for r in shared.value.sentences([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "rows"]
            )

    got = sample.select("doc_id", "text", "label").mapInArrow(features, "doc_id long, label int, rows binary").collect()
    got.sort(key=lambda r: r.doc_id)
    rows = [np.frombuffer(r.rows, "<f4").reshape(-1, len(marks.words)) for r in got]
    sure = {r.word for r in best if r.other == 0 and r.toxic >= SURE}
    return Model(marks, rows, np.array([r.label for r in got]), [w for w in marks.words if w in sure])


def with_score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    docs = replacing(docs, text_col, out)
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in parts(batches):
            scores = shared.value.scores([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
