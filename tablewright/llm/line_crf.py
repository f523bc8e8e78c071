"""Quality classifier: a linear-chain conditional random field over lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import or_empty, table
from .language_id import held_out

#: Bound of the fit: labelled documents of each label, read whole. Scoring reads every line of every document.
FIT_DOCS = 1500
FIT_STEPS = 150
#: Most of a bad document's length that may be taken for good lines when its lines get labels of their own.
GOOD_SHARE = 0.4

_KIND = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 white space, 5 symbol, 6 beyond ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[9, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in "#*$%&|<>!@^~_{}[]\\="]] = 5
OWN = 9
WIDTH = 3 * OWN + 2


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines of a text, at least one. A line has its own features, those of the lines before
    and after, and whether there are such lines."""
    raw = text.encode("utf-8", "replace")
    lines = raw.split(b"\n")
    n = len(lines)
    length = np.fromiter(map(len, lines), np.int64, n)
    start = np.cumsum(length + 1) - length - 1
    kinds = _KIND[np.frombuffer(raw + b"\n", np.uint8)]
    kinds[start + length] = 7
    count = np.bincount(np.repeat(np.arange(n), length + 1) * 8 + kinds, minlength=8 * n).reshape(n, 8)
    words = [x.split() for x in lines]
    n_words = np.fromiter(map(len, words), np.float64, n)
    distinct = np.fromiter((len(set(w)) for w in words), np.float64, n)
    size = length + 1.0
    own = np.empty((n, OWN), np.float64)
    own[:, 0] = np.log1p(length)
    own[:, 1] = count[:, 5] / size
    own[:, 2] = count[:, 1] / size
    own[:, 3] = count[:, 3] / size
    own[:, 4] = (count[:, 2] + count[:, 6]) / size
    own[:, 5] = np.log((size + 10) / (n_words + 2))
    own[:, 6] = (distinct + 1) / (n_words + 1)
    own[:, 7] = np.log1p(n_words)
    own[:, 8] = (length == 0) | (n_words < 3)
    out = np.zeros((n, WIDTH), np.float64)
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[0, 3 * OWN] = out[-1, 3 * OWN + 1] = 1
    return out, length


class LineCRF:
    """Two labels, bad 0 and good 1. weights give a line's log-odds of good; change is the log-potential of two neighbours
    that differ."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, change: float):
        self.centre, self.scale, self.weights, self.bias, self.change = centre, scale, weights, bias, change

    def odds(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.centre) / self.scale) @ self.weights + self.bias

    def marginals(self, odds: np.ndarray) -> np.ndarray:
        """Forward-backward: each line's probability of good given the whole document. The messages are log-odds."""
        n = len(odds)
        e = np.clip(odds, -30, 30).tolist()
        ahead, back = [0.0] * n, [0.0] * n
        t = np.exp(self.change)
        for k in range(1, n):
            r = np.exp(min(30.0, max(-30.0, ahead[k - 1] + e[k - 1])))
            ahead[k] = float(np.log((r + t) / (r * t + 1)))
        for k in range(n - 2, -1, -1):
            r = np.exp(min(30.0, max(-30.0, back[k + 1] + e[k + 1])))
            back[k] = float(np.log((r + t) / (r * t + 1)))
        return 1 / (1 + np.exp(-(np.array(e) + ahead + back)))

    def score(self, text: str | None) -> float:
        """Mean marginal of the document's lines, weighed by length; an empty line weighs as one character."""
        features, length = line_features(text or "")
        return float(np.average(self.marginals(self.odds(features)), weights=length + 1))

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], steps: int = FIT_STEPS) -> LineCRF:
        """Maximum likelihood with a small L2 penalty, by Adam on all lines of the sample. A document's label says what most of it is, so the lines' labels
        are latent: at first they all carry the document's, and lines are fitted without the chain; then those of a bad document that look good by
        themselves, up to GOOD_SHARE of its length, the best first, are labelled good, and the chain is fitted on labels that change along a
        document. Documents of like length are padded together. Without both labels the score is constant."""
        if len(set(labels)) < 2:
            return cls(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 4.0 if sum(labels) or not labels else -4.0, 0.0)
        read = [line_features(t) for t in texts]
        flat = np.concatenate([f for f, _ in read])
        centre, scale, total = flat.mean(0), flat.std(0) + 1e-3, len(flat)
        by_size: dict[int, list[int]] = {}
        for i, (f, _) in enumerate(read):
            by_size.setdefault(len(f).bit_length(), []).append(i)
        padded, sizes = [], []
        for some in by_size.values():
            longest = max(len(read[i][0]) for i in some)
            x, there, size = np.zeros((len(some), longest, WIDTH), np.float32), np.zeros((len(some), longest), np.float32), np.zeros((len(some), longest))
            for k, i in enumerate(some):
                n = len(read[i][0])
                x[k, :n], there[k, :n], size[k, :n] = (read[i][0] - centre) / scale, 1, read[i][1] + 1
            padded.append((x, there, np.repeat(np.array([labels[i] for i in some], np.float32)[:, None], longest, 1)))
            sizes.append(size)
        p = cls._climb(padded, np.zeros(WIDTH + 2), total, steps, chain=False)
        padded = [(x, there, cls._own_labels((x @ p[:WIDTH].astype(np.float32) + p[WIDTH]) * there, there, y, size)) for (x, there, y), size in zip(padded, sizes, strict=True)]
        p = cls._climb(padded, p, total, steps)
        return cls(centre, scale, p[:WIDTH].copy(), float(p[WIDTH]), float(min(0.0, p[-1])))

    @classmethod
    def _climb(cls, padded: list[tuple[np.ndarray, np.ndarray, np.ndarray]], p: np.ndarray, total: int, steps: int, chain: bool = True) -> np.ndarray:
        """Adam's steps from p on sequences (features, which lines are there, the lines' labels); without the chain neighbours don't matter."""
        m, v = np.zeros(WIDTH + 2), np.zeros(WIDTH + 2)
        seen = sum(float((np.abs(y[:, 1:] - y[:, :-1]) * there[:, 1:]).sum()) for _, there, y in padded)
        for k in range(1, steps + 1):
            grad = np.zeros(WIDTH + 2)
            for x, there, y in padded:
                odds = (x @ p[:WIDTH].astype(np.float32) + p[WIDTH]) * there
                good, differ = cls._expect(odds, there, p[-1]) if chain else (1 / (1 + np.exp(-np.clip(odds, -30, 30))), 0.0)
                rest = (good - y) * there
                grad += np.concatenate([np.tensordot(rest, x, 2), [rest.sum(), differ]])
            grad[-1] -= seen if chain else 0
            grad = grad / total + 1e-4 * p
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            p = p - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return p

    @staticmethod
    def _own_labels(odds: np.ndarray, there: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Lines' labels: of a bad document, good for lines of positive log-odds, the greatest first, while they make up GOOD_SHARE of it at most."""
        order = np.argsort(-np.where(there > 0, odds, -np.inf), axis=1, kind="stable")
        taken = np.cumsum(np.take_along_axis(size, order, 1), axis=1) <= GOOD_SHARE * size.sum(1, keepdims=True)
        good = taken & (np.take_along_axis(odds, order, 1) > 0) & (np.take_along_axis(there, order, 1) > 0)
        out = y.copy()
        np.put_along_axis(out, order, np.maximum(np.take_along_axis(y, order, 1), good), 1)
        return out

    @staticmethod
    def _expect(odds: np.ndarray, there: np.ndarray, change: float) -> tuple[np.ndarray, float]:
        """Marginals of good, and the expected number of neighbours that differ, over padded sequences."""
        n, longest = odds.shape
        ahead, back, t = np.zeros_like(odds), np.zeros_like(odds), np.exp(change)
        for k in range(1, longest):
            r = np.exp(np.clip(ahead[:, k - 1] + odds[:, k - 1], -30, 30))
            ahead[:, k] = np.log((r + t) / (r * t + 1))
        for k in range(longest - 2, -1, -1):
            r = np.exp(np.clip(back[:, k + 1] + odds[:, k + 1], -30, 30))
            back[:, k] = np.log((r + t) / (r * t + 1)) * there[:, k + 1]
        left, right = np.clip(ahead + odds, -30, 30)[:, :-1], np.clip(back + odds, -30, 30)[:, 1:]
        a, b = np.exp(left), np.exp(right)
        differ = (t * (a + b) / (a * b + 1 + t * (a + b)) * there[:, 1:]).sum()
        return 1 / (1 + np.exp(-(ahead + odds + back))), float(differ)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS) -> LineCRF:
    """Fits on the fit_docs labelled ids of each label whose hashes are least, one text of each: where rows repeat an id, the least
    of theirs. Labels other than 0 and 1 and null ids are passed over; null texts are empty. Only those texts move: their ids, a
    bounded list, are broadcast to the scan. Of empty tables, or without both labels, comes a model of constant score."""
    marks = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    some = None
    for y in (0, 1):
        part = marks.filter(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(fit_docs)
        some = part if some is None else some.unionAll(part)
    rows = docs.select(F.col(id_col).alias("_id"), or_empty(F.col(text_col).cast("string")).alias("_text")).join(F.broadcast(some), "_id")
    rows = rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()
    rows.sort(key=lambda r: (r["_id"], r["_label"]))
    return LineCRF.fit([r["_text"] for r in rows], [r["_label"] for r in rows])


def score_quality(docs: DataFrame, model: LineCRF, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs' columns and `into` (in place of a column of that name), the document's quality from 0 to 1.

    Row by row, so repeated rows get the same and an empty table stays empty; only the text goes to Python. Null is the empty text,
    one empty line. A text of any length is read whole, in memory proportional to it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def infer(texts: pa.Array) -> pa.Array:
        return pa.array([min(1.0, max(0.0, shared.value.score(t.as_py()))) for t in texts], pa.float64())

    return docs.withColumn(into, F.arrow_udf(infer, "double").asNondeterministic()(F.col(text_col).cast("string")))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = labels.filter(~held_out("doc_id", 3, 1))
    model = fit_quality(docs.filter(~held_out("doc_id", 3, 1)), learned)
    scored = score_quality(docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text"), model).select("doc_id", "held_out", "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
