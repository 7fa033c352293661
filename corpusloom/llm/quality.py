"""Quality classifier: a linear-chain conditional random field labels every line of a text good or bad.

A line's features are rates of pairs of character classes and measures of its words; the lines before and after it count
with weights of their own. In training, every line of a labelled document has the document's label, and each document
counts alike. A document's score is the mean of its lines' forward-backward marginals of "good", weighted by length.

The model is fitted on at most about `LEARN` labelled documents, picked by the hashes of their ids; each gradient is a Spark
job over them that returns one sum a partition. Scoring goes over all whole texts.

Results for odd input: a null text counts as an empty one, which is one empty line; lines are what line feeds part, empty
ones too, and weigh one byte more than they hold; very long texts are read some lines at a time; without any labels the
score is 0.5, with labels of one kind their value; labels without a value are left out, of several labels of an
id the least counts, and ids repeated in the documents each count; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remainder

#: Documents that the model learns from, about, and partitions that they are dealt to.
LEARN = 4096
LEARN_PARTS = 8
#: Weight of the penalty, gradients at most, and the relative gain at which learning ends.
PENALTY = 1e-3
TURNS = 40
LEAST_GAIN = 1e-4
THRESHOLD = 0.3
#: Bytes of a text, of whole lines, whose features are worked out at a time.
PIECE = 1 << 18

#: Classes of bytes: lower, upper, digit, blank, stops, exclamation, quotes and brackets, other signs, beyond ASCII, control.
GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".,;:?'-", b"!", b"\"()[]{}", b"#$%&*+/<=>@\\^_`|~", bytes(range(128, 256)))
KINDS = len(GROUPS) + 1
WORD_FEATURES = 6
SIZE = KINDS * KINDS + WORD_FEATURES


def kinds() -> np.ndarray:
    out = np.full(256, KINDS - 1, np.int64)
    for k, group in enumerate(GROUPS):
        out[list(group)] = k
    return out


def pieces(raw: bytes) -> Iterator[bytes]:
    """A text in stretches of whole lines."""
    at = 0
    while True:
        end = raw.find(b"\n", at + PIECE) if len(raw) - at > PIECE else -1
        yield raw[at:] if end < 0 else raw[at:end]
        if end < 0:
            return
        at = end + 1


def features(raw: bytes, kind: np.ndarray, seen: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of features, the weight) of each line; seen: hashes of the text's lines so far."""
    lines = raw.split(b"\n")
    sizes = np.array([len(x) for x in lines], np.int64) + 1
    counts = np.zeros(len(lines) * KINDS * KINDS)
    ends = np.cumsum(sizes)
    whole = raw + b"\n"
    for at in range(0, len(whole) - 1, PIECE):
        part = np.frombuffer(whole, np.uint8, min(PIECE + 1, len(whole) - at), at)
        code, within = kind[part], np.flatnonzero(part[:-1] != 10)  # pairs within lines, each with its end
        line = np.searchsorted(ends, within + at, side="right")
        first = int(line[0]) if len(line) else 0
        found = np.bincount((line - first) * KINDS * KINDS + code[within] * KINDS + code[within + 1])
        counts[first * KINDS * KINDS : first * KINDS * KINDS + len(found)] += found
    out = np.empty((len(lines), SIZE))
    out[:, : KINDS * KINDS] = np.sqrt(counts.reshape(len(lines), -1) / sizes[:, None])
    for i, x in enumerate(lines):
        words = x.lower().split()
        n = len(words)
        h = hash(x)
        again = float(n > 0 and h in seen)
        seen.add(h)
        out[i, KINDS * KINDS :] = (
            math.log(len(x) + 1), math.log(n + 1), len(x) / (n + 1), len(set(words)) / n if n else 1.0,
            sum(map(operator.eq, words, words[1:])) / n if n else 0.0, again,
        )
    return out, sizes


def both(a: float, b: float) -> float:
    """log(e^a + e^b)."""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def chain(odds: list[float], t: list[list[float]]) -> tuple[list[float], list[float], float]:
    """(log odds of "good" of the forward messages, of the backward ones, log of the partition sum).

    odds: log odds of each line by its features; t[a][b]: the weight of label b after a.
    """
    forward, base = [odds[0]], 0.0
    for u in odds[1:]:
        r = forward[-1]
        down = both(t[0][0], t[1][0] + r)
        forward.append(u + both(t[0][1], t[1][1] + r) - down)
        base += down
    backward = [0.0]
    for u in reversed(odds[1:]):
        r = u + backward[-1]
        backward.append(both(t[1][0], t[1][1] + r) - both(t[0][0], t[0][1] + r))
    return forward, backward[::-1], base + both(0.0, forward[-1])


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


class Model:
    """Weights of a line's own features, of those of the lines before and after it, a constant, and four transitions."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.mean, self.scale = weights, mean, scale
        self.transitions = weights[-4:].reshape(2, 2).tolist()

    def shares(self, x: np.ndarray) -> np.ndarray:
        """What each line's features add to its own odds, to those of the line after it and of the line before it."""
        return (x - self.mean) / self.scale @ self.weights[: 3 * SIZE].reshape(3, SIZE).T

    def odds(self, raw: bytes, kind: np.ndarray) -> tuple[list[float], np.ndarray]:
        seen: set[int] = set()
        parts, sizes = zip(*((self.shares(x), n) for x, n in (features(p, kind, seen) for p in pieces(raw))))
        part, size = np.concatenate(parts), np.concatenate(sizes)
        out = part[:, 0] + self.weights[3 * SIZE]
        out[1:] += part[:-1, 1]
        out[:-1] += part[1:, 2]
        return out.tolist(), size

    def score(self, raw: bytes, kind: np.ndarray) -> float:
        odds, size = self.odds(raw, kind)
        forward, backward, _ = chain(odds, self.transitions)
        good = np.array([sigmoid(f + b) for f, b in zip(forward, backward)])
        return float(min(1.0, good @ size / size.sum()))

    def gradient(self, raw: bytes, label: int, kind: np.ndarray) -> tuple[float, np.ndarray]:
        """(negative log likelihood, its gradient) of the label on all lines, for each line."""
        odds, _ = self.odds(raw, kind)
        t, n = self.transitions, len(odds)
        forward, backward, total = chain(odds, t)
        miss = np.array([sigmoid(f + b) for f, b in zip(forward, backward)]) - label
        out = np.zeros(len(self.weights))
        own = out[: 3 * SIZE].reshape(3, SIZE)
        by = np.zeros((3, n))  # the misses that each line's features bear on
        by[0], by[1, :-1], by[2, 1:] = miss, miss[1:], miss[:-1]
        at, seen = 0, set()
        for p in pieces(raw):
            x, _ = features(p, kind, seen)
            own += by[:, at : at + len(x)] @ ((x - self.mean) / self.scale)
            at += len(x)
        out[3 * SIZE] = miss.sum()
        for k in range(1, n):
            r, s = forward[k - 1], odds[k] + backward[k]
            w = [t[0][0], t[0][1] + s, t[1][0] + r, t[1][1] + r + s]
            top = max(w)
            e = [math.exp(v - top) for v in w]
            z = sum(e)
            for j in range(4):
                out[-4 + j] += e[j] / z
            out[-1 if label else -4] -= 1
        value = total - (sum(odds) if label else 0.0) - (n - 1) * t[label][label]
        return value / n, out / n


def sums(sample: DataFrame, one) -> list[np.ndarray]:
    """The sum of one(raw, label, kind) over the rows of each partition."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, total = kinds(), None
        for batch in it:
            for raw, label in zip(batch.column(0), batch.column(1).to_pylist()):
                x = one(raw.as_py(), label, kind)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    return [np.array(r["total"]) for r in sample.select("raw", "label").mapInArrow(add, "total array<double>").collect()]  # LEARN_PARTS rows at most


def descend(value_of, x: np.ndarray, turns: int = TURNS, least_gain: float = LEAST_GAIN, memory: int = 8) -> np.ndarray:
    """The minimum of a smooth function by L-BFGS; value_of gives (value, gradient)."""
    value, slope = value_of(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    used = 1
    while used < turns:
        way, alphas = slope.copy(), []
        for s, y in reversed(steps):
            alphas.append(s @ way / (s @ y))
            way -= alphas[-1] * y
        way *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (s, y), a in zip(steps, reversed(alphas)):
            way += (a - y @ way / (s @ y)) * s
        far = 1.0
        while used < turns:
            new, new_slope = value_of(x - far * way)
            used += 1
            if new <= value - 1e-4 * far * (slope @ way):
                break
            far /= 4
        else:
            return x
        s, y = -far * way, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y)] if len(steps) >= memory else [*steps, (s, y)]
        gain, x, value, slope = value - new, x + s, new, new_slope
        if gain <= least_gain * abs(value):
            break
    return x


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, most: int = LEARN) -> Model | float:
    """The model of the labelled documents outside one fold of the ids; a number where there is nothing to tell apart."""
    known = labels.where("doc_id is not null and quality is not null").where(remainder(F.col("doc_id"), folds) != fold)
    known = cut(known.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("label")))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n == 0:
        return 0.5
    if good in (0, n):
        return float(good > 0)
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / n))
    # The picked labels are `most` rows, give or take the chance of the hashes, so they go to all tasks.
    sample = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).cast("binary").alias("raw")).join(F.broadcast(known.where(picked)), "doc_id")
    sample = cut(sample.select("raw", "label").repartition(LEARN_PARTS))

    def moments(raw: bytes, label: int, kind: np.ndarray) -> np.ndarray:
        seen: set[int] = set()
        out = np.zeros(2 * SIZE + 1)
        lines = 0
        for p in pieces(raw):
            x, _ = features(p, kind, seen)
            out[:SIZE] += x.sum(axis=0)
            out[SIZE:-1] += (x * x).sum(axis=0)
            lines += len(x)
        out /= lines  # each document counts alike
        out[-1] = 1
        return out

    found = sums(sample, moments)
    if not found:
        return good / n
    total = sum(found)
    docs_seen = total[-1]
    mean = total[:SIZE] / docs_seen
    scale = np.sqrt(np.maximum(total[SIZE:-1] / docs_seen - mean * mean, 0))
    scale[scale < 1e-6] = 1.0

    def value_of(weights: np.ndarray) -> tuple[float, np.ndarray]:
        model = Model(weights, mean, scale)
        total = sum(sums(sample, lambda raw, label, kind: np.append(*reversed(model.gradient(raw, label, kind)))))
        return total[-1] / docs_seen + PENALTY / 2 * float(weights @ weights), total[:-1] / docs_seen + PENALTY * weights

    return Model(descend(value_of, np.zeros(3 * SIZE + 5)), mean, scale)


def scored(docs: DataFrame, model: Model | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    if not isinstance(model, Model):
        return docs.select(docs[doc_id].alias("doc_id"), F.lit(float(model)).alias("score"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = kinds()
        for batch in it:
            scores = [model.score(raw.as_py(), kind) for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(batches, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = scored(docs, learn(docs, labels, folds, fold))
    return rows.select("doc_id", (remainder(F.col("doc_id"), folds) == fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
