"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features, and those of the lines before and after it, weigh on its label, and labels weigh on
their neighbours: both are learnt, by gradient ascent on the likelihood of the line labels of a text, with one ridge.
Training takes a bounded sample of labelled documents whose lines carry the document's label. A
document's quality is the mean of its lines' forward-backward marginals, weighted by length, and a logistic fit on the sample
turns it into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraseg.llm.common import arrow_limits, hash_words, text_slices

SAMPLE_DOCS = 4000
CUTOFF = 0.3
STEPS, RATE, RIDGE = 300, 0.05, 1e-4


def _classes() -> np.ndarray:
    """Class of each byte: letters, upper case, digits, blanks, stops, other marks, bars and bytes beyond ASCII."""
    table = np.full(256, 5, np.int8)
    table[[*range(ord("a"), ord("z") + 1)]] = 0
    table[[*range(ord("A"), ord("Z") + 1)]] = 1
    table[[*range(ord("0"), ord("9") + 1)]] = 2
    table[[0x20, *range(0x09, 0x0E)]] = 3
    table[[ord(c) for c in ".,;:'?-"]] = 4
    table[ord("|")] = 6
    table[128:] = 7
    return table


CLASSES = 8
NAMES = ["bias", *(f"class {i}" for i in range(CLASSES)), "length", "words", "word length", "repeated words", "marked words", "blank"]


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and bytes of every line of the texts, and the number of lines of each text (one at least)."""
    kinds = _classes()[data]
    edges = offsets[1:-1]
    marks = np.unique(np.r_[np.flatnonzero(data == 0x0A) + 1, edges, 0])
    starts = marks[marks < len(data)]
    if not len(data):
        starts = np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(data)] if len(starts) else starts
    owner = np.searchsorted(offsets, starts, "right") - 1
    n = len(starts)
    size = (ends - starts).astype(np.float64)
    shares = np.zeros((n, CLASSES))
    if n:
        line = np.repeat(np.arange(n), ends - starts)
        shares = np.bincount(line * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES) / size[:, None]
    solid = kinds != 3
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[starts] = solid[starts]
    word = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    if n:
        last[ends - 1] = solid[ends - 1]
    stop = np.flatnonzero(last) + 1
    words, repeated, marked = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(word):
        at = np.searchsorted(starts, word, "right") - 1
        words = np.bincount(at, minlength=n).astype(float)
        key, _ = hash_words(data, offsets)
        same = np.r_[False, (key[1:] == key[:-1]) & (at[1:] == at[:-1])]
        repeated = np.bincount(at, same, minlength=n) / np.maximum(words, 1)
        marked = np.bincount(at, kinds[stop - 1] >= 5, minlength=n) / np.maximum(words, 1)
        marked -= np.bincount(at, kinds[stop - 1] == 7, minlength=n) / np.maximum(words, 1)
    features = np.column_stack([np.ones(n), shares, np.minimum(np.log1p(size) / 8, 1), np.minimum(np.log1p(words) / 6, 1), np.minimum(shares @ np.r_[1, 1, 1, 0, 1, 1, 1, 1] * size / np.maximum(words, 1) / 12, 2), repeated, marked, words == 0])
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    none = np.flatnonzero(counts == 0)
    if len(none):
        # An empty text is one empty line.
        at = np.repeat(np.cumsum(counts)[none], 1)
        blank = np.zeros(len(NAMES))
        blank[[0, -1]] = 1
        features = np.insert(features, at, blank, axis=0) if n else np.tile(blank, (len(none), 1))
        size = np.insert(size, at, 1.0) if n else np.ones(len(none))
        counts = np.maximum(counts, 1)
    return features, size, counts


def with_neighbours(features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the lines before and after it in its text (zeros where there is none)."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    ends = np.cumsum(counts)
    before[ends - counts] = 0
    after[ends - 1] = 0
    return np.column_stack([features, before, after])


def chain(scores: np.ndarray, counts: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and of each pair of labels of a line and the one before it in its text.

    Forward-backward over all texts side by side. ``scores`` are log odds of good by line, ``switch[a, b]`` weights of
    label a before label b. The first line of a text has no pair: zeros.
    """
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    emit = np.exp(np.clip(np.column_stack([np.zeros(len(scores)), scores]), -30, 30))
    emit /= emit.sum(1, keepdims=True)
    trans = np.exp(switch - switch.max())
    ahead, back = np.ones_like(emit), np.ones_like(emit)
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes.max()) if len(sizes) else 0)]
    for t, n in enumerate(active):
        at = starts[:n] + t
        now = emit[at] if t == 0 else emit[at] * (ahead[at - 1] @ trans)
        ahead[at] = now / now.sum(1, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        now = (emit[at + 1] * back[at + 1]) @ trans.T
        back[at] = now / now.sum(1, keepdims=True)
    both = ahead * back
    pairs = np.zeros((len(scores), 2, 2))
    at = np.flatnonzero(inner_lines(counts))
    pairs[at] = ahead[at - 1][:, :, None] * trans * (emit[at] * back[at])[:, None, :]
    pairs[at] /= pairs[at].sum((1, 2), keepdims=True)
    return both[:, 1] / both.sum(1), pairs


def inner_lines(counts: np.ndarray) -> np.ndarray:
    """Which lines have one before them in their text."""
    inner = np.ones(int(counts.sum()), bool)
    inner[np.cumsum(counts) - counts] = False
    return inner


def marginals(scores: np.ndarray, counts: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """Probability that each line is good."""
    return chain(scores, counts, switch)[0]


def gradient(x: np.ndarray, counts: np.ndarray, y: np.ndarray, weights: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean over texts of the log likelihood a line of the labels ``y``, less the ridge, by ``weights`` and ``switch``."""
    good, pairs = chain(x @ weights, counts, switch)
    share = np.repeat(1 / counts, counts) / len(counts)
    at = np.flatnonzero(inner_lines(counts))
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), share[at])
    return x.T @ ((y - good) * share) - RIDGE * weights, seen - np.tensordot(share[at], pairs[at], 1) - RIDGE * switch


class Model:
    """Weights of the features, of the label changes, and of the final logistic fit."""

    def __init__(self, weights: np.ndarray, switch: np.ndarray):
        self.weights, self.switch, self.slope, self.level = weights, switch, 1.0, 0.0

    def raw(self, features: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        good = marginals(with_neighbours(features, counts) @ self.weights, counts, self.switch)
        starts = np.cumsum(counts) - counts
        mean = np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, features: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(features, size, counts) + self.level, -500, 500)))


def fit(features: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: np.ndarray, lines: np.ndarray | None = None) -> Model:
    """Gradient ascent on the likelihood of the lines' labels (``lines``, or that of their text); texts count alike.

    Where labels never change inside a text, only the ridge and the number of steps bound the weight of a change.
    """
    x = with_neighbours(features, counts)
    y = np.repeat(labels, counts).astype(float) if lines is None else lines.astype(float)
    values = np.zeros(x.shape[1] + 4)
    first, second = np.zeros(len(values)), np.zeros(len(values))
    for step in range(1, STEPS + 1):
        slope = np.concatenate([part.ravel() for part in gradient(x, counts, y, values[:-4], values[-4:].reshape(2, 2))])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        values = values + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights, switch = values[:-4], values[-4:].reshape(2, 2)
    model = Model(weights, switch)
    raw = model.raw(features, size, counts)
    slope, level = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * raw + level, -500, 500)))
        g = np.array([((labels - p) * raw).sum() - 1e-3 * slope, (labels - p).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * raw * raw).sum() + 1e-3, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, level = slope + move[0], level + move[1]
    model.slope, model.level = max(slope, 0.0), level
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs, sizes = [], []
        for _, _, data, offsets in text_slices(batch.column(1)):
            features, size, counts = line_features(data, offsets)
            ends = np.cumsum(counts)
            for a, z in zip(ends - counts, ends):
                blobs.append(features[a:z].astype(np.float32).tobytes())
                sizes.append(size[a:z].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary())], ["label", "features", "sizes"])


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_DOCS
) -> Model | None:
    """A model from the texts of at most ``sample`` ids of each label, those whose hashes come first; None without both labels."""
    arrow_limits(docs.sparkSession)
    rows = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(id_col), F.lit(7)).alias("h"))
    first = [rows.filter(F.col("label") == value).orderBy("h", "__id").limit(sample).select("__id", "label") for value in (0, 1)]
    # At most 2 * sample rows.
    taken = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(first[0].union(first[1])), "__id")
    found = taken.select("label", "text").mapInArrow(_features, "label int, features binary, sizes binary").toArrow().to_pylist()
    labels = np.array([r["label"] for r in found], float)
    if len(set(labels.tolist())) < 2:
        return None
    features = [np.frombuffer(r["features"], np.float32).reshape(-1, len(NAMES)) for r in found]
    size = np.concatenate([np.frombuffer(r["sizes"], np.float32) for r in found]).astype(float)
    return fit(np.concatenate(features).astype(float), size, np.array([len(f) for f in features]), labels)


def _score(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            scores = [own.score(*line_features(data, offsets)) for _, _, data, offsets in text_slices(batch.column(1))]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score_documents(
    docs: DataFrame, labels: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row: probability of label 1, and whether it reaches ``CUTOFF``.

    Learns from rows of ``labels`` with 0 or 1 where ``training``, a condition on the id, holds; ids with two labels count
    twice. Null and empty texts are one empty line. Without both labels to learn from, every score is 0.5. Repeated rows
    are scored alike; ids may be null; extra columns are ignored.
    """
    model = train(docs, labels.filter(training), id_col=id_col, text_col=text_col, label_col=label_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        scored = rows.select("doc_id", F.lit(0.5).alias("score"))
    else:
        kind = docs.schema[id_col].dataType.simpleString()
        scored = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
