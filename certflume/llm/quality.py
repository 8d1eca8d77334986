"""Quality by pairwise ranking.

Of a pair of texts, one labelled good and one bad, the good one should have the
higher score: a Bradley-Terry model, fitted by logistic loss on differences of
features. Features are counts over bytes and words of the whole text. The score
is cut at a quantile: the one of the fitted rows that parts the labels best; at
the cut the returned score is `CUT`, and it rises with the pairwise score.

The fit uses FIT_ROWS labelled rows at most and PARTNERS pairs of each; scoring
is one step over the rows and shuffles nothing.

Nulls: a null text counts as empty. Without rows of both labels all scores are 1 - CUT.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import crc_mod, extend, quoted, shipped, struct
from .linear import FIT_ROWS, labelled_sample, logistic, sigmoid
from .text import SPACED, string_bytes, window_hashes, words

#: Score at the quantile that parts good from bad.
CUT = 0.3
#: Texts of the other label that each fitted text is paired with.
PARTNERS = 8

#: Classes of bytes that are counted.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "line": b"\n", "stop": b".,;:?", "shout": b"!",
    "symbol": b"#$%&*+<=>@\\^_`{}~", "bar": b"|/", "quote": b"\"'()[]-",
}


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)
    for k, chars in enumerate(CLASSES.values()):
        table[list(chars)] = k
    return table


def _distinct(doc: np.ndarray, value: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: how many distinct values, and how often the commonest occurs."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if not len(doc):
        return np.zeros(docs), np.zeros(docs)
    begin = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])
    many = np.diff(np.r_[begin, len(doc)])
    most = np.zeros(docs)
    np.maximum.at(most, doc[begin], many)
    return np.bincount(doc[begin], minlength=docs).astype(float), most


def features(array: pa.Array) -> np.ndarray:
    """Documents x features, each within a few units."""
    data, offsets = string_bytes(array)
    docs = len(offsets) - 1
    w = words(array, SPACED, False)
    n = np.maximum(w.counts, 1).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    kind = _class_table()[data]
    per = lambda flags, at: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    counts = {name: per(kind == k, offsets) for k, name in enumerate(CLASSES)}
    length = w.end - w.start
    value, doc = w.hashes(), w.doc()
    unique, commonest = _distinct(doc, value, docs)
    pair = window_hashes(value, 2)
    inside = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    pairs, _ = _distinct(doc[:-1][inside], pair[inside], docs) if len(doc) > 1 else (np.zeros(docs), None)
    repeat = np.zeros(len(value), bool)
    if len(value) > 1:
        repeat[1:] = (value[1:] == value[:-1]) & inside
    last = w.bytes[w.end - 1] if len(value) else np.zeros(0, np.uint8)
    odd = np.isin(kind[w.end - 1] if len(value) else last, [6, 7])
    loud = last == 0x21
    upper_word = (kind[w.start] == 0) & (kind[np.minimum(w.start + 1, w.end - 1)] == 0) if len(value) else np.zeros(0, bool)
    mean = per(length, w.first) / n
    columns = [
        np.log1p(w.counts) / 5, mean / 8, per(length > 20, w.first) / n, unique / n, commonest / n, pairs / np.maximum(n - 1, 1), per(repeat, w.first) / n,
        per(odd, w.first) / n, per(loud, w.first) / n, per(upper_word, w.first) / n, np.log1p(counts["line"]) / 3, counts["line"] / n,
        *[np.sqrt(counts[name] / size) for name in CLASSES if name != "line"], *[counts[name] / n for name in ("symbol", "bar", "shout", "stop")],
    ]
    x = np.stack(columns, 1)
    # Shares matter most where they are small: each also by its sign of being there at all.
    return np.hstack([x, np.tanh(20 * x[:, 6:10]), np.tanh(10 * x[:, -4:])])


@dataclass
class Quality:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    cut: float

    def score(self, array: pa.Array) -> np.ndarray:
        s = np.clip((features(array) - self.mean) / self.scale, -6, 6) @ self.weights
        return sigmoid(self.slope * (s - self.cut) + np.log(CUT / (1 - CUT)))


def pairs(few: np.ndarray, many: np.ndarray, partners: int) -> tuple[np.ndarray, np.ndarray]:
    """Each of the few meets `partners` of the many or as many as let all take part, taken in turn: a bounded set of pairs, not their product."""
    i = np.arange(len(few) * max(partners, -(-len(many) // len(few))))
    # After the least common multiple of both lengths the same pairs would come again, so the many move on by one place.
    return few[i % len(few)], many[(i + i // np.lcm(len(few), len(many))) % len(many)]


def fit(x: np.ndarray, y: np.ndarray, partners: int = PARTNERS) -> Quality:
    """From features and labels in a fixed order."""
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.clip((x - mean) / scale, -6, 6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Quality(mean, scale, np.zeros(x.shape[1]), 1.0, -2 * float(np.log((1 - CUT) / CUT)))
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    left, right = pairs(few, many, partners)
    better, worse = (right, left) if few is bad else (left, right)
    weights = logistic(z[better] - z[worse], np.ones(len(better)), np.full(len(better), 1.0), ridge=1.0, free_bias=False)[:-1]
    s = z @ weights
    order = np.argsort(s, kind="stable")
    ranked = y[order]
    # Cutting below place i keeps everything from i on; the quantile with the best mean of both classes' shares that are right.
    right_bad = np.r_[0, np.cumsum(ranked == 0)] / len(bad)
    right_good = 1 - np.r_[0, np.cumsum(ranked == 1)] / len(good)
    i = int(np.argmax(right_bad * len(bad) + right_good * len(good) + 0.5 * (right_bad + right_good)))
    values = s[order]
    cut = values[0] - 1 if i == 0 else values[-1] + 1 if i == len(s) else (values[i - 1] + values[i]) / 2
    spread = max(float(s[good].mean() - s[bad].mean()), 1e-6)
    return Quality(mean, scale, weights, 8 / spread, float(cut))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Quality:
    may = docs.where(crc_mod(doc_id, 5) != 0).select(F.col(quoted(doc_id)).cast("long").alias("__id"), F.col(quoted(text)).cast("string").alias("t"))
    sample = F.broadcast(labelled_sample(labels, label, doc_id, rows))  # `rows` bounds it
    make = lambda batch: [pa.array([r.tobytes() for r in features(batch.column("__text")).astype(np.float32)], pa.binary())]
    found = extend(may.join(sample, "__id"), "t", make, struct("x binary"), keep=["__id", "__y"]).orderBy("__id", "x").toArrow()
    width = features(pa.array(["a"])).shape[1]
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(found.num_rows, width).astype(float)
    # In order of a hash, so that partners do not follow the ids.
    order = np.argsort((found.column("__id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    return fit(x[order], found.column("__y").to_numpy()[order])


def score(docs: DataFrame, model: Quality, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append `score` (0 to 1) and `predicted` (score >= CUT). Columns of these names are replaced."""
    sent = shipped(docs.sparkSession, model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        s = sent().score(batch.column("__text"))
        return [pa.array(s), pa.array((s >= CUT).astype(np.int32))]

    return extend(docs, text, make, struct("score double, predicted int"), keep=keep)
