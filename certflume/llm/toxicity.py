"""Toxicity by weak supervision.

Voters (lexicons and patterns) say toxic, clean or nothing about a text. A
generative label model is fitted by expectation maximisation on how often each
combination of votes occurs over all documents that may be learned from: per
voter what it says given each class (its accuracy), and from the correlations
that remain given the class how much of its evidence is its own. Given labels
are one more voter. A linear classifier is then trained on the posterior labels.

The classifier is fitted on `rows` labelled rows at most (FIT_ROWS); terms are counted over
all labelled rows that may be learned from, votes over all rows. The lexicon that tasks are sent holds the
`terms` strongest terms of the toxic class and `features` further ones (TERMS and FEATURES
by default), so its size is bounded; both are parameters of `train`.

Nulls: a null text is an empty one and gets the score of no evidence. Rows with
null ids are scored. Without any labelled toxic row the seed lexicons alone vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import crc_mod, extend, quoted, shipped, small_batches, struct
from .linear import FIT_ROWS, labelled_sample, logistic, sigmoid
from .text import ALNUM, Words, slices, string_bytes, words

#: Seed lexicons, a voter each.
SEEDS = {
    "insult": "idiot moron stupid loser clown scum pathetic worthless trash disgusting imbecile jerk dumb idiota imbécil estúpido imbécile stupide crétin dummkopf trottel versager",
    "profanity": "shit fuck fucking bastard bitch asshole crap damn mierda puta merde putain salope scheiße arschloch",
    "threat": "kill die hurt destroy hate burn matar odio tuer haine töten hass",
}
#: Terms learned from labels that vote, at most, and the voters they are dealt to.
TERMS, GROUPS = 96, 5
#: Further terms that only the classifier sees, at most.
FEATURES = 256
#: Labels (an id and a flag) that are broadcast at a time.
LABEL_BLOCK = 1_000_000
#: A learned term occurs in so many labelled documents at least.
LEAST_DOCS = 5
NAMES = [*SEEDS, *[f"learned{i}" for i in range(GROUPS)], "several", "dense", "none", "shouting"]
TOXIC, CLEAN, NOTHING = 2, 0, 1


def term_hash(terms) -> np.ndarray:
    w = words(pa.array([" ".join(terms)], pa.large_string()), ALNUM, True)
    return w.hashes()


def pairs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, word hash)."""
    value, doc = w.hashes(), w.doc()
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])] if len(value) else np.zeros(0, bool)
    return doc[new], value[new]


# ---- terms


def term_counts(sample: DataFrame, text: str) -> DataFrame:
    """(term hash, documents, toxic documents) over a frame with __y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def merged() -> np.ndarray:
            every = np.concatenate(held)
            term, at = np.unique(every["term"], return_inverse=True)
            out = np.zeros(len(term), every.dtype)
            out["term"] = term
            for name in ("n", "toxic"):
                out[name] = np.bincount(at, every[name], len(term)).astype(np.int64)
            return out

        size = 0
        for batch in slices(batches, "t"):
            doc, value = pairs(words(batch.column("t"), ALNUM, True))
            part = np.zeros(len(value), [("term", np.uint64), ("n", np.int64), ("toxic", np.int64)])
            part["term"], part["n"], part["toxic"] = value, 1, batch.column("__y").to_numpy()[doc]
            held.append(part)
            size += len(part)
            if size > 500_000:
                held = [merged()]
                size = len(held[0])
                if size > 250_000:
                    yield _rows(held[0])
                    held, size = [], 0
        if held:
            yield _rows(merged())

    def _rows(a: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a["term"].view(np.int64)), pa.array(a["n"]), pa.array(a["toxic"])], ["term", "n", "toxic"])

    rows = sample.select(F.col(quoted(text)).cast("string").alias("t"), "__y").mapInArrow(run, "term bigint, n bigint, toxic bigint")
    return rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


@dataclass
class Lexicon:
    """Sorted hashes of all terms, and for each its voter and its place among the features (-1: none)."""

    term: np.ndarray
    voter: np.ndarray
    feature: np.ndarray
    features: int


def lexicon(labelled: DataFrame, text: str, terms: int = TERMS, features: int = FEATURES) -> Lexicon:
    n, toxic = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("__y"), F.lit(0))).first()
    counts = term_counts(labelled, text).where(F.col("n") >= LEAST_DOCS)
    # How far the toxic share of the term's documents lies from the overall share, in standard errors.
    share = (toxic + 1.0) / (n + 2.0)
    z = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * F.lit(share * (1 - share)))
    ranked = counts.select("term", z.alias("z"), (F.col("toxic") / F.col("n")).alias("p"))
    strong = [r.term for r in ranked.where((F.col("p") > min(0.9, 3 * share)) & (F.col("z") > 4)).orderBy(F.desc("z"), "term").limit(terms).collect()] if toxic else []
    other = [r.term for r in ranked.orderBy(F.desc(F.abs("z")), "term").limit(features).collect()] if toxic else []
    voter: dict[int, int] = {}
    feature: dict[int, int] = {}
    for i, t in enumerate(strong):
        voter[t] = len(SEEDS) + i % GROUPS
    for v, seed in enumerate(SEEDS.values()):
        for t in term_hash(seed.split()).view(np.int64).tolist():
            voter.setdefault(t, v)
    for t in [*voter, *other]:
        feature.setdefault(t, len(feature))
    every = np.array(sorted(feature, key=lambda t: t & (1 << 64) - 1), np.int64)
    return Lexicon(every.view(np.uint64), np.array([voter.get(t, -1) for t in every.tolist()], np.int64),
                   np.array([feature[t] for t in every.tolist()], np.int64), len(feature))


# ---- votes


def evidence(array: pa.Array, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Votes (documents x voters) and features (documents x terms, then how many and how dense the lexicon's hits are)."""
    w = words(array, ALNUM, True)
    docs = len(w.first) - 1
    value = w.hashes()
    x = np.zeros((docs, lex.features + 2), np.float32)
    hits = np.zeros((docs, len(NAMES)))
    all_hits = np.zeros(docs)
    if len(value) and len(lex.term):
        at = np.minimum(np.searchsorted(lex.term, value), len(lex.term) - 1)
        known = np.flatnonzero(lex.term[at] == value)
        at, doc = at[known], np.searchsorted(w.first, known, side="right") - 1
        x[doc, lex.feature[at]] = 1
        on = lex.voter[at] >= 0
        np.add.at(hits, (doc[on], lex.voter[at[on]]), 1)
        all_hits += np.bincount(doc[on], minlength=docs)
    length = np.maximum(w.counts, 1)
    groups = (hits[:, :len(SEEDS) + GROUPS] > 0).sum(1)
    x[:, -2], x[:, -1] = np.log1p(all_hits), np.minimum(all_hits / length * 20, 3)
    votes = np.full((docs, len(NAMES)), NOTHING, np.int8)
    lexicons = len(SEEDS) + GROUPS
    votes[:, :lexicons][hits[:, :lexicons] > 0] = TOXIC
    votes[:, lexicons] = np.where((groups >= 2) | (all_hits >= 3), TOXIC, NOTHING)
    votes[:, lexicons + 1] = np.where(all_hits / length > 0.02, TOXIC, np.where(all_hits / length < 0.001, CLEAN, NOTHING))
    votes[:, lexicons + 2] = np.where(all_hits == 0, CLEAN, NOTHING)
    votes[:, lexicons + 3] = np.where(shouting(array) > 0.3, TOXIC, NOTHING)
    return votes, x


def shouting(array: pa.Array) -> np.ndarray:
    """Exclamation marks for each space in the raw text."""
    data, offsets = string_bytes(array)
    count = lambda c: np.diff(np.concatenate([[0], np.cumsum(data == c)])[offsets])
    return count(0x21) / (count(0x20) + 1)


def patterns(docs: DataFrame, text: str, sent) -> DataFrame:
    """(pattern, n): votes as base-3 digits, the given label as the last voter, with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in slices(batches, "t"):
            votes, _ = evidence(batch.column("t"), sent())
            label = np.array([NOTHING if y is None else TOXIC if y else CLEAN for y in batch.column("__y").to_pylist()])
            code = np.hstack([votes, label[:, None]]).astype(np.int64) @ 3 ** np.arange(len(NAMES) + 1)
            for c, n in zip(*np.unique(code, return_counts=True), strict=True):
                total[int(c)] = total.get(int(c), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["pattern", "n"])

    rows = docs.select(F.col(quoted(text)).cast("string").alias("t"), "__y").mapInArrow(run, "pattern bigint, n bigint")
    return rows.groupBy("pattern").agg(F.sum("n").alias("n"))


# ---- the label model


@dataclass
class LabelModel:
    """log P(vote | class) by voter, vote and class; how much of each voter's evidence counts; log prior."""

    table: np.ndarray
    own: np.ndarray
    prior: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = self.prior + sum(self.own[j] * self.table[j][votes[:, j]] for j in range(votes.shape[1]))
        return sigmoid(logs[:, 1] - logs[:, 0])


def _correlation(centred: np.ndarray, weight: np.ndarray) -> np.ndarray:
    cov = (centred * weight[:, None]).T @ centred
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    return cov / scale[:, None] / scale[None, :]


def label_model(votes: np.ndarray, n: np.ndarray, steps: int = 40) -> LabelModel:
    """Fit on distinct vote vectors and their counts. It starts from the majority of votes, labels outweighing the others.

    Voters that nearly always agree are copies of one from the start: once their common opinion is taken
    for the class, no correlation would remain to tell.
    """
    voters = votes.shape[1]
    share = n / max(n.sum(), 1e-9)
    copies = _correlation(votes - share @ votes, share) > 0.9
    np.fill_diagonal(copies, True)
    copies[-1] = copies[:, -1] = False
    copies[-1, -1] = True
    lean = (votes[:, :-1] - 1.0) @ (1 / copies.sum(1)[:-1]) + 6.0 * (votes[:, -1] - 1.0)
    p = sigmoid(lean)
    for _ in range(steps):
        weight = np.stack([n * (1 - p), n * p], 1)
        table = np.empty((voters, 3, 2))
        for j in range(voters):
            for v in range(3):
                table[j, v] = weight[votes[:, j] == v].sum(0) + 0.5
        table = np.log(table / table.sum(1, keepdims=True))
        prior = np.log((weight.sum(0) + 1) / (n.sum() + 2))
        # Correlation that remains given the class (what chance and a rough class leave aside): voters that repeat each other share their evidence.
        remains = np.zeros((voters, voters))
        for y in range(2):
            w = weight[:, y] / max(weight[:, y].sum(), 1e-9)
            remains += 0.5 * _correlation(votes - w @ votes, w)
        own = 1 / (copies.sum(1) + np.where(copies, 0, np.maximum(remains - 0.25, 0)).sum(1))
        own[-1] = 1.0
        model = LabelModel(table, own, prior)
        new = model.posterior(votes)
        moved = np.abs(new - p).max()
        p = new
        if moved < 1e-6:
            break
    return model


# ---- training and scoring


@dataclass
class Toxicity:
    lexicon: Lexicon
    labels: LabelModel
    weights: np.ndarray

    def score(self, array: pa.Array) -> np.ndarray:
        _, x = evidence(array, self.lexicon)
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS,
          terms: int = TERMS, features: int = FEATURES) -> Toxicity:
    small_batches(docs.sparkSession)
    may = docs.where(crc_mod(doc_id, 5) != 0).select(F.col(quoted(doc_id)).cast("long").alias("__id"), F.col(quoted(text)).cast("string").alias("t"))
    sample = F.broadcast(labelled_sample(labels, label, doc_id, rows))  # `rows` bounds it
    # All labelled rows, LABEL_BLOCK or so at a time beside the texts, which stay where they are.
    every = labelled_sample(labels, label, doc_id, None)
    blocks = max(1, -(-every.count() // LABEL_BLOCK))
    parts = [may.join(F.broadcast(every.where(F.pmod(F.xxhash64("__id"), F.lit(blocks)) == b)), "__id") for b in range(blocks)]
    lex = lexicon(reduce(DataFrame.unionByName, parts), "t", terms, features)
    sent = shipped(docs.sparkSession, lex)
    digits = 3 ** np.arange(len(NAMES) + 1)
    found = patterns(may.join(sample, "__id", "left"), "t", sent).collect()  # 3 ** 13 rows at most
    code = np.array([r.pattern for r in found], np.int64)
    votes = code[:, None] // digits % 3 if len(code) else np.full((1, len(digits)), NOTHING)
    model = label_model(votes, np.array([r.n for r in found], float) if len(code) else np.ones(1))
    sent_model = shipped(docs.sparkSession, model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        v, x = evidence(batch.column("__text"), sent())
        label = np.where(batch.column("__y").to_numpy() > 0, TOXIC, CLEAN)
        p = sent_model().posterior(np.hstack([v, label[:, None]]))
        return [pa.array(p), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())]

    fit = extend(may.join(sample, "__id"), "t", make, struct("p double, x binary"), keep=["__y"]).select("p", "x").toArrow()
    if not fit.num_rows:
        return Toxicity(lex, model, np.append(np.zeros(lex.features), [2.0, 1.0, -4.0]))
    x = np.frombuffer(b"".join(fit.column("x").to_pylist()), np.float16).reshape(fit.num_rows, -1)
    p = fit.column("p").to_numpy()
    return Toxicity(lex, model, _fit(x, p))


def _fit(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rows with equal features are one weighted row, so a common text costs no more than a rare one."""
    key, at = np.unique(x, axis=0, return_inverse=True)
    n = np.bincount(at.ravel())
    mean = np.bincount(at.ravel(), p) / n
    return logistic(key.astype(np.float64), mean, n.astype(float), ridge=0.05)


def score(docs: DataFrame, model: Toxicity, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append `score` (0 to 1) and `predicted` (score >= 0.5). Columns of these names are replaced."""
    sent = shipped(docs.sparkSession, model)
    make = lambda batch: [pa.array((s := sent().score(batch.column("__text"))).astype(np.float64)), pa.array((s >= 0.5).astype(np.int32))]
    return extend(docs, text, make, struct("score double, predicted int"), keep=keep)
