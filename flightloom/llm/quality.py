"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.llm.common import batches, hash_sample, one_text_each, settled

#: Bounds of the training sample: documents of each label, chains of lines, and lines of one chain. At most TRAIN_CHAINS
#: times CHAIN rows of OWN numbers reach the driver, however long the texts are.
TRAIN_DOCS, TRAIN_CHAINS, CHAIN = 4_000, 6_000, 64
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "bar")
OWN = len(CLASSES) + 7
FEATURES = 1 + 3 * OWN + 2


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"Ll": 0, "Lo": 0, "Lm": 0, "Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3, "Cc": 3, "Zl": 3, "Zp": 3}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c)), 6) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for marks, kind in ((".,;:", 4), ("!?", 5), ("|", 7)):
        table[[ord(c) for c in marks]] = kind
    return table


def own_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x OWN, length of each line): what each line of a whole text is like by itself, and whether it came before."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    breaks = points == 10
    row = np.cumsum(breaks) - breaks
    n = int(breaks.sum()) + 1
    counts = np.bincount((row * 8 + _classes()[points])[~breaks], minlength=8 * n).reshape(n, 8).astype(float)
    sizes = counts.sum(axis=1)
    own = np.zeros((n, OWN))
    own[:, :8] = counts / np.maximum(sizes, 1)[:, None]
    own[:, 8] = np.log1p(sizes) / 6
    seen: set[str] = set()
    for i, line in enumerate(text.split("\n")):
        words = line.split()
        k = len(words)
        if k:
            own[i, 9] = len(set(words)) / k
            own[i, 10] = sum(map(eq, words, words[1:])) / k
            own[i, 11] = (sizes[i] - counts[i, 3]) / k / 10
            own[i, 12] = words[-1][-1] in ".!?"
        else:
            own[i, 13] = 1
        own[i, 14] = line in seen
        seen.add(line)
    return own, sizes


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """lines x FEATURES of one text: a constant, the line's own features, both neighbours', and whether it has any."""
    n = len(own)
    both = np.zeros((n, FEATURES))
    both[:, 0] = 1
    both[:, 1 : 1 + OWN] = own
    both[1:, 1 + OWN : 1 + 2 * OWN] = own[:-1]
    both[:-1, 1 + 2 * OWN : 1 + 3 * OWN] = own[1:]
    both[0, -2] = both[-1, -1] = 1
    return both


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    own, sizes = own_features(text)
    return with_neighbours(own), sizes


def marginals(emit: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains laid end to end. emit: rows x 2 scores; sizes: rows of each chain; step: 2 x 2 scores.

    Returns the marginals (rows x 2), the summed pair marginals (2 x 2) and the log normaliser of each chain. All chains
    advance together, place by place, so a step is one numpy operation over the chains that are long enough.
    """
    order = np.argsort(-sizes, kind="stable")
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))[order]
    size = sizes[order]
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), side="left")  # chains longer than each place
    forward, backward = np.zeros_like(emit), np.zeros_like(emit)
    for t in range(longest):
        at = start[: alive[t]] + t
        came = np.logaddexp(*(forward[at - 1][:, k, None] + step[k] for k in (0, 1))) if t else 0
        forward[at] = emit[at] + came
    pairs = np.zeros((2, 2))
    end = start + size - 1
    norm = np.logaddexp(forward[end, 0], forward[end, 1])
    for t in range(longest - 2, -1, -1):
        k = alive[t + 1]
        at = start[:k] + t
        ahead = emit[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(step[:, 0] + ahead[:, 0, None], step[:, 1] + ahead[:, 1, None])
        pairs += np.exp(forward[at][:, :, None] + step + ahead[:, None, :] - norm[:k, None, None]).sum(axis=0)
    each = np.empty(len(sizes))
    each[order] = norm
    return np.exp(forward + backward - np.repeat(each, sizes)[:, None]), pairs, each


@dataclass
class QualityModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 2)))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: tuple[float, float] = (1.0, 0.0)

    def lines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts' lines end to end: the marginal of being good and the length; and the lines of each text."""
        found = [line_features(t) for t in texts]
        sizes = np.array([len(x[1]) for x in found], np.int64)
        good = marginals(np.concatenate([x[0] for x in found]) @ self.weights, sizes, self.step)[0][:, 1]
        return good, np.concatenate([x[1] for x in found]), sizes

    @staticmethod
    def aggregated(good: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The mean of a text's marginals, weighted by the lines' lengths plus one."""
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return np.add.reduceat(good * (length + 1), starts) / np.add.reduceat(length + 1, starts)

    def document_quality(self, texts: list[str | None]) -> np.ndarray:
        return self.aggregated(*self.lines(texts))

    def calibrated(self, quality: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        quality = np.clip(quality, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(a * np.log(quality / (1 - quality)) + b, -40, 40)))


def crf_fit(features: np.ndarray, good: np.ndarray, sizes: np.ndarray, rounds: int = 250, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition scores that maximise the chains' conditional likelihood."""
    w, step = np.zeros((features.shape[1], 2)), np.zeros((2, 2))
    told = np.zeros((len(good), 2))
    told[np.arange(len(good)), good] = 1
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    inner = np.setdiff1d(np.arange(len(good)), starts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[inner - 1], good[inner]), 1)
    m, v = np.zeros(w.size + 4), np.zeros(w.size + 4)
    for t in range(1, rounds + 1):
        guess, pairs, _ = marginals(features @ w, sizes, step)
        grad = np.append((features.T @ (guess - told) / len(good) + ridge * w).ravel(), ((pairs - seen) / len(good) + ridge * step).ravel())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, step = w - move[:-4].reshape(w.shape), step - move[-4:].reshape(2, 2)
    return w, step


def _calibrate(quality: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """A logistic curve over the logit of the document quality, by Newton steps with a small ridge."""
    logit = np.log(np.clip(quality, 1e-6, 1 - 1e-6) / (1 - np.clip(quality, 1e-6, 1 - 1e-6)))
    x = np.column_stack([logit, np.ones(len(logit))])
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        theta = theta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2), x.T @ (label - p) - (theta - [1, 0]))
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, seed: int = 5) -> QualityModel:
    """Fits on at most TRAIN_DOCS texts of each label, chosen by a seeded hash of doc_id, cut to chains of CHAIN lines, of
    which at most TRAIN_CHAINS are used, chosen by a seeded hash too.

    Lines take the label of their document as a weak label; the chain model then tells ordinary lines of bad documents
    from bad ones, since ordinary lines are common in good documents. Features are extracted where the texts are, and the
    documents' qualities too, which then calibrate the aggregate by their labels. Null and empty texts count as one empty
    line. A doc_id with both labels counts as bad, one with several texts by the text of least hash. Without labels of both kinds an
    uninformed model is returned; it scores 0.5.
    """
    known = labels.where(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int"))
    parts = [hash_sample(known.where(F.col("quality") == k), "doc_id", TRAIN_DOCS, seed).withColumn("quality", F.lit(k)) for k in (0, 1)]
    chosen = settled(parts[0].union(parts[1]).groupBy("doc_id").agg(F.min("quality").alias("label")))
    sample = settled(one_text_each(docs, chosen.select("doc_id")).join(F.broadcast(chosen), "doc_id"))

    def chains(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces:
            out = []
            for doc_id, text, label in zip(pdf["doc_id"], pdf["text"], pdf["label"], strict=True):
                own = own_features(text)[0].astype(np.float32)
                # A chain brings the lines beside it along, so that its ends know their neighbours.
                out += [(doc_id, at, label, at > 0, at + CHAIN < len(own), own[max(0, at - 1) : at + CHAIN + 1].tobytes()) for at in range(0, len(own), CHAIN)]
            yield pd.DataFrame(out, columns=["doc_id", "at", "label", "before", "after", "own"])

    drawn = F.xxhash64(F.lit(seed + 1), "doc_id", "at")
    found = sample.mapInPandas(chains, "doc_id long, at long, label int, before boolean, after boolean, own binary")
    pdf = found.orderBy(drawn, "doc_id", "at", "own").limit(TRAIN_CHAINS).toPandas()
    if pdf["label"].nunique() < 2:
        return QualityModel()
    features = []
    for before, after, own in zip(pdf["before"], pdf["after"], pdf["own"], strict=True):
        lines = with_neighbours(np.frombuffer(own, np.float32).reshape(-1, OWN).astype(float))
        features.append(lines[int(before) : len(lines) - int(after)])
    sizes = np.array([len(x) for x in features], np.int64)
    model = QualityModel()
    model.weights, model.step = crf_fit(np.concatenate(features), np.repeat(pdf["label"].to_numpy(np.int64), sizes), sizes)

    def judged(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces:
            for at in batches(len(pdf), 500):
                yield pd.DataFrame({"quality": model.document_quality(list(pdf["text"].iloc[at])), "label": pdf["label"].iloc[at].to_numpy()})

    known_quality = sample.mapInPandas(judged, "quality double, label int").toPandas().sort_values(["quality", "label"])
    model.calibration = _calibrate(known_quality["quality"].to_numpy(), known_quality["label"].to_numpy())
    return model


def quality_scores(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, n_lines and n_good (lines whose marginal of being good is over a half) for each row of
    `docs` (doc_id, text). Whole texts count, however long. Null and empty texts are one empty line. Rows that repeat or
    have no doc_id come out once each; an empty table gives an empty table. A score at the threshold is predicted 1."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in batches(len(pdf), 500):
                part = pdf.iloc[at]
                good, length, sizes = model.lines(list(part["text"]))
                score = model.calibrated(model.aggregated(good, length, sizes))
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": score, "predicted": (score >= threshold).astype(np.int32), "n_lines": sizes, "n_good": np.add.reduceat((good > 0.5).astype(np.int64), starts)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, score double, predicted int, n_lines long, n_good long")


def line_labels(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, line (from 0), length, good (the marginal) and label (1 if it is over a half) of every line of `docs`. Null and
    empty texts are one empty line; rows that repeat or have no doc_id give their lines once each; no rows, no lines."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in batches(len(pdf), 500):
                part = pdf.iloc[at]
                good, length, sizes = model.lines(list(part["text"]))
                yield pd.DataFrame({"doc_id": part["doc_id"].repeat(sizes), "line": np.concatenate([np.arange(n) for n in sizes]), "length": length.astype(np.int64), "good": good, "label": (good > 0.5).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, line long, length long, good double, label int")
