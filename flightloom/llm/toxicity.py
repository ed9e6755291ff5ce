"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.llm.common import hash_sample, one_text_each

#: Bounds of the training sample and of the model.
POSITIVES, UNLABELLED, FEATURES = 4_000, 12_000, 4_096
HASH_BITS = 20
_TOKEN = re.compile(r"\w+")


@lru_cache(maxsize=300_000)
def _slot(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) >> (64 - HASH_BITS)


def token_slots(text: str | None) -> np.ndarray:
    """The distinct hashed words of a whole text, sorted."""
    found = {_slot(t) for t in set(_TOKEN.findall(text.lower()))} if text else ()
    return np.sort(np.fromiter(found, np.int32, len(found)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Rows:
    """Sparse 0/1 rows: slots of row i are at[start[i]:start[i + 1]]."""

    at: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, lists: list) -> Rows:
        sizes = [len(x) for x in lists]
        return cls(np.concatenate([*map(np.asarray, lists), np.zeros(0, np.int64)]).astype(np.int64), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))

    def __len__(self) -> int:
        return len(self.start) - 1

    def dot(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(weights[self.at])))
        return total[self.start[1:]] - total[self.start[:-1]]

    def back(self, values: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.at, np.repeat(values, np.diff(self.start)), width)


@dataclass
class ToxicityModel:
    slots: np.ndarray  # hashed words that the model knows, sorted
    weights: np.ndarray
    bias: float
    prior: float

    def known(self, text: str | None) -> np.ndarray:
        slots = token_slots(text)
        at = np.searchsorted(self.slots, slots)
        at[at == len(self.slots)] = 0
        return at[self.slots[at] == slots] if len(self.slots) else at[:0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.bias + Rows.of([self.known(t) for t in texts]).dot(self.weights))


def nonnegative_pu_fit(positive: Rows, unlabelled: Rows, width: int, prior: float, rounds: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative PU risk with the logistic loss.

    Risk: prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]). Where the second part turns negative, its
    gradient is ascended, as the method prescribes, so positives are not overfitted. Adam, full batches.
    """
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        fp, fu = positive.dot(w) + b, unlabelled.dot(w) + b
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        to_plus = -sigmoid(-fp) * prior / len(positive)
        from_positive, from_unlabelled = -sigmoid(fp) * prior / len(positive), sigmoid(fu) / len(unlabelled)
        gp, gu = (to_plus + from_positive, from_unlabelled) if negative >= 0 else (-from_positive, -from_unlabelled)
        grad = np.append(positive.back(gp, width) + unlabelled.back(gu, width) + ridge * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, learn: Column, prior: float | None = None, seed: int = 11) -> ToxicityModel:
    """Fits on at most POSITIVES confirmed toxic texts and UNLABELLED texts, chosen by a seeded hash of doc_id.

    `learn` says over doc_id which rows may be learned from. The class prior is the share of toxic rows among the labels
    that may be learned from, unless given. Features are extracted where the texts are; a text gives each distinct word
    once, and an id with several texts gives the one of least hash. Without any such positive text the model scores every text by the prior 0.
    """
    known = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    total, toxic = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    prior = prior if prior is not None else min(0.9, (toxic or 0) / max(total, 1))

    def slots(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "slots": [token_slots(t) for t in pdf["text"]]})

    def gather(ids: DataFrame) -> Rows:
        # A row an id of the bounded sample: its features come to the driver.
        pdf = one_text_each(docs, ids).mapInPandas(slots, "doc_id long, slots array<int>").toPandas().sort_values("doc_id", kind="stable")
        return Rows.of(list(pdf["slots"]))

    positive = gather(hash_sample(known.where("toxic = 1").select("doc_id"), "doc_id", POSITIVES, seed)) if toxic else Rows.of([])
    unlabelled = gather(hash_sample(docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id"), "doc_id", UNLABELLED, seed + 1)) if toxic else Rows.of([])
    if not len(positive) or not len(unlabelled):
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0), -40.0, prior)
    # Words by how far their share of positive texts lies above that of unlabelled ones, in standard errors. Words of
    # fewer than 5 positives (of a quarter of them where they are few), or not twice as frequent there, go: they follow
    # length and topic.
    width = 1 << HASH_BITS
    in_p, in_u = (np.bincount(r.at, minlength=width) for r in (positive, unlabelled))
    share = (in_p + in_u + 1) / (len(positive) + len(unlabelled) + 2)
    gap = (in_p / len(positive) - in_u / len(unlabelled)) / np.sqrt(share * (1 - share) * (1 / len(positive) + 1 / len(unlabelled)))
    gap[(in_p < min(5, max(1, len(positive) // 4))) | (in_p * len(unlabelled) < 2 * in_u * len(positive))] = 0
    order = np.lexsort((np.arange(width), -gap))[:FEATURES]
    chosen = np.sort(order[gap[order] > 3])
    model = ToxicityModel(chosen.astype(np.int32), np.zeros(len(chosen)), 0.0, prior)

    def narrowed(rows: Rows) -> Rows:
        at = np.searchsorted(chosen, rows.at)
        at[at == len(chosen)] = 0
        hit = chosen[at] == rows.at if len(chosen) else np.zeros(len(at), bool)
        kept = np.concatenate(([0], np.cumsum(hit)))
        return Rows(at[hit], kept[rows.start])

    model.weights, model.bias = nonnegative_pu_fit(narrowed(positive), narrowed(unlabelled), len(chosen), min(max(prior, 1e-3), 0.9))
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted for each row of `docs` (doc_id, text). Whole texts count, each word once. Null and empty
    texts score by the bias alone. Rows that repeat or have no doc_id come out once each; an empty table gives an empty
    table. A score at the threshold is predicted 1."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            score = model.scores(list(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": score, "predicted": (score >= threshold).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, score double, predicted int")
