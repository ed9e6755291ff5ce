"""Language identification by string kernels: Nystrom landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom.llm.common import settled

#: Bounds of the training sample: texts in all where languages are few, and texts of each language where they are many.
TRAIN_DOCS, EACH_LEAST = 6_000, 8
#: Languages that one model holds on the driver; fit() refuses more, it does not choose among them.
MOST_LANGUAGES = 2_000
#: Landmarks (one of every language at least, MOST_LANGUAGES bounds them), and hashed n-grams.
LANDMARKS, SLOTS = 192, 1 << 15
#: The blended spectrum: n-grams of one to four letters.
ORDERS = (1, 2, 3, 4)
#: Of known texts, held out from the model that judges them, the share below whose strength a text is not identified.
REJECTED = 0.005


@cache
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, or a space for all else."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def presence(text: str | None) -> np.ndarray | None:
    """Which hashed n-grams a whole text holds; None without a letter. Digits, signs and blanks count as one space."""
    if not text:
        return None
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    letter = points != 32
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.concatenate(([32], points[keep], [32])).astype(np.uint64)
    there = np.zeros(SLOTS, bool)
    rolled = np.zeros(len(points), np.uint64)
    for n in ORDERS:
        if len(points) < n:
            break
        rolled = rolled[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        there[((rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)] = True
    return there


def kernel(rows: np.ndarray, landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Presence kernel of texts against landmarks: shared n-grams over the root of the product of their numbers."""
    dense = rows.astype(np.float32)
    return dense @ landmarks / np.sqrt(np.maximum(dense.sum(axis=1), 1)[:, None] * sizes[None, :])


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # packed bits, one row a landmark
    whiten: np.ndarray
    ridge: np.ndarray
    floor: float = 0.0

    def unpacked(self) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return np.ascontiguousarray(bits.T), np.maximum(bits.sum(axis=1), 1)

    def responses(self, rows: np.ndarray, ready: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Responses of all languages' regressions, and the strength of the answer.

        Strength is the share of a text's kernel norm that the landmarks explain, times the lead of the best response over
        the next (with one language, the share alone). Neither grows or shrinks with the number of languages.
        """
        spread = kernel(rows, *ready).astype(float) @ self.whiten
        response = np.column_stack([spread, np.ones(len(rows))]) @ self.ridge
        top = np.sort(response, axis=1)
        return response, (spread**2).sum(axis=1) * (top[:, -1] - top[:, -2] if top.shape[1] > 1 else 1.0)

    def predict(self, texts: list[str | None], ready: tuple[np.ndarray, np.ndarray]) -> tuple[list[str], np.ndarray]:
        """The best language of each text and the response of its regression, cut to 0 to 1; `und` and 0 without letters."""
        rows = [presence(t) for t in texts]
        at = [i for i, r in enumerate(rows) if r is not None]
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if at and self.languages:
            response = self.responses(np.stack([rows[i] for i in at]), ready)[0]
            best = response.argmax(axis=1)
            score[at] = np.clip((response[np.arange(len(at)), best] + 1) / 2, 0, 1)
            for i, k in zip(at, best, strict=True):
                names[i] = self.languages[k]
        return names, score

    def identified(self, texts: list[str | None], ready: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Whether the strength of each text reaches the floor; never for texts without letters. A model that has learned no
        language rejects no other text."""
        rows = [presence(t) for t in texts]
        at = [i for i, r in enumerate(rows) if r is not None]
        told = np.zeros(len(texts), bool)
        told[at] = not self.languages
        if at and self.languages:
            told[at] = self.responses(np.stack([rows[i] for i in at]), ready)[1] >= self.floor
        return told


def fit(docs: DataFrame, learn: Column, seed: int = 3) -> LanguageModel:
    """Fits on a bounded sample of texts with a language: TRAIN_DOCS over the number of languages of each, EACH_LEAST at
    least, so every language seen is learned, however rare. More than MOST_LANGUAGES raise a ValueError.

    `learn` says over doc_id which rows may be learned from. Of each language the texts of least seeded hash of doc_id and
    text are taken, each once however often its row repeats; landmarks are the first of them, language by language in
    turn. Only lang and text are read, for labels and features. The sample, of bounded size, and one row a language reach
    the driver. Null and empty texts, texts without letters, and rows of null lang or doc_id teach nothing; if no row is
    left, an idle model is returned.
    """
    mark = F.xxhash64(F.lit(seed), "doc_id", "text")
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    languages = known.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    idle = LanguageModel([], np.zeros((0, SLOTS // 8), np.uint8), np.zeros((0, 0)), np.zeros((1, 0)))
    if not languages:
        return idle
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in column lang")
    each = max(EACH_LEAST, TRAIN_DOCS // languages)
    # Ids and hashes only; a task passes on no more than `each` rows a language.
    first = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "doc_id"))
    chosen = settled(known.select("lang", "doc_id", mark.alias("drawn")).distinct().withColumn("turn", first).where(F.col("turn") <= each).drop("turn"))

    def sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [presence(t) for t in pdf["text"]]
            ok = [i for i, r in enumerate(rows) if r is not None]
            packed = [np.packbits(rows[i]).tobytes() for i in ok]
            yield pdf.iloc[ok][["doc_id", "lang", "drawn"]].assign(bits=packed)

    texts = known.select("lang", "doc_id", mark.alias("drawn"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), ["lang", "doc_id", "drawn"], "left_semi").groupBy("lang", "doc_id", "drawn").agg(F.min("text").alias("text"))
    pdf = sample.select("doc_id", "lang", "drawn", "text").mapInPandas(sets, "doc_id long, lang string, drawn long, bits binary").toPandas()
    pdf = pdf.sort_values(["drawn", "doc_id", "lang"])
    pdf["turn"] = pdf.groupby("lang").cumcount()
    pdf = pdf[pdf["turn"] < each].sort_values(["turn", "lang"])
    if pdf.empty:
        return idle
    packed, labels = np.stack([np.frombuffer(b, np.uint8) for b in pdf["bits"]]), pdf["lang"].to_numpy()
    model = _learned(packed, labels)
    # Texts that a model learned from look stronger than others: one of every second turn judges the turns between.
    odd = pdf["turn"].to_numpy() % 2 == 1
    if odd.any():
        half, known = _learned(packed[~odd], labels[~odd]), packed[odd]
        ready = half.unpacked()
        strength = np.concatenate([half.responses(np.unpackbits(known[a : a + 256], axis=1), ready)[1] for a in range(0, len(known), 256)])
        model.floor = float(np.sort(strength)[int(REJECTED * len(strength))])
    return model


def _learned(packed: np.ndarray, labels: np.ndarray) -> LanguageModel:
    languages = sorted(set(labels))
    model = LanguageModel(languages, packed[: max(LANDMARKS, len(languages))], np.zeros((0, 0)), np.zeros((0, 0)))
    ready = model.unpacked()
    among = kernel(ready[0].T, *ready).astype(float)
    values, vectors = np.linalg.eigh(among)
    firm = values > 1e-6 * values.max()
    model.whiten = vectors[:, firm] / np.sqrt(values[firm])
    spread = np.concatenate([kernel(np.unpackbits(packed[a : a + 256], axis=1), *ready).astype(float) @ model.whiten for a in range(0, len(packed), 256)])
    x = np.column_stack([spread, np.ones(len(spread))])
    y = np.where(labels[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    model.ridge = np.linalg.solve(x.T @ x + 1e-2 * np.eye(x.shape[1]), x.T @ y)
    return model


def language_ids(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of each row of `docs` (doc_id, text), any others left aside.

    Whole texts count, however long. Null and empty texts and texts without a letter are `und` at score 0, as all texts are
    under an idle model. Equal responses go to the first language by name. Repeated rows and rows of null doc_id come out
    once each; an empty table gives an empty table.
    """
    return _with_language(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model).drop("text")


def _with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` with lang_pred and score put after its columns."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = model.unpacked()
        for pdf in parts:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                names, score = model.predict(list(part["text"]), ready)
                yield part.assign(lang_pred=names, score=score)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(run, f"{fields}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of `docs` whose language is told: texts of a strength that all but REJECTED of the known ones reach.

    Whole rows come back with the columns of `docs`, whatever their names, repeated ones as often as they were. Texts that
    are null, empty or without a letter go; under an idle model no others do. An empty table gives an empty table.
    """
    names = [f.name for f in docs.schema]
    told = F.pandas_udf(_teller(model), "boolean")
    return docs.where(told(F.col("text").cast("string"))).select(names)


def _teller(model: LanguageModel):
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = model.unpacked()
        for texts in parts:
            yield pd.Series(np.concatenate([model.identified(list(texts.iloc[at : at + 64]), ready) for at in range(0, max(len(texts), 1), 64)]))

    told.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return told
