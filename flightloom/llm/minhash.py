"""Document fingerprints by MinHash, near-duplicates by signature bands, and likeness along an id order."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.llm import nearcopies
from flightloom.llm.common import Shingles, mix64, settled

PERMUTATIONS, SHINGLE = 128, 5
#: Bands of minima by which texts meet.
BANDS, BAND_ROWS = 16, 5
_SEED = 7


class MinHasher:
    """Signatures of PERMUTATIONS universal hashes a*x + b modulo 2**32 (a odd: each one permutes the 32-bit values)."""

    def __init__(self, permutations: int = PERMUTATIONS) -> None:
        rng = np.random.default_rng(_SEED)
        self.a = (rng.integers(0, 2**32, permutations, np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, permutations, np.uint32)[:, None]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """uint32 minima of every permutation over the upper halves of 64-bit hashes, in blocks of bounded memory."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 2**32 - 1, np.uint32)
        for at in range(0, len(x), 4096):
            np.minimum(low, (self.a * x[None, at : at + 4096] + self.b).min(axis=1), out=low)
        return low


class Bands:
    """Keys of a signature's bands: `count` bands of `rows` minima. A pair of similarity s shares a band with a probability
    of 1 - (1 - s**rows)**count."""

    def __init__(self, count: int = BANDS, rows: int = BAND_ROWS) -> None:
        self.hasher, self.count, self.rows = MinHasher(count * rows), count, rows
        self.weights = mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.tables = mix64(np.arange(1001, 1001 + count, dtype=np.uint64))

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        low = mix64(self.hasher.signature(shingles).astype(np.uint64)).reshape(self.count, self.rows)
        return mix64((low * self.weights).sum(axis=1, dtype=np.uint64) ^ self.tables).view(np.int64)


def digits(signature: np.ndarray) -> str:
    """Four hex digits a permutation: its minimum, scrambled and cut to 16 bits."""
    return (mix64(signature.astype(np.uint64)) >> np.uint64(48)).astype(">u2").tobytes().hex()


def likeness(one: str, other: str) -> float:
    """The share of permutations on which two fingerprints agree, an estimate of the shingles' Jaccard similarity."""
    return float(np.mean(np.frombuffer(bytes.fromhex(one), ">u2") == np.frombuffer(bytes.fromhex(other), ">u2")))


def minhash_near_duplicates(docs: DataFrame, similarity: float = nearcopies.ALIKE, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """nearcopies.classes() over texts whose signatures share a band: (doc_id, mark, node, component_id, kept) of each row of
    `docs` (doc_id, text) with a doc_id.

    A pair is a link if it shares a band and the exact Jaccard similarity of the five-word shingles reaches `similarity`.
    Of pairs at 0.8, 1 in 600 shares none of 16 bands of 5. Null and empty texts form one class.
    """
    return nearcopies.classes(docs, Shingles(SHINGLE), Bands(bands, rows).keys, similarity)


#: Bytes of text that a range of edited_likeness() holds on the average, and places drawn a range to find its bounds.
RANGE_BYTES, DRAWN = 128 << 20, 20


def _bounds(units: DataFrame, ranges: int) -> list[tuple]:
    """Up to `ranges` - 1 places that part the rows of `units` (no_id, doc_id, mark, distinct) evenly: quantiles of places drawn by
    a hash, DRAWN a range. A place orders rows by descending id, those without one last, then by descending hash of the text; ~x falls
    where x rises, at both ends of the longs too."""
    share = min(1.0, DRAWN * ranges / max(units.count(), 1))
    drawn = F.pmod(F.xxhash64(F.lit(_SEED), "doc_id", "mark"), F.lit(1_000_000)) < int(share * 1_000_000) + 1
    places = units.where(drawn).select("no_id", F.bitwise_not("doc_id").alias("down"), F.bitwise_not("mark").alias("then")).toPandas().sort_values(["no_id", "down", "then"])
    chosen = places.iloc[sorted({len(places) * i // ranges for i in range(1, ranges)})] if len(places) else places
    return sorted({(bool(a), int(b), int(c)) for a, b, c in chosen.itertuples(index=False)})


def edited_likeness(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints each text of `docs` (doc_id, text) and its edited text, and compares them, and with the next text.

    The next document is the one with the next smaller doc_id (null ids come last), after the last one the first; the
    edited text swaps the last third of the code points, rounded down, for as many from the start of the next text.
    Null texts count as empty. Rows of one doc_id are ordered by a hash of their text, equal ones follow each other. A
    single row is its own next one; an empty table gives an empty table. Whole texts count, however long.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    Rows are dealt into ranges of (doc_id, hash of the text) of about `range_bytes` each and sorted within them, so texts are
    shuffled once and streamed, and the rows of one id spread like any others. The first row of each range goes to the
    range before it as well; those are as many rows as ranges. Rows equal in id and text travel once and are multiplied
    at the end: all but the last of them have themselves as the next.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").isNull().alias("no_id"), nearcopies.text_mark().alias("mark"))
    unit = ["no_id", "doc_id", "mark"]
    units = settled(rows.groupBy(*unit).agg(F.count("*").alias("copies"), F.sum(F.octet_length("text")).alias("bytes")))
    size = units.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), size // range_bytes + 1)
    bounds = _bounds(units, ranges)

    def range_of(no_id: pd.Series, down: pd.Series, then: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, place) for place in zip(no_id, down, then, strict=True)], dtype="int32")

    place = [F.col("no_id"), F.bitwise_not("doc_id"), F.bitwise_not("mark")]
    dealt_to = F.pandas_udf(range_of, "int")(*place)
    again = settled(units.where("copies > 1").select(*unit, "copies"))
    if again.isEmpty():
        once = rows.withColumn("copies", F.lit(1).cast("long"))
    else:
        known = F.broadcast(again) if again.count() <= nearcopies.WANTED else again
        alone = rows.join(known.drop("copies"), unit, "left_anti").withColumn("copies", F.lit(1).cast("long"))
        once = alone.unionByName(rows.join(known, unit).dropDuplicates(unit))
    dealt = once.withColumn("range", dealt_to)
    # One row a range reaches the driver: the number of ranges is bounded above.
    tops = units.withColumn("range", dealt_to).groupBy("range").agg(F.min(F.struct(*place)).alias("top")).collect()
    first = {r["range"]: (r["top"][0], ~r["top"][1], ~r["top"][2]) for r in tops}
    filled = sorted(first)
    extra = [(*first[r], filled[i - 1]) for i, r in enumerate(filled)]
    ahead = spark.createDataFrame(extra or [(False, 0, 0, -1)], "no_id boolean, doc_id long, mark long, range int")
    copies = once.join(F.broadcast(ahead), unit)
    cols = ["range", "later", "doc_id", "mark", "text", "no_id", "copies"]
    both = dealt.withColumn("later", F.lit(False)).select(cols).union(copies.withColumn("later", F.lit(True)).select(cols))
    placed = both.repartitionById(len(bounds) + 1, F.col("range").cast("int")).sortWithinPartitions("range", "later", "no_id", F.desc("doc_id"), F.desc("mark"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, shingles = MinHasher(), Shingles(SHINGLE)
        print_of = lambda text: digits(hasher.signature(shingles.of(text)))
        held: tuple | None = None

        def row(doc_id, text, print_, next_text, next_print, copies) -> tuple:
            cut = len(text) // 3
            edited = text[: len(text) - cut] + next_text[:cut] if cut else text
            edited_print = print_of(edited) if cut else print_
            return doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), print_, edited_print, likeness(print_, edited_print), likeness(print_, next_print), copies

        for pdf in parts:
            out = []
            for place, later, doc_id, text, no_id, copies in zip(*(pdf[c] for c in ("range", "later", "doc_id", "text", "no_id", "copies")), strict=True):
                print_ = print_of(text)
                if held is not None and held[0] == place:
                    out.append(row(*held[1:], text, print_, 1))
                held = None if later else (place, None if no_id else doc_id, text, print_)
                if copies > 1 and not later:
                    out.append(row(*held[1:], text, print_, copies - 1))
            yield pd.DataFrame(out, columns=_EDITED).astype({"doc_id": "Int64"})

    made = placed.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long")
    spread = made.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return spread.select(*_EDITED[:-1])


_EDITED = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "copies"]
