"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.sources.shared import fresh_folder, remove_folder

#: A word is a run of code points outside these (space, tab to carriage return).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Entries after which a task forgets the word hashes that it has looked up.
CACHED_WORDS = 60_000
#: Rows and bytes of texts that a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def modest_batches(spark: SparkSession) -> SparkSession:
    """Lowers this session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES: whole texts are long, and Spark's default of
    10,000 rows would hold tens of megabytes in every worker, several times over."""
    rows, size = (f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if not 0 < in_bytes(spark.conf.get(size)) <= BATCH_BYTES:
        spark.conf.set(size, BATCH_BYTES)
    return spark


def in_bytes(size: str) -> int:
    """A size as Spark's settings write it: digits, and k, m, g, t or p, with or without a b."""
    found = re.fullmatch(r"(-?\d+)([kmgtp]?)i?b?", size.strip().lower())
    if not found:
        raise ValueError(f"no size in bytes: {size!r}")
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ")


def settled(df: DataFrame) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it again: cuts lineage, outlives lost executors. The folder goes
    when the process ends, or when forget() says that nothing reads it any more."""
    path = fresh_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what settled() wrote, once nothing reads it any more: all that came of it is written itself."""
    for df in tables:
        remove_folder(df.sparkSession, df.settled_at)


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str, ties: list[str] | None = None) -> DataFrame:
    """`df` with the place (long, from 1) of each row among those of equal `keys` (null is a key), by `order`, then `ties`, nulls
    first. Rows are dealt by ranges of keys and order, so one key's rows spread over many tasks: each range counts its own, and
    begins where the ranges before it end. A range has at most one key that began before it: that bounds the broadcast."""
    dealt = settled(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", *keys).orderBy(*order, *(ties or ()))
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), before.alias("_before")).where("_before > 0")
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = dealt.withColumn(name, F.row_number().over(own).cast("long")).join(F.broadcast(starts), same, "left")
    return ranked.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).select(*df.columns, name)


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo `parts`; null ids fall in fold 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts, F.lit(0))


def hash_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """(key) of at most `rows` distinct keys, chosen by a seeded hash: the same ones at every run and partitioning, however
    often a key repeats. Keys alone are shuffled, once each from a task; few of them reach the final sort."""
    keys = df.select(key).distinct()
    total = keys.count()
    if total <= rows:
        return keys
    steps = 1_000_000
    share = min(steps, int(steps * 1.2 * rows / total) + 100)
    drawn = F.xxhash64(F.lit(seed), F.col(key))
    return keys.where(F.pmod(drawn, F.lit(steps)) < share).orderBy(drawn, key).limit(rows)


def one_text_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in `ids` (doc_id distinct, bounded: it is broadcast): of an id's texts the one with the
    least hash, so there are no more rows than ids, however often one repeats."""
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8, case kept. bytes.split() parts at exactly the six separators of WORD_PATTERN."""
    return text.encode("utf-8", "replace").split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered within a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Distinct 64-bit hashes of a text's word shingles, sorted; fewer words than a shingle make one, no words one of their
    own. With `lower`, A-Z count as a-z."""

    def __init__(self, words: int = 5, lower: bool = False) -> None:
        self.size, self.lower, self.known = words, lower, WordHashes()
        self.weights = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text.lower() if text and self.lower and text.isascii() else text)
        if self.lower and text and not text.isascii():
            words = [w.lower() for w in words]  # of bytes: A-Z only
        if not words:
            return np.zeros(1, np.uint64)
        hashes = self.known.array(words)
        k = min(self.size, len(words))
        total = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            total += hashes[j : len(words) - k + 1 + j] * self.weights[j]
        return np.unique(mix64(total))


class RollingHash:
    """Polynomial hashes modulo 2**64 of word ranges, all ranges of a text at once."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 2**64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        """prefix[j] - prefix[i] identifies words i to j, once scaled by `up[size - j]`-like powers; see `ranges`."""
        n = len(hashes) + 1
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = np.full(size, self.BASE, np.uint64)
            back = np.full(size, self.INVERSE, np.uint64)
            steps[0] = back[0] = 1
            self.up, self.down = np.cumprod(steps, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        total = np.zeros(n, np.uint64)
        np.cumsum(hashes * self.down[: n - 1], dtype=np.uint64, out=total[1:])
        return total

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words from start to end (exclusive) for each pair; equal words give equal hashes."""
        return mix64((prefix[end] - prefix[start]) * self.up[start])


def batches(pdf_size: int, step: int) -> Iterator[slice]:
    for at in range(0, pdf_size, step):
        yield slice(at, min(at + step, pdf_size))
