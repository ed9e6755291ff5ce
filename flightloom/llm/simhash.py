"""SimHash near-duplicates found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.llm import nearcopies
from flightloom.llm.common import Shingles, mix64, settled
from flightloom.llm.components import components
from flightloom.llm.minhash import Bands

BITS, RADIUS = 64, 2
#: The radius at which documents are dropped as near copies.
DEDUP_RADIUS = 4
#: MinHash bands by which texts meet beyond the radius: BANDS of BAND_ROWS minima; a pair of 0.8 meets in none with 5 in 100,000.
BANDS, BAND_ROWS = 25, 5
#: Fingerprints that one bucket may hold before it is dealt out again under finer masks.
BUCKET = 256


def shingle_hashes(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included, A-Z lower-cased; fewer words: of all; no words: empty."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    k = min(words_per_shingle, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)),
        np.uint64,
        n - k + 1,
    )


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """The 64 majority bits of the hashes of a text's word shingles; no words: 0."""
    return majority(shingle_hashes(text, words_per_shingle))


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of `docs` (doc_id, text, any others); fp is the fingerprint as a signed long."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            fps = np.fromiter((fingerprint(t, words_per_shingle) for t in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, fp long")


def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """2**(radius + 1) - 1 masks over the bits set in `free`; any `radius` bits are all left out by one of the masks.

    The j-th free bit gets one of the non-zero vectors of radius + 1 bits; mask v keeps the bits whose vector has an odd
    product with v. For `radius` bits some v other than zero has an even product with all their vectors, so two values
    that differ in no other bits are equal under that mask.
    """
    count = 2 ** (radius + 1) - 1
    at = [i for i in range(BITS) if free >> i & 1]
    return [sum(1 << i for j, i in enumerate(at) if ((j % count + 1) & v).bit_count() & 1) for v in range(1, count + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _near_in_bucket(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all of a bucket's values that are connected through pairs within the radius."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (low == label).all():
            break
        label = low
    return [(int(fps[r]), int(fps[i])) for i, r in enumerate(label) if r != i]


def _bucket_links(keyed: DataFrame, radius: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [x for fps in pdf["fps"] for x in _near_in_bucket(np.asarray(fps, np.int64).view(np.uint64), radius)]
            yield pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["u", "v"])

    lists = keyed.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return lists.select("fps").mapInPandas(run, "u long, v long")


def links_within(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect all distinct values of column fp which lie within `radius` bits, directly or by others.

    Level 1 deals every value into tables by masks that keep about half of the bits. Buckets of more than BUCKET values
    are dealt out again by masks over the bits still free, twice at most: then 7 bits or fewer are free and a bucket has
    at most 128 values. So no bucket is compared pair by pair beyond its bound, and no link is lost.
    """
    everything, spark = (1 << BITS) - 1, distinct.sparkSession
    tables = list(enumerate(covering_masks(everything, radius)))
    count = len(tables)
    keyed = distinct.select("fp", F.inline(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in tables])))
    found: list[DataFrame] = []
    for level in range(3):
        last = level == 2
        if not last:
            crowded = settled(keyed.groupBy("t", "key").count().where(F.col("count") > BUCKET).select("t", "key"))
            last = crowded.isEmpty()
        if last:
            found.append(_bucket_links(keyed, radius))
            break
        found.append(_bucket_links(keyed.join(crowded, ["t", "key"], "left_anti"), radius))
        tables = [(count * i + j, m | finer) for i, m in tables for j, finer in enumerate(covering_masks(everything & ~m, radius))]
        # One row a mask: count**2 or count**3 rows whatever the input.
        masks = F.broadcast(spark.createDataFrame([(i, _signed(m)) for i, m in tables], "t int, mask long"))
        rest = keyed.join(crowded, ["t", "key"], "left_semi").select("fp", F.explode(F.sequence(F.col("t") * count, F.col("t") * count + (count - 1))).alias("t"))
        keyed = rest.join(masks, "t").select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    return reduce(DataFrame.union, found).distinct()


def simhash_components(docs: DataFrame, words_per_shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and n_same for each row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable over links of `radius` differing bits or fewer; n_same is the number of
    rows with the same fingerprint. Null and empty texts have fingerprint zero and are linked like any other. Repeated
    rows come out once each. Rows of null doc_id are kept; they do not name a component unless all its ids are null.
    """
    fps = settled(fingerprints(docs, words_per_shingle))
    classes = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_same")))
    found = components(links_within(classes.select("fp"), radius))
    named = found.withColumnRenamed("node", "fp").join(classes, "fp")
    roots = named.groupBy("root").agg(F.min("rep").alias("low"))
    low = named.select("fp", "root").join(roots, "root").select("fp", "low")
    classes = settled(classes.join(low, "fp", "left").select("fp", "n_same", F.coalesce("low", "rep").alias("component_id")))
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def near_copy_classes(docs: DataFrame, words_per_shingle: int = 5, radius: int = DEDUP_RADIUS, alike: float = nearcopies.ALIKE) -> DataFrame:
    """nearcopies.classes() over texts that meet by their fingerprints' covering masks (certain within `radius` bits) or by
    MinHash bands (likely for any pair that alike). A-Z count as a-z; repeats within a text count once."""
    masks = np.array(covering_masks((1 << BITS) - 1, radius), np.uint64)
    tables = mix64(np.arange(1, len(masks) + 1, dtype=np.uint64))
    bands = Bands(BANDS, BAND_ROWS)

    def keys(shingles: np.ndarray) -> np.ndarray:
        return np.concatenate((mix64((masks & np.uint64(majority(shingles))) ^ tables).view(np.int64), bands.keys(shingles)))

    return nearcopies.classes(docs, Shingles(words_per_shingle, lower=True), keys, alike)


def simhash_dedup(docs: DataFrame, words_per_shingle: int = 5, radius: int = DEDUP_RADIUS, alike: float = nearcopies.ALIKE) -> DataFrame:
    """The rows of `docs` that stay: of each class of near copies the row with the smallest doc_id.

    Near copies are texts whose distinct five-word shingles have a Jaccard similarity of `alike` or more, and what these
    connect. Texts count, not ids: rows of one doc_id with unlike texts all stay, each unless it is a near copy of another.
    Rows that repeat the kept doc_id and text collapse to one. Null and empty texts and texts without words are copies of
    each other. Of rows with a null doc_id none is dropped, since they cannot be told apart; they connect nothing. Columns
    are those of `docs`, whatever their names. An empty table gives an empty table.
    """
    return nearcopies.one_of_each(docs, near_copy_classes(docs, words_per_shingle, radius, alike))
