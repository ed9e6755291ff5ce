"""Best-fit packing of documents into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.llm.common import settled
from flightloom.llm.mixing import word_count

CAPACITIES = (512, 1024, 2048, 4096)
#: What a bin costs besides its capacity, and pieces that one task packs together.
OPENING, SHARD = 32.0, 20_000


def variable_best_fit(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, opening: float = OPENING) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity) for each size, none above the largest capacity.

    Sizes are placed from the largest down, equal ones in the order given. A piece goes into the open bin that leaves the
    least room. Where none has room, a bin is opened at the permitted capacity with the least cost (capacity + opening)
    together with the cost of what then still waits: words that neither this bin nor the room of open bins holds, at the
    cheapest rate a word, one bin of the smallest capacity at least. In the end every bin shrinks to the smallest
    capacity that holds what it has.
    """
    caps = sorted(capacities)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    suffix = [0] * (len(order) + 1)
    for k in range(len(order) - 1, -1, -1):
        suffix[k] = suffix[k + 1] + sizes[order[k]]
    rate = min((c + opening) / c for c in caps)
    free = 0
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    place: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for k, i in enumerate(order):
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
            free -= left
        else:
            waits = size + max(0, suffix[k + 1] - free)
            left = min((c for c in caps if c >= size), key=lambda c: (c + opening + (max(rate * (waits - c), caps[0] + opening) if waits > c else 0), c))
            b = len(used)
            used.append(0)
        place[i] = (b, used[b])
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
            free += left - size
    final = [next(c for c in caps if c >= u) for u in used]
    return [(b, offset, final[b]) for b, offset in place]


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, opening: float = OPENING, shard: int = SHARD) -> DataFrame:
    """One row for each piece of each row of `docs` (doc_id, text): doc_id, copy, piece, start and n_words (word range),
    bin (shard and number), bin_offset, capacity and used.

    Sizes are words. A text longer than the largest capacity is cut into pieces of that capacity and a rest; nothing is
    dropped. Null texts and texts without words make one piece of size 0. Rows equal in doc_id and size are told apart by
    copy, from 1. Pieces are dealt by a hash of doc_id, copy and piece into shards of about `shard` pieces, each packed
    in one task; bins do not cross shards. Rows with a null doc_id are packed too.
    """
    largest = max(capacities)
    sized = docs.select(F.col("doc_id").cast("long"), word_count(F.col("text").cast("string")).alias("size"))
    rows = sized.groupBy("doc_id", "size").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / largest)))))
    start = F.col("piece") * largest
    pieces = settled(rows.select("doc_id", "copy", "piece", start.alias("start"), F.least(F.lit(largest).cast("long"), F.col("size") - start).alias("n_words")))
    shards = max(1, -(-pieces.count() // shard))
    capacities = tuple(capacities)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "copy", "piece", "n_words"], na_position="last").reset_index(drop=True)
        found = pd.DataFrame(variable_best_fit(pdf["n_words"].tolist(), capacities, opening), columns=["number", "bin_offset", "capacity"])
        out = pd.concat([pdf, found], axis=1)
        out["bin"] = out["shard"].astype(str) + "-" + out["number"].astype(str)
        out["used"] = out.groupby("number")["n_words"].transform("sum")
        return out[["doc_id", "copy", "piece", "start", "n_words", "bin", "bin_offset", "capacity", "used"]].astype({"doc_id": "Int64"})

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece", F.lit(13)), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(place, "doc_id long, copy long, piece long, start long, n_words long, bin string, bin_offset long, capacity long, used long")
