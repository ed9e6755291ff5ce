"""Exact top-k search by inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom.llm.common import settled

#: Rows of an index block at most, and of its rows times components (8 bytes each); queries that travel in one row.
BLOCK, CELLS, GROUP = 131_072, 8_000_000, 256
SCALE = 256


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id, q) with q = floor(256 * x) of each component as a double; `row` numbers the rows, ids may repeat or be
    null. Rows whose vector is null or has a null or non-finite component are left out. The numbers are those of one run:
    settle the table before they are read twice."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull()).where(sound)
    q = F.transform(x, lambda c: F.floor(c * SCALE).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), q.alias("q"))


class Block:
    """The slices of up to BLOCK rows: bit b of every row's value of attribute d, less the attribute's least value."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, named: np.ndarray, low: np.ndarray, bits: np.ndarray, packed: np.ndarray) -> None:
        """Rows in order of their ids, those without one (not `named`) last; `packed` holds all slices, one after another."""
        self.row, self.ids, self.named, self.low, self.bits = rows, ids, named, low, bits.tolist()
        self.by_row = np.argsort(rows)
        width = -(-len(ids) // 64)
        every = packed.reshape(-1, width) if width else packed.reshape(int(bits.sum()), 0)
        at = np.concatenate(([0], np.cumsum(bits))).astype(int)
        self.slices = [[every[k] for k in range(at[d], at[d + 1])] for d in range(len(bits))]
        self.rows = _bitmap(np.ones(len(ids), bool))

    @classmethod
    def of(cls, rows: np.ndarray, ids: np.ndarray, named: np.ndarray, values: np.ndarray) -> Block:
        order = np.lexsort((rows, ids, ~named))
        rows, ids, named, values = rows[order], ids[order], named[order], values[order]
        low = values.min(axis=0) if values.size else np.zeros(values.shape[1], np.int64)
        shifted = (values - low).astype(np.uint64)
        bits = np.array([int(x).bit_length() for x in shifted.max(axis=0)] if values.size else [0] * values.shape[1], np.int64)
        slices = [_bitmap((shifted[:, d] >> np.uint64(b)) & np.uint64(1) != 0) for d, n in enumerate(bits.tolist()) for b in range(n)]
        return cls(rows, ids, named, low, bits, np.concatenate([*slices, np.zeros(0, np.uint64)]))

    def packed(self) -> dict[str, bytes]:
        slices = np.concatenate([x for d in self.slices for x in d] + [np.zeros(0, np.uint64)])
        return {"rows": self.row.tobytes(), "ids": self.ids.tobytes(), "named": self.named.tobytes(), "low": self.low.tobytes(), "bits": np.array(self.bits, np.int64).tobytes(), "body": slices.tobytes()}

    @classmethod
    def unpacked(cls, rows: bytes, ids: bytes, named: bytes, low: bytes, bits: bytes, body: bytes) -> Block:
        longs = [np.frombuffer(x, np.int64) for x in (rows, ids, low, bits)]
        return cls(longs[0], longs[1], np.frombuffer(named, bool), longs[2], longs[3], np.frombuffer(body, np.uint64))

    def scores(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the weighted sum, least first, and what to add to it. Negative weights take complemented slices."""
        columns: list[list[np.ndarray]] = []
        rest = 0
        for d, w in enumerate(weights[: len(self.bits)].tolist()):
            rest += w * int(self.low[d])
            if w < 0:
                rest += w * ((1 << self.bits[d]) - 1)
            size, a = abs(w), 0
            while size >> a:
                if size >> a & 1:
                    for b, piece in enumerate(self.slices[d]):
                        while len(columns) <= a + b:
                            columns.append([])
                        columns[a + b].append(~piece if w < 0 else piece)
                a += 1
        total: list[np.ndarray] = []
        at = 0
        while at < len(columns):
            column = columns[at]
            if at + 1 == len(columns) and len(column) > 1:
                columns.append([])
            while len(column) > 2:  # a full adder: three bitmaps of a weight become one, and one of the next weight
                x, y, z = column.pop(), column.pop(), column.pop()
                half = x ^ y
                column.append(half ^ z)
                columns[at + 1].append((x & y) | (half & z))
            if len(column) == 2:
                x, y = column
                columns[at + 1].append(x & y)
                column = [x ^ y]
            total.append(column[0] if column else np.zeros_like(self.rows))
            at += 1
        return total, rest

    def top(self, own: int, weights: np.ndarray, k: int) -> list[tuple[int, int | None]]:
        """(score, id) of the block's k best rows but row `own`, ties to the smaller id, rows without one last."""
        slices, rest = self.scores(weights)
        tied = self.rows.copy()
        at = np.searchsorted(self.row, own, sorter=self.by_row)
        if at < len(self.row) and self.row[self.by_row[at]] == own:
            at = self.by_row[at]
            tied[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        sure = np.zeros_like(tied)
        count = lambda x: int(np.bitwise_count(x).sum())
        if count(tied) > k:
            for piece in reversed(slices):
                both = sure | (tied & piece)
                n = count(both)
                if n > k:
                    tied &= piece
                else:
                    sure = both
                    tied &= ~piece
                    if n == k:
                        tied = np.zeros_like(tied)
                        break
        else:
            sure, tied = tied, np.zeros_like(tied)
        places = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
        chosen = places(sure)
        # Boundary rows have one score: rows stand in order of id, so the first ones are right.
        chosen = np.concatenate([chosen, places(tied)[: max(0, k - len(chosen))]]).astype(np.int64)
        word, bit = chosen // 64, (chosen % 64).astype(np.uint64)
        value = [rest] * len(chosen)
        for b, piece in enumerate(slices):
            on = (piece[word] >> bit) & np.uint64(1)
            value = [v + (1 << b) * int(x) for v, x in zip(value, on, strict=True)]
        return [(v, int(self.ids[i]) if self.named[i] else None) for v, i in zip(value, chosen, strict=True)]


def _bitmap(flags: np.ndarray) -> np.ndarray:
    return np.packbits(np.pad(flags, (0, -len(flags) % 64)), bitorder="little").view(np.uint64)


_SHAPE = "rows binary, ids binary, named binary, low binary, bits binary, body binary"


def _packed(rows: DataFrame, part: str, sliced: bool) -> DataFrame:
    """One row for each value of column `part`: its rows as slices, or as plain values. Parts are bounded by their making."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, pdf["q"]), default=0)
        values = np.zeros((len(pdf), width), np.int64)
        for i, q in enumerate(pdf["q"]):
            values[i, : len(q)] = q
        ids, named = pdf["id"].fillna(0).to_numpy(np.int64), pdf["id"].notna().to_numpy(bool)
        number = pdf["row"].to_numpy(np.int64)
        plain = {"rows": number.tobytes(), "ids": ids.tobytes(), "named": named.tobytes(), "low": b"", "bits": b"", "body": values.tobytes()}
        return pd.DataFrame([{part: pdf[part].iloc[0]} | (Block.of(number, ids, named, values).packed() if sliced else plain)])

    return rows.select(part, "row", F.col("id"), "q").groupBy(part).applyInPandas(pack, f"{part} long, {_SHAPE}")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other rows for each row of `vectors` where `is_query`.

    `is_query` is a condition over column id. Score: inner product of quantised() vectors; shorter vectors count as
    padded with zeros. Ids name rows but do not identify them: rows of one id are rows of their own, each asks for itself
    and finds the others, and rows without an id are found as null, after equal scores with one. An empty table gives an
    empty table. Component sizes are bounded by the sum of products fitting a long.

    The slices are built once, in blocks of about BLOCK rows, or of CELLS components where vectors are wide, and written. A block is then sent to one task, or to a few
    while there are fewer blocks than tasks, and the queries stream past it; so the index is shuffled once at scale, the
    queries once a block, and of each meeting only k rows leave. Every row is compared exactly.
    """
    spark = vectors.sparkSession
    rows = settled(quantised(vectors, id_col, vector_col))
    asked = rows.where(is_query)
    count, width = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    block = max(64, min(BLOCK, CELLS // max(width or 0, 1)))
    n_blocks, n_groups = max(1, -(-count // block)), max(1, -(-asked.count() // GROUP))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    lanes = max(1, min(n_groups, tasks // n_blocks))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    index = settled(_packed(rows.withColumn("block", deal(n_blocks, 1)), "block", True)).withColumn("lane", every(lanes))
    queries = settled(_packed(asked.withColumn("grp", deal(n_groups, 2)), "grp", False)).withColumn("block", every(n_blocks)).withColumn("lane", F.pmod("grp", F.lit(lanes)))
    columns = ["block", "lane", "asks", *[x.split()[0] for x in _SHAPE.split(", ")]]
    both = index.withColumn("asks", F.lit(False)).select(columns).union(queries.withColumn("asks", F.lit(True)).select(columns))
    # One partition a lane of a block, so that no task waits for another's lane.
    placed = both.repartition(max(tasks, n_blocks * lanes), "block", "lane").sortWithinPartitions("block", "lane", "asks")

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[int, int, Block] | None = None
        for pdf in parts:
            for block, lane, asks, *body in pdf.itertuples(index=False):
                if not asks:
                    held = (block, lane, Block.unpacked(*body))
                elif held is not None and held[:2] == (block, lane):
                    numbers, ids = (np.frombuffer(x, np.int64) for x in body[:2])
                    named, values = np.frombuffer(body[2], bool), np.frombuffer(body[5], np.int64).reshape(len(numbers), -1)
                    out = [(int(own), int(i) if known else None, s, found) for own, i, known, weights in zip(numbers, ids, named, values, strict=True) for s, found in held[2].top(int(own), weights, k)]
                    frame = pd.DataFrame(out, columns=["asker", "query_id", "score", "vec_id"])
                    yield frame.astype({"query_id": "Int64", "vec_id": "Int64"})

    met = placed.mapInPandas(meet, "asker long, query_id long, score long, vec_id long")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
