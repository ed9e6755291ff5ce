"""Repeated word passages found through a compacted de Bruijn graph, and their removal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightloom.llm.common import RollingHash, WordHashes, mix64, settled, words_of

WINDOW, ANCHOR = 50, 8
_PLACE = np.uint64((1 << 24) - 1)
_CHUNK = 1 << 20


class Paths:
    """Cuts a text's edges (windows of WINDOW words, between nodes of one word less) into paths by their anchors.

    The anchor of a window is its ANCHOR-word piece with the smallest hash, the leftmost of equals: it depends on the
    window's words only. Consecutive windows with the same anchor form one path, so equal windows of any two texts lie on
    paths with equal anchors, and paths can be gathered by anchor.
    """

    def __init__(self, window: int = WINDOW, anchor: int = ANCHOR) -> None:
        self.window, self.anchor = window, anchor
        self.words, self.rolling = WordHashes(), RollingHash()

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """anchor hash, shape, first and last window start of each path; the rolling prefix of the text. The shape is where
        the anchor stands in the path and how many windows it has."""
        prefix = self.rolling.prefix(hashes)
        n, wide = len(hashes) - self.window + 1, self.window - self.anchor + 1
        if n < 1:
            empty = np.zeros(0, np.int64)
            return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, prefix
        at = np.arange(len(hashes) - self.anchor + 1)
        pieces = self.rolling.ranges(prefix, at, at + self.anchor)
        places = np.empty(n, np.int64)
        for low in range(0, n, _CHUNK):
            part = pieces[low : low + _CHUNK + wide - 1]
            least = (mix64(part) & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
            span = 1
            while 2 * span <= wide:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if wide > span:
                least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
            places[low : low + _CHUNK] = (least & _PLACE).astype(np.int64) + low
        turns = np.flatnonzero(np.diff(places)) + 1
        first = np.concatenate(([0], turns))
        last = np.concatenate((turns - 1, [n - 1]))
        place = places[first]
        shape = ((place - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
        return pieces[place], shape, first, last, prefix


class Bytes:
    """Hashes of word ranges from their bytes, which have nothing in common with the rolling hash of the anchors."""

    def __init__(self, words: list[bytes]) -> None:
        self.joined = b" ".join(words)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1

    def hashes(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros(0, np.uint64)
        starts = np.where(first > 0, self.ends[first - 1] + 1, 0)
        ends = self.ends[stop - 1]
        return np.fromiter((xxhash.xxh3_64_intdigest(self.joined[a:b], 10) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(first))


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.withColumn("doc_key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))


def _distinct(rows: DataFrame) -> DataFrame:
    """Each doc_key once: rows that repeat a doc_id and its text say nothing new, and would meet each other. Only those are
    shuffled, one a task; where none repeats, rows stay as they are."""
    again = settled(rows.groupBy("doc_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_key"))
    if again.isEmpty():
        return rows
    return rows.join(again, "doc_key", "left_anti").unionByName(rows.join(again, "doc_key", "left_semi").dropDuplicates(["doc_id", "doc_key"]))


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_key, start, stop): word ranges of windows that also start in a document with a smaller doc_id.

    1. Every text is cut into paths, one row each: anchor, hash of its bytes and shape, source coordinates. 2. Path rows are
    aggregated to the distinct paths of each anchor with the smallest doc_id of each; anchors met once drop out. 3. A join
    brings this back to the coordinates. A path whose words also lie in a smaller document is repeated as a whole; repeated
    paths that always follow each other are compacted(), so a long passage is one span. An anchor with several distinct
    paths is a branching node: the first carriers of its paths are opened into single edges. 4. Edges are aggregated and
    joined in the same way, within their anchor. Equality rests on the hash of the anchor's words and on one of the bytes
    between the source coordinates, 64 bits each.
    """
    rows = _keyed(docs)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths = Paths(window, anchor)
        for pdf in parts:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                found = []
                for text in part["text"]:
                    words = words_of(text)
                    anchors, shape, first, last, _ = paths.of(paths.words.array(words))
                    found.append((anchors, mix64(Bytes(words).hashes(first, last + window) + mix64(shape + np.uint64(1))), first, last, np.arange(len(first))))
                count = [len(x[0]) for x in found]
                joined = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0)] * 5
                yield pd.DataFrame(
                    {
                        "anchor": joined[0].astype(np.uint64).view(np.int64),
                        "path": joined[1].astype(np.uint64).view(np.int64),
                        "first": joined[2].astype(np.int32),
                        "last": joined[3].astype(np.int32),
                        "turn": joined[4].astype(np.int32),
                        "doc_id": part["doc_id"].repeat(count).to_numpy(),
                        "doc_key": part["doc_key"].repeat(count).to_numpy(),
                    }
                )

    # Null ids are never smaller than another and have none smaller: such rows neither remove nor lose words.
    source = _distinct(rows.where(F.col("doc_id").isNotNull()))
    paths = settled(source.mapInPandas(cut, "anchor long, path long, first int, last int, turn int, doc_id long, doc_key long"))
    same = ["anchor", "path"]
    nodes = settled(paths.groupBy(*same).agg(F.min("doc_id").alias("lowest"), F.count("*").alias("n")))
    shared = nodes.groupBy("anchor").agg(F.count("*").alias("branches"), F.sum("n").alias("total")).where("total > 1")
    known = settled(nodes.join(shared.select("anchor", "branches"), "anchor").select(*same, "lowest", "branches"))
    located = settled(paths.join(known, same).where("lowest < doc_id or branches > 1"))
    repeated = located.where("lowest < doc_id").select(F.xxhash64(*same).alias("node"), "doc_key", "turn", "first", "last")
    whole = compacted(repeated).select("doc_key", F.col("first").alias("start"), (F.col("last") + window).alias("stop"))

    carriers = located.where("lowest = doc_id").groupBy("doc_key").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("paths"))

    def open_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for doc_id, doc_key, text, anchor_of, first, last in pdf.itertuples(index=False):
                first = np.asarray(first, np.int64)
                size = np.asarray(last, np.int64) - first + 1
                at = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                anchors = np.repeat(np.asarray(anchor_of, np.int64), size)
                edges = Bytes(words_of(text)).hashes(at, at + window).view(np.int64)
                yield pd.DataFrame({"anchor": anchors, "edge": edges, "start": at.astype(np.int32), "doc_id": doc_id, "doc_key": doc_key})

    opened = source.join(carriers, "doc_key").select("doc_id", "doc_key", "text", "paths.anchor", "paths.first", "paths.last")
    edges = settled(opened.mapInPandas(open_up, "anchor long, edge long, start int, doc_id long, doc_key long"))
    alike = ["anchor", "edge"]
    lowest = edges.groupBy(*alike).agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest")).where("lowest < highest").drop("highest")
    single = edges.join(lowest, alike).where("lowest < doc_id").select("doc_key", "start", (F.col("start") + window).alias("stop"))
    return whole.union(single)


def compacted(rows: DataFrame) -> DataFrame:
    """(doc_key, first, last): runs of rows (node, doc_key, turn, first, last) whose nodes always follow each other.

    A node that is always followed by one other, which always follows it, is linked to it. Links are followed to the head
    of their chain by pointer doubling: a join a round, as many rounds as the logarithm of the longest chain. Circles have
    no head; their nodes stay as they are.
    """
    order = Window.partitionBy("doc_key").orderBy("turn")
    beside = lambda f, step: F.when(f("turn").over(order) == F.col("turn") + step, f("node").over(order))
    rows = settled(rows.withColumn("after", beside(F.lead, 1)).withColumn("before", beside(F.lag, -1)))
    seen = rows.groupBy("node").agg(F.count("*").alias("n"), *[g(x).alias(f"{k}_{x}") for x in ("after", "before") for k, g in (("min", F.min), ("max", F.max), ("n", F.count))])
    always = lambda x: (F.col(f"n_{x}") == F.col("n")) & (F.col(f"min_{x}") == F.col(f"max_{x}"))
    ahead = seen.where(always("after")).select(F.col("node").alias("head"), F.col("min_after").alias("node"))
    links = settled(seen.where(always("before")).select("node", F.col("min_before").alias("head")).where("node <> head").join(ahead, ["node", "head"]).withColumn("steps", F.lit(1)))
    for _ in range(max(links.count(), 1).bit_length()):
        beyond = links.select(F.col("node").alias("head"), F.col("head").alias("further"), F.col("steps").alias("more"))
        if links.join(beyond, "head", "left_semi").isEmpty():
            break
        links = settled(links.join(beyond, "head", "left").select("node", F.coalesce("further", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    chains = links.join(links.select(F.col("node").alias("head")), "head", "left_anti")
    run = rows.join(chains, "node", "left").select("doc_key", F.coalesce("head", "node").alias("head"), (F.col("turn") - F.coalesce("steps", F.lit(0))).alias("begin"), "first", "last")
    return run.groupBy("doc_key", "head", "begin").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("head", "begin")


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of each row of `docs` (doc_id, text).

    A word goes if a window of `window` words covers it whose words also start in a document with a smaller doc_id, as
    the input stands. kept_text joins the words that stay by one space. Null and empty texts have no words. Texts shorter
    than a window stay whole. Rows with a null doc_id stay whole, and so do rows equal in doc_id and text.
    """
    spans = repeated_spans(docs, window, anchor).groupBy("doc_key").agg(F.collect_set(F.shiftleft(F.col("start").cast("long"), 32) + F.col("stop")).alias("spans"))

    def remove(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for doc_id, text, chosen in pdf.itertuples(index=False):
                words = words_of(text)
                if chosen is not None and len(chosen):
                    depth = np.zeros(len(words) + 1, np.int64)
                    ends = np.asarray(chosen, np.int64)
                    np.add.at(depth, ends >> 32, 1)
                    np.add.at(depth, ends & 0xFFFFFFFF, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
                else:
                    kept = words
                joined = b" ".join(kept)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8")))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    joined = _keyed(docs).join(spans, "doc_key", "left").select("doc_id", "text", "spans")
    return joined.mapInPandas(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
