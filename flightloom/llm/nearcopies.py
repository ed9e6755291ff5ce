"""Near copies: texts that meet in a bucket, verified by the Jaccard similarity of their shingles, and what these connect."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.llm.common import Shingles, settled
from flightloom.llm.components import components

#: The Jaccard similarity that makes near copies.
ALIKE = 0.8
#: Nodes of a bucket that stand on either side of one comparison.
BUCKET = 256
#: Rows of ids that are broadcast to find their texts (24 bytes each); more are joined by a shuffle.
WANTED = 500_000
#: Least hashes of a shingle set that its sketch holds: so many, or a quarter of them where that is more, but no more than the
#: second number. A set and one unlike it, known by a quarter, cannot be alike whatever the rest holds.
SKETCH, SKETCH_MOST = 128, 16_384
#: From the distinct shingle hashes of a text to the buckets in which it meets others.
Keys = Callable[[np.ndarray], np.ndarray]


def text_mark() -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _set_id(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def shingle_sets(docs: DataFrame, shingles: Shingles, keys: Keys) -> DataFrame:
    """(doc_id, mark, node, n, keys, sketch) of each row with a doc_id: node identifies the set of distinct shingles, n is its
    size, keys are the buckets where it meets others, sketch its least hashes, cut to 32 bits."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            sets = [shingles.of(t) for t in pdf["text"]]
            yield pdf[["doc_id", "mark"]].assign(node=[_set_id(x) for x in sets], n=[len(x) for x in sets], keys=[keys(x) for x in sets], sketch=[(x[: min(max(SKETCH, len(x) // 4), SKETCH_MOST)] >> np.uint64(32)).astype(np.uint32).tobytes() for x in sets])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_mark().alias("mark"))
    return rows.mapInPandas(run, "doc_id long, mark long, node long, n long, keys array<long>, sketch binary")


def _alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingles: Shingles, alike: float) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose shingle sets have a Jaccard similarity of `alike` or more.

    Only texts of candidates are read again, by the least (doc_id, mark) of their node; a set is 8 bytes a shingle.
    """
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = settled(nodes.join(needed, "node", "left_semi").select("rep.doc_id", "rep.mark"))
    wanted = F.broadcast(wanted) if wanted.count() <= WANTED else wanted

    def sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [shingles.of(t) for t in pdf["text"]]
            yield pd.DataFrame({"node": [_set_id(x) for x in found], "shingles": [x.view(np.int64) for x in found]})

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_mark().alias("mark")).join(wanted, ["doc_id", "mark"], "left_semi").drop("mark")
    # Repeated rows give their set more than once.
    found = settled(texts.mapInPandas(sets, "node long, shingles array<long>").dropDuplicates(["node"]))
    sized = pairs.join(found.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(found.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    both = F.size(F.array_intersect("a", "b"))
    return settled(sized.where(both >= alike * (F.size("a") + F.size("b") - both)).select("u", "v"))


def sketched(one: list[np.ndarray], other: list[np.ndarray], sizes: np.ndarray, others: np.ndarray, alike: float) -> np.ndarray:
    """Which pairs of sets can have a Jaccard similarity of `alike`, by their sketches (len(one) x len(other)). None that has is
    left out.

    Up to the lesser of both sketches' greatest hashes both sets are known in full: how many they share there, plus all that
    the one with fewer unknown hashes may share beyond, bounds what they have in common.
    """
    every, at = np.unique(np.concatenate([*one, *other]), return_inverse=True)
    lists = [*one, *other]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    often = np.bincount(at, minlength=len(every)) > 1
    column = (np.cumsum(often) - 1)[at]
    both = np.zeros((len(one), len(other)), np.float32)
    for low in range(0, max(int(often.sum()), 1), 1 << 15):  # hashes that several sets hold, so many at a time
        chosen = often[at] & (column >= low) & (column < low + (1 << 15))
        table = np.zeros((len(lists), min(1 << 15, max(int(often.sum()), 1))), np.float32)
        table[row[chosen], column[chosen] - low] = 1
        both += table[: len(one)] @ table[len(one) :].T
    # Hashes of one set may be equal in 32 bits: each such counts as shared.
    both += np.array([len(x) - len(np.unique(x)) for x in one], np.float32)[:, None]
    last = lambda x, n: np.inf if n <= len(x) else float(x[-1])
    up_one, up_other = (np.array([last(x, n) for x, n in zip(lists_, ns, strict=True)]) for lists_, ns in ((one, sizes), (other, others)))
    # A set's hash equal in 32 bits to the last one known may lie on either side of it: it counts as unknown.
    known = np.stack([np.where(np.isinf(np.minimum(u, up_other)), n, np.searchsorted(x, np.minimum(u, up_other), side="left")) for x, u, n in zip(one, up_one, sizes, strict=True)])
    known_other = np.stack([np.where(np.isinf(np.minimum(u, up_one)), n, np.searchsorted(x, np.minimum(u, up_one), side="left")) for x, u, n in zip(other, up_other, others, strict=True)], axis=1)
    most = both + np.minimum(sizes[:, None] - known, others[None, :] - known_other)
    return most * (1 + alike) >= alike * (sizes[:, None] + others[None, :]) - 1e-6


def pairs_that_meet(met: DataFrame, alike: float) -> DataFrame:
    """Distinct pairs (u, v) of nodes that share a bucket of `met` (key, node, n, label, sketch) and not a label, whose sizes
    permit a similarity of `alike`, and whose sketches do: no pair of that similarity is left out.

    In each bucket the nodes that have not the most frequent label meet all its nodes; those that have it are connected
    already. Both are dealt into blocks of about BUCKET by a hash, and every block of the ones meets every block of the
    others, in rows of their own: the pairs do not depend on BUCKET.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for rows in pdf["rows"]:
                sides = [[r for r in rows if r["asks"] == asks] for asks in (True, False)]
                if not all(sides):
                    continue
                (n, label, node), (ns, labels, nodes) = ([np.array([r[k] for r in side], np.int64) for k in ("n", "label", "node")] for side in sides)
                prints, others = ([np.frombuffer(r["sketch"], np.uint32) for r in side] for side in sides)
                fits = np.minimum(n[:, None], ns[None, :]) >= alike * np.maximum(n[:, None], ns[None, :])
                # A node that asks and is asked as well meets each such node once.
                turn = ~np.array([r["rest"] for r in sides[1]], bool)[None, :] | (node[:, None] < nodes[None, :])
                i, j = np.nonzero(fits & turn & (label[:, None] != labels[None, :]) & sketched(prints, others, n, ns, alike))
                yield pd.DataFrame({"u": np.minimum(node[i], nodes[j]), "v": np.maximum(node[i], nodes[j])})

    counts = met.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("key").agg(F.sum("n").alias("many"), F.max(F.struct("n", "label")).alias("top")).where("top.n < many")
    own = met.join(most.select("key", "many", F.col("top.label").alias("main"), F.ceil(F.col("many") / BUCKET).alias("blocks"), F.ceil((F.col("many") - F.col("top.n")) / BUCKET).alias("chunks")), "key")
    own = own.withColumn("rest", F.col("label") != F.col("main"))
    place, upto = F.xxhash64("node", "key"), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = own.withColumn("asks", F.lit(False)).withColumn("i", F.pmod(place, F.col("blocks"))).withColumn("j", upto("chunks"))
    asking = own.where("rest").withColumn("asks", F.lit(True)).withColumn("j", F.pmod(place, F.col("chunks"))).withColumn("i", upto("blocks"))
    cells = asked.unionByName(asking).groupBy("key", "i", "j").agg(F.collect_list(F.struct("node", "n", "label", "sketch", "rest", "asks")).alias("rows"))
    return cells.select("rows").mapInPandas(run, "u long, v long").distinct()


def classes(docs: DataFrame, shingles: Shingles, keys: Keys, alike: float = ALIKE) -> DataFrame:
    """(doc_id, mark, node, component_id, kept) of each row with a doc_id: component_id is the smallest doc_id reachable
    over pairs of texts whose distinct shingles have a Jaccard similarity of `alike` or more and which meet in a bucket;
    `kept` says whether the row's doc_id and mark are the least of its class.

    Equal sets are one node. Each bucket first compares its nodes with one of them; then nodes which that leaves unconnected
    are compared pair by pair, as far as sizes and sketches permit. Every link rests on the texts' whole sets. What is not
    connected and meets is compared, so groups of copies, however large, cost a few comparisons a node, and only texts that
    nearly alike without being so cost more.
    """
    rows = settled(shingle_sets(docs, shingles, keys))
    nodes = settled(rows.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key")
    met = settled(keyed.join(shared, "key"))
    # One order of nodes for all buckets: the nodes of a group that meet often have few leads among them.
    leads = met.groupBy("key").agg(F.min(F.struct(F.xxhash64("node"), "node", "n")).alias("lead"))
    fits = F.least("n", "lead.n") >= alike * F.greatest("n", "lead.n")
    star = met.join(leads, "key").where((F.col("node") != F.col("lead.node")) & fits)
    star = settled(star.select(F.least("node", "lead.node").alias("u"), F.greatest("node", "lead.node").alias("v")).distinct())
    links = _alike(star, docs, nodes, shingles, alike)
    labels = components(links).withColumnRenamed("root", "label")
    apart = met.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(nodes.select("node", "sketch"), "node")
    rest = settled(pairs_that_meet(apart, alike).join(star, ["u", "v"], "left_anti"))
    ends = components(links.union(_alike(rest, docs, nodes, shingles, alike)))
    named = ends.join(nodes.select("node", "rep"), "node")
    low = named.join(named.groupBy("root").agg(F.min("rep").alias("low")), "root").select("node", "low")
    least = settled(nodes.select("node", "rep").join(low, "node", "left").select("node", F.coalesce("low", "rep").alias("low")))
    kept = F.struct("doc_id", "mark") == F.col("low")
    return rows.select("doc_id", "mark", "node").join(least, "node").select("doc_id", "mark", "node", F.col("low.doc_id").alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: of each class of `found` the one of least doc_id and mark, and all of null doc_id.

    Rows that repeat the kept doc_id and text collapse to one, whichever comes first by a hash of the whole row. Columns
    are those of `docs`.
    """
    names = docs.columns
    kept = settled(found.where("kept").groupBy("doc_id", "mark").agg(F.count("*").alias("many")))
    whole = F.struct(*[F.col(f"`{n}`") for n in names])
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), whole.alias("row"))
    once = rows.join(kept.where("many = 1").drop("many"), ["doc_id", "mark"]).select("row")
    out = once.union(docs.where(F.col("doc_id").isNull()).select(whole.alias("row")))
    repeated = kept.where("many > 1").drop("many")
    if not repeated.isEmpty():
        again = rows.join(repeated, ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        out = out.union(again.select("row"))
    return out.select("row.*")
