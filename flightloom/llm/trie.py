"""The prefix trie of conversations: which openings are shared, by whom, and what sharing them saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.llm.common import forget, rank_within, settled

NODE = ["conv_id", "depth"]
#: Ids joined to one text before a node's texts are read in order by one task.
CHUNK_IDS = 4_000


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): each conversation's turns, at 1 and on, by turn (null first), ties by role and text; null role
    or text is empty. Rows of null conv_id are left out: a node is named by an id."""
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rank_within(rows, ["conv_id"], ["turn"], "at", ties=["role", "text"]).drop("turn")


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that open alike, made from any: of conversation c the first h turns become those of c - c % group (all if
    it has fewer, none if it is absent), where h is the unsigned crc32 of c in decimals, modulo `heads`. % has the sign of c.
    Gives (conv_id) of all conversations and (conv_id, at, role, text) of their turns, at 1 and on."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    lengths = turns.groupBy("conv_id").agg(F.max("at").alias("n"))
    taken = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    sizes = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("has"))
    taken = settled(taken.join(sizes, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("head")))
    opening = turns.where(F.col("at") < heads).withColumnRenamed("conv_id", "base")
    lent = taken.where("head > 0").join(opening, "base").where("at <= head").select("conv_id", "at", "role", "text")
    own = turns.join(taken, "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("head")).alias("at"), "role", "text")
    return taken.select("conv_id"), lent.unionByName(own)


def _turn_key(role: Column, text: Column) -> Column:
    """32 bytes that stand for a turn: SHA-256 of its role and text, the role's length first."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def _ends(last: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) from (conv_id, depth, member): SHA-256 of the members' ids, ascending, comma-joined.

    Ids are dealt by ranges of (node, id); each range joins its ids in texts of CHUNK_IDS. One task reads a node's texts in
    order and keeps nothing but the hash: SHA-256 has no other way, but a text stands for thousands of rows.
    """
    placed = rank_within(last, NODE, ["member"], "at")
    chunk = F.floor((F.col("at") - 1) / CHUNK_IDS)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "member"))), lambda x: x["member"].cast("string")), ",")
    texts = placed.groupBy(*NODE, chunk.alias("chunk")).agg(ids.alias("ids"))

    def hashes(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for pdf in pdfs:
            rows = []
            for c, d, ids in zip(pdf["conv_id"], pdf["depth"], pdf["ids"], strict=True):
                if (c, d) == node:
                    state.update(b"," + ids.encode())
                else:
                    if state:
                        rows.append((*node, state.hexdigest()))
                    node, state = (c, d), hashlib.sha256(ids.encode())
            yield pd.DataFrame(rows, columns=[*NODE, "ends_sha256"])
        if state:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").mapInPandas(hashes, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row a node: a distinct
    sequence of first `depth` turns, named by its smallest member, from the textless root.

    `convs` (conv_id long, distinct) are the members, `turns` (conv_id, at, role, text) what they say, at 1, 2, 3 without gaps. Level by level
    the conversations that still share their node are grouped by (node, next turn), and the least id of a group names the
    new node. A conversation alone at its node needs no more levels: what is left of it is a chain of nodes with one member.
    Then, from the deepest level up, joins add up leaves and savings: (members - 1) times the UTF-8 bytes of the last text.

    A conversation without turns belongs to the root alone. No conversations: no nodes. Extra columns are left alone.
    """
    keyed = settled(turns.select("conv_id", "at", _turn_key(F.col("role"), F.col("text")).alias("turn_key"), F.octet_length("text").cast("long").alias("bytes")).repartitionByRange("at", "conv_id").sortWithinPartitions("at"))
    members = settled(convs.join(keyed.groupBy("conv_id").agg(F.max("at").alias("length")), "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length")))
    root = members.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("bytes"))
    levels = [settled(root)]
    top = levels[0].first()
    if top is None:
        return levels[0].select(*NODE, "parent_conv_id", "n_convs", *[F.col("n_convs").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.lit("").alias("ends_sha256"))
    live = [members.select("conv_id", F.lit(top["conv_id"]).cast("long").alias("node"))]
    while top["n_convs"] > 1:
        depth = len(levels)
        steps = live[-1].join(keyed.where(F.col("at") == depth).drop("at"), "conv_id")
        levels.append(settled(steps.groupBy("node", "turn_key").agg(F.min("conv_id").alias("least"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"))))
        shared = levels[-1].where("n_convs > 1").select("node", "turn_key", "least")
        if not shared.take(1):
            break
        live.append(settled(steps.join(shared, ["node", "turn_key"]).select("conv_id", F.col("least").alias("node"))))
    named = levels[:1] + [df.select(F.col("least").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), "n_convs", "bytes") for d, df in enumerate(levels) if d]
    # From the deepest level up: what the children add up to comes to their parent's own.
    summed: list[DataFrame] = []
    for df in reversed(named):
        own = (F.col("n_convs") - 1) * F.col("bytes")
        if summed:
            below = summed[-1].groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            df = df.join(below, "conv_id", "left")
        else:
            df = df.select("*", *[F.lit(None).cast("long").alias(c) for c in ("children", "leaves", "saved")])
        summed.append(settled(df.select(*NODE, "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (own + F.coalesce("saved", F.lit(0))).alias("saved_tokens"))))
    forget(*levels)
    upper = reduce(DataFrame.unionByName, summed)
    # Where members end: at a node of their own, or at one they share.
    last = reduce(DataFrame.unionByName, [df.withColumn("depth", F.lit(d).cast("long")) for d, df in enumerate(live)]).join(members.where("length >= 0"), "conv_id").where("length = depth")
    ends = _ends(last.select(F.col("node").alias("conv_id"), "depth", F.col("conv_id").alias("member")))
    shared = upper.where("n_convs > 1").join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))
    # A conversation that has parted from all others goes on alone: one node a turn, and the last is where it ends.
    alone = upper.where("n_convs = 1").join(members, "conv_id")
    more = (F.col("depth") < F.col("length")).cast("long").alias("n_children")
    end = F.sha2(F.when(F.col("depth") == F.col("length"), F.col("conv_id").cast("string")).otherwise("").cast("binary"), 256).alias("ends_sha256")
    one = F.lit(1).cast("long")
    tails = keyed.select("conv_id", F.col("at").cast("long").alias("depth")).join(alone.select("conv_id", "length", F.col("depth").alias("since")), "conv_id").where("depth > since")
    tails = tails.select(*NODE, F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), more, one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), end)
    return shared.unionByName(alone.select(*NODE, "parent_conv_id", "n_convs", more, "n_leaves", "saved_tokens", end)).unionByName(tails)
