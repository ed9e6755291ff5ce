"""Reply trees as conversations: every path from a root to a leaf, best branches first, in one marked-up text each.

The template writes a turn as `<|im_start|>ROLE`, a newline, the text, `<|im_end|>` and a newline. Inside roles and texts every
`<`, k backslashes, `|` gets one backslash more, so no control string can arise from them and the escape can be undone. In roles
a backslash is written `\\b` and a newline `\\n` besides, so that the first newline ends the role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.llm.common import forget, rank_within, settled

START, END = "<|im_start|>", "<|im_end|>\n"
#: Roles whose texts a model learns to say.
LEARNED_ROLES = ("assistant",)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _same(a: DataFrame, b: DataFrame, left: str, right: str) -> Column:
    """Rows of one tree (null is a tree of its own) whose `left` in a is `right` in b."""
    return a["tree"].eqNullSafe(b["tree"]) & (a[left] == b[right])


def _linked(nodes: DataFrame, keep: int | None) -> DataFrame:
    """(tree, node, up, top, leaf, branch, role, text): `up` is the parent if it is there, `top` says that there is none, `leaf`
    that no node replies, `branch` is the place among the replies to one parent, or among the roots of a tree."""
    once = nodes.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min(F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("worst"), "parent", "role", "text")).alias("m")).select("tree", "node", "m.*")
    once = settled(once)
    links = once.select("tree", F.col("node").alias("parent_node")).alias("b")
    a = once.alias("a")
    there = a.join(links, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.parent") == F.col("b.parent_node")), "left").select("a.*", F.col("b.parent_node").alias("up"))
    answered = once.where("parent IS NOT NULL").select(F.col("tree").alias("asked_tree"), F.col("parent").alias("asked")).distinct()
    rows = there.join(answered, F.col("tree").eqNullSafe(F.col("asked_tree")) & (F.col("node") == F.col("asked")), "left").select("tree", "node", "up", "worst", F.col("up").isNull().alias("top"), F.col("asked").isNull().alias("leaf"), "role", "text")
    ranked = rank_within(rows, ["tree", "up"], ["worst", "node"], "branch")
    out = settled(ranked if keep is None else ranked.where(F.col("branch") <= keep))
    forget(once)
    return out


def _paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, steps) for each leaf with a root above it and each node on the way there, by doubling: the 2**k-th
    ancestors of all nodes, joined with themselves, give the next; each round doubles the length of every path."""
    jumps = [settled(nodes.where("up IS NOT NULL").select("tree", "node", "up"))]
    counts = [jumps[0].count()]
    while counts[-1] and (len(counts) < 2 or counts[-1] < counts[-2]):
        a, b = jumps[-1].alias("a"), jumps[-1].select("tree", F.col("node").alias("middle"), F.col("up").alias("far")).alias("b")
        jumps.append(settled(a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.middle"))).select("a.tree", "a.node", F.col("b.far").alias("up"))))
        counts.append(jumps[-1].count())
    pairs = nodes.where("leaf").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("steps"))
    if counts[-1]:  # as many have an ancestor 2**k as 2**(k-1) above: these stand on or below a cycle, which has no root
        endless = jumps[-1].select(F.col("tree").alias("t"), F.col("node").alias("n"))
        pairs = pairs.join(endless, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    for k, jump in enumerate(jumps):
        if not counts[k] or (counts[-1] and k == len(jumps) - 1):
            break
        j = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        further = pairs.join(j, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", F.col("up").alias("node"), (F.col("steps") + 2**k).alias("steps"))
        grown = settled(pairs.unionByName(further))
        if k:
            forget(pairs)
        pairs = grown
    forget(*jumps)
    return pairs


def reply_trees(nodes: DataFrame, keep: int | None = None, learned: tuple[str, ...] = LEARNED_ROLES) -> DataFrame:
    """(tree, path, leaf, score, n_turns, formatted, loss_spans): one row for each chosen path of a reply tree.

    `nodes` has tree, node, parent, role, text and score (double); other columns are left alone. The replies to one parent
    are ranked by score, highest first (null last), ties to the smaller node; with `keep`, only the first so many of
    each are followed. Paths of a tree are numbered from 1 by the ranks along them; `score` is the mean of a path's scores.
    `loss_spans` are the ranges (code points, end exclusive) that the texts of the `learned` roles take in `formatted`.

    Null tree: a tree of its own. Null node: left out. A parent that is not there, or null, makes a root. Rows that repeat a node: the
    one with the highest score stays, then the least by parent, role and text. Nodes on a cycle or below one have no
    root and give no path. Null role or text: empty. An empty table gives an empty one.
    """
    rows = nodes.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("score").cast("double").alias("score"))
    linked = _linked(rows, keep)
    pairs = _paths(linked)
    said = linked.select(F.col("tree").alias("t"), F.col("node").alias("n"), "top", "branch", "worst", "role", "text")
    on = pairs.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    head, body = F.concat(F.lit(START), _escaped_role(F.col("role")), F.lit("\n")), escaped(F.col("text"))
    on = on.select("tree", "leaf", "steps", "top", "branch", "worst", F.col("role").isin(*learned).alias("learned"), head.alias("head"), body.alias("body"))
    on = on.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("steps"))
    at = F.sum(F.length("piece").cast("long")).over(before) - F.length("piece") + F.length("head")
    on = on.withColumn("span", F.when(F.col("learned"), F.struct(at.alias("start"), (at + F.length("body")).alias("end"))))
    found = on.groupBy("tree", "leaf").agg(
        F.max("steps").alias("steps"),
        F.count("*").alias("n_turns"),
        F.max_by("top", "steps").alias("top"),
        F.avg(F.when(F.col("worst") < float("inf"), -F.col("worst"))).alias("score"),
        F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("at"), "branch", "piece", "span"))).alias("turns"),
    ).where("top AND n_turns = steps + 1")  # a path through a branch that was not kept lacks its nodes
    whole = found.select(
        "tree", "leaf", "score", "n_turns",
        F.transform("turns", lambda x: x["branch"]).alias("branches"),
        F.concat_ws("", F.transform("turns", lambda x: x["piece"])).alias("formatted"),
        F.array_compact(F.transform("turns", lambda x: x["span"])).alias("loss_spans"),
    )
    return rank_within(whole, ["tree"], ["branches", "leaf"], "path").select("tree", "path", "leaf", "score", "n_turns", "formatted", "loss_spans")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, as they were."""
    pieces = F.filter(F.split(formatted, r"\Q<|im_end|>\E\n", -1), lambda p: p != "")
    role = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(pieces, lambda p: F.struct(_unescaped_role(F.substr(role(p), F.lit(len(START) + 1))).alias("role"), unescaped(F.substr(p, F.length(role(p)) + 2)).alias("text")))


def read_spans(formatted: Column, spans: Column) -> Column:
    """array<string>: what stands under each span, as it was. In UTF-32 a code point has four bytes: spans are cut without
    counting from the start of the text each time."""
    wide = F.encode(formatted, "UTF-32")
    cut = lambda s: F.substring(wide, (s["start"] * 4 + 1).cast("int"), ((s["end"] - s["start"]) * 4).cast("int"))
    return F.transform(spans, lambda s: unescaped(F.decode(cut(s), "UTF-32")))


def chains(conversations: DataFrame) -> DataFrame:
    """(tree, node, parent, role, text, score) of conversations: each turn replies to the one before, by turn (null first),
    ties by role and text, null as empty. Rows of null conv_id are one conversation."""
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rank_within(rows, ["tree"], ["turn"], "node", ties=["role", "text"])
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))
