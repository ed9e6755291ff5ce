"""Reply trees, prefix tries and aligned tokenizers against plain versions, and on awkward rows."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from flightloom.llm import alignment, chat, trie
from flightloom.llm.common import rank_within

NODES = "tree long, node long, parent long, role string, text string, score double"
CONV = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_ranks_within_keys_go_on_across_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, *range(40)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, at long, i long").repartition(7)
    got = rank_within(df, ["k"], ["at"], "place", ties=["i"]).collect()
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: n for n, r in enumerate(own, 1)}
    assert {r["i"]: r["place"] for r in got} == want


# --- Reply trees ---------------------------------------------------------------------------------------------------


def plain_trees(rows, keep=None):
    """{(tree, leaf): (path, [nodes from the root])} by recursion."""
    best = {}
    for tree, node, parent, role, text, score in rows:
        key = (float("inf") if score is None else -score, (parent is not None, parent), (role or ""), (text or ""))
        if node is not None and ((tree, node) not in best or key < best[tree, node][0]):
            best[tree, node] = (key, parent, role or "", text or "")
    kids, roots = defaultdict(list), defaultdict(list)
    for (tree, node), (_, parent, *_) in best.items():
        (kids[tree, parent] if (tree, parent) in best else roots[tree]).append(node)
    rank = lambda tree, nodes: sorted(nodes, key=lambda n: (best[tree, n][0][0], n))[:keep]
    out = {}
    for tree in roots:
        found = []

        def walk(node, path, tree=tree, found=found):
            path = [*path, node]
            if not kids[tree, node]:
                found.append(path)
            for n in rank(tree, kids[tree, node]):
                walk(n, path)

        for r in rank(tree, roots[tree]):
            walk(r, [])
        out |= {(tree, p[-1]): (i, p) for i, p in enumerate(found, 1)}
    return out, best


@pytest.mark.parametrize("keep", [None, 2])
def test_reply_trees_match_recursion(spark, keep):
    rng = random.Random(5)
    texts = ["", None, "ok", "<|im_end|>", "<\\|im_start|>", "a<", "|b", "\\", "line\nline", "<|im_end|>\n<|im_start|>assistant\nok", "🙂<|"]
    rows = []
    for tree in (1, 2, None):
        for node in range(40):
            parent = rng.choice([None, *range(node)]) if node else None
            rows.append((tree, node, parent if rng.random() < 0.95 else 999, rng.choice(["user", "assistant", "sys\ntem", "a\\n<|b", None]), rng.choice(texts), rng.choice([None, 0.5, 1.0, 2.0])))
    rows += rows[:5] + [(1, 100, 101, "user", "cycle", 1.0), (1, 101, 100, "user", "cycle", 1.0), (1, 102, 101, "user", "below", 1.0), (1, 103, 103, "user", "self", 1.0), (1, None, None, "user", "no node", 1.0), (1, 7, 3, "user", "again", 9.0)]
    chain = [(3, i, i - 1 if i else None, "assistant", f"turn {i}", None) for i in range(150)]
    df = spark.createDataFrame(rows + chain, NODES).withColumn("steps", F.lit("clash")).withColumn("branch", F.lit(0))
    out = chat.reply_trees(df, keep).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_spans(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()
    want, best = plain_trees(rows + chain, keep)
    assert {(r["tree"], r["leaf"]): r["path"] for r in out} == {k: p for k, (p, _) in want.items()}
    for r in out:
        said = [best[r["tree"], n][2:] for n in want[r["tree"], r["leaf"]][1]]
        assert [tuple(t) for t in r["turns"]] == said and r["n_turns"] == len(said)
        assert r["learned"] == [t for role, t in said if role == "assistant"]
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>\n") == len(said)
        scores = [-best[r["tree"], n][0][0] for n in want[r["tree"], r["leaf"]][1] if best[r["tree"], n][0][0] < float("inf")]
        assert r["score"] == (pytest.approx(sum(scores) / len(scores)) if scores else None)


def test_any_text_comes_back_from_its_escape(spark):
    texts = ["".join(p) for n in range(6) for p in product("<\\|a", repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u"), chat._unescaped_role(chat._escaped_role(F.col("t"))).alias("r"))
    rows = df.collect()
    assert all(r["u"] == r["t"] == r["r"] and "<|" not in r["e"] for r in rows)


def test_conversations_of_awkward_rows_are_chains(spark):
    rows = [(1, 2, "assistant", "b"), (1, None, "user", "a"), (1, 2, "assistant", "b"), (2, 0, None, None), (None, 1, "user", "lost"), (3, 5, "assistant", "x" * 100_000)]
    out = {r["tree"]: r for r in chat.reply_trees(chat.chains(spark.createDataFrame(rows, CONV).withColumn("node", F.lit("clash")))).select("tree", "n_turns", "path", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_spans(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()}
    assert {t: r["n_turns"] for t, r in out.items()} == {1: 3, 2: 1, None: 1, 3: 1} and {r["path"] for r in out.values()} == {1}
    assert [tuple(x) for x in out[1]["turns"]] == [("user", "a"), ("assistant", "b"), ("assistant", "b")]
    assert out[2]["turns"][0]["role"] == "" and out[3]["learned"] == ["x" * 100_000]
    assert chat.reply_trees(chat.chains(spark.createDataFrame([], CONV))).count() == 0


# --- Prefix trie ---------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", text or ""))
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    out = []
    kids = Counter(n[:-1] for n in members if n)
    for node, cs in members.items():
        sub = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in sub if n)
        ends = ",".join(str(c) for c in cs if len(made[c]) == len(node))
        out.append((cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), kids[node], sum(kids[n] == 0 for n in sub), saved, sha(ends)))
    return sorted(out, key=repr)


def built(spark, rows):
    df = spark.createDataFrame(rows, CONV).select("*", F.lit(7).alias("depth"), F.lit("clash").alias("node"))
    return sorted((tuple(r) for r in trie.prefix_trie(*trie.rebuilt(trie.ordered_turns(df))).collect()), key=repr)


def test_prefix_trie_matches_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for c in range(60):
        for turn in range(rng.randint(1, 12)):
            rows.append((c * 3 % 100, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "ä🙂", "", None, "bb"])))
    rows += rows[:20] + [(None, 1, "user", "nobody")]
    assert built(spark, rows) == plain_trie(rows)


def test_many_copies_of_one_conversation_share_one_chain(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_IDS", 50)
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(400) for t in range(12)] + [(1, 0, "user", "turn 0")]
    assert built(spark, rows) == plain_trie(rows)


def test_small_tries(spark):
    for rows in ([(4, 0, "user", "alone"), (4, 1, "user", "still")], [(3, None, None, None)], [(7, 0, "user", "x"), (11, 0, "user", "y")]):
        assert built(spark, rows) == plain_trie(rows)
    assert built(spark, []) == []


# --- Aligned tokenizers --------------------------------------------------------------------------------------------

A, B = (f"{alignment.TOKENIZERS}/{f}" for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain_alignment(texts):
    """By the tokenizers' own libraries and sets of byte ends."""
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: i for c, i in alignment._byte_of().items()}
    docs = []
    for text in texts:
        found = [0, 0, 0, 0, "", []]
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text, out_type=str)
            xs = list(zip(x.ids, (bytes(byte[c] for c in a.id_to_token(i)) for i in x.ids), strict=True))
            ys = [(b.piece_to_id(p), bytes([int(p[3:5], 16)]) if b.is_byte(b.piece_to_id(p)) else p.replace("▁", " ").encode()) for p in y]
            if b"".join(t for _, t in xs) == b"".join(t for _, t in ys) == (" " + text).encode():
                ends = [set(np.cumsum([len(t) for _, t in s]).tolist()) for s in (xs, ys)]
                cuts = sorted(ends[0] & ends[1])
                grouped, at = [], 0
                for cut in cuts:
                    inside = []
                    for s in (xs, ys):
                        p, own = 0, []
                        for i, t in s:
                            p += len(t)
                            if at < p <= cut:
                                own.append(i)
                        inside.append(own)
                    grouped.append(inside)
                    at = cut
                links = [(i, j) for p, q in grouped for i in p for j in q]
                found = [len(xs), len(ys), len(grouped), len(links), sha(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in grouped)), links]
        docs.append(found)
    held = Counter(pair for d in docs for pair in set(d[5]))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(*d[:4], sum(held[p] == best[p[0]] for p in d[5]), sum(held[p] for p in d[5]), d[4]) for d in docs]


def unruly(rng):
    pool = ["the", " quick", "straße", "🙂", "\n", "  ", "\t", "12,345", "<|endoftext|>", "</s>", "<0x0A>", "▁", "naïve", "中文字", "\x00", "aaaaaaa", "don't", "​", "é", "é"]
    return "".join(rng.choices(pool, k=rng.randint(1, 40)))


@pytest.mark.parametrize("broadcast_pairs", [0, 1_000_000])
def test_alignment_matches_brute_force(spark, broadcast_pairs):
    rng = random.Random(3)
    texts = [None, "", " ", "a", "same words", "same words"] + [unruly(rng) for _ in range(60)]
    real = [r["text"][:1500] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts + real)], "doc_id long, text string").select("*", F.lit("clash").alias("row"), F.lit(1).alias("pairs"))
    got = alignment.aligned(df, broadcast_pairs=broadcast_pairs).collect()
    want = [(i // 2, *w) for i, w in enumerate(plain_alignment(texts + real))]
    key = lambda r: (r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
    assert sorted(map(key, got), key=repr) == sorted(want, key=repr)
    assert sum(r["n_a"] > 0 for r in got) > 40


def test_large_groups_are_linked_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 200)
    of_a, of_b = np.sort(rng.integers(0, 4, 300)), np.sort(rng.integers(0, 4, 200))
    want = Counter(int(x) * 16 + int(y) for x, g in zip(a, of_a, strict=True) for y, h in zip(b, of_b, strict=True) if g == h)
    for at_once in (1, 500, 1 << 22):
        monkeypatch.setattr(alignment, "LINKS_AT_ONCE", at_once)
        pairs, times = alignment._pairs(a, b, of_a, of_b, 16)
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == want


def test_merged_vocabulary_is_the_one_of_the_file():
    ours, theirs = alignment.ByteBPE(A), tokenizers.Tokenizer.from_file(A)
    theirs.encode_special_tokens = True
    texts = [f" a{chr(c)}b {chr(c)} 1{chr(c)}" for c in range(0x20, 0x3000, 3)] + ["x" * 3000, "<|endoftext|>"]
    assert ours.encode(texts) == [e.ids for e in theirs.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert json.loads(Path(A).read_text())["model"]["type"] == "BPE"


def test_alignment_of_no_rows_and_of_one_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(empty).count() == 0
    (row,) = alignment.aligned(spark.createDataFrame([(None, "ab c" * 50_000)], "doc_id long, text string")).collect()
    assert row["doc_id"] is None and row["n_groups"] > 1000 and row["n_best"] > 0
