"""What two tokenizers make of the same bytes: groups between common cuts, and which tokens stand for which.

B tokens are intervals of bytes in order, an index as it stands. Both ends of every A token are looked up by bisection, which gives
the B tokens that it overlaps; a gap between A tokens that lies inside no B interval is a cut of the group.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightloom.llm.common import forget, modest_batches, settled

TOKENIZERS = "/opt/tokenizers"
#: The pattern by which byte-level BPE parts a text before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs whose table of counts is broadcast; beyond, counts are joined by shuffles.
BROADCAST_PAIRS = 1_000_000
#: Links spelled out at a time within a document: a group of m and n tokens has m times n.
LINKS_AT_ONCE = 1 << 22


def _byte_of() -> dict[str, int]:
    """Byte-level alphabets write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """A byte-level BPE of a tokenizers file, run by tiktoken, several times faster: merges rank by the id they make."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        byte = _byte_of()
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.bytes = {i: bytes(map(byte.__getitem__, t)) for t, i in model["vocab"].items() if all(c in byte for c in t)}
        made = [model["vocab"][t] for t in joined]
        if made != sorted(made):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        kept = {*made, *(i for t, i in model["vocab"].items() if len(t) == 1)}
        self.model = tiktoken.Encoding("bpe", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks={self.bytes[i]: i for i in kept}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(" " + t) for t in texts]


class PieceBPE:
    """A sentencepiece model, which sets a space before a text by itself."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        piece = lambda i: bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = {i: piece(i) for i in range(n)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@cache
def tokenizer(kind: str, path: str) -> tuple[ByteBPE | PieceBPE, np.ndarray]:
    """A tokenizer and the length in bytes of each id's token: loaded once a worker."""
    known = {"byte": ByteBPE, "piece": PieceBPE}[kind](path)
    lengths = np.zeros(max(known.bytes) + 1, np.int64)
    lengths[list(known.bytes)] = [len(b) for b in known.bytes.values()]
    return known, lengths


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the first B token that it overlaps and the one after the last. Tokens follow each other from byte 0."""
    first = np.searchsorted(b_ends, np.append(0, a_ends[:-1]), "right")
    return first, np.searchsorted(b_ends, a_ends, "left") + 1


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token, from 0: a group ends where no B token spans the gap after an A token."""
    first, after = overlaps(a_ends, b_ends)
    # The next A token begins with a B token that this one does not overlap: the gap between them is spanned by none.
    cut = np.append(first[1:] >= after[:-1], True) if len(a_ends) else np.zeros(0, bool)
    of_a = np.cumsum(cut) - cut
    of_b = np.searchsorted(after[cut], np.arange(len(b_ends)), "right")
    return of_a, of_b


def _pairs(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked id pairs (a * width + b) and how often each is linked."""
    size = np.bincount(of_b, minlength=int(of_a[-1]) + 1)
    begin = np.cumsum(size) - size
    many, start = size[of_a], begin[of_a]
    total, found, times = np.cumsum(many), [], []
    at = 0
    while at < len(a):  # as many A tokens as have LINKS_AT_ONCE links, one at least
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LINKS_AT_ONCE, "right")))
        n = many[at:upto]
        ends = np.cumsum(n)
        other = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(start[at:upto], n)
        pair, count = np.unique(np.repeat(a[at:upto], n) * width + b[other], return_counts=True)
        found.append(pair)
        times.append(count)
        at = upto
    if len(found) == 1:
        return found[0], times[0]
    pair, back = np.unique(np.concatenate(found), return_inverse=True)
    return pair, np.bincount(back, np.concatenate(times)).astype(np.int64)


class _Spelling:
    """The text of groups: ids with what follows each, joined at once."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self.size = max(n_a, n_b)
        self.parts = [f"{i}{mark}" for mark in ",|;" for i in range(self.size)]

    def of(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> str:
        last_a, last_b = np.append(of_a[1:] != of_a[:-1], True), np.append(of_b[1:] != of_b[:-1], True)
        out = np.empty(len(a) + len(b), np.int64)
        # Before an A token stand the A tokens before it and the B tokens of earlier groups; before a B token the A tokens of its group too.
        out[np.arange(len(a)) + np.searchsorted(of_b, of_a, "left")] = a + self.size * last_a
        out[np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")] = b + 2 * self.size * last_b
        return "".join(map(self.parts.__getitem__, out.tolist()))[:-1]


#: A pair of ids as one number: a * WIDTH + b.
WIDTH = 1 << 24
_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _align_texts(pdfs: Iterator[pd.DataFrame], a_path: str, b_path: str) -> Iterator[pd.DataFrame]:
    (a_model, a_length), (b_model, b_length) = tokenizer("byte", a_path), tokenizer("piece", b_path)
    spelling = _spelling(len(a_length), len(b_length))
    for pdf in pdfs:
        rows = []
        for row, doc_id, text in zip(pdf["row"], pdf["doc_id"], pdf["text"], strict=True):
            found = None
            if text:
                (a_ids,), (b_ids,), whole = a_model.encode([text]), b_model.encode([text]), b" " + text.encode()
                a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
                a_ends = np.cumsum(a_length[a])
                # Byte-level tokens are cut out of the very bytes: their number tells whether any are missing. Pieces are compared.
                if a_ends[-1] == len(whole) and whole == b"".join(map(b_model.bytes.__getitem__, b_ids)):
                    of_a, of_b = groups(a_ends, np.cumsum(b_length[b]))
                    pairs, times = _pairs(a, b, of_a, of_b, WIDTH)
                    spelled = spelling.of(a, b, of_a, of_b)
                    found = (len(a), len(b), int(of_a[-1]) + 1, int(times.sum()), hashlib.sha256(spelled.encode()).hexdigest(), pairs, times)
            rows.append((row, doc_id, *(found or (0, 0, 0, 0, "", [], []))))
        yield pd.DataFrame(rows, columns=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


@cache
def _spelling(n_a: int, n_b: int) -> _Spelling:
    return _Spelling(n_a, n_b)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many documents a pair of ids is linked, and whether no pair of its A id is in more."""
    counts = encoded.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    # An A id has at most as many rows here as B has ids: a window over them is bounded by the vocabulary.
    most = F.max("docs").over(Window.partitionBy(F.expr(f"pair div {WIDTH}")))
    return counts.withColumn("best", F.col("docs") == most)


def aligned(docs: DataFrame, a_path: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_path: str = f"{TOKENIZERS}/piece_bpe_32k.model", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row a row of `docs` (doc_id, text).

    Each whole text is encoded by both tokenizers, whose files (same path on all machines) are read once a worker. Where
    tokens of both end at one byte a group ends; tokens of one group are linked, all with all. A pair of ids counts the
    documents that hold it linked; links of the best pairs of their A id are counted in n_best, all counts summed in
    count_sum. Only distinct pairs of a document leave its task. The table of counts has a row a distinct pair: it is
    broadcast up to `broadcast_pairs` rows, and joined by shuffle beyond; results are the same.

    Null and empty texts, and those that a tokenizer does not give back byte for byte, have no tokens: zeros and ''. Repeated
    rows are documents of their own, null ids too. Other columns are left alone. An empty table gives an empty one.
    """
    modest_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    encoded = settled(rows.mapInPandas(lambda pdfs: _align_texts(pdfs, a_path, b_path), f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_DOC}"))
    counts = settled(pair_counts(encoded))
    links = encoded.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    held = links.join(F.broadcast(counts) if counts.count() <= broadcast_pairs else counts, "pair")
    sums = settled(held.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")))
    out = encoded.drop("pairs", "times").join(sums, "row", "left")
    forget(counts)
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
