"""The registered queries over the smallest tables, against what their contracts say of columns, folds and rows."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import pytest

from flightloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_packing": ["doc_id", "bin", "capacity"],
    "op3_quality": ["doc_id", "held_out", "score", "predicted"],
    "op4_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_simhash": ["doc_id", "fingerprint", "component_id"],
    "op6_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op7_topk": ["query_id", "rank", "vec_id", "score"],
    "op8_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "minhash_duplicates": ["doc_id", "component_id"],
    "op9_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op11_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op12_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}
FOLDS = {"op1_toxicity": (5, 0, 0.5), "op3_quality": (4, 2, 0.7), "op9_langid": (3, 1, None)}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_keeps_its_contract(spark, name):
    out = queries()[name](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    assert set(COLUMNS[name]) <= set(out.columns) and len(out)
    if name in FOLDS:
        parts, held, threshold = FOLDS[name]
        assert all(h == (zlib.crc32(str(d).encode()) % parts == held) for d, h in zip(out["doc_id"], out["held_out"], strict=True))
        assert out["score"].between(0, 1).all()
        assert threshold is None or (out["predicted"] == (out["score"] >= threshold)).all()
    if "doc_id" in COLUMNS[name] and name != "op2_packing":
        assert sorted(out["doc_id"]) == sorted(docs["doc_id"])
    if name == "op4_mixing":
        assert (out["taken"] <= 3 * out["size"]).all() and (out["taken"] % out["size"].clip(lower=1) == 0).all()
        for _, part in out.groupby("source_size"):
            assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max() / 2 + 1
    if name == "op10_substrings":
        whole = {d: t.split() for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
        same = out[out["n_removed"] == 0]
        assert all(h == hashlib.sha256(" ".join(whole[d]).encode()).hexdigest() for d, h in zip(same["doc_id"], same["kept_sha256"], strict=True))


def test_sql_agrees(spark):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    for name, text in oracle_sql().items():
        found = con.execute(text)
        names, want = [c[0] for c in found.description], found.fetchall()
        got = queries()[name](spark, SF)
        assert sorted(got.columns) == sorted(names)
        order = sorted(names)
        rows = [sorted(repr([r[c] for c in order]) for r in got.collect()), sorted(repr([r[names.index(c)] for c in order]) for r in want)]
        assert rows[0] == rows[1], name
