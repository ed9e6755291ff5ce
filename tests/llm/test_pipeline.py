"""The pipeline's stages, each judged on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flightloom.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    text = lambda n, letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))
    rows = [(i, text(80, "aeiorstn" if i % 2 else "äöükzwch"), ("en", "de")[1 - i % 2], f"s{i % 3}", 0) for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2], "s0", 0) for i in range(5)] + [(300, "12 34 !!", "en", "s1", 0), (301, None, None, None, None)]
    rows += [(302, rows[7][1] + " mail me at ab@cd.example.com", "en", "s1", 0)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        kept[name] = docs.toPandas()
        if name != "sequences":
            assert docs.columns == columns
    assert set(kept["language"]["doc_id"]) == set(range(120)) | set(range(200, 205)) | {302}
    assert set(kept["near_copies"]["doc_id"]) >= set(range(120)) and not set(kept["near_copies"]["doc_id"]) & set(range(200, 205))
    assert not kept["personal_data"]["text"].str.contains("@").any() and len(kept["personal_data"]) == len(kept["near_copies"])
    assert set(kept["mixture"]["doc_id"]) <= set(kept["personal_data"]["doc_id"])
    assert kept["sequences"]["n_words"].sum() == kept["mixture"]["text"].str.split().str.len().sum()


def test_run_and_registry(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0 and corpus_pipeline.ORACLE_SQL is None
    names = queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and set(oracle_sql()) <= set(names)


ROWS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with the names that operators use inside.
CLASHES = ("size", "place", "mark", "row", "salt", "copies", "node", "score", "spans", "number", "part")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_awkward_and_empty_tables(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    known = [(i, "die and the und der " * 3 + "abcdefgh"[i % 8] * 4 + f" w{i}" * 6, ("en", "de")[i % 2], f"s{i % 2}", 90) for i in range(20)]
    rows = [*known, known[3], known[3], (3, "quite another text with other words", "en", "s1", 9), (None, None, None, None, None), (None, known[4][1], "en", None, 5), (30, "", "de", "s0", 0), (31, " \t", None, None, 2), (32, "12 !!", "", "s0", 5), (33, "the und " * 9_000, "en", "s0", 72_000)]
    docs = spark.createDataFrame(rows, ROWS).select("*", *[F.lit("x").alias(c) for c in CLASHES])
    out = stage(spark, docs, folder)
    got = out.toPandas()
    if name != "sequences":
        assert out.columns == docs.columns and set(got["mark"]) == {"x"}
        assert got["text"].dropna().isin({r[1] for r in rows}).all()
    if name == "language":
        assert not {30, 31, 32} & set(got["doc_id"].dropna()) and (got["doc_id"] == 3).sum() == 4
    if name == "near_copies":
        assert (got["doc_id"] == 3).sum() == 2 and got["doc_id"].isna().sum() == 2 and not {31} & set(got["doc_id"].dropna())
    if name == "personal_data":
        assert len(got) == len(rows) and got["text"].isna().sum() == 1
    if name == "sequences":
        assert got["n_words"].sum() == sum(len((r[1] or "").split()) for r in rows)
    assert stage(spark, docs.where("doc_id = -1"), folder).count() == 0
