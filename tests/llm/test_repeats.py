"""One id, or one row, on thousands of rows: no operator grows with the square of them, or loses what the others say."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightloom.llm import bitslice, debruijn, langid, minhash, nearcopies, pii, quality, toxicity
from flightloom.llm.common import Shingles, hash_sample, in_bytes, modest_batches, one_text_each

SCHEMA = "doc_id long, text string, lang string"
MANY = 10_000


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))


def many(spark, *others):
    """MANY rows of id 1 (each with a text of its own) beside the others."""
    copies = spark.range(MANY).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("the word "), "id").alias("text"), F.lit("en").alias("lang"))
    return copies.union(spark.createDataFrame(list(others), SCHEMA)) if others else copies


def test_sampled_keys_are_distinct_and_never_too_few(spark):
    df = many(spark, *[(i, "x", "de") for i in range(2, 500)])
    assert hash_sample(df, "doc_id", 4_000, 1).count() == 499
    assert hash_sample(df, "doc_id", 200, 1).count() == 200
    texts = one_text_each(df, hash_sample(df, "doc_id", 4_000, 1))
    assert texts.count() == 499 and texts.where("doc_id = 1").count() == 1
    assert one_text_each(df, df.select("doc_id").distinct()).exceptAll(texts).count() == 0


def test_a_rare_language_is_learned_beside_many_rows_of_one_id(spark):
    rng = random.Random(1)
    df = many(spark, *[(i, "straße " + prose(rng, 20), "de") for i in range(2, 22)])
    model = langid.fit(df, F.lit(True))
    assert model.languages == ["de", "en"]
    same = spark.range(MANY).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the word").alias("text"), F.lit("en").alias("lang"))
    assert langid.fit(same.union(df.where("lang = 'de'")), F.lit(True)).languages == ["de", "en"]


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        langid.fit(spark.createDataFrame([(i, "abc", f"l{i}") for i in range(4)], SCHEMA), F.lit(True))


def test_classifiers_learn_beside_many_rows_of_one_id(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30) + (" vile nasty vile2" if i % 3 == 0 else ""), "en") for i in range(2, 120)]
    df = many(spark, *rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), i % 2) for i in range(2, 120)] + [(1, 0, 0)] * 2_000, "doc_id long, toxic int, quality int")
    sent = []
    real = toxicity.Rows.of
    monkeypatch.setattr(toxicity.Rows, "of", classmethod(lambda cls, lists: sent.append(len(lists)) or real(lists)))
    model = toxicity.fit(df, labels, F.lit(True))
    assert len(model.slots) and max(sent[:2]) <= 119
    assert quality.fit(df, labels, F.lit(True)).calibration is not None
    assert pii.fit(df.withColumn("text", F.concat("text", F.lit(" mail a@b.de")))).weights.any()


@pytest.mark.parametrize("doc_id", [7, None])
def test_ranges_part_the_rows_of_one_id(spark, doc_id):
    copies = spark.range(2_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    rows = copies.union(spark.createDataFrame([(9, "same words twice")] * 3_000 + [(8, "alone")], "doc_id long, text string"))
    out = minhash.edited_likeness(rows, range_bytes=2_000)
    per_task = out.where(F.col("n_chars") > 0).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(per_task) >= 3
    got = out.toPandas()
    assert len(got) == 5_001
    # Brute force: descending id (null last), descending hash of the text.
    marks = {r["text"]: r["m"] for r in rows.select("text", F.xxhash64("text").alias("m")).distinct().collect()}
    order = sorted(((d, t) for d, t in map(tuple, rows.collect())), key=lambda r: (r[0] is None, -(r[0] or 0), -marks[r[1]]))
    want = []
    for i, (_, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        cut = len(text) // 3
        want.append(hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest())
    assert sorted(got["edited_sha256"]) == sorted(want)
    shingles, hasher = Shingles(5), minhash.MinHasher()
    assert set(got["fingerprint"]) == {minhash.digits(hasher.signature(shingles.of(t))) for t in marks}


def test_repeated_rows_cost_the_substring_dedup_no_more(spark):
    rng = random.Random(3)
    head, passage = prose(rng, 60), prose(rng, 90)
    base = [(1, f"{head} {passage}"), (2, f"{passage} {prose(rng, 60)}")]
    df = spark.createDataFrame(base, "doc_id long, text string")
    copies = df.join(spark.range(MANY).drop("id").select(F.lit(1).alias("x"))).drop("x")
    out = {r["doc_id"]: (r["n"], r["removed"], r["kinds"]) for r in debruijn.substring_dedup(copies).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_removed").alias("removed"), F.countDistinct("kept_sha256").alias("kinds")).collect()}
    assert out == {1: (MANY, 0, 1), 2: (MANY, 90, 1)}


def test_blocks_of_wide_vectors_stay_small(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=48)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = {tuple(r) for r in bitslice.top_k(df, F.col("id") % 50 == 0).collect()}
    monkeypatch.setattr(bitslice, "CELLS", 64 * 48)
    sizes = []
    real = bitslice._packed
    monkeypatch.setattr(bitslice, "_packed", lambda rows, part, sliced: sizes.append(rows.groupBy(part).count().agg(F.max("count")).first()[0] if sliced else 0) or real(rows, part, sliced))
    assert {tuple(r) for r in bitslice.top_k(df, F.col("id") % 50 == 0).collect()} == plain and max(sizes) < 120


def test_sizes_with_units_are_read(spark):
    assert [in_bytes(x) for x in ("64m", "1g", "2kb", "512", "16MB", "-1", "1mib")] == [64 << 20, 1 << 30, 2048, 512, 16 << 20, -1, 1 << 20]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for value in ("64m", "1m", "33554432"):
            spark.conf.set(key, value)
            modest_batches(spark)
            assert 0 < in_bytes(spark.conf.get(key)) <= 16 << 20
    finally:
        spark.conf.set(key, before)


def test_sketches_leave_no_alike_pair_out():
    """Pairs at and around the similarity, of sets far larger than their sketches, and of hashes that collide in 32 bits."""
    rng = np.random.default_rng(6)
    left = lambda x: (x[: min(max(nearcopies.SKETCH, len(x) // 4), nearcopies.SKETCH_MOST)] >> np.uint64(32)).astype(np.uint32)
    for size in (5, 100, 129, 600, 3_000, 90_000):
        for spread in (2**64 - 1, 2**34):
            whole = np.unique(rng.integers(0, spread, 2 * size, dtype=np.uint64))
            sets = [np.sort(rng.choice(whole, size, replace=False)) for _ in range(3)]
            for share in (0.78, 0.8, 0.82, 0.9):
                kept = int(np.ceil(2 * share / (1 + share) * size))
                other = np.concatenate([rng.choice(sets[0], min(kept, size), replace=False), rng.integers(0, spread, size - min(kept, size), dtype=np.uint64)])
                sets.append(np.unique(other))
            n = np.array([len(x) for x in sets])
            found = nearcopies.sketched([left(x) for x in sets], [left(x) for x in sets], n, n, 0.8)
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                        assert found[i, j], (size, i, j)
    a, b = (np.unique(rng.integers(0, 2**64 - 1, 4_000, dtype=np.uint64)) for _ in range(2))
    assert not nearcopies.sketched([left(a)], [left(b)], np.array([len(a)]), np.array([len(b)]), 0.8).any()
