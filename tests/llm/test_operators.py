"""Each operator against a plain version on small tables, and on tables of awkward rows."""

import hashlib
import random
import re
import zlib
from itertools import combinations, product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flightloom.llm import bitslice, components, debruijn, langid, minhash, mixing, nearcopies, packing, pii, quality, simhash, toxicity
from flightloom.llm.common import Shingles, fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with the names that operators use inside.
CLASHES = ("size", "place", "fp", "row", "salt", "copies", "range", "later", "score", "spans", "bin", "node")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n, vocabulary="abcdefghij"):
    return " ".join("".join(rng.choices(vocabulary, k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    texts += texts[:10] + [t + " end" for t in texts[10:20]] + [texts[20] + "\n" + texts[21], " ".join(["again"] * 130)]
    passage = prose(rng, 70)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 9) for _ in range(6)]
    rows = [(i * 7 % 1009, t, ("en", "de")[i % 2], ("b", "a", "c", None)[i % 4], len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA), {r[0]: r for r in rows}


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "", "en", "a", 0), (3, "", "en", "a", 0), (4, "word", "en", "a", 4), (5, " \t\n", "de", None, 3), (6, "x " * 30_000, "de", "b", 60_000), (7, "1234 !! 🙂", "", "", 9), (8, "ß" * 50_000, "de", "b", 50_000), (None, "a@b.cd twice", "en", "a", 5), (None, "a@b.cd twice", "en", "a", 5)]
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in CLASHES])


# --- SimHash -------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, k=3):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_matches_brute_force(spark, corpus):
    df, rows = corpus
    got = {r["doc_id"]: r for r in simhash.simhash_components(df).collect()}
    fps = {i: plain_fingerprint(r[1]) for i, r in rows.items()}
    near = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(fps, near)


def test_covering_masks_of_a_wider_radius_leave_any_four_bits_out():
    rng = np.random.default_rng(4)
    masks = simhash.covering_masks(2**64 - 1, 4)
    assert len(masks) == 31
    for _ in range(2000):
        bits = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not mask & bits for mask in masks)


def test_dedup_drops_a_long_text_with_one_word_changed_and_keeps_others(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in rng.integers(0, 5000, 1200)]
    near = [*words[:600], "changed", *words[601:]]
    rows = [(3, " ".join(words)), (5, " ".join(near)), (9, " ".join(words[::-1])), (7, " ".join(near).upper())]
    kept = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 9]


def test_dedup_links_by_likeness_beyond_the_radius_and_nothing_less_alike(spark):
    """Some pairs of 0.9 are caught, pairs of 0.6 never: what is linked beyond the radius is checked by its text."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(80):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 300)]
        edits = 3 if i < 40 else 15
        near = list(words)
        for at in rng.choice(np.arange(5, 295, 6), edits, replace=False):
            near[at] = f"changed{i}-{at}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    kept = {r["doc_id"] for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, _ in rows if d % 2 == 0} <= kept
    assert {d for d, _ in rows if d > 80} <= kept
    assert sum(2 * i + 1 not in kept for i in range(40)) >= 13


def edited(words, edits, tag):
    """Every edit changes one word and with it five shingles; the edits are spread evenly."""
    out = list(words)
    for k in range(edits):
        out[4 + k * (len(words) - 8) // edits] = f"{tag}-{k}"
    return out


def alike(a, b, k=5):
    one, other = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
    return len(one & other) / len(one | other)


def test_dedup_catches_every_pair_of_texts_alike_beside_nearer_ones(spark):
    """Families of a text, one of 0.7 and one of 0.8 to 0.85: the one is never dropped, the other always."""
    rng = np.random.default_rng(5)
    rows, keep = [], set()
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 300)]
        near, far = edited(words, 6, f"n{i}"), edited(words, 11, f"f{i}")
        assert alike(words, near) >= 0.8 > 0.72 > alike(words, far) and alike(near, far) < 0.8
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
        keep |= {3 * i, 3 * i + 2}
    kept = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == keep


def test_crowded_buckets_of_texts_lose_no_pair(spark, monkeypatch):
    """What groups of near copies come out must not depend on the bound of a bucket."""
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in rng.integers(0, 50_000, 300)]
    variants = {i: edited(words, int(rng.integers(1, 14)), f"v{i % 25}-{i}") for i in range(50)}
    for i in range(50, 60):
        variants[i] = edited(variants[i - 50], 6, f"x{i}")
    near = [(a, b) for a, b in combinations(variants, 2) if alike(variants[a], variants[b]) >= 0.8]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in variants.items()], "doc_id long, text string")
    want = set(plain_components(variants, near).values())
    assert 1 < len(want) < 60
    for bound in (4, 256):
        monkeypatch.setattr(nearcopies, "BUCKET", bound)
        assert {r["doc_id"] for r in simhash.simhash_dedup(docs).collect()} == want


def test_every_pair_of_a_crowded_bucket_is_a_candidate(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BUCKET", 4)
    sketch = np.arange(10, dtype=np.uint32).tobytes()
    rows = [(1, i, 10, i % 5, bytearray(sketch)) for i in range(23)] + [(2, i, 10, 7, bytearray(sketch)) for i in range(3)]
    met = spark.createDataFrame(rows, "key long, node long, n long, label long, sketch binary")
    got = nearcopies.pairs_that_meet(met, 0.8).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(a, b) for a, b in combinations(range(23), 2) if a % 5 != b % 5}


def test_sketches_tell_whole_sets_exactly_and_pass_longer_ones_that_may_be_alike():
    """What a sketch does not hold may be shared: of longer sets, pairs that only their verification can tell apart pass."""
    rng = np.random.default_rng(2)
    for size, exact in ((60, True), (900, False)):
        base = np.unique(rng.integers(0, 2**32, size, np.uint32))
        sets = [np.unique(np.concatenate((rng.choice(base, int(len(base) * share), replace=False), rng.integers(0, 2**32, 12, np.uint32)))) for share in np.linspace(0.7, 1, 25)]
        similar = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets])
        sizes = np.array([len(x) for x in sets])
        got = nearcopies.sketched([x[: nearcopies.SKETCH] for x in sets], [x[: nearcopies.SKETCH] for x in sets], sizes, sizes, 0.8)
        assert got[similar >= 0.8].all() and (not exact or not got[similar < 0.8].any())
        strange = np.unique(rng.integers(0, 2**32, size, np.uint32))
        assert not nearcopies.sketched([x[: nearcopies.SKETCH] for x in sets], [strange[: nearcopies.SKETCH]], sizes, np.array([len(strange)]), 0.8).any()


def test_dedup_tells_texts_of_one_id_apart(spark):
    rng = random.Random(12)
    one, two, three = (prose(rng, 40) for _ in range(3))
    rows = [(1, one, "x"), (1, two, "x"), (1, two, "x"), (1, two, "y"), (2, two + " end", "x"), (3, three, "x"), (3, three, "x"), (None, one, "x"), (None, None, "x"), (4, None, "x"), (5, "", "x")]
    kept = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string, mark string"))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(1, one), (1, two), (3, three), (0, one), (0, ""), (4, "")])
    assert kept.columns == ["doc_id", "text", "mark"]


def test_dedup_keeps_texts_that_share_one_repeated_line(spark):
    """The line outvotes all else in a fingerprint of repeats, and the texts are 0.1 alike or less."""
    rng = np.random.default_rng(7)
    line = [f"line{i}" for i in range(10)]
    rows = [(i, " ".join([f"w{x}" for x in rng.integers(0, 50_000, int(rng.integers(60, 200)))] + line * 30)) for i in range(20)]
    assert max(alike(a[1].split(), b[1].split()) for a, b in combinations(rows, 2)) < 0.2
    assert simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).count() == 20


def test_covering_masks_leave_any_two_bits_out():
    free = (1 << 64) - 1
    for level in range(2):
        masks = simhash.covering_masks(free)
        bits = [i for i in range(64) if free >> i & 1]
        assert all(any(not (m >> a | m >> b) & 1 for m in masks) for a, b in combinations(bits, 2))
        free &= ~masks[0]


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Buckets above their bound are dealt out again; the links found must not depend on the bound."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(30)) for _ in range(300)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.links_within(spark.createDataFrame(signed, "fp long"))
    found = {tuple(x % 2**64 for x in r) for r in links.collect()}
    near = [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 2]
    assert all((a ^ b).bit_count() <= 64 for a, b in found)
    assert plain_components(fps, found) == plain_components(fps, near)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 500)] + [(70, 61), (61, 60)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == plain_components({x for pair in links for x in pair}, links)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- MinHash -------------------------------------------------------------------------------------------------------


def test_edited_likeness_matches_brute_force(spark, corpus):
    df, rows = corpus
    got = {r["doc_id"]: r for r in minhash.edited_likeness(df, range_bytes=3_000).collect()}
    order = sorted(rows, reverse=True)
    hasher, shingles = minhash.MinHasher(), Shingles(5)
    assert len(got) == len(rows)
    for i, d in enumerate(order):
        text, nxt = rows[d][1], rows[order[(i + 1) % len(order)]][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        prints = [minhash.digits(hasher.signature(shingles.of(t))) for t in (text, edited, nxt)]
        assert got[d]["n_chars"] == len(text)
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert [got[d]["fingerprint"], got[d]["edited_fingerprint"]] == prints[:2]
        assert got[d]["near_edited"] == minhash.likeness(*prints[:2]) and got[d]["near_next"] == minhash.likeness(prints[0], prints[2])


def test_minhash_duplicates_match_brute_force(spark, corpus):
    df, rows = corpus
    shingles = Shingles(5)
    sets = {d: set(shingles.of(r[1]).tolist()) for d, r in rows.items()}
    near = [(a, b) for a, b in combinations(rows, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in minhash.minhash_near_duplicates(df).collect()}
    assert got == plain_components(rows, near)


def test_minhash_likeness_follows_jaccard():
    rng = random.Random(9)
    a, b = ([prose(rng, 5) for _ in range(300)] for _ in range(2))
    hasher, shingles = minhash.MinHasher(), Shingles(5)
    x, y = " ".join(a), " ".join(a[:200] + b[:100])
    sets = [set(shingles.of(t).tolist()) for t in (x, y)]
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(minhash.likeness(*(minhash.digits(hasher.signature(shingles.of(t))) for t in (x, y))) - exact) < 0.15


def test_minhash_near_duplicates(spark):
    rng = random.Random(3)
    base = [prose(rng, 200) for _ in range(4)]
    texts = [*base, *base[:2], base[0] + " more words here", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.minhash_near_duplicates(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 1, 6: 0, 7: 7, 8: 7}


# --- repeated passages ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("window,anchor", [(50, 8), (12, 3)])
def test_substring_dedup_matches_brute_force(spark, corpus, window, anchor):
    df, rows = corpus
    got = {r["doc_id"]: r for r in debruijn.substring_dedup(df, window, anchor).collect()}
    first = {}
    for d in sorted(rows):
        w = words(rows[d][1])
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    for d, row in rows.items():
        w = words(row[1])
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_text"]) == (len(w), len(gone), kept)
        assert got[d]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert sum(r["n_removed"] for r in got.values()) > 0


# --- classifiers ---------------------------------------------------------------------------------------------------


def labelled(spark, n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        toxic, good = i % 5 == 0, i % 3 != 0
        lines = [prose(rng, 12) + "." for _ in range(4)]
        if toxic:
            lines[2] += " vile horrid"
        if not good:
            lines[1:3] = ["$$$ !!! ### " * 8, "BUY NOW!! " * 6]
        lang = ("en", "xx")[i % 2]
        text = "\n".join(lines) if lang == "en" else "\n".join(lines).replace("a", "ö").replace("e", "ü")
        rows.append((i, text, lang, "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_compaction_joins_what_always_follows_each_other(spark):
    """Chains become one run at each occurrence; branches, ends and circles stay apart."""
    texts = {1: [1, 2, 3, 4, 9, 5], 2: [1, 2, 3, 4, 8], 3: [9, 5, 6], 4: [7], 5: [20, 21, 20, 21]}
    rows = [(n, d, t, 10 * t, 10 * t + 9) for d, nodes in texts.items() for t, n in enumerate(nodes)] + [(1, 6, 3, 30, 39), (2, 6, 4, 40, 49), (3, 6, 5, 50, 59), (4, 6, 6, 60, 69)]
    got = sorted(tuple(r) for r in debruijn.compacted(spark.createDataFrame(rows, "node long, doc_key long, turn int, first int, last int")).collect())
    want = [(1, 0, 39), (1, 40, 59), (2, 0, 39), (2, 40, 49), (3, 0, 19), (3, 20, 29), (4, 0, 9), (6, 30, 69)]
    assert [g for g in got if g[0] != 5] == want
    covered = {x for _, a, b in (g for g in got if g[0] == 5) for x in range(a, b + 1)}
    assert covered == set(range(40))


def test_fold_is_crc32_of_decimal_text(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, 123456789012)], "doc_id long").select("doc_id", fold("doc_id", 5).alias("f"))
    assert {r["doc_id"]: r["f"] for r in df.collect()} == {i: zlib.crc32(str(i).encode()) % 5 for i in (0, 7, 123456789012)}


def test_held_out_accuracy(spark):
    docs, labels, rows, told = labelled(spark)
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    toxic = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, toxicity.fit(docs, labels, fold("doc_id", 5) != 0)).collect()}
    hits = [toxic[i]["predicted"] == told[i][2] for i in held]
    assert np.mean(hits) > 0.9, (np.mean(hits), [(toxic[i]["score"], told[i][2]) for i in held])
    good = {r["doc_id"]: r for r in quality.quality_scores(docs, quality.fit(docs, labels, fold("doc_id", 5) != 0)).collect()}
    assert np.mean([good[i]["predicted"] == told[i][1] for i in held]) > 0.95
    langs = {r["doc_id"]: r for r in langid.language_ids(docs, langid.fit(docs, fold("doc_id", 5) != 0)).collect()}
    assert all(langs[i]["lang_pred"] == rows[i][2] for i in held)
    assert all(0 <= r["score"] <= 1 for out in (toxic, good, langs) for r in out.values())


def test_every_language_is_learned_however_many(spark):
    rng = random.Random(5)
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    kinds = {f"l{i:03d}": rng.sample(letters, 4) for i in range(300)}
    rows = [(i, prose(rng, 30, kinds[k]), k) for i, k in enumerate(k for k in kinds for _ in range(5))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == sorted(kinds)
    ready = model.unpacked()
    names, _ = model.predict([prose(rng, 60, kinds[k]) for k in kinds], ready)
    assert np.mean([a == b for a, b in zip(names, kinds, strict=True)]) > 0.5


def test_texts_without_letters_teach_nothing(spark):
    df = spark.createDataFrame([(i, f"{i} 12 !!", "en") for i in range(9)] + [(20, None, "de")], "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    assert model.languages == [] and {r["lang_pred"] for r in langid.language_ids(df, model).collect()} == {"und"}
    more = df.union(spark.createDataFrame([(30, "a word", None)], df.schema))
    assert [r["doc_id"] for r in langid.keep_identified(more, model).collect()] == [30]


@pytest.mark.parametrize("langs", [1, 2, 4])
def test_garbled_and_foreign_texts_are_not_identified(spark, langs):
    """However many languages there are; texts of known ones stay but for a few in a hundred."""
    rng = random.Random(9)
    lexicon = {f"l{k}": [prose(rng, 1, letters) for _ in range(150)] for k, letters in enumerate(("aeiorstn", "uokzwch", "bdlmpiea", "gfvyjqxo"))}
    told = [(i, " ".join(rng.choices(lexicon[f"l{i % langs}"], k=rng.randint(20, 90))), f"l{i % langs}", "a", 0) for i in range(600)]
    odd = [(1000 + i, prose(rng, 50, "abcdefghijklmnopqrstuvwxyz"), None, "a", 0) for i in range(20)] + [(2000 + i, prose(rng, 50, "абвгдежз"), None, "a", 0) for i in range(20)]
    docs = spark.createDataFrame(told + odd, SCHEMA)
    kept = {r["doc_id"] for r in langid.keep_identified(docs, langid.fit(docs, F.col("doc_id") % 3 > 0)).collect()}
    assert max(kept) < 1000 and len(kept) >= 570


def test_nonnegative_risk_separates_sparse_rows():
    positive = toxicity.Rows.of([[0, 1]] * 30)
    unlabelled = toxicity.Rows.of([[0, 1]] * 10 + [[2]] * 90)
    w, b = toxicity.nonnegative_pu_fit(positive, unlabelled, 3, prior=0.1)
    assert w[0] + w[1] + b > 0 > w[2] + b


def test_nonnegative_risk_follows_a_plain_version():
    """The same descent over dense rows, with the risk's gradient taken numerically."""
    rng = np.random.default_rng(4)
    lists = [[int(x) for x in np.flatnonzero(rng.random(4) < 0.5)] for _ in range(40)]
    dense = np.array([[float(j in x) for j in range(4)] for x in lists])
    p, u, prior = dense[:10], dense[10:], 0.3

    def parts(theta):
        fp, fu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        negative = np.log1p(np.exp(fu)).mean() - prior * np.log1p(np.exp(fp)).mean()
        return prior * np.log1p(np.exp(-fp)).mean(), negative

    theta, m, v = np.append(np.zeros(4), np.log(prior / (1 - prior))), np.zeros(5), np.zeros(5)
    for t in range(1, 31):
        rising = parts(theta)[1] < 0
        risk = lambda x: -parts(x)[1] if rising else sum(parts(x))  # noqa: B023, E731
        grad = np.array([(risk(theta + d) - risk(theta - d)) / 2e-6 for d in 1e-6 * np.eye(5)]) + 1e-4 * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w, b = toxicity.nonnegative_pu_fit(toxicity.Rows.of(lists[:10]), toxicity.Rows.of(lists[10:]), 4, prior, rounds=30)
    assert np.allclose(np.append(w, b), theta, atol=1e-3)


def test_kernel_ridge_matches_a_plain_version():
    rng = random.Random(3)
    texts = [prose(rng, 12, "abcd" if i % 2 else "cdef") for i in range(24)]
    labels = np.array(["x" if i % 2 else "y" for i in range(24)])
    packed = np.stack([np.packbits(langid.presence(t)) for t in texts])
    model = langid._learned(packed, labels)
    sets = [set(np.flatnonzero(langid.presence(t))) for t in texts]
    gram = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    # All texts are landmarks: the Nystrom map keeps the whole kernel, and ridge regression is that of the kernel and a constant.
    both = gram + 1
    y = np.where(labels[:, None] == np.array(["x", "y"])[None, :], 1.0, -1.0)
    want = both @ np.linalg.solve(both + 1e-2 * np.eye(24), y)
    got, _ = model.responses(np.stack([langid.presence(t) for t in texts]), model.unpacked())
    assert np.allclose(got, want, atol=1e-3)


def test_chain_fit_is_a_maximum_of_the_enumerated_likelihood():
    rng = np.random.default_rng(5)
    sizes = np.array([3, 2, 4, 1, 3])
    good = rng.integers(0, 2, sizes.sum())
    x = np.column_stack([np.ones(len(good)), good + rng.normal(size=len(good))])
    w, step = quality.crf_fit(x, good, sizes, rounds=3000, rate=0.02, ridge=1e-2)

    def risk(w, step):
        total, at = 0.0, 0
        for n in sizes:
            emit, own = x[at : at + n] @ w, good[at : at + n]
            value = lambda path: sum(emit[i, k] for i, k in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
            total += np.logaddexp.reduce([value(path) for path in product((0, 1), repeat=int(n))]) - value(tuple(own))
            at += n
        return total / len(good) + 0.5e-2 * ((w**2).sum() + (step**2).sum())

    least = risk(w, step)
    for d in 0.05 * np.eye(8):
        for sign in (1, -1):
            assert risk(w + sign * d[:4].reshape(2, 2), step + sign * d[4:].reshape(2, 2)) >= least - 1e-4


def test_line_labels_cover_every_line(spark):
    docs = spark.createDataFrame([(1, "a b\n\nc"), (2, None), (3, "x")], "doc_id long, text string")
    rows = quality.line_labels(docs, quality.QualityModel()).collect()
    assert sorted((r["doc_id"], r["line"], r["length"]) for r in rows) == [(1, 0, 3), (1, 1, 0), (1, 2, 1), (2, 0, 0), (3, 0, 1)]


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 1, 4])
    emit, step = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    got, pairs, norm = quality.marginals(emit, sizes, step)
    at, want_pairs = 0, np.zeros((2, 2))
    for c, n in enumerate(sizes):
        total, each = 0.0, np.zeros((n, 2))
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            p = np.exp(sum(emit[at + i, y[i]] for i in range(n)) + sum(step[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            for i in range(n):
                each[i, y[i]] += p
        np.testing.assert_allclose(got[at : at + n], each / total)
        np.testing.assert_allclose(norm[c], np.log(total))
        at += n
    assert np.isclose(pairs.sum(), (sizes - 1).sum()) and want_pairs.shape == pairs.shape


# --- personal data -------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS.items()):
        for m in re.finditer(p[1], text):
            d = re.sub("[^0-9]", "", m.group())
            ok = [True, all(int(x) <= 255 for x in m.group().split(".")) if p[0] == "ip" else False, 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]
            if ok:
                out.append((m.start(), k, f"{p[0]}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


@pytest.mark.parametrize(
    "text",
    ["a@b.cd_x@y.zz", "a.b+c@d-e.f.g.h @x.y z@", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (319) 555-5132 +4 +12345678", "x@1.2.3.4 +4111111111111111", "é4556737586899855é a@b@c.de", "", "..@..", "a@b.c" * 3],
)
def test_base_spans_match_plain_patterns(text):
    assert pii.written(pii.base_spans(text)) == plain_spans(text)


def test_base_spans_match_on_random_text():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices("1234567890" * 2 + "..@@+-- ()ab_", k=rng.randint(0, 40)))
        assert pii.written(pii.base_spans(text)) == plain_spans(text), text


def test_model_adds_what_patterns_miss_and_redacts(spark):
    rng = random.Random(6)
    token = lambda: "".join(rng.choices("0123456789abcdef", k=24))
    card = lambda: next(c for c in iter(lambda: "".join(rng.choices("0123456789", k=16)), "") if pii.luhn(c))
    rows = [(i, f"some words password={token()} then mail ab.c{i}@mail.example.com and 10.0.0.{i % 250} more 12345678 words +1 (234) 555-{1000 + i} or {card()} end") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df)
    got = {r["doc_id"]: r for r in pii.personal_data(df, model).collect()}
    assert all(got[i]["n_secret"] == got[i]["n_added"] == 1 and got[i]["n_email"] == 1 and got[i]["n_ip"] == 1 for i, _ in rows)
    clean = pii.redacted(rows[0][1], model)
    assert clean == "some words password=[SECRET] then mail [EMAIL] and [IP] more 12345678 words [PHONE] or [CARD] end"
    assert pii.redacted("nothing here", model) == "nothing here"
    # What no pattern finds and no word announces, planted in other texts than those learned from.
    draw = np.random.default_rng(99)
    found = planted = wrong = 0
    for i in range(150):
        text, told = pii.learned_from(f"words {i} say " + rows[i][1].replace("555-1", "777-2"), draw)
        fixed = pii.base_spans(text)
        hidden = {(x, y, k) for (x, y), k in told.items() if (x, y, k) not in fixed and all(y <= c or d <= x for c, d, _ in fixed)}
        more = {s for s in model.added(text, fixed) if s[:2] not in {f[:2] for f in fixed}}
        found, planted, wrong = found + len(more & hidden), planted + len(hidden), wrong + len(more - hidden - {(x, y, k) for (x, y), k in told.items()})
    assert planted > 200 and found >= 0.85 * planted and wrong <= 0.1 * found, (found, planted, wrong)


def segmentations(n, ranges, at=0):
    if at == n:
        yield []
        return
    for rest in segmentations(n, ranges, at + 1):
        yield rest
    for c, (i, j) in enumerate(ranges):
        if i == at:
            for rest in segmentations(n, ranges, j):
                yield [c, *rest]


def test_segmentation_and_likelihood_match_enumeration():
    rng = np.random.default_rng(8)
    for _ in range(6):
        n = 5
        ranges = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.5]
        features = rng.normal(size=(len(ranges), pii.FEATURES))
        w = 0.3 * rng.normal(size=(pii.FEATURES, len(pii.KINDS)))
        score = features @ w
        each = [(chosen, kinds) for chosen in segmentations(n, ranges) for kinds in product(range(len(pii.KINDS)), repeat=len(chosen))]
        values = np.array([sum(score[c, k] for c, k in zip(*x, strict=True)) for x in each])
        told = dict(zip(*each[int(rng.integers(len(each)))], strict=True))
        got, grad = pii.likelihood([(n, ranges, features, told)], w)
        value = sum(score[c, k] for c, k in told.items())
        assert got == pytest.approx(value - np.logaddexp.reduce(values))
        best = pii.SpanModel(w).best(n, ranges, features)
        assert sum(score[c, k] for c, k in best) == pytest.approx(max(values))
        for f, k in ((0, 0), (3, 2), (9, 4)):
            step = np.zeros_like(w)
            step[f, k] = 1e-5
            ahead, behind = (pii.likelihood([(n, ranges, features, told)], w + d)[0] for d in (step, -step))
            assert grad[f, k] == pytest.approx((ahead - behind) / 2e-5, abs=1e-5)


# --- search, mixing, packing ---------------------------------------------------------------------------------------


def test_bit_sliced_search_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 9)).astype("float32")
    vectors[10:40] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (950, [float("nan")] * 9), (951, [None] + [0.0] * 8), (1000, [float("inf")] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = bitslice.top_k(df, F.col("id") % 50 == 0, k=5).orderBy("query_id", "rank").collect()
    q = np.floor(256 * vectors.astype(float)).astype(int)
    want = []
    for i in range(0, 300, 50):
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:5]
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate(best)]
    assert [tuple(r) for r in got] == want


def test_search_tells_rows_of_one_id_apart(spark):
    """Rows, not ids: repeated and null ids ask and are found, as in the SQL."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 4)).astype("float32")
    ids = [int(x) if x % 7 else None for x in rng.integers(0, 20, 60)] + [0, 0, 50, 50]
    rows = [(i, v.tolist()) for i, v in zip(ids, [*vectors, vectors[0], vectors[0], vectors[1], vectors[2]], strict=True)]
    got = bitslice.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0, k=5).collect()
    q = np.floor(256 * np.array([r[1] for r in rows])).astype(int)
    want = []
    for i, own in enumerate(ids):
        if own is not None and own % 50 == 0:
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-int(q[j] @ q[i]), ids[j] is None, ids[j] or 0))[:5]
            want += [(own, k + 1, ids[j], int(q[j] @ q[i])) for k, j in enumerate(order)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and len(want) > 15


def test_few_rows_and_wide_values():
    values = np.array([[3, -(2**30)], [2**30, 5], [0, 0]], np.int64)
    ids = np.array([1, 5, 9])
    block = bitslice.Block.unpacked(**bitslice.Block.of(ids, ids, np.ones(3, bool), values).packed())
    assert block.top(5, values[1], 5) == [(3 * 2**30 - 5 * 2**30, 1), (0, 9)][::-1] or sorted(block.top(5, values[1], 5)) == [(-2 * 2**30, 1), (0, 9)]


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, mass = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / mass > cap * sizes[s]]
        if not over:
            return {s: fixed.get(s, left * w[s] / mass if free else 0) for s in names}
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_fill_like_water(spark):
    rng = random.Random(2)
    for _ in range(3):
        sizes = {f"s{i}": rng.choice([1, 5, 40, 900, 10_000]) for i in range(9)} | {None: 30}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = plain_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_mix_takes_near_targets_and_repeats(spark, corpus):
    df, rows = corpus
    got = mixing.mix_sizes(df).toPandas().set_index("doc_id")
    again = mixing.mix_sizes(df.repartition(7)).toPandas().set_index("doc_id")
    assert got.sort_index().equals(again.sort_index())
    assert (got["taken"] <= 3 * got["size"]).all() and all(got["size"][d] == len(words(r[1])) for d, r in rows.items())
    source = {d: r[3] for d, r in rows.items()}
    for s in set(source.values()):
        part = got[[source[d] == s for d in got.index]]
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max() / 2 + 1
    assert mixing.mix(df).count() == got["copies"].sum()


def test_mix_of_repeated_and_null_ids_reaches_its_targets(spark):
    """Equal rows share a place: the cut falls between them all the same, and reruns agree."""
    text = "one two three four five"
    rows = [(None if i % 2 else 7, text, "a", i) for i in range(120)] + [(i, text, "b", i) for i in range(40)] + [(1, text, "b", i) for i in range(250)] + [(2, None, "b", 0), (None, "", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    got = mixing.mix_sizes(df).withColumn("s", F.col("source_size")).toPandas()
    assert len(got) == len(rows)
    for size in (600, 1450):
        part = got[got["s"] == size]
        assert len(part) and abs(part["taken"].sum() - part["target"].iloc[0]) <= 2.5
    again = mixing.mix_sizes(df.repartition(5)).toPandas()
    assert sorted(map(tuple, got[["size", "target", "taken"]].to_numpy().tolist())) == sorted(map(tuple, again[["size", "target", "taken"]].to_numpy().tolist()))
    assert mixing.mix(df).count() == got["copies"].sum()


def test_packing_keeps_every_word(spark, corpus):
    df, rows = corpus
    got = packing.pack(df, capacities=(32, 64, 100)).toPandas()
    assert {d: int(g["n_words"].sum()) for d, g in got.groupby("doc_id")} == {d: len(words(r[1])) for d, r in rows.items()}
    for _, b in got.groupby("bin"):
        spans = sorted(zip(b["bin_offset"], b["n_words"], strict=True))
        assert all(a + n <= c for (a, n), (c, _) in zip(spans, spans[1:], strict=False))
        used, capacity = b["n_words"].sum(), b["capacity"].iloc[0]
        assert used <= capacity and capacity == min(c for c in (32, 64, 100) if c >= used) and (b["used"] == used).all()


def plain_best_fit(sizes, capacities, opening):
    """The same rule by searching all bins each time: (bin, capacity in the end) of each size."""
    rate, bins, place = min((c + opening) / c for c in capacities), [], {}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    for k, i in enumerate(order):
        fits = [(cap - used - sizes[i], b) for b, (cap, used) in enumerate(bins) if cap - used >= sizes[i]]
        fits = [f for f in fits if bins[f[1]][0] > bins[f[1]][1]] if sizes[i] == 0 else fits
        if fits:
            b = min(fits)[1]
        else:
            waits = sizes[i] + max(0, sum(sizes[j] for j in order[k + 1 :]) - sum(cap - used for cap, used in bins))
            cost = lambda c: c + opening + (max(rate * (waits - c), min(capacities) + opening) if waits > c else 0)  # noqa: B023, E731
            bins.append([min((c for c in capacities if c >= sizes[i]), key=lambda c: (cost(c), c)), 0])  # noqa: B023
            b = len(bins) - 1
        bins[b][1] += sizes[i]
        place[i] = b
    return [(place[i], min(c for c in capacities if c >= bins[place[i]][1])) for i in range(len(sizes))]


def test_best_fit_matches_a_search_of_all_bins():
    rng = random.Random(7)
    for _ in range(30):
        caps = sorted(rng.sample(range(10, 90), 3))
        sizes = [rng.randint(1, caps[-1]) for _ in range(rng.randint(1, 40))]
        got = packing.variable_best_fit(sizes, caps, 4.0)
        assert [(b, c) for b, _, c in got] == plain_best_fit(sizes, caps, 4.0)


def test_best_fit_prefers_the_tightest_bin():
    assert packing.variable_best_fit([60, 50, 40, 14, 10], capacities=(64, 100), opening=1) == [(0, 0, 100), (1, 0, 100), (0, 60, 100), (1, 50, 100), (1, 64, 100)]
    assert packing.variable_best_fit([10, 64], capacities=(64, 100), opening=1) == [(0, 64, 100), (0, 0, 100)]
    assert packing.variable_best_fit([10], capacities=(64, 100), opening=1) == [(0, 0, 64)]


# --- awkward rows --------------------------------------------------------------------------------------------------


def every_operator(docs, labels, vectors):
    always = F.lit(True)
    yield "simhash", simhash.simhash_components(docs)
    yield "simhash_dedup", simhash.simhash_dedup(docs)
    yield "minhash", minhash.minhash_near_duplicates(docs)
    yield "likeness", minhash.edited_likeness(docs)
    yield "substrings", debruijn.substring_dedup(docs)
    yield "toxicity", toxicity.toxicity_scores(docs, toxicity.fit(docs, labels, always))
    yield "quality", quality.quality_scores(docs, quality.fit(docs, labels, always))
    model = langid.fit(docs, always)
    yield "langid", langid.language_ids(docs, model)
    yield "identified", langid.keep_identified(docs, model)
    yield "pii", pii.personal_data(docs, pii.fit(docs))
    yield "redact", pii.redact(docs, pii.fit(docs))
    yield "sizes", mixing.mix_sizes(docs)
    yield "mix", mixing.mix(docs)
    yield "pack", packing.pack(docs)
    yield "topk", bitslice.top_k(vectors, F.col("id") % 2 == 0)


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None), (6, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([(1, [0.5]), (2, [0.5, 1.0]), (2, [0.5, 1.0]), (None, [1.0]), (4, [])], "vec_id long, embedding array<float>")
    got = {name: df.toPandas() for name, df in every_operator(awkward, labels, vectors)}
    assert len(got["minhash"]) == 9  # rows with a doc_id
    for name in ("simhash", "likeness", "substrings", "toxicity", "quality", "langid", "pii", "sizes", "redact"):
        assert len(got[name]) == 12, name
    assert set(got["identified"].columns) == set(awkward.columns) == set(got["mix"].columns) == set(got["redact"].columns)
    assert (got["langid"]["lang_pred"] == "und").sum() == 7
    assert got["pack"]["n_words"].sum() == got["sizes"]["size"].sum() == 30_000 + 1 + 3 + 1 + 4
    assert sorted(got["simhash_dedup"]["doc_id"].dropna()) == [1, 4, 6, 7, 8]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert all(df.count() == 0 for _, df in every_operator(docs, labels, vectors))
