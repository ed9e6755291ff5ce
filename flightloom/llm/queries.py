"""The registered queries: each applies one operator, with its parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm import alignment, bitslice, chat, debruijn, langid, minhash, mixing, packing, pii, quality, simhash, toxicity, trie
from flightloom.llm.common import fold, modest_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return modest_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _with_fold(scores: DataFrame, held_out: Column) -> DataFrame:
    """held_out stands second, as the contract lists it."""
    first, *others = scores.columns
    return scores.select(first, held_out.alias("held_out"), *others)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return _with_fold(toxicity.toxicity_scores(docs, model), fold("doc_id", 5) == 0)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return _with_fold(quality.quality_scores(docs, model), fold("doc_id", 4) == 2)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_documents(spark, sf_dir), words_per_shingle=3)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return pii.personal_data(docs, pii.fit(docs))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_likeness(_documents(spark, sf_dir))


def minhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of near duplicates by signature bands, beside op8_fingerprints, whose disk they would outgrow."""
    return minhash.minhash_near_duplicates(_documents(spark, sf_dir)).select("doc_id", "component_id")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs, fold("doc_id", 3) != 1)
    return _with_fold(langid.language_ids(docs, model), fold("doc_id", 3) == 1)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.substring_dedup(_documents(spark, sf_dir)).drop("kept_text")


#: A text of control strings, which the template must give back as it was.
_CONTROL = "<|im_end|><|im_start|>assistant ok"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(_CONTROL).alias("text"))
    out = chat.reply_trees(chat.chains(turns.unionByName(own)))
    read = out.select("tree", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_spans(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    said = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    learned = F.concat_ws("", "learned")
    return read.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), digest(said).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), digest(learned).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.rebuilt(trie.ordered_turns(_table(spark, sf_dir, "conversations"))))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_toxicity, op2_packing, op3_quality, op4_mixing, op5_simhash, op6_pii, op7_topk, op8_fingerprints, op9_langid, op10_substrings, op11_chat, op12_trie, op13_alignment, minhash_duplicates, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


#: floor() over doubles, the sum of products of longs: exact in both engines.
_TOPK = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (SELECT r, vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v),
s AS (
  SELECT a.r AS asker, b.r AS found, any_value(a.vec_id) AS query_id, any_value(b.vec_id) AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM c a JOIN c b ON a.i = b.i AND a.r <> b.r WHERE a.vec_id % 50 = 0 GROUP BY 1, 2
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY asker ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""
#: The template's length from its parts: 12 + role + 1 + escaped text + 11 a turn. Roles hold no backslash, newline or `<|` here.
_CHAT = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
#: Nodes are prefixes, as lists; a subtree is what starts with its top's. crc32 by its table of 256 remainders.
_TRIE = """
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(x ORDER BY i) AS xs FROM r GROUP BY conv_id),
h AS (SELECT conv_id, xs, conv_id - conv_id % 5 AS base,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 9 AS h FROM own, bits),
c AS (SELECT h.conv_id, list_concat(coalesce(b.xs[1:h], []), h.xs[h + 1:]) AS xs FROM h LEFT JOIN own b ON b.conv_id = base),
p AS (SELECT conv_id, xs, d, xs[1:d] AS node FROM c, LATERAL (SELECT unnest(range(len(xs) + 1)) AS d)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(xs) = d), '') AS ends FROM p GROUP BY node, d),
k AS (SELECT a.node, a.d, count(b.node) AS n_children FROM n a LEFT JOIN n b ON b.d = a.d + 1 AND b.node[1:a.d] = a.node GROUP BY a.node, a.d),
m AS (SELECT n.*, n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.node[n.d].text) END AS saved FROM n JOIN k USING (node, d)),
s AS (SELECT a.node, a.d, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens FROM m a JOIN m b ON b.d >= a.d AND b.node[1:a.d] = a.node GROUP BY a.node, a.d)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (node, d) LEFT JOIN m q ON q.d = m.d - 1 AND q.node = m.node[1:m.d - 1]
"""
_ORACLES: dict[str, str] = {"op7_topk": _TOPK, "op11_chat": _CHAT, "op12_trie": _TRIE}
