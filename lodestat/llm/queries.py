"""The queries of this subpackage, as (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chroma, cross_entropy, jaccard, nearest, packing, recompress, sharding, token_counts, toxicity
from ._cut import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the 50k byte-level ranks, and the text they decode to, as digests."""
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What aligns with every hundredth recording (each embedding is rendered as a tune, as no table holds audio): whole, among all others; and cut at its start, among all."""
    vectors = _table(spark, sf_dir, "embeddings")
    prints = cut(chroma.fingerprints(vectors, "vec_id", "embedding", vectors=True))
    clips = cut(chroma.fingerprints(vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", vectors=True, skip=chroma.RATE + 37))
    whole = chroma.align(prints, prints.where("id % 100 = 0")).withColumn("part", F.lit("whole"))
    return whole.unionByName(chroma.align(prints, clips, among=False).withColumn("part", F.lit("clip")))


def op3_stable_projection_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found of every hundredth vector, among all."""
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op4_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    out = sharding.shard(_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, 4096, digest=True)


def op6_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more each document is like those labelled of good quality and not toxic than like the corpus."""
    labels = _table(spark, sf_dir, "labels")
    return cross_entropy.score(_table(spark, sf_dir, "documents"), labels.where("quality = 1 and toxic = 0"))


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version after inserts, takedowns, revisions and a repeated commit.

    Batch ``load`` inserts all documents. ``takedown`` deletes those labelled toxic. ``recount`` revises those labelled of low
    quality (and not toxic) to a version that also counts an end id. ``load`` is then committed again, which changes nothing.
    """
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    counts = cut(token_counts.counted(docs, public_tokenizers.path("word_bpe_49k.json"), "word_bpe_49k"))
    marked = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    gone = counts.join(marked.where("toxic = 1"), "doc_id", "left_semi")
    old = counts.join(marked.where("quality = 0 and not (toxic <=> 1)"), "doc_id", "left_semi")
    new = old.withColumn("tokenizer", F.lit("word_bpe_49k+end")).withColumn("n_tokens", F.col("n_tokens") + 1)
    rollup = token_counts.Rollup(spark, token_counts.shared_folder(spark, "rollup"))
    for name, deltas in (("load", token_counts.inserts(counts)), ("takedown", token_counts.deletes(gone)), ("recount", token_counts.revisions(old, new)), ("load", token_counts.inserts(counts))):
        rollup.commit(name, deltas)
    return rollup.totals()


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 4-word shingle similarity of 0.85 or more."""
    return jaccard.groups(_table(spark, sf_dir, "documents"), 4, 85, 100)


def op9_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that start earlier elsewhere."""
    out = recompress.remove_repeats(_table(spark, sf_dir, "documents"), 20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and decisions of the classifier chain for all documents."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels, toxicity.CATEGORIES))
    return out.select("doc_id", F.col("is_toxic").alias("toxic"), "p_low_quality", "p_toxic")


def queries() -> dict:
    return {f.__name__: f for f in (op1_byte_bpe, op2_chroma_fingerprints, op3_stable_projection_nearest, op4_kd_tree_shards, op5_power_of_two_packing, op6_cross_entropy_difference, op7_token_rollups, op8_ngram_jaccard_join, op9_recompression_dedup, op10_toxicity_chain)}


_WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"

#: Shingle sets, all pairs that share a shingle, and what the links reach; for tables of some thousand documents.
_OP8_SQL = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
 x AS MATERIALIZED (SELECT DISTINCT r, s FROM (SELECT r, array_to_string(w[i + 1 : i + 4], ' ') AS s FROM w, LATERAL (SELECT unnest(range(greatest(len(w) - 3, least(len(w), 1)))) AS i))),
 n AS MATERIALIZED (SELECT w.r, any_value(doc_id) AS doc_id, count(s) AS n FROM w LEFT JOIN x ON x.r = w.r GROUP BY w.r),
 c AS MATERIALIZED (SELECT min(r) AS c, h, any_value(n) AS n FROM (SELECT x.r, any_value(n.n) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM x JOIN n ON n.r = x.r GROUP BY x.r) GROUP BY h),
 m AS MATERIALIZED (SELECT x.r, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM x GROUP BY x.r), p AS MATERIALIZED (SELECT c.c, c.n, x.s FROM c JOIN x ON x.r = c.c),
 l AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM p a JOIN p b ON a.s = b.s AND a.c <> b.c GROUP BY a.c, b.c HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
 reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
 g AS MATERIALIZED (SELECT a, min(b) AS g FROM reach GROUP BY a), low AS (SELECT g.g, min(n.doc_id) AS low FROM m JOIN c ON c.h = m.h JOIN g ON g.a = c.c JOIN n ON n.r = m.r GROUP BY g.g)
 SELECT n.doc_id, n.n AS n_shingles, CASE WHEN n.n = 0 THEN n.doc_id ELSE low.low END AS component_id FROM n LEFT JOIN m ON m.r = n.r LEFT JOIN c ON c.h = m.h LEFT JOIN g ON g.a = c.c LEFT JOIN low ON low.g = g.g"""

#: All windows of 20 words in order; the words of those that are not the first of their kind go.
_OP9_SQL = f"""WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
 s AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS s FROM w, LATERAL (SELECT unnest(range(greatest(len(w) - 19, 0))) AS i)),
 later AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
 gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + d AS i FROM later, range(20) AS r(d)),
 kept AS MATERIALIZED (SELECT w.doc_id, string_agg(t, ' ' ORDER BY t0.i) FILTER (WHERE gone.i IS NULL) AS kept, count(gone.i) AS n_removed FROM w, LATERAL (SELECT unnest(w) AS t, unnest(range(len(w))) AS i) AS t0 LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = t0.i GROUP BY w.doc_id)
 SELECT w.doc_id, len(w)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The two that SQL can say; the others need a tokenizer, a fitted model or a search that is not exact."""
    return {"op8_ngram_jaccard_join": _OP8_SQL, "op9_recompression_dedup": _OP9_SQL}
