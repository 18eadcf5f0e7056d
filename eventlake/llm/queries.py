"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clusters, decontaminate, near_dup, negatives, passages, pii, quality, token_output, token_scan, toxicity, urls
from .shared import new_path, read_table, written

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: A tokenizer file of the same vocabulary, and the id that ends each document in token files.
TOKENIZER, END = public_tokenizers.path("byte_bpe_50k.json"), 2
#: Stands for a secret that a real run reads from its key store.
KEY = "example key, replace in production"
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
PROBE = "SELECT -7L AS conv_id, n AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(n, role)"


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document contains, renamed or renumbered ones too."""
    return decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("key")


def op2_distribution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's counts and whether its histograms lie near those of its language."""
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op3_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each conversation's turns and trained replies, read back from its formatted examples."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.expand(turns.unionByName(spark.sql(PROBE))))


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by pseudonyms of the same format."""
    return pii.pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), KEY, count_col="n_replaced")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's token count and the hashes of its ids and of the bytes that they decode to."""
    done = bpe.round_trip(read_table(spark, sf_dir, "documents"), RANKS, PATTERN, keep=["doc_id"])
    return done.select("doc_id", bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host and path, and the longest rule that fits them."""
    return urls.judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each document that near-duplicate passages of others."""
    return passages.repeated_passages(read_table(spark, sf_dir, "documents"))


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's token count, found in flat token files of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    path = new_path(spark, "tokens")
    token_scan.write_token_files(bpe.encode(docs, RANKS, PATTERN, bits=16, never=token_scan.SEPARATOR, keep=[]), path)
    return token_scan.with_documents(token_scan.document_lengths(spark, path), token_scan.places(docs, "doc_id"))


def op9_setsketch_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's near-duplicate group, its smallest id, and whether it stays."""
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity by a model of the labelled rows that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has its label moved on first."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_kd_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors after ten rounds, with each vector's distance."""
    return clusters.cluster(read_table(spark, sf_dir, "embeddings"))


def op13_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place, length and checksum in Huffman-coded token files of all documents, read back from them."""
    path = new_path(spark, "token-files")
    tokens = written(token_output.encode(read_table(spark, sf_dir, "documents"), TOKENIZER, END, bits=16), "tokens")
    token_output.write(tokens, path, bits=16)
    return token_output.digests(spark, path)


QUERIES = {f.__name__: f for f in (
    op1_template_decontamination, op2_distribution_quality, op3_prefix_targets, op4_feistel_pseudonyms, op5_byte_bpe,
    op6_url_trie, op7_compact_windows, op8_separator_scan, op9_setsketch_duplicates, op10_subword_toxicity,
    op11_ball_tree_negatives, op12_kd_tree_clusters, op13_huffman_token_files,
)}

#: Queries that SQL can express; the others are tested against brute force, round trips or held-out labels.
SQL = {
    "op3_prefix_targets": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(role) + 8 AS size FROM t),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(size) AS size FROM e GROUP BY 1)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM g""",
    "op6_url_trie": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) v(rh, rp, verdict)),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM h JOIN r
      ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)""",
}
