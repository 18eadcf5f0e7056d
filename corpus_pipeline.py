"""A corpus pipeline of the language-model operators: every stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm import bpe, decontaminate, near_dup, pii, toxicity
from eventlake.llm.queries import KEY, PATTERN, RANKS
from eventlake.llm.shared import read_table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.3 or more; rows without text stay."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return near_dup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item, renamed or renumbered ones too."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pseudonyms_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format; n_chars follows the new text."""
    changed = pii.pseudonymise(docs, KEY)
    return changed.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (packed 32-bit integers), and whether decoding them gives the text again."""
    decoded = bpe.round_trip(docs, RANKS, PATTERN, keep=["doc_id", "text", "lang", "source"])
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return decoded.select("doc_id", "lang", "source", bpe.n_tokens("ids").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pseudonyms", pseudonyms_stage),
    ("tokens", tokens_stage),
]
#: SQL expresses neither a trained score nor sketches or BPE; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over documents; between two stages the rows are written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
