"""A training corpus in stages, each written as Parquet before the next one reads it.

Every stage takes all documents that the one before kept. All but the last return the columns that they got;
`n_chars` follows the text. Stages handle nulls, empty texts, repeated rows and empty tables as their operators
do.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from featloom.llm import bpe, jaccard, langid, linededup, mixing
from featloom.llm.common import fresh, read, staged
from featloom.session import scratch_dir

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, whatever the input's labels allow to learn; one without a label gets the predicted one."""
    automata = langid.learn(docs.where(~langid.held_out()))
    lang, score, letter = fresh(docs, "lang_pred", "lang_score", "has_letter")
    known = langid.predict(docs, automata, lang_col=lang, score_col=score, letter_col=letter).where(F.col(letter))
    filled = F.coalesce(F.col("lang"), F.when(F.col(lang) != langid.UNKNOWN_LANGUAGE, F.col(lang)))
    return known.select(*[filled.alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; one that loses all its lines goes."""
    kept = linededup.drop_lines(docs).where("n_dropped < n_lines")
    columns = {c: F.col(f"doc.{c}") for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("doc.n_chars"))
    return kept.select(*[columns[c].alias(c) for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, a null id being the greatest.

    Of rows of one id each is judged by its own text. Rows of one id with equal texts are one document. Rows
    without words are near nothing, so those without an id stay all.
    """
    found = staged(jaccard.surplus(docs), "surplus")
    digest, id_, of = fresh(docs, "text_digest", "surplus_id", "surplus_of")
    marked = docs.withColumn(digest, jaccard.text_digest())
    key = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(digest) == F.col(of))

    def named(rows):
        return rows.select(F.col("doc_id").alias(id_), F.col("digest").alias(of))

    kept = marked.join(named(found), key, "left_anti").select(*docs.columns)
    repeated = found.where("stays")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(marked.join(named(repeated), key, "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the target of their source takes them."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256 of every document."""
    both = bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN)
    return both.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), "ids",
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join),
          ("mix_sources", mix_sources), ("byte_bpe", byte_bpe)]

ORACLE_SQL = None  # language ID, the join and BPE have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read(spark, sf_dir, "documents")
    folder = scratch_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
