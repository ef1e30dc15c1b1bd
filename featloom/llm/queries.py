"""The registered queries of this package, and their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from featloom.llm import (bpe, fill_middle, fingerprint, html_extract, jaccard, langid, lexical, linededup, mixing, passages,
                          personal, topk, warc)
from featloom.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


@query()
def op1_fingerprints(spark, sf_dir):
    return fingerprint.edited(read(spark, sf_dir, "documents"))


@query()
def op2_language_id(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents"))


@query()
def op3_suffix_dedup(spark, sf_dir):
    return passages.digests(read(spark, sf_dir, "documents"))


@query()
def op4_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


@query(linededup.ORACLE)
def op5_line_dedup(spark, sf_dir):
    return linededup.digests(read(spark, sf_dir, "documents"))


@query(warc.ORACLE)
def op6_warc(spark, sf_dir):
    return warc.archive(read(spark, sf_dir, "pages"))


@query()
def op7_html_extraction(spark, sf_dir):
    return html_extract.extract(read(spark, sf_dir, "pages"))


@query(mixing.ORACLE)
def op8_mixing(spark, sf_dir):
    return mixing.mix_sizes(read(spark, sf_dir, "documents"))


@query()
def op9_byte_bpe(spark, sf_dir):
    return bpe.digests(read(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


@query(topk.ORACLE)
def op10_top_k(spark, sf_dir):
    vectors = topk.integers(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.search(vectors, vectors.where(F.col("id") % 20 == 0))


@query()
def op11_fill_middle(spark, sf_dir):
    return fill_middle.digests(read(spark, sf_dir, "documents"))


@query(lexical.ORACLE)
def op12_lexical(spark, sf_dir):
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query()
def op13_personal_data(spark, sf_dir):
    return personal.digests(read(spark, sf_dir, "documents"))
