"""A corpus pipeline of five stages over documents.

Each stage works on all documents that the one before kept, and what it decides
takes effect: it returns the documents that stay, with their columns; the last one
returns them with their token ids in place of their text.

Cases: null, empty and letterless texts go in the first stage, as no language can be
told; of repeated rows one stays; null ids are kept like any other; nulls in other
columns and extra columns, whatever their names, pass through the stages; an empty table
gives an empty result; very long texts are worked on whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from redactlake.llm import common, decontam, exact, langid, prefix_bpe, simhash


def identify_language(spark, docs, sf_dir):
    """Documents go whose language the model can't tell: without a letter, or with no language likelier than all others together."""
    return langid.accept(docs)


def drop_exact_copies(spark, docs, sf_dir):
    """One document of each group of texts that are equal without white space stays."""
    return exact.drop_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each component of SimHash links stays."""
    return simhash.drop_near_copies(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold ten words in a row of a test item, or a whole shorter one, go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark, docs, sf_dir):
    """The documents' byte-level BPE ids, and whether they decode to the text."""
    found = prefix_bpe.with_ids(docs.select("doc_id", "lang", "source", "n_chars", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", decontaminate),
    ("byte_level_bpe", encode),
]

#: Naive Bayes, SimHash and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage(docs, name)
    return docs
