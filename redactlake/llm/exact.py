"""Exact dedup with a split between heavy and ordinary digests.

Misra-Gries summaries of the digests find every digest that may hold more than a
share ``HEAVY`` of the rows. Their counts and winners are computed exactly from
partial aggregates and, being at most ``2 / HEAVY`` rows, broadcast: rows of heavy
digests never meet in one task. The other digests take an ordinary shuffle, where
no group is larger than that share.

Cases: a null text counts as empty; empty texts are copies of each other; a null
id loses to any other id of the same length; of repeated rows (same id and text)
one stays; an empty table gives an empty result; other columns are not looked at, but
that ``drop_copies`` takes rows of one id and text in the order of a hash of them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.common import SPACES, free_name, row_key, slim, stage

HEAVY = 0.001  # share of rows above which a digest is heavy for certain
COUNTERS = 2000  # counters of a Misra-Gries summary: 2 / HEAVY


def bare(text):
    """The text without white space, by plain byte replacements."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digest(text):
    return F.sha2(bare(text), 256)


def misra_gries(counters: int):
    """mapInArrow function: digests -> (digest, counter) of one partition."""

    def summarise(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for d in batch.column(0).to_pylist():
                if d in held:
                    held[d] += 1
                elif len(held) < counters:
                    held[d] = 1
                else:
                    held = {k: n - 1 for k, n in held.items() if n > 1}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["text_sha256", "counter"]
        )

    return summarise


def heavy_digests(base: DataFrame) -> DataFrame:
    """The digests that may hold over HEAVY of the rows, at most 2 / HEAVY of them.

    Partition counters fall short of true counts by at most rows / (COUNTERS + 1) in
    all, so every digest with over HEAVY * total rows reaches half of that; counters
    sum to no more than the rows, so at most 2 / HEAVY digests do.
    """
    total = base.count()
    held = base.select("text_sha256").mapInArrow(misra_gries(COUNTERS), "text_sha256 string, counter long")
    return held.groupBy("text_sha256").agg(F.sum("counter").alias("counter")).where(F.col("counter") >= max(2, HEAVY * total / 2)).select("text_sha256")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The row that stays has the most code points in its original text, then the
    smallest id.
    """
    base = stage(
        slim(docs, id_col, text_col).select(
            "doc_id",
            digest(F.col("text")).alias("text_sha256"),
            F.length("text").alias("n"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "exact-base",
    )
    heavy = heavy_digests(base)
    best = F.max(F.struct(F.col("n"), (-F.col("doc_id")).alias("neg"), (-F.col("rid")).alias("rid")))
    verdict = [
        F.col("doc_id"),
        (-F.col("best.neg")).alias("keep_id"),
        F.col("group_size"),
        (F.col("rid") == -F.col("best.rid")).alias("kept"),
        F.col("text_sha256"),
    ]
    winners = stage(
        base.join(F.broadcast(heavy), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")),
        "exact-heavy",
    )
    known = F.broadcast(winners)
    light = base.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = light.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    return base.join(known, "text_sha256").select(verdict).unionByName(light.join(groups, "text_sha256").select(verdict))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Copies of heavy digests go where they are read, by the broadcast winners; the
    winners of the others come from partial aggregates of keys, and rows with their texts are
    shuffled once, to those.
    """
    sha, key = free_name(docs, "exact_sha"), free_name(docs, "exact_key")
    marked = docs.withColumns({sha: digest(F.coalesce(F.col(text_col), F.lit(""))), key: row_key(docs, id_col)})
    base = stage(
        marked.select(F.col(sha).alias("text_sha256"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), (-F.col(id_col).cast("long")).alias("neg"), F.col(key).alias("key")), "exact-base"
    )
    best = F.max(F.struct("n", "neg", "key"))["key"].alias("key")
    heavy = heavy_digests(base)
    winners = stage(base.join(F.broadcast(heavy), "text_sha256", "left_semi").groupBy("text_sha256").agg(best), "exact-heavy")
    light = base.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").groupBy("text_sha256").agg(best)
    known = winners.select(F.col("text_sha256").alias(f"{sha}_r"), F.col("key").alias(f"{key}_r"))
    ordinary = marked.join(F.broadcast(known.select(f"{sha}_r")), marked[sha] == F.col(f"{sha}_r"), "left_anti")
    one = light.select(F.concat("text_sha256", F.lit("/"), "key").alias(f"{key}_r"))
    ordinary = ordinary.withColumn(key, F.concat(sha, F.lit("/"), key))
    kept = ordinary.join(one, ordinary[key] == one[f"{key}_r"], "left_semi").dropDuplicates([key])
    first = marked.join(F.broadcast(known), (marked[sha] == F.col(f"{sha}_r")) & (marked[key] == F.col(f"{key}_r")), "left_semi").dropDuplicates([key])
    return kept.select(docs.columns).unionByName(first.select(docs.columns))
