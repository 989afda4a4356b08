"""Corpus quality: leaks, over-masking, labels and fidelity as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n]+"), F.lit(0))).alias("word"))


def fidelity(want: DataFrame, got: DataFrame) -> DataFrame:
    """Words lost and words made, as differences of multisets, for each document that has any.

    One aggregate: each word counts 1 where it is wanted and -1 where it is got, partial sums first.
    """
    both = tokens(want).withColumn("n", F.lit(1)).unionByName(tokens(got).withColumn("n", F.lit(-1)))
    left = both.groupBy("doc_id", "word").agg(F.sum("n").alias("n")).where("n <> 0")
    return left.groupBy("doc_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("n_lost"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("n_made"))


def _pattern(value):
    """A value of the annotations as a pattern: ``re:`` before a regular expression, else a whole-word literal."""
    literal = F.concat(F.lit(r"(?U)(?<!\w)\Q"), value, F.lit(r"\E(?!\w)"))
    return F.when(value.startswith("re:"), F.expr("substring(value, 4)")).otherwise(literal)


def checks(outputs: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row per annotated value: document, kind (mask or keep), value, failed.

    outputs: document, redacted; annotations: document, kind, value.
    """
    both = annotations.join(outputs, "document")
    seen = F.regexp_like("redacted", _pattern(F.col("value")))
    return both.select("document", "kind", "value", F.when(F.col("kind").isin("mask", "absent"), seen).otherwise(~seen).alias("failed"))


def totals(found: DataFrame) -> DataFrame:
    """Checked values by document, and in total in the row whose document is null."""
    one = lambda kind, failed: F.sum(F.when((F.col("kind") == kind) & (F.col("failed") if failed else F.lit(True)), 1).otherwise(0))
    return found.rollup("document").agg(
        one("mask", False).alias("mask_total"), one("mask", True).alias("leaked"), one("keep", False).alias("keep_total"), one("keep", True).alias("missing")
    )


def report(outputs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Leaks and over-masking by document and in total."""
    return totals(checks(outputs, annotations))


def label_errors(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Mentions that should share a label and don't (same), or should differ and don't.

    labels: document, mention, label; groups: document, group_no, same, mention.
    """
    both = groups.join(labels, ["document", "mention"], "left")
    n = F.countDistinct(F.coalesce("label", F.lit("-")))
    per = both.groupBy("document", "group_no", "same").agg(n.alias("n"), F.countDistinct("mention").alias("m"))
    wrong = F.when(F.col("same"), F.col("n") > 1).otherwise(F.col("n") < F.col("m"))
    return per.select("document", "group_no", "same", wrong.alias("failed"))


GOLD = "document string, description string, `set` string, needs_ocr boolean, mask map<string, array<string>>, keep array<string>, absent_output array<string>, same_label array<array<string>>, distinct_labels array<array<string>>, present array<string>, absent array<string>"


def _labelled(values, kind: str, label, label_name: str, value_name: str):
    """Each of an array's values (none where it is null) beside a label."""
    return F.transform(F.coalesce(values, F.array().cast(kind)), lambda v: F.struct(F.lit(label).alias(label_name), v.alias(value_name)))


def annotations(spark, path: str) -> DataFrame:
    """Gold annotations, a JSON file a document, as rows of document, kind and value.

    kind: mask and absent (must not be seen), keep and present (must be). A document that can't be read gives no row.
    """
    gold = spark.read.schema(GOLD).option("multiLine", True).option("recursiveFileLookup", "true").json(path)
    parts = {"mask": F.flatten(F.map_values("mask")), "keep": F.col("keep"), "absent": F.col("absent_output"), "present": F.col("present")}
    rows = F.explode(F.flatten(F.array(*[_labelled(values, "array<string>", kind, "kind", "value") for kind, values in parts.items()])))
    return gold.where("document IS NOT NULL").select("document", rows.alias("x")).select("document", "x.kind", "x.value")


def label_groups(spark, path: str) -> DataFrame:
    """Groups of mentions of gold annotations that should share a label or differ: document, group_no, same, mention."""
    gold = spark.read.schema(GOLD).option("multiLine", True).option("recursiveFileLookup", "true").json(path)
    groups = F.concat(*[_labelled(F.col(c), "array<array<string>>", same, "same", "g") for c, same in (("same_label", True), ("distinct_labels", False))])
    rows = gold.where("document IS NOT NULL").select("document", F.posexplode(groups).alias("group_no", "x"))
    return rows.select("document", "group_no", "x.same", F.explode("x.g").alias("mention"))


def swallowed(outputs: DataFrame, docs: DataFrame, most: int = 200) -> DataFrame:
    """Documents of which a redacted span holds more than ``most`` characters: document, n_swallowed.

    outputs: document, spans (start, end); a span that long has taken text in.
    """
    long = F.size(F.filter("spans", lambda s: s["end"] - s["start"] > most))
    return outputs.join(docs, "document").select("document", long.alias("n_swallowed")).where("n_swallowed > 0")


def unsteady(first: DataFrame, second: DataFrame) -> DataFrame:
    """Documents whose two redactions differ: document."""
    same = F.col("a.redacted").eqNullSafe(F.col("b.redacted"))
    return first.alias("a").join(second.alias("b"), "document").where(~same).select("document")
