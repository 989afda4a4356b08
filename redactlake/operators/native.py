"""Detectors that Catalyst runs alone: a pattern, a check of its digits, offsets from marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.functions.text import digits
from redactlake.operators.spans import marked_hits

# All repetitions are bounded: an unbounded one over a very long match exhausts the engine's stack.
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b"
CARD = r"\b(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{13,19})\b"
URL = r"\bhttps?://[A-Za-z0-9./?=&%#_~:+-]{3,500}"

#: entity, score, pattern, a quick test that spares most texts the search, a check of the value
DETECTORS: list[tuple[str, float, str, str, object]] = [
    ("EMAIL_ADDRESS", 1.0, EMAIL, "@", None),
    ("IP_ADDRESS", 0.95, IPV4, r"[0-9]\.[0-9]", None),
    ("CREDIT_CARD", 1.0, CARD, "[0-9]{4}", lambda v: F.call_function("luhn_check", digits(v))),
    ("URL", 0.6, URL, "https?:", None),
]


def hits(docs: DataFrame, pattern: str, test: str | None = None) -> DataFrame:
    """doc_id, start, end, value of a pattern's matches."""
    text = docs.select("doc_id", F.translate("text", "\x01", " ").alias("text"))
    if test:
        text = text.where(F.col("text").rlike(test))
    return marked_hits(text, F.regexp_replace("text", f"({pattern})", "\x01$1\x01"))


def detect(docs: DataFrame, entities: tuple[str, ...] | None = None) -> DataFrame:
    """Spans of the detectors of the given entities, all by default, in one scan; texts that none of their tests fits are passed over."""
    own = [d for d in DETECTORS if not entities or d[0] in entities]
    text = docs.select("doc_id", F.translate("text", "\x01", " ").alias("text")).where(F.col("text").rlike("|".join(f"(?:{test})" for *_, test, _ in own)))
    names = [f"p{k}" for k in range(len(own))]
    marks = [F.when(F.col("text").rlike(test), F.split(F.regexp_replace("text", f"({pattern})", "\x01$1\x01"), "\x01")).alias(n) for n, (_, _, pattern, test, _) in zip(names, own, strict=True)]
    split = text.select("doc_id", *marks)
    kinds = F.array(*[F.struct(F.lit(e).alias("entity"), F.lit(s).alias("score"), F.col(n).alias("p")) for n, (e, s, *_) in zip(names, own, strict=True)])
    pieces = split.select("doc_id", F.inline(F.filter(kinds, lambda k: F.size(k["p"]) > 1)))
    ends = F.aggregate("p", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    rows = pieces.withColumn("at", ends).select("doc_id", "entity", "score", "at", F.posexplode("p").alias("k", "value")).where(F.col("k") % 2 == 1)
    for entity, _, _, _, check in own:
        if check:
            rows = rows.where((F.col("entity") != entity) | check(F.col("value")))
    return rows.select("doc_id", F.col("at")[F.col("k")].alias("start"), (F.col("at")[F.col("k") + 1]).alias("end"), "entity", "score", F.lit(False).alias("from_ner"), F.lit("").alias("kind"), "value")


def with_context(found: DataFrame, docs: DataFrame, context: str, boost: float = 0.35, window: int = 60) -> DataFrame:
    """Raise the scores of spans that the text just before them announces."""
    from redactlake.functions.checks import boosted

    own = found.join(docs.select("doc_id", "text"), "doc_id")
    begin = F.greatest(F.col("start") - window, F.lit(0))
    before: Column = F.substring("text", begin + 1, F.col("start") - begin)
    return own.withColumn("score", boosted(F.col("score"), before, context, boost)).drop("text")
