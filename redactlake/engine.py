"""The engine's interface over DataFrames.

Each call is one Arrow pass over the documents: nothing is shuffled, a task holds
one batch, and a lost task is simply run again.

Cases: a null or blank text has no spans and stays as it is; a text over the length
limit is refused with status 413 and no text, never cut; repeated rows give repeated
results; ids may be null.
"""

from __future__ import annotations

import json
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.config import EngineConfig
from redactlake.operators import document
from redactlake.operators.rules import Found

_SPANS = "array<struct<start:int,end:int,entity:string,score:double,label:string,kind:string,rule:string,value:string>>"
_REVIEW = "array<struct<term:string,count:int,reason:string>>"
_SPANS_ARROW = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string()), ("score", pa.float64()), ("label", pa.string()), ("kind", pa.string()), ("rule", pa.string()), ("value", pa.string())])
)
_REVIEW_ARROW = pa.list_(pa.struct([("term", pa.string()), ("count", pa.int32()), ("reason", pa.string())]))


class Engine:
    def __init__(self, config: EngineConfig = EngineConfig()):  # noqa: B008
        self.config = config

    def process(self, docs: DataFrame, allow: list[str] = (), deny: list[str] = (), model_spans: DataFrame | None = None) -> DataFrame:
        """doc_id, status, error, text_redacted, spans, review, and kept (the reasons why spans of a model stay readable) of each document.

        model_spans: doc_id, start, end, entity, score of an outside model.
        """
        config, allow, deny = self.config, list(allow), list(deny)
        rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        if model_spans is not None:
            given = model_spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "entity", "score")).alias("given"))
            rows = rows.join(given, "doc_id", "left")
        key = rows.schema["doc_id"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                out = []
                given = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
                for text, own in zip(batch.column(1).to_pylist(), given, strict=True):
                    if text is not None and len(text) > config.max_chars:
                        out.append((413, f"the text has {len(text)} characters, more than {config.max_chars}", None, [], [], []))
                        continue
                    own = [Found(g["start"], g["end"], g["entity"], g["score"], "model", from_ner=True) for g in own or ()]
                    found, kept = document.analyse(text or "", config, own, allow, deny)
                    spans = [
                        {"start": f.start, "end": f.end, "entity": f.entity, "score": round(f.score, 3), "label": label, "kind": f.kind, "rule": f.rule, "value": text[f.start : f.end]} for f, label in found
                    ]
                    redacted = document.redact(text, [(f.start, f.end, label) for f, label in found]) if text is not None else None
                    terms = document.review(text or "", [(f.start, f.end) for f, _ in found], kept, config.max_terms)
                    out.append((200, None, redacted, spans, [{"term": t, "count": n, "reason": r} for t, n, r in terms], [r for _, _, r in kept]))
                status, error, redacted, spans, terms, reasons = zip(*out, strict=True) if out else ((),) * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(status, pa.int32()), pa.array(error, pa.string()), pa.array(redacted, pa.string()), pa.array(spans, _SPANS_ARROW), pa.array(terms, _REVIEW_ARROW), pa.array(reasons, pa.list_(pa.string()))],
                    ["doc_id", "status", "error", "text_redacted", "spans", "review", "kept"],
                )

        return rows.mapInArrow(run, f"doc_id {key}, status int, error string, text_redacted string, spans {_SPANS}, review {_REVIEW}, kept array<string>")

    def detect(self, docs: DataFrame, allow: list[str] = (), deny: list[str] = (), model_spans: DataFrame | None = None) -> DataFrame:
        """One row per span."""
        return self.process(docs, allow, deny, model_spans).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")

    def redact(self, docs: DataFrame, **more) -> DataFrame:
        return self.process(docs, **more).select("doc_id", "status", "error", "text_redacted")

    def redact_with_review(self, docs: DataFrame, **more) -> DataFrame:
        return self.process(docs, **more).select("doc_id", "status", "error", "text_redacted", "review")

    def analyze(self, docs: DataFrame, **more) -> DataFrame:
        """doc_id and the detections as JSON: start, end, type, label, score, value."""
        shaped = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity"].alias("type"), s["label"].alias("label"), F.round(s["score"], 3).alias("score"), s["value"].alias("value")))
        return self.process(docs, **more).select("doc_id", F.to_json(shaped).alias("detections"))

    def apply(self, docs: DataFrame, chosen: DataFrame) -> DataFrame:
        """Redact docs by spans (doc_id, start, end, label) that someone has chosen."""
        from redactlake.operators.spans import redact

        return redact(docs, chosen, F.concat(F.lit("["), F.col("label"), F.lit("]")))

    def describe(self) -> str:
        """The settings as JSON."""
        return json.dumps({"status": "ok", "rules": len(document.rules.RULES), "ocr": False, "model": False} | asdict(self.config))
