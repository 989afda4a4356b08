"""The engine's functions for SQL: register(spark), then use them in queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from redactlake.config import EngineConfig
from redactlake.operators import document


def _redacted(text: str | None, config: EngineConfig) -> str | None:
    if text is None:
        return None
    found, _ = document.analyse(text, config)
    return document.redact(text, [(f.start, f.end, label) for f, label in found])


@udtf(returnType="start int, end int, entity string, score double, label string, value string")
class Detections:
    """Rows of a text's spans: SELECT ... FROM documents, LATERAL detections(text)."""

    def eval(self, text: str):
        for f, label in document.analyse(text or "")[0]:
            yield f.start, f.end, f.entity, f.score, label, text[f.start : f.end]


def register(spark: SparkSession, config: EngineConfig = EngineConfig()) -> None:  # noqa: B008
    """Functions redact_text, detections, enterprise_ok, national_number_ok and account_ok."""

    @pandas_udf("string")
    def redact_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: _redacted(t, config), na_action="ignore")

    spark.udf.register("redact_text", redact_text)
    spark.udtf.register("detections", Detections)
    for name, body in {
        "enterprise_ok": "length(d) = 10 AND 97 - CAST(left(d, 8) AS BIGINT) % 97 = CAST(right(d, 2) AS BIGINT)",
        "national_number_ok": "length(d) = 11 AND CAST(right(d, 2) AS BIGINT) IN (97 - CAST(left(d, 9) AS BIGINT) % 97, 97 - CAST(concat('2', left(d, 9)) AS BIGINT) % 97)",
        "account_ok": "length(d) = 12 AND coalesce(nullif(CAST(left(d, 10) AS BIGINT) % 97, 0), 97) = CAST(right(d, 2) AS BIGINT)",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(d STRING) RETURNS BOOLEAN RETURN {body}")
