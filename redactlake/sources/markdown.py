"""Markdown from redacted text: only white space changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def render(text: Column) -> Column:
    """Trimmed lines without blank ones; an empty line between paragraphs, none between rows of a table."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x != "")
    state = F.struct(F.lit("").alias("out"), F.lit(False).alias("row"))

    def step(a: Column, x: Column) -> Column:
        row = x.startswith("|")
        gap = F.when(a["out"] == "", "").when(a["row"] & row, "\n").otherwise("\n\n")
        return F.struct(F.concat(a["out"], gap, x).alias("out"), row.alias("row"))

    return F.aggregate(lines, state, step, lambda a: F.when(a["out"] == "", "").otherwise(F.concat(a["out"], F.lit("\n"))))
