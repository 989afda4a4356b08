"""Benchmark decontamination by a generalised suffix automaton of test items.

Items become word sequences of one automaton. A document's words stream through
it, which gives the longest match that ends at each word; a match of at least
``window`` words, or one that holds a whole shorter item, marks its words. Runs of
words that no item uses are skipped, as nothing in them can match.

The automaton holds at most ``BLOCK_WORDS`` item words. A larger benchmark is cut
into blocks of whole items, each with its own automaton over all documents. Documents
are then staged once; a block writes only the marks that it finds, and those of a
document are united at the end, so texts move once, however many blocks there are.

Cases: null and empty texts have no words; an item without words never matches;
items of one id count once, and those with a null id as the id ''; an empty
benchmark marks nothing; repeated rows give repeated rows with one block; other
columns are not looked at, or kept as they are by ``clean``.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactlake.llm.common import free_name, slim, stage

WINDOW = 10
BLOCK_WORDS = 200_000

# A byte of a word stays (A-Z as a-z); any other becomes a blank.
_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_BYTES).split()


class Automaton:
    """Suffix automaton of the word sequences of (item id, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        seqs = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for item, ws in items if ws]
        self.size = max(1, len(self.vocab))
        self.go: dict[int, int] = {}
        self.out: list[list[int]] = [[]]  # words on which a state goes on; only while building
        self.length, self.link = [0], [-1]
        for _, seq in seqs:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        del self.out
        self.shortest = min((min(window, len(s)) for _, s in seqs), default=window)
        self.full: dict[int, set[str]] = {}  # state of a window -> items
        self.short: dict[int, list[tuple[int, str]]] = {}  # state -> (words, item) of whole shorter items
        for item, seq in seqs:
            n = min(window, len(seq))
            for i, (state, size) in enumerate(self.stream(seq)):
                if size >= n and i + 1 >= n:
                    at = self._cut(state, n)
                    if n == window:
                        self.full.setdefault(at, set()).add(item)
                    elif i + 1 == n:
                        self.short.setdefault(at, []).append((n, item))

    def _state(self, length: int, link: int, like: int | None = None) -> int:
        k = len(self.length)
        self.length.append(length)
        self.link.append(link)
        self.out.append([])
        if like is not None:
            for w in self.out[like]:
                self.go[k * self.size + w] = self.go[like * self.size + w]
            self.out[k] = list(self.out[like])
        return k

    def _split(self, p: int, w: int) -> int:
        """The state for p's string and w, apart from longer strings."""
        q = self.go[p * self.size + w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], like=q)
        self.link[q] = clone
        while p >= 0 and self.go.get(p * self.size + w) == q:
            self.go[p * self.size + w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if last * self.size + w in self.go:
            return self._split(last, w)
        new = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and p * self.size + w not in self.go:
            self.go[p * self.size + w] = new
            self.out[p].append(w)
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def _cut(self, state: int, n: int) -> int:
        """The state of the last n words of a state's strings."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def stream(self, seq):
        """After each word: the state and the length of the longest match that ends there."""
        go, link, length, size = self.go, self.link, self.length, self.size
        state = match = 0
        for w in seq:
            to = go.get(state * size + w)
            while to is None and state:
                state = link[state]
                match = length[state]
                to = go.get(state * size + w)
            if to is None:
                match = 0
            else:
                state = to
                match += 1
            yield state, match

    def find(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Marked word ranges (half-open, ascending, apart) and the items that occur."""
        if len(ws) < self.shortest or not self.go:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, ws, repeat(-1)), dtype=np.int64, count=len(ws))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            for i, (state, match) in enumerate(self.stream(ids[a:b].tolist()), a + 1):
                if match < self.shortest:
                    continue
                if match >= self.window:
                    ranges.append((i - match, i))
                    items |= self.full[self._cut(state, self.window)]
                if self.short:
                    at = state
                    while at > 0:
                        for n, item in self.short.get(at, ()):
                            if n <= match:
                                ranges.append((i - n, i))
                                items.add(item)
                        at = self.link[at]
        return united(ranges), items


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """An automaton for each block of the benchmark; items come to the driver one block at a time."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    held, size = [], 0
    for item, text in rows.toLocalIterator():
        ws = words(text)
        if held and size + len(ws) > block_words:
            yield Automaton(held, window)
            held, size = [], 0
        held.append((item, ws))
        size += len(ws)
    yield Automaton(held, window)


MARKS = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("ranges", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))]
)
_MARKS_ARROW = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def _with_block(docs: DataFrame, text: str, found: str, automaton: Automaton) -> DataFrame:
    """docs with a struct of n_words, ranges and items."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(text).to_pylist():
                ws = words(t)
                ranges, items = shared.value.find(ws)
                out.append({"n_words": len(ws), "ranges": ranges, "items": sorted(items)})
            yield batch.append_column(found, pa.array(out, _MARKS_ARROW))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(found, MARKS)]))


def _hits(rows: DataFrame, automaton: Automaton) -> DataFrame:
    """Of rows of row and text the marks of those that have any."""
    shared = rows.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        for batch in batches:
            found = [(row, *shared.value.find(words(t))) for row, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            found = [(row, ranges, sorted(items)) for row, ranges, items in found if ranges]
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *(_MARKS_ARROW.field(k).type for k in (1, 2))), strict=True)], ["row", "ranges", "items"])

    return rows.mapInArrow(run, "row long, ranges array<array<bigint>>, items array<string>")


def with_marks(docs: DataFrame, benchmark: DataFrame, text_col: str, found: str, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the struct column found."""
    blocks = automata(benchmark, window=window, block_words=block_words)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _with_block(docs, text_col, found, first)
    row = free_name(docs, "decontam_row")
    base = stage(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-rows")
    texts = base.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    parts = [stage(_hits(texts, a), "decontam-hits") for a in chain((first, second), blocks)]
    marked = reduce(DataFrame.unionByName, parts).groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list("ranges")).alias(f"{row}_r"), F.array_distinct(F.flatten(F.collect_list("items"))).alias(f"{row}_i"))
    both = base.join(marked, row, "left")

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (text_col, f"{row}_r", f"{row}_i"))
            out = [{"n_words": len(words(t)), "ranges": united([*map(tuple, r or ())]), "items": sorted(i or ())} for t, r, i in zip(*columns, strict=True)]
            yield batch.drop_columns([row, f"{row}_r", f"{row}_i"]).append_column(found, pa.array(out, _MARKS_ARROW))

    return both.select(*docs.columns, row, f"{row}_r", f"{row}_i").mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(found, MARKS)]))


def marks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, ranges of marked words, items that occur."""
    return with_marks(slim(docs, id_col, text_col), benchmark, "text", "found", window, block_words).select("doc_id", "found.*")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return marks(docs, benchmark, id_col, text_col, window).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each range."""
    data = text.encode("utf-8", "replace")
    spans = [m.span() for m in _WORD.finditer(data.translate(_BYTES))]
    out, at = [], 0
    for a, b in ranges:
        out.append(data[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8")


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    coverage: float = 0.0,
    longest: int | None = None,
    length_col: str | None = "n_chars",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """docs without contamination, in their own columns.

    A document of which more than ``coverage`` of the words are marked goes, and so does
    one with a marked span of over ``longest`` words; from the others the marked spans are cut,
    and ``length_col``, where there is one, follows. With 0, every marked document goes.
    """
    found = free_name(docs, "decontam_found")
    marked = with_marks(docs, benchmark, text_col, found, window, block_words)
    ranges = F.col(found)["ranges"]
    hit = F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    kept = marked.where(hit <= F.col(found)["n_words"] * coverage)
    if coverage <= 0:
        return kept.drop(found)
    if longest is not None:
        kept = kept.where(~F.exists(ranges, lambda r: r[1] - r[0] > longest))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([without(t, [tuple(r) for r in m]) if t is not None and len(m) else t for t, m in zip(texts, marks, strict=True)], dtype=object)

    kept = kept.withColumn(text_col, cut(F.col(text_col), ranges))
    if length_col in docs.columns:
        changed = F.when(F.size(ranges) > 0, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
        kept = kept.withColumn(length_col, changed)
    return kept.select(docs.columns)
