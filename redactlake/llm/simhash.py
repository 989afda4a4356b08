"""SimHash near-dedup by tiled exact comparison.

A fingerprint has a bit for each of 64 places of XXH64 over the word shingles of a
text. Distinct fingerprints are sorted by their population counts (of all bits,
then of each 16-bit quarter) and cut into tiles. Counts that differ by more than
the radius prove a larger distance, so tiles meet only where their ranges of counts
lie within it: an equi-join on the total count, then a bound from the quarters. Two
tiles are compared whole with exclusive-or and bit counts, and of their links a
spanning forest is returned, so a group of copies never becomes all its pairs.

The quarters' bound leaves about 5 in 100 tile pairs of evenly spread fingerprints
once tiles are narrow; work still grows with the square of distinct fingerprints.

Cases: null, empty and blank texts have fingerprint zero and are linked like any
other; repeated rows share a fingerprint; a null id never names a component unless
all its ids are null; an empty table gives an empty result; other columns are kept
by ``drop_near_copies`` and not looked at.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from redactlake.llm.common import free_name, row_key, slim, stage
from redactlake.llm.components import stars

WORDS = 3
SEED = 42
RADIUS = 3
TILE = 4096
ROWS = 256  # rows of a tile that are compared at once
STEP = 1 << 16  # shingles that are hashed at once


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bits that are set in over half of the hashes of all shingles."""
    ws = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not ws:
        return 0
    n = max(1, len(ws) - words + 1)
    sums = np.zeros(64, dtype=np.int64)
    for at in range(0, n, STEP):
        part = ws[at : at + STEP + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False)) if len(ws) >= words else [b" ".join(ws)]
        h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _tiles(batches):
    """Sorted fingerprints -> tiles with the range of each count."""
    held = np.zeros(0, dtype=np.int64)

    def row(fp: np.ndarray):
        u = fp.view(np.uint64)
        counts = [np.bitwise_count(u), *(np.bitwise_count((u >> np.uint64(16 * k)) & np.uint64(0xFFFF)) for k in range(4))]
        low, high = ([int(f(c)) for c in counts] for f in (np.min, np.max))
        return pa.RecordBatch.from_arrays(
            [pa.array([int(fp[0])]), pa.array([low], pa.list_(pa.int32())), pa.array([high], pa.list_(pa.int32())), pa.array([fp.astype("<i8").tobytes()], pa.binary())], ["tile", "low", "high", "fps"]
        )

    for batch in batches:
        held = np.concatenate([held, batch.column(0).to_numpy()])
        while len(held) >= TILE:
            yield row(held[:TILE])
            held = held[TILE:]
    if len(held):
        yield row(held)


class Forest:
    """Union-find over array positions, in numpy; roots are the lowest positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        while len(a):
            while True:
                top = up[up]
                if np.array_equal(top, up):
                    break
                up = top
            a, b = up[a], up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            up[np.maximum(a, b)] = np.minimum(a, b)
        self.up = up


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between and, if they are the same, in two tiles of fingerprints."""
    own = np.array_equal(a, b)
    nodes = np.unique(np.concatenate([a, b]))
    at, bt = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    forest = Forest(len(nodes))
    for i in range(0, len(a), ROWS):
        near = np.bitwise_count(a[i : i + ROWS, None].view(np.uint64) ^ b[None, :].view(np.uint64)) <= radius
        x, y = np.nonzero(near)
        x, y = at[x + i], bt[y]
        keep = x < y if own else x != y
        forest.join(x[keep], y[keep])
    up = forest.up
    while not np.array_equal(up[up], up):
        up = up[up]
    child = np.flatnonzero(up != np.arange(len(up)))
    return nodes[child], nodes[up[child]]


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                u, v = tile_links(np.frombuffer(a.as_buffer(), dtype=np.int64), np.frombuffer(b.as_buffer(), dtype=np.int64), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that span all pairs of distinct fingerprints fp within the radius."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    ordered = distinct.select("fp", F.bit_count("fp").alias("c"), *(q.alias(f"q{k}") for k, q in enumerate(quarter))).sort("c", "q0", "q1", "q2", "q3", "fp")
    tiles = stage(ordered.select("fp").mapInArrow(_tiles, "tile long, low array<int>, high array<int>, fps binary"), "tiles")
    box = tiles.select("tile", "low", "high")
    # A tile is listed under each total count it holds, its partner also up to the radius
    # above; a pair is taken at the lowest count they share and so once.
    left = box.select("tile", "low", "high", F.explode(F.sequence(F.col("low")[0], F.col("high")[0])).alias("c"))
    right = box.select(
        F.col("tile").alias("tile2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(F.sequence(F.col("low")[0] - radius, F.col("high")[0])).alias("c")
    )
    gap = [F.greatest(F.col("low")[k] - F.col("high2")[k], F.col("low2")[k] - F.col("high")[k], F.lit(0)) for k in range(5)]
    pairs = (
        left.join(right, "c")
        .where(F.col("c") == F.greatest(F.col("low")[0], F.col("low2")[0] - radius))
        .where((F.col("low")[0] < F.col("low2")[0]) | (F.col("low")[0] == F.col("low2")[0]) & (F.col("tile") <= F.col("tile2")))
        .where((gap[0] <= radius) & (gap[1] + gap[2] + gap[3] + gap[4] <= radius))
        .select("tile", "tile2")
    )
    pairs = stage(pairs, "tile-pairs")
    n = distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")
    both = (
        pairs.join(tiles.select("tile", F.col("fps").alias("a")), "tile")
        .join(tiles.select(F.col("tile").alias("tile2"), F.col("fps").alias("b")), "tile2")
        .repartition(int(n) * 2, "tile", "tile2")
    )
    return both.select("a", "b").mapInArrow(_compare(radius), "u long, v long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest id that links reach)."""
    base = stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = stage(base.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    star = stars(links(distinct, radius))
    member = distinct.join(star.select(F.col("u").alias("fp"), F.col("v").alias("top")), "fp", "left").withColumn("top", F.coalesce("top", "fp"))
    name = member.groupBy("top").agg(F.min("first").alias("component_id"))
    of = member.join(name, "top").select("fp", "component_id")
    return base.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each component: that with the smallest id; of several rows of one id, the first by a hash of the row."""
    found = classes(docs, id_col, text_col, words, radius)
    key, name = free_name(docs, "near_key"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("id")
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")).distinct()
    rows = docs.select(name, row_key(docs, id_col).alias(f"{key}_r")).groupBy("id").agg(F.min(f"{key}_r").alias(f"{key}_r"))
    keep = rows.join(own, "id", "left_semi").select(f"{key}_r")
    marked = docs.withColumn(key, row_key(docs, id_col))
    return marked.join(keep, marked[key] == keep[f"{key}_r"], "left_semi").dropDuplicates([key]).drop(key)
