"""Removal of byte strings that an earlier document holds, by ranks at growing lengths.

Plain prefix doubling sorts a row for every byte in each of its rounds, twenty times
the input a round. Here ranks are hashes, equal in all tasks for equal strings, so a
round needs no sort to name them, and rounds work on fewer and fewer positions:

1. Each window of ``window`` bytes is stood for by its anchor, the gram of ``gram``
   bytes in it with the lowest rank (equal windows have it at the same place), and
   neighbouring windows with one anchor by one row. Rows are dealt by the anchor's
   rank and sorted by the pair (rank of the gram, rank of all bytes of the row's
   windows). A row whose pair an earlier document has repeats whole; a gram that
   one document alone holds is past the threshold and done.
2. What is left, rows whose gram an earlier document has in other surroundings, is
   doubled out to single windows, which are sorted by their ranks.

Texts are packed in chunks of documents, staged in buckets of a table, so rounds
join with them without moving them. Within a chunk, repeats are settled before the
deal: a chunk sends one document's rows for a pair, so no frequent string makes a
large group. A gram that stands in many surroundings would make one all the same:
grams that ``HOT`` of the documents of a sample of chunks hold are dealt by the whole pair, all
their rows go on to the second round, and their windows are dealt by their own ranks. That only says where rows meet, so the result
is the same whatever the sample holds.

No bytes are compared. The first round compares 48 bits of the gram's rank and 64 of its
surroundings', the second the 64 bits of a window's rank and 32 of an independent one.

Cases: a null text counts as empty; texts under ``window`` bytes lose nothing;
documents of one id (repeated rows) never remove from each other; a null id comes
after all others; very long texts make chunks of their own; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm import common
from redactlake.llm.common import slim
from redactlake.llm.grams import Ranks, anchors, mixed

WINDOW = 50
GRAM = 20
CHUNK = (2 << 20) - 1  # bytes of text in a chunk; ranks take about a hundred times that for a while
BUCKET = 24 << 20  # bytes of text for each bucket of ranks
LAST = np.iinfo(np.int64).max  # stands for a null id
SPAN = 255  # windows in a row, at most
HOT, SAMPLED = 0.005, 48  # share of documents that makes a gram hot; chunks in the sample


# Packed rows: columns byte by byte, so that like bytes lie together, then compressed.


def pack(*columns: np.ndarray) -> bytes:
    parts = [np.array([len(columns), len(columns[0])], dtype="<u4").tobytes()]
    for c in columns:
        kind = c.dtype.newbyteorder("<")
        parts += [kind.str.encode().ljust(4), np.ascontiguousarray(c.astype(kind)).view(np.uint8).reshape(len(c), kind.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    k, n = np.frombuffer(data, dtype="<u4", count=2).tolist()
    at, out = 8, []
    for _ in range(k):
        kind = np.dtype(data[at : at + 4].decode().strip())
        size = kind.itemsize * n
        out.append(np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8, count=size, offset=at + 4).reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += 4 + size
    return out


def split48(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of ranks as two columns."""
    return (x >> np.uint64(32)).astype(np.uint16), (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def join48(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(32) | low


def _packed(batches, most: int):
    """Documents -> chunks: key, ids, sizes, compressed bytes."""
    ids: list[int] = []
    texts: list[bytes] = []
    held = 0

    def row():
        nonlocal held
        data = zstandard.ZstdCompressor(3).compress(b"".join(texts))
        out = pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([np.array(ids, dtype="<i8").tobytes()], pa.binary()), pa.array([np.array(list(map(len, texts)), dtype="<i8").tobytes()], pa.binary()), pa.array([data], pa.binary())],
            ["chunk", "ids", "sizes", "data"],
        )
        ids.clear()
        texts.clear()
        held = 0
        return out

    for batch in batches:
        for k, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            text = t.as_py()
            if texts and held + len(text) > most:
                yield row()
            ids.append(LAST if k.as_py() is None else k.as_py())
            texts.append(text)
            held += len(text)
    if texts:
        yield row()


def _opened(ids, sizes, data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, sizes = (np.frombuffer(x.as_buffer(), dtype="<i8") for x in (ids, sizes))
    raw = zstandard.ZstdDecompressor().decompress(data.as_py(), max_output_size=max(1, int(sizes.sum())))
    return ids, sizes, np.frombuffer(raw, dtype=np.uint8)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Number of the group of equal keys that each of sorted rows is in."""
    new = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _first_ids(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each sorted row's group."""
    if not len(ids):
        return ids
    return np.minimum.reduceat(ids, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))[group]


def _settle(ids: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Rows whose keys a smaller id has too."""
    order = np.lexsort(keys)
    group = _groups(*(k[order] for k in keys))
    out = np.zeros(len(ids), dtype=bool)
    out[order] = ids[order] > _first_ids(group, ids[order])
    return out


def _deal(bucket: np.ndarray, rows: list[np.ndarray], own_ids: np.ndarray, doc: np.ndarray):
    """(bucket, blob of ids, blob of rows) of each bucket; rows keep their order in it."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            docs, at = np.unique(doc[part], return_inverse=True)
            yield int(bucket[part[0]]), pack(docs.astype(np.uint32), own_ids[docs]), pack(at.astype(np.uint16 if len(docs) < 1 << 16 else np.uint32), *(r[part] for r in rows))


_OUT = "kind int, chunk string, bucket int, docs binary, rows binary"
REPEATS, ROWS, ASKED, WINDOWS = range(4)  # kinds of packed rows


def _batch(found: list[tuple]):
    if found:
        kind, chunk, bucket, docs, rows = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(chunk, pa.string()), pa.array(bucket, pa.int32()), pa.array(docs, pa.binary()), pa.array(rows, pa.binary())], ["kind", "chunk", "bucket", "docs", "rows"]
        )


def _bucket(rank: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors have low ranks, so ranks are mixed once more for an even deal."""
    return ((mixed(rank) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _grams_held(window: int, gram: int):
    """Chunks -> grams of anchors, with the documents that hold them, and in each chunk's first row the number of its documents."""

    def run(batches):
        for batch in batches:
            for ids, sizes, data in zip(*batch.columns, strict=True):
                own, sizes, raw = _opened(ids, sizes, data)
                ranks = Ranks(raw)
                a, _, _, doc = anchors(ranks, sizes, window, gram)
                pairs = np.unique(np.stack([ranks.at(a, a + gram).view(np.int64), doc]), axis=1)
                g, n = np.unique(pairs[0], return_counts=True)
                more = n > max(1, HOT * len(own) / 4)  # others fall short by a quarter of the share at most
                docs = np.concatenate([[len(own)], np.zeros(more.sum(), dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[0], g[more]])), pa.array(np.concatenate([[0], n[more]])), pa.array(docs)], ["g", "n", "docs"])

    return run


def hot_grams(chunks: DataFrame, window: int, gram: int) -> np.ndarray:
    """Ranks of grams that many documents of a sample of chunks hold: at most 1 / HOT for each anchor of a mean document."""
    keys = [r.chunk for r in chunks.select("chunk").orderBy("chunk").limit(SAMPLED).collect()]
    few = chunks.where(F.col("chunk").isin(keys)).select("ids", "sizes", "data")
    held = common.stage(few.mapInArrow(_grams_held(window, gram), "g long, n long, docs long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "repeats-grams")
    total = held.agg(F.sum("docs")).first()[0] or 0
    found = held.where((F.col("docs") == 0) & (F.col("n") > max(1.0, HOT * total))).select("g").toArrow()
    return np.sort(found.column("g").to_numpy().view(np.uint64))


def _first_round(window: int, gram: int, buckets: int, hot: np.ndarray):
    """Chunks -> rows of windows with one anchor, dealt by its rank; repeats within the chunk settled."""

    def run(batches):
        for batch in batches:
            for key, *packed in zip(*batch.columns, strict=True):
                chunk = key.as_py()
                ids, sizes, data = _opened(*packed)
                ranks = Ranks(data)
                a, low, high, doc = anchors(ranks, sizes, window, gram)
                g = ranks.at(a, a + gram)
                r = ranks.at(low, high + window) ^ mixed((a - low).astype(np.uint64) * np.uint64(SPAN + 1) + (high - low).astype(np.uint64))
                begin = np.cumsum(sizes) - sizes
                place, more = low - begin[doc], high - low
                repeat = _settle(ids[doc], r, g)
                found = []
                if repeat.any():  # goes along with some bucket
                    found.append((REPEATS, chunk, int(key.as_py()[:8], 16) % buckets, b"", pack(doc[repeat].astype(np.uint32), place[repeat], more[repeat].astype(np.uint8))))
                rest = np.flatnonzero(~repeat)
                rest = rest[np.argsort(g[rest])]
                own_hot = np.isin(g[rest], hot)
                bucket = _bucket(np.where(own_hot, g[rest] ^ r[rest], g[rest]), buckets)
                high48 = split48(g[rest] & np.uint64((1 << 48) - 1))
                where = place[rest].astype(np.uint32 if sizes.max(initial=0) < 1 << 32 else np.uint64)
                for b, docs, rows in _deal(bucket, [*high48, r[rest], where, (more[rest] + own_hot * (SPAN + 1)).astype(np.uint16)], ids, doc[rest]):
                    found.append((ROWS, chunk, b, docs, rows))
                yield from _batch(found)

    return run


def _gathered(table: pa.Table):
    """Chunk number, document in it, id and columns of all rows of a bucket."""
    chunks, source, doc, ids, cols = [], [], [], [], []
    for chunk, docs, rows in zip(*(table.column(c) for c in ("chunk", "docs", "rows")), strict=True):
        own, own_ids = unpack(docs.as_py())
        at, *rest = unpack(rows.as_py())
        source.append(np.full(len(at), len(chunks)))
        chunks.append(chunk.as_py())
        doc.append(own[at])
        ids.append(own_ids[at])
        cols.append(rest)
    return chunks, np.concatenate(source), np.concatenate(doc), np.concatenate(ids), cols


def _by_chunk(kind: int, bucket: int, chunks: list[str], source: np.ndarray, pick: np.ndarray, cols: list[np.ndarray]):
    pick = pick[np.argsort(source[pick], kind="stable")]
    for part in np.split(pick, np.flatnonzero(np.diff(source[pick])) + 1):
        if len(part):
            yield kind, chunks[source[part[0]]], bucket, b"", pack(*(c[part] for c in cols))


def _pairs_of_bucket(table: pa.Table) -> pa.Table:
    """Sort a bucket's rows by their rank pairs: whole repeats, and rows to look into. Repeats found before pass."""
    bucket = table.column("bucket")[0].as_py()
    settled = table.filter(pc.equal(table.column("kind"), REPEATS))
    table = table.filter(pc.equal(table.column("kind"), ROWS))
    if not table.num_rows:
        return settled
    chunks, source, doc, ids, cols = _gathered(table)
    gh, gl, r, place, more = (np.concatenate(c) for c in zip(*cols, strict=True))
    g = join48(gh, gl)
    order = np.lexsort((r, g))
    source, doc, ids, place, more = (x[order] for x in (source, doc, ids, place, more))
    hot, more = more > SPAN, more & SPAN
    group = _groups(g[order])
    pair = _groups(g[order], r[order])
    repeat = ids > _first_ids(pair, ids)
    asks = ~repeat & (ids > _first_ids(group, ids))
    # Whatever stays in a group that someone asks about is looked into.
    look = ~repeat & (hot | (np.bincount(group, weights=asks, minlength=group[-1] + 1 if len(group) else 0) > 0)[group])
    cols = [doc.astype(np.uint32), place.astype(np.uint32 if place.max(initial=0) < 1 << 32 else np.uint64), (more + hot * (SPAN + 1)).astype(np.uint16)]
    found = [x for kind, pick in ((REPEATS, repeat), (ASKED, look)) for x in _by_chunk(kind, bucket, chunks, source, np.flatnonzero(pick), cols)]
    return pa.concat_tables([settled.cast(_OUT_ARROW), pa.Table.from_batches(_batch(found), schema=_OUT_ARROW)])


_OUT_ARROW = pa.schema([("kind", pa.int32()), ("chunk", pa.string()), ("bucket", pa.int32()), ("docs", pa.binary()), ("rows", pa.binary())])


def _runs(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count-1 for each count, one after another."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _second_round(window: int, buckets: int):
    """Chunks with the rows asked about -> their single windows, in the same buckets; those of hot grams are dealt by their ranks."""

    def run(batches):
        for batch in batches:
            chunk, ids, sizes, data, asked = batch.columns
            for i in range(batch.num_rows):
                own_ids, own_sizes, raw = _opened(ids[i], sizes[i], data[i])
                ranks, others = Ranks(raw), Ranks(raw, 1)
                begin = np.cumsum(own_sizes) - own_sizes
                found = []
                rows = [unpack(one["rows"]) for one in asked[i].as_py()]
                doc, place, more = (np.concatenate(c) for c in zip(*rows, strict=True))
                asked_in = np.repeat([one["bucket"] for one in asked[i].as_py()], [len(r[0]) for r in rows])
                count = (more & SPAN).astype(np.int64) + 1
                p = np.repeat(begin[doc] + place.astype(np.int64), count) + _runs(count)
                d = np.repeat(doc, count).astype(np.int64)
                w, v = ranks.at(p, p + window), (others.at(p, p + window) >> np.uint64(32)).astype(np.uint32)
                repeat = _settle(own_ids[d], v, w)
                where = p - begin[d]
                if repeat.any():
                    found.append((REPEATS, chunk[i].as_py(), int(chunk[i].as_py()[:8], 16) % buckets, b"", pack(d[repeat].astype(np.uint32), where[repeat], np.zeros(repeat.sum(), dtype=np.uint8))))
                rest = np.flatnonzero(~repeat)
                rest = rest[np.lexsort((where[rest], d[rest]))]
                columns = [w[rest], v[rest], where[rest].astype(np.uint32 if own_sizes.max() < 1 << 32 else np.uint64)]
                # All rows of an ordinary gram come from one bucket, and so do its windows.
                dealt_to = np.where(np.repeat(more > SPAN, count)[rest], _bucket(w[rest], buckets), np.repeat(asked_in, count)[rest])
                for b, docs, dealt in _deal(dealt_to, columns, own_ids, d[rest]):
                    found.append((WINDOWS, chunk[i].as_py(), b, docs, dealt))
                yield from _batch(found)

    return run


def _windows_of_bucket(table: pa.Table) -> pa.Table:
    """Sort a bucket's windows by rank: those that a smaller id has too repeat. Repeats found before pass."""
    bucket = table.column("bucket")[0].as_py()
    settled = table.filter(pc.equal(table.column("kind"), REPEATS))
    table = table.filter(pc.equal(table.column("kind"), WINDOWS))
    if not table.num_rows:
        return settled
    chunks, source, doc, ids, cols = _gathered(table)
    w, v, place = (np.concatenate(c) for c in zip(*cols, strict=True))
    pick = np.flatnonzero(_settle(ids, v, w))
    cols = [doc.astype(np.uint32), place, np.zeros(len(place), dtype=np.uint8)]
    found = pa.Table.from_batches(_batch(list(_by_chunk(REPEATS, bucket, chunks, source, pick, cols))), schema=_OUT_ARROW)
    return pa.concat_tables([settled.cast(_OUT_ARROW), found])


def _cut(window: int, digest: bool):
    """Chunks with all repeats -> what is left of each document."""

    def run(batches):
        for batch in batches:
            _, ids, sizes, data, found = batch.columns
            for i in range(batch.num_rows):
                own_ids, own_sizes, raw = _opened(ids[i], sizes[i], data[i])
                end = np.cumsum(own_sizes)
                begin = end - own_sizes
                step = np.zeros(len(raw) + 1, dtype=np.int32)
                for one in found[i].as_py() or ():
                    doc, place, more = unpack(one["rows"])
                    more = more & SPAN
                    at = begin[doc] + place.astype(np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + more + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                left, n_removed, n_spans = [], [], []
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    own = gone[a:b]
                    n_removed.append(int(own.sum()))
                    n_spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
                    kept = (raw[a:b][~own] if n_removed[-1] else raw[a:b]).tobytes()
                    left.append(hashlib.sha256(kept).hexdigest() if digest else kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if k == LAST else k for k in own_ids.tolist()], pa.int64()),
                        pa.array(own_sizes, pa.int64()),
                        pa.array(n_removed, pa.int64()),
                        pa.array(n_spans, pa.int64()),
                        pa.array(left, pa.string() if digest else pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"],
                )

    return run


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """One list of packed rows for each chunk."""
    return rows.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "rows")).alias(name))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, digest: bool = True, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, and kept_sha256 or (digest off) the kept bytes."""
    spark = docs.sparkSession
    path = common.new_path(spark, "repeats-chunks")
    name = f"repeats_{uuid.uuid4().hex}"
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim(docs, id_col, text_col).mapInArrow(lambda batches: _packed(batches, chunk), "chunk string, ids binary, sizes binary, data binary").write.bucketBy(width, "chunk").option("path", path).option("compression", "uncompressed").saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the table's buckets are known to the plan
    total = chunks.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = min(max(8, 3 * total // BUCKET), 1 << 31)
    tasks = max(width, buckets // 4)

    def settled(rows: DataFrame, by) -> DataFrame:
        return rows.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(by, _OUT)

    hot = hot_grams(chunks, window, gram)
    pairs = common.stage(settled(chunks.mapInArrow(_first_round(window, gram, buckets, hot), _OUT), _pairs_of_bucket), "repeats-pairs")
    asked = _listed(pairs.where(F.col("kind") == ASKED), "asked")
    windows = settled(chunks.join(asked, "chunk").mapInArrow(_second_round(window, buckets), _OUT), _windows_of_bucket)
    repeats = pairs.where(F.col("kind") == REPEATS).unionByName(windows)
    whole = chunks.join(_listed(repeats, "found"), "chunk", "left").select("chunk", "ids", "sizes", "data", "found")
    kept = "kept_sha256 string" if digest else "kept binary"
    return whole.mapInArrow(_cut(window, digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept}")
