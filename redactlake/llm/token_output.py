"""Token ids in binary files: Huffman blocks in ascending order of the documents.

Three passes: texts are encoded once and their ids staged; counts of all ids give
one canonical code; documents are coded, dealt into ranges of ids, and written as
blocks, a Parquet row each, beside a table of code lengths. Only id counts (as
many as the vocabulary) and one total a range reach the driver.

Cases: a null text counts as empty and has the end id alone; documents with the
same id follow each other in no fixed order; an added token that a text spells out,
as <|endoftext|>, has its own id, as in the library; a null id sorts first; a very long
document makes a block of its own; an empty table gives files without blocks;
other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm import huffman
from redactlake.llm.common import slim, stage
from redactlake.llm.pieces import PieceEncoder

BLOCK = 1 << 18  # ids after which a block ends
RANGE = 1 << 24  # ids of a range of documents, about
MOST_RANGES = 20_000  # tasks; a range is sorted on disk and streamed, so a larger one costs time, not memory

_held: dict[str, PieceEncoder] = {}
_whole: dict = {}

# How byte-level vocabularies spell bytes: visible Latin-1 characters stand for
# themselves, the others in order for the code points from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELLED = dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512), strict=False))


def library_encoder(path: str) -> PieceEncoder:
    """Texts by the tokenizers library, added tokens' strings being ordinary text; text_encoder() heeds them.

    The library's pre-tokenizer and model are called for each new piece; pieces seen
    before are looked up.
    """
    if path not in _held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        split, model = own.pre_tokenizer.pre_tokenize_str, own.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["post_processor"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level vocabularies can be cut at blanks")
        _held[path] = PieceEncoder(
            lambda piece: [t for t, _ in split(piece)] if piece else [],
            lambda token: [t.id for t in model.tokenize(token)],
            own.get_vocab_size(),
            lambda letters: letters.encode("utf-8", "replace").decode("latin-1").translate(_SPELLED),
        )
    return _held[path]


def text_encoder(path: str):
    """Whole texts as the tokenizers library encodes them without adding special tokens: an added token that a text spells out has its own id, and what lies between is cut anew."""
    if path not in _whole:
        from tokenizers import Tokenizer

        plain = library_encoder(path)
        added = {t.content: (i, t) for i, t in Tokenizer.from_file(path).get_added_tokens_decoder().items()}
        if any(t.single_word or t.lstrip or t.rstrip for _, t in added.values()):
            raise ValueError("only added tokens that stand for their own letters alone can be cut at")
        ids = {x: np.array([i], dtype=plain.dtype) for x, (i, _) in added.items()}
        find = re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None  # the longest first, as in the library

        def to_ids(text: str) -> np.ndarray:
            if find is None or find.search(text) is None:
                return plain(text)
            parts, at = [], 0
            for m in find.finditer(text):
                parts += [plain(text[at : m.start()]), ids[m[0]]]
                at = m.end()
            return np.concatenate([*parts, plain(text[at:])])

        to_ids.dtype = plain.dtype
        _whole[path] = to_ids
    return _whole[path]


def encode(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """doc_id, n and ids (little-endian, 2 or 4 bytes each by the vocabulary) of each text, with the end id."""

    def run(batches):
        to_ids = text_encoder(path)
        end = np.array([end_id], dtype=to_ids.dtype).tobytes()
        for batch in batches:
            ids = [to_ids(t.as_py()).tobytes() + end for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // to_ids.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])

    return slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, ids binary")


def joined(column: pa.Array, width: str) -> np.ndarray:
    """The ids of all rows of a binary column, one row after another."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].view(width) if data is not None and len(column) else np.zeros(0, dtype=width)


def count_ids(encoded: DataFrame, n_ids: int) -> np.ndarray:
    width = "<u2" if n_ids <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(n_ids, dtype=np.int64)
        for batch in batches:
            total += np.bincount(joined(batch.column(0), width), minlength=n_ids)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_ids, dtype=np.int64)
    counts[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return counts


def part_of(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The range that each document is in; the first for null ids."""
    return np.searchsorted(bounds, ids.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32)


def write(docs: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Write the ids of all texts below the folder out."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    n_ids = Tokenizer.from_file(path).get_vocab_size()
    encoded = stage(encode(docs, path, id_col, text_col, end_id), "token-ids")
    size = huffman.lengths(count_ids(encoded, n_ids))
    spark.createDataFrame([(i, int(size[i])) for i in np.flatnonzero(size).tolist()], "id int, bits int").coalesce(1).write.parquet(f"{out}/code")
    total, lowest = encoded.agg(F.sum("n"), F.min("doc_id")).first()
    ranges = min(MOST_RANGES, max(1, (total or 0) // RANGE))
    cuts = encoded.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    bounds = np.unique(np.array(cuts, dtype=np.int64))
    shared = spark.sparkContext.broadcast((size, bounds))

    def code(batches):
        size, bounds = shared.value
        symbols = huffman.codes(size)
        width = "<u2" if n_ids <= 1 << 16 else "<u4"
        for batch in batches:
            ids, counts = joined(batch.column(2), width), batch.column(1).to_numpy()
            part = part_of(batch.column(0), bounds)
            end = np.cumsum(counts)
            at = 0
            while at < batch.num_rows:  # about a million ids at once
                before = end[at] - counts[at]
                to = max(at + 1, int(np.searchsorted(end, before + (1 << 20), side="right")))
                bits, marks = huffman.pack(ids[before : end[to - 1]], counts[at:to], symbols, size)
                rows = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([pa.array(part[at:to]), rows.column(0), rows.column(1), pa.array(marks, pa.binary()), pa.array(bits, pa.binary())], ["part", "doc_id", "n", "marks", "bits"])
                at = to

    def sum_up(batches):
        _, bounds = shared.value
        sums = np.zeros(len(bounds) + 1, dtype=np.int64)
        for batch in batches:
            np.add.at(sums, part_of(batch.column(0), bounds), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["part", "n"])

    sums = dict(encoded.select("doc_id", "n").mapInArrow(sum_up, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts = spark.sparkContext.broadcast(np.concatenate([[0], np.cumsum([sums.get(k, 0) for k in range(len(bounds) + 1)])]).tolist())

    def assemble(batches):
        part, block, held, before = -1, 0, 0, 0
        docs: list = []

        def flush():
            nonlocal block, held
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([docs[0][1]], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([huffman.write_block(docs)], pa.binary())],
                ["part", "block", "start", "n_docs", "data"],
            )
            docs.clear()
            block, held = block + 1, 0
            return row

        for batch in batches:
            for i in range(batch.num_rows):
                k, doc, n, marks, bits = (c[i].as_py() for c in batch.columns)
                if k != part:
                    if docs:
                        yield flush()
                    part, block, before = k, 0, starts.value[k]
                docs.append((doc, before, n, marks, bits))
                before, held = before + n, held + n
                if held >= BLOCK:
                    yield flush()
        if docs:
            yield flush()

    coded = encoded.mapInArrow(code, "part int, doc_id long, n long, marks binary, bits binary")
    coded = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())
    coded.mapInArrow(assemble, "part int, block int, start long, n_docs long, data binary").write.option("compression", "uncompressed").parquet(f"{out}/blocks")


def read(spark, out: str) -> DataFrame:
    """doc_id, start, ids of every document of files that write() made."""

    def as_rows(doc_id, start, ids):
        return pa.array(ids, pa.list_(pa.int64())), "ids"

    return _decoded(spark, out, as_rows, "ids array<bigint>")


def read_digests(spark, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""

    def as_rows(doc_id, start, ids):
        return pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), "ids_crc32"

    return _decoded(spark, out, as_rows, "ids_crc32 long")


def _decoded(spark, out: str, as_rows, column: str) -> DataFrame:
    rows = spark.read.schema("id int, bits int").parquet(f"{out}/code").toArrow()
    size = np.zeros(max(rows.column("id").to_pylist(), default=0) + 1, dtype=np.uint8)
    size[rows.column("id").to_numpy()] = rows.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(size)

    def run(batches):
        table = huffman.decode_table(shared.value)
        for batch in batches:
            for block in batch.column(0):
                own, start, ids = zip(*huffman.read_block(block.as_py(), table), strict=True)
                last, name = as_rows(own, start, ids)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(start, pa.int64()), pa.array(list(map(len, ids)), pa.int64()), last], ["doc_id", "start", "n_tokens", name])

    blocks = spark.read.schema("part int, block int, start long, n_docs long, data binary").parquet(f"{out}/blocks")
    return blocks.select("data").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")
