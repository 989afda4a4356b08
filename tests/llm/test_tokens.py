"""Encoders, prefix tables, codes and files against the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from redactlake.llm import huffman, prefix_bpe, token_output

NASTY = [
    "", " ", "a  b", "a \n b", "  x", "a\x1cb \x1c c \x85d", "it's we'll  ''s", "x\n\n y\t\tz  ", "日本語テキスト 漢字", "é́ 🤩 👨‍👩‍👧 1234 ²½", "<|endoftext|> <|endoftext|>",
    "a" * 300, "  " * 50, "a.\nB c,\nD e.\n\nF 'll.\n's é.\nÉ, ñ.", "x ,. ., .\n, '\n'", "  x　y ​ z",
]
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(JSON)
    own.encode_special_tokens = True
    return own


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=prefix_bpe.load_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("text", NASTY)
def test_encoders(text, library, reference):
    want = reference.encode_ordinary(text)
    assert library.encode(text, add_special_tokens=False).ids == want
    assert token_output.library_encoder(JSON)(text).tolist() == want
    bpe, encode = prefix_bpe.encoder(RANKS, P.PATTERN)
    assert encode(text).tolist() == want and bpe.decode(want) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abETs '.,\n\t \x1cé1²日"), max_size=40))
def test_any_text(text):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=prefix_bpe.encoder(RANKS, P.PATTERN)[0].ranks, special_tokens={}) if not hasattr(test_any_text, "own") else test_any_text.own
    test_any_text.own = own
    want = own.encode_ordinary(text)
    assert prefix_bpe.encoder(RANKS, P.PATTERN)[1](text).tolist() == want
    assert token_output.library_encoder(JSON)(text).tolist() == want


def test_append_and_edit():
    bpe, _ = prefix_bpe.encoder(RANKS, P.PATTERN)
    data = b"thonblend eauenxyz the quick" * 3
    last = bpe.table(data)
    whole, table = bpe.append(data, last, b"ened")
    assert table == bpe.table(whole)
    for at in range(0, len(data), 5):
        whole, table = bpe.edit(data, last, at, 3, b"qu")
        assert table == bpe.table(whole)


@pytest.mark.parametrize("limit", [8, 16])
def test_codes(limit):
    rng = np.random.default_rng(1)
    counts = np.zeros(3000, dtype=np.int64)
    counts[:200] = (1e6 / np.arange(1, 201) ** 2).astype(int) + 1
    size = huffman.lengths(counts, limit)
    assert size.max() <= limit and abs((2.0 ** -size[size > 0].astype(float)).sum() - 1) < 1e-9
    ids = rng.choice(200, 5000, p=counts[:200] / counts[:200].sum()).astype("<u2")
    counts = np.array([3000, 0, 1, 1999])
    bits, marks = huffman.pack(ids, counts, huffman.codes(size), size)
    own, before = [5, None, 7, 8], [0, 3000, 3000, 3001]
    block = huffman.write_block([*zip(own, before, counts.tolist(), marks, bits)])
    got = list(huffman.read_block(block, huffman.decode_table(size)))
    assert [x[0] for x in got] == own and [x[1] for x in got] == before
    assert all((x[2] == ids[a : a + n]).all() and len(x[2]) == n for x, a, n in zip(got, before, counts))
    with pytest.raises(ValueError, match="whole"):
        list(huffman.read_block(block[:-1] + b"x", huffman.decode_table(size)))


def test_lengths_are_best():
    """Without a limit that binds, the cost is that of a plain Huffman tree."""
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1, 1])
    heap = [c for c in counts.tolist() if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        cost += (x := heapq.heappop(heap) + heapq.heappop(heap))
        heapq.heappush(heap, x)
    assert int((huffman.lengths(counts) * counts).sum()) == cost


def test_files(spark, tmp_path, library, monkeypatch):
    rows = [(3, "b c"), (1, None), (2, "a " * 500), (None, "x"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_output.write(docs, f"{tmp_path}/f", JSON)
    got = [tuple(r) for r in token_output.read_digests(spark, f"{tmp_path}/f").collect()]
    want, at = [], 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert [r.ids for r in token_output.read(spark, f"{tmp_path}/f").collect() if r.doc_id == 9] == [[0]]
    token_output.write(docs.limit(0), f"{tmp_path}/e", JSON)
    assert token_output.read_digests(spark, f"{tmp_path}/e").count() == 0


def test_digests(spark, reference):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*NASTY, None])], "doc_id long, text string, n_tokens string")
    for r in prefix_bpe.digests(docs, RANKS, P.PATTERN).collect():
        text = ([*NASTY, ""])[r.doc_id]
        ids = reference.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    ids = prefix_bpe.with_ids(docs.withColumnRenamed("n_tokens", "token_ids"), RANKS, P.PATTERN)
    assert ids.columns == ["doc_id", "text", "token_ids", "_token_ids", "round_trip"] and all(r.round_trip for r in ids.collect())
    assert prefix_bpe.digests(docs.limit(0), RANKS, P.PATTERN).count() == 0
