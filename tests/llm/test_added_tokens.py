"""Operator 1 against the library as it is loaded, on texts that spell out an added token."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from redactlake.llm import token_output

JSON = P.path("byte_bpe_50k.json")
OWN = Tokenizer.from_file(JSON)
END = "<|endoftext|>"


@pytest.mark.parametrize("text", ["a <|endoftext|> b", END, END * 2, f" {END}  {END} \n", f"a{END}b", f"<|endoftext|{END}>", "<|endoftext|", "", "a  b"])
def test_encoder(text):
    assert token_output.text_encoder(JSON)(text).tolist() == OWN.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([END, " ", "a", "<|", "|>", "\n", "é", "'s", "."]), max_size=20).map("".join))
def test_any_text(text):
    assert token_output.text_encoder(JSON)(text).tolist() == OWN.encode(text, add_special_tokens=False).ids


def test_files(spark, tmp_path):
    rows = [(1, "a b"), (2, f"a {END} b"), (3, "c"), (4, END)]
    token_output.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), f"{tmp_path}/f", JSON)
    want, at = [], 0
    for k, t in rows:
        ids = np.array([*OWN.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in token_output.read_digests(spark, f"{tmp_path}/f").orderBy("doc_id").collect()] == want
