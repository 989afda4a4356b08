"""Byte-level BPE by prefix dynamic programming.

BPE's result for a byte string ends in one token, and what comes before it is the
result for the prefix that remains. So every prefix has a unique valid last token:
the token that ends there and is compatible with the last token of the prefix it
leaves. Two adjacent tokens are compatible if undoing their merges never meets a
pair that BPE would have merged across the border earlier. Storing the last token
of each prefix gives the whole encoding by walking back, lets text be appended
exactly without starting over, and makes an edit cost only what follows it.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactlake.llm.common import free_name, slim
from redactlake.llm.pieces import PieceEncoder

PIECES = 250_000  # pieces of text whose ids a worker remembers, in each of two generations
PAIRS = 300_000  # pairs of tokens whose compatibility it remembers
ROWS = 500  # rows whose ids are held at once

# White space as the tokenizer's engine has it.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file; ranks are the ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def compiled(pattern: str):
    """The pre-tokenizer's pattern with its white space spelled out."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]"))


class PrefixBPE:
    """ranks must hold all single bytes and be numbered in order of merging."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.halves: dict[int, tuple[int, int]] = {}  # the two tokens that a token was merged from
        self.pairs: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.tree: dict = {}  # by byte the tokens that go on so; at 256 the token that ends here
        for b, r in ranks.items():
            node = self.tree
            for c in b:
                node = node.setdefault(c, {})
            node[256] = r
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                self.halves[r] = (r, r)
                continue
            # Tokens of lower rank are in place, so the dynamic programme below, kept
            # from using the token itself, gives the two it is made of.
            last = self.table(b, below=r)
            right = last[len(b)]
            left = last[len(b) - len(self.bytes_of[right])] if right >= 0 else -1
            if left >= 0 and len(self.bytes_of[left]) + len(self.bytes_of[right]) == len(b):
                self.halves[r] = (left, right)
                self.pairs[left, right] = r
            else:
                self.halves[r] = (r, r)  # no merge makes it: it stands only for itself
        self.fits.clear()

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two adjacent tokens alone."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, pairs, halves = left, right, self.pairs, self.halves
        limit = len(self.bytes_of)  # merges from this rank on come too late to cross
        while True:
            if pairs.get((a, b), limit) < limit:
                good = False
                break
            # Undo the later of the two tokens' last merges, on the side of the border.
            undo_left = a > b
            for side in (undo_left, not undo_left):
                if side:
                    inner = halves[a][1]
                    if inner != a:
                        limit, a = a, inner
                        break
                else:
                    inner = halves[b][0]
                    if inner != b:
                        limit, b = b + 1, inner
                        break
            else:
                good = True
                break
        if len(self.fits) > PAIRS:
            self.fits.clear()
        self.fits[left, right] = good
        return good

    def table(self, data: bytes, last: list[int] | None = None, start: int = 0, below: int | None = None) -> list[int]:
        """last[i]: the last token of BPE's result for data[:i], -1 at 0.

        last and start: a table whose entries up to start hold already, for appends
        and edits. below: only tokens of lower rank are used.
        """
        last = [-1] if last is None else last[: start + 1]
        self._fill(data, last, len(data), below)
        return last

    def _fill(self, data: bytes, last: list[int], size: int, below: int | None = None) -> None:
        """Carry a table on, in place, to the prefix of size bytes."""
        start = len(last) - 1
        last += [-1] * (size - start)
        fits, tree = self.fits, self.tree
        for at in range(max(0, start + 1 - self.longest), size):
            before = last[at]
            if before < 0 and at:
                continue
            node, i = tree, at
            while i < size:
                node = node.get(data[i])
                if node is None:
                    break
                i += 1
                # A prefix has one valid last token, so the first that is found is it.
                if i > start and last[i] < 0 and (token := node.get(256)) is not None and (below is None or token < below):
                    if at:
                        good = fits.get((before, token))
                        if good is None:
                            good = self.compatible(before, token)
                        if not good:
                            continue
                    last[i] = token

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        """The tokens that a table says, from the end back."""
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        """BPE of one pre-token."""
        own = self.ranks.get(data)
        return [own] if own is not None else self.walk(data, self.table(data))

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The table of data + more from that of data."""
        whole = data + more
        return whole, self.table(whole, last, len(data))

    def edit(self, data: bytes, last: list[int], at: int, drop: int, put: bytes) -> tuple[bytes, list[int]]:
        """The table after data[at:at+drop] gave way to put.

        Entries before the edit hold. After it, the old entries hold again once as many
        entries in a row as the longest token has bytes have come out as before.
        """
        whole = data[:at] + put + data[at + drop :]
        shift = len(put) - drop
        out = last[: at + 1]
        same = 0
        while len(out) <= len(whole):
            i = len(out)
            self._fill(whole, out, min(len(whole), i + self.longest))
            for k in range(i, len(out)):
                old = k - shift
                same = same + 1 if k > at + len(put) and 0 <= old < len(last) and last[old] == out[k] else 0
                if same > self.longest:
                    return whole, out[: k + 1] + last[old + 1 :]
        return whole, out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_held: dict[str, tuple[PrefixBPE, PieceEncoder]] = {}


def encoder(path: str, pattern: str) -> tuple[PrefixBPE, PieceEncoder]:
    """The vocabulary and the text encoder of a rank file, built once in a process."""
    if path not in _held:
        bpe = PrefixBPE(load_ranks(path))
        find = compiled(pattern).findall
        _held[path] = bpe, PieceEncoder(find, lambda t: bpe.encode(t.encode("utf-8", "replace")), len(bpe.bytes_of), size=PIECES)
    return _held[path]


def with_ids(docs: DataFrame, path: str, pattern: str, text_col: str = "text", name: str = "token_ids", check: str = "round_trip") -> DataFrame:
    """docs with two more columns: the ids of each text (null: empty) and whether they decode to it."""
    name, check, text = free_name(docs, name), free_name(docs, check), free_name(docs, "bpe_text")

    def run(batches):
        bpe, encode = encoder(path, pattern)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ids, same = [], []
            for t in batch.column(text):
                own = t.as_py() or ""
                ids.append(encode(own))
                same.append(bpe.decode(ids[-1].tolist()) == own.encode())
            flat = np.concatenate(ids).astype(np.int32)
            cuts = np.concatenate([[0], np.cumsum(list(map(len, ids)))]).astype(np.int32)
            batch = batch.drop_columns([text])
            yield batch.append_column(name, pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))).append_column(check, pa.array(same, pa.bool_()))

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType())), T.StructField(check, T.BooleanType())])
    return docs.withColumn(text, F.col(text_col).cast("string")).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, decoded from its ids.

    Cases: a null text counts as empty and has no tokens; of very long texts only
    the ids are held besides; rows are told apart by nothing, so repeated rows give
    repeated rows; other columns are not looked at.
    """

    def run(batches):
        bpe, encode = encoder(path, pattern)
        words = list(map(str, range(len(bpe.bytes_of))))
        for batch in batches:
            n, ids_sha, out_sha = [], [], []
            for t in batch.column(1):
                ids = encode(t.as_py()).tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(words.__getitem__, ids)).encode()).hexdigest())
                out_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
