"""Canonical length-limited Huffman codes for token ids, in numpy.

A block holds whole documents. Each document's bits begin at a byte; every
``STEP`` ids a checkpoint holds the bit where the next id begins, so all stretches
between checkpoints decode side by side, one table look-up a step for all of them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

STEP = 128
LIMIT = 16
MAGIC = b"IDHB1\0"
_HEAD = struct.Struct("<6sHQQQQ")  # magic, step, documents, checkpoints, payload bytes, crc32 of what follows
_NULL = np.iinfo(np.int64).min


def lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code lengths by package-merge; 0 for ids that never occur.

    The limit grows where there are more ids than codes of that length.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # Each level merges the coins of the symbols with the packages of the level below.
    # A level's list is kept as its sort order: entries under n are symbols.
    packages = np.zeros(0)
    levels = []
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by)
        merged = merged[by]
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
    size = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for by in reversed(levels):
        chosen = by[:take]
        symbols = chosen[chosen < n]
        size[symbols] += 1
        take = 2 * (len(chosen) - len(symbols))
    out[order] = size
    return out


def codes(size: np.ndarray) -> np.ndarray:
    """The canonical codes of code lengths: shorter first, then by id."""
    used = np.flatnonzero(size)
    order = used[np.argsort(size[used], kind="stable")]
    out = np.zeros(len(size), dtype=np.uint32)
    code = last = 0
    for k in range(1, int(size.max(initial=0)) + 1):
        own = order[size[order] == k]
        code <<= k - last
        last = k
        out[own] = code + np.arange(len(own), dtype=np.uint32)
        code += len(own)
    return out


def decode_table(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and length for each value of the next ``width`` bits."""
    width = int(size.max(initial=1))
    ids, lens = np.zeros(1 << width, dtype=np.uint32), np.zeros(1 << width, dtype=np.uint8)
    used = np.flatnonzero(size)
    order = used[np.argsort(size[used], kind="stable")]
    spread = np.left_shift(1, width - size[order].astype(np.int64))
    ids[: spread.sum()] = np.repeat(order.astype(np.uint32), spread)
    lens[: spread.sum()] = np.repeat(size[order], spread)
    return ids, lens, width


def pack(ids: np.ndarray, counts: np.ndarray, code: np.ndarray, size: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Bits of documents that lie one after another in ids, each filled up to whole bytes, and the checkpoints of each."""
    if not len(ids):
        return [b""] * len(counts), [b""] * len(counts)
    n = size[ids].astype(np.int64)
    if not n.all():
        raise ValueError("an id has no code")
    end = np.concatenate([[0], np.cumsum(n)])
    stop = np.cumsum(counts)
    first = stop - counts
    nbytes = (end[stop] - end[first] + 7) // 8
    to = np.cumsum(nbytes) - nbytes
    begin = end[:-1] + np.repeat(to * 8 - end[first], counts)
    # A code fits in 32 bits, so it touches its 32-bit word and the next at most.
    value = code[ids].astype(np.uint64) << (np.uint64(64) - n.astype(np.uint64) - (begin & 31).astype(np.uint64))
    word = begin >> 5
    head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros((int(begin[-1] + n[-1]) >> 5) + 2, dtype=np.uint64)
    out[word[head]] = np.add.reduceat(value >> np.uint64(32), head)
    out[word[head] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), head)
    bits = out.astype(">u4").tobytes()
    stretches = -(-counts // STEP)
    last = np.cumsum(stretches)
    at = np.repeat(first, stretches) + (np.arange(last[-1]) - np.repeat(last - stretches, stretches)) * STEP
    marks = (begin[at] - np.repeat(to * 8, stretches)).astype("<u8")
    pieces = zip(to.tolist(), (to + nbytes).tolist(), (last - stretches).tolist(), last.tolist(), strict=True)
    both = [(bits[a:b], marks[c:d].tobytes()) for a, b, c, d in pieces]
    return [x for x, _ in both], [x for _, x in both]


def unpack(payload: bytes, begin: np.ndarray, count: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Ids of the stretches that begin at given bits and hold ``count`` ids each, one after another."""
    ids, lens, width = table
    padded = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8)
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.uint32)
    order = np.argsort(-count, kind="stable")
    at, to, left = begin[order].astype(np.int64), start[order], count[order]
    mask, shift = np.int64((1 << width) - 1), np.int64(40 - width)
    for k in range(int(count.max(initial=0))):
        live = int(np.searchsorted(-left, -k, side="left"))  # stretches with over k ids
        at, to = at[:live], to[:live]
        byte = at >> 3
        window = padded[byte].astype(np.int64)
        for b in range(1, 5):
            window = (window << 8) | padded[byte + b]
        key = (window >> (shift - (at & 7))) & mask
        out[to + k] = ids[key]
        at = at + lens[key]
    return out


def write_block(docs: list[tuple[int | None, int, int, bytes, bytes]]) -> bytes:
    """A block from (doc_id, ids before it, ids in it, checkpoints, bits) of documents."""
    own = np.array([_NULL if d[0] is None else d[0] for d in docs], dtype="<i8").tobytes()
    meta = np.array([[d[1], d[2], len(d[4])] for d in docs], dtype="<u8").tobytes()
    marks = b"".join(d[3] for d in docs)
    body = own + meta + marks + b"".join(d[4] for d in docs)
    return _HEAD.pack(MAGIC, STEP, len(docs), len(marks) // 8, len(body), zlib.crc32(body)) + body


def read_block(block: bytes, table: tuple[np.ndarray, np.ndarray, int]):
    """(doc_id, ids before it, its ids) of each document of a block."""
    magic, step, n, marks, size, crc = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or len(body) != size or zlib.crc32(body) != crc:
        raise ValueError("not a whole block")
    own = np.frombuffer(body, dtype="<i8", count=n)
    before, count, nbytes = np.frombuffer(body, dtype="<u8", count=3 * n, offset=8 * n).reshape(n, 3).astype(np.int64).T
    mark = np.frombuffer(body, dtype="<u8", count=marks, offset=32 * n).astype(np.int64)
    payload = bytes(body[32 * n + 8 * marks :])
    first = (np.cumsum(nbytes) - nbytes) * 8
    stretches = -(-count // step)
    doc = np.repeat(np.arange(n), stretches)
    k = np.arange(marks) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    ids = unpack(payload, first[doc] + mark, np.minimum(step, count[doc] - k * step), table)
    cuts = np.cumsum(count)
    for i in range(n):
        yield None if own[i] == _NULL else int(own[i]), int(before[i]), ids[cuts[i] - count[i] : cuts[i]]
