"""Toxicity: bags of subword embeddings averaged into a linear softmax.

A word is the mean of the vectors of its hashed character n-grams, a window of
words the mean of its words, and a linear softmax over that gives toxic or not.
Vectors and softmax are trained jointly in numpy on the driver. A document scores
as its most toxic window does, whichever word it starts at, so a few words in a long
text still count; words of punctuation alone are in no window, here and in training, which
first averages whole documents, then follows the windows that score highest.

Only the difference of the two logits matters for a score, and it is linear in the
vectors: scoring broadcasts one number for each bucket of n-grams.

Learned from: at most ``TOXIC`` toxic and ``OTHER`` other labelled documents outside
the held-out fold, chosen by a hash of their ids; their whole texts.

Cases: null and wordless texts score the share of toxic rows among the labelled
ones; without rows of both labels every text scores that share (0.0 without any);
a label with a null id or value isn't used; of a document's several labels the
largest counts, of its several texts the one that sorts first is learned from; a null doc_id is scored and not held out; repeated rows score
alike; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.common import in_fold, slim

BITS = 18  # buckets of n-grams: 2 ** BITS
DIM = 8
GRAMS = (3, 4, 5, 6)
WINDOW = 2  # words
TOXIC, OTHER = 1000, 2500
WARM, STEPS, RATE = 10, 60, 0.05
DECAY = 1e-7
CACHE = 800_000  # words whose scores a worker remembers

_EDGE = ".,;:!?\"'()[]{}<>«»“”„‘’…|#*%$&@+-–—/\\_=~^`"


def normal(word: str) -> str:
    return word.lower().strip(_EDGE)


def grams(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, one word after another, and where each word begins."""
    marked = [f"<{w}>" for w in words]
    size = np.fromiter(map(len, marked), dtype=np.int64, count=len(words))
    cp = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), dtype=np.uint32)
    end = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(cp))
    h = np.zeros(len(cp), dtype=np.uint32)
    own, found = [], []
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(cp) - n + 1] * np.uint32(0x01000193) + cp[n - 1 :] * np.uint32(0x9E3779B1)
        if n in GRAMS:
            whole = place[: len(h)] + n <= end[: len(h)]
            x = h[whole] + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            found.append(((x ^ (x >> np.uint32(13))) >> np.uint32(32 - bits)).astype(np.int32))
            own.append(owner[: len(h)][whole])
    if not found:
        return np.zeros(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
    owner, bucket = np.concatenate(own), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=len(words))
    return bucket[order], np.cumsum(count) - count


def windows(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin in the words of all documents, one at each word that has a whole one left, and where each document's windows begin."""
    per = np.maximum(sizes - width + 1, 1)
    first = np.cumsum(per) - per
    start = np.repeat(np.cumsum(sizes) - sizes, per) + np.arange(per.sum()) - np.repeat(first, per)
    return start, first


def means(s: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The mean of the words of each window."""
    total = s[start].astype(np.float64)
    for k in range(1, WINDOW):
        total += np.where(k < width, s[np.minimum(start + k, len(s) - 1)], 0.0)
    return total / width


class Model:
    """score: number for each bucket; bias; share of toxic rows."""

    def __init__(self, score: np.ndarray | None, bias: float, share: float, bits: int = BITS):
        self.score, self.bias, self.share, self.bits = score, bias, share, bits

    def words(self, words: list[str]) -> np.ndarray:
        """The logit difference that each word gives; NaN for those of punctuation alone."""
        out = np.full(len(words), np.nan, dtype=np.float32)
        plain = [normal(w) for w in words]
        some = np.flatnonzero(np.fromiter(map(len, plain), dtype=np.int64, count=len(plain)))
        if len(some):
            bucket, start = grams([plain[i] for i in some], self.bits)
            out[some] = np.add.reduceat(self.score[bucket], start) / np.diff(np.append(start, len(bucket)))
        return out

    def texts(self, texts: list[str | None], known: dict[str, float]) -> list[float]:
        out = []
        for text in texts:
            ws = (text or "").split()
            if self.score is None or not ws:
                out.append(self.share)
                continue
            new = [w for w in set(ws) if w not in known]
            if new:
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = list(set(ws))
                known.update(zip(new, self.words(new).tolist(), strict=True))
            s = np.fromiter(map(known.__getitem__, ws), dtype=np.float64, count=len(ws))
            s = s[~np.isnan(s)]
            if not len(s):
                out.append(self.share)
                continue
            mean = means(s, np.arange(max(len(s) - WINDOW + 1, 1)), np.int64(min(WINDOW, len(s))))
            out.append(float(1 / (1 + np.exp(-np.clip(mean.max() + self.bias, -50, 50)))))
        return out


def train(texts: list[str], labels: list[int], share: float, bits: int = BITS, seed: int = 7) -> Model:
    """Vectors and softmax by full-batch Adam."""
    index: dict[str, int] = {}
    seqs = []
    for text in texts:
        ids = [index.setdefault(w, len(index)) for w in map(normal, text.split()) if w]
        seqs.append(np.array(ids, dtype=np.int32))
    use = [i for i, s in enumerate(seqs) if len(s)]
    y = np.array([labels[i] for i in use], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(None, 0.0, share, bits)
    inst = np.concatenate([seqs[i] for i in use])
    sizes = np.array([len(seqs[i]) for i in use])
    bucket, start = grams(list(index), bits)
    per_word = np.diff(np.append(start, len(bucket))).astype(np.float32)
    del index, seqs
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << bits, DIM)).astype(np.float32)
    out = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2)
    moments = [np.zeros_like(x, dtype=np.float32) for x in (vectors, vectors, out, out, bias, bias)]
    win, first = windows(sizes, WINDOW)
    doc_start = np.cumsum(sizes) - sizes
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    doc_of_win = np.repeat(np.arange(len(sizes)), np.diff(np.append(first, len(win))))
    width = np.minimum(WINDOW, sizes)[doc_of_win]
    for step in range(WARM + STEPS):
        diff = out[:, 1] - out[:, 0]
        word = np.add.reduceat((vectors @ diff)[bucket], start) / per_word
        s = word[inst]
        if step < WARM:
            at, n = doc_start, sizes
            logit = np.add.reduceat(s, at) / n
        else:
            mean = means(s, win, width)
            best = np.maximum.reduceat(mean, first)
            pick = np.full(len(sizes), -1)
            hit = np.flatnonzero(mean == best[doc_of_win])[::-1]
            pick[doc_of_win[hit]] = hit
            at, n, logit = win[pick], width[pick], best
        p = 1 / (1 + np.exp(-np.clip(logit + bias[1] - bias[0], -50, 50)))
        g = weight * (p - y)  # by the logit difference
        spread = np.repeat(g / n, n).astype(np.float32)
        places = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
        by_word = np.bincount(inst[places], weights=spread, minlength=len(start)) / per_word
        live = np.flatnonzero(by_word)
        spans = per_word[live].astype(np.int64)
        flat = np.repeat(start[live] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        by_bucket = np.bincount(bucket[flat], weights=np.repeat(by_word[live], spans), minlength=1 << bits).astype(np.float32)
        d_diff = by_bucket @ vectors
        grads = [by_bucket[:, None] * diff + DECAY * vectors, np.stack([-d_diff, d_diff], axis=1), np.array([-g.sum(), g.sum()])]
        for k, (x, d) in enumerate(zip((vectors, out, bias), grads, strict=True)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m *= 0.9
            m += 0.1 * d
            v *= 0.99
            v += 0.01 * d * d
            x -= RATE * min(1.0, 2 * (1 - step / (WARM + STEPS))) * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]), share, bits)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TOXIC, other: int = OTHER) -> Model:
    """A model of the labelled rows outside the held-out fold."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~in_fold(id_col))
    own = own.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    total, ones = own.agg(F.count(F.lit(1)), F.sum("label")).first()
    share = (ones or 0) / total if total else 0.0
    ids = [own.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic), (0, other))]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))  # toxic + other rows at most
    rows = slim(docs, id_col, text_col).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).toArrow()
    by_id = sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True))
    return train([t for _, t, _ in by_id], [y for _, _, y in by_id], share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            found = shared.value.texts(batch.column(1).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.float64()), pa.array([int(x >= 0.5) for x in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = slim(docs, id_col, text_col).withColumn("held_out", in_fold())
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
